"""Sinks: feature tables, summaries, live dumps, prediction history and model runs."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under the cluster's shared checkpoint folder. Only a session without executors may do without one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        return tempfile.mkdtemp(prefix="barloom-")
    name = spark.range(1).select(F.uuid().alias("u")).first().u
    return f"{shared.rstrip('/')}/barloom-{name}"


def write_parquet(df: DataFrame, path: str, partition_by: Iterable[str] = (), mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path, header=True)


def write_summary_csv(summary: DataFrame, path: str) -> None:
    """A one-row summary as one file with a header."""
    write_csv(summary.coalesce(1), path)


def append_live(df: DataFrame, path: str, source: str) -> None:
    """Append bars or latest feature rows with source and time of arrival, one folder per day of arrival.

    Symbols stay a column, sorted inside the files, so that their number does not multiply the files.
    """
    now = F.current_timestamp()
    stamped = df.withColumns({"Source": F.lit(source), "Timestamp": now, "ingest_date": F.to_date(now)})
    stamped.sortWithinPartitions("Symbol", "Date").write.mode("append").partitionBy("ingest_date").parquet(path)


def prediction_records(scored: DataFrame, source: str, model: str = "Random Forest") -> DataFrame:
    """Scored rows as history records with nested details."""
    return scored.select(
        F.col("Symbol").alias("symbol"),
        "prediction",
        F.round("confidence", 4).alias("confidence"),
        F.current_timestamp().alias("timestamp"),
        F.lit(source).alias("source"),
        F.lit(model).alias("model"),
        F.struct(
            F.col("Date").alias("latest_date"),
            F.col("p_down").alias("down_probability"),
            F.col("p_up").alias("up_probability"),
            F.struct(
                *[F.round(c, 4).alias(c.lower()) for c in ("Open", "High", "Low", "Close")],
                F.col("Volume").cast("long").alias("volume"),
            ).alias("quote"),
        ).alias("meta"),
    )


def append_predictions(records: DataFrame, path: str) -> None:
    records.write.mode("append").parquet(path)


def append_model_run(
    metrics: DataFrame,
    importances: DataFrame,
    path: str,
    model: str,
    params: dict,
    folds: DataFrame | None = None,
    confusion: DataFrame | None = None,
    report: DataFrame | None = None,
    confidence: DataFrame | None = None,
    split: str = "first 80 % by time",
    validation: str = "time-ordered folds inside the training part",
) -> None:
    """Append one nested record: metrics, confusion matrix, report, confidence, parameters, split, fold scores and the
    20 strongest features.

    `metrics`, `confusion` and `confidence` hold one row, `report` one per label, `folds` one per fold; `importances` one per
    feature of the model vector.
    """
    def rows(df: DataFrame):
        return df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias("rows")).scalar()

    top = importances.orderBy(F.desc("importance"), "feature").limit(20)
    tops = top.agg(F.reverse(F.array_sort(F.collect_list(F.struct("importance", "feature")))).alias("t")).scalar()
    settings = F.create_map(*[F.lit(str(v)) for pair in params.items() for v in pair])
    record = metrics.select(
        F.lit(model).alias("model"),
        F.current_timestamp().alias("run_time"),
        *metrics.columns,
        settings.alias("params"),
        F.lit(split).alias("split"),
        F.lit(validation).alias("validation"),
        tops.alias("top_features"),
    )
    for name, df in (("confusion", confusion), ("confidence", confidence)):
        if df is not None:
            record = record.withColumn(name, df.select(F.struct(*df.columns)).scalar())
    if report is not None:
        record = record.withColumn("report", rows(report))
    if folds is not None:
        record = record.withColumn("folds", rows(folds)).withColumn(
            "cv", folds.agg(F.struct(F.avg("accuracy").alias("mean"), F.stddev_pop("accuracy").alias("std"))).scalar())
    record.write.mode("append").parquet(path)
