"""Whole jobs: from raw bars to written features and their summary, live features of asked symbols, and recorded predictions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import ml, reports
from barloom.plans import cleaning, features
from barloom.schema import BAR_COLUMNS, FEATURES, require_columns
from barloom.sources import writers


@dataclass(frozen=True)
class BatchResult:
    """What a batch job wrote, read back: cleaned bars, their features, the one-row summary and the rows per cleaning stage."""

    bars: DataFrame
    features: DataFrame
    summary: DataFrame
    stages: DataFrame


def batch_job(raw: DataFrame, out: str, min_rows: int = 100, fmt: str | list[str] | None = None, intraday: bool = False) -> BatchResult:
    """Validate, clean, compute the batch features, write both as Parquet and the summary as CSV.

    Cleaned bars are written before the features are computed, so that no step of the cleaning runs twice.
    """
    spark = raw.sparkSession
    require_columns(raw, [*BAR_COLUMNS, "seq"])
    writers.write_parquet(cleaning.clean(raw, min_rows, fmt, intraday), f"{out}/bars")
    bars = spark.read.parquet(f"{out}/bars")
    writers.write_parquet(features.batch_features(bars), f"{out}/features")
    made = spark.read.parquet(f"{out}/features")
    summary = reports.summary(made)
    writers.write_summary_csv(summary, f"{out}/summary")
    writers.write_parquet(cleaning.stage_counts(raw, min_rows, fmt, intraday), f"{out}/stages")
    return BatchResult(bars, made, spark.read.schema(summary.schema).csv(f"{out}/summary", header=True), spark.read.parquet(f"{out}/stages"))


def live_job(bars: DataFrame, symbols: DataFrame, out: str, source: str) -> DataFrame:
    """Append the complete live features of the asked symbols (a column Symbol) with source and time of arrival; returns them.

    Symbols are picked before anything is computed; rows without all model columns are left out.
    """
    asked = bars.select(*require_columns(bars, BAR_COLUMNS).columns).join(symbols.select("Symbol").distinct(), "Symbol", "left_semi")
    live = require_columns(features.live_features(asked), FEATURES).dropna(subset=FEATURES)
    columns = live.columns
    writers.append_live(live, out, source)
    return bars.sparkSession.read.parquet(out).select(*columns)


def predict_and_record(symbols: DataFrame, bars: DataFrame, model: ml.Forest, history: str, source: str, name: str = "Random Forest") -> DataFrame:
    """The latest complete bar of each asked symbol, scored and appended to the history; returns a status for every symbol.

    Nothing is recorded for a symbol without bars or without a complete row.
    """
    live = features.live_features(bars.join(symbols.select("Symbol").distinct(), "Symbol", "left_semi"))
    path = f"{writers.scratch_dir(bars.sparkSession)}/scored"
    # scored once, for the record and for the answer
    writers.write_parquet(ml.score_batch(symbols.select("Symbol").distinct(), live, model), path)
    scored = bars.sparkSession.read.parquet(path)
    writers.append_predictions(writers.prediction_records(scored.filter("status = 'ok'"), source, name), history)
    return scored.select("Symbol", "Date", "status", "prediction", F.round("confidence", 4).alias("confidence"))
