"""The training job: split, weights, fit, metrics, cross-validation and the record of the run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import datasets, evaluate, ml
from barloom.operators.clean import drop_nonfinite
from barloom.operators.ranking import time_split
from barloom.schema import FEATURES
from barloom.sources.writers import scratch_dir, write_parquet


@dataclass(frozen=True)
class Run:
    """A fitted model and what is known about it; all frames are of a fixed small size but `scored`."""

    model: ml.Forest
    scored: DataFrame
    metrics: DataFrame
    confusion: DataFrame
    report: DataFrame
    confidence: DataFrame
    importances: DataFrame
    folds: DataFrame | None


def train_structured(rows: DataFrame, cols: list[str] = FEATURES, target: str = "Target", train: float = 0.8, folds: int = 5, **params) -> Run:
    """Fit on the first part by time, weighted by its own classes, and judge on the rest.

    Cross-validation stays inside the training part and weighs like the model. `folds=0` leaves it out.
    """
    spark, path = rows.sparkSession, scratch_dir(rows.sparkSession)
    write_parquet(time_split(drop_nonfinite(rows, cols), train), f"{path}/rows")
    finite = spark.read.parquet(f"{path}/rows")
    first, rest = (finite.filter(F.col("role") == role).drop("role") for role in ("train", "test"))
    model = ml.train_forest(first, cols, target, **params)
    # scoring sends the model to every task
    write_parquet(ml.score(ml.in_few_parts(rest), model), f"{path}/scored")
    scored = spark.read.parquet(f"{path}/scored")
    judged = evaluate.predicted(scored.select(F.col(target).alias("y"), F.col("p_up").alias("p"), "confidence"))
    return Run(
        model, scored,
        evaluate.classification_metrics(judged).withColumn("roc_auc", evaluate.roc_auc(judged).scalar()),
        evaluate.confusion_matrix(judged),
        evaluate.classification_report(judged),
        scored.agg(*[f("confidence").alias(n) for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]),
        ml.feature_importance(model, list(cols)),
        ml.cross_validate(first, cols, target, folds, **params) if folds else None,
    )


@dataclass(frozen=True)
class SequenceRun:
    """A fitted sequence classifier, the bounds its inputs were scaled by, its scored test sequences and their metrics."""

    model: object
    bounds: DataFrame
    scored: DataFrame
    metrics: DataFrame


def train_sequences(rows: DataFrame, length: int = 60, cols: list[str] = FEATURES, target: str = "Target", train: float = 0.8, **params) -> SequenceRun:
    """Fit a sequence classifier on the first part by time and judge it on the rest.

    Either part makes its sequences from its own rows, so the first `length` rows of a symbol in the rest have none: a
    gap that keeps every window on one side of the cut. Values are scaled by the bounds of the first part alone.
    """
    spark, path = rows.sparkSession, scratch_dir(rows.sparkSession)
    write_parquet(time_split(drop_nonfinite(rows, cols), train).select("Symbol", "Date", target, *cols, "role"), f"{path}/rows", ["role"])
    finite = spark.read.schema(rows.select("Symbol", "Date", target, *cols).withColumn("role", F.lit("")).schema).parquet(f"{path}/rows")
    first = finite.filter("role = 'train'")
    bounds = datasets.minmax_fit(first, cols)
    for role in ("train", "test"):
        part = datasets.minmax_transform(finite.filter(F.col("role") == role).drop("role"), bounds, cols)
        write_parquet(datasets.sequences(part, length, cols, target), f"{path}/{role}")
    model = ml.sequence_classifier(ml.in_few_parts(spark.read.parquet(f"{path}/train")), **params)
    write_parquet(ml.score_sequences(spark.read.parquet(f"{path}/test"), model).drop("sequence"), f"{path}/scored")
    scored = spark.read.parquet(f"{path}/scored")
    judged = evaluate.predicted(scored.select(F.col("label").alias("y"), F.col("p_up").alias("p")))
    return SequenceRun(model, bounds, scored, evaluate.classification_metrics(judged).withColumn("roc_auc", evaluate.roc_auc(judged).scalar()))


_FRAMES = ("scored", "metrics", "confusion", "report", "confidence", "importances", "folds")


def save_run(run: Run, path: str) -> None:
    """The model and all that is known about it, one folder each."""
    ml.save_model(run.model, f"{path}/model")
    for name in _FRAMES:
        df = getattr(run, name)
        if df is not None:
            # all but the scored rows are of a fixed small size
            write_parquet(df if name == "scored" else df.coalesce(1), f"{path}/{name}")


def load_run(spark: SparkSession, path: str, folds: bool = True) -> Run:
    """A saved run; folds=False for one that was made without cross-validation."""
    read = {name: spark.read.parquet(f"{path}/{name}") for name in _FRAMES if name != "folds" or folds}
    return Run(ml.load_model(f"{path}/model"), **{"folds": None, **read})


def flatten_embedding(fused: DataFrame, embedding: str = "embedding", size: int = 128) -> tuple[DataFrame, list[str]]:
    """The embedding as columns of their own, and the names of the fused vector: features first."""
    names = [f"embedding_{i}" for i in range(size)]
    return fused.select("*", *[F.get(embedding, F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)]), [*FEATURES, *names]


def train_fusion(fused: DataFrame, embedding: str = "embedding", size: int = 128, structured: DataFrame | None = None, **params) -> tuple[Run, DataFrame | None]:
    """The same job over features fused with embeddings, rows with values that are not finite left out.

    With the metrics of the structured model also the comparison of the two.
    """
    wide, names = flatten_embedding(fused, embedding, size)
    run = train_structured(wide, names, **{**ml.FUSION_FOREST, **params})
    return run, None if structured is None else compared(run.metrics, structured)


def compared(metrics: DataFrame, base: DataFrame) -> DataFrame:
    """One row of metrics with its gain over another run's."""
    known = base.select(F.struct(*base.columns)).scalar()
    return metrics.select(*metrics.columns, *[(F.col(n) - known[n]).alias(f"{n}_gain") for n in metrics.columns])
