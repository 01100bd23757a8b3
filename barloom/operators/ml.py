"""Random forests and sequence classifiers over the feature tables, with Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from operator import add

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.clean import drop_nonfinite
from barloom.operators.datasets import latest_complete
from barloom.operators.evaluate import class_weights, confusion_matrix, predicted
from barloom.operators.ranking import fold_parts
from barloom.schema import FEATURES, require_order
from barloom.sources.writers import scratch_dir

# Hyperparameters of the two forests.
FOREST = {"numTrees": 900, "maxDepth": 20, "minInstancesPerNode": 4, "featureSubsetStrategy": "sqrt", "seed": 42}
FUSION_FOREST = {"numTrees": 1000, "maxDepth": 25, "minInstancesPerNode": 3, "featureSubsetStrategy": "sqrt", "seed": 42}


# Every level of the trees sends them to every task: enough rows a task.
ROWS_A_TASK = 100_000
#: most shares of a forest that are grown side by side
SHARES = 8


def in_few_parts(df: DataFrame, rows: int = ROWS_A_TASK) -> DataFrame:
    """The rows in one partition for each `rows` of them, or as they are if they have fewer partitions."""
    return df.coalesce(max(1, -(-df.count() // rows)))


class Forest:
    """A forest in shares of trees; its probabilities are the means over all trees."""

    def __init__(self, shares: list[PipelineModel]):
        self.shares = shares
        self.trees = [s.stages[-1].getNumTrees for s in shares]

    @property
    def getNumTrees(self) -> int:
        return sum(self.trees)

    @property
    def cols(self) -> list[str]:
        return self.shares[0].stages[0].getInputCols()

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds p_down and p_up."""
        out = self.shares[0].stages[0].transform(df)
        names = [f"_p{i}" for i in range(len(self.shares))]
        for name, share in zip(names, self.shares):
            out = share.stages[-1].copy().setRawPredictionCol("").setPredictionCol("").setProbabilityCol(name).transform(out)
        each = [(n, vector_to_array(name)) for n, name in zip(self.trees, names)]
        return out.withColumns({
            label: reduce(add, [p[k] * F.lit(float(n)) for n, p in each]) / F.lit(float(self.getNumTrees)) for k, label in enumerate(("p_down", "p_up"))
        }).drop(*names)

    def importances(self) -> np.ndarray:
        found = sum(n * s.stages[-1].featureImportances.toArray() for n, s in zip(self.trees, self.shares))
        return found / max(found.sum(), 1e-300)


def assemble(df: DataFrame, cols: Iterable[str] = FEATURES, embedding: str | None = None) -> DataFrame:
    """Add `vector`: the listed columns in order, followed by the embedding array if one is named."""
    if embedding is None:
        return VectorAssembler(inputCols=list(cols), outputCol="vector", handleInvalid="skip").transform(df)
    parts = F.array(*[F.col(c).cast("double") for c in cols])
    return df.withColumn("vector", array_to_vector(F.concat(parts, F.col(embedding).cast("array<double>"))))


def train_forest(
    df: DataFrame, cols: Iterable[str] = FEATURES, target: str = "Target", weighted: bool = True, **params
) -> PipelineModel:
    """A forest on finite rows; rows weigh by class when the labels are imbalanced."""
    settings = {**FOREST, **params}
    if set(cols) == set(FEATURES):
        require_order(list(cols))
    df = drop_nonfinite(df, cols)
    if weighted:
        df = class_weights(df, target)
        settings["weightCol"] = "weight"
    assembler = VectorAssembler(inputCols=list(cols), outputCol="vector")
    tasks = max(1, -(-df.count() // ROWS_A_TASK))
    df = df.coalesce(tasks)
    trees, seed = settings.pop("numTrees"), settings.pop("seed")
    shares = max(1, min(SHARES, df.sparkSession.sparkContext.defaultParallelism // tasks, trees))

    def grown(i: int) -> PipelineModel:
        forest = RandomForestClassifier(featuresCol="vector", labelCol=target, numTrees=trees // shares + (i < trees % shares), seed=seed + i, **settings)
        return Pipeline(stages=[assembler, forest]).fit(df)

    return Forest(_side_by_side(df.sparkSession, grown, range(shares)))


def _side_by_side(spark: SparkSession, task: Callable, args: Iterable) -> list:
    """Results of jobs that do not depend on each other, each from a thread of its own."""
    args = list(args)
    with ThreadPoolExecutor(len(args)) as pool:
        return list(pool.map(inheritable_thread_target(spark)(task), args))


def train_on_vectors(df: DataFrame, target: str = "Target", **params):
    """A forest on assembled vectors, for features fused with embeddings."""
    return RandomForestClassifier(featuresCol="vector", labelCol=target, **{**FUSION_FOREST, **params}).fit(in_few_parts(df))


def sequence_classifier(sequences: DataFrame, **params):
    """A linear classifier on flattened sequences."""
    flat = sequences.withColumn("vector", array_to_vector(F.flatten("sequence")))
    return LogisticRegression(featuresCol="vector", labelCol="label", **{"maxIter": 50, "regParam": 0.01, **params}).fit(flat)


def score_sequences(sequences: DataFrame, model) -> DataFrame:
    flat = sequences.withColumn("vector", array_to_vector(F.flatten("sequence")))
    return _named(model.transform(flat)).drop("vector")


def _named(scored: DataFrame) -> DataFrame:
    p = vector_to_array("probability")
    return _labelled(scored.withColumns({"p_down": p[0], "p_up": p[1]})).drop("rawPrediction", "probability")


def _labelled(scored: DataFrame) -> DataFrame:
    return scored.withColumns(
        {
            # a tie is UP, as in the metrics
            "prediction": F.when(F.col("p_up") >= F.col("p_down"), "UP").otherwise("DOWN"),
            "confidence": F.greatest("p_up", "p_down") * 100.0,
        }
    )


def score(df: DataFrame, model) -> DataFrame:
    """Add prediction, p_up, p_down and confidence in percent; the model's own vector must list the features in order."""
    if isinstance(model, Forest):
        if set(model.cols) == set(FEATURES):
            require_order(model.cols)
        return _labelled(model.transform(df)).drop("vector")
    return _named(model.transform(df)).drop("vector")


def score_batch(symbols: DataFrame, features: DataFrame, model, cols: Iterable[str] = FEATURES) -> DataFrame:
    """The latest prediction of each asked symbol; one without a complete row stays, with an error status."""
    # a row a symbol: few tasks, each of which is sent the model
    scored = score(in_few_parts(latest_complete(features, cols)), model)
    known = features.select("Symbol").distinct().withColumn("_known", F.lit(True))
    out = symbols.join(known, "Symbol", "left").join(scored, "Symbol", "left")
    status = (
        F.when(F.col("_known").isNull(), "unknown symbol")
        .when(F.col("prediction").isNull(), "no complete row")
        .otherwise("ok")
    )
    return out.withColumn("status", status).drop("_known")


def feature_importance(model, names: list[str]) -> DataFrame:
    """One row per feature with its importance and its family, strongest first."""
    # as long as the model vector
    weights = model.importances() if isinstance(model, Forest) else model.featureImportances.toArray()
    rows = [(n, float(w), "structured" if n in FEATURES else "embedding") for n, w in zip(names, weights)]
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame(rows, "feature string, importance double, type string").orderBy(F.desc("importance"), "feature")


def cross_validate(
    df: DataFrame, cols: Iterable[str] = FEATURES, target: str = "Target", folds: int = 5, weighted: bool = True, **params
) -> DataFrame:
    """fold, rows tested and accuracy of a forest per time-ordered fold, weighted like the model itself.

    The parts are ranked and written once; a fold is then a filter. The folds are independent and are fitted side by side.
    """
    path = f"{scratch_dir(df.sparkSession)}/parts"
    fold_parts(df, folds).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)

    def judged(i: int) -> tuple[int, int, float | None]:
        model = train_forest(rows.filter(F.col("part") < i), cols, target, weighted=weighted, **params)
        tested = score(in_few_parts(rows.filter(F.col("part") == i)), model)
        cells = confusion_matrix(predicted(tested.select(F.col(target).alias("y"), F.col("p_up").alias("p")))).first()
        n = cells.tn + cells.fp + cells.fn + cells.tp
        return i, n, (cells.tn + cells.tp) / n if n else None

    found = _side_by_side(df.sparkSession, judged, range(1, folds + 1))
    return df.sparkSession.createDataFrame(found, "fold int, rows long, accuracy double")


def save_model(model: Forest, path: str) -> None:
    """A folder a share, and how many there are."""
    spark = SparkSession.getActiveSession()
    spark.range(1).select(F.lit(len(model.shares)).alias("shares")).write.mode("overwrite").parquet(f"{path}/forest")
    _side_by_side(spark, lambda i: model.shares[i].write().overwrite().save(f"{path}/share-{i}"), range(len(model.shares)))


def load_model(path: str) -> Forest:
    spark = SparkSession.getActiveSession()
    shares = spark.read.parquet(f"{path}/forest").first().shares
    return Forest(_side_by_side(spark, lambda i: PipelineModel.load(f"{path}/share-{i}"), range(shares)))
