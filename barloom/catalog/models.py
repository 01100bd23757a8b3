"""Models over the feature tables, with the operators' own numbers of trees, depths and lengths.

A run (model, metrics, folds and so on) is made once for the files of the tables and kept in the registry of the shared scratch
folder; the other queries, also those of other processes, load it.
"""

from pyspark.sql import functions as F

from barloom.catalog.base import COMPLETE, EVENTS_BARS, STRICT_CTES, live_ctes, query, with_ctes
from barloom.catalog.datasets import FEATURES_COMPLETE
from barloom.operators import datasets, evaluate, ml, reports
from barloom.operators.ranking import time_split
from barloom.plans import features, registry, training
from barloom.schema import FEATURES
from barloom.sources import writers
from barloom.sources.adapters import embeddings_keyed, events_bars, table
from barloom.sources.writers import scratch_dir

def _registered(spark, sf_dir, name, tables, params, make, load):
    key = registry.fingerprint(spark, [f"{sf_dir}/{t}.parquet" for t in tables], name=name, **params)
    return registry.registered(spark, name, key, make, load)


def _training(spark, sf_dir):
    """Training features as a written table, made once: all models read it, some several times.

    The bars are written before: the layout of the features reads them three times, which would group the events as often.
    """
    def make(path):
        bars = scratch_dir(spark) + "/bars"
        writers.write_parquet(events_bars(spark, sf_dir), bars)
        writers.write_parquet(features.training_features(spark.read.parquet(bars)), path)

    return _registered(spark, sf_dir, "features", ["events"], {}, make, spark.read.parquet)


def trained(spark, sf_dir):
    """The run of the structured forest over a table folder, without cross-validation."""
    return _registered(
        spark, sf_dir, "structured", ["events"], ml.FOREST,
        lambda path: training.save_run(training.train_structured(_training(spark, sf_dir), folds=0), path),
        lambda path: training.load_run(spark, path, folds=False))


def _validated(spark, sf_dir, part):
    """fold, rows and accuracy of the structured forest's time-ordered folds, over all rows or the training part."""
    def rows():
        return _training(spark, sf_dir) if part == "all" else _split(_training(spark, sf_dir))[0]

    return _registered(
        spark, sf_dir, "folds", ["events"], {**ml.FOREST, "part": part},
        lambda path: writers.write_parquet(ml.cross_validate(rows()).coalesce(1), path), spark.read.parquet)


def _fused(spark, sf_dir):
    """The run of the forest over features fused with embeddings."""
    def make(path):
        fused = scratch_dir(spark) + "/fused"
        writers.write_parquet(datasets.fuse(_training(spark, sf_dir), embeddings_keyed(spark, sf_dir)), fused)
        training.save_run(training.train_fusion(spark.read.parquet(fused), size=64, folds=0)[0], path)

    return _registered(spark, sf_dir, "fusion", ["events", "embeddings"], ml.FUSION_FOREST, make, lambda path: training.load_run(spark, path, folds=False))


def _split(rows):
    rows = time_split(rows)
    return rows.filter("role = 'train'"), rows.filter("role = 'test'")


@query("assemble", with_ctes(
    live_ctes(EVENTS_BARS),
    "Symbol, Date:d, size:i, close:f",
    f"""SELECT "Symbol", "Date", 21 AS size, "Close" AS close FROM l WHERE {FEATURES_COMPLETE}""",
))
def assemble(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    rows = ml.assemble(features.live_features(events_bars(spark, sf_dir)).dropna())
    return rows.select("Symbol", "Date", F.size(vector_to_array("vector")).alias("size"), vector_to_array("vector")[3].alias("close"))


# Trees differ from engine to engine, so the SQL holds what is certain of a model's output: keys, counts and bounds.

_RANKED = """SELECT *, row_number() OVER (ORDER BY "Date", "Symbol") AS r, count(*) OVER () AS n FROM t"""
_CTES = {**STRICT_CTES, "t": f"SELECT * FROM f WHERE {COMPLETE}", "s": _RANKED}
_CUT = "greatest(least(floor(n * 0.8), n - 1), 1)"
_NAMES = ", ".join(f"('{c}')" for c in FEATURES)


def _within(*names):
    return F.forall(F.array(*[F.col(n) for n in names]), lambda x: x.between(0.0, 1.0))


@query("train_forest", with_ctes(_CTES, "valid, tested:i", f"SELECT true AS valid, count(*) AS tested FROM s WHERE r > {_CUT}"))
def train_forest(spark, sf_dir):
    """Train on the first 80 %, evaluate on the rest."""
    run = trained(spark, sf_dir)
    tested = run.confusion.select((F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("n")).scalar()
    return run.metrics.select(_within("accuracy", "precision", "recall", "f1_score", "roc_auc").alias("valid"), tested.alias("tested"))


@query("score", with_ctes(_CTES, "Symbol, Date:d, consistent", f'SELECT "Symbol", "Date", true AS consistent FROM s WHERE r > {_CUT}'))
def score(spark, sf_dir):
    """Every test row: the two probabilities sum to one, the larger one is the confidence, and it names the label."""
    _, test = _split(_training(spark, sf_dir))
    scored = ml.score(ml.in_few_parts(test), trained(spark, sf_dir).model)
    best = F.greatest("p_up", "p_down")
    consistent = (
        (F.abs(F.col("p_up") + F.col("p_down") - 1.0) < 1e-9) & (F.abs(F.col("confidence") - 100.0 * best) < 1e-9)
        & (F.col("prediction") == F.when(F.col("p_up") >= F.col("p_down"), "UP").otherwise("DOWN"))
    )
    return scored.select("Symbol", "Date", consistent.alias("consistent"))


@query("score_batch", with_ctes(
    {**live_ctes(EVENTS_BARS), "k": f"""SELECT "Symbol", max("Date") AS "Date" FROM l WHERE {FEATURES_COMPLETE} GROUP BY 1"""},
    "Symbol, Date:d, status, valid",
    """SELECT "Symbol", "Date", 'ok' AS status, true AS valid FROM k
       UNION ALL SELECT n_name, NULL, 'unknown symbol', NULL FROM nation""",
))
def score_batch(spark, sf_dir):
    """The latest complete bar of all symbols that events or nations name; the latter have no bars."""
    model = trained(spark, sf_dir).model
    live = features.live_features(events_bars(spark, sf_dir))
    asked = live.select("Symbol").distinct().unionByName(table(spark, sf_dir, "nation").select(F.col("n_name").alias("Symbol")))
    scored = ml.score_batch(asked, live, model)
    return scored.select("Symbol", "Date", "status", (F.col("confidence").between(50, 100) & F.col("prediction").isin("UP", "DOWN")).alias("valid"))


def _importances(spark, sf_dir):
    return trained(spark, sf_dir).importances


@query("feature_importance", f"SELECT feature, 'structured' AS type, true AS valid, true AS whole FROM (VALUES {_NAMES}) AS v(feature)")
def feature_importance(spark, sf_dir):
    """All features, weights between 0 and 1 that sum to one."""
    found = _importances(spark, sf_dir)
    total = found.agg(F.sum("importance")).scalar()
    return found.select("feature", "type", _within("importance").alias("valid"), (F.abs(total - 1.0) < 1e-9).alias("whole"))


@query("top_importances", "SELECT 12::BIGINT AS rows, true AS highest")
def top_importances(spark, sf_dir):
    """The twelve strongest: none of the others is stronger."""
    found = _importances(spark, sf_dir)
    top = reports.top_importances(found)
    others = found.join(top, "feature", "left_anti").agg(F.coalesce(F.max("importance"), F.lit(0.0))).scalar()
    return top.agg(F.count(F.lit(1)).alias("rows"), (F.min("importance") >= others).alias("highest"))


@query("fusion_forest", """SELECT type, true AS valid, true AS whole FROM (VALUES ('structured'), ('embedding')) AS v(type)""")
def fusion_forest(spark, sf_dir):
    """Features fused with embeddings, trained and judged like the structured model: importance by family."""
    run = _fused(spark, sf_dir)
    gain = training.compared(run.metrics, trained(spark, sf_dir).metrics)
    valid = gain.select(F.col("accuracy_gain").between(-1.0, 1.0) & F.col("roc_auc_gain").between(-1.0, 1.0)).scalar()
    families = reports.importance_by_type(run.importances)
    total = families.agg(F.sum("importance")).scalar()
    return families.select("type", (_within("importance") & valid).alias("valid"), (F.abs(total - 1.0) < 1e-9).alias("whole"))


@query("save_and_load_model", with_ctes(_CTES, "rows:i, different:i", "SELECT count(*) AS rows, 0 AS different FROM t"))
def save_and_load_model(spark, sf_dir):
    """A model that is loaded, saved again and loaded scores every row as before."""
    rows = ml.in_few_parts(_training(spark, sf_dir))
    run, path = trained(spark, sf_dir), scratch_dir(spark) + "/model"
    ml.save_model(run.model, path)
    loaded = ml.score(rows, ml.load_model(path)).select("Symbol", "Date", F.col("p_up").alias("q"))
    both = ml.score(rows, run.model).select("Symbol", "Date", "p_up").join(loaded, ["Symbol", "Date"])
    return both.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("p_up") != F.col("q")).alias("different"))


@query("cross_validate", with_ctes(
    {**_CTES, "c": "SELECT max(n) AS n FROM s"}, "fold:i, rows:i, valid", "SELECT unnest([1, 2, 3, 4, 5]) AS fold, floor(n / 6) AS rows, true AS valid FROM c"))
def cross_validate(spark, sf_dir):
    return _validated(spark, sf_dir, "all").select("fold", "rows", _within("accuracy").alias("valid"))


_SEQUENCES = {
    **_CTES,
    "later": f"""SELECT *, row_number() OVER (PARTITION BY "Symbol" ORDER BY "Date") AS place FROM s WHERE r > {_CUT}""",
}


@query("sequence_classifier", with_ctes(
    _SEQUENCES, "Symbol, Date:d, label:i, valid", 'SELECT "Symbol", "Date", "Target" AS label, true AS valid FROM later WHERE place > 60'))
def sequence_classifier(spark, sf_dir):
    """Every test sequence, with the confidence in the right order and metrics over them."""
    run = training.train_sequences(_training(spark, sf_dir))
    judged = run.metrics.select(_within("accuracy", "precision", "recall", "f1_score", "roc_auc")).scalar()
    consistent = (F.abs(F.col("p_up") + F.col("p_down") - 1.0) < 1e-9) & (F.col("prediction") == F.when(F.col("p_up") >= F.col("p_down"), "UP").otherwise("DOWN"))
    return run.scored.select("Symbol", "Date", "label", (consistent & judged).alias("valid"))


@query("append_model_run", with_ctes(_CTES, "model, tested:i, folds:i, labels:i, top:i, valid", f"""
SELECT 'forest' AS model, count(*) AS tested, 5 AS folds, 4 AS labels, 20 AS top, true AS valid FROM s WHERE r > {_CUT}"""))
def append_model_run(spark, sf_dir):
    """The whole record of a run, read back."""
    path = scratch_dir(spark) + "/model_runs"
    run = trained(spark, sf_dir)
    folds = _validated(spark, sf_dir, "train")
    writers.append_model_run(run.metrics, run.importances, path, "forest", ml.FOREST, folds, run.confusion, run.report, run.confidence)
    runs = spark.read.parquet(path)
    best = evaluate.rank_models(runs).select("model", "roc_auc")
    c = F.col("confusion")
    return runs.join(best.withColumnRenamed("roc_auc", "_best"), "model").select(
        "model", (c.tn + c.fp + c.fn + c.tp).alias("tested"), F.size("folds").alias("folds"), F.size("report").alias("labels"), F.size("top_features").alias("top"),
        (_within("accuracy", "f1_score", "roc_auc", "cv.mean") & (F.col("_best") == F.col("roc_auc")) & F.col("confidence.mean").between(50, 100)).alias("valid"))
