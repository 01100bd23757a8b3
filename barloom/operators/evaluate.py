"""Classification metrics over scored rows, backtests and model comparison.

Scored rows hold a label `y` (0 or 1) and a probability of UP `p`; `by` names
grouping columns such as the model.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.scalar import confidence, safe_ratio
from barloom.operators.datasets import last_n
from barloom.operators.ranking import grouped, quantiles, running_total


def predicted(df: DataFrame, p: str = "p") -> DataFrame:
    """Add `yhat`, UP from one half on."""
    return df.withColumn("yhat", (F.col(p) >= 0.5).cast("int"))


def confusion_matrix(df: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    def cell(y: int, yhat: int):
        return F.count_if((F.col("y") == y) & (F.col("yhat") == yhat))

    return df.groupBy(*by).agg(
        cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp")
    )


def classification_metrics(df: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """Accuracy, precision, recall and F1 of the UP class; 0 where a divisor is 0."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return confusion_matrix(df, by).select(
        *by,
        safe_ratio(tn + tp, tn + fp + fn + tp).alias("accuracy"),
        safe_ratio(tp, tp + fp).alias("precision"),
        safe_ratio(tp, tp + fn).alias("recall"),
        safe_ratio(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
    )


def classification_report(df: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of DOWN and UP, their plain and their weighted mean."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))

    def line(name: str, hit, wrong, missed):
        return F.struct(
            F.lit(name).alias("label"),
            safe_ratio(hit, hit + wrong).alias("precision"),
            safe_ratio(hit, hit + missed).alias("recall"),
            safe_ratio(2 * hit, 2 * hit + wrong + missed).alias("f1_score"),
            (hit + missed).alias("support"),
        )

    two = confusion_matrix(df).select(line("DOWN", tn, fn, fp).alias("d"), line("UP", tp, fp, fn).alias("u"))
    total = F.col("d.support") + F.col("u.support")
    scores = ("precision", "recall", "f1_score")
    macro = F.struct(
        F.lit("macro avg").alias("label"),
        *[((F.col(f"d.{s}") + F.col(f"u.{s}")) / 2.0).alias(s) for s in scores],
        total.alias("support"),
    )
    weighted = F.struct(
        F.lit("weighted avg").alias("label"),
        *[
            safe_ratio(F.col(f"d.{s}") * F.col("d.support") + F.col(f"u.{s}") * F.col("u.support"), total).alias(s)
            for s in scores
        ],
        total.alias("support"),
    )
    return two.select(F.inline(F.array("d", "u", macro, weighted)))


def roc_auc(df: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """Exact area under the curve, ties count half. Rows with one score merge before any ordering."""
    by = list(by)
    scores = df.groupBy(*by, "p").agg(F.count_if(F.col("y") == 1).alias("up"), F.count_if(F.col("y") == 0).alias("down"))
    scores, group = grouped(scores, "p")
    ranked = running_total(scores, ["down"], "p", group, by)
    wins = F.sum(F.col("up") * (F.col("down_before") + F.col("down") / 2.0))
    pairs = F.sum("up").cast("double") * F.sum("down")
    return ranked.groupBy(*by).agg(F.try_divide(wins, pairs).alias("roc_auc"))


def confidence_stats(df: DataFrame) -> DataFrame:
    """Mean, median and 90th percentile of the confidence."""
    conf = df.select(confidence("p").alias("c"))
    mean = conf.agg(F.avg("c").alias("mean")).scalar()
    return quantiles(conf, "c", {"median": 0.5, "p90": 0.9}).withColumn("mean", mean)


def class_imbalance(df: DataFrame, target: str = "Target", threshold: float = 1.2) -> DataFrame:
    """Label counts, their ratio, and whether balanced weights are due."""
    counts = df.agg(F.count_if(F.col(target) == 0).alias("down"), F.count_if(F.col(target) == 1).alias("up"))
    ratio = F.greatest("down", "up") / F.greatest(F.lit(1), F.least("down", "up"))
    return counts.withColumn("ratio", ratio).withColumn("balanced", F.col("ratio") >= threshold)


def class_weights(df: DataFrame, target: str = "Target", threshold: float = 1.2) -> DataFrame:
    """Add `weight`: n / (2 * n of the class) when the labels are imbalanced, else 1."""
    counts = class_imbalance(df, target, threshold)
    c = counts.select(F.struct(*counts.columns)).scalar()
    own = F.when(F.col(target) == 1, c["up"]).otherwise(c["down"])
    balanced = (c["down"] + c["up"]) / (2.0 * own)
    return df.withColumn("weight", F.when(c["balanced"], balanced).otherwise(F.lit(1.0)))


def compare_to_baseline(df: DataFrame, baseline: str, model: str = "model") -> DataFrame:
    """Accuracy, F1 and area of each model, and the difference to the named one."""
    metrics = classification_metrics(df, [model]).join(roc_auc(df, [model]), model)
    names = ["accuracy", "f1_score", "roc_auc"]
    base = metrics.filter(F.col(model) == baseline).agg(F.struct(*[F.max(n).alias(n) for n in names])).scalar()
    return metrics.select(model, *names, *[(F.col(n) - base[n]).alias(f"{n}_gain") for n in names])


def rank_models(runs: DataFrame) -> DataFrame:
    """The last run of each model, best first by area, F1 and accuracy."""
    kept = ["accuracy", "f1_score", "roc_auc"]
    last = F.max_by(F.struct(*kept), "run_time").alias("_last")
    return runs.groupBy("model").agg(last).select("model", "_last.*").orderBy(
        F.desc("roc_auc"), F.desc("f1_score"), F.desc("accuracy")
    )


def signal_backtest(df: DataFrame, days: int = 30, length: int = 60) -> DataFrame:
    """Signals of the last min(days, rows - length) complete rows per symbol against the move into that row.

    `df` holds complete rows with the probability `p` predicted for each. A
    symbol with too few rows yields none.
    """
    recent = last_n(df, days + length)  # enough rows to decide both bounds
    w = W.partitionBy("Symbol")
    recent = recent.withColumns(
        {
            "_rows": F.count(F.lit(1)).over(w),
            "_back": F.row_number().over(w.orderBy(F.desc("Date"))),
            "_prev": F.lag("Close", 1).over(w.orderBy("Date")),
        }
    ).filter(F.col("_back") <= F.least(F.lit(days), F.col("_rows") - length))
    up, rose = F.col("p") >= 0.5, F.col("Close") > F.col("_prev")
    return recent.select(
        "Symbol",
        "Date",
        "Close",
        "p",
        F.when(up, "UP").otherwise("DOWN").alias("prediction"),
        F.when(rose, "UP").otherwise("DOWN").alias("actual"),
        (up == F.coalesce(rose, F.lit(False))).alias("correct"),
    )


def backtest_accuracy(backtest: DataFrame, by: Iterable[str] = ("Symbol",)) -> DataFrame:
    right = F.count_if("correct")
    total = F.count(F.lit(1))
    return backtest.groupBy(*by).agg(
        right.alias("correct"), total.alias("total"), (right * 100.0 / total).alias("accuracy_pct")
    )
