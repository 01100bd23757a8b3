"""Exact global ranks, running totals, cuts and quantiles without a one-task window."""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import reduce
from operator import add

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running_total(
    df: DataFrame, values: Iterable[str], order: str, coarse: Column, by: Iterable[str] = (), wider: int | None = None
) -> DataFrame:
    """Add `<value>_before`, the exact sum over all rows with a smaller `order`, per `by`.

    `order` must be unique per `by`; `coarse` groups neighbouring keys and must
    not decrease with `order`. The totals per coarse group form a smaller table
    that is summed first; the detail is summed inside its coarse group. Where the
    coarse groups are numbered and many, `wider` of them are summed together
    first, in the same way.
    """
    by, values = list(by), list(values)
    df = df.withColumn("_coarse", coarse)
    totals = df.groupBy(*by, F.col("_coarse").alias("_group")).agg(*[F.sum(v).alias(v) for v in values])
    if wider:
        totals = running_total(totals, values, "_group", F.floor(F.col("_group") / wider), by)
        before = {v: F.col(f"{v}_before") for v in values}
    else:
        earlier = W.partitionBy(*by).orderBy("_group").rowsBetween(W.unboundedPreceding, -1)
        before = {v: F.coalesce(F.sum(v).over(earlier), F.lit(0)) for v in values}
    group = f"_group_of_{order}"
    offsets = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in by], F.col("_group").alias(group), *[c.alias(f"_o_{v}") for v, c in before.items()]
    )
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in by] + [F.col("_coarse") == F.col(group)]
    inside = W.partitionBy(*by, "_coarse").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    out = df.join(offsets, same).drop(group)
    out = out.withColumns(
        {f"{v}_before": F.col(f"_o_{v}") + F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values}
    )
    return out.drop("_coarse", *[f"_k_{k}" for k in by], *[f"_o_{v}" for v in values])


#: groups of neighbouring values that are summed by themselves
GROUPS = 4096


def grouped(values: DataFrame, x: str, groups: int = GROUPS) -> tuple[DataFrame, Column]:
    """The rows with a number of the group of neighbouring values that x lies in, and that column.

    Bounds come from a quantile summary of the rows, so values that lie close together, or next to zero, still spread
    over many groups. `groups` bounds at most reach the driver. Equal values share a group.
    """
    cuts = values.approxQuantile(x, [i / groups for i in range(1, groups)], 1 / (4 * groups))
    inner = sorted({float(c) for c in cuts})
    splits = [-math.inf, *inner, math.inf]
    if len(splits) < 3:
        return values.withColumn("_near", F.lit(0).cast("long")), F.col("_near")
    placed = Bucketizer(splits=splits, inputCol="_value", outputCol="_near", handleInvalid="keep").transform(values.withColumn("_value", F.col(x).cast("double")))
    return placed.withColumn("_near", F.col("_near").cast("long")).drop("_value"), F.col("_near")


def _dates_with_totals(df: DataFrame) -> DataFrame:
    per_date = df.groupBy("Date").agg(F.count(F.lit(1)).alias("n"))
    return running_total(per_date, ["n"], "Date", F.date_trunc("month", "Date"))


def cut_keys(df: DataFrame, ranks: Column) -> DataFrame:
    """The (Date, Symbol) keys at the given ranks of the (Date, Symbol) order, one row, column `cuts`.

    `ranks` builds an array of ranks from the row count `total`. Only the dates
    that hold a cut are ranked inside, so this costs one count per date. (Date,
    Symbol) must be unique.
    """
    dates = _dates_with_totals(df)
    total = df.agg(F.count(F.lit(1)).alias("total")).scalar()
    dates = dates.withColumn("total", total).withColumn("_ranks", ranks)
    inside = F.filter("_ranks", lambda k: (F.col("n_before") < k) & (k <= F.col("n_before") + F.col("n")))
    # at most one row per cut
    hit = dates.select(F.col("Date").alias("_date"), "n_before", F.explode(inside).alias("_rank"))
    on_date = df.select("Date", "Symbol").join(F.broadcast(hit), F.col("Date") == F.col("_date")).withColumn("_one", F.lit(1))
    numbered = running_total(on_date, ["_one"], "Symbol", _within_dates(df, dates), ["Date", "_rank"])
    keys = numbered.filter(F.col("_one_before") + 1 == F.col("_rank") - F.col("n_before"))
    return keys.agg(F.sort_array(F.collect_list(F.struct("Date", "Symbol"))).alias("cuts"))


#: rows of one date that a task may rank by itself
DATE_ROWS = 1_000_000


def _within_dates(df: DataFrame, dates: DataFrame) -> Column:
    """Groups of neighbouring symbols of a date: one, or ranges of Symbol where some date holds more than `DATE_ROWS` rows."""
    widest = dates.agg(F.max("n")).first()[0] or 0
    return symbol_range(df) if widest > DATE_ROWS else F.lit(0).cast("long")


#: ranges of symbols that are ranked by themselves within a date: SPLITS * SPLITS
SPLITS = 32


def symbol_range(df: DataFrame, splits: int = SPLITS) -> Column:
    """The number of the range that Symbol lies in, by bounds from a sample of the distinct symbols.

    The sample takes symbols by hash, so it is the same on every run, and at most about 16 a range; bounds only place the
    rows, ranks stay exact whatever they are.
    """
    wanted = splits * splits
    symbols = df.select("Symbol").distinct()
    many = symbols.agg(F.approx_count_distinct("Symbol")).first()[0]
    share = max(1, many // (16 * wanted))
    sample = symbols.filter(F.pmod(F.xxhash64("Symbol"), F.lit(share)) == 0).select(
        F.sort_array(F.collect_list("Symbol")).alias("s")).first().s
    bounds = sorted({sample[len(sample) * i // wanted] for i in range(1, wanted)}) if sample else []
    if not bounds:
        return F.lit(0).cast("long")
    blocks = [bounds[i : i + splits] for i in range(0, len(bounds), splits)]

    def passed(some: Column) -> Column:
        return F.size(F.filter(some, lambda b: b <= F.col("Symbol"))).cast("long")

    tops = F.array(*[F.lit(b[0]) for b in blocks])
    top = passed(tops)
    inner = F.element_at(F.array(*[F.array(*[F.lit(x) for x in b]) for b in blocks]), F.greatest(top, F.lit(1)).cast("int"))
    return F.when(top == 0, F.lit(0).cast("long")).otherwise((top - 1) * splits + passed(inner))


def time_split(df: DataFrame, train: float = 0.8) -> DataFrame:
    """Add `role`: train for the first floor(train * n) rows by (Date, Symbol), at least 1 and at most n - 1."""
    n = F.col("total")
    rank = F.greatest(F.least(F.floor(n * F.lit(train)), n - 1), F.lit(1)).cast("long")
    cut = cut_keys(df, F.array(rank)).scalar()
    before = F.struct("Date", "Symbol") <= F.element_at(cut, 1)
    return df.withColumn("role", F.when(before, "train").otherwise("test"))


def fold_parts(df: DataFrame, folds: int = 5) -> DataFrame:
    """Rows with `part`: fold i tests the rows of part i, floor(n / (folds + 1)) of them, and trains on all lower parts."""
    size = F.floor(F.col("total") / (folds + 1)).cast("long")
    ranks = F.array(*[F.col("total") - size * (folds - i) for i in range(folds)])
    cuts = cut_keys(df, ranks).scalar()
    row = F.struct("Date", "Symbol")
    passed = [F.when(F.element_at(cuts, i + 1) < row, 1).otherwise(0) for i in range(folds)]
    return df.withColumn("part", reduce(add, passed))


def time_series_folds(df: DataFrame, folds: int = 5) -> DataFrame:
    """Rows with `fold` and `role`, one for each fold that a row tests or trains."""
    out = fold_parts(df, folds).withColumn("fold", F.explode(F.sequence(F.greatest(F.col("part"), F.lit(1)), F.lit(folds))))
    return out.withColumn("role", F.when(F.col("fold") == F.col("part"), "test").otherwise("train")).drop("part")


def global_rank(df: DataFrame) -> DataFrame:
    """Add `rank`, the exact row number in (Date, Symbol) order."""
    dates = _dates_with_totals(df)
    inside = running_total(df.withColumn("_one", F.lit(1)), ["_one"], "Symbol", _within_dates(df, dates), ["Date"])
    dates = dates.select(F.col("Date").alias("_date"), "n_before")
    out = inside.join(dates, F.col("Date") == F.col("_date"))
    return out.withColumn("rank", F.col("n_before") + F.col("_one_before") + 1).drop("_date", "n_before", "_one", "_one_before")


def quantiles(
    df: DataFrame, x: str, probs: dict[str, float], coarse: Column | None = None, wider: int | None = None
) -> DataFrame:
    """Exact linear-interpolated quantiles in one row; equal values count once and carry their number.

    `coarse` groups neighbouring values `v`, as in `running_total`; without it they are grouped by a summary of the values.
    """
    values = df.filter(F.col(x).isNotNull()).groupBy(F.col(x).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    total = values.agg(F.sum("n").alias("total")).scalar()
    if coarse is None:
        values, coarse = grouped(values, "v")
    ranked = running_total(values, ["n"], "v", coarse, wider=wider).withColumn("total", total)

    def at(position: Column) -> Column:
        hit = (F.col("n_before") <= position) & (position < F.col("n_before") + F.col("n"))
        return F.max(F.when(hit, F.col("v")))

    out = []
    for name, p in probs.items():
        h = (F.col("total") - 1) * F.lit(p)
        low, part = at(F.floor(h)), F.max(h - F.floor(h))
        out.append((low + (at(F.ceil(h)) - low) * part).alias(name))
    return ranked.agg(*out)
