"""Model-ready rows: latest rows, sequences, candle windows, fusion with embeddings."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.scalar import pct
from barloom.operators.layout import is_daily, lay_out, over, settle, with_positions
from barloom.schema import FEATURES

# Spark's own bound for limits per group and task
_LIMITED = 1000


def latest_complete(df: DataFrame, cols: Iterable[str] = FEATURES) -> DataFrame:
    """The last row of each symbol that has all listed columns; partial aggregation keeps one row per task."""
    rest = [c for c in df.columns if c not in ("Symbol", "Date")]
    last = F.max_by(F.struct("Date", *rest), "Date").alias("_last")
    return df.dropna(subset=list(cols)).groupBy("Symbol").agg(last).select(
        *[F.col(c) if c == "Symbol" else F.col("_last")[c].alias(c) for c in df.columns]
    )


def last_n(df: DataFrame, n: int) -> DataFrame:
    """The last n rows per symbol.

    Up to n = 1000 Spark limits each symbol to n rows per task before the shuffle. Beyond that the counts per time
    bucket say from which one on a symbol can hold its last n rows, and only those rows are sorted.
    """
    if n > _LIMITED and not is_daily(df):
        counts = df.groupBy("Symbol", F.date_trunc("hour", "Date").alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
        later = W.partitionBy("Symbol").orderBy(F.col("_bucket").desc()).rowsBetween(W.unboundedPreceding, -1)
        needed = counts.withColumn("_later", F.coalesce(F.sum("_n").over(later), F.lit(0))).filter(F.col("_later") < n)
        since = needed.groupBy("Symbol").agg(F.min("_bucket").alias("_since"))
        df = df.join(since, "Symbol").filter(F.col("Date") >= F.col("_since")).drop("_since").select(*df.columns)
    newest = W.partitionBy("Symbol").orderBy(F.col("Date").desc())
    return df.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= n).drop("_rn")


def vector_of(cols: Iterable[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in cols])


def sequences(df: DataFrame, length: int = 60, cols: Iterable[str] = FEATURES, target: str = "Target", **layout) -> DataFrame:
    """For each row with `length` rows before it: those rows' vectors in time order, and this row's label."""
    keep = lay_out(df.select("Symbol", "Date", target, vector_of(cols).alias("_v")), before=length, **layout)
    frame = over(keep).rowsBetween(-length, -1)
    out = settle(keep.withColumn("sequence", F.collect_list("_v").over(frame)))
    return out.filter(F.size("sequence") == length).select("Symbol", "Date", "sequence", F.col(target).alias("label"))


def prediction_sequence(df: DataFrame, length: int = 60, cols: Iterable[str] = FEATURES) -> DataFrame:
    """The last `length` complete vectors of each symbol, or a status that says why there are none."""
    complete = last_n(df.dropna(subset=list(cols)).select("Symbol", "Date", vector_of(cols).alias("v")), length)
    # at most `length` rows per symbol reach this group
    gathered = complete.groupBy("Symbol").agg(F.sort_array(F.collect_list(F.struct("Date", "v"))).alias("_rows"))
    symbols = df.select("Symbol").distinct()
    rows = F.coalesce(F.size("_rows"), F.lit(0))
    return symbols.join(gathered, "Symbol", "left").select(
        "Symbol",
        rows.cast("long").alias("rows"),
        F.when(rows >= length, "ok").otherwise("too few complete rows").alias("status"),
        F.when(rows >= length, F.transform("_rows", lambda r: r["v"])).alias("sequence"),
    )


def candle_label(next_close: Column, close: Column) -> Column:
    return F.when(next_close.isNull(), None).when(next_close > close, "bullish").otherwise("bearish")


def next_bar_label(df: DataFrame) -> DataFrame:
    """Label of each bar by the close of the next bar of its symbol; a tie is bearish, the last bar has none."""
    df = lay_out(df, before=1, after=1)
    return settle(df.withColumn("label", candle_label(F.lead("Close", 1).over(over(df)), F.col("Close"))))


def candle_windows(df: DataFrame, size: int = 30, date_format: str = "yyyyMMdd", **layout) -> DataFrame:
    """Windows of `size` bars with their end date, label and image id; each needs one more bar for the label."""
    df = lay_out(df, before=1, after=size + 1, **layout)
    w = over(df)
    bar = F.struct("Date", "Open", "High", "Low", "Close", "Volume")
    df = df.withColumns(
        {
            "candles": F.collect_list(bar).over(w.rowsBetween(0, size - 1)),
            "_next": F.lead("Close", size).over(w),
        }
    )
    last = F.col("candles")[size - 1]
    return settle(df).filter(F.size("candles") == size).filter(F.col("_next").isNotNull()).select(
        "Symbol",
        F.col("Date").alias("start_date"),
        last["Date"].alias("end_date"),
        "candles",
        candle_label(F.col("_next"), last["Close"]).alias("label"),
        F.concat_ws("_", "Symbol", F.date_format(last["Date"], date_format)).alias("image_id"),
    )


def even_sample(windows: DataFrame, most: int = 500) -> DataFrame:
    """Of a symbol's T windows in time order, those at floor(i * (T - 1) / (most - 1)), i = 0..most-1, when T > most."""
    df = with_positions(windows.withColumnRenamed("start_date", "Date"))
    at, last = F.col("pos") - 1, F.col("total") - 1
    step = last.cast("double") / F.lit(float(most - 1))
    near = F.floor(at / step).cast("long")
    # the index that lands on this row, if any, is next to position / step
    lands = F.exists(
        F.sequence(near - 1, near + 2),
        lambda i: (i >= 0) & (i < most) & (F.when(i == most - 1, last).otherwise(F.floor(i * step)) == at),
    )
    picked = df.filter(F.when(F.col("total") <= most, F.lit(True)).otherwise(lands))
    return picked.drop("pos", "total").withColumnRenamed("Date", "start_date")


def _chosen(i: Column, last: Column, most: int) -> Column:
    """The i-th of `most` evenly spread places from 0 to `last`."""
    return F.when(i == most - 1, last).otherwise(F.floor(i * (last.cast("double") / F.lit(float(most - 1)))))


def sampled_candle_windows(bars: DataFrame, size: int = 30, most: int = 500, date_format: str = "yyyyMMdd", bucket: str = "month") -> DataFrame:
    """`even_sample` of the `candle_windows` of the bars, without the other windows.

    The places of the chosen starts follow from a symbol's number of bars, so a bar knows by arithmetic which chosen windows
    it lies in. Bars in none are dropped before anything moves, the others are gathered by (Symbol, start), size + 1 at most.
    """
    df = with_positions(bars.select("Symbol", "Date", "Open", "High", "Low", "Close", "Volume"), bucket)
    at, last = F.col("pos") - 1, F.col("total") - size - 1  # of the bar, and of the last window's start
    first = F.greatest(at - size, F.lit(0))
    step = last.cast("double") / F.lit(float(most - 1))
    # the places of all starts that may reach the bar, one more on either side for rounding
    low = F.greatest(F.ceil(first / step).cast("long") - 1, F.lit(0))
    high = F.least(F.floor(at / step).cast("long") + 1, F.lit(most - 1))
    some = F.when(low <= high, F.transform(F.sequence(low, high), lambda i: _chosen(i, last, most)))
    upto = F.least(at, last)
    every = F.when(first <= upto, F.sequence(first, upto))
    starts = F.when(F.col("total") - size <= most, every).otherwise(F.array_distinct(F.filter(some, lambda s: s.between(first, upto))))
    bar = F.struct("Date", "Open", "High", "Low", "Close", "Volume")
    spread = df.filter(F.col("total") > size).withColumn("_start", F.explode(starts))
    row = F.struct(at.alias("at"), bar.alias("bar"))
    gathered = spread.groupBy("Symbol", "_start").agg(F.transform(F.sort_array(F.collect_list(row)), lambda r: r["bar"]).alias("_bars"))
    candles, end = F.slice("_bars", 1, size), F.col("_bars")[size - 1]
    return gathered.select(
        "Symbol",
        F.col("_bars")[0]["Date"].alias("start_date"),
        end["Date"].alias("end_date"),
        candles.alias("candles"),
        candle_label(F.col("_bars")[size]["Close"], end["Close"]).alias("label"),
        F.concat_ws("_", "Symbol", F.date_format(end["Date"], date_format)).alias("image_id"),
    ).filter(F.size("candles") == size)


def fuse(features: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Rows that have both features and an embedding; a right-hand column that collides gets the suffix _cnn."""
    keys = ("Symbol", "Date")
    clash = {c: f"{c}_cnn" for c in embeddings.columns if c in features.columns and c not in keys}
    return features.join(embeddings.withColumnsRenamed(clash), list(keys), "inner")


def join_coverage(features: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Matched rows, and their share of either side in percent."""
    left = features.select("Symbol", "Date", F.lit(1).alias("_l"))
    right = embeddings.select("Symbol", "Date", F.lit(1).alias("_r"))
    both = F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull())
    out = left.join(right, ["Symbol", "Date"], "full").agg(
        both.alias("matched"), F.count("_l").alias("_left"), F.count("_r").alias("_right")
    )
    return out.select(
        "matched", pct("matched", "_left").alias("features_pct"), pct("matched", "_right").alias("embeddings_pct")
    )


def minmax_fit(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """One row: lowest and highest value per column."""
    return df.agg(*[F.struct(F.min(c).alias("low"), F.max(c).alias("high")).alias(c) for c in cols])


def minmax_transform(df: DataFrame, fitted: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Columns scaled by the fitted one-row ranges; a constant column becomes 0 where it holds its value."""
    ranges = fitted.select(F.struct(*fitted.columns)).scalar()
    out = {}
    for c in cols:
        low, high = ranges[c]["low"], ranges[c]["high"]
        width = F.when(high == low, F.lit(1.0)).otherwise(high - low)
        out[c] = (F.col(c) - low) / width
    return df.withColumns(out)


def sort_by_symbol(df: DataFrame) -> DataFrame:
    return df.orderBy("Symbol", "Date")


def sort_by_time(df: DataFrame) -> DataFrame:
    return df.orderBy("Date", "Symbol")


def concat_frames(*frames: DataFrame) -> DataFrame:
    """All rows of all frames, columns by name; a column one frame lacks is null there."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def all_symbols(*lists: DataFrame) -> DataFrame:
    """Distinct symbols of all lists."""
    return concat_frames(*[df.select("Symbol") for df in lists]).distinct()
