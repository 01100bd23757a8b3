"""Summaries, distributions and the tables behind the charts."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.scalar import next_business_day, pct
from barloom.operators.datasets import last_n, latest_complete
from barloom.schema import CORRELATED


def summary(batch: DataFrame) -> DataFrame:
    """The one-row summary of a batch feature table."""
    return batch.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.countDistinct("Symbol").alias("unique_symbols"),
        F.min("Date").alias("date_range_start"),
        F.max("Date").alias("date_range_end"),
        F.avg("Close").alias("avg_close_price"),
        F.stddev_samp("Close").alias("std_close_price"),
        F.min("Close").alias("min_close_price"),
        F.max("Close").alias("max_close_price"),
        F.avg("Volume").alias("avg_volume"),
        F.avg("Daily_Returns_Spark").alias("avg_daily_returns"),
        F.avg("Volatility_Spark").alias("avg_volatility"),
    )


def rows_per_symbol(df: DataFrame) -> DataFrame:
    return df.groupBy("Symbol").agg(F.count(F.lit(1)).alias("n"))


def symbol_date_range(df: DataFrame) -> DataFrame:
    return df.agg(
        F.countDistinct("Symbol").alias("symbols"), F.min("Date").alias("first_date"), F.max("Date").alias("last_date")
    )


def target_distribution(df: DataFrame, target: str = "Target") -> DataFrame:
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    name = F.when(F.col(target) == 1, "UP").when(F.col(target) == 0, "DOWN").otherwise("NONE")
    return counts.select(name.alias("label"), "n", pct("n", total).alias("share_pct"))


def _correlation(a: str, b: str) -> Column:
    """Pearson over the rows that have both; null where either is constant (`corr` raises there)."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    spread = F.stddev_pop(F.when(both, F.col(a))) * F.stddev_pop(F.when(both, F.col(b)))
    return F.try_divide(F.covar_pop(a, b), spread)


def correlation_matrix(df: DataFrame, cols: Iterable[str] = CORRELATED, last: int = 50) -> DataFrame:
    """Pearson correlation of every pair of columns over the last rows of each symbol, in long form."""
    cols = list(cols)
    pairs = list(combinations_with_replacement(cols, 2))
    wide = last_n(df.select("Symbol", "Date", *cols), last).groupBy("Symbol").agg(
        *[_correlation(a, b).alias(f"{a}|{b}") for a, b in pairs]
    )
    cells = [
        F.struct(F.lit(x).alias("column_a"), F.lit(y).alias("column_b"), F.col(f"{a}|{b}").alias("correlation"))
        for a, b in pairs
        for x, y in ({(a, b), (b, a)})
    ]
    return wide.select("Symbol", F.inline(F.array(*cells)))


def _recent_returns(df: DataFrame, last: int) -> DataFrame:
    return last_n(df.select("Symbol", "Date", "Daily_Returns"), last).dropna(subset=["Daily_Returns"])


def returns_histogram(df: DataFrame, last: int = 100, bins: int = 30) -> DataFrame:
    """Equal-width bins of the last daily returns of each symbol; empty bins are left out."""
    w = W.partitionBy("Symbol")
    recent = _recent_returns(df, last).withColumns(
        {"_low": F.min("Daily_Returns").over(w), "_high": F.max("Daily_Returns").over(w)}
    )
    width = (F.col("_high") - F.col("_low")) / F.lit(float(bins))
    at = F.coalesce(F.floor(F.try_divide(F.col("Daily_Returns") - F.col("_low"), width)), F.lit(0))
    recent = recent.withColumn("bin", F.least(at, F.lit(bins - 1)).cast("long"))
    return recent.groupBy("Symbol", "bin").agg(
        F.first(F.col("_low") + F.col("bin") * width).alias("bin_start"), F.count(F.lit(1)).alias("n")
    )


def returns_stats(df: DataFrame, last: int = 100) -> DataFrame:
    r = "Daily_Returns"
    stats = _recent_returns(df, last).groupBy("Symbol").agg(
        F.count(r).alias("n"),
        F.avg(r).alias("mean"),
        F.stddev_samp(r).alias("std"),
        F.min(r).alias("lowest"),
        F.max(r).alias("highest"),
    )
    return stats.withColumns({"band_low": F.col("mean") - F.col("std"), "band_high": F.col("mean") + F.col("std")})


def candle_label_counts(windows: DataFrame) -> DataFrame:
    """Windows per label and symbol, and the grand total under the symbol TOTAL."""
    counts = windows.rollup("Symbol").agg(
        F.grouping("Symbol").alias("_all"),
        F.count_if(F.col("label") == "bullish").alias("bullish"),
        F.count_if(F.col("label") == "bearish").alias("bearish"),
        F.count_if(F.col("label").isNull()).alias("skipped"),
    )
    symbol = F.when(F.col("_all") == 1, "TOTAL").otherwise(F.col("Symbol"))
    return counts.withColumn("Symbol", symbol).drop("_all")


def forecast_point(df: DataFrame, move: float = 0.02) -> DataFrame:
    """Next business day and the close moved by 2 % in the predicted direction, from each symbol's latest row."""
    latest = latest_complete(df, ["Close", "prediction"])
    sign = F.when(F.col("prediction").contains("UP"), 1.0).otherwise(-1.0)
    return latest.select(
        "Symbol",
        F.col("Date").alias("latest_date"),
        next_business_day("Date").alias("forecast_date"),
        (F.col("Close") + F.col("Close") * move * sign).alias("forecast_close"),
    )


def cv_mean_std(scores: DataFrame, score: str = "accuracy") -> DataFrame:
    return scores.agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"))


def importance_by_type(importances: DataFrame) -> DataFrame:
    return importances.groupBy("type").agg(F.sum("importance").alias("importance"))


def top_importances(importances: DataFrame, k: int = 12) -> DataFrame:
    return importances.orderBy(F.desc("importance"), "feature").limit(k)


def sample_rows(df: DataFrame, fraction: float = 0.001, seed: int = 42) -> DataFrame:
    """About that share of the rows, the same ones in every run: those whose key hashes low."""
    key = F.concat_ws("|", F.lit(str(seed)), "Symbol", F.date_format("Date", "yyyy-MM-dd HH:mm:ss"))
    return df.filter(F.substring(F.md5(key), 1, 8) < f"{min(int(fraction * 2**32), 2**32 - 1):08x}")


def take_rows(df: DataFrame, n: int) -> DataFrame:
    """The first n rows by (Date, Symbol)."""
    return df.orderBy("Date", "Symbol").limit(n)


def recent_predictions(history: DataFrame, n: int = 20) -> DataFrame:
    """The newest n prediction records, as displayed."""
    newest = history.orderBy(F.desc("timestamp"), "symbol").limit(n)
    return newest.select(
        F.col("symbol").alias("Symbol"),
        F.col("prediction").alias("Prediction"),
        F.col("confidence").alias("Confidence (%)"),
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("Timestamp"),
        F.col("source").alias("Source"),
        F.col("model").alias("Model"),
    )
