"""Cleaning steps: coercion, one row per bar, filling, sanity, and the reports on them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.scalar import is_finite
from barloom.operators.layout import is_daily
from barloom.schema import NUMERICS, PRICES


def number(text: str | Column) -> Column:
    """Text to a number, null where it is none."""
    return (F.col(text) if isinstance(text, str) else text).try_cast("double")


def coerce_numeric(df: DataFrame, cols: Iterable[str] = NUMERICS, seen: Observation | None = None) -> DataFrame:
    """Columns as doubles; bad text becomes null. `seen` collects the newly null values per column in passing."""
    if seen is not None:
        lost = [F.count_if(F.col(c).isNotNull() & number(c).isNull()).alias(c) for c in cols]
        df = df.observe(seen, *lost)
    return df.withColumns({c: number(c) for c in cols})


def coercion_report(df: DataFrame, cols: Iterable[str] = NUMERICS) -> DataFrame:
    """One row per column: values that are present but no numbers."""
    cols = list(cols)
    counts = df.agg(*[F.count_if(F.col(c).isNotNull() & number(c).isNull()).alias(c) for c in cols])
    return counts.unpivot([], cols, "column_name", "coerced")


def date_of(col: str = "Date", fmt: str | list[str] | None = None, intraday: bool = False) -> Column:
    """Text as a date (or a timestamp for bars with a time of day), null where it is none. Of several formats the first that fits."""
    def parsed(one: str | None) -> Column:
        if intraday:
            return F.try_to_timestamp(F.col(col), F.lit(one)) if one else F.try_to_timestamp(F.col(col))
        return F.try_to_date(F.col(col), one) if one else F.try_to_date(F.col(col))

    return F.coalesce(*[parsed(one) for one in (fmt if isinstance(fmt, list) else [fmt])])


def coerce_date(df: DataFrame, col: str = "Date", fmt: str | list[str] | None = None, intraday: bool = False) -> DataFrame:
    """Text to a date; rows without one are dropped. `fmt` may list several formats, None among them for the usual one."""
    return df.withColumn(col, date_of(col, fmt, intraday)).dropna(subset=[col])


def drop_incomplete(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    return df.dropna(subset=subset)


def dedup_keep_last(df: DataFrame, keys: Iterable[str] = ("Symbol", "Date"), order: Iterable[str] = ("seq",)) -> DataFrame:
    """The last row per key by `order`; the other columns break ties, so the result never depends on row order.

    An aggregate, not a ranking: copies of one key collapse before the shuffle.
    """
    keys, order = list(keys), list(order)
    rest = [c for c in df.columns if c not in keys and c not in order]
    last = F.max(F.struct(*order, *rest)).alias("_last")
    return df.groupBy(*keys).agg(last).select(
        *[F.col(c) if c in keys else F.col("_last")[c].alias(c) for c in df.columns]
    )


def forward_fill(df: DataFrame, cols: Iterable[str] = NUMERICS, bucket: str = "month") -> DataFrame:
    """Last known value per symbol; (Symbol, Date) must be unique. Rows that stay null are dropped."""
    cols = list(cols)
    return fill_values(df, cols, bucket).dropna(subset=cols)


def fill_values(df: DataFrame, cols: Iterable[str] = NUMERICS, bucket: str = "month") -> DataFrame:
    """Last known value per symbol, null before the first; (Symbol, Date) must be unique and not null.

    With a time of day a symbol is filled inside time buckets, and a small table
    of the last values per bucket carries them across.
    """
    cols = list(cols)
    if is_daily(df):
        so_far = W.partitionBy("Symbol").orderBy("Date").rowsBetween(W.unboundedPreceding, 0)
        return df.withColumns({c: F.last(c, ignorenulls=True).over(so_far) for c in cols})
    names = df.columns
    df = df.withColumn("_bucket", F.date_trunc(bucket, "Date"))
    ends = df.groupBy("Symbol", "_bucket").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("Date"))).alias(c) for c in cols]
    )
    earlier = W.partitionBy("Symbol").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(
        "Symbol", "_bucket", *[F.last(c, ignorenulls=True).over(earlier).alias(f"_carried_{c}") for c in cols]
    )
    so_far = W.partitionBy("Symbol", "_bucket").orderBy("Date").rowsBetween(W.unboundedPreceding, 0)
    filled = df.join(carried, ["Symbol", "_bucket"]).withColumns(
        {c: F.coalesce(F.last(c, ignorenulls=True).over(so_far), F.col(f"_carried_{c}")) for c in cols}
    )
    return filled.select(*names)


def is_sane() -> Column:
    """Positive prices, High at or above Low, no negative volume."""
    sane = (F.col("High") >= F.col("Low")) & (F.col("Volume") >= 0)
    for c in PRICES:
        sane = sane & (F.col(c) > 0)
    return sane


def price_sanity(df: DataFrame) -> DataFrame:
    return df.filter(is_sane())


def thin_symbols(df: DataFrame, min_rows: int = 100) -> DataFrame:
    """Symbols with fewer rows than `min_rows`, and how many they have."""
    return df.groupBy("Symbol").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < min_rows)


def drop_thin_symbols(df: DataFrame, min_rows: int = 100) -> DataFrame:
    return drop_symbols(df, thin_symbols(df, min_rows))


def drop_symbols(df: DataFrame, flagged: DataFrame) -> DataFrame:
    """Rows whose symbol is not flagged. Spark broadcasts the list when it is small and splits hot symbols if not."""
    return df.join(flagged.select("Symbol"), "Symbol", "left_anti")


def drop_columns(df: DataFrame, cols: Iterable[str] = ("Adj Close",)) -> DataFrame:
    return df.drop(*cols)


def filter_symbols(df: DataFrame, symbols: Iterable[str]) -> DataFrame:
    return df.filter(F.col("Symbol").isin(list(symbols)))


def filter_symbol(df: DataFrame, symbol: str) -> DataFrame:
    return df.filter(F.col("Symbol") == symbol)


def select_ordered(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """The listed columns that exist, in the listed order."""
    return df.select(*[c for c in cols if c in df.columns])


def drop_nonfinite(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    keep = F.lit(True)
    for c in cols:
        keep = keep & is_finite(c)
    return df.filter(keep)


def audit_nonfinite(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Per column the nulls and the infinite values, in one pass; NaN counts as null."""
    cols = list(cols)
    one = df.agg(
        *[
            F.struct(
                F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias("nulls"),
                F.count_if(F.abs(F.col(c).cast("double")) == float("inf")).alias("infinite"),
            ).alias(c)
            for c in cols
        ]
    )
    return one.unpivot([], cols, "column_name", "_found").select("column_name", "_found.nulls", "_found.infinite")


def binary_target_check(df: DataFrame, target: str = "Target") -> DataFrame:
    """Rows, rows outside {0, 1} (null included), and whether the target is binary."""
    bad = F.count_if(~F.coalesce(F.col(target).isin(0, 1), F.lit(False)))
    return df.agg(F.count(F.lit(1)).alias("rows"), bad.alias("bad")).withColumn("ok", F.col("bad") == 0)


def require_binary_target(df: DataFrame, target: str = "Target") -> DataFrame:
    """Fails the job on the first row whose target is neither 0 nor 1."""
    ok = F.coalesce(F.col(target).isin(0, 1), F.lit(False))
    return df.withColumn(
        target, F.when(ok, F.col(target)).otherwise(F.raise_error(F.lit(f"{target} is not binary")))
    )


def rename_keys(df: DataFrame) -> DataFrame:
    """symbol, date -> Symbol, Date."""
    return df.withColumnsRenamed({"symbol": "Symbol", "date": "Date"})


def high_volume(df: DataFrame, threshold: float = 1e6) -> DataFrame:
    return df.filter(F.col("Volume") > threshold)


def round_outputs(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})
