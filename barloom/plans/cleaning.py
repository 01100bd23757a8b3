"""The cleaning chain over raw text bars, with row counts per stage."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from barloom.operators import clean as c
from barloom.schema import BAR_COLUMNS, NUMERICS, require_columns


def stages(raw: DataFrame, min_rows: int = 100, fmt: str | list[str] | None = None, intraday: bool = False, bucket: str = "month") -> dict[str, DataFrame]:
    """Each stage of the chain by name, in order; every frame builds on the one before it.

    `raw` carries `seq`, the file order that decides which copy of a bar survives.
    """
    require_columns(raw, [*BAR_COLUMNS, "seq"])
    dated = c.coerce_date(c.drop_columns(raw), fmt=fmt, intraday=intraday)
    unique = c.dedup_keep_last(c.coerce_numeric(dated)).select(*BAR_COLUMNS)
    filled = c.forward_fill(unique, bucket=bucket)
    sane = c.price_sanity(filled)
    return {"raw": raw, "dated": dated, "unique": unique, "filled": filled, "sane": sane,
            "kept": c.drop_thin_symbols(sane, min_rows)}


def clean(
    raw: DataFrame,
    min_rows: int = 100,
    fmt: str | list[str] | None = None,
    intraday: bool = False,
    bucket: str = "month",
    counts: dict[str, Observation] | None = None,
) -> DataFrame:
    """Clean bars. `counts` gives observations by stage name, filled in passing by the first action."""
    require_columns(raw, [*BAR_COLUMNS, "seq"])
    counts = counts or {}

    def seen(df: DataFrame, stage: str) -> DataFrame:
        return df.observe(counts[stage], F.count(F.lit(1)).alias("rows")) if stage in counts else df

    dated = seen(c.coerce_date(c.drop_columns(seen(raw, "raw")), fmt=fmt, intraday=intraday), "dated")
    unique = seen(c.dedup_keep_last(c.coerce_numeric(dated)).select(*BAR_COLUMNS), "unique")
    sane = seen(c.price_sanity(seen(c.forward_fill(unique, bucket=bucket), "filled")), "sane")
    return seen(c.drop_thin_symbols(sane, min_rows), "kept")


STAGES = ("raw", "dated", "unique", "filled", "sane", "kept")


def stage_counts(raw: DataFrame, min_rows: int = 100, fmt: str | list[str] | None = None, intraday: bool = False, bucket: str = "month") -> DataFrame:
    """Rows per stage and how many each removed, as a table (`clean(counts=...)` gives the same in passing).

    One chain, which the filling of bars with a time of day reads twice: copies of a key collapse into one row with their number, every row is marked with the furthest stage it
    reaches, and the marks are added up per symbol, where the rule on thin symbols is decided. Rows without a date stand
    under a date of their own without values, so they are counted and fill nothing.
    """
    require_columns(raw, [*BAR_COLUMNS, "seq"])
    none = F.lit("0001-01-01").cast("timestamp" if intraday else "date")
    dated = c.coerce_numeric(raw).withColumn("Date", c.date_of("Date", fmt, intraday))
    dated = dated.withColumns({n: F.when(F.col("Date").isNotNull(), F.col(n)) for n in NUMERICS}).withColumn("Date", F.coalesce("Date", none))
    # as in dedup_keep_last: the last of a key by seq, the other columns break ties
    last = F.max(F.struct("seq", *NUMERICS)).alias("_last")
    unique = dated.groupBy("Symbol", "Date").agg(F.count(F.lit(1)).alias("_copies"), last).select("Symbol", "Date", "_copies", *[f"_last.{n}" for n in NUMERICS])
    # rows without a symbol are counted too, apart from those of an empty one
    marked = c.fill_values(unique.withColumn("Symbol", F.coalesce(F.concat(F.lit("="), "Symbol"), F.lit(""))), bucket=bucket)
    known, filled = F.col("Date") != none, reduce(and_, [F.col(n).isNotNull() for n in NUMERICS])
    per_symbol = marked.groupBy("Symbol").agg(
        F.sum("_copies").alias("raw"), F.sum(F.when(known, F.col("_copies")).otherwise(0)).alias("dated"), F.count_if(known).alias("unique"),
        F.count_if(known & filled).alias("filled"), F.count_if(known & filled & c.is_sane()).alias("sane"))
    per_symbol = per_symbol.withColumn("kept", F.when(F.col("sane") >= min_rows, F.col("sane")).otherwise(0))
    totals = per_symbol.agg(*[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in STAGES])
    before = [F.col(STAGES[max(i - 1, 0)]) for i in range(len(STAGES))]
    rows = [F.struct(F.lit(i).cast("long").alias("step"), F.lit(s).alias("stage"), F.col(s).alias("rows"), (before[i] - F.col(s)).alias("removed")) for i, s in enumerate(STAGES)]
    return totals.select(F.inline(F.array(*rows)))
