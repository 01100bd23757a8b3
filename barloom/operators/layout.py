"""How a series is spread over tasks.

Indicators need the rows of one symbol in time order, and the obvious window,
`partitionBy("Symbol")`, puts a whole symbol into one task. For daily bars that
is safe: (Symbol, Date) is unique and a calendar holds some tens of thousands
of days; many bars are dealt by symbol to as many tasks as `DAILY` asks for. For bars with a time of day there is no such bound, so `lay_out` cuts
a series into blocks of neighbouring time buckets and sends each bucket also to
the blocks whose windows look back (`before` rows) or ahead (`after` rows) into
it. All windows then run per (Symbol, block), and `settle` keeps each row once,
in the block that owns it.

Only the table of rows per (Symbol, bucket) is needed to place the blocks: a scan of
two columns whose counts are combined before they move. The bars move by (Symbol, bucket)
to meet it, and by (Symbol, block) for the windows. The bucket is the widest
calendar unit of which no symbol has more than an eighth of a block in one, so a
month of second bars makes many blocks too; `bucket` fixes it and saves the look.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

BLOCK = "_block"
BEFORE = "rows_before"
OWN = "_own"

# Rows copied before a block unless a step asks for more: enough for an exponential average up to alpha 1/14,
# (13/14)^1000 being below 1e-32.
HALO = 1000
CORE = 65_536
# Daily bars a task: the windows of all features sort them several times, with all columns.
DAILY = 131_072


class NeedsRows(ValueError):
    """A step looks further back than the rows that its blocks hold; `rows` is what it needs."""

    def __init__(self, rows: int):
        super().__init__(f"lay the bars out with before={rows}")
        self.rows = rows


def require_before(df: DataFrame, rows: int) -> None:
    """Raise unless the blocks of a laid-out frame hold so many rows before their own."""
    if BLOCK in df.columns and df.schema[BLOCK].metadata.get(BEFORE, 0) < rows:
        raise NeedsRows(rows)


def is_daily(df: DataFrame) -> bool:
    """True when Date has day resolution, which bounds the rows of a symbol."""
    return isinstance(df.schema["Date"].dataType, DateType)


def by_symbol(bars: DataFrame, rows: int = DAILY) -> DataFrame:
    """Daily bars dealt by symbol to one task for each `rows` of them, or as they are if there are enough tasks anyway.

    The windows keep this exchange in place of their own, so the memory of a task does not grow with the bars. Counting
    them reads the two key columns.
    """
    tasks = -(-bars.count() // rows)
    return bars.repartition(tasks, "Symbol") if tasks > bars.sparkSession.sparkContext.defaultParallelism else bars


def series_keys(df: DataFrame) -> list[str]:
    return ["Symbol", BLOCK] if BLOCK in df.columns else ["Symbol"]


def over(df: DataFrame) -> WindowSpec:
    """The time-ordered window of one series (or of one block of it)."""
    return W.partitionBy(*series_keys(df)).orderBy("Date")


#: calendar units a bucket may have, widest first
UNITS = ("month", "day", "hour", "minute", "second")


def fitting_bucket(bars: DataFrame, core: int = CORE) -> str:
    """The widest unit of which no symbol has more than an eighth of `core` rows in one; a second at least.

    Each look is a count per (Symbol, unit), combined in the tasks; the usual bars need one.
    """
    for unit in UNITS[:-1]:
        counts = bars.groupBy("Symbol", F.date_trunc(unit, "Date").alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
        if (counts.agg(F.max("_n")).first()[0] or 0) <= core // 8:
            return unit
    return UNITS[-1]


def bucket_counts(bars: DataFrame, bucket: str) -> DataFrame:
    """Rows per (Symbol, time bucket) and the position `_from` of the bucket's first row in its series."""
    counts = bars.groupBy("Symbol", F.date_trunc(bucket, "Date").alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    # one row per calendar bucket, so this window is small for every symbol
    running = F.sum("_n").over(W.partitionBy("Symbol").orderBy("_bucket"))
    return counts.withColumn("_from", running - F.col("_n"))


def _placement(bars: DataFrame, before: int, after: int, core: int, bucket: str) -> DataFrame:
    by_time = W.partitionBy("Symbol").orderBy("_bucket")
    widest = F.max("_n").over(W.partitionBy("Symbol"))
    placed = bucket_counts(bars, bucket).withColumn(
        BLOCK, F.floor(F.col("_from") / F.greatest(F.lit(core), 8 * widest))
    )
    placed = placed.withColumns(
        {
            "_to": F.col("_from") + F.col("_n"),
            "_head": F.when(F.coalesce(F.lag(BLOCK).over(by_time) != F.col(BLOCK), F.lit(True)), F.col(BLOCK)),
            "_tail": F.when(F.coalesce(F.lead(BLOCK).over(by_time) != F.col(BLOCK), F.lit(True)), F.col(BLOCK)),
        }
    )
    # blocks that start within `before` rows after a bucket, and blocks that end within `after` rows before it
    ahead = W.partitionBy("Symbol").orderBy("_from").rangeBetween(0, before - 1)
    behind = W.partitionBy("Symbol").orderBy("_to").rangeBetween(1 - after, 0)
    placed = placed.withColumns(
        {"_starts": F.collect_list("_head").over(ahead), "_ends": F.collect_list("_tail").over(behind)}
    )
    none = F.array().cast("array<bigint>")
    return placed.select(
        "Symbol",
        "_bucket",
        F.col(BLOCK).alias("_home"),
        F.concat(
            F.array(BLOCK),
            F.coalesce(F.lead("_starts").over(by_time), none),
            F.coalesce(F.lag("_ends").over(by_time), none),
        ).alias("_blocks"),
    )


def lay_out(
    bars: DataFrame,
    before: int = HALO,
    after: int = 1,
    core: int = CORE,
    bucket: str | None = None,
    force: bool = False,
) -> DataFrame:
    """Bars with a block column, ready for `over`; (Symbol, Date) must be unique and not null.

    `bucket` names a date_trunc unit that holds a moderate number of rows of one
    symbol; without it `fitting_bucket` finds one.
    Daily bars stay without blocks unless `force` is set (see `by_symbol`).
    """
    if BLOCK in bars.columns:
        return bars
    if is_daily(bars) and not force:
        return by_symbol(bars)
    # days are bounded by the calendar, so a symbol of daily bars has few in a month
    bucket = bucket or ("month" if is_daily(bars) else fitting_bucket(bars, core))
    placed = _placement(bars, max(before, 1), max(after, 1), core, bucket)
    spread = bars.withColumn("_bucket", F.date_trunc(bucket, "Date")).join(placed, ["Symbol", "_bucket"])
    spread = spread.select(*bars.columns, "_home", F.explode("_blocks").alias(BLOCK))
    spread = spread.withColumn(OWN, F.col(BLOCK) == F.col("_home")).drop("_home")
    return spread.withColumn(BLOCK, F.col(BLOCK).alias(BLOCK, metadata={BEFORE: max(before, 1)}))


def settle(df: DataFrame) -> DataFrame:
    """Drop the copies that `lay_out` made, and its columns."""
    if BLOCK not in df.columns:
        return df
    return df.filter(OWN).drop(BLOCK, OWN)


def with_positions(bars: DataFrame, bucket: str = "month") -> DataFrame:
    """Exact 1-based row number `pos` in the series and its length `total`, without one task per symbol."""
    if is_daily(bars):
        w = W.partitionBy("Symbol")
        return bars.withColumns(
            {"pos": F.row_number().over(w.orderBy("Date")).cast("long"), "total": F.count(F.lit(1)).over(w)}
        )
    counts = bucket_counts(bars, bucket).withColumn("total", F.sum("_n").over(W.partitionBy("Symbol"))).drop("_n")
    inside = W.partitionBy("Symbol", "_bucket").orderBy("Date")
    return (
        bars.withColumn("_bucket", F.date_trunc(bucket, "Date"))
        .join(counts, ["Symbol", "_bucket"])
        .withColumn("pos", F.col("_from") + F.row_number().over(inside))
        .select(*bars.columns, "pos", "total")
    )
