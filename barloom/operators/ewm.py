"""Exponentially weighted means, y0 = x0 and y = (1 - alpha) * y_previous + alpha * x.

The recurrence is linear, so inside a segment of rows it equals a running sum of
x scaled by powers of (1 - alpha). Segments are long enough that the sum of one
segment is all that the next can see in double precision, and short enough that
the powers stay in range. Everything is running window sums, O(rows), in the JVM.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.operators.layout import over, require_before, series_keys

# natural logs of the weight that counts as gone (7e-33) and of the largest safe power (1e299)
_GONE = 74.0
_SAFE = 690.0


class Ewm(NamedTuple):
    """One average: the input expression, its alpha, and the inputs needed before a value shows."""

    x: str | Column
    alpha: float
    min_periods: int = 1


def span(n: int) -> float:
    """Alpha of an n-row exponential average."""
    return 2.0 / (n + 1.0)


def halo(alpha: float) -> int:
    """Rows after which the start of an average no longer shows in a double."""
    return math.ceil(_GONE / -math.log1p(-alpha))


def segmented(df: DataFrame, *alphas: float) -> DataFrame:
    """Number the rows of each series by segment, long enough for the slowest of the averages.

    Steps that share one segmentation also share one sort.
    """
    rows = max(halo(a) for a in alphas)
    position = F.row_number().over(over(df)) - 1
    df = df.withColumn("_pos", position)
    return df.withColumns(
        {"_seg": F.floor(F.col("_pos") / rows), "_step": F.col("_pos") % rows, "_rows": F.lit(rows)}
    ).drop("_pos")


SEGMENT_COLUMNS = ["_seg", "_step", "_rows"]


def with_ewm(df: DataFrame, averages: dict[str, Ewm]) -> DataFrame:
    """Add one column per entry. Inputs may start with nulls; inside they should hold none (fill first).

    On a laid-out frame the average starts in the rows before the block; where they
    are too few for the start to vanish, `layout.NeedsRows` says how many it takes.
    A frame that is already segmented keeps its segments.
    """
    if not all(0.0 < a.alpha < 1.0 for a in averages.values()):
        raise ValueError("alpha must lie between 0 and 1")
    require_before(df, max(max(halo(a.alpha), a.min_periods) for a in averages.values()))
    if "_seg" not in df.columns:
        decay = {name: -math.log1p(-a.alpha) for name, a in averages.items()}
        if math.ceil(_GONE / min(decay.values())) * max(decay.values()) > _SAFE:
            # one segment length cannot serve the slow and the fast one: do the fastest apart
            fast = max(decay, key=decay.get)
            slow = {name: a for name, a in averages.items() if name != fast}
            return with_ewm(with_ewm(df, slow), {fast: averages[fast]})
        df = segmented(df, *[a.alpha for a in averages.values()])
        return with_ewm(df, averages).drop(*SEGMENT_COLUMNS)

    columns = df.columns
    df = df.withColumns({f"_x_{n}": F.col(a.x) if isinstance(a.x, str) else a.x for n, a in averages.items()})

    keys = series_keys(df)
    inside = W.partitionBy(*keys, "_seg").orderBy("Date").rowsBetween(W.unboundedPreceding, 0)
    # the same sort order as `inside`, so that Spark sorts once for both
    series = W.partitionBy(*keys).orderBy("_seg", "Date")
    so_far = series.rowsBetween(W.unboundedPreceding, 0)
    earlier = series.rowsBetween(W.unboundedPreceding, -1)

    def keep(a: Ewm, n: Column | str) -> Column:
        return F.pow(F.lit(1.0 - a.alpha), n)

    scaled = {
        f"_in_{n}": F.sum(F.coalesce(F.col(f"_x_{n}"), F.lit(0.0)) * a.alpha * keep(a, -F.col("_step"))).over(inside)
        * keep(a, "_step")
        for n, a in averages.items()
    }
    df = df.withColumns(scaled)
    carried = {}
    for n, a in averages.items():
        carried[f"_n_{n}"] = F.count(f"_x_{n}").over(so_far)
        carried[f"_first_{n}"] = F.first(f"_x_{n}", ignorenulls=True).over(so_far)
        carried[f"_end_{n}"] = F.last(
            F.when(F.col("_step") == F.col("_rows") - 1, F.col(f"_in_{n}")), ignorenulls=True
        ).over(earlier)
    df = df.withColumns(carried)
    result = {
        n: F.when(
            (F.col(f"_n_{n}") >= a.min_periods) & F.col(f"_x_{n}").isNotNull(),
            F.col(f"_in_{n}")
            + F.coalesce(F.col(f"_end_{n}"), F.lit(0.0)) * keep(a, F.col("_step") + 1)
            + F.col(f"_first_{n}") * keep(a, F.col(f"_n_{n}")),
        )
        for n, a in averages.items()
    }
    return df.withColumns(result).select(*[c for c in columns if c not in averages], *averages)
