"""Rolling expressions over an ordered series window.

`min_periods` defaults to the window length (null until the window is full);
1 gives the partial form, whose frame shrinks at the start of the series.
The guard counts the aggregated column itself, so nulls in it delay the start.
"""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from barloom.functions.scalar import _c, growth, pct


def _rolling(agg, x: str | Column, n: int, w: WindowSpec, min_periods: int | None) -> Column:
    frame = w.rowsBetween(1 - n, 0)
    value = agg(_c(x)).over(frame)
    need = n if min_periods is None else min_periods
    return value if need <= 1 else F.when(F.count(_c(x)).over(frame) >= need, value)


def mean(x: str | Column, n: int, w: WindowSpec, min_periods: int | None = None) -> Column:
    return _rolling(F.avg, x, n, w, min_periods)


def std(x: str | Column, n: int, w: WindowSpec, min_periods: int | None = None) -> Column:
    """Sample deviation; a frame of one row gives null."""
    return _rolling(F.stddev_samp, x, n, w, min_periods)


def change(x: str | Column, k: int, w: WindowSpec) -> Column:
    """Percent change against the value k rows earlier."""
    return growth(x, F.lag(_c(x), k).over(w))


def future_change(x: str | Column, w: WindowSpec, k: int = 1) -> Column:
    """Percent change of the value k rows later against this one."""
    return pct(F.lead(_c(x), k).over(w) - _c(x), x)
