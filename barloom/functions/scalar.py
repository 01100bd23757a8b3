"""Row-level expressions. Every divisor goes through try_divide: zero gives null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pct(part: str | Column, whole: str | Column) -> Column:
    """part / whole * 100."""
    return F.try_divide(_c(part), _c(whole)) * 100.0


def growth(now: str | Column, then: str | Column) -> Column:
    """Percent change from `then` to `now`."""
    return (F.try_divide(_c(now), _c(then)) - 1.0) * 100.0


def range_abs() -> Column:
    return F.col("High") - F.col("Low")


def range_pct() -> Column:
    return pct(range_abs(), "Close")


def intraday_change() -> Column:
    return pct(F.col("Close") - F.col("Open"), "Open")


def direction() -> Column:
    """bull when the bar closed above its open, else bear."""
    return F.when(F.col("Close") > F.col("Open"), "bull").otherwise("bear")


def is_finite(x: str | Column) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    x = _c(x).cast("double")
    return F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False))


def confidence(p_up: str | Column) -> Column:
    """Probability of the predicted side."""
    return F.greatest(_c(p_up), 1.0 - _c(p_up))


def confidence_band(percent: str | Column) -> Column:
    """High above 80, Medium above 60, else Low; the argument is in percent."""
    return F.when(_c(percent) > 80, "High").when(_c(percent) > 60, "Medium").otherwise("Low")


def next_business_day(day: str | Column) -> Column:
    """First Monday-to-Friday day after `day`."""
    day = _c(day).cast("date")
    return F.date_add(day, F.when(F.dayofweek(day) == 6, 3).when(F.dayofweek(day) == 7, 2).otherwise(1))


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0 (the convention of the classification metrics)."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
