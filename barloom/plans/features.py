"""Whole feature tables: the strict training set, the batch set and the live set."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions import rolling, scalar
from barloom.operators import indicators as ind
from barloom.operators.datasets import last_n
from barloom.operators.layout import NeedsRows, is_daily, lay_out, over, settle
from barloom.schema import BAR_COLUMNS, FEATURES, require_columns

Step = Callable[[DataFrame], DataFrame]


def apply_indicators(bars: DataFrame, steps: list[tuple[str, Step]], **layout) -> DataFrame:
    """Compose named steps over one laid-out series; the names label errors.

    A step that looks further back than the layout has it laid out anew with as many rows as it needs.
    """
    df = lay_out(bars, **layout)
    for name, step in steps:
        try:
            df = df.transform(step)
        except NeedsRows as more:
            return apply_indicators(bars, steps, **{**layout, "before": more.rows})
        except Exception as error:
            raise RuntimeError(f"indicator step {name!r} failed") from error
    return settle(df)


def apply_per_symbol(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Escape hatch for pandas code that needs one whole symbol: the rows of each go to one task.

    Only for daily bars, where the calendar bounds a symbol; everything in the
    library itself works without it.
    """
    if not is_daily(df):
        raise ValueError("bars with a time of day have no bound per symbol: cast Date to date first")
    return df.groupBy("Symbol").applyInPandas(lambda part: fn(part.sort_values("Date")), schema)


def _closed_form(df: DataFrame) -> DataFrame:
    """Every strict column that depends on the bars alone: one window pass, then projections.

    Spark evaluates each window expression it is given, so the shared ones get a name first.
    """
    w = over(df)
    df = df.withColumns(
        {
            **{f"MA{n}": rolling.mean("Close", n, w) for n in (5, 10, 20)},
            **{f"_volume_{n}": rolling.mean("Volume", n, w) for n in (5, 10)},
            "_sd": rolling.std("Close", 20, w),
            "Lag_1": F.lag("Close", 1).over(w),
            "Lag_3": F.lag("Close", 3).over(w),
            "_lag_5": F.lag("Close", 5).over(w),
            "_volume_lag": F.lag("Volume", 1).over(w),
            "_next": F.lead("Close", 1).over(w),
        }
    )
    lower, upper = F.col("MA20") - 2.0 * F.col("_sd"), F.col("MA20") + 2.0 * F.col("_sd")
    return df.withColumns(
        {
            "Daily_Returns": scalar.growth("Close", "Lag_1"),
            "Weekly_Momentum": scalar.growth("Close", "_lag_5"),
            "Volume_Change_Pct": scalar.growth("Volume", "_volume_lag"),
            "Volatility": scalar.range_abs(),
            "Price_Change_Pct": scalar.intraday_change(),
            "BB_Position": F.try_divide(F.col("Close") - lower, upper - lower),
            "BB_Width": scalar.pct(upper - lower, "MA20"),
            "Avg_Volume_Trend": F.try_divide("Volume", "_volume_10"),
            "Avg_5D_Volume_Trend": F.try_divide("Volume", "_volume_5"),
            "Trend_Strength": scalar.pct(F.abs(F.col("MA5") - F.col("MA20")), "MA20"),
            "Future_Return_Pct": scalar.pct(F.col("_next") - F.col("Close"), "Close"),
        }
    )


STRICT_STEPS: list[tuple[str, Step]] = [
    ("columns of the bars", _closed_form),
    ("deviation of returns", ind.rolling_std_returns),
    ("exponential averages", ind.exponential_family),
]

STRICT_COLUMNS = [
    *BAR_COLUMNS,
    "MA5",
    "MA10",
    "MA20",
    "Daily_Returns",
    "Volatility",
    "Price_Change_Pct",
    "Lag_1",
    "Lag_3",
    "RSI",
    "Volume_Change_Pct",
    "EMA12",
    "BB_Position",
    "MACD",
    "MACD_Signal",
    "MACD_Hist",
    "BB_Width",
    "Weekly_Momentum",
    "Avg_Volume_Trend",
    "Avg_5D_Volume_Trend",
    "Trend_Strength",
    "Rolling_Std_Returns",
    "Future_Return_Pct",
]


def strict_features(bars: DataFrame, **layout) -> DataFrame:
    """All strict indicators and the future return, one row per bar; nothing is dropped."""
    bars = require_columns(bars, BAR_COLUMNS).select(*BAR_COLUMNS)
    return apply_indicators(bars, STRICT_STEPS, **layout).select(*STRICT_COLUMNS)


def training_features(bars: DataFrame, band: float = 1.0, symbols: list[str] | None = None, **layout) -> DataFrame:
    """Strict features with the label; rows in the noise band or with any null are left out at the end."""
    if symbols is not None:
        bars = bars.filter(F.col("Symbol").isin(symbols))
    df = ind.target(strict_features(bars, **layout), band)
    return df.dropna(subset=["Target"]).dropna()


def batch_features(bars: DataFrame, **layout) -> DataFrame:
    """The batch job's set: partial frames, suffix `_Spark`, other columns kept."""
    df = lay_out(require_columns(bars, BAR_COLUMNS), before=20, **layout)
    w = over(df)
    df = df.withColumns(
        {
            **{f"MA{n}_Spark": rolling.mean("Close", n, w, 1) for n in (5, 10, 20)},
            "Rolling_Std_20_Spark": rolling.std("Close", 20, w, 1),
            "Volume_MA20_Spark": rolling.mean("Volume", 20, w, 1),
            "Close_Lag1_Spark": F.lag("Close", 1).over(w),
            "Close_Lag5_Spark": F.lag("Close", 5).over(w),
        }
    )
    df = df.withColumns(
        {
            "Daily_Returns_Spark": scalar.growth("Close", "Close_Lag1_Spark"),
            "Weekly_Momentum_Spark": scalar.growth("Close", "Close_Lag5_Spark"),
            "Volatility_Spark": scalar.range_pct(),
            "Volume_Ratio_Spark": F.try_divide("Volume", "Volume_MA20_Spark"),
            "Bollinger_Width_Spark": scalar.pct(2.0 * F.col("Rolling_Std_20_Spark"), "MA20_Spark"),
        }
    )
    return settle(df)


def live_features(bars: DataFrame, **layout) -> DataFrame:
    """The live job's set: plain partial means in place of exponential ones, per symbol."""
    df = lay_out(require_columns(bars, BAR_COLUMNS).select(*BAR_COLUMNS), before=LIVE_CONTEXT, **layout)
    w = over(df)
    df = df.withColumns(
        {
            **{f"MA{n}": rolling.mean("Close", n, w, 1) for n in (5, 10, 20)},
            "EMA12": rolling.mean("Close", 12, w, 1),
            "_mean_26": rolling.mean("Close", 26, w, 1),
            "_sd": rolling.std("Close", 20, w, 1),
            "_volume_5": rolling.mean("Volume", 5, w, 1),
            "Lag_1": F.lag("Close", 1).over(w),
            "Lag_3": F.lag("Close", 3).over(w),
            "_lag_5": F.lag("Close", 5).over(w),
        }
    )
    move = F.col("Close") - F.col("Lag_1")
    df = df.withColumns(
        {
            "MACD": F.col("EMA12") - F.col("_mean_26"),
            "_gain": F.when(move > 0, move).otherwise(0.0),
            "_loss": F.when(move < 0, -move).otherwise(0.0),
            "Daily_Returns": scalar.growth("Close", "Lag_1"),
            "Weekly_Momentum": scalar.growth("Close", "_lag_5"),
            "Volatility": scalar.range_abs(),
            "Price_Change_Pct": scalar.intraday_change(),
            "BB_Width": scalar.pct(4.0 * F.col("_sd"), "MA20"),
            "Avg_5D_Volume_Trend": F.try_divide("Volume", "_volume_5"),
            "Trend_Strength": scalar.pct(F.abs(F.col("MA5") - F.col("MA20")), "MA20"),
        }
    )
    df = df.withColumns(
        {
            "MACD_Signal": rolling.mean("MACD", 9, w, 1),
            "_gain": rolling.mean("_gain", 14, w, 1),
            "_loss": rolling.mean("_loss", 14, w, 1),
        }
    )
    df = df.withColumn("RSI", ind.rsi_of_means("_gain", "_loss"))
    return settle(df).select("Symbol", "Date", *FEATURES)


# Rows before a bar that its live columns can see: a mean of 9 over means of 26, rounded up.
LIVE_CONTEXT = 40


def recent_live_features(bars: DataFrame, n: int) -> DataFrame:
    """Live features of the last n bars per symbol; older bars never leave the task that reads them."""
    return last_n(live_features(last_n(bars, n + LIVE_CONTEXT)), n)


def features(bars: DataFrame, mode: str = "strict", **layout) -> DataFrame:
    """strict, partial (the batch set) or sma (the live set)."""
    modes = {"strict": strict_features, "partial": batch_features, "sma": live_features}
    return modes[mode](bars, **layout)
