"""Column contracts: the bar table, the ordered model vector, and the guards on them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

SYMBOL = "Symbol"
DATE = "Date"
PRICES = ["Open", "High", "Low", "Close"]
NUMERICS = [*PRICES, "Volume"]
BAR_COLUMNS = [SYMBOL, DATE, *NUMERICS]

BAR_SCHEMA = "Symbol string, Date date, Open double, High double, Low double, Close double, Volume double"

# The ordered model vector. Trained models depend on this order.
FEATURES = [
    "Open",
    "High",
    "Low",
    "Close",
    "Volume",
    "MA5",
    "MA10",
    "MA20",
    "EMA12",
    "RSI",
    "MACD",
    "MACD_Signal",
    "Daily_Returns",
    "Volatility",
    "Price_Change_Pct",
    "Weekly_Momentum",
    "Trend_Strength",
    "BB_Width",
    "Avg_5D_Volume_Trend",
    "Lag_1",
    "Lag_3",
]

# The columns of the correlation report.
CORRELATED = ["Close", "Volume", "RSI", "MACD", "Volatility", "MA5", "MA20", "Daily_Returns", "Trend_Strength"]


def missing_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    """Required names that the frame lacks, sorted."""
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    """The frame itself, or an error that names every missing column."""
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def require_order(columns: list[str], expected: list[str] = FEATURES) -> list[str]:
    """A model vector must list exactly the expected columns in the expected order."""
    if list(columns) != list(expected):
        raise ValueError(f"feature order differs: expected {expected}, got {list(columns)}")
    return columns
