"""Technical indicators of one series, each a DataFrame -> DataFrame step that adds columns.

Run them on a laid-out frame (see `layout.lay_out`) or on daily bars as they are.
The default forms are strict: null until the window is full. `min_periods=1`
gives the partial forms.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from barloom.functions import rolling, scalar
from barloom.operators.ewm import SEGMENT_COLUMNS, Ewm, segmented, span, with_ewm
from barloom.operators.layout import over


# Column builders: what an indicator is, given the window of its series.


def bollinger_position_of(w: WindowSpec, n: int = 20, k: float = 2.0) -> Column:
    mid, sd = rolling.mean("Close", n, w), rolling.std("Close", n, w)
    lower, upper = mid - k * sd, mid + k * sd
    return F.try_divide(F.col("Close") - lower, upper - lower)


def bollinger_width_of(w: WindowSpec, n: int = 20, k: float = 2.0, min_periods: int | None = None) -> Column:
    """Distance of the upper and the lower band in percent of the mean."""
    mid, sd = rolling.mean("Close", n, w, min_periods), rolling.std("Close", n, w, min_periods)
    return scalar.pct((mid + k * sd) - (mid - k * sd), mid)


def rsi_of_means(gain: str, loss: str) -> Column:
    """RSI of a mean gain and a mean loss; a zero loss counts as 0.0001."""
    floor = F.when(F.col(loss) == 0, F.lit(0.0001)).otherwise(F.col(loss))
    return _rsi_from(F.col(gain), floor)


def target_of(future: str | Column, band: float = 1.0) -> Column:
    """1 above +band percent, 0 below -band percent, null in the noise between."""
    future = scalar._c(future)
    return F.when(future > band, 1).when(future < -band, 0)


# Steps.


def moving_averages(df: DataFrame, windows: Iterable[int] = (5, 10, 20), min_periods: int | None = None) -> DataFrame:
    w = over(df)
    return df.withColumns({f"MA{n}": rolling.mean("Close", n, w, min_periods) for n in windows})


def daily_return(df: DataFrame) -> DataFrame:
    return df.withColumn("Daily_Returns", rolling.change("Close", 1, over(df)))


def momentum(df: DataFrame, n: int = 5) -> DataFrame:
    return df.withColumn("Weekly_Momentum", rolling.change("Close", n, over(df)))


def volatility(df: DataFrame) -> DataFrame:
    return df.withColumn("Volatility", scalar.range_abs())


def price_change(df: DataFrame) -> DataFrame:
    return df.withColumn("Price_Change_Pct", scalar.intraday_change())


def lags(df: DataFrame, steps: Iterable[int] = (1, 3)) -> DataFrame:
    w = over(df)
    return df.withColumns({f"Lag_{k}": F.lag("Close", k).over(w) for k in steps})


def volume_change(df: DataFrame) -> DataFrame:
    return df.withColumn("Volume_Change_Pct", rolling.change("Volume", 1, over(df)))


def volume_trend(df: DataFrame, n: int = 10, name: str = "Avg_Volume_Trend", min_periods: int | None = None) -> DataFrame:
    return df.withColumn(name, F.try_divide(F.col("Volume"), rolling.mean("Volume", n, over(df), min_periods)))


def volume_ratio(df: DataFrame, n: int = 20) -> DataFrame:
    """Partial-frame volume mean and the volume relative to it."""
    return df.withColumn("Volume_MA20", rolling.mean("Volume", n, over(df), 1)).withColumn(
        "Volume_Ratio", F.try_divide("Volume", "Volume_MA20")
    )


def trend_strength(df: DataFrame) -> DataFrame:
    """Distance of MA5 from MA20 in percent of MA20; needs both columns."""
    return df.withColumn("Trend_Strength", scalar.pct(F.abs(F.col("MA5") - F.col("MA20")), "MA20"))


def rolling_std_returns(df: DataFrame, n: int = 10) -> DataFrame:
    """Deviation of the last n daily returns; needs Daily_Returns."""
    return df.withColumn("Rolling_Std_Returns", rolling.std("Daily_Returns", n, over(df)))


def rolling_std_close(df: DataFrame, n: int = 20, min_periods: int | None = 1) -> DataFrame:
    return df.withColumn(f"Rolling_Std_{n}", rolling.std("Close", n, over(df), min_periods))


def bollinger_position(df: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    return df.withColumn("BB_Position", bollinger_position_of(over(df), n, k))


def bollinger_width(df: DataFrame, n: int = 20, k: float = 2.0, min_periods: int | None = None) -> DataFrame:
    return df.withColumn("BB_Width", bollinger_width_of(over(df), n, k, min_periods))


def bollinger_width_half(df: DataFrame, n: int = 20) -> DataFrame:
    """Two deviations in percent of the mean, on shrinking frames."""
    w = over(df)
    return df.withColumn("BB_Width_Half", scalar.pct(2.0 * rolling.std("Close", n, w, 1), rolling.mean("Close", n, w, 1)))


def ema(df: DataFrame, n: int = 12, x: str = "Close", name: str | None = None) -> DataFrame:
    return with_ewm(df, {name or f"EMA{n}": Ewm(x, span(n), n)})


def ema_as_sma(df: DataFrame, n: int = 12) -> DataFrame:
    """The live job's stand-in for the exponential average: a partial n-row mean."""
    return df.withColumn(f"EMA{n}", rolling.mean("Close", n, over(df), 1))


def _moves(df: DataFrame) -> DataFrame:
    move = F.col("Close") - F.lag("Close", 1).over(over(df))
    return df.withColumn("_move", move)


def _wilder(n: int) -> dict[str, Ewm]:
    gain = F.greatest(F.col("_move"), F.lit(0.0))
    loss = F.greatest(-F.col("_move"), F.lit(0.0))
    # greatest skips nulls, the first row must stay null
    known = F.col("_move").isNotNull()
    return {
        "_gain": Ewm(F.when(known, gain), 1.0 / n, n),
        "_loss": Ewm(F.when(known, loss), 1.0 / n, n),
    }


def _rsi_from(gain: str | Column, loss: str | Column) -> Column:
    return 100.0 - F.try_divide(F.lit(100.0), 1.0 + F.try_divide(gain, loss))


def rsi_wilder(df: DataFrame, n: int = 14) -> DataFrame:
    """Relative strength with Wilder smoothing; null while there is no loss to divide by."""
    df = with_ewm(_moves(df), _wilder(n))
    return df.withColumn("RSI", _rsi_from("_gain", "_loss")).drop("_move", "_gain", "_loss")


def macd(df: DataFrame) -> DataFrame:
    df = segmented(df, span(26))
    df = with_ewm(df, {"_fast": Ewm("Close", span(12), 12), "_slow": Ewm("Close", span(26), 26)})
    return _macd_from(df).drop("_fast", "_slow", *SEGMENT_COLUMNS)


def _macd_from(df: DataFrame) -> DataFrame:
    df = df.withColumn("MACD", F.col("_fast") - F.col("_slow"))
    df = with_ewm(df, {"MACD_Signal": Ewm("MACD", span(9), 9)})
    return df.withColumn("MACD_Hist", F.col("MACD") - F.col("MACD_Signal"))


def exponential_family(df: DataFrame) -> DataFrame:
    """EMA12, RSI and the three MACD columns with one pass for all averages of the close."""
    df = with_ewm(
        segmented(_moves(df), span(26), 1.0 / 14),
        {"EMA12": Ewm("Close", span(12), 12), "_slow": Ewm("Close", span(26), 26), **_wilder(14)},
    )
    df = _macd_from(df.withColumn("_fast", F.col("EMA12")))
    return df.withColumn("RSI", _rsi_from("_gain", "_loss")).drop(
        "_move", "_gain", "_loss", "_fast", "_slow", *SEGMENT_COLUMNS
    )


def rsi_simple(df: DataFrame, n: int = 14) -> DataFrame:
    """RSI over plain means of shrinking frames; a zero mean loss counts as 0.0001."""
    df = _moves(df)
    # the first row has no move and counts as neither gain nor loss
    df = df.withColumns(
        {
            "_gain": F.when(F.col("_move") > 0, F.col("_move")).otherwise(0.0),
            "_loss": F.when(F.col("_move") < 0, -F.col("_move")).otherwise(0.0),
        }
    )
    w = over(df)
    df = df.withColumns({"_gain": rolling.mean("_gain", n, w, 1), "_loss": rolling.mean("_loss", n, w, 1)})
    return df.withColumn("RSI", rsi_of_means("_gain", "_loss")).drop("_move", "_gain", "_loss")


def macd_as_sma(df: DataFrame) -> DataFrame:
    """MACD line and signal from plain partial means of 12, 26 and 9 rows."""
    w = over(df)
    df = df.withColumn("MACD", rolling.mean("Close", 12, w, 1) - rolling.mean("Close", 26, w, 1))
    return df.withColumn("MACD_Signal", rolling.mean("MACD", 9, w, 1))


def future_return(df: DataFrame) -> DataFrame:
    return df.withColumn("Future_Return_Pct", rolling.future_change("Close", over(df)))


def target(df: DataFrame, band: float = 1.0) -> DataFrame:
    """Label from Future_Return_Pct, which must be present."""
    return df.withColumn("Target", target_of("Future_Return_Pct", band))
