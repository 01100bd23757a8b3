"""Indicators and feature tables."""

from pyspark.sql import functions as F

from barloom.catalog.base import (
    BATCH_SHOWN,
    COMPLETE,
    EVENTS_BARS,
    LINEITEM_BARS,
    LIVE_SHOWN,
    STRICT_DAILY_CTES,
    STRICT_SHOWN,
    batch_ctes,
    ewm,
    growth,
    lag,
    live_ctes,
    query,
    rolling,
    strict,
    with_ctes,
)
from barloom.functions import scalar
from barloom.operators import indicators as ind
from barloom.operators.layout import lay_out, settle
from barloom.plans import features as plan
from barloom.schema import BAR_COLUMNS
from barloom.sources.adapters import events_bars, lineitem_bars

KEY = ["Symbol", "Date"]


def _step(name, columns, steps, shown, inner="SELECT * FROM f"):
    """One indicator over the hourly bars, checked against its column of the strict SQL."""

    @query(name, strict("Symbol, Date:d, " + shown, inner))
    def run(spark, sf_dir):
        df = lay_out(events_bars(spark, sf_dir))
        for step in steps:
            df = df.transform(step)
        # a label may be null: shown as a double
        return settle(df).select(*KEY, *[F.col(c).cast("double").alias(c) for c in columns])


_step("sma_strict", ["MA5", "MA10", "MA20"], [ind.moving_averages], "MA5:f, MA10:f, MA20:f")
_step("daily_return", ["Daily_Returns"], [ind.daily_return], "Daily_Returns:f")
_step("momentum", ["Weekly_Momentum"], [ind.momentum], "Weekly_Momentum:f")
_step("range_abs", ["Volatility"], [ind.volatility], "Volatility:f")
_step("intraday_change", ["Price_Change_Pct"], [ind.price_change], "Price_Change_Pct:f")
_step("rsi_wilder", ["RSI"], [ind.rsi_wilder], "RSI:f")
_step("volume_change", ["Volume_Change_Pct"], [ind.volume_change], "Volume_Change_Pct:f")
@query("ema_long_span", with_ctes({"bars": EVENTS_BARS, "e": f"SELECT *, {ewm('\"Close\"', '(2.0/201)', 200)} AS \"EMA200\" FROM bars"}, "Symbol, Date:d, EMA200:f", "SELECT * FROM e"))
def ema_long_span(spark, sf_dir):
    """A long average over small blocks: the blocks get the rows that it needs."""
    steps = [("ema", lambda df: ind.ema(df, 200))]
    return plan.apply_indicators(events_bars(spark, sf_dir), steps, core=64, bucket="day").select(*KEY, "EMA200")


_step("ema", ["EMA12"], [ind.ema], "EMA12:f")
_step("bb_position", ["BB_Position"], [ind.bollinger_position], "BB_Position:f")
_step("macd", ["MACD", "MACD_Signal", "MACD_Hist"], [ind.macd], "MACD:f, MACD_Signal:f, MACD_Hist:f")
_step("bb_width", ["BB_Width"], [ind.bollinger_width], "BB_Width:f")
_step("volume_trend", ["Avg_Volume_Trend"], [ind.volume_trend], "Avg_Volume_Trend:f")
_step(
    "volume_trend_5",
    ["Avg_5D_Volume_Trend"],
    [lambda df: ind.volume_trend(df, 5, "Avg_5D_Volume_Trend")],
    "Avg_5D_Volume_Trend:f",
)
_step("trend_strength", ["Trend_Strength"], [ind.moving_averages, ind.trend_strength], "Trend_Strength:f")
_step(
    "rolling_std_returns",
    ["Rolling_Std_Returns"],
    [ind.daily_return, ind.rolling_std_returns],
    "Rolling_Std_Returns:f",
)
_step("future_return", ["Future_Return_Pct"], [ind.future_return], "Future_Return_Pct:f")
_step("target", ["Target"], [ind.future_return, ind.target], "Target:f")
_step(
    "target_wide_band",
    ["Target"],
    [ind.future_return, lambda df: ind.target(df, 25.0)],
    "Target:f",
    """SELECT "Symbol", "Date", CASE WHEN "Future_Return_Pct" > 25 THEN 1 WHEN "Future_Return_Pct" < -25 THEN 0 END
       AS "Target" FROM f""",
)


@query("lags", with_ctes(
    {"bars": EVENTS_BARS},
    "Symbol, Date:d, Lag_1:f, Lag_3:f, Lag_5:f",
    f'SELECT *, {lag("Close", 1)} AS "Lag_1", {lag("Close", 3)} AS "Lag_3", {lag("Close", 5)} AS "Lag_5" FROM bars',
))
def lags(spark, sf_dir):
    df = ind.lags(lay_out(events_bars(spark, sf_dir), before=5), (1, 3, 5))
    return settle(df).select(*KEY, "Lag_1", "Lag_3", "Lag_5")


@query("bar_projections", with_ctes(
    {"bars": EVENTS_BARS},
    "Symbol, Date:d, range_pct:f, direction",
    """SELECT *, ("High" - "Low") / nullif("Close", 0) * 100 AS range_pct,
       CASE WHEN "Close" > "Open" THEN 'bull' ELSE 'bear' END AS direction FROM bars""",
))
def bar_projections(spark, sf_dir):
    return events_bars(spark, sf_dir).select(
        *KEY, scalar.range_pct().alias("range_pct"), scalar.direction().alias("direction")
    )


# Partial and simple-mean forms, over the hourly and the daily bars.


def _partial(name, columns, steps, shown, ctes, table):
    @query(name, with_ctes(ctes(EVENTS_BARS), "Symbol, Date:d, " + shown, table))
    def run(spark, sf_dir):
        df = lay_out(events_bars(spark, sf_dir), before=40)
        for step in steps:
            df = df.transform(step)
        return settle(df).select(*KEY, *columns)


_partial(
    "sma_partial",
    ["MA5", "MA10", "MA20"],
    [lambda df: ind.moving_averages(df, min_periods=1)],
    "MA5:f, MA10:f, MA20:f",
    live_ctes,
    "SELECT * FROM l",
)
_partial("rsi_simple", ["RSI"], [ind.rsi_simple], "RSI:f", live_ctes, "SELECT * FROM l")
_partial("ema_as_sma", ["EMA12"], [ind.ema_as_sma], "EMA12:f", live_ctes, "SELECT * FROM l")
_partial("macd_as_sma", ["MACD", "MACD_Signal"], [ind.macd_as_sma], "MACD:f, MACD_Signal:f", live_ctes, "SELECT * FROM l")
_partial(
    "bb_width_partial",
    ["BB_Width"],
    [lambda df: ind.bollinger_width(df, min_periods=1)],
    "BB_Width:f",
    live_ctes,
    "SELECT * FROM l",
)
_partial(
    "volume_trend_5_partial",
    ["Avg_5D_Volume_Trend"],
    [lambda df: ind.volume_trend(df, 5, "Avg_5D_Volume_Trend", 1)],
    "Avg_5D_Volume_Trend:f",
    live_ctes,
    "SELECT * FROM l",
)
_partial(
    "bb_width_half",
    ["BB_Width_Half"],
    [ind.bollinger_width_half],
    "BB_Width_Half:f",
    batch_ctes,
    'SELECT *, "Bollinger_Width_Spark" AS "BB_Width_Half" FROM b',
)
_partial(
    "rolling_std_close",
    ["Rolling_Std_20"],
    [ind.rolling_std_close],
    "Rolling_Std_20:f",
    batch_ctes,
    'SELECT *, "Rolling_Std_20_Spark" AS "Rolling_Std_20" FROM b',
)
_partial(
    "volume_ratio",
    ["Volume_MA20", "Volume_Ratio"],
    [ind.volume_ratio],
    "Volume_MA20:f, Volume_Ratio:f",
    batch_ctes,
    'SELECT *, "Volume_MA20_Spark" AS "Volume_MA20", "Volume_Ratio_Spark" AS "Volume_Ratio" FROM b',
)


# Whole feature tables.


@query("strict_features", strict(STRICT_SHOWN))
def strict_features(spark, sf_dir):
    return plan.strict_features(events_bars(spark, sf_dir))


@query("training_features", strict(STRICT_SHOWN + ", Target:i", f"SELECT * FROM f WHERE {COMPLETE}"))
def training_features(spark, sf_dir):
    return plan.training_features(events_bars(spark, sf_dir))


@query("training_features_daily", with_ctes(
    STRICT_DAILY_CTES, STRICT_SHOWN + ", Target:i", f"SELECT * FROM f WHERE {COMPLETE}"
))
def training_features_daily(spark, sf_dir):
    return plan.training_features(lineitem_bars(spark, sf_dir))


@query("batch_features", with_ctes(batch_ctes(EVENTS_BARS), BATCH_SHOWN, "SELECT * FROM b"))
def batch_features(spark, sf_dir):
    return plan.batch_features(events_bars(spark, sf_dir))


@query("batch_features_daily", with_ctes(batch_ctes(LINEITEM_BARS), BATCH_SHOWN, "SELECT * FROM b"))
def batch_features_daily(spark, sf_dir):
    return plan.batch_features(lineitem_bars(spark, sf_dir))


@query("live_features", with_ctes(live_ctes(EVENTS_BARS), LIVE_SHOWN, "SELECT * FROM l"))
def live_features(spark, sf_dir):
    return plan.live_features(events_bars(spark, sf_dir))


@query("live_features_daily", with_ctes(live_ctes(LINEITEM_BARS), LIVE_SHOWN, "SELECT * FROM l"))
def live_features_daily(spark, sf_dir):
    return plan.live_features(lineitem_bars(spark, sf_dir))


@query("apply_indicators", with_ctes(
    {"bars": EVENTS_BARS, "r": f'SELECT *, {growth(chr(34) + "Close" + chr(34), lag("Close", 1))} AS "Daily_Returns" FROM bars'},
    "Symbol, Date:d, Daily_Returns:f, Volatility:f, Rolling_Std_Returns:f",
    f"""SELECT *, "High" - "Low" AS "Volatility", {rolling('stddev_samp', 'Daily_Returns', 10)} AS "Rolling_Std_Returns" FROM r""",
))
def apply_indicators(spark, sf_dir):
    steps = [
        ("daily returns", ind.daily_return),
        ("volatility", ind.volatility),
        ("deviation of returns", ind.rolling_std_returns),
    ]
    df = plan.apply_indicators(events_bars(spark, sf_dir), steps, before=20)
    return df.select(*KEY, "Daily_Returns", "Volatility", "Rolling_Std_Returns")


@query("apply_per_symbol", with_ctes(
    {"bars": LINEITEM_BARS},
    "Symbol, Date:d, peak:f",
    """SELECT *, max("Close") OVER (PARTITION BY "Symbol" ORDER BY "Date"
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM bars""",
))
def apply_per_symbol(spark, sf_dir):
    """A function of the user over one symbol at a time: the highest close so far."""

    def peak(part):
        part["peak"] = part["Close"].cummax()
        return part[["Symbol", "Date", "peak"]]

    bars = lineitem_bars(spark, sf_dir).select("Symbol", "Date", "Close")
    return plan.apply_per_symbol(bars, peak, "Symbol string, Date date, peak double")


@query("select_features", with_ctes(
    live_ctes(EVENTS_BARS),
    "Symbol, Date:d, Close:f, RSI:f, MA20:f",
    """SELECT * FROM l WHERE "Symbol" IN ('click', 'error')""",
))
def select_features(spark, sf_dir):
    """Symbols picked after the windows, columns in the asked order, unknown columns skipped."""
    from barloom.operators.clean import filter_symbols, select_ordered

    df = filter_symbols(plan.features(events_bars(spark, sf_dir), "sma"), ["click", "error"])
    return select_ordered(df, ["Symbol", "Date", "Close", "RSI", "No_Such_Column", "MA20"])


@query("filter_symbol", with_ctes(
    {"bars": EVENTS_BARS},
    "Symbol, Date:d, Open:f, High:f, Low:f, Close:f, Volume:f",
    """SELECT * FROM bars WHERE "Symbol" = 'click'""",
))
def filter_symbol(spark, sf_dir):
    from barloom.operators.clean import filter_symbol as pick

    return pick(events_bars(spark, sf_dir), "click").select(*BAR_COLUMNS)


@query("round_outputs", with_ctes(
    live_ctes(EVENTS_BARS),
    "Symbol, Date:d, Close:f, RSI:f, Daily_Returns:f",
    """SELECT "Symbol", "Date", round("Close", 4) AS "Close", round("RSI", 6) AS "RSI",
       round("Daily_Returns", 2) AS "Daily_Returns" FROM l""",
))
def round_outputs(spark, sf_dir):
    from barloom.operators.clean import round_outputs as rounded

    df = plan.live_features(events_bars(spark, sf_dir)).select(*KEY, "Close", "RSI", "Daily_Returns")
    return rounded(df, {"Close": 4, "RSI": 6, "Daily_Returns": 2})


@query("confidence_band", with_ctes(
    {"s": "SELECT doc_id, ((doc_id * 37) % 101) / 100.0 AS p FROM labels"},
    "doc_id:i, confidence:f, band",
    """SELECT doc_id, greatest(p, 1.0 - p) * 100 AS confidence,
       CASE WHEN greatest(p, 1.0 - p) * 100 > 80 THEN 'High' WHEN greatest(p, 1.0 - p) * 100 > 60 THEN 'Medium' ELSE 'Low' END
       AS band FROM s""",
))
def confidence_band(spark, sf_dir):
    from barloom.sources.adapters import scored_labels

    percent = scalar.confidence("p") * 100
    return scored_labels(spark, sf_dir).select(
        "doc_id", percent.alias("confidence"), scalar.confidence_band(percent).alias("band")
    )


@query("high_volume", with_ctes(
    {"bars": LINEITEM_BARS},
    "Symbol, rows:i, high_rows:i",
    """SELECT "Symbol", count(*) AS rows, count(*) FILTER (WHERE "Volume" > 40) AS high_rows FROM bars
       GROUP BY 1 HAVING count(*) FILTER (WHERE "Volume" > 40) > 0""",
))
def high_volume(spark, sf_dir):
    from barloom.operators.clean import high_volume as busy
    from barloom.operators.reports import rows_per_symbol

    bars = lineitem_bars(spark, sf_dir)
    high = rows_per_symbol(busy(bars, 40.0)).withColumnRenamed("n", "high_rows")
    return rows_per_symbol(bars).withColumnRenamed("n", "rows").join(high, "Symbol").select("Symbol", "rows", "high_rows")
