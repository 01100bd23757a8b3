"""Layout, exponential averages and indicators against pandas."""

import numpy as np
import pandas as pd
import pytest

from barloom.operators import datasets, indicators as ind
from barloom.operators.ewm import Ewm, with_ewm
from barloom.operators.layout import BLOCK, NeedsRows, lay_out, settle, with_positions
from barloom.plans import features
from conftest import bars, ordered, series


def in_pandas(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values("Date").copy()
    close = part["Close"]
    part["EMA12"] = close.ewm(span=12, min_periods=12, adjust=False).mean()
    move = close.diff()
    gain = move.clip(lower=0).ewm(alpha=1 / 14, min_periods=14, adjust=False).mean()
    loss = (-move).clip(lower=0).ewm(alpha=1 / 14, min_periods=14, adjust=False).mean()
    part["RSI"] = 100 - 100 / (1 + gain / loss.replace(0, np.nan))
    part["MACD"] = part["EMA12"] - close.ewm(span=26, min_periods=26, adjust=False).mean()
    part["MACD_Signal"] = part["MACD"].ewm(span=9, min_periods=9, adjust=False).mean()
    part["MA20"] = close.rolling(20).mean()
    part["BB_Width"] = 4 * close.rolling(20).std() / part["MA20"] * 100
    part["Lag_3"] = close.shift(3)
    part["Future_Return_Pct"] = (close.shift(-1) - close) / close * 100
    return part


CHECKED = ["EMA12", "RSI", "MACD", "MACD_Signal", "MA20", "BB_Width", "Lag_3", "Future_Return_Pct"]


def same(got, want, cols, tolerance=1e-8):
    assert len(got) == len(want)
    for c in cols:
        assert (got[c].isna() == want[c].isna()).all(), c
        assert np.nanmax(np.abs(got[c] - want[c])) < tolerance, c


@pytest.mark.parametrize("options", [{}, {"core": 300, "bucket": "day"}, {"core": 1, "bucket": "week"}])
def test_blocks_do_not_show(spark, options):
    """One symbol holds most rows; blocks of any size give what the whole series gives."""
    pdf = pd.concat([series(3000, ["HOT"]), series(40, ["A", "B"], seed=7)])
    got = ordered(features.strict_features(bars(spark, pdf), **options))
    want = pd.concat([in_pandas(p) for _, p in pdf.groupby("Symbol")]).sort_values(["Symbol", "Date"]).reset_index(drop=True)
    same(got, want, CHECKED)


def test_blocks_are_bounded(spark):
    pdf = series(5000, ["HOT"])
    spread = lay_out(bars(spark, pdf), before=100, core=500, bucket="day")
    sizes = spread.groupBy("Symbol", BLOCK).count().toPandas()["count"]
    assert len(sizes) >= 9 and sizes.max() < 500 + 100 + 3 * 24
    assert settle(spread).count() == 5000


def test_gaps_in_time(spark):
    """Sparse and dense stretches: the halo counts rows, not time."""
    pdf = series(600)
    pdf["Date"] = pd.Timestamp("2020-01-01") + pd.to_timedelta(np.cumsum(1 + (np.arange(600) % 50 == 0) * 900), unit="h")
    got = ordered(features.strict_features(bars(spark, pdf), core=50, bucket="day"))
    same(got, in_pandas(pdf).reset_index(drop=True), CHECKED)


def test_daily_bars_need_one_exchange(spark):
    pdf = series(100, ["A", "B"], freq="D")
    df = features.strict_features(bars(spark, pdf, daily=True))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    got = ordered(df)
    want = pd.concat([in_pandas(p) for _, p in pdf.groupby("Symbol")]).reset_index(drop=True)
    same(got, want, CHECKED)


def test_row_order_and_other_symbols_do_not_matter(spark):
    pdf = series(120, ["A", "B"])
    one = ordered(features.strict_features(bars(spark, pdf)))
    two = ordered(features.strict_features(bars(spark, pdf.sample(frac=1, random_state=3))))
    alone = ordered(features.strict_features(bars(spark, pdf[pdf.Symbol == "A"])))
    pd.testing.assert_frame_equal(one, two)
    pd.testing.assert_frame_equal(one[one.Symbol == "A"].reset_index(drop=True), alone)


@pytest.mark.parametrize("alpha", [0.9, 0.5, 1 / 14, 0.01, 0.002])
def test_ewm_of_long_series(spark, alpha):
    pdf = series(4000, freq="D")
    got = ordered(with_ewm(bars(spark, pdf, daily=True), {"y": Ewm("Close", alpha, 3)}))
    want = pdf["Close"].ewm(alpha=alpha, min_periods=3, adjust=False).mean()
    assert (got["y"].isna() == want.isna()).all()
    assert np.nanmax(np.abs(got["y"] - want)) < 1e-9


def test_ewm_mixes_fast_and_slow(spark):
    pdf = series(2500, freq="D")
    got = ordered(with_ewm(bars(spark, pdf, daily=True), {"a": Ewm("Close", 0.9), "b": Ewm("Close", 0.003)}))
    for name, alpha in (("a", 0.9), ("b", 0.003)):
        assert np.abs(got[name] - pdf["Close"].ewm(alpha=alpha, adjust=False).mean()).max() < 1e-9


def test_warm_up_lengths(spark):
    got = ordered(features.strict_features(bars(spark, series(60))))
    first = {c: int(got[c].first_valid_index()) + 1 for c in ("MA5", "MA20", "RSI", "EMA12", "MACD", "MACD_Signal", "Rolling_Std_Returns")}
    assert first == {"MA5": 5, "MA20": 20, "RSI": 15, "EMA12": 12, "MACD": 26, "MACD_Signal": 34, "Rolling_Std_Returns": 11}
    assert got["RSI"].dropna().between(0, 100).all()


def test_rsi_without_losses(spark):
    pdf = series(40)
    pdf["Close"] = np.arange(40) + 10.0
    df = lay_out(bars(spark, pdf))
    assert ordered(settle(ind.rsi_wilder(df)))["RSI"].isna().all()
    simple = ordered(settle(ind.rsi_simple(df)))["RSI"]
    assert simple.iloc[-1] == pytest.approx(100 - 100 / (1 + 1 / 0.0001))
    assert simple.iloc[0] == 0.0


def test_partial_frames(spark):
    df = ordered(features.batch_features(bars(spark, series(30))))
    assert df["MA5_Spark"].iloc[0] == df["Close"].iloc[0]
    assert pd.isna(df["Rolling_Std_20_Spark"].iloc[0]) and pd.isna(df["Close_Lag1_Spark"].iloc[0])


def test_zero_divisors_give_null(spark):
    pdf = series(40)
    pdf.loc[5, "Close"] = 0.0
    pdf["Volume"] = 0.0
    df = ordered(features.strict_features(bars(spark, pdf)))
    assert pd.isna(df["Daily_Returns"].iloc[6]) and df["Avg_Volume_Trend"].isna().all()


def test_target_bands(spark):
    pdf = series(4)
    pdf["Close"] = [100.0, 101.0, 102.5, 100.0]
    df = ind.target(ind.future_return(lay_out(bars(spark, pdf))))
    assert ordered(settle(df))["Target"].tolist()[1:3] == [1.0, 0.0]
    assert pd.isna(ordered(settle(df))["Target"].iloc[0])  # exactly 1 % is noise


def test_positions(spark):
    pdf = series(2000, ["A", "B"])
    got = ordered(with_positions(bars(spark, pdf), bucket="day"))
    assert (got["pos"] == got.groupby("Symbol").cumcount() + 1).all() and (got["total"] == 2000).all()


def test_sequences_and_candles_across_blocks(spark):
    pdf = series(400)
    pdf["Target"] = 1
    df = spark.createDataFrame(pdf)
    cols = ["Close", "Volume"]
    got = ordered(datasets.sequences(df, 60, cols, core=50, bucket="day"))
    assert len(got) == 340
    assert np.allclose(np.array([list(v) for v in got["sequence"].iloc[100]]), pdf[cols].to_numpy()[100:160])
    candles = datasets.candle_windows(bars(spark, pdf.drop(columns="Target")), core=50, bucket="day")
    c = candles.toPandas().sort_values("start_date").reset_index(drop=True)
    assert len(c) == 370
    rises = pdf["Close"].to_numpy()[30:] > pdf["Close"].to_numpy()[29:-1]
    assert (c["label"] == np.where(rises, "bullish", "bearish")).all()


@pytest.mark.parametrize("total, most", [(1000, 500), (7, 3), (37, 20), (5, 5)])
def test_even_sample(spark, total, most):
    pdf = pd.DataFrame({"Symbol": "A", "start_date": pd.date_range("2020-01-01", periods=total, freq="h"), "i": range(total)})
    got = sorted(datasets.even_sample(spark.createDataFrame(pdf), most).toPandas()["i"])
    want = np.linspace(0, total - 1, most, dtype=int) if total > most else np.arange(total)
    assert got == sorted(set(want.tolist()))


def test_unknown_step_is_named(spark):
    with pytest.raises(RuntimeError, match="broken"):
        features.apply_indicators(bars(spark, series(5)), [("broken", lambda df: df.select("nope"))])


def test_long_averages_over_blocks(spark):
    df = bars(spark, series(6000))
    steps = [("ema", lambda d: ind.ema(d, 200)), ("rsi", lambda d: ind.rsi_wilder(d, 100))]
    whole = features.apply_indicators(df, steps, core=100_000).select("Symbol", "Date", "EMA200", "RSI")
    small = features.apply_indicators(df, steps, core=300, bucket="day").select("Symbol", "Date", "EMA200", "RSI")
    pd.testing.assert_frame_equal(ordered(small), ordered(whole), rtol=1e-9, atol=1e-9)
    with pytest.raises(NeedsRows):
        ind.ema(lay_out(df, before=1000), 200)
