"""Streaming jobs against the batch result."""

import datetime as dt
import os

import pandas as pd

from barloom.operators.layout import lay_out
from barloom.plans import features
from barloom.streaming import averages
from barloom.streaming import incremental as inc
from barloom.streaming.averages import RunningAverages
from barloom.streaming.store import VersionedStore
from conftest import BARS, bars, ordered, series

SCHEMA = BARS.format("timestamp")


def land(spark, pdf, path):
    bars(spark, pdf).write.mode("append").csv(path, header=True)


def text(schema):
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)


def test_late_bars_and_repeated_batches(spark, tmp_path):
    root = str(tmp_path)
    pdf = series(90, ["A", "B"])
    late = pdf[(pdf.Symbol == "A") & (pdf.Date == pdf.Date[20])]
    arrivals = [pdf[(pdf.Date < pdf.Date[50])].drop(late.index), pdf[pdf.Date >= pdf.Date[50]], late]
    job = inc.LiveFeatures(spark, f"{root}/store", features.strict_features)
    for part in arrivals:
        land(spark, part, f"{root}/landing")
        job.start(inc.new_bars(spark, f"{root}/landing", SCHEMA), f"{root}/checkpoint").awaitTermination()
    want_df = features.strict_features(bars(spark, pdf))
    want = ordered(want_df)
    pd.testing.assert_frame_equal(ordered(job.read(text(want_df.schema)))[want.columns], want, rtol=1e-9, atol=1e-9)
    # the last batch again, as after a lost executor
    job.step(bars(spark, late), 2)
    pd.testing.assert_frame_equal(ordered(job.read(text(want_df.schema)))[want.columns], want, rtol=1e-9, atol=1e-9)


AVERAGES = ["EMA12", "RSI", "MACD", "MACD_Signal"]


def averaged(spark, pdf, parts, root, **options):
    """The stream's averages after parts of the bars in turn, against those of all bars at once."""
    job = RunningAverages(spark, f"{root}/store", **options)
    for number, part in enumerate(parts):
        job.step(bars(spark, part), number)
    want = ordered(features.strict_features(bars(spark, pdf)))[["Symbol", "Date", "Close", *AVERAGES]]
    pd.testing.assert_frame_equal(ordered(job.read())[want.columns], want, rtol=1e-9, atol=1e-9)
    return job


def test_running_averages_equal_the_batch(spark, tmp_path):
    pdf = series(400, ["A", "B"], freq="8h")
    cut = sorted(pdf.Date.unique())
    # single rows, steps over the warm-up of every average, one symbol alone, and a month
    edges = [0, 1, 2, 13, 14, 27, 35, 200, 400]
    parts = [pdf[pdf.Date.isin(cut[a:b])] for a, b in zip(edges, edges[1:])]
    parts = parts[:-1] + [parts[-1][parts[-1].Symbol == "A"], parts[-1][parts[-1].Symbol == "B"]]
    job = averaged(spark, pdf, parts, str(tmp_path), every=3)
    # the last batch again, as after a lost executor
    job.step(bars(spark, parts[-1]), len(parts) - 1)
    assert job.read().count() == len(pdf)


def test_running_averages_with_late_and_corrected_bars(spark, tmp_path):
    pdf = series(300, ["A", "B"], freq="8h")
    late = pdf[(pdf.Symbol == "A") & pdf.Date.isin(sorted(pdf.Date.unique())[90:120])]
    first = pdf[(pdf.Symbol == "B") & (pdf.Date == pdf.Date[0])]
    wrong = pdf[(pdf.Symbol == "B") & (pdf.Date == pdf.Date[150])].assign(Close=1.0)
    rest = pdf.drop(late.index).drop(first.index)
    right = pdf.loc[wrong.index]
    parts = [rest[rest.Date < pdf.Date[200]].drop(wrong.index), pd.concat([wrong, rest[rest.Date >= pdf.Date[200]]]), late, first, right]
    averaged(spark, pdf, parts, str(tmp_path))


def test_running_averages_over_a_long_backlog(spark, tmp_path, monkeypatch):
    """One symbol's backlog is many blocks."""
    monkeypatch.setattr(averages, "lay_out", lambda df, **o: lay_out(df, **o, core=1500, bucket="day"))
    pdf = series(9000, ["A"], freq="5min")
    averaged(spark, pdf, [pdf[:40], pdf[40:]], str(tmp_path))


def folders(path):
    return sum(len(d) for _, d, _ in os.walk(path))


def test_live_features_write_only_symbols_with_bars(spark, tmp_path):
    root = str(tmp_path)
    pdf = series(60, list("ABCDEF"), freq="8h")
    dates = sorted(pdf.Date.unique())
    job = inc.LiveFeatures(spark, f"{root}/store", lambda df: df.select("Symbol", "Date", "Close"), shards=4, every=3)
    job.step(bars(spark, pdf[pdf.Date.isin(dates[:40])]), 0)
    sizes = []
    for number in range(1, 21):
        job.step(bars(spark, pdf[pdf.Date.isin(dates[39 + number : 40 + number]) & (pdf.Symbol == "A")]), number)
        sizes.append(folders(f"{root}/store"))
    for kind in ("bars", "features", "tail"):
        written = spark.read.parquet(f"{root}/store/{kind}/batches/batch=20")
        assert [r.Symbol for r in written.select("Symbol").distinct().collect()] == ["A"]
    # compaction keeps their number within a bound: the second half has no more than the first
    assert max(sizes[10:]) <= max(sizes[:10])
    seen = pdf[(pdf.Symbol == "A") | pdf.Date.isin(dates[:40])]
    want = ordered(bars(spark, seen).select("Symbol", "Date", "Close"))
    pd.testing.assert_frame_equal(ordered(job.read("Symbol string, Date timestamp, Close double")), want)


def test_store_expires_old_months_and_keeps_reruns_whole(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "s"), ["Symbol", "Date"], shards=2, every=2, months=1)
    schema = "Symbol string, Date date, x int"

    def put(batch, *rows):
        store.write(spark.createDataFrame([(s, dt.date.fromisoformat(d), x) for s, d, x in rows], schema), batch)

    put(0, ("A", "2020-01-05", 1), ("B", "2020-01-06", 2))
    put(1, ("A", "2020-01-05", 3), ("A", "2020-02-01", 4))
    put(2, ("A", "2020-03-01", 5))
    put(2, ("A", "2020-03-01", 6))
    assert sorted(tuple(r) for r in store.read(schema).select("Symbol", "x").collect()) == [("A", 3), ("A", 4), ("A", 6), ("B", 2)]
    put(3, ("B", "2020-03-02", 7))
    put(4, ("B", "2020-03-02", 8))
    got = sorted(tuple(r) for r in store.read(schema).select("Symbol", "x").collect())
    assert got == [("A", 4), ("A", 6), ("B", 8)]  # January is more than a month behind March
    asked = spark.createDataFrame([("B",)], "Symbol string")
    assert [r.x for r in store.read(schema, 4, asked).collect()] == [7]


def test_newest_file_first(spark, tmp_path):
    path = str(tmp_path / "landing")
    land(spark, series(5), path)
    stream = inc.new_bars(spark, path, SCHEMA, files_per_batch=1, newest_first=True)
    assert stream.isStreaming


def test_dedup_keeps_late_symbols(spark, tmp_path):
    root = str(tmp_path)
    pdf = series(3000, ["A", "B"])
    for part in (pdf[pdf.Symbol == "A"], pdf[pdf.Symbol == "B"], pdf[pdf.Date < pdf.Date[100]]):
        land(spark, part, f"{root}/landing")
        inc.dedup_stream(inc.new_bars(spark, f"{root}/landing", SCHEMA), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    got = spark.read.parquet(f"{root}/out")
    assert got.groupBy("Symbol").count().orderBy("Symbol").collect() == [("A", 3000), ("B", 3000)]
    assert got.select("Symbol", "Date").distinct().count() == 6000
