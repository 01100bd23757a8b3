"""Cleaning, ranking, metrics, symbols and sources on small hand-made tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Observation
from pyspark.sql import functions as F

from barloom.operators import clean, datasets, evaluate, ml, ranking, reports, symbols
from barloom.plans import cleaning
from barloom.schema import FEATURES, require_columns, require_order
from barloom.sources import readers
from barloom.sources.adapters import dirty_bars
from conftest import bars, ordered, series


def test_dedup_ignores_row_order(spark):
    rows = [("A", 1, 1.0, s) for s in (3, 9, 5)] + [("A", 1, 2.0, 9)] + [("B", 1, None, 1)]
    for part in (rows, rows[::-1]):
        df = spark.createDataFrame(part, "Symbol string, Date int, Close double, seq long").repartition(4)
        got = {(r.Symbol, r.Close, r.seq) for r in clean.dedup_keep_last(df).collect()}
        assert got == {("A", 2.0, 9), ("B", None, 1)}


def test_dedup_combines_before_the_shuffle(spark):
    df = spark.createDataFrame([("A", 1, 1.0, 1)], "Symbol string, Date int, Close double, seq long")
    plan = clean.dedup_keep_last(df)._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan and plan.count("Exchange") == 1 and "Window" not in plan


@pytest.mark.parametrize("daily", [True, False])
def test_forward_fill(spark, daily):
    pdf = series(300, ["A", "B"], freq="D")
    rng = np.random.default_rng(5)
    holes = pdf.copy()
    for c in ("Open", "Close"):
        holes.loc[rng.random(len(pdf)) < 0.6, c] = np.nan
    holes.loc[holes.Symbol == "A", "Volume"] = np.where(np.arange(300) < 70, np.nan, 1.0)
    df = spark.createDataFrame(holes, "Symbol string, Date timestamp, Open double, High double, Low double, Close double, Volume double")
    if daily:
        df = df.withColumn("Date", F.to_date("Date"))
    got = ordered(clean.forward_fill(df))
    cols = ["Open", "High", "Low", "Close", "Volume"]
    want = holes.copy()
    want[cols] = want.groupby("Symbol")[cols].ffill()
    want = want.dropna().reset_index(drop=True)
    assert np.allclose(got[cols].to_numpy(), want[cols].to_numpy())


def test_observed_counts_match_the_report(spark, sf_dir):
    raw = dirty_bars(spark, sf_dir)
    counts = {s: Observation(s) for s in ("raw", "dated", "unique", "filled", "sane", "kept")}
    cleaning.clean(raw, intraday=True, counts=counts).write.format("noop").mode("overwrite").save()
    report = {r["stage"]: r["rows"] for r in cleaning.stage_counts(raw, intraday=True).collect()}
    for stage in ("raw", "dated", "kept"):
        assert counts[stage].get["rows"] == report[stage]


def test_coercion_is_observed(spark):
    df = spark.createDataFrame([("1", "x"), ("y", None), ("3", "4")], "a string, b string")
    seen = Observation("lost")
    clean.coerce_numeric(df, ["a", "b"], seen).collect()
    assert seen.get == {"a": 1, "b": 1}


def test_binary_target_fails_the_job(spark):
    df = spark.createDataFrame([(0,), (2,)], "Target int")
    with pytest.raises(PySparkException):
        clean.require_binary_target(df).collect()


def test_guards(spark):
    with pytest.raises(ValueError, match="Close"):
        require_columns(spark.range(1), ["id", "Close"])
    with pytest.raises(ValueError):
        require_order(FEATURES[::-1])


def keyed(spark, n_dates, n_symbols):
    dates = pd.date_range("2020-01-01", periods=n_dates, freq="D").date
    pdf = pd.DataFrame([(f"S{j:03d}", d) for d in dates for j in range(n_symbols) if (d.toordinal() + j) % 3])
    return pdf.rename(columns={0: "Symbol", 1: "Date"}), spark.createDataFrame(pdf, "Symbol string, Date date")


@pytest.mark.parametrize("n_dates, n_symbols", [(100, 7), (1, 50), (2, 1)])
def test_split_and_folds(spark, n_dates, n_symbols):
    pdf, df = keyed(spark, n_dates, n_symbols)
    pdf = pdf.sort_values(["Date", "Symbol"]).reset_index(drop=True)
    n = len(pdf)
    got = ordered(ranking.time_split(df), ["Date", "Symbol"])
    cut = max(1, min(int(n * 0.8), n - 1))
    assert (got["role"] == ["train"] * cut + ["test"] * (n - cut)).all()
    if n < 6:
        return
    folds = ranking.time_series_folds(df).toPandas()
    size = n // 6
    for i in range(1, 6):
        part = folds[folds.fold == i].sort_values(["Date", "Symbol"])
        start = n - (6 - i) * size
        assert part["role"].tolist() == ["train"] * start + ["test"] * size


def test_quantiles_and_auc_by_brute_force(spark):
    rng = np.random.default_rng(2)
    p = np.round(rng.random(700), 2)
    p[:250] = 0.5  # one score holds a third of all rows
    y = (rng.random(700) < p).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "p": p}))
    up, down = p[y == 1], p[y == 0]
    want = ((up[:, None] > down).sum() + (up[:, None] == down).sum() / 2) / (len(up) * len(down))
    assert evaluate.roc_auc(df).first()[0] == pytest.approx(want)
    stats = evaluate.confidence_stats(df).first()
    conf = np.maximum(p, 1 - p)
    assert stats["median"] == pytest.approx(np.median(conf)) and stats["p90"] == pytest.approx(np.percentile(conf, 90))
    assert stats["mean"] == pytest.approx(conf.mean())


def test_metrics_without_positives(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y int, yhat int")
    assert tuple(evaluate.classification_metrics(df).first()) == (1.0, 0.0, 0.0, 0.0)


def test_backtest_needs_enough_rows(spark):
    pdf = series(75, ["LONG"])
    short = series(60, ["SHORT"])
    df = spark.createDataFrame(pd.concat([pdf, short]).assign(p=0.7))
    got = evaluate.signal_backtest(df).toPandas()
    assert set(got["Symbol"]) == {"LONG"} and len(got) == 15
    rises = (pdf["Close"].diff() > 0).tail(15)
    assert got.sort_values("Date")["correct"].tolist() == rises.tolist()


def test_correlation_of_a_constant_is_null(spark):
    pdf = series(60)[["Symbol", "Date", "Close", "Volume"]]
    pdf["Flat"] = 1.0
    got = reports.correlation_matrix(spark.createDataFrame(pdf), ["Close", "Volume", "Flat"]).toPandas()
    cell = got.set_index(["column_a", "column_b"])["correlation"]
    assert cell[("Close", "Volume")] == pytest.approx(pdf.tail(50)["Close"].corr(pdf.tail(50)["Volume"]))
    assert pd.isna(cell[("Flat", "Close")]) and cell[("Close", "Close")] == pytest.approx(1.0) and len(got) == 9


def test_names_shared_and_partial(spark):
    rows = [("AAA", 1, ["Orchard", "Orchard Inc"]), ("GGL", 2, ["Lettera", "Letters One"]), ("GGG", 3, ["Lettera"]), ("MMM", 4, ["Facetree", "Metatree"]),
            ("F", 5, ["Fjord Motor"]), ("TXN", 6, ["Texin"]), ("T", 7, ["Telco"]), ("TSL", 8, ["Teslite"])]
    names = spark.createDataFrame(rows, "symbol string, position int, names array<string>")
    universe = spark.createDataFrame([(s,) for s in ("AAA", "GGL", "GGG", "MMM", "F", "TXN", "T")], "symbol string")
    asked = {
        "aaa": "AAA", " Orchard ": "AAA", "LETTERA": "GGL", "facetree": "MMM", "buy fjord motor now": "F",
        "letter": "GGL", "Teslite": None, "": None, "xyzzy": None, "T": "T",
    }
    df = spark.createDataFrame([(k,) for k in asked], "text string")
    # the first name in order that contains or is contained
    assert {r.text: r.resolved for r in symbols.resolve_symbols(df, names, universe).collect()} == asked
    assert [r.symbol for r in symbols.search_symbols(names, universe, "gg").collect()] == ["GGG", "GGL"]
    assert symbols.search_symbols(names, universe, "  ").count() == 0


def test_symbol_dir(spark, tmp_path):
    head = "Date,Open,High,Low,Close,Volume\n"
    (tmp_path / "AAA.csv").write_text(head + "2020-01-01,1,2,0.5,1.5,10\n2020-01-02,1,2,0.5,1.6,11\n")
    (tmp_path / "BBB.csv").write_text("Volume,Close,Date,Open,High,Low,Adj Close,Note\n7,3,2020-01-01,1,4,1,2.9,\"a,b\"\n")
    (tmp_path / "CCC.csv").write_text("Date,Open\n2020-01-01,1\n")
    (tmp_path / "DDD.csv").write_text("")
    (tmp_path / "EEE.csv").write_text(head)
    got = ordered(readers.read_symbol_dir(spark, str(tmp_path)))
    assert got["Symbol"].tolist() == ["AAA", "AAA", "BBB"]
    assert got["Close"].tolist() == ["1.5", "1.6", "3"] and got["Adj Close"].tolist()[2] == "2.9"
    assert readers.read_symbol_dir(spark, str(tmp_path), ["BBB", "NOPE"]).count() == 1
    assert readers.read_symbol_dir(spark, str(tmp_path), limit=1).count() == 2
    contract = {r.file: (r.missing, r.ok, r.reordered) for r in readers.column_contract(spark, str(tmp_path)).collect()}
    assert contract["CCC.csv"] == (["Close", "High", "Low", "Volume"], False, False)
    assert contract["BBB.csv"] == ([], True, True) and contract["AAA.csv"] == ([], True, False)
    assert "DDD.csv" not in contract


def test_symbol_dir_wide_quoted_and_ordered(spark, tmp_path):
    extra = [f"X{i}" for i in range(34)]
    (tmp_path / "a").mkdir()
    wide = ",".join([*extra, '"Note, long"', "Date", "Open", "High", "Low", "Close", "Volume"])
    values = ",".join(["0"] * 34)
    (tmp_path / "a" / "W W.csv").write_text(f'{wide}\n{values},"a, ""b""",2020-01-01,1,4,0.5,3,7\n')
    head = "Date,Open,High,Low,Close,Volume"
    (tmp_path / "a" / "R.csv").write_text(f"{head}\n2020-01-01,9,9,9,9,9\n{head}\n2020-01-01,1,2,0.5,1.5,100\n")
    rows = readers.read_symbol_dir(spark, str(tmp_path / "a")).orderBy("Symbol", "seq").collect()
    assert [(r.Symbol, r.High, r.Close, r.Volume) for r in rows] == [("R", "9", "9", "9"), ("R", "High", "Close", "Volume"), ("R", "2", "1.5", "100"), ("W W", "4", "3", "7")]
    kept = cleaning.clean(readers.read_symbol_dir(spark, str(tmp_path / "a")), min_rows=1).filter("Symbol = 'R'").collect()
    assert [r.Close for r in kept] == [1.5]


def test_scratch_folder_is_shared(spark):
    from types import SimpleNamespace

    from barloom.sources.writers import scratch_dir

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(master="yarn"))
    with pytest.raises(RuntimeError):
        scratch_dir(cluster)


def test_last_n_beyond_the_limit_per_task(spark):
    from pyspark.sql import functions as F

    df = spark.range(6000).select(F.lit("A").alias("Symbol"), (F.lit("2020-01-01").cast("timestamp") + F.make_dt_interval(secs=F.col("id"))).alias("Date"), F.col("id").alias("Close"))
    got = datasets.last_n(df, 1001)
    assert sorted(r.Close for r in got.collect()) == list(range(4999, 6000))
    # rows before the hour that can hold the last ones are dropped before the sort
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "_since" in plan


def test_fuse_suffix_and_minmax(spark):
    left = spark.createDataFrame([("A", 1, 5.0)], "Symbol string, Date int, Close double")
    right = spark.createDataFrame([("A", 1, 6.0), ("B", 1, 7.0)], "Symbol string, Date int, Close double")
    assert datasets.fuse(left, right).columns == ["Symbol", "Date", "Close", "Close_cnn"]
    assert tuple(datasets.join_coverage(left, right).first()) == (1, 100.0, 50.0)
    flat = datasets.minmax_transform(left, datasets.minmax_fit(left, ["Close"]), ["Close"])
    assert flat.first()["Close"] == 0.0


def test_forest_learns_a_planted_signal(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 2))
    pdf = pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "Target": (x[:, 0] > 0).astype(int)})
    df = spark.createDataFrame(pdf)
    model = ml.train_forest(df, ["a", "b"], numTrees=5, maxDepth=3)
    rows = ml.score(df, model).select(F.col("Target").alias("y"), F.col("p_up").alias("p"))
    assert evaluate.roc_auc(rows).first()[0] > 0.9
    assert ml.feature_importance(model, ["a", "b"]).first()["feature"] == "a"


def test_pandas_escape_hatch(spark):
    from barloom.plans.features import apply_per_symbol

    df = bars(spark, series(50, ["A", "B"], freq="D"), daily=True).select("Symbol", "Date", "Close")

    def smooth(part):
        part["y"] = part["Close"].ewm(span=5, adjust=False).mean()
        return part[["Symbol", "Date", "y"]]

    assert apply_per_symbol(df, smooth, "Symbol string, Date date, y double").count() == 100
