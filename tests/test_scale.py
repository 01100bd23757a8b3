"""Operators whose cost must not follow one hot key, against plain answers."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import clean, datasets, evaluate, layout, ranking, symbols
from barloom.plans import cleaning, features
from barloom.sources import adapters
from barloom.sources.adapters import dirty_bars
from conftest import bars, ordered, series


def test_partial_names_against_all_pairs(spark):
    rng = random.Random(2)
    names = [("".join(rng.choice("ab c") for _ in range(rng.randint(1, 7))), i) for i in range(60)]
    asked = ["".join(rng.choice("ab cd") for _ in range(rng.randint(1, 9))) for _ in range(80)]
    frame = spark.createDataFrame([(f"S{i}", i, [n, f"x{i}"]) for n, i in names], "symbol string, position int, names array<string>")
    universe = spark.createDataFrame([(f"S{i}",) for _, i in names if i % 5], "symbol string")
    got = {r.text: r.resolved for r in symbols.resolve_symbols(spark.createDataFrame([(a,) for a in asked], "text string"), frame, universe).collect()}
    first = {}
    for n, i in names:
        for k, x in enumerate((n, f"x{i}")):
            x = x.strip().lower()
            first.setdefault(x, (i, k))
    known = sorted((place, x) for x, place in first.items() if place[0] % 5)
    for a in asked:
        q = a.strip().lower()
        exact = [p for p, x in known if x == q]
        partial = [p for p, x in known if q and (q in x or x in q)]
        want = f"S{(exact or partial)[0][0]}" if q and (exact or partial) else None
        assert got[a] == want, a


def test_long_names_and_inputs_have_no_array_of_substrings(spark):
    rng = random.Random(3)
    name, text = ("".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (10_000, 100_000))
    frame = spark.createDataFrame([("L", 0, ["q" + name + "q"]), ("M", 1, ["zebra house"])], "symbol string, position int, names array<string>")
    universe = spark.createDataFrame([("L",), ("M",)], "symbol string")
    asked = [name[4000:9000], text + "zebra house" + text[:50], text]
    got = {r.text: r.resolved for r in symbols.resolve_symbols(spark.createDataFrame([(a,) for a in asked], "text string"), frame, universe).collect()}
    assert [got[a] for a in asked] == ["L", "M", None]
    assert spark.range(1).select(F.lit("abca").alias("t")).select(F.size(symbols.fragments("t", 3)), F.size(symbols.fragments("t", 1)), F.size(symbols.fragments("t", 5))).first() == (2, 3, 0)


def test_numbered_names_meet_few_inputs(spark):
    """Numbered names share all short fragments; candidates must grow with the texts, not with their product."""
    frame = spark.range(1500).selectExpr("CONCAT('S', id) AS symbol", "id AS position", "ARRAY(CONCAT('Supplier#', LPAD(id, 9, '0'))) AS names")
    asked = spark.range(3000).selectExpr("CONCAT(IF(id % 2 = 0, 'buy Supplier#', 'plier#'), LPAD(id, 9, '0')) AS text")
    named = symbols._sized(symbols.name_map(frame), "name")
    pairs = symbols._candidates(symbols._sized(asked.selectExpr("LOWER(text) AS _q"), "_q"), named, symbols._lengths(named))
    assert 1500 <= pairs.count() <= 4 * 1500
    got = symbols.resolve_symbols(asked, frame, frame.select("symbol")).collect()
    assert {r.text: r.resolved for r in got} == {r.text: f"S{int(r.text[-9:])}" if int(r.text[-9:]) < 1500 else None for r in got}


@pytest.mark.parametrize("size", [2, 3, 6, 11, 12, 13, 24, 25, 30])
def test_partial_names_of_all_lengths(spark, size):
    rng = random.Random(size)
    text = "".join(rng.choice("abé😀 1") for _ in range(60))
    names = [f"x{text[k : k + size].strip()}y" for k in (0, 7, 20)] + ["other"]
    asked = [text[7 : 7 + size], "so " + names[2] + " it is"]
    frame = spark.createDataFrame([(f"S{i}", i, [n]) for i, n in enumerate(names)], "symbol string, position int, names array<string>")
    got = {r.text: r.resolved for r in symbols.resolve_symbols(spark.createDataFrame([(a,) for a in asked], "text string"), frame, frame.select("symbol")).collect()}
    for a in asked:
        q = a.strip().lower()
        partial = [f"S{i}" for i, n in enumerate(names) if q and (q in n or n in q)]
        assert got[a] == (partial[0] if partial else None)


def test_many_daily_bars_go_to_more_tasks(spark, sf_dir, monkeypatch):
    """Tasks follow the number of bars and of order lines, not the session's shuffle partitions; the rows stay the same."""
    def rows():
        return features.training_features(adapters.lineitem_bars(spark, sf_dir))

    want = ordered(rows())
    monkeypatch.setattr(layout.by_symbol, "__defaults__", (100,))
    monkeypatch.setattr(adapters, "LINES_A_TASK", 100)
    dealt = rows()
    tasks = -(-adapters.lineitem_bars(spark, sf_dir).count() // 100)
    assert tasks > 40 and dealt.rdd.getNumPartitions() == tasks
    assert ordered(dealt).equals(want)
    placed = layout.by_symbol(adapters.lineitem_bars(spark, sf_dir)).select("Symbol", F.spark_partition_id().alias("p")).distinct()
    assert placed.groupBy("Symbol").count().agg(F.max("count")).first()[0] == 1


@pytest.mark.parametrize("most", [2, 7, 40])
def test_sampled_windows_equal_the_sample_of_all(spark, most):
    pdf = pd.concat([series(n, [s], freq="9h") for s, n in (("A", 130), ("B", 6), ("C", 5), ("D", 45), ("E", 46))], ignore_index=True)
    df = bars(spark, pdf)
    want = datasets.even_sample(datasets.candle_windows(df, 5), most).toPandas().sort_values(["Symbol", "start_date"]).reset_index(drop=True)
    got = datasets.sampled_candle_windows(df, 5, most).toPandas().sort_values(["Symbol", "start_date"]).reset_index(drop=True)
    assert len(got) and got[want.columns].astype(str).equals(want.astype(str))


def test_windows_that_are_not_chosen_are_not_built(spark):
    df = datasets.sampled_candle_windows(bars(spark, series(20_000, ["A"], freq="h")), 5, 10)
    seen = []
    df._jdf.collectToPython()

    def walk(node):
        if node.nodeName() == "AdaptiveSparkPlan":
            return walk(node.finalPhysicalPlan())
        if "QueryStage" in node.nodeName():
            return walk(node.plan())
        if node.nodeName() == "Generate":
            seen.append(node.metrics().apply("numOutputRows").value())
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    plan = df._jdf.queryExecution().executedPlan()
    walk(plan)
    assert seen == [60]


def test_stage_counts_read_the_input_twice_at_most(spark, sf_dir):
    raw = dirty_bars(spark, sf_dir)
    counted = cleaning.stage_counts(raw, intraday=True)
    stages = cleaning.stages(raw, intraday=True)
    assert {r.stage: r.rows for r in counted.collect()} == {name: df.count() for name, df in stages.items()}
    scans = counted._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    one = raw._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    assert scans <= 2 * one
    daily = spark.createDataFrame([("A", "2020-01-01", "1", "1", "1", "1", "1", 0), ("A", "bad", "1", "1", "1", "1", "1", 1), ("A", "2020-01-01", "2", "2", "1", "1", "1", 2),
                                   ("A", "2020-01-02", None, "x", "1", "1", "1", 3), (None, "2020-01-02", None, "1", "1", "1", "1", 4)],
                                  "Symbol string, Date string, Open string, High string, Low string, Close string, Volume string, seq int")
    assert [tuple(r) for r in cleaning.stage_counts(daily, min_rows=2).collect()] == [
        (0, "raw", 5, 0), (1, "dated", 4, 1), (2, "unique", 3, 1), (3, "filled", 2, 1), (4, "sane", 2, 0), (5, "kept", 2, 0)]


def test_dates_in_several_formats(spark):
    df = spark.createDataFrame([(x,) for x in ("2020-01-31", "31.01.2020", "01/31/2020", "nothing", None)], "Date string")
    got = clean.coerce_date(df, fmt=[None, "dd.MM.yyyy", "MM/dd/yyyy"])
    assert [str(r.Date) for r in got.collect()] == ["2020-01-31"] * 3
    assert clean.coerce_date(df).count() == 1


def test_tiny_scores_spread_over_groups_and_stay_exact(spark):
    rng = np.random.default_rng(1)
    p = np.concatenate([rng.random(20_000) * 1e-9, [0.0, 0.5, 0.5, 1.0]])
    y = (rng.random(len(p)) < 0.3).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "p": p}))
    placed, group = ranking.grouped(df, "p")
    assert placed.groupBy(group.alias("g")).count().agg(F.max("count")).first()[0] < 200
    order = pd.Series(p).rank()
    up = y == 1
    want = (order[up].sum() - up.sum() * (up.sum() + 1) / 2) / (up.sum() * (~up).sum())
    assert evaluate.roc_auc(df).first().roc_auc == pytest.approx(want, abs=1e-12)
    q = ranking.quantiles(df, "p", {"a": 0.25, "b": 0.9}).first()
    assert (q.a, q.b) == pytest.approx(tuple(np.quantile(p, [0.25, 0.9])), rel=1e-12)
    same = spark.createDataFrame([(0, 0.5), (1, 0.5)], "y int, p double")
    assert evaluate.roc_auc(same).first().roc_auc == 0.5


def test_ranks_inside_a_hot_date(spark, monkeypatch):
    monkeypatch.setattr(ranking, "DATE_ROWS", 50)
    n = 3000
    pdf = pd.DataFrame({"Symbol": [f"S{i:05d}" for i in range(n)] + ["A", "B"], "Date": pd.to_datetime(["2020-01-02"] * n + ["2020-01-01", "2020-01-03"])})
    df = spark.createDataFrame(pdf)
    want = pdf.sort_values(["Date", "Symbol"]).reset_index(drop=True)
    got = ranking.global_rank(df).toPandas().sort_values("rank").reset_index(drop=True)
    assert got["rank"].tolist() == list(range(1, n + 3)) and got[["Symbol", "Date"]].equals(want[["Symbol", "Date"]])
    assert df.groupBy(ranking.symbol_range(df).alias("g")).count().agg(F.max("count")).first()[0] < 20
    split = ranking.time_split(df).groupBy("role").count().collect()
    assert {r.role: r["count"] for r in split} == {"train": int((n + 2) * 0.8), "test": n + 2 - int((n + 2) * 0.8)}
    folds = ranking.fold_parts(df).groupBy("part").count().collect()
    assert sorted(r["count"] for r in folds)[:5] == [500] * 5


def test_a_month_of_second_bars_makes_blocks_of_bounded_size(spark):
    n = 1_000_000
    at = F.timestamp_seconds(F.lit(1_577_836_800) + F.col("id"))
    one = F.lit(1.0)
    df = spark.range(n).select(F.lit("A").alias("Symbol"), at.alias("Date"), *[one.alias(c) for c in ("Open", "High", "Low", "Close", "Volume")])
    laid = layout.lay_out(df)
    assert layout.fitting_bucket(df) == "hour"
    sizes = [r["count"] for r in layout.settle(laid.withColumn("b", F.col(layout.BLOCK))).groupBy("b").count().collect()]
    assert sum(sizes) == n and max(sizes) <= 2 * layout.CORE and len(sizes) > 10
