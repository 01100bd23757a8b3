"""Lexical search against plain Python."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from barloom.llm import catalog, lexical
from tests.llm import odd

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return [re.sub("[A-Z]", lambda c: c[0].lower(), x) for x in TERM.findall(text or "")]


def plain(docs, items, k=20):
    """Every item's rows, all documents scored by the definition."""
    bags = [(i, Counter(t), len(t)) for i, t in ((i, plain_terms(text)) for i, text in docs)]
    big_n, big_l = sum(n > 0 for _, _, n in bags), sum(n for _, _, n in bags)
    df = Counter(x for _, bag, _ in bags for x in bag)
    out = []
    for item, text in items:
        asked = Counter(x for x in plain_terms(text) if df[x])
        w = {x: math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[x] + 1))) for x in asked}
        scores = []
        for doc, bag, n in bags:
            m = 100 - 25 + (25 * n * big_n) // big_l if big_l else 0
            score = sum(times * w[x] * ((1_000_000_000 * bag[x]) // (1000 * bag[x] + 12 * m)) for x, times in asked.items() if x in bag)
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=repr)


def read(df, key):
    return [(r[key], r.text) for r in df.collect()]


def test_terms_are_those_of_the_pattern():
    texts = ["A-b_c9 Éé.x", "", None, "日本 語!", "\x00a\x7fb", "ÀZ z"]
    hashes, first = lexical.terms(pa.array(texts))
    assert np.diff(first).tolist() == [len(plain_terms(t)) for t in texts]
    assert hashes[0] == lexical.terms(pa.array(["a"]))[0][0]


def test_lexical_search_in_small_buckets(spark, sf_dir, monkeypatch):
    docs, items = catalog.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = plain(read(docs, "doc_id"), read(items, "item_id"))
    assert want and rows(lexical.search(docs, items)) == want
    monkeypatch.setattr(lexical, "BUCKET", 7)
    # a pass for about every tenth item
    assert rows(lexical.search(docs, items, group=2000)) == want


def test_bounds_leave_out_vectors_and_nothing_else():
    """Buckets by falling length: the same answer with every vector scored, and fewer vectors scored."""
    rng = np.random.default_rng(5)
    made = lexical.Items(["a b c d", "c c c e", "f", "a f"])
    size, n = len(made.vocabulary), 3000
    held = rng.random((n, size)) < 0.3
    impact = np.where(held, (rng.pareto(1.2, (n, size)) * 1000).astype(np.int64) + 1, 0)
    length = np.sqrt((impact.astype(float) ** 2).sum(axis=1))
    order = np.argsort(-length)
    scored = []

    class Noted(lexical.Search):
        def _keep(self, item, score, ids):
            scored.append(len(ids))
            super()._keep(item, score, ids)

    search = Noted(made, np.ones(size, dtype=np.int64), np.ones(4, dtype=np.int64), 20)
    for at in range(0, n, 100):
        some = order[at : at + 100]
        row, place = np.nonzero(impact[some])
        search.bucket(some, length[some], row, place, impact[some][row, place])
    asked = np.zeros((4, size), dtype=np.int64)
    asked[made.row, made.place] = made.count
    for item in range(4):
        score = impact @ asked[item]
        best = sorted(zip((-score[score > 0]).tolist(), np.flatnonzero(score > 0).tolist()))[:20]
        assert list(zip((-search.scores[item]).tolist(), search.ids[item].tolist())) == best
    assert sum(scored) < n


def test_lexical_odd(spark):
    docs = odd.docs(spark)
    found = read(docs, "doc_id")
    asked = [(1, odd.prose(60, 2)), (1, odd.prose(60, 2)), (2, None), (3, ""), (4, "ONE one one"), (5, "nowhere-at-all"), (6, "é 語 x"), (None, odd.prose(50, 3)), (7, odd.prose(40_000, 1))]
    items = spark.createDataFrame([(i, t, "c", "c") for i, t in asked], "item_id long, text string, rank string, doc_id string")
    want = plain(found, asked)
    assert rows(lexical.search(docs, items)) == want and {r[0] for r in want} >= {1, 4, None, 7}
    assert lexical.search(odd.empty(spark), items).count() == 0 and lexical.search(docs, items.limit(0)).count() == 0
    many = spark.createDataFrame([(i % 40, "same words here") for i in range(300)], "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    asked = [(9, "words here"), (10, "one")]
    assert rows(lexical.search(many, spark.createDataFrame(asked, "item_id long, text string"), k=5)) == plain(read(many, "doc_id"), asked, 5)
    assert lexical.impacts(np.array([10**8]), np.array([10**8]), 10**10, 10**18)[0] == 10**17 // (10**11 + 12 * (75 + 25))
