"""Near duplicates, repeated strings, benchmark leaks and the pipeline against brute force."""

import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from barloom.llm import arrays, catalog, components, decontaminate, ngram_join, repeats
from tests.llm import odd


def plain_components(rows, n, percent):
    sets = []
    for _, t in rows:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), 1 << 60), rows[i][0])
    return Counter((rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows)))


def families(seed=7):
    rng = random.Random(seed)
    out = []
    for size, members in ((90, 150), (14, 40), (40, 3), (6, 7), (9, 60), (300, 5)):
        base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        for _ in range(members):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = f"w{rng.randrange(10**6)}"
            out.append(" ".join(w + [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 3))]))
    out += ["", None, "one", "one", "One two", "a b c d e"] * 2
    rng.shuffle(out)
    return [(i * 7 % 1009, t) for i, t in enumerate(out)]


def test_join_equals_all_pairs(spark):
    rows = families()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for n, percent in ((4, 85), (5, 80), (2, 60)):
        got = Counter(map(tuple, ngram_join.similar(docs, n, percent, side=16).collect()))
        assert got == plain_components(rows, n, percent)


def test_blocks_lose_no_pair():
    rng = random.Random(5)
    texts = []
    for _ in range(200):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([4, 7, 9, 12, 20, 40, 80, 200]))]
        for _ in range(5):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, len(w) // 25 + 1))):
                w[rng.randrange(len(w))] = f"w{rng.randrange(10**6)}"
            texts.append(" ".join(w + [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 1 + len(w) // 8))]))
    for n, percent in ((4, 85), (1, 70)):
        gram, first, sign = ngram_join.incidence(pa.array(texts), n)
        sets = [set(gram[a:b].tolist()) for a, b in zip(first[:-1], first[1:])]
        key, row = ngram_join.Blocks(percent, int(np.diff(first).max())).deal(gram, first)
        held = [set() for _ in texts]
        for k, r in zip(key.tolist(), row.tolist()):
            held[r].add(k)
        for i in range(len(texts)):
            for j in range(i):
                if sign[i] != sign[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                    assert held[i] & held[j]


def test_join_odd(spark):
    rows = [(i, t) for i, t in odd.texts() if i is not None]
    got = Counter(map(tuple, ngram_join.similar(odd.docs(spark).filter("doc_id IS NOT NULL"), 5, 80).collect()))
    assert got == plain_components(rows, 5, 80)
    docs = odd.docs(spark)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 0, 1, 2, 3, 4, 6, 8, 10, 11, 12]
    assert ngram_join.keep_one(odd.empty(spark)).count() == 0 and ngram_join.similar(odd.empty(spark)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 100), (200, 200)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100}


def test_join_plans_stay_small(spark, monkeypatch):
    """Every written step reads tables that are written: its plan holds no other step's."""
    plans = {}

    def noted(df, name, own=components.saved):
        plans[name] = max(plans.get(name, 0), df._jdf.queryExecution().executedPlan().toString().count("Exchange"))
        return own(df, name)

    for module in (components, ngram_join):
        monkeypatch.setattr(module, "saved", noted)
    base = [odd.prose(40, seed).split() for seed in range(6)]
    rows = [(i * 50 + k, " ".join(b[:k] + ["other"] + b[k + 1 :])) for i, b in enumerate(base) for k in range(12)]
    got = ngram_join.similar(spark.createDataFrame(rows, "doc_id long, text string"), n=2, percent=80, side=4)
    assert Counter(map(tuple, got.collect())) == plain_components(rows, 2, 80)
    assert {"stars", "tiles", "links"} <= set(plans) and max(plans.values()) <= 40, plans


def plain_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, dtype=bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        gone = gone[:-1]
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(r, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def check_repeats(spark, rows, length, prime):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(docs, length, prime).collect())
    assert got == Counter((i, *x) for (i, _), x in zip(rows, plain_repeats([t for _, t in rows], length)))


def test_repeats_equal_brute_force(spark):
    rng = random.Random(3)
    passages = [odd.prose(rng.randrange(5, 40), 100 + k) for k in range(12)]
    rows = [(i, " ".join(rng.choice(passages) if rng.random() < 0.5 else odd.prose(rng.randrange(1, 20), 1000 + 50 * i + k) for k in range(rng.randrange(1, 8)))) for i in range(120)]
    rows += [(500, "ab" * 300), (501, "x" * 150), (502, None), (503, ""), (504, rows[0][1]), (504, rows[0][1]), (None, rows[1][1]), (None, rows[2][1] + "é" * 40)]
    check_repeats(spark, rows, 60, 7)
    check_repeats(spark, rows, 60, 2)
    check_repeats(spark, rows, 100, 5)


def test_passages_around_400_bytes(spark):
    """A passage of 400 bytes or more that stands in two documents goes, one of 399 stays; so do those within one document."""
    rng = random.Random(9)

    def letters(n):
        return "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))

    rows, want = [], {}
    for k, size in enumerate((399, 400, 401, 1200)):
        passage = "<" + letters(size - 2) + ">"
        for side in (0, 1):
            rows.append((2 * k + side, letters(300 + k) + f"A{2 * k + side}" + passage + f"{2 * k + side}B" + letters(250)))
            want[2 * k + side] = size if size >= 400 else 0
    twice = "<" + letters(398) + ">"
    rows += [(20, "1" + twice + "2" + letters(40) + "3" + twice + "4"), (21, letters(2000))]
    want |= {20: 800, 21: 0}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = {r.doc_id: (r.n_removed, r.n_spans) for r in repeats.remove_repeats(docs).collect()}
    assert made == {k: (n, 2 if k == 20 else int(n > 0)) for k, n in want.items()}


def test_repeats_of_equal_short_names(spark):
    """Strings of one 32-bit name in different lanes: what met in a task is made known to the lane of each."""
    noise = np.random.default_rng(11).integers(ord("a"), ord("z") + 1, 500_000, dtype=np.uint8)
    at = np.arange(100, len(noise) - 200)
    full = arrays.span_hash(arrays.prefix_sums(noise), at, at + 54)
    lane = (full >> np.uint64(40)) % np.uint64(int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = np.argsort(full & np.uint64(0xFFFFFFFF), kind="stable")
    near = (np.diff(full[order] & np.uint64(0xFFFFFFFF)) == 0) & (np.diff(lane[order]) != 0)
    pairs = [(int(at[order[k]]), int(at[order[k + 1]])) for k in np.flatnonzero(near)]
    cover = repeats.difference_cover(2)
    shift = next(d for d in cover if (d + 1) % 7 in cover)  # the one sample that places 0 and 1 share

    def text(start, size):
        return noise[start : start + size].tobytes().decode()

    first, other = [], []
    for k, (x, y) in enumerate(pairs):
        first += [(3 * k, text(y - cover[0], 90)), (3 * k + 1, text(x - shift, 60) + odd.prose(20, 2 * k))]
        other.append((3 * k + 2, "A" + text(x - shift, 60) + odd.prose(20, 2 * k + 1)))
    rows = first + other
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).mapPartitionsWithIndex(lambda n, _: iter((first, other)[n])), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(docs, 60, 2).collect()}
    want = dict(zip((i for i, _ in rows), plain_repeats([t for _, t in rows], 60)))
    assert len(pairs) > 5 and all(want[3 * k + 2][1] >= 60 for k in range(len(pairs))) and got == want


def test_repeats_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in catalog.documents(spark, sf_dir).collect()}
    want = dict(zip(texts, plain_repeats(list(texts.values()), 400)))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in catalog.op5_repeats(spark, sf_dir).collect()} == want


def test_repeats_odd(spark):
    made = repeats.remove_repeats(odd.docs(spark), with_text=True)
    rows = made.collect()
    assert len(rows) == len(odd.texts()) and all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed for r in rows)
    assert repeats.remove_repeats(odd.empty(spark)).count() == 0
    assert all(len({(m - n) % (q * q + q + 1) for m in repeats.difference_cover(q) for n in repeats.difference_cover(q)}) == q * q + q + 1 for q in (2, 3, 5, 7, 13, 17))


def test_leaks(spark):
    items = [odd.prose(k, 300 + k) for k in (12, 20, 33, 58)] + ["", None]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    around = lambda k: odd.prose(80, 400 + k)
    words = items[2].split()
    changed = " ".join(w if k % 6 else "other" for k, w in enumerate(words))
    half = " ".join(words[:14])
    rows = [(k, f"{around(k)} {t} {around(50 + k)}") for k, t in enumerate(items[:4])]
    rows += [(10, f"{around(9)} {items[1].upper()}!!"), (11, f"{around(10)}\n{changed}. {around(11)}"), (12, f"{around(12)} {half} {around(13)}"),
             (13, "### ".join(items[3].split())), (14, around(14)), (15, None), (16, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, benchmark).collect()}
    assert found == {(0, 0), (1, 1), (2, 2), (3, 3), (10, 1), (11, 2), (13, 3)}
    in_groups = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, benchmark, group=2).collect()}
    assert in_groups == found
    assert sorted(r.doc_id for r in decontaminate.drop_leaks(docs, benchmark).collect()) == [12, 14, 15, 16]


def test_reworded_items_are_found(spark):
    """Items with words dropped, put in and replaced, as far as the rule on the common subsequence lets them be leaks."""
    sf = "/root/testdata/sf0.01"
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rng = random.Random(12)
    rows, want = [], set()
    for item, text in items:
        words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
        for drop, put, swap in ((0.1, 0, 0), (0.2, 0.1, 0), (0.3, 0, 0), (0, 0.3, 0), (0, 0, 0.2), (0.1, 0.2, 0.1)):
            made = []
            for w in words:
                if rng.random() < drop:
                    continue
                made.append(f"swap{rng.randrange(99)}" if rng.random() < swap else w)
                if rng.random() < put:
                    made.append(f"put{rng.randrange(99)}")
            held, tail = plain_lcs(words, made), plain_lcs(words[-6:], made)
            doc = len(rows)
            rows.append((doc, " ".join([odd.prose(60, doc), *made, odd.prose(60, doc + 5000)])))
            if held >= 0.75 * len(words) or tail >= 0.8 * min(6, len(words)) and held >= 0.6 * len(words):
                want.add((doc, item))
    rows += [(r.doc_id + 10_000, r.text) for r in catalog.documents(spark, "/root/testdata/sf0.001").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert len(want) > 150 and len(want & found) >= 0.99 * len(want)
    assert {x for x in found if x[0] < 10_000} <= want


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_lcs():
    rng = random.Random(2)
    for _ in range(300):
        item, text = [rng.randrange(6) for _ in range(rng.randrange(1, 12))], [rng.randrange(6) for _ in range(rng.randrange(0, 30))]
        masks = {}
        for k, w in enumerate(item):
            masks[w] = masks.get(w, 0) | 1 << k
        assert len(item) - decontaminate.lcs(masks, len(item), text).bit_count() == plain_lcs(item, text)


def test_leak_query_finds_all_whole_items(spark):
    sf = "/root/testdata/sf0.01"
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    texts = {r.doc_id: r.text for r in catalog.documents(spark, sf).collect()}
    got = {(r.doc_id, r.item_id) for r in catalog.op4_decontaminate(spark, sf).collect()}
    assert {(d, i) for d, t in texts.items() for i, x in items.items() if x in t} <= got
    plain = {d: "".join(c if c.isalnum() else " " for c in t.lower()).split() for d, t in texts.items()}
    for d, i in got:
        item = "".join(c if c.isalnum() else " " for c in items[i].lower()).split()
        assert plain_lcs(item, plain[d]) >= 0.6 * len(item)


def test_leaks_odd(spark):
    docs, benchmark = odd.docs(spark), spark.createDataFrame([(1, odd.prose(30, 77))], "item_id long, text string")
    nothing = spark.createDataFrame([], benchmark.schema)
    assert decontaminate.drop_leaks(docs, benchmark).columns == docs.columns and decontaminate.drop_leaks(docs, benchmark).count() == len(odd.texts())
    assert decontaminate.drop_leaks(docs, nothing).count() == len(odd.texts()) and decontaminate.leaks(docs, nothing).count() == 0
    assert decontaminate.leaks(odd.empty(spark), benchmark).count() == 0


def test_pipeline(spark):
    sf = "/root/testdata/sf0.01"
    docs = catalog.documents(spark, sf)
    columns = docs.columns
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = components.saved(stage(spark, docs, sf), "stage")
        assert docs.columns == columns
        kept.append({r.doc_id: r.text for r in docs.collect()})
    rows = sorted(kept[0].items())
    assert Counter(kept[1].keys()) == Counter(c for d, _, c in plain_components(rows, 5, 80) if d == c)
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert not any(x in t for t in kept[2].values() for x in items) and kept[2].keys() <= kept[1].keys()
    assert kept[3].keys() == kept[2].keys()
    final = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in final} == set(kept[3]) and all(len(r.ids) == 4 * r.length for r in final)


def test_pipeline_stages_take_odd_rows(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.docs(spark), "/root/testdata/sf0.001").count() >= 0
        assert stage(spark, odd.empty(spark), "/root/testdata/sf0.001").count() == 0


@pytest.mark.parametrize("percent", [80, 85])
def test_blocks_without_common_columns_lose_no_pair(percent):
    """Rows of common columns, mostly or all: every pair that reaches the similarity shares a block, whatever is called common."""
    rng = np.random.default_rng(percent)
    usual = np.sort(rng.integers(0, 1 << 63, 60).astype(np.uint64))
    rows = []
    for _ in range(60):
        size = int(rng.integers(1, 90))
        base = np.unique(np.concatenate([rng.choice(usual, rng.integers(0, min(size, 60) + 1), replace=False), rng.integers(0, 1 << 63, size).astype(np.uint64)]))[:size]
        for _ in range(4):
            kept = base[rng.random(len(base)) > 0.08]
            more = rng.integers(0, 1 << 63, rng.integers(0, 1 + len(base) // 12)).astype(np.uint64)
            rows.append(np.unique(np.concatenate([kept, more])) if len(kept) else base)
    rows += [usual[:50], usual[:55], usual[3:50]]
    gram, first = np.concatenate(rows), np.append(0, np.cumsum([len(r) for r in rows]))
    plan = ngram_join.Blocks(percent, max(map(len, rows)))
    near = {(i, j) for i in range(len(rows)) for j in range(i) if 100 * (o := len(np.intersect1d(rows[i], rows[j]))) >= percent * (len(rows[i]) + len(rows[j]) - o)}
    assert len(near) > 60
    for common in (usual, usual[::2], np.unique(gram), None):
        key, row = plan.deal(gram, first, common)
        met: dict[int, list[int]] = {}
        for k, r in zip(key.tolist(), row.tolist()):
            met.setdefault(k, []).append(r)
        shared = {(max(a, b), min(a, b)) for members in met.values() for a in members for b in members if a != b}
        assert near <= shared


def test_common_columns_are_found(spark):
    line = odd.prose(12, 5)
    docs = spark.createDataFrame([(i, odd.prose(20, 100 + i) + " " + line) for i in range(120)], "doc_id long, text string")
    written = docs.mapInArrow(lambda batches: ngram_join._signed(batches, 5), "doc_id long, n long, row long, gram long, held long")
    assert set(ngram_join.incidence(pa.array([line]), 5)[0].tolist()) <= set(ngram_join._common(written.filter("gram IS NOT NULL"), 120).tolist())
    assert {r.component_id for r in ngram_join.similar(docs).collect()} == set(range(120))


def test_join_takes_little_memory():
    """Of a task: a tile of the product, counting and tables of powers for a piece of text; results are as before."""
    rng = np.random.default_rng(3)
    rows = 1500
    usual = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate([usual[rng.random(400) > 0.02], rng.integers(0, 1 << 62, 4).astype(np.uint64)])) for _ in range(rows)]
    sets[700], sets[701] = (np.arange(k, k + 300, dtype=np.uint64) for k in (5, 10))
    text = pa.array([" ".join(f"w{x}" for x in rng.integers(0, 1 << 40, 120)) for _ in range(4000)])
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(4000)), text], names=["doc_id", "text"])
    arrays.give_back()
    tracemalloc.start()
    try:
        label = ngram_join.connected(sets, 80)
        tile = tracemalloc.get_traced_memory()[1]
        tracemalloc.reset_peak()
        made = list(ngram_join._signed(iter([batch]), 5))
        counted = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert label.tolist() == [700 if k in (700, 701) else 0 for k in range(rows)]
    assert sum(b.num_rows for b in made) == 4000
    # mostly the sets themselves and four bytes for every pair of rows
    assert tile < 24 * rows * rows, tile
    assert counted < 40e6, counted


def test_memory_goes_back(spark, monkeypatch):
    """Functions of a group give free memory back, and a stage begins with a collection on the executors."""
    given = []
    monkeypatch.setattr(ngram_join, "give_back", lambda: given.append(1))
    assert ngram_join._frugal(lambda t: t.num_rows)(pa.table({"a": [1, 2]})) == 2 and given == [1]
    collections = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    before = sum(b.getCollectionCount() for b in collections())
    components.sweep(spark)
    assert sum(b.getCollectionCount() for b in collections()) > before
