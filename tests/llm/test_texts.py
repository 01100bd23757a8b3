"""Quality rules, packing, ranking and sharding against plain Python."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from barloom.llm import catalog, packing, quality, ranking, shards
from tests.llm import odd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_quality(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), failed


def plain_repeats(text, n):
    """Share of the bytes of words that lie in copies after the first of n-grams."""
    words = WORD.findall(text or "")
    seen, inside = set(), set()
    for i in range(len(words) - n + 1):
        gram = tuple(words[i : i + n])
        if gram in seen:
            inside.update(range(i, i + n))
        seen.add(gram)
    return sum(len(words[i].encode()) for i in inside) / max(sum(len(w.encode()) for w in words), 1)


def test_quality_query(spark, sf_dir):
    got = {r.doc_id: r for r in catalog.op8_quality(spark, sf_dir).collect()}
    for d in catalog.documents(spark, sf_dir).collect():
        r = got[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_quality(d.text)
        assert r.repeat_6_share == pytest.approx(plain_repeats(d.text, 6)) and r.repeat_10_share == pytest.approx(plain_repeats(d.text, 10))
        assert not (r.kept and r.base_failed)


def test_quality_odd(spark):
    texts = [t for _, t in odd.texts()] + ["a\nb\na\n\n\n \n \r\na", "w " * 50, "b a b a b a b a b a b a c", odd.prose(200, 4) + "\n" + odd.prose(200, 4)]
    made = quality.measure(pa.array(texts))
    for i, t in enumerate(texts):
        assert tuple(made[k][i] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == plain_quality(t)
    docs = odd.docs(spark)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.exceptAll(docs).count() == 0
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 6, 7, 7, 8, 9, 13]
    assert quality.keep_good(odd.empty(spark)).count() == 0 and quality.quality_figures(odd.empty(spark)).count() == 0


def check_packing(rows, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(catalog.default_tokenizer())
    want = Counter((i, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4").tobytes()) for i, t in texts)
    assert len({r.sequence_id for r in rows}) == len(rows)
    by = {}
    for r in rows:
        assert r.length & (r.length - 1) == 0 and r.length <= 1024 and r.offset == 0 and zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by.setdefault((r.doc_id, r.doc_tokens), {}).setdefault(r.start, []).append(bytes(r.ids))
    got = Counter()
    for (doc, _), starts in by.items():
        ids = [starts[s] for s in sorted(starts)]
        copies = {len(x) for x in ids}
        assert len(copies) == 1 and all(len(set(x)) == 1 for x in ids)
        got[doc, b"".join(x[0] for x in ids)] += copies.pop()
    assert got == want


def test_packing_round_trip(spark, sf_dir):
    docs = catalog.documents(spark, sf_dir)
    check_packing(packing.pack(docs, catalog.default_tokenizer()).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert catalog.op3_packing(spark, sf_dir).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_packing_odd(spark):
    texts = [(i or 100 + k, t) for k, (i, t) in enumerate(odd.texts())]
    more = ["a   b", " x  y\n z  d", "don't won't'll  \n\n x", "\x1c!x <|endoftext|> y", "a\xa0\xa0 b", "12.5,3 ½, a__b", "a  b  c\n  d", "x" * 5000 + " é.É,é"]
    texts += [(200 + k, t) for k, t in enumerate(more)]
    docs = spark.createDataFrame([(i, t, "c") for i, t in texts], "doc_id long, text string, length string")
    check_packing(packing.pack(docs, catalog.default_tokenizer()).collect(), texts)
    assert packing.pack(odd.empty(spark), catalog.default_tokenizer()).count() == 0
    assert packing.pack(odd.docs(spark), catalog.default_tokenizer()).filter("doc_id IS NULL").count() > 0
    assert packing.pieces_of(2700) == [1024, 1024, 512, 128, 8, 4] and packing.pieces_of(1) == [1]


def test_ranking_is_right_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = catalog.op10_ranking(spark, sf).toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    both = got[got.held_out].merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    assert len(both) > 50 and (both.predicted == both.quality).mean() >= 0.97


def test_ranking_learns_nothing_from_held_out_labels(spark, sf_dir):
    docs, labels = catalog.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    turned = labels.selectExpr("doc_id", "IF(crc32(CAST(doc_id AS STRING)) % 4 = 2, 1 - quality, quality) AS quality")
    a, b = ranking.train(docs, labels), ranking.train(docs, turned)
    assert (a.weights == b.weights).all() and a.cut == b.cut


def test_ranking_odd(spark):
    docs = odd.docs(spark)
    no_labels = spark.createDataFrame([], "doc_id long, quality int")
    flat = ranking.score(docs, ranking.train(docs, no_labels)).collect()
    assert {(r.score, r.predicted) for r in flat} == {(ranking.THRESHOLD, 1)} and len(flat) == len(odd.texts())
    labels = spark.createDataFrame([(6, 1), (6, 1), (8, 1), (11, 0), (2, 0), (12, None), (None, 1), (999, 0)], "doc_id long, quality int")
    made = ranking.score(docs, ranking.train(docs, labels)).collect()
    assert len({r.score for r in made if r.doc_id == 7}) == 1 and all(0 <= r.score <= 1 for r in made)
    assert ranking.score(odd.empty(spark), ranking.train(odd.empty(spark), labels)).count() == 0


def test_ranking_learns_from_all_pairs(spark):
    """The minimum of the mean loss of all pairs, and the threshold among all scores, against plain numpy."""
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (700, len(ranking.FIGURES)))
    good = (x[:, 0] - x[:, 3] + rng.normal(0, 1, 700) > 0.5).tolist()
    rows = spark.createDataFrame([(g, v.tolist()) for g, v in zip(good, x)], "good boolean, x array<double>").repartition(5)
    made = ranking.fit(rows)
    mark = np.array(good)
    z = np.clip((x - x.mean(axis=0)) / x.std(axis=0), -6, 6)
    assert np.allclose(made.mean, x.mean(axis=0), atol=1e-6) and np.allclose(made.scale, x.std(axis=0), atol=1e-6)
    difference = (z[mark][:, None, :] - z[~mark][None, :, :]).reshape(-1, x.shape[1])
    w = np.zeros(x.shape[1])
    for _ in range(20):
        p = 1 / (1 + np.exp(difference @ w))
        gradient = -difference.T @ p / len(p) + ranking.PENALTY * w
        w -= np.linalg.solve((difference * (p * (1 - p))[:, None]).T @ difference / len(p) + ranking.PENALTY * np.eye(len(w)), gradient)
    assert np.abs(made.weights - w).max() < 1e-3
    assert made.cut == np.quantile(made.raw(x), np.mean(~mark), method="higher")
    again = ranking.fit(rows.repartition(3))
    assert (again.weights == made.weights).all() and again.cut == made.cut


def test_ranking_has_no_cap_on_labelled_texts(spark):
    """The cap was 20,000 texts of each label: of 21,000 of one label all are measured."""
    docs = spark.range(28_500).selectExpr("id AS doc_id", "IF(id < 28000, 'aa bb', 'cc dd ee!!') AS text")
    labels = docs.selectExpr("doc_id", "IF(doc_id < 28000, 1, 0) AS quality")
    used = docs.filter(~ranking.held_out()).selectExpr("avg(IF(doc_id < 28000, log(3D), log(4D))) AS m", "count(*) AS n").first()
    assert used.n > 20_500
    assert abs(ranking.train(docs, labels).mean[ranking.FIGURES.index("log_words")] - used.m) < 1e-6


def check_shards(rows, shards_, total):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == total and all(sorted(x) == list(range(len(x))) for x in by.values())
    counts = [len(by.get(s, [])) for s in range(shards_)]
    assert sum(counts) == total and max(counts) - min(counts) <= 1


def test_shards(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: (r.text or "").encode() for r in catalog.documents(spark, sf).collect()}
    rows = catalog.op6_sharding(spark, sf).collect()
    check_shards(rows, 40, 1000)
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {i: (len(t) + 16, zlib.crc32(t)) for i, t in texts.items()}
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}
    small = shards.shuffle(catalog.documents(spark, sf), 7, part=10).collect()
    check_shards(small, 7, 1000)
    # a uniform shuffle does not remember the order of the ids
    assert abs(np.corrcoef([r.doc_id for r in small], [r.slot for r in small])[0, 1]) < 0.12


def test_shards_odd(spark):
    check_shards(shards.shuffle(odd.docs(spark), 3, part=2).collect(), 3, len(odd.texts()))
    assert shards.shuffle(odd.empty(spark), 3).count() == 0
    same = spark.range(500).selectExpr("CAST(NULL AS LONG) AS doc_id", "'t' AS text")
    check_shards(shards.shuffle(same, 8, part=50).collect(), 8, 500)


def test_communication_matrix():
    matrix = shards.communication_matrix([5, 0, 7, 30], shards.sizes(42, 4), 1)
    assert matrix.sum(axis=0).tolist() == [11, 11, 10, 10] and matrix.sum(axis=1).tolist() == [5, 0, 7, 30]
    many = np.stack([shards.communication_matrix([20, 20], np.array([10, 30]), s) for s in range(400)])
    assert abs(many[:, 0, 0].mean() - 5) < 0.3
