"""Alignment of two tokenizers against plain Python."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from barloom.llm import align, catalog
from tests.llm import odd


def plain(texts):
    """The figures of every text, and (documents, links) of every pair."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(catalog.default_tokenizer())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=catalog.default_pieces())
    names = align.byte_level(a.get_vocab())
    of_b = [align.piece_bytes(b.id_to_piece(i)) for i in range(b.get_piece_size())]
    made, links, documents = [], [], Counter()
    for text in texts:
        ids = ([], [])
        if text:
            ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            if not (b"".join(names[i] for i in ids[0]) == b"".join(of_b[i] for i in ids[1]) == (" " + text).encode()):
                ids = ([], [])
        ends = [np.cumsum([len(n[i]) for i in x]).tolist() for n, x in ((names, ids[0]), (of_b, ids[1]))]
        where = [{e: k for k, e in enumerate(x)} for x in ends]
        groups, own, done = [], [], (0, 0)
        for e in ends[0]:
            if e in where[1]:
                upto = where[0][e] + 1, where[1][e] + 1
                groups.append("|".join(",".join(map(str, x[i:j])) for x, i, j in zip(ids, done, upto)))
                own.append((ids[0][upto[0] - 1], ids[1][upto[1] - 1]))
                done = upto
        links.append(own)
        documents.update(set(own))
        made.append((len(ids[0]), len(ids[1]), len(groups), len(own), ";".join(groups)))
    total = Counter(x for own in links for x in own)
    most = {}
    for (_, j), n in total.items():
        most[j] = max(most.get(j, 0), n)
    rows = [(*m[:4], sum(total[x] == most[x[1]] for x in own), sum(total[x] for x in own), m[4]) for m, own in zip(made, links)]
    return rows, {x: (documents[x], n) for x, n in total.items()}


def check(docs, rows):
    read = docs.select("doc_id", "text").collect()
    want, _ = plain([r.text for r in read])
    want = sorted(((r.doc_id, *w[:6], hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "") for r, w in zip(read, want)), key=repr)
    got = sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows), key=repr)
    assert got == want


def test_alignment_query(spark, sf_dir):
    made = catalog.op11_alignment(spark, sf_dir)
    assert made.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    check(catalog.documents(spark, sf_dir), made.collect())


AWKWARD = ["a  b   c ", " x", "  ", "\n\n a\t b\r\n", "</s> <s> <|endoftext|> <unk> <0x41>", "▁x ▁", "½ ﬁ Ⅷ 日本語 テキスト 🙂👩‍👩‍👧", "a\x00b\x1c c", "a\xa0b c 　", "don't won't I'll",
           "aaaa " * 300, "é é", "x" * 3000, "12 345 6789"]


def test_alignment_odd(spark, monkeypatch):
    docs = odd.docs(spark).unionByName(spark.createDataFrame([(100 + k, t, *("c" for _ in odd.CLASHES)) for k, t in enumerate(AWKWARD)], odd.SCHEMA))
    made = align.align(docs, catalog.default_tokenizer(), catalog.default_pieces(), groups=True).collect()
    check(docs, made)
    assert all(r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") for r in made)
    assert {r.doc_id: r.n_a for r in made if r.doc_id in (1, 2, 105)} == {1: 0, 2: 0, 105: 0}
    assert align.align(odd.empty(spark), catalog.default_tokenizer(), catalog.default_pieces()).count() == 0


@pytest.mark.parametrize("size", [3, 1 << 14])
def test_pair_counts_over_ranges(spark, sf_dir, size, monkeypatch):
    docs = catalog.documents(spark, sf_dir).limit(60)
    monkeypatch.setattr(align, "RANGE", size)
    got = {(r.a, r.b): (r.documents, r.links) for r in align.pair_counts(align.index(docs, catalog.default_tokenizer(), catalog.default_pieces())).collect()}
    assert got == plain([r.text for r in docs.collect()])[1]


def test_bitmaps_hold_counts():
    rng = np.random.default_rng(3)
    a, b, place = rng.integers(0, 3, 5000), rng.integers(0, 2, 5000), rng.integers(0, 40, 5000)
    parts = [align.bitmaps(a[s], b[s], place[s]) for s in (np.flatnonzero(place < 17), np.flatnonzero(place >= 17))]
    key, byte = align.merged(*zip(*parts))
    plane = (key >> np.uint64(14)) & np.uint64(63)
    weight = np.where(plane == 0, 1, 1 << np.maximum(plane.astype(np.int64) - 1, 0))
    found = Counter()
    for k, w, x in zip(key.tolist(), weight.tolist(), byte.tolist()):
        found[k >> 20] += w * x.bit_count()
    want = Counter(zip(b.tolist(), a.tolist()))
    assert {(k >> 20, k & (1 << 20) - 1): n for k, n in found.items()} == want
    assert align.merged([], [])[0].size == 0
