"""Alignment of two tokenizers' ids over the bytes of every text, with corpus-wide counts of linked id pairs.

Both tokenizers encode a space and the text. Byte offsets where tokens of both end cut them into groups; the two tokens
that end there are linked. Pairs of ids are counted through an inverted index of bitmaps:

1. Documents are numbered by range, a task's run of at most `RANGE` of them. For every pair of ids and range there is a
   bitmap of the documents that link it, without its zero bytes, and bitmaps of the planes of (links in the document) - 1:
   plane k + 1 holds the documents in whose number bit k is set. The bitmaps of the pieces of a range are OR-merged.
2. A bitmap's population counts documents, or 2^k links for a plane; sums over the ranges give each pair's totals.
3. Each posting takes its pair's score and returns it to the documents of its set bits, a range at a time.

A range is bounded by documents and by bitmap bytes, a pair has at most a few rows for a range, and totals are combined
before they move, so a pair in every document makes no larger task than others. Chunks of text are known by a 64-bit hash.

Defined cases: null and empty texts, and texts that the tokens of either side do not spell byte for byte, have no tokens:
zeros and an empty string. Null, repeated and equal ids stay rows of their own; other columns are not read; an empty table
gives no rows. A text is encoded as a whole: the memory of a task follows the longest text, about 150 bytes a token.
"""

from __future__ import annotations

import hashlib
import itertools
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.arrays import flat, pieces, prefix_sums, span_hash
from barloom.llm.components import saved
from barloom.llm.packing import chunks

#: documents of a range, and bitmap bytes at which a range ends early
RANGE = 1 << 14
ENTRIES = 1 << 22
#: most distinct chunks in a worker's cache of each side; a full cache is emptied, which changes the time, not the result
CACHE = 500_000
#: bytes of text taken at once
PIECE = 1 << 20
_IDS, _PLANES, _PLACES = 20, 6, 14  # bits of an id, of a plane's number and of a byte's place in a range's bitmap
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(bool)
_POPULATION = _BITS.sum(axis=1).astype(np.int64)


def byte_level(vocabulary: dict[str, int]) -> list[bytes]:
    """Bytes of every id of a byte-level vocabulary: printable bytes stand for themselves, others for 256 and above."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        out[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
    return out


def piece_bytes(piece: str) -> bytes:
    """Bytes of a piece: U+2581 is a space, <0xHH> a byte."""
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


def word_chunks(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the chunks of texts that begin with a space: the first space of every run of them."""
    before = np.zeros(len(buf), dtype=np.uint8)
    before[1:] = buf[:-1]
    begins = (buf == 0x20) & (before != 0x20)
    begins[offsets[:-1][offsets[:-1] < len(buf)]] = True
    return np.flatnonzero(begins)


def level_chunks(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the chunks that byte-level pre-tokenisation cannot cross; a text with rare white space is one chunk."""
    start, first, whole = chunks(buf, offsets)
    keep = ~np.repeat(whole, np.diff(first))
    keep[first[:-1][np.diff(first) > 0]] = True
    return start[keep]


class Side:
    """One tokenizer: ids of texts, each distinct chunk encoded once."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], names: list[bytes], starts: Callable, most: int = CACHE):
        if len(names) >= 1 << _IDS:
            raise ValueError(f"ids must be under {1 << _IDS}")
        self.encode, self.names, self.starts, self.most = encode, names, starts, most
        self.sizes = np.array([len(x) for x in names], dtype=np.int64)
        self.clear()

    def clear(self) -> None:
        self.keys, self.pool = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)
        self.first, self.count, self.exact = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=bool)

    def _learn(self, keys: np.ndarray, raw: list[bytes]) -> None:
        found = self.encode([x.decode("utf-8", "replace") for x in raw])
        exact = np.fromiter((b"".join([self.names[i] for i in ids]) == x for ids, x in zip(found, raw)), dtype=bool, count=len(raw))
        count = np.fromiter(map(len, found), dtype=np.int32, count=len(found))
        ids = np.fromiter(itertools.chain.from_iterable(found), dtype=np.int32, count=int(count.sum()))
        first = np.cumsum(count, dtype=np.int64) - count + len(self.pool)
        self.pool = np.concatenate([self.pool, ids])
        joined = [np.concatenate(x) for x in ((self.keys, keys), (self.first, first), (self.count, count), (self.exact, exact))]
        order = np.argsort(joined[0], kind="stable")
        self.keys, self.first, self.count, self.exact = (x[order] for x in joined)

    def __call__(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, number of each text's ids, whether they spell the text)."""
        if len(self.keys) > self.most:
            self.clear()
        start = self.starts(buf, offsets)
        first = np.searchsorted(start, offsets)
        end = np.append(start[1:], len(buf))
        keys, example, which = np.unique(span_hash(prefix_sums(buf), start, end), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        known = self.keys[np.minimum(at, len(self.keys) - 1)] == keys if len(self.keys) else np.zeros(len(keys), dtype=bool)
        if not known.all():
            new = example[~known]
            self._learn(keys[~known], [buf[a:b].tobytes() for a, b in zip(start[new].tolist(), end[new].tolist())])
            at = np.searchsorted(self.keys, keys)
        count = self.count[at][which].astype(np.int64)
        ends = np.cumsum(count)
        ids = self.pool[np.repeat(self.first[at][which] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]
        wrong = np.append(0, np.cumsum(~self.exact[at][which]))
        return ids, np.diff(np.append(0, ends)[first]), wrong[first[1:]] == wrong[first[:-1]]


_sides: dict[str, Side] = {}


def side(path: str) -> Side:
    """The tokenizer of a file, one per Python worker: .json is a byte-level vocabulary, .model one of pieces."""
    if path not in _sides:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            pieces_ = [model.id_to_piece(i) for i in range(model.get_piece_size())]
            # no piece continues over a space, so that chunks are independent; else texts stay whole
            apart = not any("▁" in p.lstrip("▁") for p in pieces_)
            # the model puts a space in front of what it is given, but for an empty text
            space = [model.piece_to_id("▁")]
            _sides[path] = Side(lambda texts: [ids or space for ids in model.encode([t[1:] for t in texts], num_threads=1)], [piece_bytes(p) for p in pieces_],
                               word_chunks if apart else lambda buf, offsets: offsets[:-1][np.diff(offsets) > 0])
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = True
            _sides[path] = Side(lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)],
                               byte_level(tokenizer.get_vocab()), level_chunks)
    return _sides[path]


def _decimals(size: int) -> tuple[np.ndarray, np.ndarray]:
    """(digits, number of digits) of the numbers under `size`."""
    text = np.array([str(i) for i in range(size)], dtype="S")
    return text.view(np.uint8).reshape(size, -1), np.char.str_len(text).astype(np.int64)


class Aligner:
    """Groups and links of batches of texts."""

    def __init__(self, a: str, b: str):
        self.a, self.b = side(a), side(b)
        self.digits, self.widths = _decimals(max(len(self.a.names), len(self.b.names)))

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, ...]:
        """(n_a, n_b, n_groups of each text; text, id a and id b of each link; characters of all groups, bounds of each text's)."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        column = pc.if_else(pc.equal(pc.binary_length(column), 0), column, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), column, pa.scalar("", pa.large_string())))
        buf, offsets = flat(column)
        ids_a, n_a, good_a = self.a(buf, offsets)
        ids_b, n_b, good_b = self.b(buf, offsets)
        good = good_a & good_b
        ids_a, ids_b = ids_a[np.repeat(good, n_a)], ids_b[np.repeat(good, n_b)]
        n_a, n_b = np.where(good, n_a, 0), np.where(good, n_b, 0)
        # texts that stay have the same bytes on both sides, so ends compare across the whole batch
        end_a, end_b = np.cumsum(self.a.sizes[ids_a]), np.cumsum(self.b.sizes[ids_b])
        place = np.searchsorted(end_b, end_a)
        last_a = np.flatnonzero(end_b[place] == end_a)
        last_b = place[last_a]
        text = np.repeat(np.arange(len(n_a)), n_a)[last_a]
        n_groups = np.bincount(text, minlength=len(n_a))
        return n_a, n_b, n_groups, text, ids_a[last_a], ids_b[last_b], *self._written(ids_a, ids_b, last_a, last_b, n_a + n_b)

    def _written(self, ids_a: np.ndarray, ids_b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """a1,a2|b1;a3|b2,b3 of all texts one after another, each with a semicolon behind it, and the bounds of each."""
        closes_a, closes_b = np.zeros(len(ids_a), dtype=np.int64), np.zeros(len(ids_b), dtype=np.int64)
        closes_a[last_a], closes_b[last_b] = 1, 1
        # an item stands behind the other side's items of the groups before, and b's behind those of its own group too
        at_a = np.arange(len(ids_a)) + np.append(0, last_b + 1)[np.cumsum(closes_a) - closes_a]
        at_b = np.arange(len(ids_b)) + (last_a + 1)[np.cumsum(closes_b) - closes_b]
        ids, mark = np.empty(len(ids_a) + len(ids_b), dtype=np.int32), np.empty(len(ids_a) + len(ids_b), dtype=np.uint8)
        ids[at_a], ids[at_b] = ids_a, ids_b
        mark[at_a], mark[at_b] = np.where(closes_a, ord("|"), ord(",")), np.where(closes_b, ord(";"), ord(","))
        width = self.widths[ids]
        ends = np.cumsum(width + 1)
        out = np.empty(ends[-1] if len(ends) else 0, dtype=np.uint8)
        begin = ends - width - 1
        for k in range(self.digits.shape[1]):
            has = width > k
            out[begin[has] + k] = self.digits[ids[has], k]
        out[ends - 1] = mark
        return out, np.append(0, ends)[np.append(0, np.cumsum(n))]


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a: str, b: str) -> Aligner:
    if (a, b) not in _aligners:
        _aligners[a, b] = Aligner(a, b)
    return _aligners[a, b]


def bitmaps(a: np.ndarray, b: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, byte) of the bitmaps of links (a, b) in the documents at `place` of a range. A key is the pair, the plane and
    the byte's place, in this order; bytes without a bit are left out."""
    key, count = np.unique((b.astype(np.uint64) << np.uint64(_IDS + 24)) | (a.astype(np.uint64) << np.uint64(24)) | place.astype(np.uint64), return_counts=True)
    pair, place, more = key >> np.uint64(24), (key & np.uint64((1 << 24) - 1)).astype(np.int64), count - 1
    keys, bits = [], []

    def plane(number: int, held: np.ndarray) -> None:
        keys.append((pair[held] << np.uint64(_PLANES + _PLACES)) | np.uint64(number << _PLACES) | (place[held] >> 3).astype(np.uint64))
        bits.append((1 << (place[held] & 7)).astype(np.uint8))

    plane(0, np.ones(len(pair), dtype=bool))
    for k in range(int(more.max(initial=0)).bit_length()):
        plane(k + 1, (more >> k & 1).astype(bool))
    return merged(keys, bits)


def merged(keys: list[np.ndarray], bits: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps OR-merged."""
    if not keys:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint8)
    key, byte = np.concatenate(keys), np.concatenate(bits)
    order = np.argsort(key, kind="stable")
    key, byte = key[order], byte[order]
    edge = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=np.int64)
    return key[edge], np.bitwise_or.reduceat(byte, edge) if len(edge) else byte


_POSTINGS = "range long, pos int, doc_id {0}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, a int, b int, plane int, bits binary, found long"


def index(docs: DataFrame, a: str, b: str, text: str = "text", doc_id: str = "doc_id", groups: bool = False) -> DataFrame:
    """The written index. Rows of documents (`pos` is set): range, pos, doc_id and the document's own figures, with
    groups=True the groups as text too. Rows of postings: range, a, b, plane, bits (place of the byte as two bytes,
    little-endian, and the byte) and found, the set bits."""
    kind = docs.schema[doc_id].dataType.simpleString()
    names = [x.split()[0] for x in _POSTINGS.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(a, b)
        task, number, taken = TaskContext.get().partitionId(), 0, 0
        held: tuple[list, list] = ([], [])

        def table(n: int, **columns) -> pa.RecordBatch:
            made = {name: columns.get(name, pa.nulls(n, t)) for name, t in zip(names, types)}
            return pa.RecordBatch.from_arrays(list(made.values()), names=names)

        def closed() -> Iterator[pa.RecordBatch]:
            key, byte = merged(*held)
            held[0].clear(), held[1].clear()
            if not len(key):
                return
            own = key >> np.uint64(_PLACES)
            edge = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            own = own[edge]
            packed = np.empty((len(key), 3), dtype=np.uint8)
            place = (key & np.uint64((1 << _PLACES) - 1)).astype("<u2")
            packed[:, :2], packed[:, 2] = place.view(np.uint8).reshape(-1, 2), byte
            counted = np.add.reduceat(_POPULATION[byte], edge)
            bound = 3 * np.append(edge, len(key))
            for at in range(0, len(own), 50_000):
                upto = min(at + 50_000, len(own))
                some = own[at:upto]
                pair = some >> np.uint64(_PLANES)
                bits = packed.reshape(-1)[bound[at] : bound[upto]]
                yield table(
                    upto - at, range=pa.array(np.full(upto - at, task << 32 | number)),
                    a=pa.array((pair & np.uint64((1 << _IDS) - 1)).astype(np.int32)), b=pa.array((pair >> np.uint64(_IDS)).astype(np.int32)),
                    plane=pa.array((some & np.uint64((1 << _PLANES) - 1)).astype(np.int32)),
                    bits=pa.Array.from_buffers(pa.binary(), upto - at, [None, pa.py_buffer((bound[at : upto + 1] - bound[at]).astype("<i4")), pa.py_buffer(bits)]),
                    found=pa.array(counted[at:upto]))

        types = None
        for batch in pieces(batches, "text", PIECE):
            types = types or [pa.int64(), pa.int32(), batch.schema.field("doc_id").type, *[pa.int64()] * 4, pa.string(), pa.string(), *[pa.int32()] * 3, pa.binary(), pa.int64()]
            for at in range(0, batch.num_rows, RANGE):
                part = batch.slice(at, RANGE)
                if taken + part.num_rows > RANGE or sum(map(len, held[0])) > ENTRIES:
                    yield from closed()
                    number, taken = number + 1, 0
                n_a, n_b, n_groups, which, link_a, link_b, out, bound = align(part.column("text"))
                for x, y in zip(held, bitmaps(link_a, link_b, which + taken)):
                    x.append(y)
                whole = memoryview(out)
                written = [whole[x : max(y - 1, x)] for x, y in zip(bound[:-1].tolist(), bound[1:].tolist())]
                n = part.num_rows
                yield table(
                    n, range=pa.array(np.full(n, task << 32 | number)), pos=pa.array(np.arange(taken, taken + n, dtype=np.int32)), doc_id=part.column("doc_id"),
                    n_a=pa.array(n_a), n_b=pa.array(n_b), n_groups=pa.array(n_groups), n_links=pa.array(n_groups),
                    groups_sha256=pa.array([hashlib.sha256(x).hexdigest() if len(x) else "" for x in written], pa.string()),
                    groups=pa.array([str(x, "ascii") for x in written], pa.string()) if groups else pa.nulls(n, pa.string()))
                taken += n
        if types:
            yield from closed()

    return saved(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(rows, _POSTINGS.format(kind)), "alignment")


def _weight() -> F.Column:
    """Links that a set bit of a plane stands for; plane 0 is that of the documents, whose first link it is."""
    return F.expr("shiftleft(1L, greatest(plane - 1, 0))")


def pair_counts(indexed: DataFrame) -> DataFrame:
    """a, b, documents and links of every pair of ids that is linked anywhere."""
    return indexed.filter("plane IS NOT NULL").groupBy("a", "b").agg(
        F.sum(F.when(F.col("plane") == 0, F.col("found"))).alias("documents"), F.sum(_weight() * F.col("found")).alias("links"))


def returned(indexed: DataFrame, scored: DataFrame) -> DataFrame:
    """range, pos, n_best and count_sum: the scores of a document's links, one each for every link.

    scored: a, b, links and best, whether no other pair has more links for this b.
    """

    def add(table: pa.Table) -> pa.Table:
        data = table.column("bits").combine_chunks()
        sizes = pc.binary_length(data).to_numpy() // 3
        packed = flat(data)[0].reshape(-1, 3)
        place = packed[:, :2].astype(np.int64) @ np.array([1, 256])
        weight, links = (table.column(c).to_numpy() for c in ("weight", "links"))
        best = table.column("best").to_numpy(zero_copy_only=False)
        worth = np.repeat(weight * links, sizes), np.repeat(weight * best, sizes)
        total, top, seen = (np.zeros(8 << _PLACES, dtype=np.int64) for _ in range(3))
        for bit in range(8):
            on = _BITS[packed[:, 2], bit]
            at = place[on] * 8 + bit
            seen[at] = 1
            # whole numbers: no sum goes through floating point
            np.add.at(total, at, worth[0][on])
            np.add.at(top, at, worth[1][on])
        pos = np.flatnonzero(seen)
        return pa.table({"range": pa.array(np.full(len(pos), table.column("range")[0].as_py())), "pos": pa.array(pos.astype(np.int32)),
                         "n_best": pa.array(top[pos]), "count_sum": pa.array(total[pos])})

    sent = indexed.filter("plane IS NOT NULL").select("range", "a", "b", _weight().alias("weight"), "bits").join(scored, ["a", "b"])
    return sent.select("range", "weight", "links", "best", "bits").groupBy("range").applyInArrow(add, "range long, pos int, n_best long, count_sum long")


def align(docs: DataFrame, a: str, b: str, text: str = "text", doc_id: str = "doc_id", groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair no other pair of its id b exceeds), count_sum (links
    in the corpus of the pairs of a document's links), groups_sha256 and, with groups=True, the groups as text.

    a: file of a byte-level vocabulary; b: file of a model of pieces (either kind goes on either side).
    """
    indexed = index(docs, a, b, text, doc_id, groups)
    pairs = saved(pair_counts(indexed), "pairs")
    scored = pairs.join(pairs.groupBy("b").agg(F.max("links").alias("most")), "b").select("a", "b", "links", (F.col("links") == F.col("most")).alias("best"))
    own = indexed.filter("pos IS NOT NULL").select("range", "pos", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *(["groups"] if groups else []))
    out = own.join(returned(indexed, scored), ["range", "pos"], "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
                      F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256", *(["groups"] if groups else []))
