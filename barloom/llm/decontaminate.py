"""Benchmark decontamination by latent semantic retrieval and an order-aware check.

Texts are read as words of letters and digits without case, so punctuation, symbols and shouting do not hide a passage.
Passages are blocks of words. Their TF-IDF vectors over the benchmark's vocabulary are factored by a distributed
randomised SVD: tasks sum their share of A'(A X) for a narrow random X, the small sums meet on the driver. The items
are folded in, so the latent space holds every item exactly beside the corpus directions. Passages near an item by
the cosine in that space are candidates; a candidate is a leak if the longest common subsequence covers most
of the item, or a good part of it including its answer.

Document frequencies, factors and the search run over all passages of all texts. The benchmark is worked off in
groups of `ITEMS` items, so what a task holds does not grow with the benchmark.

Defined cases: null and empty texts hold no passage and are clean; items without words are never found; equal rows
are judged alike and each gives its rows; items that equal one another are all reported; a null doc_id or item_id is
reported as null; other columns are not read; an empty table gives no rows, an empty benchmark finds nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.arrays import flat, pieces, prefix_sums, span_hash, spans
from barloom.llm.components import release

ITEMS = 1000
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True


@dataclass(frozen=True)
class Rules:
    """cosine: least similarity of a candidate. lcs: share of an item's words that a leak holds in order; answer_lcs: the
    share that is enough if the answer, the item's last `answer` words, is there too (`answer_share` of them, in order)."""

    cosine: float = 0.65
    lcs: float = 0.75
    answer_lcs: float = 0.6
    answer: int = 6
    answer_share: float = 0.8
    passage: int = 32
    rank: int = 48
    common: float = 0.005
    rare: int = 8


def plain_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, first word of each text and the total); words are runs of letters and digits without case."""
    hashes, _, _, first = plain_spans(column)
    return hashes, first


def plain_spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, end of every word, first word of each text and the total)."""
    buf, offsets = flat(column)
    buf = buf.copy()
    before = np.zeros(len(buf), dtype=np.uint8)
    before[1:] = buf[:-1]
    upper = ((buf >= 0x41) & (buf <= 0x5A)) | ((before == 0xC3) & (buf >= 0x80) & (buf <= 0x9E) & (buf != 0x97))
    buf[upper] += 0x20
    inside = _WORD[buf]
    for at in np.flatnonzero((before == 0xE2) & (buf == 0x80)):  # general punctuation
        inside[at - 1 : at + 2] = False
    start, end, first = spans(inside, offsets)
    return span_hash(prefix_sums(buf), start, end), start, end, first


class Vocabulary:
    """Place of a word's hash among known ones, or none."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in hashes, places in keys) of the known words."""
        if not len(self.keys):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        at = np.flatnonzero(self.maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        known = self.keys[place] == hashes[at]
        return at[known], place[known]


def blocks_of(at: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Number of the block of `size` words that each word position lies in; blocks of two texts are never neighbours."""
    count = np.diff(first)
    base = np.cumsum(np.append(0, -(-count // size) + 1))[:-1]
    text = np.searchsorted(first, at, side="right") - 1
    return base[text] + (at - first[text]) // size


def _starts(sorted_values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1])) if len(sorted_values) else np.zeros(0, dtype=np.int64)


def _row_sums(table: np.ndarray, rows: np.ndarray, edge: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sums of table[rows] over runs that begin at edge: one addition for each place in a run, of the runs that have it."""
    out = table[rows[edge]]
    order = np.argsort(-count, kind="stable")
    live = len(count) - np.searchsorted(np.sort(count), np.arange(2, count.max() + 1))
    for k, n in enumerate(live.tolist(), 1):
        out[order[:n]] += table[rows[edge[order[:n]] + k]]
    return out


def lcs(masks: dict[int, int], size: int, words: list[int]) -> int:
    """Bits of the item (masks: word -> its places) that a longest common subsequence with words leaves set to 0."""
    full = (1 << size) - 1
    row = full
    for word in words:
        match = masks.get(word, 0) & row
        if match:
            row = ((row + match) | (row - match)) & full
    return row


def _summed(docs: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all tasks of make(their rows), a matrix of a size that the item group bounds. Tasks send the rows they touched."""
    slices = 8
    each = -(-max(shape[0], 1) // slices)
    width = int(np.prod(shape[1:]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = make(batches).reshape(shape[0], width)
        touched = np.flatnonzero(whole.any(axis=1))
        cut = [touched[(touched >= k * each) & (touched < (k + 1) * each)] for k in range(slices)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(slices)), *(pa.array(x, pa.binary()) for x in ([c.astype("<i4").tobytes() for c in cut], [whole[c].astype("<f4").tobytes() for c in cut]))],
            names=["part", "rows", "sums"])

    def total(rows: list[bytes], sums: list[bytes]) -> np.ndarray:
        out = np.zeros((shape[0], width))
        for r, x in zip(rows, sums):
            out[np.frombuffer(r, "<i4")] += np.frombuffer(x, "<f4").reshape(-1, width)
        return out

    def add(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        out = total(table.column("rows").to_pylist(), table.column("sums").to_pylist())
        own = np.arange(part * each, min((part + 1) * each, shape[0]), dtype="<i4")
        return pa.table({"part": table.column("part")[:1], "rows": pa.array([own.tobytes()], pa.binary()), "sums": pa.array([out[own].astype("<f4").tobytes()], pa.binary())})

    schema = "part long, rows binary, sums binary"
    rows = docs.mapInArrow(task, schema).groupBy("part", F.pmod(F.spark_partition_id(), F.lit(32)).alias("_lane")).applyInArrow(add, schema)
    found = rows.groupBy("part").applyInArrow(add, schema).collect()
    out = total([r.rows for r in found], [r.sums for r in found]).reshape(shape)
    release(docs.sparkSession)
    return out


@dataclass
class Model:
    """What a task needs to search: sent to every task, of a size that the item group bounds."""

    vocabulary: Vocabulary
    idf: np.ndarray
    corpus: np.ndarray
    items: list[np.ndarray]
    rules: Rules

    def __post_init__(self) -> None:
        self.classes: dict[int, list[int]] = {}
        for i, words in enumerate(self.items):
            if len(words):
                self.classes.setdefault(max(8, 1 << (len(words) - 1).bit_length()), []).append(i)
        self.masks = []
        for words in self.items:
            masks: dict[int, int] = {}
            for k, w in enumerate(words.tolist()):
                masks[w] = masks.get(w, 0) | 1 << k
            self.masks.append(masks)
        self.sorted = [np.unique(w) for w in self.items]
        # by class: weights of a word for the corpus directions and the class's items, for its items' cosines, and the
        # fewest weighted words that some two neighbouring blocks of a leak hold: it spans three, and lacks few words
        self.spaces = {}
        for size, members in self.classes.items():
            vectors = np.stack([self._vector(self.items[i]) for i in members])
            basis = np.linalg.qr(np.hstack([self.corpus, vectors.T]))[0]
            latent = vectors @ basis
            latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
            weighted = basis * self.idf[:, None]
            least = min(int((self.idf[self.vocabulary.find(self.items[i])[1]] > 0).sum()) - (1 - self.rules.answer_lcs) * len(self.items[i]) for i in members)
            self.spaces[size] = weighted.astype(np.float32), (weighted @ latent.T).astype(np.float32), max(2, math.ceil(least / 2))

    def _vector(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.idf))
        _, place = self.vocabulary.find(words)
        np.add.at(out, place, self.idf[place])
        return out

    def search(self, column: pa.Array) -> list[tuple[int, int, float, int, bool]]:
        """(text, item, cosine, words of the item in order, answer found) of all leaks, the best of each text and item."""
        hashes, first = plain_words(column)
        at, place = self.vocabulary.find(hashes)
        used = self.idf[place] > 0
        at, place = at[used], place[used]
        best: dict[tuple[int, int], tuple[float, int, bool]] = {}
        for size, members in self.classes.items():
            half = size // 2
            block = blocks_of(at, first, half)
            edge = _starts(block)
            number = block[edge]
            count = np.diff(np.append(edge, len(block)))
            # blocks that with a neighbour hold enough weighted words
            weighted, scores, need = self.spaces[size]
            follows = np.append(number[1:] == number[:-1] + 1, False) if len(number) else np.zeros(0, dtype=bool)
            rich = count + np.where(follows, np.append(count[1:], 0), 0) >= need
            rich[1:] |= follows[:-1] & rich[:-1]
            keep = np.repeat(rich, count)
            if not keep.any():
                continue
            hit, where, block = at[keep], place[keep], block[keep]
            edge = _starts(block)
            number, count = block[edge], np.diff(np.append(edge, len(block)))
            near, latent = (_row_sums(x, where, edge, count) for x in (scores, weighted))
            follows = np.flatnonzero(number[1:] == number[:-1] + 1)
            both = latent[follows] + latent[follows + 1]
            close = near / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
            wide = (near[follows] + near[follows + 1]) / np.maximum(np.linalg.norm(both, axis=1, keepdims=True), 1e-9)
            close[follows] = np.maximum(close[follows], wide)
            text = np.searchsorted(first, hit[edge], side="right") - 1
            for b, m in zip(*np.nonzero(close >= self.rules.cosine)):
                item = members[m]
                begin = hit[edge[b]]
                begin = first[text[b]] + (begin - first[text[b]]) // half * half
                region = hashes[max(first[text[b]], begin - size) : min(first[text[b] + 1], begin + 2 * size)]
                found = self._judge(item, region)
                if found is not None:
                    key = int(text[b]), item
                    value = round(float(close[b, m]), 4), *found
                    best[key] = max(best.get(key, value), value, key=lambda x: (x[1], x[2], x[0]))
        return [(*key, *value) for key, value in sorted(best.items())]

    def _judge(self, item: int, region: np.ndarray) -> tuple[int, bool] | None:
        n, known = len(self.items[item]), self.sorted[item]
        words = region[known[np.minimum(np.searchsorted(known, region), len(known) - 1)] == region].tolist()
        if len(words) < self.rules.answer_lcs * n:
            return None
        row = lcs(self.masks[item], n, words)
        held = n - row.bit_count()
        size = min(self.rules.answer, n)
        tail = {w: m >> (n - size) for w, m in self.masks[item].items() if m >> (n - size)}
        answer = size - lcs(tail, size, words).bit_count() >= self.rules.answer_share * size
        return (held, answer) if held >= self.rules.lcs * n or answer and held >= self.rules.answer_lcs * n else None


def fit(docs: DataFrame, items: list[np.ndarray], rules: Rules) -> Model:
    """The latent space of the corpus passages and these items. docs: a column text."""
    words = Vocabulary(np.concatenate([*items, np.zeros(0, dtype=np.uint64)]).astype(np.uint64))
    size = len(words.keys)
    rng = np.random.default_rng(17)

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(places, edges of the passages, number of passages): a word counts once in a passage."""
        for batch in pieces(batches, "text"):
            hashes, first = plain_words(batch.column("text"))
            at, place = words.find(hashes)
            block = blocks_of(at, first, rules.passage)
            key = np.unique(block * size + place)
            yield key % size, _starts(key // size), int((-(-np.diff(first) // rules.passage)).sum())

    def frequencies(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(size + 2)
        for place, _, n in passages(batches):
            out[:size] += np.bincount(place, minlength=size)
            out[size:] += divmod(n, 1 << 16)
        return out

    counted = _summed(docs, frequencies, (size + 2,))
    df, total = counted[:size], counted[size] * (1 << 16) + counted[size + 1]
    idf = np.log((total + 1) / (df + 1)) + 1e-3
    # words in very many passages tell little; every item keeps its rarest ones
    used = df <= max(rules.common * total, 1)
    for item in items:
        _, place = words.find(item)
        place = np.unique(place)
        used[place[np.argsort(df[place], kind="stable")[: rules.rare]]] = True
    idf[~used] = 0
    live = docs.sparkSession.sparkContext.broadcast(idf)

    def gram(x: np.ndarray) -> np.ndarray:
        """A'(A x), the rows of A being the passages' vectors of length 1."""
        sent = docs.sparkSession.sparkContext.broadcast(x.astype(np.float32))

        def share(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            out = np.zeros((size, x.shape[1]))
            for place, _, _ in _used(passages(batches), live):
                place, edge = place
                weight = live.value[place].astype(np.float32)
                count = np.diff(np.append(edge, len(place)))
                norm = np.repeat(np.sqrt(np.add.reduceat(weight * weight, edge)), count)
                weight = (weight / norm)[:, None]
                rows = np.repeat(np.add.reduceat(sent.value[place] * weight, edge), count, axis=0) * weight
                order = np.argsort(place, kind="stable")
                start = _starts(place[order])
                out[place[order][start]] += np.add.reduceat(rows[order], start)
            return out

        out = _summed(docs, share, (size, x.shape[1]))
        sent.destroy()
        return out

    rank = min(rules.rank, size)
    corpus = np.zeros((size, 0))
    if size:
        # one pass: A'A is near Y W^-1 Y' with Y = A'A X and W = X'Y, whose eigenvectors are those of Y W^-1/2
        x = np.linalg.qr(rng.standard_normal((size, rank)))[0]
        y = gram(x)
        values, turn = np.linalg.eigh((x.T @ y + y.T @ x) / 2)
        held = values > 1e-6 * max(values.max(), 1e-300)
        u, strength, _ = np.linalg.svd(y @ turn[:, held] / np.sqrt(values[held]), full_matrices=False)
        corpus = u[:, strength > 1e-6 * max(strength.max(initial=0), 1e-300)]
    live.destroy()
    return Model(words, idf, corpus, items, rules)


def _used(made: Iterator[tuple[np.ndarray, np.ndarray, int]], idf: Broadcast) -> Iterator[tuple[tuple[np.ndarray, np.ndarray], None, None]]:
    """The passages' words that have a weight."""
    for place, edge, _ in made:
        which = np.zeros(len(place), dtype=np.int64)
        which[edge[1:]] = 1
        keep = idf.value[place] > 0
        if keep.any():
            yield (place[keep], _starts(np.cumsum(which)[keep])), None, None


def models(docs: DataFrame, benchmark: DataFrame, text: str, item_text: str, item_id: str, rules: Rules, group: int = ITEMS) -> Iterator[tuple[list, Broadcast]]:
    """(ids of the items, their model) by groups of items."""
    spark: SparkSession = docs.sparkSession
    read = docs.select(F.col(text).alias("text"))
    numbered = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    groups = -(-numbered.count() // group)
    dealt = numbered.withColumn("_group", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(groups, 1))))
    for g in range(groups):
        rows = dealt.filter(F.col("_group") == g).orderBy("item_id", "text").collect()
        if rows:
            hashes, first = plain_words(pa.array([r.text for r in rows], pa.string()))
            items = [hashes[a:b] for a, b in zip(first[:-1], first[1:])]
            yield [r.item_id for r in rows], spark.sparkContext.broadcast(fit(read, items, rules))


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text",
          item_id: str = "item_id", rules: Rules = Rules(), group: int = ITEMS) -> DataFrame:
    """doc_id, item_id, cosine, lcs_words, item_words and answer_found of every item that a document holds."""
    kind, item_kind = docs.schema[doc_id].dataType.simpleString(), benchmark.schema[item_id].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    arrow_kind = to_arrow_type(item_kind)
    schema = f"doc_id {kind}, item_id {item_kind.simpleString()}, cosine double, lcs_words long, item_words long, answer_found boolean"
    out = docs.sparkSession.createDataFrame([], schema)
    for ids, model in models(docs, benchmark, text, item_text, item_id, rules, group):

        def rows(batches: Iterator[pa.RecordBatch], ids: list = ids, model: Broadcast = model) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, "text"):
                found = model.value.search(batch.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array([x[0] for x in found], pa.int64())), pa.array([ids[x[1]] for x in found], arrow_kind),
                     pa.array([x[2] for x in found], pa.float64()), pa.array([x[3] for x in found], pa.int64()),
                     pa.array([len(model.value.items[x[1]]) for x in found], pa.int64()), pa.array([x[4] for x in found], pa.bool_())],
                    names=["doc_id", "item_id", "cosine", "lcs_words", "item_words", "answer_found"])

        out = out.unionByName(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(rows, schema))
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id",
               rules: Rules = Rules(), group: int = ITEMS) -> DataFrame:
    """The rows of docs that hold no item, with all their columns as they are."""
    out = docs
    for _, model in models(docs, benchmark, text, item_text, item_id, rules, group):

        def rows(batches: Iterator[pa.RecordBatch], model: Broadcast = model) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, text):
                clean = np.ones(batch.num_rows, dtype=bool)
                clean[[x[0] for x in model.value.search(batch.column(text))]] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(rows, docs.schema)
    return out
