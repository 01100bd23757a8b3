"""Ranked lexical search: the documents of the highest impact score for every item, by buckets of vectors of like length.

A document is a vector over the items' terms: w * ((10^9 tf) div (1000 tf + 12 m)), with the weight w of the term in the corpus
and m from the document's own number of terms. An item is the vector of its term counts, the score their product.

1. One pass over the texts counts documents, terms and the items' terms in each document; those vectors are written.
2. With the corpus totals every vector gets its impacts and its length, and is written.
3. Vectors are dealt out by falling length, the longest first, for a lower bound of every item's last place. A task cuts its
   share into buckets of neighbours. An item skips a bucket where its length times the bucket's greatest (Cauchy and
   Schwarz), or its counts times the bucket's greatest impacts, stay under the bound. In a bucket it reads the postings of
   its strongest terms, as many as it takes for the others alone to stay under the bound, and drops the vectors that stay
   under it even with what the others, or the rest of the two lengths, could add. What is left is scored in whole numbers.

Bounds are floating-point with a margin, scores are 64-bit integers, and a bound equal to the last place is looked at, so
the answer is exact, ties by smaller doc_id included. Terms are known by a 64-bit hash.

Items of equal text are searched once. They are dealt into groups of about `GROUP` bytes of text, each with a pass over the
corpus of its own, so what is sent to tasks is bounded whatever the benchmark's size; one item is held whole.

Defined cases: a null or empty text has no terms and is never found; an item without terms, or whose terms no document
holds, gives no rows; repeated rows of documents or items count and rank each for itself; documents of a null id come last
among equal scores; other columns are not read; without documents or items there are no rows. doc_id is an integer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.arrays import LOWER, flat, owner, pieces, prefix_sums, span_hash, spans
from barloom.llm.components import saved

#: bytes of items' texts searched in one pass over the corpus
GROUP = 4 << 20
#: vectors of a bucket
BUCKET = 4096
#: share of the longest vectors that give the first bounds
HEAD = 1 / 64
_TERM = np.zeros(256, dtype=bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_NO_ID = np.iinfo(np.int64).max
_MARGIN = 1 + 1e-9


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every term, first term of each text and the total): digits, letters and all beyond ASCII, A-Z lower-cased."""
    buf, offsets = flat(column)
    start, end, first = spans(_TERM[buf], offsets)
    return span_hash(prefix_sums(LOWER[buf]), start, end), first


def counted(hashes: np.ndarray, first: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in the vocabulary, occurrences) of the vocabulary's terms in each text, in this order."""
    if not len(vocabulary) or not len(hashes):
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
    place = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    known = vocabulary[place] == hashes
    key, tf = np.unique(owner(first, len(hashes))[known] * len(vocabulary) + place[known], return_counts=True)
    return key // len(vocabulary), key % len(vocabulary), tf


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 12 m), m = 75 + (25 n N) div L; n is that of the document of each tf."""
    if len(n) and 25 * documents * int(n.max()) >= 1 << 62:
        m = np.array([75 + 25 * x * documents // total for x in n.tolist()], dtype=np.int64)
    else:
        m = 75 + 25 * n * documents // max(total, 1)
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _lists(flat_values: np.ndarray, count: np.ndarray) -> pa.Array:
    bounds = np.append(0, np.cumsum(4 * count)).astype("<i4")
    return pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(bounds), pa.py_buffer(flat_values.astype("<i4"))])


def _values(column: pa.Array) -> np.ndarray:
    return flat(column)[0].view("<i4").astype(np.int64)


class Items:
    """The items of a group as rows of counts over their vocabulary."""

    def __init__(self, texts: list[str]):
        hashes, first = terms(pa.array(texts, pa.large_string()))
        self.vocabulary = np.unique(hashes)
        row, self.place, self.count = counted(hashes, first, self.vocabulary)
        self.first = np.searchsorted(row, np.arange(len(texts) + 1))
        self.row = row

    def lengths(self) -> np.ndarray:
        return np.sqrt(np.bincount(self.row, weights=self.count.astype(float) ** 2, minlength=len(self.first) - 1))


class Search:
    """The best rows so far of every item, over buckets of vectors in any order."""

    def __init__(self, items: Items, weights: np.ndarray, least: np.ndarray, k: int):
        self.items, self.weights, self.k, self.least = items, weights, k, np.maximum(least, 1)
        self.size = items.lengths()
        self.scores: list[np.ndarray] = [np.zeros(0, dtype=np.int64) for _ in self.size]
        self.ids: list[np.ndarray] = [np.zeros(0, dtype=np.int64) for _ in self.size]

    def _keep(self, item: int, score: np.ndarray, ids: np.ndarray) -> None:
        held = score >= self.least[item]
        score, ids = np.concatenate([self.scores[item], score[held]]), np.concatenate([self.ids[item], ids[held]])
        order = np.lexsort((ids, -score))[: self.k]
        self.scores[item], self.ids[item] = score[order], ids[order]
        if len(order) == self.k:
            self.least[item] = max(self.least[item], score[order[-1]])

    def bucket(self, ids: np.ndarray, length: np.ndarray, row: np.ndarray, place: np.ndarray, impact: np.ndarray) -> None:
        """Vectors of `ids` and `length`, their coordinates as (row, place, impact with its weight)."""
        live = self.size * length.max(initial=0) * _MARGIN >= self.least
        if not live.any() or not len(row):
            return
        order = np.lexsort((row, place))
        row, place, impact = row[order], place[order], impact[order]
        begin = np.searchsorted(place, np.arange(len(self.weights) + 1))
        most = np.zeros(len(self.weights), dtype=np.int64)
        edge = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        most[place[edge]] = np.maximum.reduceat(impact, edge)
        upper = self.items.count * most[self.items.place]
        live &= np.bincount(self.items.row, weights=upper, minlength=len(live)) * _MARGIN >= self.least
        for item in np.flatnonzero(live).tolist():
            own = slice(self.items.first[item], self.items.first[item + 1])
            strong = np.argsort(-upper[own], kind="stable")
            p, c, u = self.items.place[own][strong], self.items.count[own][strong], upper[own][strong]
            after = np.append(np.cumsum(u[::-1])[::-1], 0)  # what the terms from here on can add at most
            focus = int(np.searchsorted(-after, -self.least[item], side="right"))
            partial, square = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids))
            for x, times in zip(p[:focus].tolist(), c[:focus].tolist()):
                at = slice(begin[x], begin[x + 1])
                partial[row[at]] += times * impact[at]
                square[row[at]] += impact[at].astype(float) ** 2
            left = c[focus:].astype(float)
            rest = np.sqrt((left**2).sum()) * np.sqrt(np.maximum(length**2 * _MARGIN - square, 0))
            found = np.flatnonzero((partial > 0) & ((partial + np.minimum(rest, after[focus])) * _MARGIN >= self.least[item]))
            if not len(found):
                continue
            score = partial[found]
            for x, times in zip(p[focus:].tolist(), c[focus:].tolist()):
                at, upto = begin[x], begin[x + 1]
                if upto > at:
                    where = np.minimum(np.searchsorted(row[at:upto], found), upto - at - 1)
                    score += np.where(row[at:upto][where] == found, times * impact[at:upto][where], 0)
            self._keep(item, score, ids[found])


def _found(vectors: DataFrame, items: Broadcast, weights: Broadcast, least: Broadcast, k: int) -> DataFrame:
    """item, doc_id and score of the k best of each task; what is under `least` is left out."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(items.value, weights.value, least.value.copy(), k)
        for batch in batches:
            for at in range(0, batch.num_rows, BUCKET):
                part = batch.slice(at, BUCKET)
                count = flat(part.column("places"))[1]
                row = np.repeat(np.arange(part.num_rows), np.diff(count) // 4)
                place = _values(part.column("places"))
                ids = part.column("doc_id").fill_null(_NO_ID).to_numpy(zero_copy_only=False)
                search.bucket(ids, part.column("length").to_numpy(), row, place, _values(part.column("impacts")) * weights.value[place])
        number = np.repeat(np.arange(len(search.ids)), [len(x) for x in search.ids])
        ids = np.concatenate([*search.ids, np.zeros(0, dtype=np.int64)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(number.astype(np.int32)), pa.array(ids, mask=ids == _NO_ID), pa.array(np.concatenate([*search.scores, np.zeros(0, dtype=np.int64)]))],
            names=["item", "doc_id", "score"])

    return vectors.mapInArrow(rows, "item int, doc_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def _of_group(docs: DataFrame, texts: list[str], k: int) -> DataFrame:
    """text, rank, doc_id, score. docs: doc_id and text."""
    spark = docs.sparkSession
    made = Items(texts)
    items = spark.sparkContext.broadcast(made)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = items.value.vocabulary
        df, documents, total = np.zeros(len(vocabulary), dtype=np.int64), 0, 0
        names = ["doc_id", "n", "places", "counts", "place", "df"]
        for batch in pieces(batches, "text"):
            hashes, first = terms(batch.column("text"))
            n = np.diff(first)
            documents, total = documents + int((n > 0).sum()), total + len(hashes)
            row, place, tf = counted(hashes, first, vocabulary)
            df += np.bincount(place, minlength=len(vocabulary))
            size = np.bincount(row, minlength=batch.num_rows)
            has = np.flatnonzero(size)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(has)), pa.array(n[has]), _lists(place, size[has]), _lists(tf, size[has]), pa.nulls(len(has), pa.int64()), pa.nulls(len(has), pa.int64())], names=names)
        place = np.append(np.flatnonzero(df), [-1, -2])
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(place), pa.int64()), *(pa.nulls(len(place), t) for t in (pa.int64(), pa.binary(), pa.binary())), pa.array(place),
             pa.array(np.append(df[place[:-2]], [documents, total]))], names=names)

    read = saved(docs.mapInArrow(vectors, "doc_id long, n long, places binary, counts binary, place long, df long"), "vectors")
    # one row a term of the group's items
    totals = {r.place: r.df for r in read.filter("place IS NOT NULL").groupBy("place").agg(F.sum("df").alias("df")).collect()}
    documents, total = totals.pop(-1, 0), totals.pop(-2, 0)
    weights = np.zeros(len(made.vocabulary), dtype=np.int64)
    for place, df in totals.items():
        weights[place] = weight(documents, df)
    sent = spark.sparkContext.broadcast(weights)

    def with_impacts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            size = np.diff(flat(batch.column("places"))[1]) // 4
            place, row = _values(batch.column("places")), np.repeat(np.arange(batch.num_rows), size)
            impact = impacts(_values(batch.column("counts")), batch.column("n").to_numpy()[row], documents, total)
            length = np.sqrt(np.bincount(row, weights=(impact * sent.value[place]).astype(float) ** 2, minlength=batch.num_rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(length), batch.column("places"), _lists(impact, size), pa.array((number + np.arange(len(size))) % 4096)],
                names=["doc_id", "length", "places", "impacts", "salt"])
            number += len(size)

    measured = saved(read.filter("place IS NULL").select("doc_id", "n", "places", "counts").mapInArrow(
        with_impacts, "doc_id long, length double, places binary, impacts binary, salt long"), "impacts")
    cut = measured.agg(F.percentile_approx("length", 1 - HEAD, 1000)).first()[0]
    nothing = spark.sparkContext.broadcast(np.ones(len(texts), dtype=np.int64))
    head = saved(_best(_found(measured.filter(F.col("length") >= F.lit(cut)), items, sent, nothing, k), k), "head")
    least = np.ones(len(texts), dtype=np.int64)
    for r in head.filter(F.col("rank") == k).select("item", "score").collect():  # one row an item of the group
        least[r.item] = r.score
    bound = spark.sparkContext.broadcast(least)
    # equal lengths are split by the written salt, so that copies of one text do not share a task
    rest = measured.filter(F.col("length") < F.lit(cut)).repartitionByRange(F.desc("length"), "salt")
    best = saved(_best(head.drop("rank").unionByName(_found(rest, items, sent, bound, k)), k), "ranked")
    for x in (items, sent, nothing, bound):
        x.destroy()
    named = spark.createDataFrame(list(enumerate(texts)), "item int, text string")
    return best.join(named, "item").select("text", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 20, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id",
           group: int = GROUP) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the k best documents of every item, scores over 0 only."""
    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    distinct = asked.filter("text <> ''").select("text").distinct()
    groups = -(-(distinct.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // group)
    kind = items.schema[item_id].dataType.simpleString()
    out = docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for g in range(groups):
        texts = [r.text for r in distinct.filter(F.pmod(F.xxhash64("text"), F.lit(groups)) == g).orderBy("text").collect()]
        if texts:
            out = out.unionByName(asked.join(_of_group(read, texts, k), "text").select("item_id", "rank", "doc_id", "score"))
    return out
