"""Quality scores by Bradley-Terry ranking: a text's score is learned from pairs of a good and a bad text.

A pair says that the good text should score higher. The loss of a pair is the logistic loss of the difference of the two
scores, which are linear in figures of the text alone, so only differences of figures matter. The threshold is the
quantile of the training scores that leaves as large a share below as the labels call bad; scores are mapped to 0..1 so that
the threshold lies at `THRESHOLD`.

The fit uses all labelled texts that are not held out and all pairs of them. A step of Newton's method is one pass over their
figures: a text's share in the gradient is a smooth function of its score and of how the other label's scores are spread, so the
pass adds up counts, figures and their products by label and narrow range of scores, and the driver sees those sums alone. The
sums are of whole numbers, so their order does not matter, and the threshold is found among all scores by their leading bits.

Defined cases: a null text scores as an empty one; equal texts score alike; labels that are null, or of unknown documents, are
not used; several labels of one document count as the lowest; without texts of both labels nothing is learned and all
scores are equal; a null doc_id is scored and not held out; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.arrays import flat, owner, per_text, pieces, prefix_sums, repeated, span_hash, within, words
from barloom.llm.components import saved
from barloom.llm.quality import measure

THRESHOLD = 0.7
PENALTY = 1e-3
# figures are added up in these parts, scaled ones in those
UNIT = 1 << 20
STEP = 1 << 12
# ranges of scores for counts and figures, and how many of them share their products
RANGES = 4096
SHARED = 8
# labelled texts that a task adds up
ROWS_A_TASK = 100_000

_CLASSES = {
    "upper": lambda b: (b >= 0x41) & (b <= 0x5A),
    "digit": lambda b: (b >= 0x30) & (b <= 0x39),
    "beyond_ascii": lambda b: b >= 0xC0,
    "shout": lambda b: b == 0x21,
    "bar": lambda b: b == 0x7C,
    "stop": lambda b: (b == 0x2E) | (b == 0x3F),
    "comma": lambda b: (b == 0x2C) | (b == 0x3A) | (b == 0x3B),
    "line": lambda b: b == 0x0A,
}
_SHARES = ("dup_line_share", "dup_line_char_share", "top_2_share", "top_3_share", "top_4_share", "repeat_6_share", "repeat_10_share")
FIGURES = ("log_words", "few_words", "word_length", "symbols", "symbols_any", *_CLASSES, "distinct_words", "repeat_words", *_SHARES)


def figures(column: pa.Array) -> np.ndarray:
    """A row of FIGURES for each text."""
    buf, offsets = flat(column)
    rules = measure(column)
    n = rules["n_words"]
    least = np.maximum(n, 1)
    start, end, first = words(buf, offsets)
    _, again = repeated(within(owner(first, len(start)), span_hash(prefix_sums(buf), start, end)))
    chars = np.maximum(rules["word_chars"], 1)
    out = {
        "log_words": np.log1p(n),
        "few_words": np.maximum(0, 12 - n) / 12,
        "word_length": np.minimum(rules["word_chars"] / least, 30),
        "symbols": np.minimum(rules["n_symbols"] / least, 3),
        "symbols_any": np.minimum(rules["n_symbols"] / least, 0.2) * 5,
        "distinct_words": 1 - per_text(again, first) / least,
        "repeat_words": rules["n_repeat_words"] / least,
    }
    for name, test in _CLASSES.items():
        out[name] = np.sqrt(np.minimum(per_text(test(buf), offsets) / chars, 1))
    for name in _SHARES:
        out[name] = np.sqrt(np.minimum(rules[name], 1))
    return np.column_stack([out[name] for name in FIGURES])


@dataclass(frozen=True)
class Scorer:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return (self.scaled(x) * self.weights).sum(axis=1)

    def __call__(self, column: pa.Array) -> np.ndarray:
        z = self.raw(figures(column)) - self.cut + np.log(THRESHOLD / (1 - THRESHOLD))
        # a text on the threshold itself counts as good, whatever the last digit of the exponential
        return np.where(z >= np.log(THRESHOLD / (1 - THRESHOLD)), np.maximum(1 / (1 + np.exp(-z)), THRESHOLD), 1 / (1 + np.exp(-np.minimum(z, 700))))


def _summed(rows: DataFrame, size: int, count: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows (good, x) of the `size` whole numbers that count(x, good) gives for a batch of them."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                total += count(x, batch.column("good").to_numpy(zero_copy_only=False))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    # a sum for each of `size` places, whatever the number of rows
    found = rows.mapInArrow(added, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size, dtype=np.int64)
    out[found["at"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def _ranges(scorer: Scorer, reach: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Counts batches: by label and range of scores the number of texts and the sums of scaled figures, by wider ranges their products."""
    k = len(FIGURES)

    def count(x: np.ndarray, good: np.ndarray) -> np.ndarray:
        z = np.rint(scorer.scaled(x) * STEP).astype(np.int64)
        score = (z * scorer.weights).sum(axis=1) / STEP
        at = np.clip(((score + reach) * (RANGES / (2 * reach))).astype(np.int64), 0, RANGES - 1) + RANGES * good
        first = np.zeros((2 * RANGES, k + 1), dtype=np.int64)
        np.add.at(first, at, np.column_stack([np.ones(len(z), dtype=np.int64), z]))
        second = np.zeros((2 * RANGES // SHARED, k, k), dtype=np.int64)
        wide = at // SHARED
        order = np.argsort(wide, kind="stable")
        cut = np.flatnonzero(np.append(True, np.diff(wide[order]) > 0))
        for part in np.split(order, cut[1:]):
            second[wide[part[0]]] += z[part].T @ z[part]
        return np.concatenate([first.ravel(), second.ravel()])

    return count


def _step(sums: np.ndarray, w: np.ndarray, penalty: float) -> np.ndarray:
    """Newton's step for the mean loss of all pairs of a good and a bad text."""
    k = len(FIGURES)
    first = sums[: 2 * RANGES * (k + 1)].reshape(2, RANGES, k + 1).astype(float)
    second = sums[2 * RANGES * (k + 1) :].reshape(2, RANGES // SHARED, k, k) / (STEP * STEP)
    n, z = first[:, :, 0], first[:, :, 1:] / STEP
    bad, good = (np.flatnonzero(n[label]) for label in (0, 1))
    # the texts of a range count at their mean score
    s = [z[label, seen] @ w / n[label, seen] for label, seen in ((0, bad), (1, good))]
    p = 1 / (1 + np.exp(np.clip(s[1][:, None] - s[0][None, :], -60, 60)))
    q = p * (1 - p)
    n_bad, n_good = n[0, bad], n[1, good]
    pairs = n_bad.sum() * n_good.sum()
    gradient = -((p @ n_bad) @ z[1, good] - (n_good @ p) @ z[0, bad]) / pairs + penalty * w
    cross = z[1, good].T @ q @ z[0, bad]
    curve = -(cross + cross.T)
    for label, seen, weight in ((0, bad, n_good @ q), (1, good, q @ n_bad)):
        texts = np.bincount(seen // SHARED, n[label, seen], RANGES // SHARED)
        curve += np.tensordot(np.bincount(seen // SHARED, n[label, seen] * weight, RANGES // SHARED) / np.maximum(texts, 1), second[label], 1)
    return np.linalg.solve(curve / pairs + penalty * np.eye(k), gradient)


def _nth(rows: DataFrame, scorer: Scorer, n: int) -> float:
    """The n-th lowest raw score, from 0, by sixteen bits of all scores at a time."""
    top = 0

    def bits(x: np.ndarray) -> np.ndarray:
        # in the order of the scores; adding zero takes the sign off a zero
        raw = (scorer.raw(x) + 0.0).view(np.int64)
        return (raw ^ ((raw >> 63) & np.int64(2**63 - 1))).view(np.uint64) ^ np.uint64(1 << 63)

    for low in (48, 32, 16, 0):
        def count(x: np.ndarray, good: np.ndarray, low=low, top=top) -> np.ndarray:
            b = bits(x) >> np.uint64(low)
            return np.bincount((b[b >> np.uint64(16) == np.uint64(top)] & np.uint64(0xFFFF)).astype(np.int64), minlength=1 << 16)

        below = np.cumsum(_summed(rows, 1 << 16, count))
        at = int(np.searchsorted(below, n, side="right"))
        n -= int(below[at - 1]) if at else 0
        top = top << 16 | at
    key = np.array([top], dtype=np.uint64) ^ np.uint64(1 << 63)
    raw = key.view(np.int64)
    return float((raw ^ ((raw >> 63) & np.int64(2**63 - 1))).view(np.float64)[0])


def fit(rows: DataFrame, penalty: float = PENALTY) -> Scorer:
    """Bradley-Terry weights by Newton's method on all pairs of the rows (good boolean, x: their FIGURES)."""
    k = len(FIGURES)
    mean, scale, w = np.zeros(k), np.ones(k), np.zeros(k)

    def sums(x: np.ndarray, good: np.ndarray) -> np.ndarray:
        return np.concatenate([[len(x), good.sum()], np.rint(x * UNIT).astype(np.int64).sum(axis=0)])

    total = _summed(rows, 2 + k, sums)
    n, n_good = int(total[0]), int(total[1])
    if not n:
        return Scorer(mean, scale, w, 0.0)
    mean = total[2:] / (n * UNIT)
    scale = np.maximum(np.sqrt(_summed(rows, k, lambda x, _, m=mean: np.rint((x - m) ** 2 * UNIT).astype(np.int64).sum(axis=0)) / (n * UNIT)), 1e-6)
    if n_good in (0, n):
        return Scorer(mean, scale, w, 0.0)
    size = 2 * RANGES * (k + 1) + 2 * RANGES // SHARED * k * k
    for _ in range(25):
        step = _step(_summed(rows, size, _ranges(Scorer(mean, scale, w, 0.0), max(6 * np.abs(w).sum(), 1e-9))), w, penalty)
        w = w - step
        if np.abs(step).max() < 1e-4:
            break
    scorer = Scorer(mean, scale, w, 0.0)
    return Scorer(mean, scale, w, _nth(rows, scorer, -(-(n - 1) * (n - n_good) // n)))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> Scorer:
    """Learns from all labelled documents that are not held out. Their figures are written once; only sums of them reach the driver."""
    known = (labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("label"))
             .filter("doc_id IS NOT NULL AND label IS NOT NULL").filter(~held_out()).groupBy("doc_id").agg(F.min("label").alias("label")))
    texts = (docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter(~held_out()).join(known, "doc_id")
             .groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select((F.col("label") == 1).alias("good"), "text"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            x = figures(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("good"), pa.array(list(x), pa.list_(pa.float64()))], names=["good", "x"])

    rows = saved(texts.mapInArrow(measured, "good boolean, x array<double>"), "figures")
    return fit(rows.coalesce(max(1, -(-rows.count() // ROWS_A_TASK))))


def score(docs: DataFrame, scorer: Scorer, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scorer(batch.column("text")))], names=["doc_id", "score"])

    made = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(rows, f"doc_id {kind}, score double")
    return made.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
