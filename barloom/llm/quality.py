"""Quality rules by repetition coverage: how much of a text lies in repeated lines and n-grams.

Word n-grams are compared by rolling hashes over flat arrays of whole texts. Characters are UTF-8 bytes of words, so
white space weighs nothing.

Defined cases: a null text is an empty one, has no words and is rejected; lines and n-grams are compared within one
text only, so equal rows are judged alike; other columns and their nulls play no part; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.arrays import covered, flat, lines, owner, per_text, pieces, prefix_sums, repeated, repeated_ngrams, span_hash, within, words

# bytes of text taken at once: some thirty bytes of arrays for each
PIECE = 1 << 19
# characters whose number is reported
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass(frozen=True)
class Limits:
    """Largest shares that a kept text may have. Of the n-grams of 2 to 4 words the share of the most frequent one
    counts, of the longer ones that of all copies after the first. `symbol_share` is symbols per word."""

    min_words: int = 10
    window: int = 5
    repeat_percent: int = 20
    line_share: float = 0.40
    line_char_share: float = 0.20
    symbol_share: float = 0.50
    top: dict[int, float] = field(default_factory=lambda: {2: 0.28, 3: 0.26, 4: 0.24})
    repeats: dict[int, float] = field(default_factory=lambda: {6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10})


def measure(column: pa.Array, limits: Limits = Limits()) -> dict[str, np.ndarray]:
    """Figures of every text: counts, shares, base_failed and kept."""
    buf, offsets = flat(column)
    texts = len(offsets) - 1
    sums = prefix_sums(buf)
    start, end, first = words(buf, offsets)
    hashes = span_hash(sums, start, end)
    n_words = np.diff(first)
    whose = owner(first, len(start))
    # bytes of words before each word
    length = np.append(0, np.cumsum(end - start))
    chars = np.maximum(length[first[1:]] - length[first[:-1]], 1)
    points = np.append(0, np.cumsum((buf & 0xC0) != 0x80))
    point_length = np.append(0, np.cumsum(points[end] - points[start]))

    out = {
        "n_words": n_words,
        "word_chars": point_length[first[1:]] - point_length[first[:-1]],
        "n_symbols": per_text(SYMBOLS[buf], offsets),
    }

    grams = repeated_ngrams(hashes, first, {limits.window, *limits.top, *limits.repeats})
    at = grams[limits.window][1]
    inside = covered(len(start), at, at + limits.window)
    out["n_repeat_words"] = per_text(inside, first)

    line_start, line_end, line_first = lines(buf, offsets)
    with_word = np.searchsorted(start, line_start) < np.searchsorted(start, line_end)
    line_start, line_end = line_start[with_word], line_end[with_word]
    line_first = np.searchsorted(line_start, offsets)
    line_owner = owner(line_first, len(line_start))
    _, line_again = repeated(within(line_owner, span_hash(sums, line_start, line_end)))
    out["n_dup_lines"] = per_text(line_again, line_first)
    out["dup_line_share"] = out["n_dup_lines"] / np.maximum(np.diff(line_first), 1)
    line_chars = length[np.searchsorted(start, line_end)] - length[np.searchsorted(start, line_start)]
    out["dup_line_char_share"] = np.bincount(line_owner, line_chars * line_again, texts) / chars

    good = (out["dup_line_share"] <= limits.line_share) & (out["dup_line_char_share"] <= limits.line_char_share)
    out["symbol_share"] = out["n_symbols"] / np.maximum(n_words, 1)
    good &= out["symbol_share"] <= limits.symbol_share
    for n, most in limits.top.items():
        key, at, _ = grams[n]
        share = np.zeros(texts)
        if len(key):
            order = np.argsort(key)
            new = np.append(True, key[order][1:] != key[order][:-1])
            size = np.add.reduceat((length[at + n] - length[at])[order], np.flatnonzero(new))
            np.maximum.at(share, whose[at][order][new], size)
        out[f"top_{n}_share"] = share / chars
        good &= out[f"top_{n}_share"] <= most
    for n, most in limits.repeats.items():
        _, at, later = grams[n]
        inside = covered(len(start), at[later], at[later] + n)
        out[f"repeat_{n}_share"] = np.bincount(whose, (end - start) * inside, texts) / chars
        good &= out[f"repeat_{n}_share"] <= most

    out["base_failed"] = (n_words < limits.min_words) | (100 * out["n_repeat_words"] > limits.repeat_percent * n_words)
    out["kept"] = good & ~out["base_failed"]
    return out


_LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _shares(limits: Limits) -> list[str]:
    return ["dup_line_share", "dup_line_char_share", "symbol_share", *(f"top_{n}_share" for n in limits.top), *(f"repeat_{n}_share" for n in limits.repeats)]


def quality_figures(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", limits: Limits = Limits()) -> DataFrame:
    """doc_id, counts, shares, base_failed and kept, a row for each row of docs."""
    kind = docs.schema[doc_id].dataType.simpleString()
    names = [*_LONGS, *_shares(limits), "base_failed", "kept"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE):
            made = measure(batch.column("text"), limits)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(made[n]) for n in names)], names=["doc_id", *names])

    schema = ", ".join([f"doc_id {kind}", *(f"{n} long" for n in _LONGS), *(f"{n} double" for n in _shares(limits)), "base_failed boolean", "kept boolean"])
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(rows, schema)


def keep_good(docs: DataFrame, text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The rows whose text is kept, with all their columns as they are."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text, PIECE):
            yield batch.filter(pa.array(measure(batch.column(text), limits)["kept"]))

    return docs.mapInArrow(rows, docs.schema)
