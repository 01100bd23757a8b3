"""Texts of an Arrow batch as flat numpy arrays: bytes, words, n-grams and their hashes.

A batch is cut into pieces of about `PIECE` bytes of text (one row at least), so that the memory of a
task depends on the longest text and not on the number of rows. Every function sees whole texts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 21
_BASE = 0x9E3779B97F4A7C15 | 5  # odd, so that it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches of at most `size` bytes of text, or one row."""
    try:
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths, dtype=np.int64)
            at = 0
            while at < batch.num_rows:
                done = ends[at - 1] if at else 0
                upto = max(at + 1, int(np.searchsorted(ends, done + size, side="right")))
                yield batch.slice(at, upto - at)
                at = upto
    finally:
        give_back()


def give_back() -> None:
    """Memory that is free goes back to the machine: Python workers live on between tasks, beside the executor's own memory."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets): text i is bytes[offsets[i]:offsets[i + 1]]. A null text is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def _power(base: int, size: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < size:
        # few sizes, so that they are seldom made again, and none much larger than what is asked for
        steps = np.full((size | 0xFFFF) + 1, base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:size]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums of value[j] * base^j before each position, modulo 2^64."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(values)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end], the same wherever the span stands."""
    return mix((sums[end] - sums[start]) * _power(_INVERSE, len(sums))[start] + (end - start).astype(np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true positions that cross no text: (starts, ends, first run of each text and the total)."""
    before, after = np.zeros(len(inside), dtype=bool), np.zeros(len(inside), dtype=bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(inside))]
    before[edge], after[edge - 1] = False, False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, offsets)


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of every text: (starts, ends, first word of each text and the total)."""
    return spans(~IS_SPACE[buf], offsets)


def lines(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines of every text that are not empty, split at line feeds."""
    return spans(buf != 0x0A, offsets)


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, first word of each text and the total)."""
    start, end, first = words(buf, offsets)
    return span_hash(prefix_sums(buf), start, end), first


def ngrams(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position of the first word) of all windows of n words that lie in one text."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    count = np.diff(first)
    inside = np.ones(len(hashes), dtype=bool)
    for back in range(1, n):  # the last n - 1 words of a text begin no window
        has = first[1:][count >= back] - back
        inside[has] = False
    at = np.flatnonzero(inside)
    h = np.full(len(at), n, dtype=np.uint64)
    for k in range(n):
        h = h * np.uint64(_BASE) + hashes[at + k]
    return mix(h), at


def owner(first: np.ndarray, size: int) -> np.ndarray:
    """Text number of each of `size` items, from the first item of each text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first)) if size else np.zeros(0, dtype=np.int64)


def within(group: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Hashes of values that also tell groups apart."""
    return mix(values + mix(group.astype(np.uint64) + np.uint64(_BASE)))


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it comes more than once, and whether it came before."""
    many, later = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if len(twice):
        many = twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys
        at = np.flatnonzero(many)
        order = np.argsort(keys[at], kind="stable")
        again = keys[at][order]
        later[at[order[1:]]] = again[1:] == again[:-1]
    return many, later


def repeated_ngrams(hashes: np.ndarray, first: np.ndarray, sizes: set[int]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By n: (key, position of the first word, whether it came before) of the n-grams that come twice or more in their own text.

    An n-gram can only be repeated where both its shorter ones are, so each size looks at the rest of the one before.
    """
    whose = owner(first, len(hashes))
    out = {}
    alive = np.ones(len(hashes), dtype=bool)
    h = within(whose, hashes)
    for n in range(2, max(sizes) + 1):
        at = np.flatnonzero(alive[:-1] & alive[1:] & (whose[n - 1 :] == whose[: len(whose) - n + 1])[: len(alive) - 1]) if len(alive) > 1 else np.zeros(0, dtype=np.int64)
        # h[i] is the key of the (n-1)-gram at i
        key = mix(h[at] * np.uint64(_BASE) + hashes[at + n - 1])
        many, later = repeated(key)
        key, at = key[many], at[many]
        out[n] = key, at, later[many]
        alive = np.zeros(max(len(alive) - 1, 0), dtype=bool)
        alive[at] = True
        h = np.zeros(len(alive), dtype=np.uint64)
        h[at] = key
    return {n: out[n] for n in sizes}


def covered(size: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """True for positions in at least one of the spans."""
    step = np.bincount(start, minlength=size + 1) - np.bincount(end, minlength=size + 1)
    return np.cumsum(step[:-1]) > 0


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of true flags in each text."""
    sums = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]
