"""Exact substring deduplication by a distributed difference cover, with hashes for names.

Two equal strings of `length` bytes at places i and j have a shift d < period such that i + d and j + d both lie
in the difference cover, so it is enough to name the sampled places, a few in a hundred:

1. Sampled places are named by the length - period + 1 bytes that follow; equal names meet, names that are alone are settled.
2. Only places within a period before a sample whose name is not alone can begin a repeated string. They are named by all
   their `length` bytes, and equal names are the repeated strings.

This takes the cover and the two depths of names from the suffix sort, but not its order: names are hashes, so no triples are
ranked, nothing is recursed on and no neighbours are compared. Equality at `length` bytes needs no order among unequal
strings, and the sort itself moves the bytes of every sampled suffix; the README has the measured figures.

A name is a hash of the bytes: 32 bits beside the lane for the samples, where a false meeting costs a comparison only,
and 64 bits of one hash beside a lane by another for the strings themselves. Names whose 64 bits are equal are brought together
within a task before they are shuffled, so a string that very many documents hold is sent once for each batch of a task.
What is found out about a text goes back to its copies by (text, salt), so copies of one text do not share a task.

Texts that are equal as a whole are covered wherever they are as long as a string; their places count as those of one text.

Defined cases: a null text is an empty one, of 0 bytes and nothing removed; equal rows are covered by one another; a null
doc_id is kept; a text shorter than `length` bytes keeps everything; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.arrays import covered, flat, mix, owner, pieces, prefix_sums, span_hash
from barloom.llm.components import release, saved

LENGTH = 400
# the cover's prime: 14 of every 183 places are sampled
PRIME = 13
# tasks that the copies of one text are dealt to
SALTS = 16
# names that a task holds before it passes them on
BATCH = 1 << 21


@cache
def difference_cover(q: int) -> tuple[int, ...]:
    """q + 1 places among q * q + q + 1 such that every shift is the difference of two of them, for a prime q.

    Singer's construction: x generates the field of q^3 elements, and the powers of x without a square term are the places.
    """
    period = q * q + q + 1
    for a, b, c in itertools.product(range(q), repeat=3):
        u = (0, 0, 1)  # coefficients of x^2, x and 1
        places = []
        for i in range(period):
            if u[0] == 0:
                places.append(i)
            u = (u[1] + a * u[0]) % q, (u[2] + b * u[0]) % q, c * u[0] % q
        if len({(m - n) % period for m in places for n in places}) == period and len(places) == q + 1:
            return tuple(places)
    raise ValueError("q must be a prime")


def _other_hash(buf: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """A second hash of the strings of one length, of other multiples of the bytes."""
    return span_hash(prefix_sums(mix(buf.astype(np.uint64) + np.uint64(0x7F4A7C15))), start, start + length)


def _several(key: np.ndarray, text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a name stands at more than one place; the same place in copies of a text is one."""
    out = np.zeros(len(key), dtype=bool)
    ordered = np.sort(key)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if len(twice):
        many = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key)
        many = many[np.argsort(key[many], kind="stable")]
        place = mix(text[many] + at[many].astype(np.uint64))
        edge = np.flatnonzero(np.append(True, key[many][1:] != key[many][:-1]))
        differ = np.minimum.reduceat(place, edge) != np.maximum.reduceat(place, edge)
        out[many[np.repeat(differ, np.diff(np.append(edge, len(many))))]] = True
    return out


def _packed(steps: np.ndarray) -> bytes:
    """Steps as two bytes each; those that need more follow after the mark 65535."""
    far = steps >= 65535
    return len(steps).to_bytes(8, "little") + np.where(far, 65535, steps).astype("<u2").tobytes() + steps[far].astype("<u4").tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    steps = np.frombuffer(raw, "<u2", n, 8).astype(np.int64)
    steps[steps == 65535] = np.frombuffer(raw, "<u4", -1, 8 + 2 * n)
    return steps


def _runs(text: np.ndarray, at: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Places in order as (texts, number of places of each, steps that begin anew with each text)."""
    run = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    step = np.diff(at, prepend=0)
    step[run] = at[run]
    return text[run].tobytes(), np.diff(np.append(run, len(text))).astype("<u4").tobytes(), _packed(step)


def _places(step: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Places from their steps."""
    first = np.cumsum(count) - count
    total = np.cumsum(step)
    return total - np.repeat(total[first] - step[first], count)


Places = Callable[[pa.RecordBatch, np.ndarray], np.ndarray]


def _meet(texts: DataFrame, places: Places, length: int, narrow: bool, lanes: int) -> DataFrame:
    """(h, places): the places whose string of `length` bytes begins at another place too. texts: h, text and what places() reads.

    places(batch, offsets) gives the positions to look at in the batch's bytes, in order; strings that do not fit are left out.
    """
    width = "<u4" if narrow else "<u8"
    # what is found is gathered by text, many texts to a shelf
    shelves = max(16, lanes // 8)

    def emit(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        name, lane, text, at = (np.concatenate(x) for x in zip(*held))
        # whole hashes are compared here: strings of one short name may lie in different lanes, and each lane needs its envoy
        met = _several(name, text, at)
        sent = ~met
        if met.any():  # one envoy for each name that met here
            where = np.flatnonzero(met)
            sent[where[np.unique(name[where], return_index=True)[1]]] = True
        key = name & np.uint64(0xFFFFFFFF) if narrow else name
        rows = []
        for kind, chosen in ((0, np.flatnonzero(sent)), (1, np.flatnonzero(met))):
            # found places are dealt out by text, names by lane
            to = lane[chosen] if kind == 0 else (text[chosen] % np.uint64(lanes)).astype(np.uint16)
            order = chosen[np.argsort(to, kind="stable")]
            to = np.sort(to)
            cut = np.searchsorted(to, np.arange(lanes + 1))
            for k in np.flatnonzero(np.diff(cut)).tolist():
                part = order[cut[k] : cut[k + 1]]
                rows.append((k if kind == 0 else -1 - k, *_runs(text[part], at[part]), key[part].astype(width).tobytes() if kind == 0 else b""))
        if rows:
            lane_, *blobs = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(lane_, pa.int64()), *(pa.array(b, pa.binary()) for b in blobs)], names=["lane", "texts", "counts", "steps", "keys"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, seen = [], 0, set()
        for batch in pieces(batches, "text"):
            # copies of a text that this batch of names holds already add nothing
            new = [h not in seen and not seen.add(h) for h in batch.column("h").to_pylist()]
            batch = batch.filter(pa.array(new))
            buf, offsets = flat(batch.column("text"))
            whose = owner(offsets, len(buf))
            at = places(batch, offsets)
            at = at[at + length <= offsets[1:][whose[at]]] if len(at) else at
            # long texts are passed on in parts, so that memory depends on the batch
            sums = prefix_sums(buf)
            full = span_hash(sums, at, at + length)
            other = full if narrow else _other_hash(buf, at, length)
            h = batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64)
            held.append((full, ((other >> np.uint64(40)) % np.uint64(lanes)).astype(np.uint16), h[whose[at]], (at - offsets[:-1][whose[at]]).astype(np.int64)))
            count += len(at)
            if count >= BATCH:
                yield from emit(held)
                held, count, seen = [], 0, set()
        if held:
            yield from emit(held)

    def join(table: pa.Table) -> pa.Table:
        blobs = [[np.frombuffer(x, kind) for x in table.column(name).to_pylist()] for name, kind in (("texts", "<u8"), ("counts", "<u4"), ("keys", width))]
        text, count, key = (np.concatenate(b) for b in blobs)
        step = np.concatenate([_unpacked(x) for x in table.column("steps").to_pylist()])
        at = _places(step, count.astype(np.int64))
        if table.column("lane")[0].as_py() >= 0:
            found = _several(key, np.repeat(text, count), at)
        else:
            found = np.ones(len(at), dtype=bool)
        text, at = np.repeat(text, count)[found], at[found]
        to = (text % np.uint64(shelves)).astype(np.int64)
        order = np.lexsort((at, text, to))
        to, text, at = to[order], text[order], at[order]
        cut = np.searchsorted(to, np.arange(shelves + 1))
        rows = [(k, *_runs(text[a:b], at[a:b])) for k, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())) if b > a]
        return pa.table({n: pa.array([r[i] for r in rows], kind) for i, (n, kind) in enumerate((("shelf", pa.int64()), ("texts", pa.binary()), ("counts", pa.binary()), ("steps", pa.binary())))})

    def gather(table: pa.Table) -> pa.Table:
        text, count = (np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist()]) for name, kind in (("texts", "<u8"), ("counts", "<u4")))
        at = _places(np.concatenate([_unpacked(x) for x in table.column("steps").to_pylist()]), count.astype(np.int64))
        text = np.repeat(text, count)
        order = np.lexsort((at, text))
        text, at = text[order], at[order]
        new = np.append(True, (text[1:] != text[:-1]) | (at[1:] != at[:-1]))
        text, at = text[new], at[new]
        edge = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        return pa.table({"h": text[edge].view(np.int64), "places": pa.array([_packed(np.diff(x, prepend=0)) for x in np.split(at, edge[1:])], pa.binary())})

    made = texts.mapInArrow(split, "lane long, texts binary, counts binary, steps binary, keys binary")
    found = made.groupBy("lane").applyInArrow(join, "shelf long, texts binary, counts binary, steps binary")
    return found.groupBy("shelf").applyInArrow(gather, "h long, places binary")


def _listed(column: pa.Array, row: int) -> np.ndarray:
    """The places of a row, in order."""
    return np.cumsum(_unpacked(column[row].as_py()))


def remove_repeats(docs: DataFrame, length: int = LENGTH, prime: int = PRIME, text: str = "text", doc_id: str = "doc_id", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row, with_text also the remaining bytes (kept)."""
    period = prime * prime + prime + 1
    if period > length:
        raise ValueError("the cover's period must not be longer than the strings")
    spark = docs.sparkSession
    read = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    read = read.withColumn("h", F.xxhash64("text", F.lit(17)))
    facts = saved(read.select("doc_id", "h", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "facts")
    total = facts.agg(F.sum("n_bytes")).first()[0] or 0
    lanes = min(60_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (8 * BATCH))))

    classes = facts.filter(F.col("n_bytes") >= length).groupBy("h", "sha").agg(F.count("*").alias("n")).filter("n > 1")
    single = read.filter(F.octet_length("text") >= length).select("h", "text")

    cover = np.zeros(period, dtype=bool)
    cover[list(difference_cover(prime))] = True

    def sampled(batch: pa.RecordBatch, offsets: np.ndarray) -> np.ndarray:
        size = int(offsets[-1])
        return np.flatnonzero(cover[(np.arange(size) - offsets[:-1][owner(offsets, size)]) % period])

    flags = saved(_meet(single, sampled, length - period + 1, True, lanes), "samples")
    release(spark)
    texts = saved(single.join(flags, "h").dropDuplicates(["h"]), "texts")
    release(spark)

    def near(batch: pa.RecordBatch, offsets: np.ndarray) -> np.ndarray:
        out = []
        for i in range(batch.num_rows):
            at = _listed(batch.column("places"), i) + offsets[i]
            out.append(offsets[i] + np.flatnonzero(covered(int(offsets[i + 1] - offsets[i]), np.maximum(at - period + 1 - offsets[i], 0), at + 1 - offsets[i])))
        return np.concatenate([*out, np.zeros(0, dtype=np.int64)])

    found = saved(_meet(texts, near, length, False, lanes), "strings")
    release(spark)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            rows = []
            for i in range(batch.num_rows):
                raw = np.frombuffer(batch.column("text")[i].as_buffer(), dtype=np.uint8)
                at = _listed(batch.column("places"), i)
                gone = covered(len(raw), at, at + length)
                kept = raw[~gone].tobytes()
                rows.append((int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            yield pa.RecordBatch.from_arrays([batch.column("h"), *(pa.array(x, kind) for x, kind in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.binary())))],
                                             names=["h", "n_removed", "n_spans", "kept_sha256", "kept"])

    changed = texts.select("h", "text").join(found, "h").mapInArrow(cut, "h long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    if with_text:
        facts = read.select("doc_id", "h", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"), "text")

    def for_all(df: DataFrame) -> DataFrame:
        return df.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))

    # by the place of the row in its file: the same when a task is run again
    facts = facts.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    rows = facts.join(for_all(changed), ["h", "_salt"], "left").join(
        for_all(classes.select("h", "sha", F.lit(True).alias("copied"))), ["h", "sha", "_salt"], "left")
    whole = F.col("copied").isNotNull()
    out = [
        "doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256")]
    if with_text:
        out.append(F.when(whole, F.lit(b"")).otherwise(F.coalesce("kept", F.encode("text", "UTF-8"))).alias("kept"))
    return rows.select(*out)
