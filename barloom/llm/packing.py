"""Packing into training sequences by power-of-two decomposition.

A document of n tokens is cut into pieces of `longest` tokens and then into the powers of two of the rest,
longest first. Every piece is a sequence of its own length, so no sequence crosses documents and nothing is
padded; sequences of equal length form a bucket, from which batches are drawn.

Defined cases: a null or empty text gives its end token alone; equal rows give equal pieces with sequences of their
own; a null doc_id is kept; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.arrays import IS_SPACE, flat, per_text, pieces, prefix_sums, span_hash

_LETTER, _MARK = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
_MARK[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) != "'"]] = True
# white space beyond ASCII, as UTF-8
_SPACES = tuple(chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))

LONGEST = 1024
END = 0
# most distinct chunks in a worker's cache; a full cache is emptied, which changes the time and not the result
CACHE = 2_000_000
# pieces of one (length, lane) are numbered together: a lane gets about one in LANES of a bucket
LANES = 4096


def pieces_of(n: int, longest: int = LONGEST) -> list[int]:
    """Lengths of the pieces of a document of n tokens."""
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 1, -1, -1) if (n % longest) >> k & 1]


def chunks(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts of chunks, first chunk of each text and the total, texts to encode as a whole).

    Chunks begin where byte-level pre-tokenisation always begins a new token: at ASCII white space that follows other
    characters, and at ASCII punctuation other than the apostrophe that follows a Latin letter. So the ids of a text are
    those of its chunks, one after another. Texts with rarer kinds of white space are encoded as a whole.
    """
    before, second = np.zeros(len(buf), dtype=np.uint8), np.zeros(len(buf), dtype=np.uint8)
    before[1:], second[2:] = buf[:-1], buf[:-2]
    letter = _LETTER[before] | ((second == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7))
    begins = (IS_SPACE[buf] & ~IS_SPACE[before]) | (_MARK[buf] & letter)
    begins[offsets[:-1][offsets[:-1] < len(buf)]] = True
    start = np.flatnonzero(begins)
    rare = np.zeros(len(buf), dtype=bool)
    rare |= (buf >= 0x1C) & (buf <= 0x1F)
    for at in np.flatnonzero((buf == 0xC2) | ((buf >= 0xE1) & (buf <= 0xE3))):
        rare[at] = bytes(buf[at : at + 3]).startswith(_SPACES)
    return start, np.searchsorted(start, offsets), per_text(rare, offsets) > 0


class Encoder:
    """Token ids by the tokenizers library, each distinct chunk once; chunks are known by a 64-bit hash of their bytes."""

    def __init__(self, path: str, most: int = CACHE):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.first, self.count = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.pool = np.zeros(0, dtype="<u4")

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        count = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        return np.fromiter(itertools.chain.from_iterable(ids), dtype="<u4", count=int(count.sum())), count

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        ids, count = self._encode(texts)
        first = np.cumsum(count) - count + len(self.pool)
        self.pool = np.concatenate([self.pool, ids])
        keys, first, count = (np.concatenate(x) for x in ((self.keys, keys), (self.first, first), (self.count, count)))
        order = np.argsort(keys, kind="stable")
        self.keys, self.first, self.count = keys[order], first[order], count[order]

    def __call__(self, column: pa.Array) -> list[np.ndarray]:
        buf, offsets = flat(column)
        if len(self.keys) > self.most:
            self.clear()
        start, first, whole = chunks(buf, offsets)
        end = np.append(start[1:], len(buf))
        keys, example, which = np.unique(span_hash(prefix_sums(buf), start, end), return_index=True, return_inverse=True)
        raw = buf.tobytes()
        at = np.searchsorted(self.keys, keys)
        known = self.keys[np.minimum(at, len(self.keys) - 1)] == keys if len(self.keys) else np.zeros(len(keys), dtype=bool)
        if not known.all():
            new = example[~known]
            self._learn(keys[~known], [raw[a:b].decode("utf-8", "replace") for a, b in zip(start[new].tolist(), end[new].tolist())])
            at = np.searchsorted(self.keys, keys)
        count = self.count[at][which]
        ends = np.cumsum(count)
        ids = self.pool[np.repeat(self.first[at][which] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.append(0, ends)[first]
        out = [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        for i in range(len(out)):
            text = raw[offsets[i] : offsets[i + 1]]
            if whole[i] or any(s in text for s in self.special):
                out[i] = self._encode([text.decode("utf-8", "replace")])[0]
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker, so that its cache lasts from task to task."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pack(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", longest: int = LONGEST, lanes: int = LANES) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary, little-endian unsigned 32-bit), ids_crc32, doc_tokens,
    sequence_id and offset.

    sequence_id is unique and holds the bucket (the power of two), the lane and the number in the lane, so a bucket is a
    range of ids. `longest` must be a power of two.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    kind = docs.schema[doc_id].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        end = np.array([END], dtype="<u4").tobytes()
        for batch in pieces(batches, "text"):
            row, start, length, total, ids, crc = [], [], [], [], [], []
            for i, found in enumerate(encode(batch.column("text"))):
                body = found.tobytes() + end
                n, at = len(body) // 4, 0
                for size in pieces_of(n, longest):
                    part = body[4 * at : 4 * (at + size)]
                    row.append(i), start.append(at), length.append(size), total.append(n)
                    ids.append(part), crc.append(zlib.crc32(part))
                    at += size
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length)),
                 pa.array(ids, pa.binary()), *(pa.array(x, pa.int64()) for x in (crc, total))],
                names=["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens"])

    made = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        cut, f"doc_id {kind}, start long, length long, ids binary, ids_crc32 long, doc_tokens long")
    return number(made, lanes)


def number(made: DataFrame, lanes: int = LANES) -> DataFrame:
    """Adds sequence_id and offset. A lane takes pieces by their place and content, so a hot document or copies of one
    text spread over the lanes of their bucket."""
    bucket = F.log2(F.col("length").cast("double")).cast("long")
    lane = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(lanes))
    in_lane = Window.partitionBy("_bucket", "_lane").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    return (made.withColumn("_bucket", bucket).withColumn("_lane", lane)
            .withColumn("_n", F.row_number().over(in_lane).cast("long"))
            .withColumn("sequence_id", F.shiftleft("_bucket", 56) + F.shiftleft("_lane", 40) + F.col("_n") - 1)
            .withColumn("offset", F.lit(0).cast("long"))
            .drop("_bucket", "_lane", "_n"))
