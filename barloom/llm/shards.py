"""A uniform shuffle into shards of exact size, by a communication matrix drawn from the hypergeometric distribution.

Rows are dealt into parts by a hash of their content. How many rows of each part go to each shard is drawn before any
row moves: in a uniform shuffle the matrix of these counts has the multivariate hypergeometric distribution
with the parts' sizes and the shards' sizes as its margins. Each part is then permuted on its own and its
first rows go to the first shard and so on; each shard is permuted again, in pieces, so no task holds a whole shard.

Only the counts of parts meet on the driver: one part for `PART` rows, at most `MOST_PARTS`, so matrix and broadcast are bounded. Texts are measured where they are
read and do not move.

Defined cases: a null text has size `extra` and the checksum of nothing; equal rows may go anywhere and are
counted one by one; null ids are dealt like others; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PART = 1_000
MOST_PARTS = 20_000


def sizes(rows: int, shards: int) -> np.ndarray:
    """Shard sizes at most one apart."""
    return np.full(shards, rows // shards) + (np.arange(shards) < rows % shards)


def communication_matrix(parts: list[int], shards: np.ndarray, seed: int) -> np.ndarray:
    """counts[part, shard]: rows of a part that go to a shard, exact in both margins."""
    rng = np.random.default_rng(seed)
    left, out = shards.astype(np.int64).copy(), np.zeros((len(parts), len(shards)), dtype=np.int64)
    for i, size in enumerate(parts):
        out[i] = rng.multivariate_hypergeometric(left, size, method="marginals")
        left -= out[i]
    return out


def _random(*columns: str, seed: int, tag: str) -> Column:
    return F.xxhash64(F.lit(f"{tag} {seed}"), *columns)


def shuffle(docs: DataFrame, shards: int, seed: int = 0, text: str = "text", doc_id: str = "doc_id", extra: int = 16,
            part: int = PART, most_parts: int = MOST_PARTS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (its place in the shard, gapless from 0) of every row."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + extra).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("text_crc32"))
    # a hot id is spread by its texts; what is equal in all three is one row many times
    content = ("doc_id", "size", "text_crc32")
    total = rows.count()
    parts = max(1, min(most_parts, -(-total // part)))
    dealt = rows.withColumn("part", F.pmod(_random(*content, seed=seed, tag="part"), F.lit(parts)))
    held = {r.part: r.n for r in dealt.groupBy("part").agg(F.count("*").alias("n")).collect()}
    matrix = communication_matrix([held.get(p, 0) for p in range(parts)], sizes(total, shards), seed)

    bounds = docs.sparkSession.range(1).select(F.posexplode(F.from_json(
        F.lit(json.dumps(np.cumsum(matrix, axis=1).tolist())), "array<array<long>>")).alias("part", "upto"))
    bounds = bounds.select(F.col("part").cast("long").alias("part"), "upto")
    in_part = Window.partitionBy("part").orderBy(_random(*content, seed=seed, tag="first"), *content)
    sent = (dealt.withColumn("nth", F.row_number().over(in_part)).join(F.broadcast(bounds), "part")
            .withColumn("shard", F.size(F.filter("upto", lambda u: u < F.col("nth"))).cast("int")).drop("upto", "nth", "part"))

    # the second permutation: pieces of a shard are ranges of one random number
    pieces = max(1, parts // shards)
    order = _random(*content, seed=seed, tag="second")
    placed = sent.withColumn("key", order).withColumn("piece", F.floor((F.shiftrightunsigned("key", 32) * pieces) / F.lit(1 << 32)).cast("long"))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "piece").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    in_piece = Window.partitionBy("shard", "piece").orderBy("key", *content)
    return (placed.withColumn("nth", F.row_number().over(in_piece)).join(starts, ["shard", "piece"])
            .select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("nth") - 1).alias("slot")))
