"""Similarity join on word n-grams as a blocked sparse matrix product.

Rows of the matrix are distinct sets of n-grams (documents with equal sets are one row, linked by that), columns are
n-grams, dealt by hash into as many blocks as the sizes of two rows ask for: similarity t leaves two rows of a and b
columns at most d = (1 - t) / (1 + t) * (a + b) columns in which they differ, so of d + 1 blocks one holds the same columns in
both. Row blocks are multiplied only where their columns are the same, which they are in few rows that are not near
copies; pairs whose sizes cannot reach the similarity are dropped, and the overlap of the rest is accumulated over all columns.

The number of blocks depends on the size class of the smaller row, so a row is dealt once for its own class and once for each
lower one that may hold a partner. Blocks without columns say nothing: there are `spare` blocks more, and a row with more
empty blocks than that is dealt again by another hash, as both rows of a pair that could be missed are.

N-grams that a good share of all texts hold (`COMMON`), such as those of a line that many share, would connect unlike rows.
They are left out of the blocks: two rows differ in no more of the other columns, so the number of blocks stays enough, and a row
that has too few others, by its empty blocks, is dealt by single columns, the uncommon ones first. Which columns are common only
changes the work: every pair that reaches the similarity still shares a block.

Rows that blocks connect, directly or by others, form a cluster. Within clusters the overlap of all pairs of rows is
accumulated column block by column block, as a dense product for columns in many rows and pair by pair for columns in few.
Clusters of more than `SIDE` rows are dealt by size class and hash into tiles of about that many; tiles of equal
or neighbouring classes meet in pairs, each in a task of its own. A task passes on links that connect what it found
connected, no pairs, so large groups of near copies make no more rows than they have.

Defined cases: a text with fewer words than n is one n-gram of all its words; a text without words, or null, has
no n-grams, links with nothing and is a component of its own; equal rows link; rows with a null doc_id link with rows of
an equal set only and name no component that has another id; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.arrays import LOWER, flat, give_back, mix, ngrams, owner, pieces, prefix_sums, span_hash, words
from barloom.llm.components import components, release, saved

# blocks that a task makes before it passes them on, and n-grams that it counts at once
BATCH, COUNTED = 1 << 19, 1 << 21
# n-grams of all texts for each lane of blocks
LANE = 1 << 23
# rows in a tile of the product
SIDE = 1024
# clusters of at most so many tiles have all of them meet
TILES = 8
# share of the texts from which on an n-gram is common, and least number of them; at most so many n-grams are left out
COMMON, FEW, MOST = 1 / 2000, 50, 2_000_000
# bytes of text taken at once
PIECE = 1 << 19
# rows and columns of a tile that are looked at together
STRIP, COLUMNS = 256, 1024
# growth of the sizes from class to class, and tries by another hash before columns are taken one by one
GROWTH, TRIES = 1.3, 8


def incidence(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-grams of every text, distinct and in order; first of each text and the total; signature of each set)."""
    buf, offsets = flat(column)
    buf = LOWER[buf]
    start, end, first = words(buf, offsets)
    hashes = span_hash(prefix_sums(buf), start, end)
    count = np.diff(first)
    whose = owner(first, len(hashes))
    gram, at = ngrams(hashes, first, n)
    gram, doc = [gram], [whose[at]]
    for k in range(1, n):  # texts of k words
        short = np.flatnonzero(count == k)
        if len(short):
            h = np.full(len(short), k, dtype=np.uint64)
            for j in range(k):
                h = mix(h + hashes[first[short] + j])
            gram.append(h), doc.append(short)
    gram, doc = np.concatenate(gram), np.concatenate(doc)
    order = np.argsort(gram)
    small = doc[order].astype(np.uint16) if len(count) < 1 << 16 else doc[order]
    order = order[np.argsort(small, kind="stable")]
    gram, doc = gram[order], doc[order]
    new = np.ones(len(gram), dtype=bool)
    new[1:] = (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])
    gram, doc = gram[new], doc[new]
    first = np.searchsorted(doc, np.arange(len(count) + 1))
    sums = np.zeros(len(gram) + 1, dtype=np.uint64)
    np.cumsum(mix(gram ^ np.uint64(0x5851F42D4C957F2D)), out=sums[1:])
    return gram, first, mix(sums[first[1:]] - sums[first[:-1]])


def _signed(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """doc_id, n and row of every text; in rows of their own gram and held, n-grams that come three times or more in a batch of texts."""
    names = ["doc_id", "n", "row", "gram", "held"]
    grams, size = [], 0

    def often() -> pa.RecordBatch:
        every = np.concatenate(grams)
        grams.clear()
        every.sort()
        key = np.unique(every[2:][every[2:] == every[:-2]])
        count = np.searchsorted(every, key, side="right") - np.searchsorted(every, key)
        return pa.RecordBatch.from_arrays([pa.nulls(len(key), kind), *(pa.nulls(len(key), pa.int64()),) * 2, pa.array(key.view(np.int64)), pa.array(count)], names=names)

    kind = None
    for batch in pieces(batches, "text", PIECE):
        kind = batch.schema.field("doc_id").type
        gram, first, sign = incidence(batch.column("text"), n)
        none = pa.nulls(batch.num_rows, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(first)), pa.array(sign.view(np.int64)), none, none], names=names)
        grams.append(gram)
        size += len(gram)
        if size >= COUNTED:
            yield often()
            size = 0
    if grams:
        yield often()


def _common(noted: DataFrame, texts: int) -> np.ndarray:
    """The common n-grams in order. Their number is at most all n-grams of the texts / the least number of texts, and `MOST`."""
    least = max(FEW, int(COMMON * texts))
    held = noted.groupBy("gram").agg(F.sum("held").alias("held")).filter(F.col("held") >= least)
    rows = held.orderBy(F.desc("held"), "gram").limit(MOST).select("gram").toArrow()
    return np.sort(rows.column("gram").to_numpy().view(np.uint64))


class Blocks:
    """How many blocks the rows of a size class are dealt into."""

    def __init__(self, percent: int, largest: int):
        self.percent = percent
        # partners are of the same class or the next one
        growth = max(GROWTH, 100 / percent)
        low = [1]
        while low[-1] <= largest:
            low.append(max(low[-1] + 1, math.ceil(low[-1] * growth)))
        self.low = np.array(low)
        small = np.append(self.low[1:] - 1, self.low[-1])
        differ = (100 - percent) * (small + small * 100 // percent) // (100 + percent)
        count = differ + 1
        for _ in range(3):
            self.spare = np.ceil(count * np.exp(-self.low / count)).astype(np.int64) + 1
            count = differ + 1 + self.spare
        self.count = count

    def classes(self, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lowest, own) class of a row: those of its possible smaller partners and its own."""
        least = np.maximum(-(-self.percent * size // 100), 1)
        return np.searchsorted(self.low, least, side="right") - 1, np.searchsorted(self.low, size, side="right") - 1

    def deal(self, gram: np.ndarray, first: np.ndarray, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(block, row) of all blocks that hold columns; a block is known by its class, place and columns."""
        size = np.diff(first)
        usual = np.zeros(len(gram), dtype=bool)
        if common is not None and len(common):
            usual = common[np.minimum(np.searchsorted(common, gram), len(common) - 1)] == gram
        rare, first_rare = gram[~usual], np.append(0, np.cumsum(~usual))[first]
        lowest, own = self.classes(size)
        filled = np.flatnonzero(size > 0)
        todo_row, todo_class = filled, own[filled]
        back = 1
        while True:  # the lower classes
            more = filled[own[filled] - back >= lowest[filled]]
            if not len(more):
                break
            todo_row, todo_class = np.append(todo_row, more), np.append(todo_class, own[more] - back)
            back += 1
        keys, rows = [], []
        for attempt in range(TRIES):
            if not len(todo_row):
                break
            at, which = _members(first_rare, todo_row)
            k = self.count[todo_class]
            base = np.cumsum(k) - k
            salt = np.uint64(0xD1B54A32D192ED03 * (attempt + 1) & ((1 << 64) - 1))
            scrambled = mix(rare[at] ^ salt)
            place = base[which] + (scrambled % k[which].astype(np.uint64)).astype(np.int64)
            total = int(k.sum())
            sums = np.zeros(total, dtype=np.uint64)
            np.add.at(sums, place, mix(scrambled))
            held = np.bincount(place, minlength=total) > 0
            entry = np.repeat(np.arange(len(todo_row)), k)
            label = (todo_class[entry].astype(np.uint64) << np.uint64(40)) | (np.arange(total) - base[entry]).astype(np.uint64)
            keys.append(mix(sums + mix(label + salt))[held])
            rows.append(todo_row[entry][held])
            again = np.bincount(entry[~held], minlength=len(todo_row)) > self.spare[todo_class]
            todo_row, todo_class = todo_row[again], todo_class[again]
        if len(todo_row):  # columns in the order of their hashes, common ones last: two rows share one of the first of each
            at, which = _members(first, todo_row)
            at = at[np.lexsort((gram[at], usual[at], which))]
            n = size[todo_row]
            rank = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            early = rank < (n - -(-self.percent * n // 100) + 1)[which]
            keys.append(mix(gram[at[early]] + np.uint64(3)))
            rows.append(todo_row[which[early]])
        empty = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        return np.concatenate([*keys, empty[0]]), np.concatenate([*rows, empty[1]]).astype(np.int64)


def _members(first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of every n-gram of these rows, place of its row in rows)."""
    size = first[rows + 1] - first[rows]
    which = np.repeat(np.arange(len(rows)), size)
    return np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + first[rows][which], which


def _frugal(function: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The function of a group, after which free memory goes back to the machine."""

    def run(table: pa.Table) -> pa.Table:
        try:
            return function(table)
        finally:
            give_back()

    return run


def _shared(docs: DataFrame, n: int, blocks: Blocks, lanes: int, common: Broadcast) -> DataFrame:
    """(block, row) of the blocks that at least two rows have; a row is the signature of its set."""

    def emit(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        key, row = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((row, key))
        key, row = key[order], row[order]
        new = np.append(True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])) if len(key) else np.zeros(0, dtype=bool)
        key, row = key[new], row[new]
        lead = np.append(True, key[1:] != key[:-1]) if len(key) else new
        follow = np.append(~lead[1:], False) if len(key) else lead
        # rows that meet here are passed on as they are, with the first of them as the block's envoy
        met = ~lead | follow
        lane = ((key[lead] >> np.uint64(32)) % np.uint64(lanes)).astype(np.int64)
        order = np.argsort(lane, kind="stable")
        lane, key_, row_ = lane[order], key[lead][order], row[lead][order]
        at = np.searchsorted(lane, np.arange(lanes + 1))
        key, row = key[met], row[met]
        own = [(-1 - k, key[k::lanes], row[k::lanes]) for k in range(min(lanes, len(key)))]
        parts = [*((k, key_[a:b], row_[a:b]) for k, (a, b) in enumerate(zip(at[:-1], at[1:]))), *own]
        parts = [p for p in parts if len(p[1])]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int64()), *(pa.array([p[i].tobytes() for p in parts], pa.binary()) for i in (1, 2))],
                                         names=["lane", "block", "row"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in pieces(batches, "text", PIECE):
            gram, first, sign = incidence(batch.column("text"), n)
            key, row = blocks.deal(gram, first, common.value)
            held.append((key, sign[row]))
            count += len(key)
            if count >= BATCH:
                yield from emit(held)
                held, count = [], 0
        if held:
            yield from emit(held)

    def join(table: pa.Table) -> pa.Table:
        key, row = (flat(table.column(name).combine_chunks())[0].view("<u8") for name in ("block", "row"))
        if table.column("lane")[0].as_py() >= 0:
            order = np.lexsort((row, key))
            key, row = key[order], row[order]
            edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            several = row[edge] != row[np.append(edge[1:], len(key)) - 1]
            keep = np.repeat(several, np.diff(np.append(edge, len(key))))
            keep[1:] &= (key[1:] != key[:-1]) | (row[1:] != row[:-1])
            key, row = key[keep], row[keep]
        return pa.table({"block": key.view(np.int64), "row": row.view(np.int64)})

    return docs.mapInArrow(split, "lane long, block binary, row binary").groupBy("lane").applyInArrow(_frugal(join), "block long, row long").distinct()


def connected(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the smallest place of a set that it reaches by links. sets: sorted distinct n-grams, none empty."""
    rows = len(sets)
    size = np.array([len(x) for x in sets])
    gram = np.concatenate(sets)
    order = np.argsort(gram, kind="stable")
    gram, row = gram[order], np.repeat(np.arange(rows), size)[order]
    edge = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
    count = np.diff(np.append(edge, len(gram)))
    overlap = np.zeros((rows, rows), dtype=np.float32)
    for c in range(2, min(rows, 8) + 1):
        members = row[edge[count == c][:, None] + np.arange(c)]
        for i in range(c):
            for j in range(i + 1, c):
                np.add.at(overlap, (members[:, i], members[:, j]), 1)
    many = np.flatnonzero(count > 8)
    for at in range(0, len(many), COLUMNS):
        columns = many[at : at + COLUMNS]
        block = np.zeros((rows, len(columns)), dtype=np.float32)
        block[row[np.concatenate([np.arange(edge[c], edge[c] + count[c]) for c in columns])], np.repeat(np.arange(len(columns)), count[columns])] = 1
        for i in range(0, rows, STRIP):
            overlap[i : i + STRIP, i:] += block[i : i + STRIP] @ block[i:].T
    # the half above the diagonal counts; a strip of rows at a time, so that a tile is held once
    linked = np.zeros((rows, rows), dtype=bool)
    for i in range(0, rows, STRIP):
        common = overlap[i : i + STRIP].astype(np.float64)
        linked[i : i + STRIP] = np.triu(100 * common >= percent * (size[i : i + STRIP, None] + size - common), i + 1)
    linked |= linked.T
    np.fill_diagonal(linked, True)
    label = np.arange(rows)
    while True:
        least = np.concatenate([np.where(linked[i : i + STRIP], label, rows).min(axis=1) for i in range(0, rows, STRIP)])
        if (least == label).all():
            return label
        label = least


def _tiles(rows: DataFrame, shared: DataFrame, blocks: Blocks, lanes: int, side: int) -> DataFrame:
    """(row, tasks): the tasks that need the row's set. rows: row, n, cluster; shared: block, row.

    A task is (lane, cluster, c, i, d, j): a lane of small clusters, or tile i of class c and tile j of class d of a large one.
    In a cluster of more than `TILES` tiles a row goes only where its tile meets one with a row that shares a block with it.
    """
    low = F.array(*(F.lit(int(x)) for x in blocks.low))
    classed = rows.withColumn("c", F.size(F.filter(low, lambda x: x <= F.col("n"))) - 1)
    counts = classed.groupBy("cluster", "c").agg(F.count("*").alias("rows"))
    large = counts.groupBy("cluster").agg(F.sum("rows").alias("all")).filter(F.col("all") > side)
    counts = counts.join(large, "cluster").select("cluster", "c", F.ceil(F.col("rows") / side).alias("t"))
    # read by several joins below: written, so that their plans don't hold them again and again
    counts = saved(counts, "sizes")

    every = counts.withColumn("each", F.sequence(F.lit(0), F.col("t") - 1))
    every = every.select("cluster", F.transform("each", lambda i: F.struct("c", i.cast("int").alias("i"))).alias("own"))
    some = counts.groupBy("cluster").agg(F.sum("t").alias("all")).filter(F.col("all") <= TILES).select("cluster")
    # at most TILES of them
    every = every.join(some, "cluster").groupBy("cluster").agg(F.flatten(F.collect_list("own")).alias("tiles"))

    placed = classed.join(counts, ["cluster", "c"]).select("row", "cluster", "c", F.pmod(F.xxhash64("row"), "t").cast("int").alias("i"))
    placed = saved(placed, "placed")
    few = placed.join(every, "cluster")
    entries = shared.join(placed.join(some, "cluster", "left_anti"), "row")
    # at most as many tiles as the cluster has
    met = entries.groupBy("block").agg(F.collect_set(F.struct("c", "i")).alias("tiles"))
    wide = entries.join(met, "block").groupBy("row", "cluster", "c", "i").agg(F.array_distinct(F.flatten(F.collect_list("tiles"))).alias("tiles"))

    def task(tile: F.Column) -> F.Column:
        own = F.struct(F.col("c").cast("int").alias("c"), F.col("i").alias("i"))
        tile = F.struct(tile.c.cast("int").alias("c"), tile.i.alias("i"))
        a, b = F.least(own, tile), F.greatest(own, tile)
        return F.struct(F.lit(-1).cast("long").alias("lane"), F.col("cluster").alias("cluster"), a.c.alias("c"), a.i.alias("i"), b.c.alias("d"), b.i.alias("j"))

    def near(tile: F.Column) -> F.Column:
        return F.abs(tile.c - F.col("c")) <= 1

    wide = wide.unionByName(few.select("row", "cluster", "c", "i", "tiles"))
    dealt = wide.select("row", F.transform(F.filter("tiles", near), task).alias("tasks"))
    zero = F.lit(0)
    lane = F.pmod(F.xxhash64("cluster"), F.lit(lanes))
    small = classed.join(large, "cluster", "left_anti").select(
        "row", F.array(F.struct(lane.alias("lane"), F.col("cluster"), zero.alias("c"), zero.alias("i"), zero.alias("d"), zero.alias("j"))).alias("tasks"))
    return dealt.unionByName(small)


def _links(docs: DataFrame, tiles: DataFrame, named: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) that connect the rows which the similarity connects within a task."""
    some = named.filter("doc_id IS NOT NULL").join(tiles, "row").select("doc_id", F.col("row").alias("_row"), "tasks")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE):
            gram, first, sign = incidence(batch.column("text"), n)
            # rows of one id may have other texts
            right = pa.array(sign.view(np.int64) == batch.column("_row").to_numpy())
            blobs = pa.array([gram[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("tasks"), blobs], names=["row", "tasks", "grams"]).filter(right)

    def product(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("cluster").to_numpy(), kind="stable")
        cluster, row = (table.column(name).to_numpy()[order] for name in ("cluster", "row"))
        blobs = table.column("grams").combine_chunks()
        edge = np.flatnonzero(np.append(True, cluster[1:] != cluster[:-1]))
        a, b = [], []
        for x, y in zip(edge.tolist(), np.append(edge[1:], len(cluster)).tolist()):
            # a row with repeated ids comes more than once
            own, at = np.unique(row[x:y], return_index=True)
            if len(own) > 1:
                label = connected([np.frombuffer(blobs[order[x + k]].as_buffer(), "<u8") for k in at.tolist()], percent)
                joined = np.flatnonzero(label != np.arange(len(own)))
                a.append(own[joined]), b.append(own[label[joined]])
        none = np.zeros(0, dtype=np.int64)
        return pa.table({"a": np.concatenate([*a, none]), "b": np.concatenate([*b, none])})

    kind = "array<struct<lane:bigint,cluster:bigint,c:int,i:int,d:int,j:int>>"
    dealt = docs.join(some, "doc_id").mapInArrow(sets, f"row long, tasks {kind}, grams binary").select("row", "grams", F.inline("tasks"))
    hot = F.when(F.col("lane") < 0, F.col("cluster")).otherwise(0)
    return dealt.groupBy("lane", hot.alias("hot"), "c", "i", "d", "j").applyInArrow(_frugal(product), "a long, b long")


def similar(docs: DataFrame, n: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id", side: int = SIDE) -> DataFrame:
    """doc_id, n_shingles and component_id of every document, linked where 100 * overlap >= percent * union."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    written = saved(docs.mapInArrow(lambda batches: _signed(batches, n), f"doc_id {kind}, n long, row long, gram long, held long"), "signed")
    signed = written.filter("n IS NOT NULL").select("doc_id", "n", "row")
    total, largest, texts = signed.agg(F.sum("n"), F.max("n"), F.count("n")).first()
    common = spark.sparkContext.broadcast(_common(written.filter("gram IS NOT NULL"), texts))
    named = saved(signed.filter("n > 0").groupBy("row").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n")), "rows")
    plan = Blocks(percent, largest or 0)
    lanes = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total or 0) // LANE))
    blocks = saved(_shared(docs, n, plan, lanes, common), "blocks")
    common.destroy()
    release(spark)

    least = blocks.groupBy("block").agg(F.min("row").alias("b"))
    clusters = components(blocks.join(least, "block").select(F.col("row").alias("a"), "b"))
    rows = clusters.withColumnsRenamed({"node": "row", "root": "cluster"}).join(named.select("row", "n"), "row")
    rows = saved(rows, "clusters")
    release(spark)
    tiles = saved(_tiles(rows, blocks, plan, 4 * lanes, side), "tiles")
    release(spark)
    roots = components(saved(_links(docs, tiles, named, n, percent), "links"))
    release(spark)

    whole = named.join(roots.withColumnRenamed("node", "row"), "row", "left").select("row", "doc_id", F.coalesce("root", "row").alias("root"))
    smallest = whole.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    labels = whole.join(smallest, "root").select("row", "component_id")
    some, none = signed.filter("n > 0"), signed.filter("n = 0")
    return some.join(labels, "row", "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(
        none.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs without those that are linked with a document of a smaller id, and one of rows with equal id.

    Rows with a null id cannot be told apart; they are kept as they are and drive nothing out.
    """
    named = docs.filter(F.col(doc_id).isNotNull())
    found = similar(named, n, percent, text, doc_id)
    first = found.filter("doc_id = component_id").select(F.col("doc_id").alias(doc_id)).distinct()
    mark = "_nth"
    while mark in docs.columns:
        mark = f"_{mark}"
    nth = F.row_number().over(Window.partitionBy(doc_id).orderBy(text))
    kept = named.join(first, doc_id, "left_semi").withColumn(mark, nth).filter(F.col(mark) == 1)
    return kept.select(*docs.columns).unionByName(docs.filter(F.col(doc_id).isNull()))
