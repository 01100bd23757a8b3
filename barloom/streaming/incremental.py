"""Structured Streaming over new bar files: ingest, live features, dedup."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.clean import dedup_keep_last
from barloom.operators.datasets import last_n
from barloom.operators.layout import HALO
from barloom.schema import BAR_COLUMNS, BAR_SCHEMA
from barloom.streaming.store import EVERY, SHARDS, VersionedStore

BarsToFeatures = Callable[[DataFrame], DataFrame]


def new_bars(
    spark: SparkSession,
    landing: str,
    schema: str = BAR_SCHEMA,
    fmt: str = "csv",
    files_per_batch: int | None = 1000,
    newest_first: bool = False,
) -> DataFrame:
    """A stream of the files that arrive in a folder, some files a batch; the checkpoint of the query remembers what was read."""
    reader = spark.readStream.schema(schema).format(fmt).option("latestFirst", str(newest_first).lower())
    if fmt == "csv":
        reader = reader.option("header", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(landing)


def ingest(bars: DataFrame, path: str, checkpoint: str):
    """Append every unseen bar to a Parquet table, then stop."""
    return (
        bars.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )


def dedup_stream(bars: DataFrame, path: str, checkpoint: str):
    """Append every (Symbol, Date) once to a Parquet table, however late its copies arrive, then stop.

    Each batch is compared with the stored rows of the months it touches, so nothing is kept in memory between batches and
    no bar is too late. A batch that is run again replaces its own rows. Of copies within a batch the largest row stays.
    """
    schema = bars.schema

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        month = F.date_format("Date", "yyyy-MM").alias("month")
        new = dedup_keep_last(batch.filter("Symbol IS NOT NULL AND Date IS NOT NULL"), order=()).withColumn("month", month)
        if batch_id:
            stored = spark.read.schema(f"{_ddl(schema)}, batch long, month string").parquet(path).filter(F.col("batch") != batch_id)
            keys = stored.select("Symbol", "Date", "month").join(new.select("month").distinct(), "month", "left_semi")
            new = new.join(keys.select("Symbol", "Date").distinct(), ["Symbol", "Date"], "left_anti")
        new.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "month").parquet(path)

    return bars.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _ddl(schema) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


class LiveFeatures:
    """Keeps a feature table up to date with a stream of bars.

    Three stores hold the bars as they came, the features of every row that a batch changed, and the last rows of
    each symbol as context for its next bars. A batch reads the shards of its symbols and writes rows of no
    other symbol; stores are compacted as they grow. A batch that is run again replaces its own rows, so it
    changes nothing. Bars at or before the last known bar of their symbol make that symbol recompute from the
    stored bars of its shard.
    """

    def __init__(
        self, spark: SparkSession, store: str, compute: BarsToFeatures, history: int = HALO, lookahead: int = 1,
        shards: int = SHARDS, every: int = EVERY, months: int | None = None,
    ):
        """`lookahead` is how many rows back a new bar changes features (the future return: one). `months`: how many
        months of bars and features behind the newest are kept, all if not given."""
        self.compute, self.history, self.lookahead = compute, history, lookahead

        def kept(kind: str, keys: list[str], date: str | None) -> VersionedStore:
            return VersionedStore(spark, f"{store.rstrip('/')}/{kind}", keys, date, shards, every, months)

        self.bars, self.features, self.tail = kept("bars", ["Symbol", "Date"], "Date"), kept("features", ["Symbol", "Date"], "Date"), kept("tail", ["Symbol"], None)

    def step(self, batch: DataFrame, batch_id: int) -> None:
        new = dedup_keep_last(batch.select(*BAR_COLUMNS).filter("Symbol IS NOT NULL AND Date IS NOT NULL"), order=[])
        schema = _ddl(new.schema)
        # read back what was written, so that the batch is computed once
        new = self.bars.write(new, batch_id)
        first = new.groupBy("Symbol").agg(F.min("Date").alias("_first"))
        tail = self.tail.read(schema, batch_id, first)
        known = tail.groupBy("Symbol").agg(F.max("Date").alias("_known"))
        late = first.join(known, "Symbol").filter(F.col("_first") <= F.col("_known")).select("Symbol", "_first")
        if late.isEmpty():
            context = tail.unionByName(new)
        else:
            context = self._context_with_late(new, tail, first, late, schema, batch_id)
        older = context.join(first, "Symbol").filter(F.col("Date") < F.col("_first")).select("Symbol", "Date")
        open_rows = last_n(older, self.lookahead).groupBy("Symbol").agg(F.min("Date").alias("_open"))
        since = first.join(open_rows, "Symbol", "left").select("Symbol", F.coalesce("_open", "_first").alias("_since"))
        changed = self.compute(context).join(since, "Symbol").filter(F.col("Date") >= F.col("_since")).drop("_since")
        self.features.write(changed, batch_id)
        self.tail.write(last_n(context, self.history), batch_id)

    def _context_with_late(
        self, new: DataFrame, tail: DataFrame, first: DataFrame, late: DataFrame, schema: str, batch_id: int
    ) -> DataFrame:
        on_time = first.join(late, "Symbol", "left_anti").select("Symbol")
        from_tail = tail.join(on_time, "Symbol", "left_semi").unionByName(new.join(on_time, "Symbol", "left_semi"))
        stored = self.bars.read(schema, batch_id + 1, late).join(late, "Symbol")
        before = last_n(stored.filter(F.col("Date") < F.col("_first")), self.history)
        after = stored.filter(F.col("Date") >= F.col("_first"))
        return from_tail.unionByName(before.unionByName(after).select(*BAR_COLUMNS))

    def start(self, bars: DataFrame, checkpoint: str):
        return (
            bars.writeStream.foreachBatch(self.step)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )

    def read(self, schema: str) -> DataFrame:
        """The current feature rows: the latest version of each (Symbol, Date)."""
        return self.features.read(schema)
