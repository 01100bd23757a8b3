"""Streaming jobs run to the end over the bars as files; each must give what the batch query gives."""

from pyspark.sql import functions as F

from barloom.catalog.base import BARS_SHOWN, EVENTS_BARS, LIVE_SHOWN, live_ctes, query, strict, with_ctes
from barloom.plans import features
from barloom.schema import BAR_COLUMNS
from barloom.sources.adapters import events_bars
from barloom.sources.writers import scratch_dir
from barloom.streaming import incremental as inc
from barloom.streaming.averages import RunningAverages

HOURLY = "Symbol string, Date timestamp, Open double, High double, Low double, Close double, Volume double"


def _arrivals(spark, sf_dir, path, slices=3):
    """Land the bars in a folder, one slice of time after the other; yields after each."""
    bars = events_bars(spark, sf_dir).select(*BAR_COLUMNS)
    age = F.unix_timestamp("Date")
    first, last = bars.agg(F.min(age), F.max(age)).first()
    width = (last - first + 1) / slices
    for i in range(slices):
        bars.filter(F.floor((age - first) / width) == i).write.mode("append").csv(path, header=True)
        yield i


@query("incremental_bars", with_ctes({"bars": EVENTS_BARS}, BARS_SHOWN, "SELECT * FROM bars"))
def incremental_bars(spark, sf_dir):
    root = scratch_dir(spark)
    for _ in _arrivals(spark, sf_dir, f"{root}/landing"):
        stream = inc.new_bars(spark, f"{root}/landing", HOURLY)
        inc.ingest(stream, f"{root}/bars", f"{root}/checkpoint").awaitTermination()
    return spark.read.schema(HOURLY).parquet(f"{root}/bars")


@query("live_feature_stream", with_ctes(live_ctes(EVENTS_BARS), LIVE_SHOWN, "SELECT * FROM l"))
def live_feature_stream(spark, sf_dir):
    root = scratch_dir(spark)
    job = inc.LiveFeatures(spark, f"{root}/store", features.live_features)
    for _ in _arrivals(spark, sf_dir, f"{root}/landing"):
        job.start(inc.new_bars(spark, f"{root}/landing", HOURLY), f"{root}/checkpoint").awaitTermination()
    schema = features.live_features(events_bars(spark, sf_dir)).schema
    return job.read(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields))


@query("running_averages", strict("Symbol, Date:d, Close:f, EMA12:f, RSI:f, MACD:f, MACD_Signal:f"))
def running_averages(spark, sf_dir):
    root = scratch_dir(spark)
    job = RunningAverages(spark, f"{root}/store")
    for _ in _arrivals(spark, sf_dir, f"{root}/landing"):
        job.start(inc.new_bars(spark, f"{root}/landing", HOURLY), f"{root}/checkpoint").awaitTermination()
    return job.read()


@query("dedup_stream", with_ctes({"bars": EVENTS_BARS}, BARS_SHOWN, "SELECT * FROM bars"))
def dedup_stream(spark, sf_dir):
    """The bars arrive twice."""
    root = scratch_dir(spark)
    bars = events_bars(spark, sf_dir).select(*BAR_COLUMNS)
    bars.unionByName(bars).write.csv(f"{root}/landing", header=True)
    inc.dedup_stream(inc.new_bars(spark, f"{root}/landing", HOURLY), f"{root}/bars", f"{root}/checkpoint").awaitTermination()
    return spark.read.schema(HOURLY).parquet(f"{root}/bars").select(*BAR_COLUMNS)


@query("dedup_stream_by_symbol", with_ctes({"bars": EVENTS_BARS}, BARS_SHOWN, "SELECT * FROM bars"))
def dedup_stream_by_symbol(spark, sf_dir):
    """One group of symbols after the other arrives with its whole history, and the first one again at the end."""
    root = scratch_dir(spark)
    bars = events_bars(spark, sf_dir).select(*BAR_COLUMNS)
    for part in (0, 1, 2, 0):
        bars.filter(F.pmod(F.crc32("Symbol"), F.lit(3)) == part).write.mode("append").csv(f"{root}/landing", header=True)
        inc.dedup_stream(inc.new_bars(spark, f"{root}/landing", HOURLY), f"{root}/bars", f"{root}/checkpoint").awaitTermination()
    return spark.read.schema(HOURLY).parquet(f"{root}/bars").select(*BAR_COLUMNS)
