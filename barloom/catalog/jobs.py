"""Whole jobs from raw files to what they write, read back."""

from pyspark.sql import functions as F

from barloom.catalog.base import BATCH_SHOWN, CLEAN_CTES, EVENTS_BARS, LIVE_SHOWN, batch_ctes, live_ctes, query, with_ctes
from barloom.catalog.datasets import FEATURES_COMPLETE
from barloom.catalog.models import trained
from barloom.catalog.reports import SUMMARY, SUMMARY_SHOWN
from barloom.plans import jobs
from barloom.sources.adapters import dirty_bars, events_bars, table
from barloom.sources.writers import scratch_dir, write_csv

# the cleaned bars under the name that the feature steps read
_SOURCE = {("source" if k == "bars" else k): v.replace("FROM bars", "FROM source") for k, v in CLEAN_CTES.items()}
_BATCH = {**_SOURCE, **batch_ctes("SELECT * FROM kept")}


def _run(spark, sf_dir):
    """The batch job over the dirty bars as CSV."""
    root = scratch_dir(spark)
    dirty = dirty_bars(spark, sf_dir)
    write_csv(dirty, f"{root}/raw")
    raw = spark.read.schema(dirty.schema).csv(f"{root}/raw", header=True)
    return jobs.batch_job(raw, f"{root}/out", intraday=True)


@query("batch_job", with_ctes(_BATCH, BATCH_SHOWN, "SELECT * FROM b"))
def batch_job(spark, sf_dir):
    return _run(spark, sf_dir).features


@query("batch_job_summary", with_ctes(_BATCH, SUMMARY_SHOWN, SUMMARY))
def batch_job_summary(spark, sf_dir):
    return _run(spark, sf_dir).summary


@query("live_job", with_ctes(
    live_ctes(f"""SELECT * FROM ({EVENTS_BARS}) AS e WHERE "Symbol" IN (SELECT event_type FROM events GROUP BY 1 HAVING count(*) % 2 = 0)"""),
    LIVE_SHOWN, f"SELECT * FROM l WHERE {FEATURES_COMPLETE}"))
def live_job(spark, sf_dir):
    """The symbols with an even number of events are asked for."""
    asked = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("Symbol")).count().filter("count % 2 = 0")
    return jobs.live_job(events_bars(spark, sf_dir), asked, f"{scratch_dir(spark)}/live", "stream")


@query("predict_and_record", with_ctes(
    {**live_ctes(EVENTS_BARS), "k": f"""SELECT "Symbol" AS symbol, max("Date") AS latest_date FROM l WHERE {FEATURES_COMPLETE} GROUP BY 1"""},
    "symbol, latest_date:d, source, model, valid", """SELECT symbol, latest_date, 'check' AS source, 'Random Forest' AS model, true AS valid FROM k"""))
def predict_and_record(spark, sf_dir):
    """All symbols that events or nations name; the latter have no bars and leave no record. The history is read back."""
    history = f"{scratch_dir(spark)}/history"
    bars = events_bars(spark, sf_dir)
    asked = bars.select("Symbol").unionByName(table(spark, sf_dir, "nation").select(F.col("n_name").alias("Symbol")))
    jobs.predict_and_record(asked, bars, trained(spark, sf_dir).model, history, "check")
    whole = F.col("confidence").between(50, 100) & F.col("prediction").isin("UP", "DOWN") & (F.col("meta.up_probability") + F.col("meta.down_probability")).between(0.999, 1.001)
    return spark.read.parquet(history).select("symbol", F.col("meta.latest_date").alias("latest_date"), "source", "model", whole.alias("valid"))
