"""Sources and sinks: every query writes what the tables give to a scratch folder and reads it back."""

from pyspark.sql import functions as F

from barloom.catalog.base import BARS_SHOWN, EVENTS_BARS, SCORED_BARS, batch_ctes, query, with_ctes
from barloom.catalog.reports import SUMMARY, SUMMARY_SHOWN
from barloom.operators import reports
from barloom.plans import features
from barloom.plans.cleaning import clean
from barloom.schema import BAR_COLUMNS
from barloom.sources import images, payloads as pay, readers, writers
from barloom.sources.adapters import events_bars, payloads, scored_bars, write_symbol_files
from barloom.sources.writers import scratch_dir

BARS = {"bars": EVENTS_BARS}
HOURLY = "Symbol string, Date timestamp, Open double, High double, Low double, Close double, Volume double"


@query("read_bars_csv", with_ctes(BARS, BARS_SHOWN, "SELECT * FROM bars"))
def read_bars_csv(spark, sf_dir):
    path = scratch_dir(spark) + "/bars"
    writers.write_csv(events_bars(spark, sf_dir).select(*BAR_COLUMNS), path)
    return readers.read_bars_csv(spark, path, HOURLY)


@query("write_parquet", with_ctes(BARS, BARS_SHOWN, "SELECT * FROM bars"))
def write_parquet(spark, sf_dir):
    path = scratch_dir(spark) + "/bars"
    writers.write_parquet(events_bars(spark, sf_dir), path, ["Symbol"])
    return spark.read.parquet(path).select(*BAR_COLUMNS)


@query("write_summary_csv", with_ctes(batch_ctes(EVENTS_BARS), SUMMARY_SHOWN, SUMMARY))
def write_summary_csv(spark, sf_dir):
    path = scratch_dir(spark) + "/summary"
    summary = reports.summary(features.batch_features(events_bars(spark, sf_dir)))
    writers.write_summary_csv(summary, path)
    return spark.read.schema(summary.schema).csv(path, header=True)


# One file per symbol. A "symbol" here is an event type on one day, so that files stay small.

_DAY = """date_part('day', "Date")::BIGINT % 5"""
_FILES = {
    **BARS,
    "files": f"""SELECT *, "Symbol" || '-' || strftime("Date", '%Y%m%d') AS sym, {_DAY} AS kind FROM bars""",
}


@query("read_symbol_dir", with_ctes(
    _FILES,
    "Symbol, Date:d, Close:f, Volume:f, Adj:f",
    """SELECT sym AS "Symbol", "Date", "Close", "Volume", CASE WHEN kind = 3 THEN "Close" END AS "Adj" FROM files WHERE kind <> 1""",
))
def read_symbol_dir(spark, sf_dir):
    path = scratch_dir(spark) + "/raw"
    write_symbol_files(spark, sf_dir, path)
    df = readers.read_symbol_dir(spark, path)
    return df.select(
        "Symbol",
        F.try_to_timestamp("Date").alias("Date"),
        *[F.col(c).try_cast("double").alias(n) for c, n in (("Close", "Close"), ("Volume", "Volume"), ("Adj Close", "Adj"))],
    )


@query("read_symbol_dir_limit", with_ctes(
    _FILES,
    "Symbol, rows:i",
    """SELECT sym AS "Symbol", count(*) AS rows FROM files WHERE kind <> 1 AND sym IN
       (SELECT DISTINCT sym FROM files ORDER BY 1 LIMIT 7) GROUP BY 1""",
))
def read_symbol_dir_limit(spark, sf_dir):
    path = scratch_dir(spark) + "/raw"
    write_symbol_files(spark, sf_dir, path)
    return reports.rows_per_symbol(readers.read_symbol_dir(spark, path, limit=7)).withColumnRenamed("n", "rows")


@query("read_wide_files", with_ctes(BARS, "Symbol, High:f, Volume:f, rows:i", """
SELECT "Symbol", max("High") AS "High", sum("Volume") AS "Volume", count(*) AS rows FROM bars GROUP BY 1"""))
def read_wide_files(spark, sf_dir):
    """Files of 40 columns with the required ones last, one folder for each symbol."""
    root = scratch_dir(spark)
    bars = events_bars(spark, sf_dir).select(*BAR_COLUMNS)
    wide = bars.select(*[F.lit(i).alias(f"X{i}") for i in range(34)], *[F.col(c) for c in ("Date", "Open", "High", "Low", "Close", "Volume")], F.col("Symbol").alias("of"))
    wide.write.partitionBy("of").csv(f"{root}/raw", header=True)
    read = readers.read_symbol_dir(spark, f"{root}/raw/*")
    symbol = F.regexp_extract(F.col("seq.path"), "of=([^/]+)/", 1)
    return read.groupBy(symbol.alias("Symbol")).agg(
        F.max(F.col("High").cast("double")).alias("High"), F.sum(F.col("Volume").cast("double")).alias("Volume"), F.count(F.lit(1)).alias("rows"))


@query("merge_and_clean", with_ctes(
    {**BARS, "f": """SELECT *, "Symbol" || '-' || strftime("Date", '%Y%m%d') AS sym FROM bars""", "r": """
       SELECT *, count(*) OVER (PARTITION BY sym) AS n FROM f"""},
    "Symbol, Date:d, Close:f, Volume:f",
    """SELECT sym AS "Symbol", "Date", "Close", "Volume" FROM r""",
))
def merge_and_clean(spark, sf_dir):
    """From files that give every bar twice, first with other prices, to clean bars: the later line counts."""
    root = scratch_dir(spark)
    write_symbol_files(spark, sf_dir, f"{root}/raw", twice=True)
    raw = readers.read_symbol_dir(spark, f"{root}/raw")
    return clean(raw.drop("Adj Close"), min_rows=1, intraday=True).select("Symbol", "Date", "Close", "Volume")


@query("column_contract", with_ctes(
    _FILES,
    "file, missing, ok, reordered",
    """SELECT DISTINCT sym || '.csv' AS file, CASE WHEN kind = 1 THEN 'Volume' ELSE '' END AS missing, kind <> 1 AS ok,
       kind = 2 AS reordered FROM files""",
))
def column_contract(spark, sf_dir):
    path = scratch_dir(spark) + "/raw"
    write_symbol_files(spark, sf_dir, path)
    return readers.column_contract(spark, path).withColumn("missing", F.concat_ws(",", "missing"))


# Payloads.

_PAYLOADS = {**BARS, "d": """SELECT *, date_part('day', "Date")::BIGINT % 7 AS kind, date_trunc('day', "Date") AS day FROM bars"""}


@query("parse_daily_series", with_ctes(_PAYLOADS, BARS_SHOWN, "SELECT * FROM d WHERE kind NOT IN (1, 2, 3, 4)"))
def parse_daily_series(spark, sf_dir):
    return pay.parse_daily_series(payloads(spark, sf_dir), intraday=True)


@query("payload_status", with_ctes(
    _PAYLOADS,
    "Symbol, day:d, status, message",
    """SELECT DISTINCT "Symbol", day, CASE kind WHEN 1 THEN 'rate_limited' WHEN 2 THEN 'rate_limited' WHEN 3 THEN 'error'
       WHEN 4 THEN 'malformed' ELSE 'ok' END AS status, CASE kind WHEN 1 THEN 'too many requests' WHEN 2 THEN 'daily limit'
       WHEN 3 THEN 'unknown symbol' END AS message FROM d""",
))
def payload_status(spark, sf_dir):
    return pay.payload_status(payloads(spark, sf_dir)).select("Symbol", "day", "status", "message")


@query("with_fallback", with_ctes(
    BARS,
    BARS_SHOWN + ", source",
    """SELECT *, 'payloads' AS source FROM bars WHERE "Symbol" IN ('click', 'error')
       UNION ALL SELECT *, 'files' FROM bars WHERE "Symbol" NOT IN ('click', 'error')""",
))
def with_fallback(spark, sf_dir):
    bars = events_bars(spark, sf_dir).select(*BAR_COLUMNS)
    delivered = bars.filter(F.col("Symbol").isin("click", "error"))
    return pay.with_fallback(delivered, bars, ("payloads", "files"))


# Images.


@query("image_labels", with_ctes(
    {**BARS, "x": """SELECT *, CASE WHEN "Close" > "Open" THEN 'bullish' ELSE 'bearish' END AS label FROM bars"""},
    "image_path, symbol, date, label",
    """SELECT 'images/' || label || '/' || "Symbol" || '_' || strftime("Date", '%Y%m%d%H') || '.png' AS image_path,
       "Symbol" AS symbol, strftime("Date", '%Y%m%d%H') AS date, label FROM x WHERE "Volume" > 1""",
))
def image_labels(spark, sf_dir):
    """Paths of the bars; those of bars with one event have malformed names and drop out."""
    label = F.when(F.col("Close") > F.col("Open"), "bullish").otherwise("bearish")
    name = F.when(
        F.col("Volume") > 1, F.concat_ws("_", "Symbol", F.date_format("Date", "yyyyMMddHH"))
    ).otherwise(F.col("Symbol"))
    path = F.concat(F.lit("images\\"), label, F.lit("/"), name, F.lit(".png"))
    return images.image_labels(events_bars(spark, sf_dir).select(path.alias("path")))


# Histories.


@query("append_live", with_ctes(BARS, "Symbol, Date:d, Close:f, Source", "SELECT *, 'events' AS \"Source\" FROM bars"))
def append_live(spark, sf_dir):
    path = scratch_dir(spark) + "/live"
    writers.append_live(events_bars(spark, sf_dir), path, "events")
    return spark.read.parquet(path).select("Symbol", "Date", "Close", "Source")


def _records(spark, sf_dir):
    scored = scored_bars(spark, sf_dir).withColumns(
        {
            "p_up": F.col("p"),
            "p_down": 1.0 - F.col("p"),
            "prediction": F.when(F.col("p") >= 0.5, "UP").otherwise("DOWN"),
            "confidence": F.greatest(F.col("p"), 1.0 - F.col("p")) * 100,
        }
    )
    return writers.prediction_records(scored, "events").withColumn("timestamp", F.col("meta.latest_date"))


@query("append_predictions", with_ctes(
    {"bars": SCORED_BARS},
    "symbol, prediction, confidence:f, timestamp:d, up_probability:f, volume:i",
    """SELECT "Symbol" AS symbol, CASE WHEN p >= 0.5 THEN 'UP' ELSE 'DOWN' END AS prediction,
       round(greatest(p, 1.0 - p) * 100, 4) AS confidence, "Date" AS timestamp, p AS up_probability, "Volume" AS volume FROM bars""",
))
def append_predictions(spark, sf_dir):
    path = scratch_dir(spark) + "/history"
    writers.append_predictions(_records(spark, sf_dir), path)
    return spark.read.parquet(path).select(
        "symbol", "prediction", "confidence", "timestamp", "meta.up_probability", "meta.quote.volume"
    )


@query("recent_predictions", """
SELECT "Symbol", CASE WHEN p >= 0.5 THEN 'UP' ELSE 'DOWN' END AS "Prediction",
       round(greatest(p, 1.0 - p) * 100, 4) + 0.0 AS "Confidence (%)", strftime("Date", '%Y-%m-%d %H:%M:%S') AS "Timestamp",
       'events' AS "Source", 'Random Forest' AS "Model"
FROM (""" + SCORED_BARS + """) AS x ORDER BY "Date" DESC, "Symbol" LIMIT 20""")
def recent_predictions(spark, sf_dir):
    return reports.recent_predictions(_records(spark, sf_dir))
