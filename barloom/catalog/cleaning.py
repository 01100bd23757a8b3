"""Cleaning steps over the dirty bars."""

from pyspark.sql import functions as F

from barloom.catalog.base import (
    BARS_SHOWN,
    CLEAN_CTES,
    DIRTY_CTES,
    EVENTS_BARS,
    query,
    strict,
    with_ctes,
)
from barloom.operators import clean as c
from barloom.plans import cleaning as plan
from barloom.plans import features
from barloom.schema import BAR_COLUMNS
from barloom.sources.adapters import dirty_bars, events_bars, scored_labels

NUMBERS = ("Open", "High", "Low", "Close", "Volume")


def _stage(name, stage, table):
    @query(name, with_ctes(CLEAN_CTES, BARS_SHOWN, f"SELECT * FROM {table}"))
    def run(spark, sf_dir):
        return plan.stages(dirty_bars(spark, sf_dir), intraday=True)[stage].select(*BAR_COLUMNS)


_stage("dedup_keep_last", "unique", "uniq")
_stage("forward_fill", "filled", "filled")
_stage("price_sanity", "sane", "sane")
_stage("drop_thin_symbols", "kept", "kept")


@query("clean_bars", with_ctes(CLEAN_CTES, BARS_SHOWN, "SELECT * FROM kept"))
def clean_bars(spark, sf_dir):
    return plan.clean(dirty_bars(spark, sf_dir), intraday=True)


@query("coerce_numeric", with_ctes(
    DIRTY_CTES,
    "seq:i, Open:f, High:f, Low:f, Close:f, Volume:f",
    "SELECT seq, " + ", ".join(f'TRY_CAST("{x}" AS DOUBLE) AS "{x}"' for x in NUMBERS) + " FROM dirty",
))
def coerce_numeric(spark, sf_dir):
    return c.coerce_numeric(dirty_bars(spark, sf_dir)).select("seq", *NUMBERS)


@query("coercion_report", with_ctes(
    DIRTY_CTES,
    "column_name, coerced:i",
    " UNION ALL ".join(
        f"""SELECT '{x}' AS column_name, count(*) FILTER (WHERE "{x}" IS NOT NULL AND TRY_CAST("{x}" AS DOUBLE) IS NULL)
        AS coerced FROM dirty""" for x in NUMBERS
    ),
))
def coercion_report(spark, sf_dir):
    return c.coercion_report(dirty_bars(spark, sf_dir))


@query("coerce_date", with_ctes(
    DIRTY_CTES,
    "Symbol, Date:d, seq:i",
    'SELECT "Symbol", TRY_CAST("Date" AS TIMESTAMP) AS "Date", seq FROM dirty WHERE TRY_CAST("Date" AS TIMESTAMP) IS NOT NULL',
))
def coerce_date(spark, sf_dir):
    return c.coerce_date(dirty_bars(spark, sf_dir), intraday=True).select("Symbol", "Date", "seq")


@query("drop_incomplete", with_ctes(
    DIRTY_CTES, "Symbol, Date, Close, Volume, seq:i", 'SELECT * FROM dirty WHERE "Volume" IS NOT NULL'
))
def drop_incomplete(spark, sf_dir):
    return c.drop_incomplete(dirty_bars(spark, sf_dir)).select("Symbol", "Date", "Close", "Volume", "seq")


@query("thin_symbols", with_ctes(
    CLEAN_CTES, "Symbol, n:i", 'SELECT "Symbol", count(*) AS n FROM sane GROUP BY 1 HAVING count(*) < 100'
))
def thin_symbols(spark, sf_dir):
    return c.thin_symbols(plan.stages(dirty_bars(spark, sf_dir), intraday=True)["sane"])


@query("stage_counts", with_ctes(
    {
        **CLEAN_CTES,
        "n": " UNION ALL ".join(
            f"SELECT {i} AS step, '{stage}' AS stage, count(*) AS rows FROM {table}"
            for i, (stage, table) in enumerate(
                [("raw", "dirty"), ("dated", "dated"), ("unique", "uniq"), ("filled", "filled"), ("sane", "sane"), ("kept", "kept")]
            )
        ),
    },
    "step:i, stage, rows:i, removed:i",
    "SELECT *, coalesce(lag(rows) OVER (ORDER BY step) - rows, 0) AS removed FROM n",
))
def stage_counts(spark, sf_dir):
    return plan.stage_counts(dirty_bars(spark, sf_dir), intraday=True)


def _with_infinities(spark, sf_dir):
    """Relative ranges where a flat bar gives infinity, as floating-point division would."""
    width = F.col("High") - F.col("Low")
    inverse = F.when(width == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.col("Close"), width))
    bars = events_bars(spark, sf_dir)
    return bars.select("Symbol", "Date", inverse.alias("inverse"), F.when(F.col("Volume") > 1, F.col("Volume")).alias("busy"))


_INFINITIES = f"""SELECT "Symbol", "Date", CASE WHEN "High" = "Low" THEN CAST('Infinity' AS DOUBLE)
    ELSE "Close" / ("High" - "Low") END AS inverse, CASE WHEN "Volume" > 1 THEN "Volume" END AS busy FROM ({EVENTS_BARS}) AS b"""


@query("drop_nonfinite", with_ctes(
    {"x": _INFINITIES},
    "Symbol, Date:d, inverse:f, busy:f",
    "SELECT * FROM x WHERE isfinite(inverse) AND busy IS NOT NULL",
))
def drop_nonfinite(spark, sf_dir):
    return c.drop_nonfinite(_with_infinities(spark, sf_dir), ["inverse", "busy"])


@query("audit_nonfinite", with_ctes(
    {"x": _INFINITIES},
    "column_name, nulls:i, infinite:i",
    " UNION ALL ".join(
        f"""SELECT '{x}' AS column_name, count(*) FILTER (WHERE {x} IS NULL OR isnan({x})) AS nulls,
        count(*) FILTER (WHERE isinf({x})) AS infinite FROM x""" for x in ("inverse", "busy")
    ),
))
def audit_nonfinite(spark, sf_dir):
    return c.audit_nonfinite(_with_infinities(spark, sf_dir), ["inverse", "busy"])


@query("binary_target_check", strict(
    "rows:i, bad:i, ok",
    'SELECT count(*) AS rows, count(*) FILTER (WHERE "Target" IS NULL) AS bad, count(*) FILTER (WHERE "Target" IS NULL) = 0 AS ok FROM f',
))
def binary_target_check(spark, sf_dir):
    from barloom.operators.indicators import target

    return c.binary_target_check(target(features.strict_features(events_bars(spark, sf_dir))))


@query("require_binary_target", """SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(quality AS BIGINT) AS y FROM labels""")
def require_binary_target(spark, sf_dir):
    return c.require_binary_target(scored_labels(spark, sf_dir), "y").select("doc_id", "y")


@query("rename_keys", with_ctes({"bars": EVENTS_BARS}, "Symbol, Date:d, Close:f", "SELECT * FROM bars"))
def rename_keys(spark, sf_dir):
    lower = events_bars(spark, sf_dir).select(F.col("Symbol").alias("symbol"), F.col("Date").alias("date"), "Close")
    return c.rename_keys(lower)


@query("drop_columns", with_ctes({"bars": EVENTS_BARS}, BARS_SHOWN, "SELECT * FROM bars"))
def drop_columns(spark, sf_dir):
    return c.drop_columns(events_bars(spark, sf_dir).withColumn("Adj Close", F.col("Close"))).select(*BAR_COLUMNS)
