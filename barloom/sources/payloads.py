"""Daily-series JSON payloads: classification, parsing, and the fallback to a second source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys of the payload.
SERIES = "Time Series (Daily)"
PAYLOAD = f"`{SERIES}` map<string, map<string, string>>, `Error Message` string, `Note` string, `Information` string"
FIELDS = ["Open", "High", "Low", "Close", "Volume"]


def _parsed(payloads: DataFrame, col: str) -> DataFrame:
    return payloads.withColumn("_p", F.from_json(col, PAYLOAD))


def _status() -> Column:
    p = F.col("_p")
    return (
        F.when(p["Error Message"].isNotNull(), "error")
        .when(p["Note"].isNotNull() | p["Information"].isNotNull(), "rate_limited")
        .when(p[SERIES].isNull(), "malformed")
        .otherwise("ok")
    )


def payload_status(payloads: DataFrame, col: str = "payload") -> DataFrame:
    """Add `status`: error, rate_limited, malformed or ok, and the `message` of the payload."""
    df = _parsed(payloads, col)
    message = F.coalesce(*[F.col("_p")[k] for k in ("Error Message", "Note", "Information")])
    return df.withColumns({"status": _status(), "message": message}).drop("_p", col)


def parse_daily_series(payloads: DataFrame, col: str = "payload", intraday: bool = False) -> DataFrame:
    """Bars of the usable payloads; the five fields of a day are taken by position."""
    days = _parsed(payloads, col).filter(_status() == "ok").select("Symbol", F.explode(F.col("_p")[SERIES]).alias("_d", "_f"))
    values = F.map_values("_f")
    when = F.try_to_timestamp("_d") if intraday else F.try_to_date("_d")
    return days.select(
        "Symbol", when.alias("Date"), *[F.get(values, F.lit(i)).try_cast("double").alias(c) for i, c in enumerate(FIELDS)]
    )


def with_fallback(primary: DataFrame, backup: DataFrame, names: tuple[str, str] = ("primary", "backup")) -> DataFrame:
    """Rows of the primary source, and of the backup for symbols the primary lacks; `source` tells which."""
    delivered = primary.select("Symbol").distinct()
    rest = backup.join(delivered, "Symbol", "left_anti").withColumn("source", F.lit(names[1]))
    return primary.withColumn("source", F.lit(names[0])).unionByName(rest)
