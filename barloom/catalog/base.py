"""Registry of queries, and the SQL fragments they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, FloatType, IntegerType, ShortType, TimestampType

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; its result is brought to comparable types (see `comparable`)."""

    def register(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: comparable(fn(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def comparable(df: DataFrame) -> DataFrame:
    """Doubles to 6 places without a negative zero, integers to bigint, dates and times to text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (DoubleType, FloatType)):
            c = F.round(c.cast("double"), 6) + 0.0
        elif isinstance(f.dataType, (IntegerType, ShortType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (DateType, TimestampType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        out.append(c.alias(f.name))
    return df.select(*out)


def shown(columns: str, inner: str) -> str:
    """SELECT of the listed columns from the SQL `inner`, with the same types as `comparable`.

    A column is written name, name:f (double), name:i (integer) or name:d (date or time).
    """
    forms = {
        "f": 'round(CAST("{0}" AS DOUBLE), 6) + 0.0 AS "{0}"',
        "i": 'CAST("{0}" AS BIGINT) AS "{0}"',
        "d": """strftime("{0}", '%Y-%m-%d %H:%M:%S') AS "{0}\"""",
        "": '"{0}"',
    }
    picked = [forms[kind].format(name) for name, _, kind in (c.strip().partition(":") for c in columns.split(","))]
    return f"SELECT {', '.join(picked)} FROM ({inner}) AS result"


def with_ctes(ctes: dict[str, str], columns: str, inner: str) -> str:
    body = ",\n".join(f"{name} AS ({sql})" for name, sql in ctes.items())
    return f"WITH {body}\n{shown(columns, inner)}"


EVENTS_BARS = """
SELECT event_type AS "Symbol", date_trunc('hour', ts) AS "Date",
       arg_min(value, struct_pack(a := ts, b := event_id)) AS "Open", max(value) AS "High", min(value) AS "Low",
       arg_max(value, struct_pack(a := ts, b := event_id)) AS "Close", CAST(count(*) AS DOUBLE) AS "Volume"
FROM events GROUP BY 1, 2"""

LINEITEM_BARS = """
SELECT CAST(l_suppkey AS VARCHAR) AS "Symbol", CAST(l_shipdate AS DATE) AS "Date",
       arg_min(price, seq) AS "Open", max(price) AS "High", min(price) AS "Low",
       arg_max(price, seq) AS "Close", sum(l_quantity) AS "Volume"
FROM (SELECT *, floor(l_extendedprice * 100 / nullif(l_quantity, 0)) / 100.0::DOUBLE AS price,
             struct_pack(a := l_orderkey, b := l_linenumber, c := l_partkey, d := l_quantity,
                         e := l_extendedprice, f := l_discount, g := l_tax) AS seq FROM lineitem) AS items
GROUP BY 1, 2"""

W = 'PARTITION BY "Symbol" ORDER BY "Date"'


def rolling(agg: str, column: str, n: int, min_periods: int | None = None) -> str:
    frame = f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    value = f'{agg}("{column}") OVER {frame}'
    need = n if min_periods is None else min_periods
    return value if need <= 1 else f'CASE WHEN count("{column}") OVER {frame} >= {need} THEN {value} END'


def lag(column: str, k: int = 1) -> str:
    return f'lag("{column}", {k}) OVER ({W})'


def growth(now: str, then: str) -> str:
    return f"({now} / nullif({then}, 0) - 1.0) * 100.0"


def ewm(x: str, alpha: str, min_periods: int) -> str:
    """The recurrence itself, folded over the list of all values so far."""
    frame = f"({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    known = f"list({x}) FILTER (WHERE {x} IS NOT NULL) OVER {frame}"
    fold = f"list_reduce({known}, lambda a, b: a * (1.0 - {alpha}) + b * {alpha})"
    return f"CASE WHEN {x} IS NOT NULL AND count({x}) OVER {frame} >= {min_periods} THEN {fold} END"


_STRICT_STEPS = {
    "f1": f"""SELECT *, {rolling('avg', 'Close', 5)} AS "MA5", {rolling('avg', 'Close', 10)} AS "MA10",
        {rolling('avg', 'Close', 20)} AS "MA20", {rolling('stddev_samp', 'Close', 20)} AS sd,
        {rolling('avg', 'Volume', 5)} AS v5, {rolling('avg', 'Volume', 10)} AS v10,
        {lag('Close', 1)} AS "Lag_1", {lag('Close', 3)} AS "Lag_3", {lag('Close', 5)} AS lag5,
        {lag('Volume', 1)} AS vlag, lead("Close", 1) OVER ({W}) AS nxt,
        {ewm('"Close"', '(2.0/13)', 12)} AS "EMA12", {ewm('"Close"', '(2.0/27)', 26)} AS "EMA26"
        FROM bars""",
    "f2": f"""SELECT *, {growth('"Close"', '"Lag_1"')} AS "Daily_Returns",
        "High" - "Low" AS "Volatility", ("Close" - "Open") / nullif("Open", 0) * 100 AS "Price_Change_Pct",
        {growth('"Volume"', 'vlag')} AS "Volume_Change_Pct", {growth('"Close"', 'lag5')} AS "Weekly_Momentum",
        ("Close" - ("MA20" - 2 * sd)) / nullif(4 * sd, 0) AS "BB_Position",
        4 * sd / nullif("MA20", 0) * 100 AS "BB_Width",
        "Volume" / nullif(v10, 0) AS "Avg_Volume_Trend", "Volume" / nullif(v5, 0) AS "Avg_5D_Volume_Trend",
        abs("MA5" - "MA20") / nullif("MA20", 0) * 100 AS "Trend_Strength",
        (nxt - "Close") / nullif("Close", 0) * 100 AS "Future_Return_Pct",
        "EMA12" - "EMA26" AS "MACD",
        CASE WHEN "Lag_1" IS NOT NULL THEN greatest("Close" - "Lag_1", 0) END AS gain,
        CASE WHEN "Lag_1" IS NOT NULL THEN greatest("Lag_1" - "Close", 0) END AS loss FROM f1""",
    "f3": f"""SELECT *, {rolling('stddev_samp', 'Daily_Returns', 10)} AS "Rolling_Std_Returns",
        {ewm('"MACD"', '0.2', 9)} AS "MACD_Signal",
        {ewm('gain', '(1.0/14)', 14)} AS avg_gain, {ewm('loss', '(1.0/14)', 14)} AS avg_loss FROM f2""",
    "f": """SELECT *, "MACD" - "MACD_Signal" AS "MACD_Hist",
        100.0 - 100.0 / (1.0 + avg_gain / nullif(avg_loss, 0)) AS "RSI",
        CASE WHEN "Future_Return_Pct" > 1.0 THEN 1 WHEN "Future_Return_Pct" < -1.0 THEN 0 END AS "Target" FROM f3""",
}

STRICT_CTES = {"bars": EVENTS_BARS, **_STRICT_STEPS}
STRICT_DAILY_CTES = {"bars": LINEITEM_BARS, **_STRICT_STEPS}

STRICT_SHOWN = (
    "Symbol, Date:d, Open:f, High:f, Low:f, Close:f, Volume:f, MA5:f, MA10:f, MA20:f, Daily_Returns:f, Volatility:f,"
    "Price_Change_Pct:f, Lag_1:f, Lag_3:f, RSI:f, Volume_Change_Pct:f, EMA12:f, BB_Position:f, MACD:f, MACD_Signal:f,"
    "MACD_Hist:f, BB_Width:f, Weekly_Momentum:f, Avg_Volume_Trend:f, Avg_5D_Volume_Trend:f, Trend_Strength:f,"
    "Rolling_Std_Returns:f, Future_Return_Pct:f"
)
STRICT_NAMES = [c.strip().partition(":")[0] for c in STRICT_SHOWN.split(",")]
COMPLETE = " AND ".join(f'"{c}" IS NOT NULL' for c in [*STRICT_NAMES, "Target"])


def strict(columns: str, inner: str = "SELECT * FROM f") -> str:
    return with_ctes(STRICT_CTES, columns, inner)


# The batch and the live set over either source of bars.


def batch_ctes(bars: str) -> dict[str, str]:
    return {
        "bars": bars,
        "b1": f"""SELECT *, {rolling('avg', 'Close', 5, 1)} AS "MA5_Spark", {rolling('avg', 'Close', 10, 1)} AS "MA10_Spark",
            {rolling('avg', 'Close', 20, 1)} AS "MA20_Spark", {rolling('stddev_samp', 'Close', 20, 1)} AS "Rolling_Std_20_Spark",
            {rolling('avg', 'Volume', 20, 1)} AS "Volume_MA20_Spark", {lag('Close', 1)} AS "Close_Lag1_Spark",
            {lag('Close', 5)} AS "Close_Lag5_Spark" FROM bars""",
        "b": f"""SELECT *, {growth('"Close"', '"Close_Lag1_Spark"')} AS "Daily_Returns_Spark",
            {growth('"Close"', '"Close_Lag5_Spark"')} AS "Weekly_Momentum_Spark",
            ("High" - "Low") / nullif("Close", 0) * 100 AS "Volatility_Spark",
            "Volume" / nullif("Volume_MA20_Spark", 0) AS "Volume_Ratio_Spark",
            2.0 * "Rolling_Std_20_Spark" / nullif("MA20_Spark", 0) * 100 AS "Bollinger_Width_Spark" FROM b1""",
    }


BATCH_SHOWN = (
    "Symbol, Date:d, Open:f, High:f, Low:f, Close:f, Volume:f, MA5_Spark:f, MA10_Spark:f, MA20_Spark:f,"
    "Rolling_Std_20_Spark:f, Volume_MA20_Spark:f, Close_Lag1_Spark:f, Close_Lag5_Spark:f, Daily_Returns_Spark:f,"
    "Weekly_Momentum_Spark:f, Volatility_Spark:f, Volume_Ratio_Spark:f, Bollinger_Width_Spark:f"
)


def live_ctes(bars: str) -> dict[str, str]:
    return {
        "bars": bars,
        "l1": f"""SELECT *, {rolling('avg', 'Close', 5, 1)} AS "MA5", {rolling('avg', 'Close', 10, 1)} AS "MA10",
            {rolling('avg', 'Close', 20, 1)} AS "MA20", {rolling('stddev_samp', 'Close', 20, 1)} AS sd,
            {rolling('avg', 'Close', 12, 1)} AS "EMA12", {rolling('avg', 'Close', 26, 1)} AS m26,
            {rolling('avg', 'Volume', 5, 1)} AS v5, {lag('Close', 1)} AS "Lag_1", {lag('Close', 3)} AS "Lag_3",
            {lag('Close', 5)} AS lag5 FROM bars""",
        "l2": f"""SELECT *, "EMA12" - m26 AS "MACD", {growth('"Close"', '"Lag_1"')} AS "Daily_Returns",
            {growth('"Close"', 'lag5')} AS "Weekly_Momentum", "High" - "Low" AS "Volatility",
            ("Close" - "Open") / nullif("Open", 0) * 100 AS "Price_Change_Pct",
            4 * sd / nullif("MA20", 0) * 100 AS "BB_Width", "Volume" / nullif(v5, 0) AS "Avg_5D_Volume_Trend",
            abs("MA5" - "MA20") / nullif("MA20", 0) * 100 AS "Trend_Strength",
            CASE WHEN "Close" > "Lag_1" THEN "Close" - "Lag_1" ELSE 0.0 END AS gain,
            CASE WHEN "Close" < "Lag_1" THEN "Lag_1" - "Close" ELSE 0.0 END AS loss FROM l1""",
        "l3": f"""SELECT *, {rolling('avg', 'MACD', 9, 1)} AS "MACD_Signal",
            {rolling('avg', 'gain', 14, 1)} AS avg_gain, {rolling('avg', 'loss', 14, 1)} AS avg_loss FROM l2""",
        "l": """SELECT *, 100.0 - 100.0 / nullif(1.0 + avg_gain / (CASE WHEN avg_loss = 0 THEN 0.0001 ELSE avg_loss END), 0)
            AS "RSI" FROM l3""",
    }


LIVE_SHOWN = (
    "Symbol, Date:d, Open:f, High:f, Low:f, Close:f, Volume:f, MA5:f, MA10:f, MA20:f, EMA12:f, RSI:f, MACD:f, MACD_Signal:f,"
    "Daily_Returns:f, Volatility:f, Price_Change_Pct:f, Weekly_Momentum:f, Trend_Strength:f, BB_Width:f,"
    "Avg_5D_Volume_Trend:f, Lag_1:f, Lag_3:f"
)

DIRTY_CTES = {
    "bars": EVENTS_BARS,
    "numbered": """SELECT *, row_number() OVER (ORDER BY "Date", "Symbol") AS r FROM bars""",
    "copies": """SELECT *, "Symbol" AS s, "Close" AS c, r * 10 AS seq FROM numbered
        UNION ALL SELECT *, "Symbol", "Close" + 1, r * 10 + 5 FROM numbered WHERE r % 19 = 0
        UNION ALL SELECT *, 'THIN', "Close", r * 10 + 7 FROM numbered WHERE "Symbol" = 'click' AND r <= 200""",
    "dirty": """SELECT s AS "Symbol",
        CASE WHEN r % 29 = 0 THEN 'bad date' ELSE strftime("Date", '%Y-%m-%d %H:%M:%S') END AS "Date",
        CAST("Open" AS VARCHAR) AS "Open",
        CAST(CASE WHEN r % 31 = 0 THEN "Low" - 1 ELSE "High" END AS VARCHAR) AS "High",
        CAST("Low" AS VARCHAR) AS "Low",
        CASE WHEN r % 17 = 0 THEN 'n/a' WHEN r % 37 = 0 THEN '-1' ELSE CAST(c AS VARCHAR) END AS "Close",
        CASE WHEN r % 23 <> 0 THEN CAST("Volume" AS VARCHAR) END AS "Volume", seq FROM copies""",
}
CLEAN_CTES = {
    **DIRTY_CTES,
    "dated": """SELECT "Symbol", TRY_CAST("Date" AS TIMESTAMP) AS "Date", TRY_CAST("Open" AS DOUBLE) AS "Open",
        TRY_CAST("High" AS DOUBLE) AS "High", TRY_CAST("Low" AS DOUBLE) AS "Low", TRY_CAST("Close" AS DOUBLE) AS "Close",
        TRY_CAST("Volume" AS DOUBLE) AS "Volume", seq FROM dirty WHERE TRY_CAST("Date" AS TIMESTAMP) IS NOT NULL""",
    "uniq": """SELECT * EXCLUDE (seq, k) FROM (SELECT *, row_number() OVER
        (PARTITION BY "Symbol", "Date" ORDER BY seq DESC) AS k FROM dated) AS x WHERE k = 1""",
    "filled": "SELECT * FROM (SELECT \"Symbol\", \"Date\", "
    + ", ".join(
        f'last_value("{c}" IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS "{c}"'
        for c in ("Open", "High", "Low", "Close", "Volume")
    )
    + ' FROM uniq) AS x WHERE "Open" IS NOT NULL AND "High" IS NOT NULL AND "Low" IS NOT NULL'
    ' AND "Close" IS NOT NULL AND "Volume" IS NOT NULL',
    "sane": """SELECT * FROM filled WHERE "Open" > 0 AND "High" > 0 AND "Low" > 0 AND "Close" > 0
        AND "High" >= "Low" AND "Volume" >= 0""",
    "kept": """SELECT * FROM sane WHERE "Symbol" IN (SELECT "Symbol" FROM sane GROUP BY 1 HAVING count(*) >= 100)""",
}
BARS_SHOWN = "Symbol, Date:d, Open:f, High:f, Low:f, Close:f, Volume:f"

SCORED = """SELECT doc_id, quality AS y, ((doc_id * 37) % 101) / 100.0 AS p,
    CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS model FROM labels"""
SCORED_BARS = f"""SELECT *, CAST((epoch("Date") / 3600)::BIGINT * 37 + length("Symbol") * 13 AS BIGINT) % 101 / 100.0 AS p
    FROM ({EVENTS_BARS}) AS b"""
