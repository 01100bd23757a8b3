"""Model-ready rows, joins, sorts, splits and folds."""

from pyspark.sql import functions as F

from barloom.catalog.base import BARS_SHOWN, COMPLETE, EVENTS_BARS, LINEITEM_BARS, LIVE_SHOWN, live_ctes, query, strict, with_ctes
from barloom.operators import datasets as d
from barloom.operators import ranking
from barloom.operators.layout import with_positions
from barloom.plans import features
from barloom.schema import BAR_COLUMNS, FEATURES
from barloom.sources.adapters import embeddings_keyed, events_bars, lineitem_bars

FEATURES_COMPLETE = " AND ".join(f'"{c}" IS NOT NULL' for c in FEATURES)
BARS = {"bars": EVENTS_BARS}
NUMBERED = {**BARS, "numbered": """SELECT *, row_number() OVER (ORDER BY "Date", "Symbol") AS r, count(*) OVER () AS n FROM bars"""}


@query("latest_complete", with_ctes(
    live_ctes(EVENTS_BARS),
    LIVE_SHOWN,
    f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "Symbol" ORDER BY "Date" DESC) AS k FROM l
        WHERE {FEATURES_COMPLETE}) AS x WHERE k = 1""",
))
def latest_complete(spark, sf_dir):
    return d.latest_complete(features.live_features(events_bars(spark, sf_dir)))


@query("last_n", with_ctes(
    BARS,
    BARS_SHOWN,
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "Symbol" ORDER BY "Date" DESC) AS k FROM bars) AS x WHERE k <= 60""",
))
def last_n(spark, sf_dir):
    return d.last_n(events_bars(spark, sf_dir), 60).select(*BAR_COLUMNS)


_LABELLED = """SELECT *, CASE WHEN lead("Close") OVER (PARTITION BY "Symbol" ORDER BY "Date") > "Close" THEN 1 ELSE 0 END AS "Target" FROM bars"""


@query("sequences", with_ctes(
    {
        **BARS,
        "t": _LABELLED,
        "s": """SELECT "Symbol", "Date", "Target" AS label, count(*) OVER w AS size,
            first_value("Close") OVER w AS first_close, last_value("Volume") OVER w AS last_volume,
            sum("Close") OVER w AS total_close FROM t
            WINDOW w AS (PARTITION BY "Symbol" ORDER BY "Date" ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)""",
    },
    "Symbol, Date:d, label:i, size:i, first_close:f, last_volume:f, total_close:f",
    "SELECT * FROM s WHERE size = 60",
))
def sequences(spark, sf_dir):
    """Sequences of the bar columns, shown by their size, ends and sum."""
    from barloom.operators.layout import lay_out, over, settle

    bars = lay_out(events_bars(spark, sf_dir), before=1)
    rises = F.lead("Close", 1).over(over(bars)) > F.col("Close")
    labelled = settle(bars.withColumn("Target", F.when(rises, 1).otherwise(0)))
    s = d.sequences(labelled, cols=["Open", "High", "Low", "Close", "Volume"])
    close = F.transform("sequence", lambda v: v[3])
    return s.select(
        "Symbol",
        "Date",
        "label",
        F.size("sequence").alias("size"),
        close[0].alias("first_close"),
        F.col("sequence")[59][4].alias("last_volume"),
        F.aggregate(close, F.lit(0.0), lambda a, x: a + x).alias("total_close"),
    )


@query("prediction_sequence", with_ctes(
    {
        **live_ctes(EVENTS_BARS),
        "k": f"""SELECT *, row_number() OVER (PARTITION BY "Symbol" ORDER BY "Date" DESC) AS k FROM l WHERE {FEATURES_COMPLETE}""",
    },
    "Symbol, rows:i, status, first_close:f, last_close:f",
    """SELECT "Symbol", count(*) AS rows, CASE WHEN count(*) >= 60 THEN 'ok' ELSE 'too few complete rows' END AS status,
       arg_max("Close", k) AS first_close, arg_min("Close", k) AS last_close FROM k WHERE k <= 60 GROUP BY 1""",
))
def prediction_sequence(spark, sf_dir):
    s = d.prediction_sequence(features.live_features(events_bars(spark, sf_dir)))
    at = FEATURES.index("Close")
    return s.select(
        "Symbol", "rows", "status", F.col("sequence")[0][at].alias("first_close"), F.col("sequence")[59][at].alias("last_close")
    )


_NEXT = """CASE WHEN {0} IS NULL THEN NULL WHEN {0} > {1} THEN 'bullish' ELSE 'bearish' END AS label"""


@query("next_bar_label", with_ctes(
    {**BARS, "x": """SELECT *, lead("Close") OVER (PARTITION BY "Symbol" ORDER BY "Date") AS nxt FROM bars"""},
    "Symbol, Date:d, Close:f, label",
    "SELECT *, " + _NEXT.format("nxt", '"Close"') + " FROM x",
))
def next_bar_label(spark, sf_dir):
    return d.next_bar_label(events_bars(spark, sf_dir)).select("Symbol", "Date", "Close", "label")


CANDLES = {
    **BARS,
    "c1": """SELECT *, lead("Close", 30) OVER w AS nxt, lead("Close", 29) OVER w AS last_close, lead("Date", 29) OVER w AS end_date,
        max("High") OVER (PARTITION BY "Symbol" ORDER BY "Date" ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING) AS top
        FROM bars WINDOW w AS (PARTITION BY "Symbol" ORDER BY "Date")""",
    "candles": """SELECT "Symbol", "Date" AS start_date, end_date, top, """
    + _NEXT.format("nxt", "last_close")
    + """, "Symbol" || '_' || strftime(end_date, '%Y%m%d%H') AS image_id FROM c1 WHERE nxt IS NOT NULL""",
}
_CANDLES_SHOWN = "Symbol, start_date:d, end_date:d, label, image_id, top:f"


def _candles(spark, sf_dir):
    return d.candle_windows(events_bars(spark, sf_dir), date_format="yyyyMMddHH")


def _show_candles(windows):
    top = F.array_max(F.transform("candles", lambda c: c["High"])).alias("top")
    return windows.select("Symbol", "start_date", "end_date", "label", "image_id", top)


@query("candle_windows", with_ctes(CANDLES, _CANDLES_SHOWN, "SELECT * FROM candles"))
def candle_windows(spark, sf_dir):
    return _show_candles(_candles(spark, sf_dir))


@query("even_sample", with_ctes(
    {
        **CANDLES,
        "numbered": """SELECT *, row_number() OVER (PARTITION BY "Symbol" ORDER BY start_date) - 1 AS place,
            count(*) OVER (PARTITION BY "Symbol") AS total FROM candles""",
        "picks": """SELECT "Symbol", CASE WHEN i = 499 THEN total - 1
            ELSE CAST(floor(i * ((total - 1)::DOUBLE / 499.0::DOUBLE)) AS BIGINT) END AS place
            FROM (SELECT DISTINCT "Symbol", total FROM numbered WHERE total > 500) AS t, range(500) AS g(i)""",
    },
    _CANDLES_SHOWN,
    """SELECT * FROM numbered WHERE total <= 500 OR ("Symbol", place) IN (SELECT ("Symbol", place) FROM picks)""",
))
def even_sample(spark, sf_dir):
    return _show_candles(d.sampled_candle_windows(events_bars(spark, sf_dir), date_format="yyyyMMddHH"))


@query("positions", with_ctes(
    BARS,
    "Symbol, Date:d, pos:i, total:i",
    """SELECT *, row_number() OVER (PARTITION BY "Symbol" ORDER BY "Date") AS pos, count(*) OVER (PARTITION BY "Symbol") AS total FROM bars""",
))
def positions(spark, sf_dir):
    return with_positions(events_bars(spark, sf_dir)).select("Symbol", "Date", "pos", "total")


FUSED = {
    **NUMBERED,
    "fused": """SELECT b."Symbol", b."Date", b."Close", e.embedding FROM numbered AS b JOIN embeddings AS e ON e.vec_id = b.r - 1""",
}


@query("fuse", with_ctes(
    FUSED,
    "Symbol, Date:d, Close:f, size:i, first:f, last:f",
    "SELECT *, len(embedding) AS size, embedding[1] AS first, embedding[len(embedding)] AS last FROM fused",
))
def fuse(spark, sf_dir):
    fused = d.fuse(events_bars(spark, sf_dir), embeddings_keyed(spark, sf_dir))
    return fused.select(
        "Symbol",
        "Date",
        "Close",
        F.size("embedding").alias("size"),
        F.get("embedding", F.lit(0)).alias("first"),
        F.element_at("embedding", -1).alias("last"),
    )


@query("join_coverage", with_ctes(
    FUSED,
    "matched:i, features_pct:f, embeddings_pct:f",
    """SELECT count(*) AS matched, count(*) * 100.0 / (SELECT count(*) FROM bars) AS features_pct,
       count(*) * 100.0 / (SELECT count(*) FROM numbered JOIN embeddings ON vec_id = r - 1) AS embeddings_pct FROM fused""",
))
def join_coverage(spark, sf_dir):
    return d.join_coverage(events_bars(spark, sf_dir), embeddings_keyed(spark, sf_dir))


@query("minmax_scale", with_ctes(
    BARS,
    "Symbol, Date:d, Close:f, Volume:f",
    """SELECT "Symbol", "Date", ("Close" - min("Close") OVER ()) / (max("Close") OVER () - min("Close") OVER ()) AS "Close",
       ("Volume" - min("Volume") OVER ()) / (max("Volume") OVER () - min("Volume") OVER ()) AS "Volume" FROM bars""",
))
def minmax_scale(spark, sf_dir):
    bars = events_bars(spark, sf_dir)
    cols = ["Close", "Volume"]
    return d.minmax_transform(bars, d.minmax_fit(bars, cols), cols).select("Symbol", "Date", *cols)


@query("sort_by_symbol", with_ctes(BARS, BARS_SHOWN, 'SELECT * FROM bars ORDER BY "Symbol", "Date"'))
def sort_by_symbol(spark, sf_dir):
    return d.sort_by_symbol(events_bars(spark, sf_dir)).select(*BAR_COLUMNS)


@query("sort_by_time", with_ctes(BARS, BARS_SHOWN, 'SELECT * FROM bars ORDER BY "Date", "Symbol"'))
def sort_by_time(spark, sf_dir):
    return d.sort_by_time(events_bars(spark, sf_dir)).select(*BAR_COLUMNS)


@query("concat_frames", with_ctes(
    {"a": EVENTS_BARS, "b": LINEITEM_BARS},
    BARS_SHOWN,
    'SELECT "Symbol", "Date", "Open", "High", "Low", "Close", "Volume" FROM a UNION ALL '
    'SELECT "Symbol", "Date", "Open", "High", "Low", "Close", "Volume" FROM b',
))
def concat_frames(spark, sf_dir):
    daily = lineitem_bars(spark, sf_dir).withColumn("Date", F.col("Date").cast("timestamp"))
    return d.concat_frames(events_bars(spark, sf_dir), daily).select(*BAR_COLUMNS)


@query("all_symbols", """SELECT DISTINCT event_type AS "Symbol" FROM events UNION SELECT CAST(l_suppkey AS VARCHAR) FROM lineitem""")
def all_symbols(spark, sf_dir):
    return d.all_symbols(events_bars(spark, sf_dir), lineitem_bars(spark, sf_dir))


@query("global_rank", with_ctes(NUMBERED, "Symbol, Date:d, rank:i", "SELECT *, r AS rank FROM numbered"))
def global_rank(spark, sf_dir):
    return ranking.global_rank(events_bars(spark, sf_dir)).select("Symbol", "Date", "rank")


@query("time_split", with_ctes(
    NUMBERED,
    "Symbol, Date:d, role",
    """SELECT *, CASE WHEN r <= greatest(least(CAST(floor(n * 0.8) AS BIGINT), n - 1), 1) THEN 'train' ELSE 'test' END AS role FROM numbered""",
))
def time_split(spark, sf_dir):
    return ranking.time_split(events_bars(spark, sf_dir)).select("Symbol", "Date", "role")


@query("time_series_folds", with_ctes(
    {
        **NUMBERED,
        "folds": """SELECT *, n // 6 AS s, i AS fold FROM numbered, range(1, 6) AS g(i)""",
    },
    "Symbol, Date:d, fold:i, role",
    """SELECT *, CASE WHEN r <= n - (6 - fold) * s THEN 'train' ELSE 'test' END AS role FROM folds WHERE r <= n - (5 - fold) * s""",
))
def time_series_folds(spark, sf_dir):
    return ranking.time_series_folds(events_bars(spark, sf_dir)).select("Symbol", "Date", "fold", "role")


@query("training_split_daily", with_ctes(
    {"bars": LINEITEM_BARS, "x": 'SELECT *, row_number() OVER (ORDER BY "Date", "Symbol") AS r, count(*) OVER () AS n FROM bars'},
    "role, rows:i, first_date:d, last_date:d, total_close:f",
    """SELECT role, count(*) AS rows, min("Date") AS first_date, max("Date") AS last_date, round(sum("Close"), 2) AS total_close FROM
       (SELECT *, CASE WHEN r <= CAST(floor(n * 0.8) AS BIGINT) THEN 'train' ELSE 'test' END AS role FROM x) AS y GROUP BY 1""",
))
def training_split_daily(spark, sf_dir):
    split = ranking.time_split(lineitem_bars(spark, sf_dir))
    return split.groupBy("role").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("Date").alias("first_date"),
        F.max("Date").alias("last_date"),
        F.round(F.sum("Close"), 2).alias("total_close"),
    )


@query("latest_training_rows", strict(
    "Symbol, Date:d, RSI:f, Target:i",
    f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "Symbol" ORDER BY "Date" DESC) AS k FROM f
        WHERE {COMPLETE}) AS x WHERE k <= 3""",
))
def latest_training_rows(spark, sf_dir):
    rows = features.training_features(events_bars(spark, sf_dir))
    return d.last_n(rows, 3).select("Symbol", "Date", "RSI", "Target")
