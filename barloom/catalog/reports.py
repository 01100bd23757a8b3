"""Summaries, distributions, metrics and backtests."""

from pyspark.sql import functions as F

from barloom.catalog.base import (
    BARS_SHOWN,
    EVENTS_BARS,
    LINEITEM_BARS,
    SCORED,
    SCORED_BARS,
    batch_ctes,
    live_ctes,
    query,
    strict,
    with_ctes,
)
from barloom.catalog.datasets import CANDLES
from barloom.operators import evaluate as e
from barloom.operators import indicators as ind
from barloom.operators import reports as r
from barloom.operators.datasets import candle_windows
from barloom.operators.layout import lay_out, settle
from barloom.plans import features
from barloom.schema import BAR_COLUMNS, CORRELATED
from barloom.sources.adapters import events_bars, lineitem_bars, scored_bars, scored_labels

SUMMARY_SHOWN = (
    "total_rows:i, unique_symbols:i, date_range_start:d, date_range_end:d, avg_close_price:f, std_close_price:f,"
    "min_close_price:f, max_close_price:f, avg_volume:f, avg_daily_returns:f, avg_volatility:f"
)
SUMMARY = """SELECT count(*) AS total_rows, count(DISTINCT "Symbol") AS unique_symbols, min("Date") AS date_range_start,
    max("Date") AS date_range_end, avg("Close") AS avg_close_price, stddev_samp("Close") AS std_close_price,
    min("Close") AS min_close_price, max("Close") AS max_close_price, avg("Volume") AS avg_volume,
    avg("Daily_Returns_Spark") AS avg_daily_returns, avg("Volatility_Spark") AS avg_volatility FROM b"""


@query("summary", with_ctes(batch_ctes(EVENTS_BARS), SUMMARY_SHOWN, SUMMARY))
def summary(spark, sf_dir):
    return r.summary(features.batch_features(events_bars(spark, sf_dir)))


@query("summary_daily", with_ctes(batch_ctes(LINEITEM_BARS), SUMMARY_SHOWN, SUMMARY))
def summary_daily(spark, sf_dir):
    return r.summary(features.batch_features(lineitem_bars(spark, sf_dir)))


@query("rows_per_symbol", with_ctes({"bars": LINEITEM_BARS}, "Symbol, n:i", 'SELECT "Symbol", count(*) AS n FROM bars GROUP BY 1'))
def rows_per_symbol(spark, sf_dir):
    return r.rows_per_symbol(lineitem_bars(spark, sf_dir))


@query("symbol_date_range", with_ctes(
    {"bars": LINEITEM_BARS},
    "symbols:i, first_date:d, last_date:d",
    'SELECT count(DISTINCT "Symbol") AS symbols, min("Date") AS first_date, max("Date") AS last_date FROM bars',
))
def symbol_date_range(spark, sf_dir):
    return r.symbol_date_range(lineitem_bars(spark, sf_dir))


def _targets(spark, sf_dir):
    df = ind.target(ind.future_return(lay_out(events_bars(spark, sf_dir), before=1)))
    return settle(df)


@query("target_distribution", strict(
    "label, n:i, share_pct:f",
    """SELECT CASE WHEN "Target" = 1 THEN 'UP' WHEN "Target" = 0 THEN 'DOWN' ELSE 'NONE' END AS label, count(*) AS n,
       count(*) * 100.0 / (SELECT count(*) FROM f) AS share_pct FROM f GROUP BY 1""",
))
def target_distribution(spark, sf_dir):
    return r.target_distribution(_targets(spark, sf_dir))


@query("class_imbalance", with_ctes(
    {"s": SCORED, "c": "SELECT count(*) FILTER (WHERE y = 0) AS down, count(*) FILTER (WHERE y = 1) AS up FROM s"},
    "down:i, up:i, ratio:f, balanced",
    """SELECT *, greatest(down, up)::DOUBLE / greatest(1, least(down, up)) AS ratio,
       greatest(down, up)::DOUBLE / greatest(1, least(down, up)) >= 1.2 AS balanced FROM c""",
))
def class_imbalance(spark, sf_dir):
    return e.class_imbalance(scored_labels(spark, sf_dir), "y")


@query("class_weights", with_ctes(
    {"s": SCORED},
    "doc_id:i, y:i, weight:f",
    """SELECT doc_id, y, count(*) OVER () / (2.0 * count(*) OVER (PARTITION BY y)) AS weight FROM s""",
))
def class_weights(spark, sf_dir):
    return e.class_weights(scored_labels(spark, sf_dir), "y").select("doc_id", "y", "weight")


CONFUSION = {
    "s": SCORED,
    "m": """SELECT count(*) FILTER (WHERE y = 0 AND p < 0.5) AS tn, count(*) FILTER (WHERE y = 0 AND p >= 0.5) AS fp,
        count(*) FILTER (WHERE y = 1 AND p < 0.5) AS fn, count(*) FILTER (WHERE y = 1 AND p >= 0.5) AS tp FROM s""",
}


def _ratio(a: str, b: str) -> str:
    return f"coalesce(({a})::DOUBLE / nullif({b}, 0), 0.0)"


@query("confusion_matrix", with_ctes(CONFUSION, "tn:i, fp:i, fn:i, tp:i", "SELECT * FROM m"))
def confusion_matrix(spark, sf_dir):
    return e.confusion_matrix(e.predicted(scored_labels(spark, sf_dir)))


_METRICS = f"""{_ratio('tn + tp', 'tn + fp + fn + tp')} AS accuracy, {_ratio('tp', 'tp + fp')} AS precision,
    {_ratio('tp', 'tp + fn')} AS recall, {_ratio('2 * tp', '2 * tp + fp + fn')} AS f1_score"""


@query("classification_metrics", with_ctes(
    CONFUSION, "accuracy:f, precision:f, recall:f, f1_score:f", f"SELECT {_METRICS} FROM m"
))
def classification_metrics(spark, sf_dir):
    return e.classification_metrics(e.predicted(scored_labels(spark, sf_dir)))


def _line(label: str, hit: str, wrong: str, missed: str) -> str:
    return f"""SELECT '{label}' AS label, {_ratio(hit, f'{hit} + {wrong}')} AS precision,
        {_ratio(hit, f'{hit} + {missed}')} AS recall, {_ratio(f'2 * {hit}', f'2 * {hit} + {wrong} + {missed}')} AS f1_score,
        {hit} + {missed} AS support FROM m"""


@query("classification_report", with_ctes(
    {**CONFUSION, "two": _line("DOWN", "tn", "fn", "fp") + " UNION ALL " + _line("UP", "tp", "fp", "fn")},
    "label, precision:f, recall:f, f1_score:f, support:i",
    """SELECT * FROM two
       UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1_score), sum(support) FROM two
       UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
       sum(f1_score * support) / sum(support), sum(support) FROM two""",
))
def classification_report(spark, sf_dir):
    return e.classification_report(e.predicted(scored_labels(spark, sf_dir)))


_AUC = """(count(*) FILTER (WHERE a.p > b.p) + count(*) FILTER (WHERE a.p = b.p) / 2.0) / count(*) AS roc_auc"""


@query("roc_auc", with_ctes(
    {"s": SCORED}, "roc_auc:f", f"SELECT {_AUC} FROM s AS a JOIN s AS b ON a.y = 1 AND b.y = 0"
))
def roc_auc(spark, sf_dir):
    return e.roc_auc(scored_labels(spark, sf_dir))


@query("confidence_stats", with_ctes(
    {"s": SCORED, "c": "SELECT greatest(p, 1.0 - p) AS c FROM s"},
    "median:f, p90:f, mean:f",
    "SELECT quantile_cont(c, 0.5) AS median, quantile_cont(c, 0.9) AS p90, avg(c) AS mean FROM c",
))
def confidence_stats(spark, sf_dir):
    return e.confidence_stats(scored_labels(spark, sf_dir))


@query("compare_to_baseline", with_ctes(
    {
        "s": SCORED,
        "m": """SELECT model, count(*) FILTER (WHERE y = 0 AND p < 0.5) AS tn, count(*) FILTER (WHERE y = 0 AND p >= 0.5) AS fp,
            count(*) FILTER (WHERE y = 1 AND p < 0.5) AS fn, count(*) FILTER (WHERE y = 1 AND p >= 0.5) AS tp FROM s GROUP BY 1""",
        "auc": f"SELECT a.model, {_AUC} FROM s AS a JOIN s AS b ON a.model = b.model AND a.y = 1 AND b.y = 0 GROUP BY 1",
        "x": f"SELECT m.model, {_METRICS}, roc_auc FROM m JOIN auc ON m.model = auc.model",
    },
    "model, accuracy:f, f1_score:f, roc_auc:f, accuracy_gain:f, f1_score_gain:f, roc_auc_gain:f",
    """SELECT x.*, x.accuracy - b.accuracy AS accuracy_gain, x.f1_score - b.f1_score AS f1_score_gain,
       x.roc_auc - b.roc_auc AS roc_auc_gain FROM x, (SELECT * FROM x WHERE model = 'even') AS b""",
))
def compare_to_baseline(spark, sf_dir):
    return e.compare_to_baseline(e.predicted(scored_labels(spark, sf_dir)), "even")


@query("rank_models", with_ctes(
    {
        "s": SCORED,
        "runs": """SELECT 'q' || (doc_id % 5) AS model, doc_id // 100 AS run_time, avg(((p >= 0.5)::INT = y)::INT) AS accuracy,
            avg(p) AS f1_score, max(p) AS roc_auc FROM s GROUP BY 1, 2""",
    },
    "model, accuracy:f, f1_score:f, roc_auc:f",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY run_time DESC) AS k FROM runs) AS x WHERE k = 1
       ORDER BY roc_auc DESC, f1_score DESC, accuracy DESC""",
))
def rank_models(spark, sf_dir):
    """Runs of five models over slices of the labels; the last run of each counts."""
    s = e.predicted(scored_labels(spark, sf_dir))
    runs = s.groupBy(
        F.concat(F.lit("q"), (F.col("doc_id") % 5).cast("string")).alias("model"),
        F.floor(F.col("doc_id") / 100).alias("run_time"),
    ).agg(
        F.avg((F.col("yhat") == F.col("y")).cast("int")).alias("accuracy"),
        F.avg("p").alias("f1_score"),
        F.max("p").alias("roc_auc"),
    )
    return e.rank_models(runs)


_BACKTEST = {
    "bars": SCORED_BARS,
    "x": """SELECT *, count(*) OVER (PARTITION BY "Symbol") AS n, row_number() OVER (PARTITION BY "Symbol" ORDER BY "Date" DESC) AS k,
        lag("Close") OVER (PARTITION BY "Symbol" ORDER BY "Date") AS prev FROM bars""",
    "t": """SELECT "Symbol", "Date", "Close", p, CASE WHEN p >= 0.5 THEN 'UP' ELSE 'DOWN' END AS prediction,
        CASE WHEN "Close" > prev THEN 'UP' ELSE 'DOWN' END AS actual, (p >= 0.5) = ("Close" > prev) AS correct
        FROM x WHERE k <= least(30, n - 60)""",
}


@query("signal_backtest", with_ctes(_BACKTEST, "Symbol, Date:d, Close:f, p:f, prediction, actual, correct", "SELECT * FROM t"))
def signal_backtest(spark, sf_dir):
    return e.signal_backtest(scored_bars(spark, sf_dir))


@query("backtest_accuracy", with_ctes(
    _BACKTEST,
    "Symbol, correct:i, total:i, accuracy_pct:f",
    """SELECT "Symbol", count(*) FILTER (WHERE correct) AS correct, count(*) AS total,
       count(*) FILTER (WHERE correct) * 100.0 / count(*) AS accuracy_pct FROM t GROUP BY 1""",
))
def backtest_accuracy(spark, sf_dir):
    return e.backtest_accuracy(e.signal_backtest(scored_bars(spark, sf_dir)))


_LAST = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "Symbol" ORDER BY "Date" DESC) AS k FROM l) AS x WHERE k <= {}"""


@query("correlation_matrix", with_ctes(
    {**live_ctes(EVENTS_BARS), "t": _LAST.format(50)},
    "Symbol, column_a, column_b, correlation:f",
    " UNION ALL ".join(
        f"""SELECT "Symbol", '{a}' AS column_a, '{b}' AS column_b, CASE WHEN isfinite(corr("{a}", "{b}")) THEN corr("{a}", "{b}") END AS correlation FROM t GROUP BY 1"""
        for a in CORRELATED
        for b in CORRELATED
    ),
))
def correlation_matrix(spark, sf_dir):
    return r.correlation_matrix(features.recent_live_features(events_bars(spark, sf_dir), 50))


_RETURNS = {
    **live_ctes(EVENTS_BARS),
    "t": _LAST.format(100),
    "v": """SELECT "Symbol", "Daily_Returns" AS v, min("Daily_Returns") OVER (PARTITION BY "Symbol") AS lo,
        max("Daily_Returns") OVER (PARTITION BY "Symbol") AS hi FROM t WHERE "Daily_Returns" IS NOT NULL""",
}


@query("returns_histogram", with_ctes(
    {**_RETURNS, "h": 'SELECT *, (hi - lo) / 30.0::DOUBLE AS w, least(floor((v - lo) / ((hi - lo) / 30.0::DOUBLE)), 29)::BIGINT AS bin FROM v'},
    "Symbol, bin:i, bin_start:f, n:i",
    'SELECT "Symbol", bin, min(lo + bin * w) AS bin_start, count(*) AS n FROM h GROUP BY 1, 2',
))
def returns_histogram(spark, sf_dir):
    return r.returns_histogram(features.recent_live_features(events_bars(spark, sf_dir), 100))


@query("returns_stats", with_ctes(
    _RETURNS,
    "Symbol, n:i, mean:f, std:f, lowest:f, highest:f, band_low:f, band_high:f",
    """SELECT "Symbol", count(*) AS n, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS lowest, max(v) AS highest,
       avg(v) - stddev_samp(v) AS band_low, avg(v) + stddev_samp(v) AS band_high FROM v GROUP BY 1""",
))
def returns_stats(spark, sf_dir):
    return r.returns_stats(features.recent_live_features(events_bars(spark, sf_dir), 100))


@query("candle_label_counts", with_ctes(
    CANDLES,
    "Symbol, bullish:i, bearish:i, skipped:i",
    """SELECT coalesce("Symbol", 'TOTAL') AS "Symbol", count(*) FILTER (WHERE label = 'bullish') AS bullish,
       count(*) FILTER (WHERE label = 'bearish') AS bearish, count(*) FILTER (WHERE label IS NULL) AS skipped
       FROM candles GROUP BY ROLLUP ("Symbol")""",
))
def candle_label_counts(spark, sf_dir):
    return r.candle_label_counts(candle_windows(events_bars(spark, sf_dir)))


@query("forecast_point", with_ctes(
    {
        "bars": SCORED_BARS,
        "x": 'SELECT *, row_number() OVER (PARTITION BY "Symbol" ORDER BY "Date" DESC) AS k FROM bars',
    },
    "Symbol, latest_date:d, forecast_date:d, forecast_close:f",
    """SELECT "Symbol", "Date" AS latest_date, CAST("Date" AS DATE) + CAST(CASE dayofweek("Date") WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS INTEGER)
       AS forecast_date, "Close" + "Close" * 0.02 * CASE WHEN p >= 0.5 THEN 1 ELSE -1 END AS forecast_close FROM x WHERE k = 1""",
))
def forecast_point(spark, sf_dir):
    df = scored_bars(spark, sf_dir).withColumn("prediction", F.when(F.col("p") >= 0.5, "UP").otherwise("DOWN"))
    return r.forecast_point(df)


@query("cv_mean_std", with_ctes(
    {"s": SCORED, "f": "SELECT doc_id % 5 AS fold, avg(((p >= 0.5)::INT = y)::INT) AS accuracy FROM s GROUP BY 1"},
    "mean:f, std:f",
    "SELECT avg(accuracy) AS mean, stddev_pop(accuracy) AS std FROM f",
))
def cv_mean_std(spark, sf_dir):
    s = e.predicted(scored_labels(spark, sf_dir))
    folds = s.groupBy((F.col("doc_id") % 5).alias("fold")).agg(
        F.avg((F.col("yhat") == F.col("y")).cast("int")).alias("accuracy")
    )
    return r.cv_mean_std(folds)


@query("sample_rows", with_ctes({"bars": LINEITEM_BARS}, BARS_SHOWN, f"""SELECT * FROM bars
    WHERE substr(md5('42|' || "Symbol" || '|' || strftime("Date", '%Y-%m-%d %H:%M:%S')), 1, 8) < '{int(0.001 * 2**32):08x}'"""))
def sample_rows(spark, sf_dir):
    return r.sample_rows(lineitem_bars(spark, sf_dir), 0.001).select(*BAR_COLUMNS)


@query("take_rows", with_ctes({"bars": LINEITEM_BARS}, BARS_SHOWN, 'SELECT * FROM bars ORDER BY "Date", "Symbol" LIMIT 5'))
def take_rows(spark, sf_dir):
    return r.take_rows(lineitem_bars(spark, sf_dir), 5).select(*BAR_COLUMNS)


@query("score_importance_by_type", with_ctes(
    {"e": "SELECT CASE WHEN label % 2 = 0 THEN 'structured' ELSE 'embedding' END AS type, abs(embedding[1])::DOUBLE AS importance FROM embeddings"},
    "type, importance:f",
    "SELECT type, sum(importance) AS importance FROM e GROUP BY 1",
))
def score_importance_by_type(spark, sf_dir):
    from barloom.sources.adapters import table

    e_ = table(spark, sf_dir, "embeddings").select(
        F.when(F.col("label") % 2 == 0, "structured").otherwise("embedding").alias("type"),
        F.abs(F.get("embedding", F.lit(0))).cast("double").alias("importance"),
    )
    return r.importance_by_type(e_)
