"""Bars from the supplied event and order tables, and the test tables derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.ranking import global_rank


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of the event values, one symbol per event type."""
    order = F.struct("ts", "event_id")
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("Symbol"), F.date_trunc("hour", "ts").alias("Date"))
        .agg(
            F.min_by("value", order).alias("Open"),
            F.max("value").alias("High"),
            F.min("value").alias("Low"),
            F.max_by("value", order).alias("Close"),
            F.count(F.lit(1)).cast("double").alias("Volume"),
        )
    )


# Order lines that a task groups by symbol and day; the grouping sorts them with all that breaks ties.
LINES_A_TASK = 1_000_000
# tasks that the lines of one symbol and day are dealt to
SALTS = 8


def _dealt(items: DataFrame, rows: int) -> DataFrame:
    """Lines (Symbol, Date, seq) in tasks of `LINES_A_TASK`, or as they were read if there are few of the `rows`."""
    tasks = -(-rows // LINES_A_TASK)
    if tasks <= items.sparkSession.sparkContext.defaultParallelism:
        return items
    return items.repartition(tasks, "Symbol", "Date", F.pmod(F.xxhash64("seq.l_orderkey"), F.lit(SALTS)))


def lineitem_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of unit prices in whole cents, one symbol per supplier; all columns break ties inside a day."""
    lines = table(spark, sf_dir, "lineitem")
    items = lines.select(
        F.col("l_suppkey").cast("string").alias("Symbol"),
        F.col("l_shipdate").cast("date").alias("Date"),
        (F.floor(F.try_divide(F.col("l_extendedprice") * 100, "l_quantity")) / 100.0).alias("price"),
        "l_quantity",
        F.struct(
            "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"
        ).alias("seq"),
    )
    # the count comes from the files' footers
    return _dealt(items, lines.count()).groupBy("Symbol", "Date").agg(
        F.min_by("price", "seq").alias("Open"),
        F.max("price").alias("High"),
        F.min("price").alias("Low"),
        F.max_by("price", "seq").alias("Close"),
        F.sum("l_quantity").alias("Volume"),
    )


def numbered_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars with `rank`, their number in (Date, Symbol) order."""
    return global_rank(events_bars(spark, sf_dir))


def dirty_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered bars as raw text with faults at fixed ranks, copies with a later `seq`, and a thin symbol."""
    b = numbered_bars(spark, sf_dir)
    r = F.col("rank")

    def text(close, seq) -> list:
        return [
            F.when(r % 29 == 0, "bad date").otherwise(F.date_format("Date", "yyyy-MM-dd HH:mm:ss")).alias("Date"),
            F.col("Open").cast("string").alias("Open"),
            F.when(r % 31 == 0, F.col("Low") - 1).otherwise(F.col("High")).cast("string").alias("High"),
            F.col("Low").cast("string").alias("Low"),
            F.when(r % 17 == 0, "n/a").when(r % 37 == 0, "-1").otherwise(close.cast("string")).alias("Close"),
            F.when(r % 23 != 0, F.col("Volume").cast("string")).alias("Volume"),
            (r * 10 + seq).alias("seq"),
        ]

    first = b.select("Symbol", *text(F.col("Close"), 0))
    again = b.filter(r % 19 == 0).select("Symbol", *text(F.col("Close") + 1, 5))
    thin = b.filter((F.col("Symbol") == "click") & (r <= 200)).select(F.lit("THIN").alias("Symbol"), *text(F.col("Close"), 7))
    return first.unionByName(again).unionByName(thin)


def embeddings_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with the key of the bar whose rank follows their id."""
    keys = numbered_bars(spark, sf_dir).select("Symbol", "Date", (F.col("rank") - 1).alias("vec_id"))
    return table(spark, sf_dir, "embeddings").join(keys, "vec_id").select("Symbol", "Date", "embedding")


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as truth with a deterministic score of two models."""
    return table(spark, sf_dir, "labels").select(
        "doc_id",
        F.col("quality").alias("y"),
        (((F.col("doc_id") * 37) % 101) / F.lit(100.0)).alias("p"),
        F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd").alias("model"),
    )


def scored_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars with a deterministic probability of UP."""
    hour = (F.unix_timestamp("Date") / 3600).cast("long")
    p = ((hour * 37 + F.length("Symbol") * 13) % 101) / F.lit(100.0)
    return events_bars(spark, sf_dir).withColumn("p", p)


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One daily-series payload per symbol and day; every seventh day of the month starts a run of failed ones."""
    day = F.date_trunc("day", "Date")
    texts = [F.col(c).cast("string") for c in ("Open", "High", "Low", "Close", "Volume")]
    names = ["1. open", "2. high", "3. low", "4. close", "5. volume"]
    fields = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*texts))
    # one day of hourly bars: at most 24 entries
    series = F.map_from_entries(F.collect_list(F.struct("k", "f")))
    rows = events_bars(spark, sf_dir).select("Symbol", day.alias("day"), F.date_format("Date", "yyyy-MM-dd HH:mm:ss").alias("k"), fields.alias("f"))
    per_day = rows.groupBy("Symbol", "day").agg(series.alias("s"))
    kind = F.dayofmonth("day") % 7
    payload = (
        F.when(kind == 1, F.lit('{"Note": "too many requests"}'))
        .when(kind == 2, F.lit('{"Information": "daily limit"}'))
        .when(kind == 3, F.lit('{"Error Message": "unknown symbol"}'))
        .when(kind == 4, F.lit('{"Time Series'))
        .otherwise(F.to_json(F.struct(F.col("s").alias("Time Series (Daily)"))))
    )
    return per_day.select("Symbol", "day", payload.alias("payload"))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies from the suppliers: ticker, mapping order, and two names; suppliers of one nation share the second."""
    s = table(spark, sf_dir, "supplier").join(
        table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    return s.select(
        F.concat(F.lit("S"), F.col("s_suppkey")).alias("symbol"),
        F.col("s_suppkey").alias("position"),
        F.array(F.col("s_name"), F.concat(F.lit("Trading House "), F.col("n_name"))).alias("names"),
    )


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Available tickers: suppliers that are not in debt."""
    return table(spark, sf_dir, "supplier").filter("s_acctbal >= 0").select(
        F.concat(F.lit("S"), F.col("s_suppkey")).alias("symbol")
    )


def symbol_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users typed, from the customers: tickers, exact names, parts of names, names in a sentence, nothing."""
    key = F.col("c_custkey")
    number = F.lpad(key.cast("string"), 9, "0")
    kind = key % 6
    text = (
        F.when(kind == 0, F.concat(F.lit(" s"), key.cast("string")))
        .when(kind == 1, F.concat(F.lit("SUPPLIER#"), number))
        .when(kind == 2, F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string")))
        .when(kind == 3, F.concat(F.lit("buy Supplier#"), number, F.lit(" today")))
        .when(kind == 4, F.col("c_name"))
        .otherwise(F.lit("  "))
    )
    return table(spark, sf_dir, "customer").select("c_custkey", text.alias("text"))


def write_symbol_files(spark: SparkSession, sf_dir: str, path: str, twice: bool = False) -> None:
    """Hourly bars as one CSV per event type and day, the raw layout of one file per symbol.

    By day of month some files lack Volume, some order the columns differently,
    some add `Adj Close`. A file is one day, so a task writes small groups. With `twice`
    all have all columns, and each bar stands before itself with another close.
    """
    import pandas as pd
    from pyarrow import fs

    columns = {1: ["Date", "Open", "High", "Low", "Close"], 2: ["Close", "Date", "Low", "High", "Open", "Volume"]}
    plain = ["Date", "Open", "High", "Low", "Close", "Volume"]
    columns[3] = [*plain, "Adj Close"]

    def write(part):
        target, folder = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        target.create_dir(folder, recursive=True)
        stem, kind = part["stem"].iloc[0], part["kind"].iloc[0]
        lines = part.sort_values("Date")
        if twice:
            kind = 0
            lines = pd.concat([lines.assign(Close=lines["Open"]), lines])
        text = lines[columns.get(kind, plain)].to_csv(index=False)
        with target.open_output_stream(f"{folder}/{stem}.csv") as out:
            out.write(text.encode())
        return part[["stem"]].head(1)

    bars = events_bars(spark, sf_dir)
    named = bars.select(
        F.concat_ws("-", "Symbol", F.date_format("Date", "yyyyMMdd")).alias("stem"),
        (F.dayofmonth("Date") % 5).alias("kind"),
        F.date_format("Date", "yyyy-MM-dd HH:mm:ss").alias("Date"),
        "Open",
        "High",
        "Low",
        "Close",
        "Volume",
        F.col("Close").alias("Adj Close"),
    )
    named.groupBy("stem").applyInPandas(write, "stem string").write.format("noop").mode("overwrite").save()
