"""EMA12, RSI and MACD of a stream of bars from constant state per symbol, without a loop over rows.

The averages are linear in what went before: with the value c that an average had before a symbol's new rows and x the
first new input, the k-th new value is y_k + q^k (c - x), where y is the average that starts at x and q = 1 - alpha. So the
closed form of `operators.ewm` runs over the new rows alone, laid out in blocks (a long backlog of one symbol is many
tasks), and the state only corrects the first rows: after `HEAD` of them q^k is below double precision.

Two stores hold the averages of every bar and, for each symbol and month, the state behind the month's last bar. Bars that
come in order go on from the newest state. A late bar makes its symbol go on from the last month before it: the stored bars
from then on, and the new ones, are computed again. A batch that is run again replaces its own rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.operators.clean import dedup_keep_last
from barloom.operators.ewm import Ewm, halo, span, with_ewm
from barloom.operators.layout import HALO, lay_out, over, settle
from barloom.streaming.store import EVERY, SHARDS, VersionedStore

FAST, SLOW, SIGNAL, WILDER = span(12), span(26), span(9), 1 / 14
#: rows after which the state no longer shows in a double
HEAD = max(halo(a) for a in (FAST, SLOW, SIGNAL, WILDER))
BARS = "Symbol string, Date timestamp, Close double"
#: raw averages are state: they have values before the row is far enough for them to be shown
RAW = "fast double, slow double, gain double, loss double, signal double, n long"
OUTPUT = f"{BARS}, EMA12 double, RSI double, MACD double, MACD_Signal double"
STORED = f"{OUTPUT}, {RAW}"
STATE = f"Symbol string, Date timestamp, Close double, {RAW}"


def _power(alpha: float) -> Column:
    return F.pow(F.lit(1 - alpha), "_k")


def _from_state(name: str, alpha: float, first: Column) -> Column:
    """The correction by the state; null, and so none, without state or behind the head."""
    return F.coalesce(_power(alpha) * (F.col(f"_was.{name}") - first), F.lit(0.0))


def advance(rows: DataFrame, start: DataFrame) -> DataFrame:
    """The averages of `rows` (Symbol, Date, Close; unique) that go on from `start` (Symbol, was: a state or null)."""
    by = W.partitionBy("Symbol").orderBy("Date")
    head = rows.withColumn("_k", F.row_number().over(by)).filter(F.col("_k") <= HEAD)
    head = head.withColumn("_x", F.first("Close").over(by)).join(start.withColumnRenamed("was", "_was"), "Symbol", "left")
    df = rows.join(head.select("Symbol", "Date", "_k", "_x", "_was"), ["Symbol", "Date"], "left")
    df = lay_out(df, before=HALO, after=1)
    before = F.coalesce(F.lag("Close").over(over(df)), F.col("_was.Close"))
    df = df.withColumns({
        # the first bar of a series has no change
        "_up": F.when(before.isNotNull(), F.greatest(F.col("Close") - before, F.lit(0.0))),
        "_down": F.when(before.isNotNull(), F.greatest(before - F.col("Close"), F.lit(0.0))),
        # behind the head every average is long past its first rows
        "n": F.when(F.col("_k").isNull(), HEAD).otherwise(F.least(F.coalesce("_was.n", F.lit(0)) + F.col("_k"), F.lit(HEAD))).cast("long"),
        "_rose": F.greatest(F.col("_x") - F.col("_was.Close"), F.lit(0.0)), "_fell": F.greatest(F.col("_was.Close") - F.col("_x"), F.lit(0.0)),
    })
    df = with_ewm(df, {"_fast": Ewm("Close", FAST), "_slow": Ewm("Close", SLOW), "_gain": Ewm("_up", WILDER), "_loss": Ewm("_down", WILDER)})
    df = df.withColumns({
        "fast": F.col("_fast") + _from_state("fast", FAST, F.col("_x")),
        "slow": F.col("_slow") + _from_state("slow", SLOW, F.col("_x")),
        # the first change of a series starts its average
        "gain": F.col("_gain") + F.when(F.col("_was.n") >= 2, _from_state("gain", WILDER, F.col("_rose"))).otherwise(0.0),
        "loss": F.col("_loss") + F.when(F.col("_was.n") >= 2, _from_state("loss", WILDER, F.col("_fell"))).otherwise(0.0),
    })
    df = df.withColumn("_macd", F.when(F.col("n") >= 26, F.col("fast") - F.col("slow")))
    df = with_ewm(df, {"_signal": Ewm("_macd", SIGNAL)})

    def next_of(name: str, alpha: float) -> Column:
        return F.col(f"_was.{name}") + alpha * (F.col("_x") - F.col(f"_was.{name}"))

    first_macd = next_of("fast", FAST) - next_of("slow", SLOW)
    df = df.withColumn("signal", F.col("_signal") + F.when(F.col("_was.n") >= 26, _from_state("signal", SIGNAL, first_macd)).otherwise(0.0))
    df = df.withColumns({
        "EMA12": F.when(F.col("n") >= 12, F.col("fast")),
        "RSI": F.when((F.col("n") >= 15) & (F.col("loss") > 0), 100.0 - 100.0 / (1.0 + F.col("gain") / F.col("loss"))),
        "MACD": F.col("_macd"),
        "MACD_Signal": F.when(F.col("n") >= 34, F.col("signal")),
    })
    return settle(df).select(*[c.split()[0] for c in STORED.split(", ")])


class RunningAverages:
    """The averages of all bars so far, kept up to date with a stream."""

    def __init__(self, spark: SparkSession, store: str, shards: int = SHARDS, every: int = EVERY):
        root = store.rstrip("/")
        self.averages = VersionedStore(spark, f"{root}/averages", ["Symbol", "Date"], "Date", shards, every)
        self.state = VersionedStore(spark, f"{root}/state", ["Symbol", "_month"], "Date", shards, every)

    def step(self, batch: DataFrame, batch_id: int) -> None:
        new = batch.select("Symbol", F.col("Date").cast("timestamp").alias("Date"), F.col("Close").cast("double").alias("Close"))
        new = dedup_keep_last(new.filter("Symbol IS NOT NULL AND Date IS NOT NULL AND Close IS NOT NULL"), order=[])
        first = new.groupBy("Symbol").agg(F.min("Date").alias("_first"))
        states = self.state.read(f"{STATE}, _month string", batch_id, first).join(first, "Symbol")
        was = F.struct(*[c.split()[0] for c in STATE.split(", ")[1:]])
        earlier = F.col("_month") < F.date_format("_first", "yyyy-MM")
        start = states.groupBy("Symbol", "_first").agg(
            F.max("Date").alias("_newest"), F.max_by(was, "Date").alias("_last"), F.max_by(F.when(earlier, was), F.when(earlier, F.col("Date"))).alias("_before"))
        late = F.col("_first") <= F.col("_newest")
        start = start.select("Symbol", "_first", late.alias("_late"), F.when(late, F.col("_before")).otherwise(F.col("_last")).alias("was"))
        again = start.filter("_late").select("Symbol", F.date_trunc("month", "_first").alias("_from"))
        rows = new
        if not again.isEmpty():
            stored = self.averages.read(STORED, batch_id, again).join(again, "Symbol").filter(F.col("Date") >= F.col("_from"))
            known = stored.select("Symbol", "Date", "Close", F.lit(0).alias("_age")).unionByName(new.withColumn("_age", F.lit(1)))
            rows = dedup_keep_last(known, order=["_age"]).drop("_age")
        made = self.averages.write(advance(rows, start.select("Symbol", "was")), batch_id)
        month = F.date_format("Date", "yyyy-MM").alias("_month")
        names = [c.split()[0] for c in STATE.split(", ")[1:]]
        ends = made.groupBy("Symbol", month).agg(F.max_by(F.struct(*names), "Date").alias("s"))
        self.state.write(ends.select("Symbol", *[F.col(f"s.{n}").alias(n) for n in names], "_month"), batch_id)

    def start(self, bars: DataFrame, checkpoint: str):
        return bars.writeStream.foreachBatch(self.step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def read(self) -> DataFrame:
        """The current averages, one row a bar."""
        return self.averages.read(STORED).select(*[c.split()[0] for c in OUTPUT.split(", ")])
