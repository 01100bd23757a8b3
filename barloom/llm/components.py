"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step is a grouped minimum (combined before the shuffle) and a join on equal keys. A node with more than one in
`SHARE` of all links would be a task of its own in that join; there are few of them, so they are sent to all tasks. The minima and each step's
links are written to the shared scratch folder, so no plan holds another step's: the driver plans and tracks a few exchanges at a
time, however many partitions they have, and gives their memory back after each round.
"""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.sources.writers import scratch_dir


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared scratch folder and read back."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: rows of an Arrow batch where rows carry whole texts
LEAN = 1000


def lean(spark: SparkSession) -> None:
    """Small Arrow batches for this session, and no shuffle files, broadcasts and garbage of steps before.

    A batch of texts is held by the JVM, outside its heap, and twice by the Python worker; the rows of a batch change the
    memory of a task, not its result.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(LEAN))
    release(spark)
    sweep(spark)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of steps whose results have been written.

    The plan that ran last stays referenced until another one runs, so a tiny one comes first.
    """
    spark.range(1).count()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def sweep(spark: SparkSession) -> None:
    """Lets the executors' JVMs give back what their heaps hold of steps before; Python workers need memory beside them.

    A heap grows with the garbage of a step and stays so: a collection that was asked for makes it smaller again.
    """
    tasks = spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).select(F.expr("reflect('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()


#: a node is hot from one in so many of all links on, so there are at most 2 * SHARE of them
SHARE = 500


def _least(edges: DataFrame) -> DataFrame:
    """(u, m, n): of every node the smallest of itself and its neighbours, and the number of its links."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("m", "u").alias("m"), "n")


def _large_star(edges: DataFrame, least: DataFrame, links: int) -> DataFrame:
    # larger neighbours only
    larger = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    many = max(links // SHARE, 100)
    hot = F.broadcast(least.filter(F.col("n") > many).select("u", F.col("m").alias("hot")))
    larger = larger.join(hot, "u", "left")
    rest = larger.filter("hot IS NULL").drop("hot").join(least.filter(F.col("n") <= many).drop("n"), "u")
    found = larger.filter("hot IS NOT NULL").select("u", "v", F.col("hot").alias("m")).unionByName(rest.select("u", "v", "m"))
    return found.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    rest = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.withColumnRenamed("m", "v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): for every node with a link the smallest node that it reaches. links: columns a, b of one type."""
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = saved(edges, "links")
    mark = edges.agg(F.count("*"), F.lit(None)).first()
    while mark[0]:
        least = saved(_least(edges), "least")
        larger = saved(_large_star(edges, least, mark[0]), "larger")
        edges = saved(_small_star(larger), "stars")
        release(edges.sparkSession)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
