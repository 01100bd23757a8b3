"""Reading bars from CSV: one table of bars, or a directory with one file per symbol."""

from __future__ import annotations

from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.schema import BAR_SCHEMA, NUMERICS

FILE_COLUMNS = ["Date", *NUMERICS]


def read_bars_csv(spark: SparkSession, path: str, schema: str = BAR_SCHEMA) -> DataFrame:
    """A CSV file or directory with a header and the bar columns in schema order."""
    return spark.read.schema(schema).csv(path, header=True)


def stem(file_name: str | Column) -> Column:
    """File name without folder and extension; that is the symbol."""
    return F.regexp_extract(file_name, r"([^/]+)\.[^./]+$", 1)


def file_headers(spark: SparkSession, path: str) -> DataFrame:
    """Per non-empty CSV file its path, its name and its column names in order; quoted names may hold commas."""
    lines = spark.read.option("pathGlobFilter", "*.csv").text(path).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_start"))
    # the id rises in line order inside a task, and the start of a file is read by one task
    starts = lines.filter("_start = 0").withColumn("_id", F.monotonically_increasing_id())
    first = starts.groupBy("path").agg(F.min_by("value", "_id").alias("_line"))
    fields = F.regexp_extract_all(F.concat("_line", F.lit(",")), F.lit('("(?:[^"]|"")*"|[^,]*),'), F.lit(1))
    names = F.transform(fields, lambda c: F.btrim(c, F.lit(' "\r\ufeff')))
    return first.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), names.alias("header"))


def column_contract(spark: SparkSession, path: str, required: Iterable[str] = FILE_COLUMNS) -> DataFrame:
    """Per file the missing columns, whether it can be used, and whether it has the required columns in another order."""
    wanted = F.array(*[F.lit(c) for c in required])
    missing = F.array_sort(F.array_except(wanted, F.col("header")))
    kept = F.filter("header", lambda c: F.array_contains(wanted, c))
    ok = F.size(missing) == 0
    return file_headers(spark, path).select("file", missing.alias("missing"), ok.alias("ok"), (ok & (kept != wanted)).alias("reordered"))


def read_symbol_dir(
    spark: SparkSession, path: str, symbols: list[str] | None = None, limit: int | None = None, multi_line: bool = False
) -> DataFrame:
    """All files `<SYMBOL>.csv` as one table of text columns plus `Adj Close` where a file has it, and `seq`.

    Columns are found by each file's own header, so files may order them differently or hold any number more; files
    that lack a required column or hold no line are skipped. `symbols` keeps the listed ones (unknown ones do not
    matter), `limit` the first n of the list, or of all symbols in order. `seq` orders the lines of a file: (path, start
    of the file's part, line in the part). With `multi_line` quoted values may hold line breaks; a file is then one task.

    Files with one header are read together, so there are as many scans as there are different headers. Their paths pass
    through the driver, as those of any listing do.
    """
    wanted = F.array(*[F.lit(c) for c in FILE_COLUMNS])
    headers = file_headers(spark, path).filter(F.size(F.array_except(wanted, F.col("header"))) == 0)
    if symbols is not None:
        headers = headers.filter(F.col("file").isin([f"{s}.csv" for s in (symbols[:limit] if limit else symbols)]))
    elif limit:
        headers = headers.join(list_symbols(spark, path).select("file").distinct().orderBy("file").limit(limit), "file", "left_semi")
    groups = headers.groupBy("header").agg(F.collect_list("path").alias("paths")).collect()
    columns = ["Symbol", *FILE_COLUMNS, "Adj Close"]
    out = spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns) + ", seq struct<path: string, start: bigint, line: bigint>")
    for group in sorted(groups, key=lambda g: g.header):
        places = {name: k for k, name in reversed(list(enumerate(group.header)))}
        read = spark.read.schema(", ".join(f"c{k} string" for k in range(len(group.header)))).option("multiLine", multi_line)
        rows = read.csv([unquote(p) for p in sorted(group.paths)], header=True, quote='"', escape='"')
        where = F.col("_metadata.file_path")

        def field(name: str, places: dict[str, int] = places) -> Column:
            return (F.col(f"c{places[name]}") if name in places else F.lit(None).cast("string")).alias(name)

        seq = F.struct(where.alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))
        out = out.unionByName(rows.select(stem(F.url_decode(F.replace(where, F.lit("+"), F.lit("%2B")))).alias("Symbol"), *[field(c) for c in columns[1:]], seq.alias("seq")))
    return out


def list_symbols(spark: SparkSession, path: str) -> DataFrame:
    """File names and symbols of a directory, empty files included; only the listing is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path).select("path")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select(name.alias("file"), stem("path").alias("Symbol"))
