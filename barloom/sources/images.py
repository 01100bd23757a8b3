"""Labels of chart images from their paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def image_paths(spark: SparkSession, root: str) -> DataFrame:
    """Paths of all PNG files under a folder; the files themselves are not read."""
    files = spark.read.format("binaryFile").options(pathGlobFilter="*.png", recursiveFileLookup="true").load(root)
    return files.select("path")


def image_labels(paths: DataFrame, col: str = "path") -> DataFrame:
    """image_path, symbol, date, label of `.../<label>/<SYMBOL>_<date>.png`; other names are left out."""
    path = F.regexp_replace(col, r"\\", "/")
    df = paths.select(path.alias("image_path"))
    name = F.regexp_extract("image_path", r"/(?:bullish|bearish)/([^/]*)\.png$", 1)
    label = F.regexp_extract("image_path", r"/(bullish|bearish)/[^/]*\.png$", 1)
    parts = F.split(name, "_")
    df = df.select("image_path", F.get(parts, F.lit(0)).alias("symbol"), F.get(parts, F.lit(1)).alias("date"), label.alias("label"))
    return df.filter((F.col("label") != "") & (F.col("symbol") != "") & (F.col("date") != ""))
