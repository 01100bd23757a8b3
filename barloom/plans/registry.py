"""A registry of finished training runs in the shared scratch folder, so that processes do not repeat each other's work.

A run is known by a fingerprint of the files of the tables it was made from and of its parameters. Every run is written to
a folder of its own and entered afterwards in a small table, one folder a fingerprint; an entry is only ever added, so
processes that make the same run at once do no harm: the first entry counts. A file that is written anew has another size or time
of change, and so another fingerprint.
"""

from __future__ import annotations

import getpass
import json
import tempfile
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.sources.writers import scratch_dir

#: raised when what a run holds, or the way it is made, changes
VERSION = 1


def registry_dir(spark: SparkSession) -> str:
    """Under spark.checkpoint.dir; a local session without one uses a folder of the machine and the user."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/barloom-registry"
    scratch_dir(spark)  # refuses a cluster without a shared folder
    return f"{tempfile.gettempdir()}/barloom-registry-{getpass.getuser()}"


def fingerprint(spark: SparkSession, tables: list[str], **params) -> str:
    """Of all files under the paths, by place, size and time of change, and of the parameters."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(tables).select("path", "length", "modificationTime")
    # one row a file, added up in the tasks
    seen = files.agg(F.count("path").alias("n"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")).alias("sum")).first()
    said = json.dumps([VERSION, seen.n, str(seen["sum"]), params], sort_keys=True, default=str)
    return spark.range(1).select(F.sha2(F.lit(said), 256).alias("h")).first().h[:32]


def _entries(spark: SparkSession, folder: str) -> list[str]:
    try:
        return [r.path for r in spark.read.schema("path string, made timestamp").parquet(folder).orderBy("made", "path").limit(10).collect()]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def registered(spark: SparkSession, name: str, key: str, make: Callable[[str], None], load: Callable[[str], object]):
    """What `load` reads from the folder of the run `name` of this key; `make` writes a folder where there is none yet."""
    folder = f"{registry_dir(spark)}/{name}/key={key}"
    for path in _entries(spark, folder):
        try:
            return load(path)
        except Exception as error:  # noqa: BLE001 - a scratch folder may have been emptied below a living entry
            if "PATH_NOT_FOUND" not in str(error) and "does not exist" not in str(error):
                raise
    path = f"{registry_dir(spark)}/{name}-{spark.range(1).select(F.uuid().alias('u')).first().u}"
    make(path)
    entry: DataFrame = spark.range(1).select(F.lit(path).alias("path"), F.current_timestamp().alias("made"))
    entry.write.mode("append").parquet(folder)
    return load(path)
