"""A table that micro-batches change: rows by symbol hash and month, a version a batch, compacted and expired as it grows.

Layout under `path`:

- `batches/batch=B/shard=S/month=M`: what batch B wrote. A batch that is run again replaces its own folder.
- `base/version=B/shard=S/month=M`: the rows of a shard and month as they were up to batch B, the newest of each key.
- `manifest/upto=B`: which version of each shard and month is valid; everything up to batch B is in them.

Every `every` batches the batches so far are merged into new versions of the shards and months that they touched, and of no
others. The merge runs before a batch writes, over batches that ended, so it never mixes with a batch that is run again.
What neither the manifest nor the one before it names is deleted then, so readers of the last state are left alone, and
the number of folders is bounded by shards, kept months and 2 * `every` batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SHARDS = 16
EVERY = 20


class VersionedStore:
    """Rows with a column Symbol. `keys`: the newest batch that holds a key has all its rows. `date` places rows in months; without
    it all rows of a shard are together. `months`: months behind the newest one that are kept, all if not given."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], date: str | None = "Date", shards: int = SHARDS, every: int = EVERY, months: int | None = None):
        self.spark, self.path, self.keys, self.date = spark, path.rstrip("/"), keys, date
        self.shards, self.every, self.months = shards, every, months

    def shard(self) -> F.Column:
        return F.pmod(F.crc32(F.col("Symbol")), F.lit(self.shards)).cast("int")

    def month(self) -> F.Column:
        return F.date_format(self.date, "yyyy-MM") if self.date else F.lit("all")

    def _fs(self, path: str):
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found, found.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self, kind: str) -> list[int]:
        """Batches, versions or manifests that there are."""
        path, fs = self._fs(f"{self.path}/{kind}")
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n.split("=")[1]) for n in names if "=" in n)

    def _delete(self, folder: str) -> None:
        path, fs = self._fs(f"{self.path}/{folder}")
        fs.delete(path, True)

    def _manifests(self) -> list[int]:
        """Those that were written to the end."""
        def done(n: int) -> bool:
            path, fs = self._fs(f"{self.path}/manifest/upto={n}/_SUCCESS")
            return fs.exists(path)

        return [n for n in self._numbers("manifest") if done(n)]

    def _manifest(self, upto: int) -> DataFrame:
        return self.spark.read.schema("shard int, month string, version long").parquet(f"{self.path}/manifest/upto={upto}")

    def write(self, df: DataFrame, batch: int) -> DataFrame:
        """The rows of a batch, written and read back."""
        schema = _ddl(df)
        self.compact(schema, batch)
        self._placed(df).write.mode("overwrite").partitionBy("shard", "month").parquet(f"{self.path}/batches/batch={batch}")
        return self.of_batch(schema, batch)

    def _placed(self, df: DataFrame) -> DataFrame:
        # a few files a shard and month, however many tasks made the rows
        return df.withColumns({"shard": self.shard(), "month": self.month()}).repartition("shard", "month")

    def of_batch(self, schema: str, batch: int) -> DataFrame:
        # found in the folder names beside the schema's own columns
        return self.spark.read.schema(schema).parquet(f"{self.path}/batches/batch={batch}").drop("shard", "month")

    def versions(self, schema: str, below: int) -> DataFrame:
        """All rows of batches under `below`, with batch, shard and month."""
        upto = max(self._manifests(), default=-1)
        names = f"{schema}, batch long, shard int, month string"
        batches = [f"{self.path}/batches/batch={n}" for n in self._numbers("batches") if upto < n < below]
        out = None
        if batches:
            out = self.spark.read.schema(names).option("basePath", f"{self.path}/batches").parquet(*batches)
        if upto >= 0:
            # only the folders that the manifest names, so that no reader meets a file that is deleted; a row a shard and month
            named = [f"{self.path}/base/version={r.version}/shard={r.shard}/month={r.month}" for r in self._manifest(upto).collect()]
            if named:
                base = self.spark.read.schema(f"{names}, version long").option("basePath", f"{self.path}/base").parquet(*named).drop("version")
                out = base if out is None else out.unionByName(base)
        return self.spark.createDataFrame([], names) if out is None else out

    def newest(self, df: DataFrame) -> DataFrame:
        """Of the versions of each key those of its newest batch."""
        age = W.partitionBy(*self.keys).orderBy(F.desc("batch"))
        return df.withColumn("_age", F.rank().over(age)).filter("_age = 1").drop("_age")

    def read(self, schema: str, below: int = 1 << 62, symbols: DataFrame | None = None) -> DataFrame:
        """The current rows before batch `below`; with `symbols` (a column Symbol) only theirs, from their shards alone."""
        df = self.versions(schema, below)
        if symbols is not None:
            df = df.join(symbols.select("Symbol", self.shard().alias("shard")).distinct(), ["shard", "Symbol"], "left_semi")
        return self.newest(df).drop("batch", "shard", "month")

    def compact(self, schema: str, batch: int) -> None:
        """Merge the batches before `batch` if there are `every` of them or more."""
        known = self._manifests()
        upto = max(known, default=-1)
        waiting = [n for n in self._numbers("batches") if upto < n < batch]
        if len(waiting) < self.every:
            return
        last = waiting[-1]
        deltas = self.spark.read.schema(f"{schema}, batch long, shard int, month string").option("basePath", f"{self.path}/batches").parquet(
            *[f"{self.path}/batches/batch={n}" for n in waiting])
        # a row a shard and month
        touched = deltas.select("shard", "month").distinct().withColumn("version", F.lit(last).cast("long"))
        old = self._manifest(upto) if known else touched.limit(0)
        now = touched.unionByName(old.join(touched, ["shard", "month"], "left_anti"))
        if self.months is not None and self.date:
            newest = now.agg(F.max(F.to_date(F.concat("month", F.lit("-01")))).alias("m")).scalar()
            now = now.filter(F.to_date(F.concat("month", F.lit("-01"))) >= F.add_months(newest, -self.months))
        merged = self.newest(self.versions(schema, batch).join(now.filter(F.col("version") == last), ["shard", "month"], "left_semi"))
        merged = merged.withColumn("version", F.lit(last).cast("long")).repartition("shard", "month")
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version", "shard", "month").parquet(f"{self.path}/base")
        now.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/upto={last}")
        self._expire(last, upto)

    def _expire(self, last: int, before: int) -> None:
        """Delete what the manifests `last` and `before` do not name."""
        for n in self._numbers("batches"):
            if n <= before:
                self._delete(f"batches/batch={n}")
        named = {(r.version, r.shard, r.month) for n in (last, before) if n >= 0 for r in self._manifest(n).collect()}
        path, fs = self._fs(f"{self.path}/base/*/*/*")
        left: dict[int, int] = {}
        for status in fs.globStatus(path) or []:
            version, shard, month = str(status.getPath()).split("/")[-3:]
            key = int(version.split("=")[1]), int(shard.split("=")[1]), month.split("=")[1]
            if key in named:
                left[key[0]] = left.get(key[0], 0) + 1
            else:
                self._delete(f"base/{version}/{shard}/{month}")
        for n in self._numbers("base"):
            if n not in left:
                self._delete(f"base/version={n}")
        for n in self._numbers("manifest"):
            if n not in (last, before):
                self._delete(f"manifest/upto={n}")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
