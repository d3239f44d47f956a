"""Session roll-ups that rewrite only what a batch changes (ST6)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import logs


class Buckets:
    """A table in hashed buckets, copied on write: a version holds the buckets it changed, and its manifest names every bucket's version.

    A version that is written again gives the same table, since it starts from
    the manifest before it. Versions that neither the newest manifest nor the
    one before it names are removed.
    """

    def __init__(self, spark: SparkSession, where: str, key: str, buckets: int = 64):
        self.spark, self.where, self.key, self.buckets = spark, where.rstrip("/"), key, buckets
        jvm = spark._jvm
        self._path = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join((self.where, *parts)))
        self._fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())

    def manifests(self) -> list[int]:
        if not self._fs.exists(self._path("manifests")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path("manifests"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def manifest(self, version: int) -> dict[int, int]:
        return {int(b): v for b, v in json.loads(self._read(f"{version}.json"))["versions"].items()}

    def _read(self, name: str) -> str:
        with_ = self._fs.open(self._path("manifests", name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(with_, "UTF-8")
        finally:
            with_.close()

    def _put(self, version: int, versions: dict[int, int]) -> None:
        made = self._path("manifests", f".{version}.new")
        out = self._fs.create(made, True)
        out.write(bytearray(json.dumps({"versions": versions}).encode()))
        out.close()
        final = self._path("manifests", f"{version}.json")
        self._fs.delete(final, False)
        if not self._fs.rename(made, final):
            raise OSError(f"no manifest {final.toString()}")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def read(self, schema, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The table as of a version (the newest), or some buckets of it."""
        done = [v for v in self.manifests() if version is None or v <= version]
        versions = self.manifest(done[-1]) if done else {}
        paths = [f"{self.where}/v{v}/bucket={b}" for b, v in sorted(versions.items()) if only is None or b in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def replace(self, version: int, updates: DataFrame, removed: DataFrame | None = None) -> list[int]:
        """Write ``updates`` over rows of the same key, without those of ``removed`` (key), as ``version``; gives the buckets that changed."""
        keys = updates.select(self.key) if removed is None else updates.select(self.key).unionByName(removed.select(self.key))
        changed = sorted(r[0] for r in keys.select(self._bucket().alias("b")).distinct().collect())  # at most ``buckets`` numbers
        before = [v for v in self.manifests() if v < version]
        versions = self.manifest(before[-1]) if before else {}
        old = self.read(updates.schema, before[-1] if before else -1, changed)
        rows = old.join(keys.distinct(), self.key, "left_anti").unionByName(updates).withColumn("bucket", self._bucket())
        rows.repartition(len(changed) or 1, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.where}/v{version}")
        there = {int(s.getPath().getName().split("=")[1]) for s in self._fs.listStatus(self._path(f"v{version}")) if s.getPath().getName().startswith("bucket=")}
        versions = {b: v for b, v in versions.items() if b not in changed} | {b: version for b in changed if b in there}
        self._put(version, versions)
        self._tidy()
        return changed

    def _tidy(self) -> None:
        done = self.manifests()
        named = {(b, v) for m in done[-2:] for b, v in self.manifest(m).items()}
        for v in range(done[-1]):
            if self._fs.exists(self._path(f"v{v}")):
                kept = False
                for s in self._fs.listStatus(self._path(f"v{v}")):
                    name = s.getPath().getName()
                    if name.startswith("bucket=") and (int(name[7:]), v) not in named:
                        self._fs.delete(s.getPath(), True)
                    kept = kept or (name.startswith("bucket=") and (int(name[7:]), v) in named)
                if not kept:
                    self._fs.delete(self._path(f"v{v}"), True)
        for m in done[:-2]:
            self._fs.delete(self._path("manifests", f"{m}.json"), False)


def roll_up_changed(lines: DataFrame, table: Buckets, checkpoint: str):
    """Start the job that re-reads the session files a batch of ``lines`` touches and replaces their sessions in ``table`` (key file_path).

    ``lines`` may come from rolled files or from ``sources.growing``: a touched
    file is read whole, so a session gets all its lines whatever the batch held.
    The names of touched files come to the driver; the stream's limit of files
    a batch bounds them.
    """

    def replace(batch: DataFrame, version: int) -> None:
        spark = batch.sparkSession
        paths = [r[0] for r in batch.select("file_path").distinct().collect()]
        if paths:
            table.replace(version, logs.sessions(logs.parse_events(logs.read_files(spark, paths))))

    return lines.writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
