"""Tables between the rounds of iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``; in a local session (tests) without one a temporary folder, kept for the session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-rounds-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Lets Spark remove the shuffle files of a statement when it ends.
SHORT_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Rounds:
    """Parquet tables of one run of an operator: ``keep`` writes one, whose shuffle files are gone then, and reads it again, ``drop`` removes those given."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.paths = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{len(self.paths)}"
        before = self.spark.conf.get(SHORT_SHUFFLES)
        self.spark.conf.set(SHORT_SHUFFLES, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(SHORT_SHUFFLES, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths[id(t)][1])
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def drop_all_but(self, *kept: DataFrame) -> None:
        self.drop(*(t for t, _ in self.paths.values() if all(t is not k for k in kept)))
