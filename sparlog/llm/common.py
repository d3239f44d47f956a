"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id inside joins; ``restore_id`` turns it back.
NULL_ID = -(2**63)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or in a local session (tests) a temporary one where unset."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc._conf.get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-ckpt-")
        sc.setCheckpointDir(base)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage."""
    return stored(df, "cut")


#: Lets Spark remove the shuffle files of a statement when it ends.
SHORT_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a compressed Parquet table in the shared folder, read again: its lineage is cut and its shuffle files are gone.

    A lost executor loses nothing of it. ``discard`` removes the table once
    nothing reads it any more.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    before = spark.conf.get(SHORT_SHUFFLES)
    spark.conf.set(SHORT_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SHORT_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Remove tables of ``stored`` or ``cut`` that nothing will read again."""
    for table in tables:
        if table is not None:
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._stored_at)
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text) alone, with a join-safe id; other columns, whatever their names, are left out."""
    return docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)).alias("doc_id"), docs["text"].alias("text"))


def restore_id(name: str = "doc_id") -> Column:
    return F.nullif(F.col(name), F.lit(NULL_ID)).alias(name)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph given as (a, b) rows; component is the least node reachable.

    Alternating large-star and small-star rounds (Kiveris et al., 2014), until
    only stars are left. Each round is two group-by minima joined back, so a
    node with very many neighbours costs a skewed join that Spark can split,
    never one task; the minima of few edges are broadcast. Nodes without an
    edge are not returned. Empty edges give no rows. The result is a table of
    ``cut``.
    """
    e = cut(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    few = e.count() <= MOST_BROADCAST_IDS
    minima = F.broadcast if few else lambda rows: rows
    while True:
        ends = e.select(F.col("a").alias("node"), F.lit(1).alias("low"), F.lit(0).alias("high")).union(e.select("b", F.lit(0), F.lit(1)))
        if ends.groupBy("node").agg(F.sum("low").alias("low"), F.max("high").alias("high")).where("low > 1 or low > 0 and high > 0").isEmpty():
            break
        last = e
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(minima(low), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = large if few else large.distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(minima(low2), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(small.union(low2.select("a", F.col("m").alias("b"))).distinct())
        discard(last)
    tops = e.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    out = cut(e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(tops))
    discard(e)
    return out


#: Ids that ``without`` may broadcast (about 16 MB).
MOST_BROADCAST_IDS = 200_000


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is not in ``ids`` (doc_id, null included); broadcasts ids only when they are counted and few."""
    gone = cut(ids.select(F.col("doc_id").alias("gone_id")).distinct())
    side = F.broadcast(gone) if gone.count() <= MOST_BROADCAST_IDS else gone
    return docs.join(side, docs["doc_id"].eqNullSafe(side["gone_id"]), "left_anti")


def numbered(docs: DataFrame, name: str = "row_number_") -> DataFrame:
    """``docs`` with a long ``name`` that tells apart what differs in doc_id or text, in order of doc_id (null first).

    Where every row has a doc_id of its own, that is the number. Rows equal in
    both columns share a number, as they share every decision.
    """
    n, ids = docs.agg(F.count(F.lit(1)), F.count_distinct(docs["doc_id"])).first()
    if n == ids:
        return docs.withColumn(name, docs["doc_id"].cast("long"))
    told = docs.withColumn("text_md5_", F.md5("text"))
    rows = told.select(F.col("doc_id").alias("id_"), F.col("text_md5_").alias("md5_")).distinct().orderBy("id_", "md5_")
    rows = cut(rows.withColumn(name, F.monotonically_increasing_id()))
    return told.join(rows, told["doc_id"].eqNullSafe(rows["id_"]) & told["text_md5_"].eqNullSafe(rows["md5_"])).drop("id_", "md5_", "text_md5_")
