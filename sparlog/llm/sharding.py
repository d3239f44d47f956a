"""Balanced label propagation over linked documents, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import cut, partitions


def _links(docs: DataFrame, marks: int) -> DataFrame:
    """cls, mark: the ``marks`` least hashes of the adjoining word pairs of each text class."""
    words = docs.withColumn("words", F.split(F.lower("text"), r"\s+"))
    codes = words.select("cls", F.array_distinct(F.zip_with("words", F.expr("slice(words, 2, size(words))"), lambda a, b: F.xxhash64(a, b))).alias("codes"))
    least = [F.expr(f"array_min(transform(codes, c -> xxhash64(c, {k})))") for k in range(marks)]
    return codes.select("cls", F.explode(F.array(*least)).alias("mark")).where("mark is not null").distinct()


def shard(docs: DataFrame, shards: int = 24, rounds: int = 4, slack: float = 0.25, marks: int = 3) -> DataFrame:
    """Deal every row of (doc_id, text) into shards whose row counts differ by at most one.

    Texts are linked when they are equal or agree in one of ``marks`` min-hashes
    of their word pairs. Classes of equal texts take labels that start from
    their first mark; in each round a class moves to the label that most of
    its neighbours have, if that cuts fewer links and the label's quota, the
    mean load and ``slack``, has room. Rounds allow moves to smaller and to
    larger labels by turns, so that two neighbours do not swap theirs. At last
    the rows, in order of label, neighbourhood (the least mark within two
    steps) and class, are dealt in equal runs: the borders of shards fall
    between labels, or between neighbourhoods of one. A class or neighbourhood
    larger than a shard lies in adjoining ones.

    Returns doc_id, size (UTF-8 bytes and 8), text_crc32, law ("rows"), shard,
    slot, grown_shard (null). A null text counts as empty; repeated rows are
    dealt each; ties in order are rows that are equal in doc_id and text; an
    empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    whole = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text")).withColumn("cls", F.md5("text"))
    rows = cut(whole.select("doc_id", F.octet_length("text").cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), "cls"))
    total = rows.count()
    links = _links(whole, marks)
    shared = links.groupBy("mark").agg(F.count("*").alias("m")).where("m > 1").select("mark")
    links = cut(links.join(shared, "mark"))
    start = links.groupBy("cls").agg(F.min("mark").alias("mark"))
    sizes = rows.groupBy("cls").agg(F.count("*").alias("n"))
    labels = cut(sizes.join(start, "cls", "left").select("cls", "n", F.pmod(F.xxhash64(F.coalesce(F.col("mark").cast("string"), "cls")), F.lit(shards)).cast("int").alias("label")))
    quota = total * (1 + slack) / shards
    chunks = max(1, min(256, total // (shards * 2000)))
    for turn in range(rounds):
        loads = labels.groupBy("label").agg(F.sum("n").alias("load"))
        at_mark = links.join(labels, "cls")
        votes = at_mark.groupBy("mark", "label").agg(F.count("*").alias("v"))
        # what each class sees around it: a mark's members but itself
        seen = at_mark.select("cls", "mark", F.col("label").alias("own")).join(votes, "mark").groupBy("cls", "own", "label").agg(F.sum(F.col("v") - F.when(F.col("label") == F.col("own"), 1).otherwise(0)).alias("w"))
        best = seen.groupBy("cls", "own").agg(F.max_by("label", F.struct("w", F.col("label") == F.col("own"), -F.col("label"))).alias("to"), F.max("w").alias("w"), F.coalesce(F.max(F.when(F.col("label") == F.col("own"), F.col("w"))), F.lit(0)).alias("stay"))
        moves = best.where(f"`to` {'<' if turn % 2 == 0 else '>'} own and w > stay").join(labels.select("cls", "n"), "cls").withColumn("chunk", F.pmod(F.xxhash64("cls"), F.lit(chunks)))
        room = loads.select(F.col("label").alias("to"), (F.greatest(F.lit(quota) - F.col("load"), F.lit(0.0)) / chunks).alias("room"))
        ranked = moves.withColumn("taken", F.sum("n").over(W.partitionBy("to", "chunk").orderBy(F.desc(F.col("w") - F.col("stay")), "cls").rowsBetween(W.unboundedPreceding, 0)))
        accepted = ranked.join(F.broadcast(room), "to", "left").where(F.col("taken") <= F.coalesce("room", F.lit(quota / chunks))).select("cls", "to")
        labels = cut(labels.join(accepted, "cls", "left").select("cls", "n", F.coalesce("to", "label").alias("label")))
    # the least mark of a class and of those within two steps
    near = start.withColumnRenamed("mark", "home")
    for _ in range(2):
        least = links.join(near, "cls").groupBy("mark").agg(F.min("home").alias("home"))
        near = cut(links.join(least, "mark").groupBy("cls").agg(F.min("home").alias("home")))
    homes = labels.join(near, "cls", "left").withColumn("home", F.coalesce("home", F.xxhash64("cls")))
    crowds = homes.groupBy("label", "home").agg(F.sum("n").alias("crowd"))
    homes = cut(homes.join(crowds, ["label", "home"]))
    # equal runs of all rows in order of (label, part, salt): counts by run first, then places within runs
    parts = max(partitions(spark), total // (shards * 20_000))
    placed = rows.join(homes, "cls").withColumn("part", F.pmod(F.xxhash64("home"), F.lit(parts)))
    # large neighbourhoods are dealt by class, and large classes by row
    own = F.when(F.col("n") > 500, F.xxhash64("doc_id")).otherwise(F.xxhash64("cls"))
    placed = placed.withColumn("salt", F.when(F.col("crowd") > 500, F.pmod(own, F.ceil(F.col("crowd") / 500).cast("long"))).otherwise(0))
    key = ["label", "part", "salt"]
    runs = placed.groupBy(*key).agg(F.count("*").alias("m"))
    # runs of one label are summed by label, then within it: no window holds more than a label's runs
    by_label = runs.groupBy("label").agg(F.sum("m").alias("m"))
    base = by_label.select("label", (F.sum("m").over(W.orderBy("label")) - F.col("m")).alias("base"))
    before = runs.withColumn("before", F.sum("m").over(W.partitionBy("label").orderBy("part", "salt")) - F.col("m")).join(F.broadcast(base), "label").select(*key, (F.col("base") + F.col("before")).alias("before"))
    ranked = placed.withColumn("k", F.row_number().over(W.partitionBy(*key).orderBy("home", "cls", "doc_id"))).join(before, key).withColumn("rank", F.col("k") - 1 + F.col("before"))
    out = ranked.withColumn("shard", F.expr(f"cast((rank * {shards}) div {max(total, 1)} as int)"))
    slot = F.expr(f"rank - ((cast(shard as long) * {max(total, 1)} + {shards - 1}) div {shards})")
    return out.select("doc_id", (F.col("size") + 8).alias("size"), "text_crc32", F.lit("rows").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
