"""Global order without one task: numbers, order statistics and lanes."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..plans.scratch import Rounds


def _ranged(rows: DataFrame, by: list[str], order: list[Column], weight: Column, rounds: Rounds) -> DataFrame:
    """``rows`` with ``before``, the weight of the rows of the same ``by`` that come earlier in ``order``.

    Rows are ranged over partitions by (by, order) and summed within them; a
    group that lies across partitions gets offsets from sums by partition, of
    which there are at most as many as partitions and groups at their borders.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    here = W.partitionBy("part_", *by).orderBy(*order)
    rows = rows.withColumn("weight_", weight).repartitionByRange(n, *by, *order).withColumn("part_", F.spark_partition_id())
    rows = rounds.keep(rows.withColumn("before", F.sum("weight_").over(here.rowsBetween(W.unboundedPreceding, 0)) - F.col("weight_")))
    sums = rows.groupBy("part_", *by).agg(F.sum("weight_").alias("w"))
    earlier = W.partitionBy(*by).orderBy("part_").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("part_", *by, F.sum("w").over(earlier).alias("offset")).where("offset is not null")
    offsets = offsets.select(F.col("part_").alias("p_"), *(F.col(c).alias(f"{c}_of") for c in by), "offset")
    same = F.col("part_") == F.col("p_")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_of"))
    out = rows.join(F.broadcast(offsets), same, "left").withColumn("before", F.col("before") + F.coalesce("offset", F.lit(0)))
    return out.drop("weight_", "part_", "p_", "offset", *(f"{c}_of" for c in by))


def numbered(rows: DataFrame, order: list[Column], name: str = "number", by: list[str] | None = None) -> DataFrame:
    """``rows`` with their number from 1 in ``order``, over all of them or within ``by``; ``order`` should tell rows apart."""
    rounds = Rounds(rows.sparkSession, "numbered")
    one = rows if by else rows.withColumn("all_", F.lit(0))
    out = _ranged(one, by or ["all_"], order, F.lit(1).cast("long"), rounds)
    return out.withColumn(name, F.col("before") + 1).drop("before", "all_")


#: Places (from 0) in n ordered values.
RULES: dict[str, Callable[[Column, float], Column]] = {
    "floor": lambda n, p: F.floor((n - 1) * F.lit(p)),
    "half": lambda n, p: F.floor(n / 2),
    "nine_tenths": lambda n, p: F.least(F.floor(n * 9 / 10), n - 1),
}


def rank_percentiles(rows: DataFrame, by: list[str], value: str, wanted: Mapping[str, tuple[str, float]]) -> DataFrame:
    """by, n and each of ``wanted``: exact order statistics of ``value`` in every group.

    ``wanted`` names a rule of ``RULES`` and its share: {"p90": ("floor", 0.9)}.
    Values are counted first, so that equal ones are one row, and groups of any
    size are ranged over tasks. Nulls are left out; a group of nulls has no row.
    """
    rounds = Rounds(rows.sparkSession, "percentiles")
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("times"))
    placed = _ranged(counts, by, [F.col(value).asc()], F.col("times"), rounds)
    sizes = placed.groupBy(*by).agg(F.sum("times").alias("n"))
    ends = sizes.select(*(F.col(c).alias(f"{c}_of") for c in by), "n", *(F.greatest(RULES[rule](F.col("n"), p), F.lit(0)).alias(f"{name}_at") for name, (rule, p) in wanted.items()))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_of"))
    # only rows that hold a wanted place stay: a few for each group
    inside = lambda name: (F.col(f"{name}_at") >= F.col("before")) & (F.col(f"{name}_at") < F.col("before") + F.col("times"))
    any_ = inside(next(iter(wanted)))
    for name in wanted:
        any_ = any_ | inside(name)
    held = placed.join(ends, same).where(any_)
    return held.groupBy(*by).agg(F.first("n").alias("n"), *(F.max(F.when(inside(name), F.col(value))).alias(name) for name in wanted))


def thread_lanes(sessions: DataFrame, thread: list[str]) -> DataFrame:
    """thread columns, first_index, last_index, sessions: each thread's span in the order of all sessions by (start_time, session_id), from 0."""
    placed = numbered(sessions.select(*thread, "start_time", "session_id"), [F.col("start_time"), F.col("session_id")], "place")
    return placed.groupBy(*thread).agg((F.min("place") - 1).alias("first_index"), (F.max("place") - 1).alias("last_index"), F.count(F.lit(1)).alias("sessions"))
