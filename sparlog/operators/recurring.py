"""Recurring problems: set-similarity join on keywords and leader clustering, newest first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..plans.scratch import Rounds

#: Words that do not tell problems apart.
PROBLEM_STOPWORDS = """para como fazer quero esta tudo isso esse essa agora depois antes apenas seguir with from that this have need want make into
user using trying wants tried então tambem também""".split()
#: Rounds in which the first member of every bucket is tried as a leader before all pairs of what is left.
STAR_ROUNDS = 3
#: Its joins are many and grow with the input: none of their sides goes through the driver.
DEALT = "merge"


def keywords(text: Column) -> Column:
    """Sorted distinct words of four or more of a-z, 0-9, - and _ that are no stop-words."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9_-]+"), lambda w: (F.length(w) >= 4) & ~w.isin(PROBLEM_STOPWORDS))
    return F.array_sort(F.array_distinct(words))


def _met(left: DataFrame, right: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(a, b, both, either) for buckets (token, at, words) of two sides that share a token and are ``share`` similar."""
    x = left.select("token", F.col("at").alias("a"), F.col("words").alias("x"))
    y = right.select("token", F.col("at").alias("b"), F.col("words").alias("y"))
    low, whole = share
    sizes = (F.size("x") * low <= F.size("y") * whole) & (F.size("y") * low <= F.size("x") * whole)
    met = x.join(y.hint(DEALT), "token").where((F.col("a") != F.col("b")) & sizes)
    both = F.size(F.array_intersect("x", "y"))
    met = met.select("a", "b", both.alias("both"), (F.size("x") + F.size("y") - both).alias("either"))
    return met.where(F.col("both") * whole >= F.col("either") * low).distinct()


def prefix_buckets(sets: DataFrame, share: tuple[int, int] = (2, 5)) -> DataFrame:
    """(token, at, words): each set (at, words) under its rarest words, as many that two sets of the wanted similarity share one.

    A set of n words can leave out the ceil(share n) - 1 most frequent ones.
    """
    low, whole = share
    rows = sets.select("at", F.explode("words").alias("token"))
    often = rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    ranked = rows.join(often.hint(DEALT), "token").groupBy("at").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("tokens"))
    kept = F.expr(f"size(tokens) - cast((size(tokens) * {low} + {whole - 1}) div {whole} as int) + 1")
    return ranked.join(sets.hint(DEALT), "at").select("at", "words", F.explode(F.slice("tokens", 1, kept)).alias("t")).select("t.token", "at", "words")


def _sets(problems: DataFrame) -> DataFrame:
    """session_id, problem, words, at: what orders problems, newest first and then by session, and tells them apart."""
    at = F.struct((-F.col("generated_at")).alias("age"), F.col("session_id").alias("session_id"), F.md5("problem").alias("code"))
    return problems.where("problem <> ''").select("session_id", "problem", keywords(F.col("problem")).alias("words"), at.alias("at"))


def similar_problems(problems: DataFrame, share: tuple[int, int] = (2, 5)) -> DataFrame:
    """first_session, second_session, shared, united: pairs of different keyword sets of Jaccard similarity ``share`` or more.

    ``problems``: session_id, problem, generated_at. Each set is named by the
    newest problem that has it; equal sets are one; sets without words are
    similar to nothing; null and empty problems are left out.
    """
    sets = _sets(problems).where(F.size("words") > 0).groupBy("words").agg(F.min("at").alias("at"))
    rounds = Rounds(problems.sparkSession, "similar-problems")
    buckets = rounds.keep(prefix_buckets(rounds.keep(sets), share))
    return _met(buckets, buckets, share).where("a < b").select(F.col("a.session_id").alias("first_session"), F.col("b.session_id").alias("second_session"), F.col("both").cast("long").alias("shared"), F.col("either").cast("long").alias("united"))


def leaders(sets: DataFrame, share: tuple[int, int], rounds: Rounds) -> DataFrame:
    """(at, leader): each set's cluster in a greedy pass in order of ``at``: the first leader similar to it, or itself.

    A set is a leader if no earlier one that is similar is a leader. First, the
    earliest sets of all their buckets lead, and what is similar to them is
    settled; that takes families of near copies without their pairs. The pairs
    of what is left are then settled in rounds, each of which decides the sets
    whose earlier neighbours are decided.
    """
    buckets = rounds.keep(prefix_buckets(sets, share))
    led, left = [], buckets
    for _ in range(STAR_ROUNDS):
        first = left.join(left.groupBy("token").agg(F.min("at").alias("first")).hint(DEALT), "token")
        new = rounds.keep(first.groupBy("at").agg(F.bool_and(F.col("at") == F.col("first")).alias("leads")).where("leads").select("at"))
        led.append(new)
        mine = left.join(new.hint(DEALT), "at", "left_semi")
        rest = left.join(new.hint(DEALT), "at", "left_anti")
        settled = rounds.keep(_met(mine, rest, share).select(F.col("b").alias("at")).distinct())
        left = rounds.keep(rest.join(settled.hint(DEALT), "at", "left_anti"))
        if settled.isEmpty():
            break  # no families of near copies
    edges = rounds.keep(_met(left, left, share).where("a < b").select("a", "b"))
    open_ = rounds.keep(left.select("at").distinct())
    while not open_.isEmpty():
        waiting = edges.join(open_.withColumnRenamed("at", "a").hint(DEALT), "a", "left_semi").select(F.col("b").alias("at"))
        new = rounds.keep(open_.join(waiting.hint(DEALT), "at", "left_anti"))
        led.append(new)
        settled = edges.join(new.withColumnRenamed("at", "a").hint(DEALT), "a", "left_semi").select(F.col("b").alias("at"))
        open_ = rounds.keep(open_.join(new.hint(DEALT), "at", "left_anti").join(settled.hint(DEALT), "at", "left_anti"))
    tops = led[0]
    for x in led[1:]:
        tops = tops.unionByName(x)
    tops = rounds.keep(tops)
    joined = _met(buckets.join(tops.hint(DEALT), "at", "left_semi"), buckets.join(tops.hint(DEALT), "at", "left_anti"), share)
    return rounds.keep(joined.groupBy(F.col("b").alias("at")).agg(F.min("a").alias("leader")).unionByName(tops.select("at", F.col("at").alias("leader"))))


def _firsts(rows: DataFrame, group: str, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each group with their place; large groups are cut down in parts first."""
    part = F.pmod(F.xxhash64("session_id"), F.lit(64))
    rows = rows.withColumn("part", part).withColumn("place", F.row_number().over(W.partitionBy(group, "part").orderBy(*order))).where(F.col("place") <= most)
    return rows.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("place") <= most).drop("part")


def recurring_problems(problems: DataFrame, share: tuple[int, int] = (2, 5), least: int = 2) -> DataFrame:
    """representative, n, keywords, sessions: clusters of ``least`` or more similar problems, the largest first (K3).

    ``problems``: session_id, problem, generated_at. Taken newest first, then
    by session, a problem joins the first cluster whose first member's keywords
    are similar to its own (Jaccard ``share``), or opens one. The longest text
    (bytes; then the newest) represents a cluster; up to five keywords that two
    or more members share, by number and then by name; up to ten sessions in
    order. Null and empty problems are left out; problems without keywords are
    similar to nothing; equal sets of keywords are clustered once.
    """
    rounds = Rounds(problems.sparkSession, "recurring-problems")
    rows = rounds.keep(_sets(problems).where(F.size("words") > 0))
    sets = rounds.keep(rows.groupBy("words").agg(F.min("at").alias("at")))
    of_set = leaders(sets, share, rounds).join(sets.hint(DEALT), "at").select("words", "leader")
    found = rounds.keep(rows.join(of_set.hint(DEALT), "words"))
    clusters = found.groupBy("leader").agg(F.count(F.lit(1)).alias("n"), F.min_by("problem", F.struct(-F.octet_length("problem"), F.col("at"))).alias("representative")).where(F.col("n") >= least)
    words = found.join(clusters.select("leader"), "leader").select("leader", F.explode("words").alias("word")).groupBy("leader", "word").agg(F.count(F.lit(1)).alias("m")).where("m >= 2")
    top = words.withColumn("place", F.row_number().over(W.partitionBy("leader").orderBy(F.desc("m"), "word"))).where("place <= 5")
    top = top.groupBy("leader").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), ",").alias("keywords"))
    sessions = _firsts(found.join(clusters.select("leader"), "leader").select("leader", "at", "session_id"), "leader", [F.col("at")], 10)
    sessions = sessions.groupBy("leader").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.col("session_id").cast("string").alias("s")))), lambda x: x["s"]), ",").alias("sessions"))
    out = clusters.join(top, "leader", "left").join(sessions, "leader")
    return out.orderBy(F.desc("n"), "leader").select("representative", "n", F.coalesce("keywords", F.lit("")).alias("keywords"), "sessions")
