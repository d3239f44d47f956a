"""The registered queries of the catalogue: a DataFrame for Spark and a statement for the checking engine."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import activity, behaviour, cost, order, recurring, scoring, search, vectors  # noqa: F401  they fill the catalogue
from ..sources import knowledge
from . import catalog
from .scratch import Rounds

TABLES = ("customer", "conversations", "documents", "embeddings", "events", "labels", "lineitem", "pages")


#: What the registered queries ask on the given tables, whose events lie hours apart; all else has its default.
ARGUMENTS: dict[str, dict[str, object]] = {
    "r1_detect_loops": {"min_count": 2, "window_s": 36_000},
    "r4_rule_hook": {"hook_count": 2, "hook_window_s": 36_000},
    "r6_rule_subagent": {"min_pairs": 1},
    "r8_rule_loop_skill": {"skill_count": 2, "skill_window_s": 36_000},
    "r10_advise": {"hook_count": 2, "hook_window_s": 36_000, "skill_count": 2, "skill_window_s": 36_000, "min_pairs": 1},
    "r11_meta_report": {"meta_count": 2, "meta_window_s": 36_000},
    "q4_search_like": {"text": "tion"},
    "q5_search_metadata": {"text": "3"},
}


def _nearest_to_queries(tables: Mapping[str, DataFrame], spark: SparkSession) -> DataFrame:
    every = catalog.frame(spark, "vectors", tables)
    return vectors.nearest(catalog.frame(spark, "vector_queries", tables), every, 50, least=0.0, with_self=True)


def _nearest_sessions(tables: Mapping[str, DataFrame], spark: SparkSession) -> DataFrame:
    every = catalog.frame(spark, "vectors", tables)
    return vectors.nearest(every, every, 10)


def _percentiles(step: str, by: str, value: str, **wanted: tuple[str, float]):
    return lambda tables, spark: order.rank_percentiles(catalog.frame(spark, step, tables), [by], value, wanted)


#: Rows of ``lineitem`` that a task groups at once.
LINES_A_TASK = 500_000


def _dealt_lines(tables: Mapping[str, DataFrame], spark: SparkSession) -> DataFrame:
    lines = tables["lineitem"]
    return lines.select("l_orderkey", "l_partkey", "l_shipdate").repartition(1 + lines.count() // LINES_A_TASK, "l_orderkey", "l_partkey")


def _scored_sets(tables: Mapping[str, DataFrame], spark: SparkSession) -> DataFrame:
    rounds = Rounds(spark, "search-messages")
    messages = rounds.keep(catalog.frame(spark, "message_terms", tables).select("session_id", "ord", "role", "len", F.col("held.term").alias("terms"), F.col("held.tf").alias("tfs")))
    sets = rounds.keep(catalog.frame(spark, "set_lists", tables).select("words", "mean_len", F.col("held.term").alias("terms"), F.col("held.idf").alias("idf")))
    return scoring.first_messages(messages, sets)


#: Inputs of steps that Spark operators make.
MADE: dict[str, Callable[[Mapping[str, DataFrame], SparkSession], DataFrame]] = {
    "knowledge_rows": lambda tables, spark: knowledge.knowledge_from_replies(knowledge.replies_from_pages(tables["pages"])),
    "spread_vocabulary": lambda tables, spark: catalog.frame(spark, "vocabulary", tables).repartition(spark.sparkContext.defaultParallelism),
    "index_rows": lambda tables, spark: Rounds(spark, "text-index").keep(catalog.frame(spark, "token_stems", tables)),
    "scored_rows": _scored_sets,
    "top_rows": lambda tables, spark: Rounds(spark, "search-sets").keep(catalog.frame(spark, "set_hits", tables)),
    "searched_rows": lambda tables, spark: Rounds(spark, "searched").keep(catalog.frame(spark, "searched", tables)),
    "part_word_rows": lambda tables, spark: Rounds(spark, "needle-words").keep(catalog.frame(spark, "part_words", tables)),
    "needle_hit_rows": lambda tables, spark: Rounds(spark, "needle-hits").keep(catalog.frame(spark, "needle_hits", tables)),
    "body_rank_rows": lambda tables, spark: Rounds(spark, "body-ranks").keep(catalog.frame(spark, "body_ranks", tables)),
    "merged_rows": lambda tables, spark: Rounds(spark, "merged-ranks").keep(catalog.frame(spark, "q8_rrf_merge", tables)),
    "shown_hits": lambda tables, spark: Rounds(spark, "search-hits").keep(catalog.frame(spark, "query_hits", tables)),
    "dealt_lines": _dealt_lines,
    "flow_selected": _percentiles("flow_rows", "model", "message_count", p50=("floor", 0.5), p90=("floor", 0.9), p99=("floor", 0.99)),
    "resolved_selected": _percentiles("resolved_rows", "model", "r", p50=("half", 0), p90=("nine_tenths", 0)),
    "selected_cost": _percentiles("project_rows", "project_dir", "cost", p90=("floor", 0.9)),
    "selected_tokens": _percentiles("project_rows", "project_dir", "tokens", p90=("floor", 0.9)),
    "price_percentiles": lambda tables, spark: order.rank_percentiles(tables["lineitem"].selectExpr("l_returnflag || l_linestatus as kind", "l_extendedprice as v"), ["kind"], "v", {"p50": ("floor", 0.5), "p90": ("floor", 0.9), "upper_median": ("half", 0), "nine_tenths": ("nine_tenths", 0)}),
    "lanes": lambda tables, spark: order.thread_lanes(catalog.frame(spark, "thread_rows", tables), ["project_dir", "git_branch", "thread_no"]),
    "recurring_rows": lambda tables, spark: recurring.recurring_problems(catalog.frame(spark, "knowledge", tables)),
    "numbered_sessions": lambda tables, spark: order.numbered(catalog.frame(spark, "sessions", tables).select("session_id", "project_dir", "start_time", "message_count"), [F.desc("start_time"), F.asc("session_id")], "place"),
    "nearest_sessions": _nearest_sessions,
    "nearest_to_queries": _nearest_to_queries,
}


#: Those that are the same whatever is asked.
UNASKED = ("knowledge_rows", "spread_vocabulary", "index_rows")
#: Inputs that a query stores, since several of its steps read them.
KEPT: dict[str, tuple[str, ...]] = {"k5_knowledge_aggregate": ("knowledge_rows",)}


class _Tables(Mapping):
    """Reads a table, or makes an input, only when a step names it; those of ``kept`` are stored."""

    def __init__(self, spark: SparkSession, sf_dir: str, kept: tuple[str, ...] = ()):
        self.spark, self.sf_dir, self.made, self.kept = spark, sf_dir, {}, kept

    def __getitem__(self, name: str) -> DataFrame:
        if name in MADE:
            if name not in self.made:
                made = MADE[name](self, self.spark)
                self.made[name] = Rounds(self.spark, name.replace("_", "-")).keep(made) if name in self.kept else made
            return self.made[name]
        if name not in TABLES:
            raise KeyError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __contains__(self, name: object) -> bool:
        return name in TABLES or name in MADE

    def __iter__(self):
        return iter((*TABLES, *MADE))

    def __len__(self) -> int:
        return len(TABLES) + len(MADE)


class Asked(_Tables):
    """``given`` steps and what is made of them, over ``tables``; what no query has a part in is theirs."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame], given: Mapping[str, DataFrame]):
        super().__init__(spark, "")
        self.tables, self.given = tables, given

    def __getitem__(self, name: str) -> DataFrame:
        if name in self.given:
            return self.given[name]
        own = name in MADE and (name not in UNASKED and isinstance(self.tables, _Tables) or name not in self.tables)
        return super().__getitem__(name) if own else self.tables[name]

    def __contains__(self, name: object) -> bool:
        return name in self.given or name in MADE or name in self.tables


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, n=name: catalog.frame(spark, n, _Tables(spark, sf_dir, KEPT.get(n, ())), **ARGUMENTS.get(n, {}))) for name in catalog.OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {name: catalog.sql(name, **ARGUMENTS.get(name, {})) for name in catalog.OPERATORS}
