"""Registered queries of operators that are written with DataFrames, each with SQL of its own."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import query_language
from ..operators import recurring, topics
from ..sources import growing, logs
from ..streaming import live, rollup
from . import catalog, checks, log_queries
from . import queries as catalogue
from .scratch import shared_dir

LINE = "project:/P/ model:opus since:20d cost:>0.01 cost:<50 branch:cc-1 the rest of it cost:free since:soon"


def _frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return catalog.frame(spark, name, catalogue._Tables(spark, sf_dir))


def k3_recurring_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the titles of all pages."""
    return recurring.recurring_problems(_frame(spark, sf_dir, "knowledge"))


def j5_similar_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurring.similar_problems(_frame(spark, sf_dir, "knowledge"))


def p5_search_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_language.search_filters(_frame(spark, sf_dir, "p1_session_cost"), LINE, datetime(2024, 1, 31)).select("session_id", "residual")


def p4_resolve_session_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every session's id as a UUID, asked for by beginnings of six characters and more in upper and lower case."""
    code = F.md5("session_id")
    dashed = F.concat_ws("-", *(F.substring(code, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    sessions = _frame(spark, sf_dir, "sessions").select(dashed.alias("session_id"), "start_time", "message_count")
    asked = sessions.select(F.substring(F.when(F.col("message_count") % 2 == 0, F.upper("session_id")).otherwise(F.col("session_id")), F.lit(1), (F.col("message_count") % 33 + 5).cast("int")).alias("q"))
    return query_language.resolve_session_ids(sessions, asked)


def q15_kmeans_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten topics of all vectors; tests hold the rounds to their rules, SQL cannot express them."""
    return topics.kmeans_topics(_frame(spark, sf_dir, "vectors"))[0].select("session_id", "topic")


def s11_input_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.tool_events(log_queries._work(spark, sf_dir)).select("session_id", F.col("ord.block").alias("event_id"), "input_preview")


def s2_subagent_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of conversations; every assistant turn is a sub-agent's file of the conversation before as well."""
    line = "to_json(named_struct('type', role, 'message', named_struct('role', role, 'content', text))) as line"
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'assistant'")
    agents = logs.parse_events(rows.selectExpr("concat('/logs/-p/', conv_id - 1, '/subagents/a', turn, '.jsonl') as file_path", log_queries._MTIME, log_queries._ORD.format("turn"), line))
    return logs.sessions(log_queries._talk(spark, sf_dir), agents).select("session_id", "sidechain_turns", "sidechain_agents")


def st1_growing_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as log files that grow: those with even turns come first, the stream reads them, then it reads what was appended."""
    spark.dataSource.register(growing.GrowingLogs)
    base = f"{shared_dir(spark)}/growing-{uuid.uuid4().hex}"
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").selectExpr("to_json(named_struct('type', role, 'sessionId', cast(conv_id as string), 'message', named_struct('role', role, 'content', text))) as value", "turn")
    lines = spark.readStream.format("growing_logs").option("path", f"{base}/logs").option("pattern", "*.txt").load()
    for part in (0, 1):
        rows.where(F.col("turn") % 2 == part).select("value").write.mode("append").text(f"{base}/logs")
        lines.writeStream.format("parquet").option("path", f"{base}/read").option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start().awaitTermination()
    read = spark.read.schema(lines.schema).parquet(f"{base}/read").select("file_path", F.lit(None).cast("timestamp").alias("mtime"), F.struct(F.col("at").alias("block"), F.lit(0).cast("long").alias("row")).alias("ord"), "line")
    return logs.messages(logs.parse_events(read)).groupBy("session_id", "role").agg(F.count(F.lit(1)).alias("messages"))


def st6_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' calls by bucket: all of them, then those of each third user again with the later half of the events, in further versions."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rolled = lambda rows: rows.groupBy(F.col("user_id").cast("string").alias("session_id")).agg(F.count(F.lit(1)).alias("calls"), F.max("event_id").alias("last_event"))
    table = rollup.Buckets(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}", "session_id", 16)
    table.replace(0, rolled(events.where("event_id % 2 = 0")))
    changed = rolled(events.where("user_id % 3 = 0"))
    table.replace(1, changed, removed=events.where("user_id % 10 = 1").select(F.col("user_id").cast("string").alias("session_id")))
    return table.read(changed.schema)


def st5_late_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loop alerts of each user and tool within three days, an alert a day at most (ST3), of a stream that is there as a whole (ST5)."""
    return live.drain(live.stream_loops(log_queries._stream(spark, sf_dir), window_s=3 * 86_400, least=2, debounce_s=86_400), shared_dir(spark)).select("session_id", "tool_name", "input_hash", F.unix_micros("ts").alias("us"), "hits")


_ALL = (s11_input_preview, s2_subagent_sessions, st1_growing_logs, st6_roll_up, st5_late_calls, q15_kmeans_topics, k3_recurring_problems, j5_similar_problems, p5_search_filters, p4_resolve_session_id)

# the rule of alerts, one call of a (user, tool) after another: recent calls of each input, those after an alert forgotten
def _loops(window_us: int, least: int, debounce_us: int) -> str:
    return f"""with recursive e as (select user_id, event_type, props, epoch_us(ts) as us, row_number() over (partition by user_id, event_type order by ts, props) as i from events),
go(user_id, event_type, i, recent, last_us, us, props, hits, alerted) as (
    select user_id, event_type, cast(0 as bigint), cast([] as struct(h varchar, t bigint)[]), cast(-4611686018427387904 as bigint), cast(0 as bigint), cast('' as varchar), cast(0 as bigint), false from e where i = 1
    union all select user_id, event_type, i, case when hits >= {least} then list_filter(kept, lambda x: x.h <> props) else kept end, case when hits >= {least} and us - last_us >= {debounce_us} then us else last_us end, us, props, hits, hits >= {least} and us - last_us >= {debounce_us} from (
        select *, len(list_filter(kept, lambda x: x.h = props)) as hits from (select e.user_id, e.event_type, e.i, e.us, e.props, g.last_us, list_append(list_filter(g.recent, lambda x: x.t > e.us - {window_us}), {{'h': e.props, 't': e.us}}) as kept from go g join e on e.user_id = g.user_id and e.event_type = g.event_type and e.i = g.i + 1)))
select cast(user_id as varchar) as session_id, event_type as tool_name, props as input_hash, us, hits from go where alerted"""

_SQL = {
    "s11_input_preview": "select cast(user_id as varchar) as session_id, event_id, case when length(p) > 100 then substring(p, 1, 99) || '…' else p end as input_preview from (select *, '/f/' || event_id % 50 || ' ' || props as p from events)",
    "s2_subagent_sessions": "select cast(s.conv_id as varchar) as session_id, coalesce(a.n, 0) as sidechain_turns, coalesce(a.n, 0) as sidechain_agents from (select distinct conv_id from conversations where role in ('user', 'assistant')) s left join (select conv_id - 1 as conv_id, count(*) as n from conversations where role = 'assistant' group by 1) a on a.conv_id = s.conv_id",
    "st1_growing_logs": "select cast(conv_id as varchar) as session_id, role, count(*) as messages from conversations where role in ('user', 'assistant') and trim(text) <> '' group by all",
    "st6_roll_up": """select cast(user_id as varchar) as session_id, count(*) filter (where user_id % 3 = 0 or event_id % 2 = 0) as calls, max(event_id) filter (where user_id % 3 = 0 or event_id % 2 = 0) as last_event from events
where user_id % 10 <> 1 or user_id % 3 = 0 group by user_id having count(*) filter (where user_id % 3 = 0 or event_id % 2 = 0) > 0""",
    "st5_late_calls": _loops(259_200_000_000, 2, 86_400_000_000),
    "st2_stream_loops": f"select session_id, tool_name, input_hash, make_timestamp(us) as ts, hits from ({_loops(604_800_000_000, 3, 3_600_000_000)})",
    "k3_recurring_problems": checks.RECURRING,
    "j5_similar_problems": f"""with {checks.PROBLEMS}, sets as (select words, min(rank) as rank, arg_min(session_id, rank) as session_id from problems group by words)
select a.session_id as first_session, b.session_id as second_session, {checks.BOTH.format(a="a.words", b="b.words")} as shared, len(a.words) + len(b.words) - {checks.BOTH.format(a="a.words", b="b.words")} as united from sets a join sets b on a.rank < b.rank and {checks.alike("a.words", "b.words")}""",
    "p5_search_filters": f"""with s as ({catalog.sql("p1_session_cost")}) select session_id, 'the rest of it cost:free since:soon' as residual from s where contains(lower(project_dir), '/p/') and contains(lower(model), 'opus') and contains(lower(coalesce(git_branch, '')), 'cc-1')
and start_time >= timestamp '2024-01-31 00:00:00' - interval 20 day and coalesce(cost_usd, 0) >= 0.01 and coalesce(cost_usd, 0) <= 50""",
    "p4_resolve_session_id": f"""with s as ({catalog.sql("sessions")}), ids as (select regexp_replace(md5(session_id), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})', '\\1-\\2-\\3-\\4-') as id, start_time, message_count from s),
asked as (select distinct substring(case when message_count % 2 = 0 then upper(id) else id end, 1, message_count % 33 + 5) as q from ids)
select a.q, i.id as session_id from asked a join ids i on starts_with(i.id, lower(a.q)) where length(a.q) >= 6 and length(a.q) <= 36 qualify row_number() over (partition by a.q order by i.id <> lower(a.q), i.start_time desc, i.id) = 1""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
