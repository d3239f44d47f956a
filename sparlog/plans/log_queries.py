"""Queries of the log parser, the ingest steps and the streams.

Logs are rendered from tables (conversations as messages, events as tool
calls), parsed again, and compared with what SQL finds in the tables.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import logs
from ..streaming import live

_ORD = "struct({0} as block, cast(0 as bigint) as row) as ord"
_MTIME = "timestamp '2024-02-01 00:00:00' as mtime"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared(spark: SparkSession) -> str:
    """A folder for what streams write: the cluster's shared one, or a temporary one where none is set (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/streams" if base else "file://" + tempfile.mkdtemp(prefix="spark-streams-")


def _talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of logs in which a conversation is a file and a turn a line."""
    line = "to_json(named_struct('type', role, 'sessionId', cast(conv_id as string), 'message', named_struct('role', role, 'content', text))) as line"
    return logs.parse_events(_table(spark, sf_dir, "conversations").selectExpr("concat('/logs/-p/', conv_id, '.jsonl') as file_path", _MTIME, _ORD.format("turn"), line))


def _work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of logs in which a user is a file and an event a tool call."""
    block = "named_struct('type', 'tool_use', 'name', case event_type when 'click' then 'Edit' else event_type end, 'input', named_struct('file_path', concat('/f/', event_id % 50), 'props', props))"
    line = f"to_json(named_struct('type', 'assistant', 'sessionId', cast(user_id as string), 'timestamp', date_format(cast(ts as timestamp), \"yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX\"), 'message', named_struct('content', array({block})))) as line"
    events = _table(spark, sf_dir, "events").repartition(spark.sparkContext.defaultParallelism, "event_id")  # a file of few row groups would be parsed in as many tasks
    return logs.parse_events(events.selectExpr("concat('/logs/-p/', user_id, '.jsonl') as file_path", _MTIME, _ORD.format("event_id"), line))


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.sessions(_talk(spark, sf_dir)).select("session_id", "project_dir", "user_messages", "assistant_messages", "message_count", "first_user_msg", "last_user_msg", "resolved_at_turn")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/event[s].parquet")  # a pattern, since a stream's own path must be a folder
    return rows.selectExpr("cast(user_id as string) as session_id", "event_type as tool_name", "props as input_hash", "cast(ts as timestamp) as ts")


def s4_sessions_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sessions(spark, sf_dir)


def s6_messages_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.messages(_talk(spark, sf_dir)).select("session_id", F.col("ord.block").alias("turn"), "role", "text")


def s7_ledger_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.ledger(_talk(spark, sf_dir)).select("file_path", F.col("idx").cast("long").alias("idx"), "role", "text")


def s9_tool_events_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.tool_events(_work(spark, sf_dir)).select("session_id", F.col("ord.block").alias("event_id"), "tool_name", F.unix_micros("ts").alias("us"), "input_hash")


def s12_file_ops_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.file_ops(_work(spark, sf_dir)).select("session_id", "path", "op_count", F.unix_micros("first_op_ts").alias("first_us"))


def s14_ingest_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.ingest_filter(_sessions(spark, sf_dir), min_messages=4).select("session_id", "message_count")


def s15_incremental_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("file_path")).agg(F.max("turn").alias("mtime"), F.first("conv_id").alias("c"))
    manifest = turns.where("c % 5 <> 0").selectExpr("if(c % 11 = 0, concat('gone-', file_path), file_path) as file_path", "if(c % 7 = 0, mtime - 1, mtime) as mtime", "1 as parser_version")
    return logs.incremental_plan(turns, manifest, 1)


def p17_export_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.export_sessions(_sessions(spark, sf_dir), logs.messages(_talk(spark, sf_dir)))


def b17_parse_model_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    replies = _table(spark, sf_dir, "conversations").selectExpr("concat(conv_id, '/', turn) as id", "concat('Here:\n```json\n', to_json(array(named_struct('role', role, 'turn', turn))), '\n```') as raw")
    return logs.parse_model_json(replies, "role string, turn long")


def st2_stream_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loops of equal events of a user within a day; the window is wide since the table's events are far apart."""
    return live.drain(live.stream_loops(_stream(spark, sf_dir), window_s=7 * 86_400, least=3, debounce_s=3600), _shared(spark))


def st7_windowed_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = live.drain(live.windowed_usage(_stream(spark, sf_dir)), _shared(spark), "complete")
    return out.select(F.unix_micros("start").alias("start_us"), "tool_name", "calls")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.min_by("text", "turn").alias("title"))


def s16_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the conversations gets new rows, and a fifth is removed."""
    rows = _turns(spark, sf_dir).select("conv_id", "turns")
    return logs.upsert(rows, rows.where("conv_id % 3 = 0").selectExpr("conv_id", "turns + 100 as turns"), "conv_id", removed=rows.where("conv_id % 5 = 0").select("conv_id"))


def s17_merge_keep_nonempty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates without a title or a number keep what was there; half of the conversations are updated, a seventh is new."""
    rows = _turns(spark, sf_dir)
    updates = rows.where("conv_id % 2 = 0").selectExpr("conv_id", "if(conv_id % 4 = 0, null, turns + 100) as turns", "if(conv_id % 6 = 0, '', concat('new ', title)) as title")
    return logs.merge_keep_nonempty(rows.where("conv_id % 7 <> 0"), updates, "conv_id", ("title",), ("turns",))


def s18_stale_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _turns(spark, sf_dir).selectExpr("conv_id as session_id", "turns as mtime")
    return logs.stale_cache(found, found.where("session_id % 3 <> 0").selectExpr("session_id", "if(session_id % 5 = 0, mtime - 1, mtime) as jsonl_mtime", "if(session_id % 7 = 0, '', 'told') as summary"))


def st4_chosen_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.chosen_tools(_table(spark, sf_dir, "events").withColumnRenamed("event_type", "tool_name"), exclude=("view",)).groupBy("tool_name").agg(F.count("*").alias("calls"))


def st7_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").selectExpr("cast(user_id as string) as session_id", "cast(ts as timestamp) as ts")
    return live.bursts(rows, "6 hours").select("session_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "calls")


_ALL = (
    s16_upsert, s17_merge_keep_nonempty, s18_stale_cache, st4_chosen_tools, st7_bursts,
    s4_sessions_from_events, s6_messages_from_events, s7_ledger_from_events, s9_tool_events_from_events, s12_file_ops_from_events, s14_ingest_filter,
    s15_incremental_plan, p17_export_sessions, b17_parse_model_json, st2_stream_loops, st7_windowed_usage,
)


def _said(d: str = "") -> str:
    return f"select conv_id, turn, role, trim(text) as text {d} from conversations where role in ('user', 'assistant')"


_PHRASES = "|".join(logs.SUCCESS_PHRASES)
_TOLD = "role = 'user' and text <> ''"
_SESSIONS = f"""with m as ({_said(", row_number() over (partition by conv_id order by turn) as n")})
select cast(conv_id as varchar) as session_id, '/p' as project_dir, count(*) filter (role = 'user') as user_messages, count(*) filter (role = 'assistant') as assistant_messages, count(*) as message_count,
substring(arg_min(text, turn) filter ({_TOLD}), 1, 200) as first_user_msg, substring(arg_max(text, turn) filter ({_TOLD}), 1, 200) as last_user_msg,
max(n) filter (role = 'user' and regexp_matches(lower(text), '{_PHRASES}')) as resolved_at_turn from m group by conv_id"""
_WARM = "|".join(logs.WARMUP_PHRASES)
_INPUT = """'{"file_path":"/f/' || event_id % 50 || '","props":' || to_json(props) || '}'"""

_TURNS = "(select conv_id, count(*) as turns, arg_min(text, turn) as title from conversations group by conv_id)"

_SQL = {
    "s16_upsert": f"select conv_id, case when conv_id % 3 = 0 then turns + 100 else turns end as turns from {_TURNS} where conv_id % 3 = 0 or conv_id % 5 <> 0",
    "s17_merge_keep_nonempty": f"""select conv_id, case when conv_id % 2 = 0 and conv_id % 4 <> 0 then turns + 100 when conv_id % 7 <> 0 then turns end as turns,
case when conv_id % 2 = 0 and conv_id % 6 <> 0 then coalesce(nullif('new ' || title, ''), case when conv_id % 7 <> 0 then title end) when conv_id % 7 <> 0 then title end as title from {_TURNS} where conv_id % 7 <> 0 or conv_id % 2 = 0""",
    "s18_stale_cache": f"select conv_id as session_id, turns as mtime from {_TURNS} where conv_id % 3 = 0 or conv_id % 5 = 0 or conv_id % 7 = 0",
    "st4_chosen_tools": "select event_type as tool_name, count(*) as calls from events where event_type <> 'view' group by event_type",
    "st7_bursts": """with e as (select user_id, epoch_us(ts) as us, lag(epoch_us(ts)) over (partition by user_id order by ts) as before from events),
b as (select *, sum(case when before is null or us - before >= 21600000000 then 1 else 0 end) over (partition by user_id order by us rows unbounded preceding) as burst from e)
select cast(user_id as varchar) as session_id, min(us) as start_us, max(us) + 21600000000 as end_us, count(*) as calls from b group by user_id, burst""",
    "s4_sessions_from_events": _SESSIONS,
    "s6_messages_from_events": f"select cast(conv_id as varchar) as session_id, turn, role, text from ({_said()}) where text <> ''",
    "s7_ledger_from_events": f"select '/logs/-p/' || conv_id || '.jsonl' as file_path, row_number() over (partition by conv_id order by turn) - 1 as idx, role, text from ({_said()}) where text <> ''",
    "s9_tool_events_from_events": f"select cast(user_id as varchar) as session_id, event_id, case event_type when 'click' then 'Edit' else event_type end as tool_name, epoch_us(ts) as us, substring(sha256({_INPUT}), 1, 16) as input_hash from events",
    "s12_file_ops_from_events": "select cast(user_id as varchar) as session_id, '/f/' || event_id % 50 as path, count(*) as op_count, min(epoch_us(ts)) as first_us from events where event_type = 'click' group by all",
    "s14_ingest_filter": f"""select session_id, message_count from ({_SESSIONS}) where message_count >= 4 and not regexp_matches(coalesce(lower(trim(first_user_msg)), ''), '{_WARM}')
and not (regexp_matches(coalesce(lower(trim(first_user_msg)), ''), '^/(clear|compact)( |$)') and user_messages <= 2)""",
    "s15_incremental_plan": """with t as (select conv_id as c, max(turn) as mtime from conversations group by conv_id)
select cast(c as varchar) as file_path, case when c % 5 = 0 or c % 11 = 0 then 'new' when c % 7 = 0 then 'updated' else 'unchanged' end as status from t
union all select 'gone-' || c, 'removed' from t where c % 5 <> 0 and c % 11 = 0""",
    # a document holds what is not null, in the order of the columns, and the messages in theirs
    "p17_export_sessions": f"""with s as ({_SESSIONS}), told as (select conv_id, string_agg('{{"role":' || to_json(role) || ',"text":' || to_json(text) || '}}', ',' order by turn) as messages from ({_said()}) where text <> '' group by conv_id)
select session_id, '{{"session_id":' || to_json(session_id) || ',"project_dir":' || to_json(project_dir) || ',"user_messages":' || user_messages || ',"assistant_messages":' || assistant_messages || ',"message_count":' || message_count
|| coalesce(',"first_user_msg":' || to_json(first_user_msg), '') || coalesce(',"last_user_msg":' || to_json(last_user_msg), '') || coalesce(',"resolved_at_turn":' || resolved_at_turn, '') || coalesce(',"messages":[' || messages || ']', '') || '}}' as document
from s left join told t on cast(t.conv_id as varchar) = s.session_id""",
    "b17_parse_model_json": "select conv_id || '/' || turn as id, role, turn, cast(null as varchar) as error from conversations",
    "st7_windowed_usage": "select epoch_us(date_trunc('day', ts)) as start_us, event_type as tool_name, count(*) as calls from events group by all",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
