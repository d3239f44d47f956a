"""Canonical tables from raw conversation logs: JSON lines, one event a line, one file a session.

``read_lines`` gives (file_path, mtime, ord, line); every step after it takes
DataFrames, so that logs from elsewhere (a table, a stream batch) go the same
way. JSON is held as VARIANT, and one Python function is used: the walk over
content whose nesting has no fixed depth.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window as W

# Fixed values.
SUCCESS_PHRASES = (
    "funcionou", "funciona", "funcionando", "perfeito", "perfeita", "resolvido", "resolveu", "obrigado", "obrigada", "valeu", "ficou bom",
    "ficou ótimo", "ficou otimo", "ta bom assim", "show", "merge ", "vou commitar", "commitei", "commitar", "deploy", "deployed",
)
WARMUP_PHRASES = ("i am claude code", "warmup", "hi claude", "hello claude code")
MAX_LINE = 16 * 1024 * 1024
FILE_TOOLS = ("Edit", "Write", "Read", "MultiEdit")

_AGENT_PATH = "/subagents/"


def read_lines(spark: SparkSession, root: str, agents: bool = False) -> DataFrame:
    """Lines of all ``*.jsonl`` below ``root``: those of sessions, or with ``agents`` those of their sub-agents."""
    rows = _lines(spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(root))
    inside = F.col("file_path").contains(_AGENT_PATH)
    return rows.where(inside if agents else ~inside)


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The lines of given files, as ``read_lines`` has them."""
    return _lines(spark.read.text(paths))


def _lines(raw: DataFrame) -> DataFrame:
    order = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return raw.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_modification_time").alias("mtime"), order.alias("ord"), F.col("value").alias("line"))


def decode_project_dir(path: Column) -> Column:
    """The project folder that a log's parent folder spells with dashes (S3)."""
    name = F.element_at(F.split(path, "/"), -2)
    return F.when(name.startswith("-"), F.translate(name, "-", "/")).otherwise(name)


def parse_events(lines: DataFrame) -> DataFrame:
    """Typed events of (file_path, mtime, ord, line); empty, overlong and malformed lines are left out."""
    # filters stop at a generator; below it each of them would make and parse the line again
    rows = lines.select("file_path", "mtime", "ord", F.explode_outer(F.array("line")).alias("line")).where((F.trim("line") != "") & (F.length("line") <= MAX_LINE))
    v = rows.select("file_path", "mtime", "ord", F.explode_outer(F.array(F.try_parse_json("line"))).alias("v")).where("v is not null and schema_of_variant(v) like 'OBJECT%'")

    def at(path: str, kind: str = "string") -> Column:
        return F.try_variant_get("v", f"$.{path}", kind)

    usage = {"input_tokens": "input_tokens", "output_tokens": "output_tokens", "cache_creation_tokens": "cache_creation_input_tokens", "cache_read_tokens": "cache_read_input_tokens"}
    return v.select(
        "file_path", "mtime", "ord", at("type").alias("type"), *(F.nullif(at(k), F.lit("")).alias(n) for k, n in (("sessionId", "session_id"), ("cwd", "cwd"), ("gitBranch", "git_branch"), ("version", "version"), ("agentId", "agent_id"))),
        F.try_to_timestamp(at("timestamp")).alias("ts"), F.coalesce(at("isSidechain", "boolean"), F.lit(False)).alias("is_sidechain"),
        F.nullif(at("message.model"), F.lit("")).alias("model"), at("message", "variant").isNotNull().alias("has_message"), at("message.content", "variant").alias("content"),
        *(F.coalesce(at(f"message.usage.{k}", "bigint"), F.lit(0)).alias(n) for n, k in usage.items()),
    )


def _leaves(x: object) -> Iterator[str]:
    if isinstance(x, str):
        yield x
    elif isinstance(x, dict):
        for k in sorted(x):
            yield from _leaves(x[k])
    elif isinstance(x, list):
        for y in x:
            yield from _leaves(y)


def _readable(content: object) -> str:
    if isinstance(content, str):
        return content.strip()
    said = []
    for b in content if isinstance(content, list) else []:
        kind = b.get("type") if isinstance(b, dict) else None
        if kind == "text":
            said.append(str(b.get("text") or ""))
        elif kind == "tool_use":
            said.append(" ".join(["tool:" + str(b.get("name") or ""), *_leaves(b.get("input"))]))
        elif kind == "tool_result":
            said.append(_readable(b.get("content")))
    return " ".join(s for s in said if s.strip()).strip()


@F.pandas_udf(StringType())
def _nested_text(raw: pd.Series) -> pd.Series:
    return raw.map(lambda s: None if s is None else _readable(json.loads(s)))


@F.pandas_udf(StringType())
def _leaf_text(raw: pd.Series) -> pd.Series:
    return raw.map(lambda s: "" if s is None else re.sub(r"\s+", " ", " ".join(_leaves(json.loads(s)))).strip())


def content_text(content: Column) -> Column:
    """Searchable text (S5): a string trimmed, else the blocks' texts, tool inputs and results joined by a space; JVM-side for strings."""
    plain = F.try_variant_get(content, "$", "string")
    is_list = F.schema_of_variant(content).startswith("ARRAY")
    return F.coalesce(F.when(is_list, _nested_text(F.when(is_list, F.to_json(content)))).otherwise(F.trim(plain)), F.lit(""))


def blocks(events: DataFrame) -> DataFrame:
    """One row for each content block: the event's columns, pos, kind, block."""
    found = events.withColumn("parts", F.expr("try_variant_get(content, '$', 'array<variant>')"))
    parts = found.select(*events.columns, F.posexplode_outer("parts").alias("pos", "block")).where("pos is not null")  # posexplode would make the array again to filter by its size
    return parts.withColumn("kind", F.expr("try_variant_get(block, '$.type', 'string')"))


def messages(events: DataFrame) -> DataFrame:
    """User and assistant messages with text."""
    rows = events.where("type in ('user', 'assistant') and has_message").withColumn("text", content_text(F.col("content")))
    return rows.where("text <> ''").select("file_path", "session_id", "ord", F.col("type").alias("role"), "text", "ts", "is_sidechain")


def ledger(events: DataFrame) -> DataFrame:
    """One row for each block in file order with a running idx from 0 (S7); a user event or string content is one row."""
    whole = messages(events).select("file_path", "ord", F.lit(-1).alias("pos"), "role", "text", "ts")
    listed = F.coalesce(F.schema_of_variant("content").startswith("ARRAY"), F.lit(False))
    one = whole.join(events.where((F.col("type") == "assistant") & listed).select("file_path", "ord"), ["file_path", "ord"], "left_anti")
    parts = blocks(events.where("type = 'assistant'"))
    get = lambda p: F.coalesce(F.expr(f"try_variant_get(block, '$.{p}', 'string')"), F.lit(""))
    text = F.when(F.col("kind") == "text", get("text")).when(F.col("kind") == "thinking", get("thinking")).when(F.col("kind") == "tool_use", F.concat_ws(" ", get("name"), F.to_json(F.expr("try_variant_get(block, '$.input', 'variant')")))).when(F.col("kind") == "tool_result", content_text(F.expr("try_variant_get(block, '$.content', 'variant')")))
    role = F.when(F.col("kind") == "text", F.lit("assistant")).otherwise(F.col("kind"))
    rows = one.union(parts.select("file_path", "ord", "pos", role.alias("role"), text.alias("text"), "ts").where("trim(text) <> ''"))
    return rows.withColumn("idx", F.row_number().over(W.partitionBy("file_path").orderBy("ord", "pos")) - 1)


def tool_events(events: DataFrame) -> DataFrame:
    """Timed tool calls with input_hash (16 hex digits of canonical JSON, "0" without input) and input_preview."""
    name, given = F.expr("try_variant_get(block, '$.name', 'string')"), F.expr("try_variant_get(block, '$.input', 'variant')")
    rows = blocks(events.where("type = 'assistant'")).where("kind = 'tool_use'").select("file_path", "session_id", "ord", "pos", "ts", name.alias("tool_name"), given.alias("input"), F.to_json(given).alias("canonical"))
    preview = _leaf_text("canonical")
    return rows.where("tool_name <> '' and ts is not null").select(
        "file_path", "session_id", "ord", "pos", "ts", "tool_name", F.coalesce(F.substring(F.sha2("canonical", 256), 1, 16), F.lit("0")).alias("input_hash"),
        F.when(F.length(preview) > 100, F.concat(F.substring(preview, 1, 99), F.lit("…"))).otherwise(preview).alias("input_preview"), "input",
    )


def tool_calls(events: DataFrame) -> DataFrame:
    """(file_path, tool_name) with the number of named calls."""
    rows = blocks(events.where("type = 'assistant'")).where("kind = 'tool_use'").withColumn("tool_name", F.expr("try_variant_get(block, '$.name', 'string')"))
    return rows.where("tool_name <> ''").groupBy("file_path", "tool_name").agg(F.count("*").alias("calls"))


def file_ops(events: DataFrame) -> DataFrame:
    """Files that tools touched in a session: op_count, first_op_ts."""
    get = lambda p: F.expr(f"try_variant_get(input, '$.{p}', 'string')")
    path = F.when(F.col("tool_name").isin(*FILE_TOOLS), get("file_path")).when(F.col("tool_name") == "NotebookEdit", get("notebook_path"))
    rows = tool_events(events).withColumn("touched", path).where("touched <> ''")
    return rows.groupBy("session_id", F.col("touched").alias("path")).agg(F.count("*").alias("op_count"), F.min("ts").alias("first_op_ts"))


def resolved_at_turn(events: DataFrame) -> DataFrame:
    """(file_path, resolved_at_turn): the last turn, from 1, whose user text outside side chains has a phrase of success."""
    turns = events.where("type in ('user', 'assistant') and has_message").withColumn("turn", F.row_number().over(W.partitionBy("file_path").orderBy("ord")))
    hit = F.lower(content_text(F.col("content"))).rlike("|".join(SUCCESS_PHRASES)) & (F.col("type") == "user") & ~F.col("is_sidechain")
    return turns.groupBy("file_path").agg(F.max(F.when(hit, F.col("turn"))).alias("resolved_at_turn"))


def sessions(events: DataFrame, agent_events: DataFrame | None = None) -> DataFrame:
    """One row for each file with messages (S4): the first non-empty fields in line order, times, counts, tokens, tools."""

    def first(c: str) -> Column:
        return F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(c)

    spoken = events.withColumn("text", F.when((F.col("type") == "user") & ~F.col("is_sidechain"), F.nullif(content_text(F.col("content")), F.lit(""))))
    told = F.when(F.col("text").isNotNull(), F.col("ord"))
    talk = "has_message and type = '{}'"
    out = spoken.groupBy("file_path").agg(
        *(first(c) for c in ("session_id", "cwd", "git_branch", "version", "model")), F.max("mtime").alias("mtime"), F.min("ts").alias("start_time"), F.max("ts").alias("end_time"),
        F.count_if(F.expr(talk.format("user"))).alias("user_messages"), F.count_if(F.expr(talk.format("assistant"))).alias("assistant_messages"),
        F.substring(F.min_by("text", told), 1, 200).alias("first_user_msg"), F.substring(F.max_by("text", told), 1, 200).alias("last_user_msg"),
        *(F.sum(F.when(F.col("type") == "assistant", F.col(c)).otherwise(0)).alias(c) for c in ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens")),
        F.count_if(F.expr("is_sidechain and has_message")).alias("sidechain_turns"), F.count_distinct(F.when(F.col("is_sidechain"), F.col("agent_id"))).alias("sidechain_agents"),
    )
    name = F.regexp_replace(F.element_at(F.split("file_path", "/"), -1), r"\.jsonl$", "")
    out = out.withColumn("message_count", F.col("user_messages") + F.col("assistant_messages")).where("message_count > 0")
    out = out.withColumn("session_id", F.coalesce("session_id", name)).withColumn("project_dir", F.coalesce("cwd", decode_project_dir(F.col("file_path")))).drop("cwd")
    if agent_events is not None:
        parent = F.regexp_extract("file_path", r"/([^/]+)/subagents/", 1)
        more = agent_events.groupBy(parent.alias("session_id")).agg(F.count_if("has_message").alias("more_turns"), F.count_distinct("file_path").alias("more_agents"))
        out = out.join(more, "session_id", "left")
        for c, m in (("sidechain_turns", "more_turns"), ("sidechain_agents", "more_agents")):
            out = out.withColumn(c, F.col(c) + F.coalesce(m, F.lit(0)))
        out = out.drop("more_turns", "more_agents")
    tools = tool_calls(events).groupBy("file_path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool_name", "calls")))).alias("tools"))
    return out.join(tools, "file_path", "left").join(resolved_at_turn(events), "file_path", "left")


def ingest_filter(found: DataFrame, skip_warmup: bool = True, skip_clear_only: bool = True, min_messages: int = 1, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Sessions worth keeping."""
    opening = F.coalesce(F.lower(F.trim("first_user_msg")), F.lit(""))
    out = found.where(F.col("message_count") >= min_messages)
    if skip_warmup:
        out = out.where(~opening.rlike("|".join(WARMUP_PHRASES)))
    if skip_clear_only:
        out = out.where(~(opening.rlike(r"^/(clear|compact)( |$)") & (F.col("user_messages") <= 2)))
    for part in exclude:
        out = out.where(~F.coalesce(F.col("project_dir").contains(part), F.lit(False)))
    return out


def incremental_plan(files: DataFrame, manifest: DataFrame, parser_version: int) -> DataFrame:
    """(file_path, status) with status new, updated, unchanged or removed, from (file_path, mtime) and (file_path, mtime, parser_version)."""
    old = manifest.select("file_path", F.col("mtime").alias("old_mtime"), F.col("parser_version").alias("old_version"), F.lit(True).alias("was"))
    both = files.select("file_path", "mtime", F.lit(True).alias("there")).join(old, "file_path", "full_outer")
    same = F.col("mtime").eqNullSafe(F.col("old_mtime")) & F.col("old_version").eqNullSafe(F.lit(parser_version))
    return both.select("file_path", F.when(F.col("there").isNull(), "removed").when(F.col("was").isNull(), "new").when(same, "unchanged").otherwise("updated").alias("status"))


def upsert(target: DataFrame, updates: DataFrame, *key: str, removed: DataFrame | None = None) -> DataFrame:
    """``target`` with the rows of the keys in ``updates`` replaced, and those of ``removed`` left out."""
    gone = updates.select(*key) if removed is None else updates.select(*key).union(removed.select(*key))
    return target.join(gone.distinct(), list(key), "left_anti").unionByName(updates)


def merge_keep_nonempty(target: DataFrame, updates: DataFrame, key: str, texts: tuple[str, ...], values: tuple[str, ...] = ()) -> DataFrame:
    """Upsert in which an empty text or a null value does not replace what is there."""
    t, u = target.alias("t"), updates.alias("u")
    both = t.join(u, F.expr(f"t.{key} = u.{key}"), "full_outer")

    def pick(c: str) -> Column:
        new = F.col(f"u.{c}")
        return F.coalesce(F.nullif(new, F.lit("")) if c in texts else new, F.col(f"t.{c}")).alias(c)

    known = {key, *texts, *values}
    return both.select(*(pick(c) if c in known else F.when(F.col(f"u.{key}").isNotNull(), F.col(f"u.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in target.columns))


def stale_cache(found: DataFrame, cache: DataFrame) -> DataFrame:
    """Sessions without a cached summary of their present mtime."""
    fresh = cache.where("summary <> ''").select("session_id", F.col("jsonl_mtime").alias("mtime"))
    return found.join(fresh, ["session_id", "mtime"], "left_anti")


def export_sessions(found: DataFrame, said: DataFrame) -> DataFrame:
    """(session_id, document): a session and its messages in order as one JSON text."""
    listed = said.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "role", "text"))), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"))).alias("messages"))
    both = found.join(listed, "session_id", "left")
    return both.select("session_id", F.to_json(F.struct(*found.columns, "messages")).alias("document"))


def parse_model_json(replies: DataFrame, schema: str) -> DataFrame:
    """Rows of ``schema`` in model replies (id, raw): fences and talk around the outer JSON are cut; error tells of replies that are not JSON."""
    bare = F.regexp_replace("raw", r"```[a-zA-Z]*", "")
    body = F.regexp_extract(bare, r"(?s)(\[.*\]|\{.*\})", 1)
    listed = F.when(body.startswith("{"), F.concat(F.lit("["), body, F.lit("]"))).otherwise(body)
    told = replies.select("id", F.explode_outer(F.array(listed)).alias("listed"))  # made once: what asks for errors is not pushed below
    rows = told.select("id", F.from_json("listed", f"array<struct<{schema}>>").alias("rows"), F.try_parse_json("listed").isNull().alias("bad"))
    return rows.select("id", F.explode_outer("rows").alias("row"), F.when(F.col("bad"), "no JSON").alias("error")).select("id", "row.*", "error")
