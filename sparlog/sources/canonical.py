"""Canonical tables: sessions, tool events, files, messages, vectors, knowledge, prices.

``sources.logs`` makes them from raw logs. The steps here derive the same
tables from star-schema tables, so that every operator runs on data that grows.
"""

from ..plans.catalog import DEFAULTS, step
from . import knowledge

AS_OF = "timestamp '$as_of'"
DEFAULTS["as_of"] = "2024-01-31 00:00:00"

#: Default price list, US dollars for a million tokens, and the BRL rate.
PRICES = (
    ("claude-sonnet-4-6", 3.00, 15.00, 3.75, 0.30),
    ("claude-opus-4-7", 15.00, 75.00, 18.75, 1.50),
    ("claude-haiku-4-5", 1.00, 5.00, 1.25, 0.10),
)
BRL_RATE = 5.20

step(
    "s19_load_pricing",
    "select model, cast(i as double) as input_rate, cast(o as double) as output_rate, cast(w as double) as cache_write_rate, cast(r as double) as cache_read_rate, "
    f"cast({BRL_RATE} as double) as brl_rate from (values " + ", ".join(map(str, PRICES)) + ") as p(model, i, o, w, r)",
    operator=False,
)
step(
    "event_rows",
    lambda d: """select cast(user_id as varchar(20)) || '-' || cast(cast(ts as date) as varchar(10)) as session_id, user_id, event_id,
    cast(ts as timestamp) as ts, event_type, value, props, cast(floor(value * 100) as bigint) as units from {events}""".replace("varchar(20)", "string" if d.name == "spark" else "varchar").replace("varchar(10)", "string" if d.name == "spark" else "varchar"),
    operator=False,
)
step(
    "sessions",
    lambda d: f"""select session_id, '/p/' || user_id % 7 as project_dir,
    case when user_id % 5 <> 0 then 'feat/CC-' || user_id % 23 end as git_branch,
    case user_id % 4 when 0 then 'claude-sonnet-4-6' when 1 then 'claude-opus-4-7' when 2 then 'claude-haiku-4-5' else 'other-model' end as model,
    min(ts) as start_time, max(ts) as end_time, count(*) as message_count,
    {d.bool_sum("event_type in ('view', 'click', 'signup')")} as user_messages,
    {d.bool_sum("event_type not in ('view', 'click', 'signup')")} as assistant_messages,
    min_by(props, {d.row("ts", "event_id")}) as first_user_msg, max_by(props, {d.row("ts", "event_id")}) as last_user_msg,
    cast(sum(units) as bigint) as input_tokens, cast(sum(units % 977) as bigint) as output_tokens,
    cast(sum(units % 331) as bigint) as cache_creation_tokens, cast(sum(units % 4999) as bigint) as cache_read_tokens,
    user_id % 3 as sidechain_agents, case when user_id % 2 = 0 then count(*) - 1 end as resolved_at_turn
    from {{event_rows}} group by session_id, user_id""",
    operator=False,
)
# the table's kinds of events stand for tools
step("tool_events", "select session_id, ts, event_id, case event_type when 'view' then 'Read' when 'click' then 'Edit' when 'purchase' then 'Bash' when 'error' then 'WebFetch' else event_type end as tool_name, props as input_hash, props as input_preview from {event_rows}", operator=False)
step("s8_tool_calls", "select session_id, tool_name, count(*) as calls from {tool_events} group by session_id, tool_name")
# nearly every row is a group of its own: Spark deals them to as many tasks as there are rows for (``plans.queries``)
step("session_files", lambda d: f"select l_orderkey as session_id, l_partkey as file_path, count(*) as op_count, min(cast(l_shipdate as timestamp)) as first_op_ts from {{{'dealt_lines' if d.name == 'spark' else 'lineitem'}}} group by l_orderkey, l_partkey", operator=False)
step("s6_messages", "select conv_id as session_id, turn as ord, role, text as content from {conversations} where role in ('user', 'assistant') and trim(text) <> ''")
step("vectors", "select vec_id as session_id, label, embedding from {embeddings}", operator=False)
# ``sources.knowledge`` makes it from model replies; the checking engine reads the pages that the replies tell of
def _knowledge(d) -> str:
    if d.name == "spark":
        return "select * from {knowledge_rows}"
    each = lambda pattern: "regexp_extract_all(html, '" + pattern.replace('\\"', '"') + "', 1)"
    one = lambda pattern: "regexp_extract(html, '" + pattern.replace('\\"', '"') + "', 1)"
    return f"""select page_id as session_id, 1704067200 + page_id % 30 * 86400 + page_id % 7 * 3600 as generated_at, {one(knowledge.TITLE)} as problem, {one(knowledge.HEADLINE)} as solution,
    {each(knowledge.BOLD)} as decisions, {each(knowledge.ASIDE)} as code_patterns, {each(knowledge.LINK)} as tech_used, {each(knowledge.SHORT)} as open_questions from {{pages}}"""


step("knowledge", _knowledge, operator=False)
