"""Cost: prices, roll-ups by project, model, day and ticket, month projections, baselines."""

from ..plans.catalog import DEFAULTS, step
from ..sources.canonical import AS_OF

#: The moment of the month and the day that are under way, their beginnings, and the Sunday that the week of ``as_of`` began with.
NOW = "timestamp '$now'"
DEFAULTS["now"] = "2024-01-20 12:00:00"
MONTH, DAY, SUNDAY = f"date_trunc('month', {NOW})", f"date_trunc('day', {NOW})", f"(date_trunc('week', {AS_OF} + interval 1 day) - interval 1 day)"

step(
    "p1_session_cost",
    """select s.session_id, s.project_dir, s.git_branch, s.model, s.start_time, s.end_time, s.message_count, s.user_messages, s.assistant_messages,
    s.input_tokens, s.output_tokens, s.cache_creation_tokens, s.cache_read_tokens, s.sidechain_agents,
    round(s.input_tokens * p.input_rate / 1e6, 9) as input_usd, round(s.output_tokens * p.output_rate / 1e6, 9) as output_usd,
    round(s.cache_creation_tokens * p.cache_write_rate / 1e6, 9) as cache_write_usd, round(s.cache_read_tokens * p.cache_read_rate / 1e6, 9) as cache_read_usd,
    round((s.input_tokens * p.input_rate + s.output_tokens * p.output_rate + s.cache_creation_tokens * p.cache_write_rate + s.cache_read_tokens * p.cache_read_rate) / 1e6, 9) as cost_usd,
    round((s.input_tokens * p.input_rate + s.output_tokens * p.output_rate + s.cache_creation_tokens * p.cache_write_rate + s.cache_read_tokens * p.cache_read_rate) / 1e6 * p.brl_rate, 9) as cost_brl
    from {sessions} s left join {s19_load_pricing} p on s.model = p.model""",
)
step("c1_totals", "select count(*) as sessions, cast(sum(message_count) as bigint) as messages, round(sum(cost_usd), 8) as cost_usd, round(sum(cost_brl), 9) as cost_brl from {p1_session_cost}")
step("c2_cost_by_project", "select project_dir, count(*) as sessions, round(coalesce(sum(cost_usd), 0e0), 8) as cost_usd from {p1_session_cost} group by project_dir order by cost_usd desc, project_dir limit $projects", projects=10)
step("c3_cost_by_model", "select model, count(*) as sessions, round(sum(cost_usd), 8) as cost_usd from {p1_session_cost} where cost_usd is not null group by model")
step("calendar_30", lambda d: f"select {d.series(d.plus_days(f'cast({AS_OF} as date)', '-$days'), d.plus_days(f'cast({AS_OF} as date)', '-1'))} as day", operator=False, days=30)
step(
    "c4_cost_by_day",
    f"""select c.day, round(coalesce(sum(s.cost_usd), 0e0), 8) as cost_usd from {{calendar_30}} c
    left join (select * from {{p1_session_cost}} where start_time >= {AS_OF} - interval $days day) s on cast(s.start_time as date) = c.day group by c.day""",
)
step(
    "month_parts",
    lambda d: f"""select cost_usd,
    case when end_time <= start_time then case when start_time >= {MONTH} and start_time < {NOW} then 1e0 else 0e0 end
    else greatest(0e0, {d.us(f"greatest(start_time, {MONTH})", f"least(end_time, {NOW})")} * 1e0) / {d.us("start_time", "end_time")} end as month_share,
    case when end_time <= start_time then case when start_time >= {DAY} and start_time < {NOW} then 1e0 else 0e0 end
    else greatest(0e0, {d.us(f"greatest(start_time, {DAY})", f"least(end_time, {NOW})")} * 1e0) / {d.us("start_time", "end_time")} end as today_share
    from {{p1_session_cost}} where cost_usd is not null""",
    operator=False,
)
step("c5_month_cost", f"select round(sum(cost_usd * month_share), 8) as accumulated_usd, round(sum(cost_usd * today_share), 8) as today_usd, round(sum(cost_usd * month_share) / day({NOW}) * day(last_day({NOW})), 8) as projected_usd from {{month_parts}}")
step("c6_daily_totals", f"select count(*) as sessions, round(coalesce(sum(cost_usd), 0e0), 8) as cost_usd from {{p1_session_cost}} where cast(start_time as date) = cast({NOW} as date)")
step("c7_budget_status", "select cost_usd, case when cost_usd > $alert_usd then 'alert' when cost_usd > $warn_usd then 'warn' else 'ok' end as status from {c6_daily_totals}", alert_usd=10, warn_usd=5)
step(
    "c8_week_delta",
    lambda d: f"""select {d.bool_sum("cur")} as sessions, {d.bool_sum("prev")} as sessions_before,
    cast(coalesce(sum(case when cur then message_count end), 0) as bigint) as messages, cast(coalesce(sum(case when prev then message_count end), 0) as bigint) as messages_before,
    round(coalesce(sum(case when cur then cost_usd end), 0e0), 8) as cost_usd, round(coalesce(sum(case when prev then cost_usd end), 0e0), 8) as cost_usd_before
    from (select *, start_time >= {SUNDAY} and start_time < {AS_OF} as cur, start_time >= {SUNDAY} - interval 7 day and start_time < {SUNDAY} as prev from {{p1_session_cost}})""",
)
step(
    "c9_cache_savings",
    f"""select round(sum(saved), 8) as saved_usd, round(sum(saved) / sum(cost_usd), 8) as ratio from (select s.cost_usd, s.cache_read_tokens * (p.input_rate - p.cache_read_rate) / 1e6 as saved
    from {{p1_session_cost}} s join {{s19_load_pricing}} p on s.model = p.model where s.start_time >= {AS_OF} - interval $days day)""",
)
step("c10_long_tail_cost", "select session_id, coalesce(cost_usd, 0e0) as cost_usd from {p1_session_cost} order by coalesce(cost_usd, 0e0) desc, session_id limit $tail", tail=20)
step("c10_long_tail_duration", lambda d: f"select session_id, {d.us('start_time', 'end_time')} as duration_us from {{sessions}} order by duration_us desc, session_id limit $tail")
step(
    "c11_cost_by_ticket",
    lambda d: f"""select ticket, count(*) as sessions, {d.joined_set("git_branch")} as branches, round(coalesce(sum(cost_usd), 0e0), 8) as cost_usd
    from (select *, {d.extract("git_branch", "[A-Z][A-Z]+-[0-9]+")} as ticket from {{p1_session_cost}} where git_branch is not null and git_branch <> '') where ticket <> ''
    group by ticket order by cost_usd desc, ticket limit 20""",
)
step("project_rows", "select project_dir, session_id, cost_usd, coalesce(cost_usd, 0e0) as cost, input_tokens + output_tokens as tokens from {p1_session_cost}", operator=False)


def _p90(value: str, made: str):
    """Spark selects the order statistic over ranges of values (``operators.order``), the checking engine numbers the rows of a group."""
    return lambda d: f"select project_dir, p90 from {{{made}}}" if d.name == "spark" else f"select project_dir, max(case when k = floor((n - 1) * 0.9e0) + 1 then {value} end) as p90 from (select *, row_number() over (partition by project_dir order by {value}, session_id) as k, count(*) over (partition by project_dir) as n from {{project_rows}}) group by project_dir"


step("project_p90_cost", _p90("cost", "selected_cost"), operator=False)
step("project_p90_tokens", _p90("tokens", "selected_tokens"), operator=False)
step("project_tools", "select project_dir, tool_name, calls, row_number() over (partition by project_dir order by calls desc, tool_name) as k from (select s.project_dir, t.tool_name, cast(sum(t.calls) as bigint) as calls from {s8_tool_calls} t join {sessions} s on t.session_id = s.session_id group by s.project_dir, t.tool_name)", operator=False)
step(
    "c12_project_profile",
    lambda d: f"""select r.project_dir, count(*) as sessions, round(sum(cost_usd), 8) as cost_usd, round(max(c.p90), 8) as p90_cost, max(k.p90) as p90_tokens, max(t.tools) as top_tools, max(l.ticket) as ticket
    from {{project_rows}} r join {{project_p90_cost}} c on c.project_dir = r.project_dir join {{project_p90_tokens}} k on k.project_dir = r.project_dir
    left join (select project_dir, {d.joined("tool_name", "k")} as tools from {{project_tools}} where k <= 3 group by project_dir) t on r.project_dir = t.project_dir
    left join (select project_dir, {d.extract("max_by(git_branch, " + d.row("start_time", "session_id") + ")", "[A-Z][A-Z][A-Z]?[A-Z]?[A-Z]?[A-Z]?[A-Z]?[A-Z]?-[0-9][0-9]?[0-9]?[0-9]?[0-9]?[0-9]?")} as ticket from {{sessions}} where git_branch is not null group by project_dir) l on r.project_dir = l.project_dir
    group by r.project_dir""",
)
step(
    "c13_session_live",
    lambda d: f"""select session_id, input_tokens + output_tokens + cache_creation_tokens + cache_read_tokens as tokens, cost_usd,
    round((input_tokens + output_tokens) / greatest(1e0, {d.us("start_time", AS_OF)} / 6e7), 8) as burn_rate from {{p1_session_cost}}""",
)
def severity(value: str, warn: str, crit: str) -> str:
    """ok, warn or crit by bounds that count themselves; without bounds (both 0) all is ok."""
    return f"case when {warn} = 0 and {crit} = 0 then 'ok' when {value} >= {crit} then 'crit' when {value} >= {warn} then 'warn' else 'ok' end"


step("p13_severity", f"select session_id, message_count, {severity('message_count', '$warn_messages', '$crit_messages')} as severity from {{sessions}}", warn_messages=2, crit_messages=4)
step(
    "c14_status_rollup",
    f"""select s.session_id, s.project_dir, s.input_tokens + s.output_tokens + s.cache_creation_tokens + s.cache_read_tokens as tokens, s.cost_usd, round(s.cost_usd / nullif(p.p90_cost, 0e0), 8) as cost_ratio,
    {severity("coalesce(s.cost_usd / nullif(p.p90_cost, 0e0), 0e0)", "$warn_ratio", "$crit_ratio")} as severity, p.sessions as project_sessions, d.sessions as day_sessions, d.cost_usd as day_usd, m.accumulated_usd as month_usd
    from {{p1_session_cost}} s join {{c12_project_profile}} p on s.project_dir = p.project_dir cross join {{c6_daily_totals}} d cross join {{c5_month_cost}} m""",
    warn_ratio=0.8, crit_ratio=1.2,
)
step(
    "recent_30",
    lambda d: f"""select *, row_number() over (partition by project_dir order by message_count, session_id) as mr, row_number() over (partition by project_dir order by cost, session_id) as cr,
    row_number() over (partition by project_dir order by duration_us, session_id) as dr, count(*) over (partition by project_dir) as n
    from (select *, coalesce(cost_usd, 0e0) as cost, {d.us("start_time", "end_time")} as duration_us, row_number() over (partition by project_dir order by end_time desc, session_id) as k from {{p1_session_cost}}) where k <= 30""",
    operator=False,
)
step(
    "c15_baseline",
    lambda d: f"""select project_dir, max(n) as sessions, max(case when mr = {d.floor_div("n", "2")} + 1 then message_count end) as median_messages,
    round(max(case when cr = {d.floor_div("n", "2")} + 1 then cost end), 8) as median_cost, max(case when dr = {d.floor_div("n", "2")} + 1 then duration_us end) as median_duration_us
    from {{recent_30}} group by project_dir having max(n) >= 3""",
)
step(
    "c16_project_history",
    lambda d: f"""select g.project_dir, g.days_ago, count(s.session_id) as sessions from (select project_dir, {d.ints('0', '$history_days - 1')} as days_ago from (select distinct project_dir from {{sessions}})) g
    left join (select project_dir, session_id, cast(floor({d.us('start_time', AS_OF)} / 8.64e10) as bigint) as days_ago from {{sessions}}) s on s.project_dir = g.project_dir and s.days_ago = g.days_ago group by g.project_dir, g.days_ago""",
    history_days=14,
)
def delta_label(now: str, base: str) -> str:
    """The kind of change against a base; none where the base is 0 or missing."""
    change = f"({now} - {base}) / {base} * 100"
    return f"case when {base} = 0e0 or {base} is null then '' when {change} > 50 then '↑↑' when {change} > 10 then '↑' when {change} < -50 then '↓↓' when {change} < -10 then '↓' else '=' end"


step(
    "c15_against_baseline",
    lambda d: f"""select s.session_id, s.project_dir, {delta_label("s.message_count * 1e0", "b.median_messages * 1e0")} as messages, {delta_label("coalesce(s.cost_usd, 0e0)", "b.median_cost")} as cost, {delta_label(d.us("s.start_time", "s.end_time") + " * 1e0", "b.median_duration_us * 1e0")} as duration
    from {{p1_session_cost}} s join {{c15_baseline}} b on b.project_dir = s.project_dir""",
)
step("p9_delta_label", f"select session_id, {delta_label('now', 'base')} as delta from (select s.session_id, s.message_count * 1e0 as now, b.median_messages * 1e0 as base from {{sessions}} s left join {{c15_baseline}} b on s.project_dir = b.project_dir)")
#: What ends the first sentence, in the order in which it is looked for.
SENTENCE_ENDS = ("chr(10)", "'. '", "' — '")


def title(d, summary: str, first: str) -> str:
    """The first sentence of a summary if it ends within 200 characters, else all of it; else the first message."""
    cuts = " ".join(f"when {d.position(e, summary)} between 2 and 200 then trim(substring({summary}, 1, {d.position(e, summary)} - 1))" for e in SENTENCE_ENDS)
    return f"case when {summary} <> '' then case {cuts} else {summary} end when {first} <> '' then {first} else '(no messages)' end"


step("p11_title_for", lambda d: f"select session_id, {title(d, 'summary', 'first_user_msg')} as title from {{chat_sessions}}")
step("p14_model_family", lambda d: f"select session_id, case when contains(lower(model), 'opus') then 'opus' when contains(lower(model), 'sonnet') then 'sonnet' when contains(lower(model), 'haiku') then 'haiku' else 'other' end as family, {d.extract('git_branch', '^[^/-]+')} as branch_kind from {{sessions}}")
#: Tools by what they do.
TOOLS = (("execution", "Bash Task Skill"), ("edit", "Edit Write NotebookEdit"), ("read", "Read Grep Glob ToolSearch WebFetch WebSearch"))
_CATEGORY = " ".join(f"when tool_name in ({', '.join(repr(t) for t in tools.split())}) then '{kind}'" for kind, tools in TOOLS)
step("p15_tool_category", f"select tool_name, case {_CATEGORY} else 'other' end as category, cast(sum(calls) as bigint) as calls from {{s8_tool_calls}} group by tool_name")
step("ranked_tools", "select session_id, tool_name, calls, row_number() over (partition by session_id order by calls desc, tool_name) as k from {s8_tool_calls}", operator=False)
step("top_tools", lambda d: f"select session_id, {d.joined('tool_name || ' + repr(':') + ' || ' + d.text('calls'), 'k')} as tools from {{ranked_tools}} where k <= 8 group by session_id", operator=False)
step(
    "p8_session_detail",
    lambda d: f"""select s.session_id, round(cache_read_tokens / nullif(cache_read_tokens + input_tokens, 0e0), 8) as cache_hit_ratio, round(user_messages / nullif({d.us("start_time", "end_time")} / 6e7, 0e0), 8) as messages_per_minute,
    {d.floor_div("(input_tokens + output_tokens + cache_creation_tokens + cache_read_tokens)", "nullif(message_count, 0)")} as tokens_per_message, round(user_messages / nullif(assistant_messages * 1e0, 0e0), 8) as user_ratio,
    {", ".join(f"round({c}_usd / nullif(cost_usd, 0e0), 8) as {c}_share" for c in ("input", "output", "cache_write", "cache_read"))}, t.tools as top_tools from {{p1_session_cost}} s left join {{top_tools}} t on t.session_id = s.session_id""",
)
step("listed", lambda d: "select * from {numbered_sessions}" if d.name == "spark" else "select session_id, project_dir, start_time, message_count, row_number() over (order by start_time desc, session_id) as place from {sessions}", operator=False)
step("p2_list_sessions", "select l.place, l.session_id, l.project_dir, l.start_time, l.message_count, t.tools from {listed} l left join {top_tools} t on t.session_id = l.session_id")
step("p3_get_sessions", "select s.session_id, s.model, t.tool_name, t.calls from {sessions} s join {s8_tool_calls} t on s.session_id = t.session_id where s.session_id in (select distinct session_id from {event_rows} where event_id % 20 = 0)")
step("p6_period_filter", f"select session_id, case when start_time > {AS_OF} - interval 7 day then 'week' when start_time > {AS_OF} - interval 30 day then 'month' else 'all' end as period from {{sessions}}")
step("p10_activity", lambda d: f"select session_id, case when {d.us('end_time', AS_OF)} < 300000000 then 'active' when {d.us('end_time', AS_OF)} < 3600000000 then 'paused' else 'idle' end as state, case when {d.days('cast(end_time as date)', f'cast({AS_OF} as date)')} = 0 then 'Today' when {d.days('cast(end_time as date)', f'cast({AS_OF} as date)')} = 1 then 'Yesterday' when {d.days('cast(end_time as date)', f'cast({AS_OF} as date)')} < 7 then 'This week' else 'Older' end as bucket from {{sessions}}")
def _metric(d, of: str, column: str | None) -> str:
    return f"cast({of}.{column} as bigint)" if column else f"cast({d.floor_div(d.us(f'{of}.start_time', f'{of}.end_time'), '1000000')} as bigint)"


# pairs are an input; the registered ones are a project's sessions one after another
step("session_pairs", "select session_id as left_id, next_id as right_id from (select session_id, lead(session_id) over (partition by project_dir order by start_time, session_id) as next_id from {sessions}) where next_id is not null", operator=False)
METRICS = (("messages", "message_count"), ("user messages", "user_messages"), ("assistant messages", "assistant_messages"), ("input tokens", "input_tokens"), ("output tokens", "output_tokens"), ("seconds", None))
step(
    "p12_compare_sessions",
    lambda d: "select left_id, right_id, metric, a, b, b - a as delta from (" + " union all ".join(f"select p.left_id, p.right_id, '{name}' as metric, {_metric(d, 'x', c)} as a, {_metric(d, 'y', c)} as b from {{session_pairs}} p join {{sessions}} x on x.session_id = p.left_id join {{sessions}} y on y.session_id = p.right_id" for name, c in METRICS) + ")",
)
step("p16_last_user_messages", "select session_id, ord, content from (select *, row_number() over (partition by session_id order by ord desc) as k from {s6_messages} where role = 'user') where k <= 3")
