"""Activity: heat maps, streaks, distributions, work threads."""

from ..plans.catalog import DEFAULTS, step
from ..sources.canonical import AS_OF

step("grid_6_7", lambda d: f"select bin, wd from (select {d.ints(0, 5)} as bin) cross join (select {d.ints(0, 6)} as wd)", operator=False)
step(
    "t1_heatmap",
    lambda d: f"""select g.bin, g.wd, count(s.session_id) as sessions from {{grid_6_7}} g left join (select session_id, cast(floor(hour(start_time) / 4e0) as integer) as b, {d.weekday("start_time")} as w from {{sessions}}
    where start_time >= {AS_OF} - interval 84 day) s on g.bin = s.b and g.wd = s.w group by g.bin, g.wd""",
)
step("calendar", lambda d: f"select {d.series("cast(timestamp '$first_monday' as date)", "cast(timestamp '$last_sunday' as date)")} as day", operator=False, first_monday="2023-11-27 00:00:00", last_sunday="2024-02-04 00:00:00")
step("t2_calendar_heatmap", lambda d: f"""select {d.weekday("c.day")} as wd, cast({d.floor_div(d.days("cast(timestamp '$first_monday' as date)", "c.day"), "7")} as bigint) as week, count(s.session_id) as sessions from {{calendar}} c left join {{sessions}} s on cast(s.start_time as date) = c.day group by 1, 2""")
step("hours", lambda d: f"select {d.ints(0, 23)} as h", operator=False)
step("t3_peak_hour", "select h.h, cast(coalesce(sum(s.user_messages), 0) as bigint) as messages from {hours} h left join {sessions} s on hour(s.start_time) = h.h group by h.h")
step("t4_time_cost_points", "select session_id, cast(hour(start_time) as integer) as h, cost_usd, model, project_dir from {p1_session_cost} where cost_usd is not null")
step(
    "t5_overview",
    lambda d: f"""select count(*) as sessions, cast(sum(message_count) as bigint) as messages, count(distinct cast(start_time as date)) as active_days, {d.days("cast(min(start_time) as date)", "cast(max(start_time) as date)")} + 1 as observed_days,
    max_by(session_id, {d.row(d.us("start_time", "end_time"), "session_id")}) as longest, (select day from (select cast(start_time as date) as day, count(*) as n from {{sessions}} group by 1) order by n desc, day limit 1) as busiest_day, min(start_time) as first_seen, max(start_time) as last_seen,
    (select model from (select model, count(*) as n from {{sessions}} where model <> '' and model <> '<synthetic>' group by model) order by n desc, model limit 1) as favourite from {{sessions}}""",
)
step("days_active", "select distinct cast(start_time as date) as day from {sessions}", operator=False)
step("runs_of_days", lambda d: f"select min(day) as first_day, max(day) as last_day, count(*) as n from (select day, {d.days('date ' + repr('2020-01-01'), 'day')} - row_number() over (order by day) as g from {{days_active}}) group by g", operator=False)
step("t6_streaks", lambda d: f"select max(n) as longest, coalesce(max(case when {d.days('last_day', f'cast({AS_OF} as date)')} <= 1 then n end), 0) as current from {{runs_of_days}}".replace("as current", "as current_run"))
step("t7_timeline", "select cast(start_time as date) as day, session_id, row_number() over (partition by cast(start_time as date) order by start_time desc, session_id) as place from {sessions} where start_time >= timestamp '$from_day' and cast(start_time as date) <= cast(timestamp '$to_day' as date)", from_day="2024-01-24 00:00:00", to_day="2024-01-30 00:00:00")
step("t8_model_distribution", "select coalesce(nullif(model, ''), 'unknown') as model, cast(sum(message_count) as bigint) as messages from {sessions} group by 1")
step(
    "t9_tokens_by_day_model",
    """select day, model, tokens, cast(sum(tokens) over (partition by day) as bigint) as day_tokens from (select day, model, tokens, dense_rank() over (order by day desc) as k from
    (select cast(start_time as date) as day, model, cast(sum(input_tokens + output_tokens) as bigint) as tokens from {sessions} where model <> '' and model <> '<synthetic>' group by 1, 2) where tokens > 0) where k <= 30""",
)
step(
    "t10_model_breakdown",
    """select model, tokens_in, tokens_out, tokens_in + tokens_out as tokens, sessions, round((tokens_in + tokens_out) * 100e0 / sum(tokens_in + tokens_out) over (), 6) as percent from
    (select model, cast(sum(input_tokens + cache_creation_tokens + cache_read_tokens) as bigint) as tokens_in, cast(sum(output_tokens) as bigint) as tokens_out, count(*) as sessions from {sessions} group by model)""",
)
step("t11_tool_stats", lambda d: f"select tool_name, cast(sum(calls) as bigint) as calls, count(distinct session_id) as sessions, {d.floor_div('cast(sum(calls) as bigint)', 'count(distinct session_id)')} as mean_calls from {{s8_tool_calls}} group by tool_name order by calls desc, tool_name limit $tools", tools=25)
step("t12_tool_sessions", "select session_id, calls from {s8_tool_calls} where tool_name = '$tool' order by calls desc, session_id limit $tool_sessions", tool="Edit", tool_sessions=50)
# order statistics: Spark selects them over ranges of values (``operators.order``), the checking engine numbers the rows of a group
step(
    "flow_rows",
    "select model, session_id, message_count, case when message_count < 10 then 0 when message_count < 30 then 1 when message_count < 100 then 2 when message_count < 300 then 3 when message_count < 1000 then 4 else 5 end as bucket from (select model, session_id, message_count from {sessions} union all select 'all models', session_id, message_count from {sessions})",
    operator=False,
)
step(
    "flow_percentiles",
    lambda d: "select * from {flow_selected}" if d.name == "spark" else "select model, " + ", ".join(f"max(case when k = floor((n - 1) * {p / 100}e0) + 1 then message_count end) as p{p}" for p in (50, 90, 99)) + " from (select *, row_number() over (partition by model order by message_count, session_id) as k, count(*) over (partition by model) as n from {flow_rows}) group by model",
    operator=False,
)
step("t13_flow_distribution", lambda d: "select b.*, p.p50, p.p90, p.p99 from (select model, " + ", ".join(f"{d.bool_sum(f'bucket = {b}')} as b{b}" for b in range(6)) + " from {flow_rows} group by model) b join {flow_percentiles} p on p.model = b.model")
step("resolved_rows", "select coalesce(model, '(unknown)') as model, session_id, resolved_at_turn as r from {sessions}", operator=False)
step(
    "resolved_percentiles",
    lambda d: "select model, n as resolved, p50, p90 from {resolved_selected}" if d.name == "spark" else f"""select model, max(n) as resolved, max(case when k = {d.floor_div("n", "2")} + 1 then r end) as p50, max(case when k = least({d.floor_div("n * 9", "10")}, n - 1) + 1 then r end) as p90 from
    (select model, r, count(*) over (partition by model) as n, row_number() over (partition by model order by r, session_id) as k from {{resolved_rows}} where r is not null) group by model""",
    operator=False,
)
step("t14_convergence", "select t.model, t.total, coalesce(p.resolved, 0) as resolved, p.p50, p.p90 from (select model, count(*) as total from {resolved_rows} group by model) t left join {resolved_percentiles} p on p.model = t.model")
step("t15_recent_by_project", "select project_dir, session_id, max(end_time) over (partition by project_dir) as latest, count(*) over (partition by project_dir) as sessions, row_number() over (partition by project_dir order by end_time desc, session_id) as place from {sessions}")
step(
    "thread_rows",
    lambda d: f"""select *, sum(opens) over (partition by project_dir, git_branch order by start_time, session_id rows unbounded preceding) as thread_no from
    (select *, case when before is null then 'first' when gap_us < $compact_s * 1000000 then 'compact' else 'resumed' end as kind, case when before is null or gap_us > $gap_s * 1000000 then 1 else 0 end as opens from
    (select *, greatest(0, {d.us("before", "start_time")}) as gap_us from (select *, lag(end_time) over (partition by project_dir, git_branch order by start_time, session_id) as before from {{p1_session_cost}})))""",
    operator=False,
)
DEFAULTS.update(compact_s=60, gap_s=1800)
step(
    "w1_build_threads",
    lambda d: f"""select project_dir, git_branch, cast(thread_no as bigint) as thread_no, min(start_time) as start_time, max_by(end_time, {d.row("start_time", "session_id")}) as end_time, count(*) as sessions,
    {d.bool_sum("kind = 'compact' and opens = 0")} as compact, {d.joined("session_id", "start_time")} as session_ids from {{thread_rows}} group by project_dir, git_branch, thread_no""",
)
step("w2_thread_totals", lambda d: f"select project_dir, git_branch, cast(thread_no as bigint) as thread_no, cast(sum({d.us('start_time', 'end_time')}) as bigint) as duration_us, round(coalesce(sum(cost_usd), 0e0), 8) as cost_usd, cast(sum(sidechain_agents) as bigint) as agents from {{thread_rows}} group by project_dir, git_branch, thread_no")
step("w2_threads_by_project", "select project_dir, cast(sum(sessions) over (partition by project_dir) as bigint) as project_sessions, git_branch, thread_no, sessions, row_number() over (partition by project_dir order by start_time desc, git_branch, thread_no) as place from {w1_build_threads}")
step("w3_thread_shape", lambda d: f"select session_id, cast(least(7, floor({d.us('start_time', 'end_time')} * 7e0 / nullif(max({d.us('start_time', 'end_time')}) over (partition by project_dir, git_branch, thread_no), 0))) as integer) as level from {{thread_rows}}")
step(
    "w4_rank_percentile",
    lambda d: "select * from {price_percentiles}" if d.name == "spark" else f"""select l_shipmode_, count(*) as n, max(case when k = floor((n - 1) * 0.5e0) then v end) as p50, max(case when k = floor((n - 1) * 0.9e0) then v end) as p90, max(case when k = {d.floor_div("n", "2")} then v end) as upper_median,
    max(case when k = least({d.floor_div("n * 9", "10")}, n - 1) then v end) as nine_tenths from (select l_returnflag || l_linestatus as l_shipmode_, l_extendedprice as v, row_number() over (partition by l_returnflag, l_linestatus order by l_extendedprice) - 1 as k, count(*) over (partition by l_returnflag, l_linestatus) as n from {{lineitem}}) group by l_shipmode_""".replace("l_shipmode_", "kind"),
)
step("w5_top_k_per_group", "select lang, doc_id, n_chars, k from (select lang, doc_id, n_chars, row_number() over (partition by lang order by n_chars desc, doc_id) as k from {documents}) where k <= 5")
step(
    "w6_thread_lanes",
    lambda d: "select project_dir, git_branch, cast(thread_no as bigint) as thread_no, first_index, last_index, sessions from {lanes}" if d.name == "spark" else "select project_dir, git_branch, cast(thread_no as bigint) as thread_no, min(place) as first_index, max(place) as last_index, count(*) as sessions from (select *, row_number() over (order by start_time, session_id) - 1 as place from {thread_rows}) group by project_dir, git_branch, thread_no",
)
