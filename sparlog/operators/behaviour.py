"""Text behaviour of messages, loops, files, recommendations."""

from ..plans.catalog import step

#: Stop-words, Portuguese and English.
STOPWORDS = """a o as os um uma uns umas de do da dos das no na nos nas em com por para pra pro ao aos à às e ou mas que se como quando onde porque porém
é são foi era ser estar está tá ter tem tinha eu tu ele ela nós vocês eles elas voce você meu minha seu sua nosso nossa deles delas isso isto aquilo esse essa este esta aquele aquela
aqui aí ali lá não nao sim também tambem já ja ainda só so mais menos agora antes depois hoje ontem amanhã amanha muito muita muitos muitas pouco pouca poucos poucas
todo toda todos todas outro outra outros outras vai vão ir vou vamos vem veio fiz fazer faz pode podem posso deve devem
a an the and or but if of in on at by for to is are was were be been being have has had i you he she it we they my your his her our their
this that these those do does did doing so as with from up down out over under can could should would will may might not no yes me us them him what which who when where why how""".split()
#: Phrases of rework.
REWORK = ("errado", "errei", "errou", "nao funciona", "não funciona", "não rodou", "nao rodou", "rollback", "desfaz", "desfaça", "ignora", "esqueci", "mudei de ideia", "cancela", "para", "stop", "fix", "bug", "broken", "fail", "failed")
_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(STOPWORDS))
_REWORK = "|".join(REWORK)

step(
    "token_rows",
    lambda d: f"select session_id, ord, role, k, w from (select session_id, ord, role, {('posexplode(' + d.words('lower(content)') + ') as (k, w)') if d.name == 'spark' else ('unnest(' + d.words('lower(content)') + ') as w, generate_subscripts(' + d.words('lower(content)') + ', 1) - 1 as k')} from {{s6_messages}}) where length(w) >= 2 and w not in ({_STOP})",
    operator=False,
)
step("b1_tokenize", "select session_id, ord, role, row_number() over (partition by session_id, ord order by k) as place, w from {token_rows}")
step("b2_top_words", "select w, count(*) as n from {token_rows} where role = 'user' group by w order by n desc, w limit $words", words=25)
step("b3_top_prefixes", "select w, count(*) as n from {b1_tokenize} where role = 'user' and place = 1 group by w order by n desc, w limit $prefixes", prefixes=15)
step("adjoining", "select session_id, ord, w, lead(w) over (partition by session_id, ord order by place) as w2, lead(w, 2) over (partition by session_id, ord order by place) as w3 from {b1_tokenize} where role = 'user'", operator=False)
step("b4_top_bigrams", "select w || ' ' || w2 as gram, count(*) as n from {adjoining} where w2 is not null group by 1 order by n desc, gram limit $bigrams", bigrams=20)
step("b5_top_trigrams", "select w || ' ' || w2 || ' ' || w3 as gram, count(*) as n from {adjoining} where w3 is not null group by 1 order by n desc, gram limit $trigrams", trigrams=12)
step("message_words", "select distinct session_id, ord, w from {token_rows} where role = 'user'", operator=False)
step("word_messages", "select w, count(*) as n from {message_words} group by w", operator=False)
step("often_words", "select m.session_id, m.ord, m.w, f.n from {message_words} m join {word_messages} f on m.w = f.w where f.n >= 3", operator=False)
step(
    "b6_co_occurrence",
    lambda d: f"""select a, b, n, round({d.log2("n * total / (na * nb)")}, 6) as pmi from (select x.w as a, y.w as b, x.n * 1e0 as na, y.n * 1e0 as nb, count(*) as n from {{often_words}} x
    join {{often_words}} y on x.session_id = y.session_id and x.ord = y.ord and x.w < y.w group by x.w, y.w, x.n, y.n having count(*) >= 3)
    cross join (select count(*) * 1e0 as total from (select distinct session_id, ord from {{message_words}})) order by pmi desc, n desc, a, b limit 30""",
)
step("b7_error_rate", lambda d: f"select count(*) as messages, {d.bool_sum(d.matches('lower(content)', _REWORK))} as hits, round({d.bool_sum(d.matches('lower(content)', _REWORK))} / nullif(count(*) * 1e0, 0e0), 6) as rate from {{s6_messages}} where role = 'user'")
step("phrases", "select phrase from (values " + ", ".join(f"('{p}')" for p in REWORK) + ") as t(phrase)", operator=False)
step("b8_error_breakdown", "select p.phrase, count(m.content) as n from {phrases} p left join (select * from {s6_messages} where role = 'user') m on contains(lower(m.content), p.phrase) group by p.phrase")
step("session_errors", lambda d: f"select session_id, hits, total, hits / (total * 1e0) as rate from (select session_id, {d.bool_sum(d.matches('lower(content)', _REWORK))} as hits, count(*) as total from {{s6_messages}} where role = 'user' group by session_id)", operator=False)
step("b9_high_error_sessions", "select session_id, hits, total, round(rate, 6) as rate from {session_errors} where rate >= $least_rate", least_rate=0.15)
step("role_words", "select role, w, n, row_number() over (partition by role order by n desc, w) as k from (select role, w, count(*) as n from {token_rows} group by role, w)", operator=False)
step("role_top", lambda d: f"select role, {d.joined('w', 'k')} as top_words from {{role_words}} where k <= 10 group by role", operator=False)
step("b10_style", "select m.role, m.messages, round(t.tokens / (m.messages * 1e0), 6) as mean_tokens, round(m.sentences / (m.messages * 1e0), 6) as mean_sentences, t.vocabulary, w.top_words from (select role, count(*) as messages, sum(greatest(1, length(content) - length(replace(replace(replace(content, '.', ''), '!', ''), '?', '')))) as sentences from {s6_messages} group by role) m join (select role, sum(n) as tokens, count(*) as vocabulary from {role_words} group by role) t on m.role = t.role join {role_top} w on w.role = m.role")
step("b11_rework_label", "select session_id, case when rate > 0.15e0 then 'high' when rate > 0.05e0 then 'moderate' else 'healthy' end as label from {session_errors}")
#: Labels and patterns of technologies; those of the second list are looked for as they are spelt.
TECH = (
    ("Go", r"golang|go\s+(build|run|test|mod|install)"), ("TypeScript", "typescript|tsx?|ts-node"), ("JavaScript", r"javascript|node\.?js|nodejs|npm|yarn"), ("React", r"react|jsx|tsx|next\.?js|vite"),
    ("Python", "python|pip|pipx|pyenv|poetry|pyproject|venv"), ("Postgres", "postgres|postgresql|psql|pgcli"), ("MongoDB", "mongodb|mongosh|mongo"), ("Docker", "docker|colima|orbstack|dockerfile"),
    ("Kubernetes", "kubectl|kubernetes|k8s|helm|stern|kubectx|k9s"), ("AWS", "aws|ec2|lambda|s3|eks|cloudformation|cloudwatch"), ("Terraform", "terraform|terragrunt|atmos|opentofu"),
    ("Bubble Tea", "bubble.?tea|lipgloss|charm"), ("SQLite", "sqlite|fts5|modernc"), ("Git", r"git|github|gh\s+(?:repo|pr|issue)"),
)
TECH_AS_SPELT = (
    ("Bun", r"bun(?:\s+(?:install|run|add|dev|build|x))?"), ("NestJS", "nest(?:js|js)?"), ("Tailwind", "tailwind(?:css)?"), ("Redis", "redis(?:-cli)?"), ("Vite", "vite"), ("Recharts", "recharts"), ("Ollama", "ollama"),
    ("Obsidian", "obsidian"), ("Ghostty", "ghostty"), ("Hammerspoon", "hammerspoon"), ("Claude Code", "claude.?code"),
)
_TECH = [(label, rf"(?i)\b(?:{r})\b") for label, r in TECH] + [(label, rf"\b(?:{r})\b") for label, r in TECH_AS_SPELT]
step("tech_counts", lambda d: f"select {d.table(('tech', 'found'), [(repr(label), d.count_matches('content', d.ascii_word(r))) for label, r in _TECH])} from {{tech_texts}}", operator=False)
# a call is a part of its message: the tool's name and what it was given, either of which may be missing; messages that come without a table of calls hold theirs
step("call_texts", "select concat_ws(' ', 'tool:' || tool_name, input_preview) as content from {tool_events}", operator=False, absent="select cast(null as string) as content where false")
step("tech_texts", "select content from {s6_messages} union all select content from {call_texts}", operator=False)
step("b12_detect_tech", "select tech, cast(sum(found) as bigint) as matches from {tech_counts} group by tech having sum(found) > 0 order by matches desc, tech")
step("said_lines", "select session_id, ord, role || ': ' || substring(content, 1, $most_of_message) || case when length(content) > $most_of_message then '…' else '' end || chr(10) || '---' || chr(10) as line from {s6_messages}", operator=False, most_of_message=800)
step("used_lines", "select session_id, ord, line, sum(length(line)) over (partition by session_id order by ord rows unbounded preceding) - length(line) as used from {said_lines}", operator=False)
step("b13_transcripts", lambda d: f"select session_id, case when length(body) > $most_of_session then substring(body, 1, $most_of_session) || chr(10) || '…(truncated)' else body end as transcript from (select session_id, {d.joined('line', 'ord', '')} as body from {{used_lines}} where used <= $most_of_session group by session_id)", most_of_session=8000)
step("b14_embedding_text", lambda d: f"select session_id, substring({d.lines('content', 'ord')}, 1, $most_chars) as body from (select session_id, ord, content, sum(length(content)) over (partition by session_id order by ord rows unbounded preceding) as used from {{s6_messages}} where role = 'user') where used - length(content) < $most_chars group by session_id", most_chars=4000)
step(
    "b15_insight_evidence",
    lambda d: f"""select 'word' as kind, w as item, cast(n as double) as value from (select w, n from {{b2_top_words}} order by n desc, w limit 15) union all select 'bigram', gram, n from (select gram, n from {{b4_top_bigrams}} order by n desc, gram limit 10)
    union all select 'tool', tool_name, calls from (select tool_name, calls from {{t11_tool_stats}} order by calls desc, tool_name limit 10) union all select 'error', 'rate', rate from {{b7_error_rate}} union all select 'error', 'hits', hits from {{b7_error_rate}}
    union all select 'high error session', {d.text("session_id")}, rate from {{b9_high_error_sessions}} union all select 'summary', {d.text("session_id")} || ': ' || case when length(summary) > 120 then substring(summary, 1, 120) || '…' else summary end, length(summary) from {{chat_sessions}} where summary <> ''""",
)
step("asked", "select session_id, ord, content, row_number() over (partition by session_id order by ord) as f, row_number() over (partition by session_id order by ord desc) as l from {s6_messages} where role = 'user' and substring(trim(content), 1, 1) <> '<'", operator=False)
step("chat_tools", lambda d: f"select session_id, {d.joined('tool', 'k')} as tools from (select session_id, tool, row_number() over (partition by session_id order by n desc, tool) as k from (select user_id as session_id, event_type as tool, count(*) as n from {{event_rows}} group by user_id, event_type)) where k <= 8 group by session_id", operator=False)
step("asked_lines", lambda d: f"select session_id, {d.joined('line', 'ord', ' | ')} as asked from (select session_id, ord, substring(trim(content), 1, 200) || case when length(trim(content)) > 200 then '…' else '' end as line from {{asked}} where f <= 5 or l <= 5) group by session_id", operator=False)
step("b16_knowledge_inputs", lambda d: f"select s.session_id, coalesce(nullif(s.summary, ''), 'Session in ' || s.project_dir || ', branch ' || s.git_branch || ', ' || {d.text('m.messages')} || ' messages') as summary, a.asked, t.tools from {{chat_sessions}} s join (select session_id, count(*) as messages from {{s6_messages}} group by session_id) m on m.session_id = s.session_id left join {{asked_lines}} a on a.session_id = s.session_id left join {{chat_tools}} t on t.session_id = s.session_id")



def _loops(d, count: str, seconds: str) -> str:
    span = d.us("min(ts)", "max(ts)")
    return f"select session_id, tool_name, input_hash, count(*) as n, {span} as span_us, max(input_preview) as preview from {{tool_events}} group by session_id, tool_name, input_hash having count(*) >= {count} and {span} > 0 and {span} <= cast({seconds} as bigint) * 1000000"


step("r1_detect_loops", lambda d: _loops(d, "$min_count", "$window_s") + " order by n desc, span_us, session_id, tool_name, input_hash limit 50", min_count=3, window_s=300)
def _reuse(d) -> str:
    sessions = "count(session_id)" if d.name == "spark" else "count(distinct session_id)"  # a session has a file once
    return f"select file_path, {sessions} as sessions, cast(sum(op_count) as bigint) as ops from {{session_files}} group by file_path having {sessions} >= greatest(2, $least_sessions) order by sessions desc, ops desc, file_path limit $files"


step("r2_file_reuse", _reuse, least_sessions=2, files=20)
#: Parts of paths that are no work of the session's own.
NOISE_PATHS = ("/dist/", "/build/", "/node_modules/", "/.git/", "/.cache/", "/.next/", "/.DS_Store")
def _noise(d) -> str:
    return " or ".join(f"contains({d.text('file_path')}, '{p}')" for p in NOISE_PATHS)


step(
    "r3_rule_file_reuse",
    lambda d: f"select 'skill_file' as rule, {d.text('file_path')} as title, sessions * 10 as score, sessions as strength from {{r2_file_reuse}} where sessions >= 3 and not ({_noise(d)}) order by sessions desc, ops desc, file_path limit 10",
)
step("hook_loops", lambda d: _loops(d, "$hook_count", "$hook_window_s") + " and tool_name = '$hook_tool' order by n desc, span_us, session_id, tool_name, input_hash limit 50", operator=False, hook_count=3, hook_window_s=3600, hook_tool="Bash")
step("r4_rule_hook", "select 'hook' as rule, input_hash as title, n * 8 as score, n as strength from {hook_loops}")
step("r5_rule_downgrade", "select 'downgrade' as rule, 'opus' as title, cast(round(sum(cost_usd) * 5) as bigint) as score, 4 as strength from {p1_session_cost} where contains(model, 'opus') and message_count <= 10 and output_tokens <= 50000 and cost_usd >= 0.1e0 having count(*) >= 3")
step(
    "j4_reads_within_5_minutes",
    lambda d: "select session_id, cast(sum(pairs) as bigint) as pairs from (select session_id, count(*) over (partition by session_id order by us range between 1 following and 300000000 following) as pairs from (select session_id, " + d.us("timestamp '2024-01-01 00:00:00'", "ts") + " as us from {tool_events} where tool_name = '$read_tool')) group by session_id having sum(pairs) > 0",
    read_tool="Read",
)
step("r6_rule_subagent", "select 'subagent' as rule, session_id as title, pairs as score, 4 as strength from {j4_reads_within_5_minutes} where pairs >= $min_pairs order by pairs desc, session_id limit 5", min_pairs=30)
step("r7_rule_context", "select 'context' as rule, head as title, count(*) * 6 as score, count(*) as strength from (select trim(trailing ' .,!?;:' from lower(substring(trim(first_user_msg), 1, 60))) as head from {sessions}) group by head having count(*) >= 3")
step("skill_loops", lambda d: _loops(d, "$skill_count", "$skill_window_s") + " and tool_name <> '$hook_tool' order by n desc, span_us, session_id, tool_name, input_hash limit 50", operator=False, skill_count=5, skill_window_s=3600)
step("r8_rule_loop_skill", "select 'loop_skill' as rule, tool_name || ' ' || input_hash as title, n * 7 as score, 7 as strength from {skill_loops}")
#: Commands that a tool would do better, and how many make a case.
CLI = (("gh", ("api.github.com", "raw.githubusercontent.com"), 3), ("gh + git aliases", ("git diff --name-only", "git log --pretty="), 5), ("fd", ('find . -name "*', "find . -type f"), 4), ("rg (ripgrep)", ("grep -r", "grep -R"), 4), ("jq (já é CLI)", ("jq -r", "jq ''.["), 8), ("httpie ou xh", ("curl http", "wget http"), 5), ("lazydocker", ("docker run -it", "docker exec -it"), 4), ("k9s", ("kubectl get", "kubectl describe"), 5))
_MET = [" or ".join(f"contains(input_preview, '{p}')" for p in pats) for _, pats, _ in CLI]
step("cli_counts", lambda d: f"select {d.table(('title', 'least', 'met'), [(repr(cli), str(least), f'case when {met} then 1 else 0 end') for (cli, _, least), met in zip(CLI, _MET, strict=True)])} from {{tool_events}} where tool_name = '$hook_tool'", operator=False)
step("r9_rule_cli", lambda d: f"select 'cli' as rule, title, cast(sum(met) as bigint) * 4 as score, cast({d.floor_div('cast(sum(met) as bigint)', '2')} as bigint) as strength from {{cli_counts}} group by title, least having sum(met) >= least")
step("r10_advise", "select rule, title, score, case when strength >= 7 then 'high' when strength >= 4 then 'medium' else 'low' end as confidence from (" + " union all ".join(f"select rule, title, cast(score as bigint) as score, cast(strength as bigint) as strength from {{{r}}}" for r in ("r3_rule_file_reuse", "r4_rule_hook", "r5_rule_downgrade", "r6_rule_subagent", "r7_rule_context", "r8_rule_loop_skill", "r9_rule_cli")) + ") order by score desc, rule, title")
step("meta_loops", lambda d: _loops(d, "$meta_count", "$meta_window_s") + " order by n desc, span_us, session_id, tool_name, input_hash limit 50", operator=False, meta_count=3, meta_window_s=3600)
step(
    "r11_meta_report",
    lambda d: f"""select 'file' as part, {d.text('file_path')} as item, cast(sessions as double) as n from {{r2_file_reuse}} union all select 'ticket', coalesce(ticket, ''), cast(cost_usd as double) from {{c11_cost_by_ticket}}
    union all select 'resolved', model, cast(resolved as double) from {{t14_convergence}} union all select 'median turn', model, cast(p50 as double) from {{t14_convergence}}
    union all select 'loop', session_id || ' ' || tool_name || ' ' || input_hash, cast(n as double) from {{meta_loops}}""",
)
