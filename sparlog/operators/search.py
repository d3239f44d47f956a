"""Search: text index, keyword, metadata and vector ranking, fusion, exemplars; knowledge roll-ups.

Queries are a table. The registered ones ask with the first one to four words
of every user message of a twentieth of the conversations, and with the vector
of the session that asks.
"""

from ..functions import stem
from ..plans import checks
from ..plans.catalog import step
from . import cost

_FOLDED, _PLAIN = stem.folding()

# tokens are runs of letters and digits of the content, and the role, which is indexed as well (pos -1)
step("content_tokens", lambda d: f"select session_id, ord, role, pos, raw, translate(lower(raw), '{_FOLDED}', '{_PLAIN}') as w from (select session_id, ord, role, {d.raw_tokens('content')} from {{s6_messages}})", operator=False)
step("all_tokens", "select session_id, ord, role, pos, raw, w from {content_tokens} union all select session_id, ord, role, -1, role, lower(role) from {s6_messages}", operator=False)
step("vocabulary", "select distinct w from {all_tokens}", operator=False)
# few bytes that cost much: Spark deals the words to all its slots (``plans.queries``)
step("spread", lambda d: "select w from {spread_vocabulary}" if d.name == "spark" else "select w from {vocabulary}", operator=False)
step("stems", lambda d: stem.stemmed(d, "w", "{spread}"), operator=False)
step("token_stems", "select t.session_id, t.ord, t.role, t.pos, t.raw, s.stem as term from {all_tokens} t join {stems} s on t.w = s.w", operator=False)
# Spark reads the index it has stored (``plans.queries``), so that a query's many uses of it do not tokenise anew
step("indexed", lambda d: "select * from {index_rows}" if d.name == "spark" else "select * from {token_stems}", operator=False)
step("search_queries", lambda d: f"select {d.text('session_id')} || '/' || {d.text('ord')} as query_id, session_id as asker, {d.first_words('content', '(1 + (ord + session_id / 20) % 4)')} as q from {{s6_messages}} where role = 'user' and session_id % 20 = 0".replace("session_id / 20", d.floor_div("session_id", "20")), operator=False)
step("query_words", lambda d: f"select query_id, translate(lower(raw), '{_FOLDED}', '{_PLAIN}') as w from (select query_id, {d.raw_tokens('q')} from {{search_queries}})", operator=False)
step("query_stems", lambda d: stem.stemmed(d, "w", "(select distinct w from {query_words})"), operator=False)
step("query_terms", "select distinct q.query_id, s.stem as term from {query_words} q join {query_stems} s on q.w = s.w", operator=False)
step("q1_text_index", lambda d: f"select session_id, ord, role, term, count(*) as tf, {d.joined(d.text('pos'), 'pos')} as positions from {{indexed}} group by session_id, ord, role, term")
step("postings", "select session_id, ord, term, count(*) as tf from {indexed} where term in (select term from {query_terms}) group by session_id, ord, term", operator=False)
step("doc_lengths", "select session_id, ord, role, count(*) as len from {indexed} group by session_id, ord, role", operator=False)
step("term_stats", "select term, count(*) as df from {postings} group by term", operator=False)
step(
    "term_weights",
    "select q.query_id, t.term, case when (n.docs - t.df + 0.5e0) / (t.df + 0.5e0) > 1 then greatest(ln((n.docs - t.df + 0.5e0) / (t.df + 0.5e0)), 1e-6) else 1e-6 end as idf, n.mean_len, count(*) over (partition by q.query_id) as wanted from {query_terms} q left join {term_stats} t on t.term = q.term cross join (select count(*) * 1e0 as docs, avg(len * 1e0) as mean_len from {doc_lengths}) n",
    operator=False,
)
step(
    "scored_hits",
    """select query_id, session_id, ord, role, score, place from (select *, row_number() over (partition by query_id order by score desc, session_id, ord) as place from (
    select w.query_id, p.session_id, p.ord, l.role, round(sum(w.idf * p.tf * 2.2e0 / (p.tf + 1.2e0 * (0.25e0 + 0.75e0 * l.len / w.mean_len))), 6) as score
    from {term_weights} w join {postings} p on p.term = w.term join {doc_lengths} l on l.session_id = p.session_id and l.ord = p.ord group by w.query_id, w.wanted, p.session_id, p.ord, l.role having count(*) = w.wanted)) where place <= 100""",
    operator=False,
)
# hits without snippets that a caller has stored
step("bm25_hits", lambda d: "select query_id, session_id, ord, role, score, place from {hit_rows}" if d.name == "spark" else "select * from {scored_hits}", operator=False)
# Spark scores each distinct set of terms once: the messages of its rarest term, then only these messages' further terms
step("query_sets", "select query_id, array_join(array_sort(collect_set(term)), ' ') as words from {query_terms} group by query_id", operator=False)
step("sized_postings", "select p.term, p.session_id, p.ord, l.role, p.tf, l.len from {postings} p join {doc_lengths} l on l.session_id = p.session_id and l.ord = p.ord", operator=False)
step(
    "set_terms",
    """select words, term, wanted, idf, mean_len, k from (select q.words, q.term, q.wanted, case when (n.docs - t.df + 0.5e0) / (t.df + 0.5e0) > 1 then greatest(ln((n.docs - t.df + 0.5e0) / (t.df + 0.5e0)), 1e-6) else 1e-6 end as idf, n.mean_len,
    row_number() over (partition by q.words order by t.df, q.term) as k, count(t.df) over (partition by q.words) as known from (select words, size(split(words, ' ')) as wanted, explode(split(words, ' ')) as term from (select distinct words from {query_sets})) q
    left join {term_stats} t on t.term = q.term cross join (select count(*) * 1e0 as docs, avg(len * 1e0) as mean_len from {doc_lengths}) n) where known = wanted""",
    operator=False,
)
# a message is one row with all its terms: a part of the messages scores all sets (``operators.scoring``), and only what may be among the first 100 is shuffled
step("message_terms", "select session_id, ord, role, len, collect_list(struct(term, tf)) as held from {sized_postings} group by session_id, ord, role, len", operator=False)
step("set_lists", "select words, first(mean_len) as mean_len, array_sort(collect_list(struct(k, term, idf))) as held from {set_terms} group by words", operator=False)
step("set_seeds", "select * from {scored_rows}", operator=False)
step("set_hits", "select words, session_id, ord, role, score, place from (select words, session_id, ord, role, round(score, 6) as score, row_number() over (partition by words order by round(score, 6) desc, session_id, ord) as place from {set_seeds}) where place <= 100", operator=False)
# a message's tokens meet its sets once; its windows are slices of the marked tokens, of which a place has as many as there are messages of one number
step(
    "set_snippets",
    """select words, session_id, ord, case when start > 0 then '…' else '' end || array_join(transform(array_sort(transform(filter(tokens, x -> x.pos >= start and x.pos < start + 16), x -> struct(x.pos as o, case when array_contains(terms, x.term) then '[' || x.raw || ']' else x.raw end as x))), s -> s.x), ' ')
    || case when start + 16 < size(tokens) then '…' else '' end as snippet from (select *, case when best is null or size(tokens) <= 16 then 0 else least(best.pos, size(tokens) - 16) end as start from (
    select *, array_min(transform(transform(marked, (x, i) -> struct(x.pos as pos, filter(slice(marked, greatest(i + 2 - same, 1), 17 * same), y -> y.pos >= x.pos and y.pos <= x.pos + 15).term as near)), z -> struct(-size(array_distinct(z.near)) as terms, -size(z.near) as hits, z.pos as pos))) as best from (
    select *, filter(tokens, x -> array_contains(terms, x.term)) as marked from (select session_id, ord, tokens, greatest(1, size(filter(tokens, x -> x.pos = 0))) as same, words, split(words, ' ') as terms from (select h.session_id, h.ord, t.tokens, explode(h.sets) as words
    from (select session_id, ord, collect_set(words) as sets from {top_rows} group by session_id, ord) h join (select i.session_id, i.ord, array_sort(collect_list(struct(i.pos, i.raw, i.term))) as tokens from {indexed} i left semi join {top_rows} w on w.session_id = i.session_id and w.ord = i.ord where i.pos >= 0 group by i.session_id, i.ord) t
    on t.session_id = h.session_id and t.ord = h.ord)))))""",
    operator=False,
)
step("query_hits", "select q.query_id, h.session_id, h.ord, h.role, h.score, h.place, s.snippet from {top_rows} h left join {set_snippets} s on s.words = h.words and s.session_id = h.session_id and s.ord = h.ord join {query_sets} q on q.words = h.words", operator=False)
_DOC = "query_id, session_id, ord"


def _snippets(hits: str) -> str:
    """Steps for the best window of 16 tokens of each of ``hits``: of most terms, then most hits, then the first; gives the name of the last one."""
    of = f"{hits}_marked"
    step(of, f"select h.query_id, c.session_id, c.ord, c.pos, c.raw, q.term from {{{hits}}} h join {{indexed}} c on c.session_id = h.session_id and c.ord = h.ord and c.pos >= 0 left join {{query_terms}} q on q.query_id = h.query_id and q.term = c.term", operator=False)
    window = f"partition by {_DOC} order by pos range between current row and 15 following"
    step(f"{hits}_windows", lambda d: f"select {_DOC}, pos, {d.distinct_over('term', window)} as terms, count(*) over ({window}) as hits from {{{of}}} where term is not null", operator=False)
    step(f"{hits}_best", lambda d: f"select {_DOC}, min_by(pos, {d.row('-terms', '-hits', 'pos')}) as pos from {{{hits}_windows}} group by {_DOC}", operator=False)
    step(f"{hits}_place", f"select n.*, case when b.pos is null or n.tokens <= 16 then 0 else least(b.pos, n.tokens - 16) end as start from (select {_DOC}, count(*) as tokens from {{{of}}} group by {_DOC}) n left join {{{hits}_best}} b on b.query_id = n.query_id and b.session_id = n.session_id and b.ord = n.ord", operator=False)
    step(
        f"{hits}_snippets",
        lambda d: f"""select query_id, session_id, ord, case when start > 0 then '…' else '' end || body || case when start + 16 < tokens then '…' else '' end as snippet from (select m.query_id, m.session_id, m.ord, p.start, p.tokens, {d.joined("case when m.term is null then m.raw else '[' || m.raw || ']' end", "m.pos", " ")} as body
        from {{{of}}} m join {{{hits}_place}} p on p.query_id = m.query_id and p.session_id = m.session_id and p.ord = m.ord and m.pos >= p.start and m.pos < p.start + 16 group by m.query_id, m.session_id, m.ord, p.start, p.tokens)""",
        operator=False,
    )
    return f"{hits}_snippets"


_SNIPPETS = _snippets("bm25_hits")
_SHOWN = f"select h.query_id, h.session_id, h.ord, h.role, h.score, h.place, s.snippet from {{bm25_hits}} h left join {{{_SNIPPETS}}} s on s.query_id = h.query_id and s.session_id = h.session_id and s.ord = h.ord"
# Spark's registered queries store these (``plans.queries``); hits of other callers get their snippets here
step("shown_hits", _SHOWN, operator=False)
step("q2_search_bm25", lambda d: "select query_id, session_id, ord, role, score, place, snippet from {shown_hits}" if d.name == "spark" else _SHOWN)
# the literal query has to occur in the content too
step("q3_search_exact", "select h.query_id, h.session_id, h.ord, h.role, h.score, row_number() over (partition by h.query_id order by h.place) as place, h.snippet from {q2_search_bm25} h join {search_queries} q on q.query_id = h.query_id join {s6_messages} m on m.session_id = h.session_id and m.ord = h.ord where contains(lower(m.content), lower(q.q))")
step("q4_search_like", "select session_id, ord from {s6_messages} where contains(lower(content), lower('$text')) order by session_id, ord limit 100", text="error")
# sessions of the conversations: what search looks at besides the messages
step("session_tools", "select distinct user_id as session_id, event_type as tool from {event_rows}", operator=False)
step(
    "chat_sessions",
    lambda d: f"""select m.session_id, '/p/' || {d.text('m.session_id % 7')} as project_dir, 'feat/CC-' || {d.text('m.session_id % 23')} as git_branch, case m.session_id % 3 when 0 then 'claude-sonnet-4-6' when 1 then 'claude-opus-4-7' else 'claude-haiku-4-5' end as model,
    m.first_user_msg, m.last_user_msg, k.problem as summary from (select session_id, min_by(content, ord) filter (where role = 'user') as first_user_msg, max_by(content, ord) filter (where role = 'user') as last_user_msg from {{s6_messages}} group by session_id) m left join {{knowledge}} k on k.session_id = m.session_id""",
    operator=False,
)
_FIELDS = (("path", "project_dir"), ("branch", "git_branch"), ("first_msg", "first_user_msg"), ("last_msg", "last_user_msg"), ("id", "id_text"), ("model", "model"), ("tool", "tool"), ("summary", "summary"))


def _metadata(d, q: str, of: str, where: str) -> str:
    """The first field of a session that holds ``q``, and what stands around it; tools are named."""
    field = " ".join(f"when contains(lower({c}), {q}) then '{name}'" for name, c in _FIELDS)
    text = " ".join(f"when '{name}' then {c}" for name, c in _FIELDS)
    at = d.position(q, "lower(body)")
    n = f"length({q})"
    start = f"greatest({at} - 30, 1)"
    snippet = f"case when field = 'tool' then 'tool: ' || body else case when {start} > 1 then '…' else '' end || substring(body, {start}, {at} - {start}) || '[' || substring(body, {at}, {n}) || ']' || substring(body, {at} + {n}, 30) || case when {at} + {n} + 29 < length(body) then '…' else '' end end"
    return f"select {of}, session_id, field, {snippet} as snippet from (select *, case field {text} end as body from (select *, case {field} end as field from {where})) where field is not null"


_SEARCHED = "(select s.*, {text} as id_text, t.tool from {{chat_sessions}} s left join (select session_id, min(tool) as tool from {{session_tools}} where {met} group by session_id) t on t.session_id = s.session_id)"
step("q5_search_metadata", lambda d: _metadata(d, "lower('$text')", "'$text' as q", _SEARCHED.replace("{{", "{").replace("}}", "}").replace("{text}", d.text("s.session_id")).replace("{met}", "contains(lower(tool), lower('$text'))")))
# a counted set of queries against all sessions
step("query_tools", "select q.query_id, t.session_id, min(t.tool) as tool from {session_tools} t join {search_queries} q on contains(lower(t.tool), lower(q.q)) group by q.query_id, t.session_id", operator=False)
step("query_sessions", lambda d: f"select q.query_id, lower(q.q) as q, s.*, {d.text('s.session_id')} as id_text, t.tool from {{chat_sessions}} s join {{search_queries}} q on length(q.q) > 0 left join {{query_tools}} t on t.query_id = q.query_id and t.session_id = s.session_id", operator=False)
# Spark asks each distinct lower-cased query (a needle) once. Its words are runs without blanks and line feeds, so each lies in one such run of
# what is searched: the runs that hold its rarest word lead to the sessions, and needles whose every word is frequent are looked for in all of them
step(
    "searched",
    lambda d: f"""select *, concat_ws(chr(10), {', '.join(f"lower({c})" for _, c in _FIELDS if c != 'tool')}, lower(array_join(tools, chr(10)))) as hay from (select s.*, {d.text("s.session_id")} as id_text, t.tools
    from {{chat_sessions}} s left join (select session_id, array_sort(collect_set(tool)) as tools from {{session_tools}} group by session_id) t on t.session_id = s.session_id)""",
    operator=False,
)
step("needles", "select distinct lower(q) as needle from {search_queries} where length(q) > 0", operator=False)
step("session_words", "select session_id, w from (select session_id, explode(array_distinct(split(hay, '[ \\n]'))) as w from {searched_rows}) where w <> ''", operator=False)
step("word_sessions", "select w, count(*) as n from {session_words} group by w", operator=False)
step("needle_parts", "select distinct explode(split(needle, ' ')) as part from {needles}", operator=False)
_LONGEST = 32  # words up to this length are looked up by all their substrings, longer ones are compared
step(
    "part_words",
    f"""select /*+ broadcast(p) */ p.part, s.w, s.n from (select w, n, explode(array_distinct(flatten(transform(sequence(1, length(w)), i -> transform(sequence(i, length(w)), j -> substring(w, i, j - i + 1)))))) as part from {{word_sessions}} where length(w) <= {_LONGEST}) s join {{needle_parts}} p on p.part = s.part
    union all select /*+ broadcast(p) */ p.part, s.w, s.n from (select w, n from {{word_sessions}} where length(w) > {_LONGEST}) s join {{needle_parts}} p on contains(s.w, p.part)""",
    operator=False,
)
step(
    "needle_keys",
    "select needle, key.part as part, key.n as n from (select n.needle, min(struct(c.n, n.part)) as key from (select needle, explode(split(needle, ' ')) as part from {needles}) n left join (select part, sum(n) as n from {part_word_rows} group by part) c on c.part = n.part group by n.needle having count(*) = count(c.n))",
    operator=False,
)
step("often_from", "select count(*) / 16 as least from {searched_rows}", operator=False)
step(
    "needle_hits",
    """select h.needle, h.session_id from (select distinct r.needle, s.session_id from (select /*+ broadcast(k) */ k.needle, p.w from {part_word_rows} p join (select needle, part from {needle_keys} cross join {often_from} where n < least) k on k.part = p.part) r join {session_words} s on s.w = r.w) h
    join {searched_rows} t on t.session_id <=> h.session_id where contains(t.hay, h.needle)
    union all select /*+ broadcast(k) */ k.needle, t.session_id from {searched_rows} t join (select needle from {needle_keys} cross join {often_from} where n >= least) k on contains(t.hay, k.needle)""",
    operator=False,
)
# a needle may be found in all sessions: their places are counted by ranges of ids
_RANGE = "coalesce(session_id div 1024, 0)"
step(
    "needle_places",
    f"""select h.needle, h.session_id, cast(b.before + h.k as int) as place from (select needle, session_id, {_RANGE} as r, row_number() over (partition by needle, {_RANGE} order by session_id) as k from {{needle_hit_rows}}) h
    join (select needle, r, sum(n) over (partition by needle order by r) - n as before from (select needle, {_RANGE} as r, count(*) as n from {{needle_hit_rows}} group by needle, {_RANGE})) b on b.needle = h.needle and b.r = h.r""",
    operator=False,
)
step("query_needles", "select query_id, lower(q) as needle from {search_queries} where length(q) > 0", operator=False)
_TOOL = "array_min(filter(s.tools, t -> contains(lower(t), {needle}))) as tool"
step("needle_details", lambda d: _metadata(d, "needle", "needle, place", f"(select p.needle, p.place, s.*, {_TOOL.format(needle='p.needle')} from {{needle_places}} p join {{searched_rows}} s on s.session_id <=> p.session_id)"), operator=False)
step("merged_details", lambda d: _metadata(d, "needle", "query_id", f"(select r.query_id, r.needle, s.*, {_TOOL.format(needle='r.needle')} from (select m.query_id, m.session_id as found, q.needle from {{merged_rows}} m join {{query_needles}} q on q.query_id = m.query_id where m.metadata_place is not null) r join {{searched_rows}} s on s.session_id <=> r.found)"), operator=False)
step("metadata_hits", lambda d: _metadata(d, "q", "query_id", "{query_sessions}"), operator=False)
step("w7_first_match", "select query_id, session_id, ord, role, snippet, more from (select query_id, session_id, ord, role, snippet, row_number() over (partition by query_id, session_id order by place) as k, count(*) over (partition by query_id, session_id) - 1 as more from {q3_search_exact}) where k = 1")
# metadata hits first, then those of the bodies: every one ($expand = 1), or the first of a session that has none, with the number of further ones
def _hybrid(d) -> str:
    if d.name == "spark":  # a needle's places are those of its queries
        return f"""select query_id, place, session_id, role || case when $expand = 0 and hits > 1 then ' (+' || {d.text('hits - 1')} || ')' else '' end as role, snippet from (
    select /*+ broadcast(q) */ q.query_id, m.place, m.session_id, m.field as role, m.snippet, coalesce(f.more + 1, 0) as hits from {{needle_details}} m join {{query_needles}} q on q.needle = m.needle left join {{w7_first_match}} f on f.query_id = q.query_id and f.session_id = m.session_id
    union all select b.query_id, cast(coalesce(c.n, 0) + row_number() over (partition by b.query_id order by b.place, b.session_id) as int), b.session_id, 'body:' || b.role, b.snippet, b.hits from (
    select h.query_id, h.place, h.session_id, h.role, h.snippet, f.more + 1 as hits, q.needle from {{q3_search_exact}} h join {{w7_first_match}} f on f.query_id = h.query_id and f.session_id = h.session_id join {{query_needles}} q on q.query_id = h.query_id left join {{needle_hit_rows}} m on m.needle = q.needle and m.session_id = h.session_id
    where $expand = 1 or (m.session_id is null and f.ord = h.ord)) b left join (select needle, count(*) as n from {{needle_hit_rows}} group by needle) c on c.needle = b.needle)"""
    return f"""select query_id, row_number() over (partition by query_id order by part, place, session_id) as place, session_id, role || case when $expand = 0 and hits > 1 then ' (+' || {d.text('hits - 1')} || ')' else '' end as role, snippet from (
    select m.query_id, 1 as part, 0 as place, m.session_id, m.field as role, m.snippet, coalesce(f.more + 1, 0) as hits from {{metadata_hits}} m left join {{w7_first_match}} f on f.query_id = m.query_id and f.session_id = m.session_id
    union all select h.query_id, 2, h.place, h.session_id, 'body:' || h.role, h.snippet, f.more + 1 from {{q3_search_exact}} h join {{w7_first_match}} f on f.query_id = h.query_id and f.session_id = h.session_id left join {{metadata_hits}} m on m.query_id = h.query_id and m.session_id = h.session_id
    where $expand = 1 or (m.session_id is null and f.ord = h.ord))"""


step(
    "q6_search_hybrid",
    _hybrid,
    expand=0,
)
#: Fixed value: what identifiers look like; a dot and letters up to the end of a word count too.
IDENTIFIER = r"[A-Z][a-z]+[A-Z]|_[a-z]|::|\.[a-z]+\(|\.[a-z]+([^0-9A-Za-z_]|$)|[A-Z]+-[0-9]"


def _kind(d, q: str) -> str:
    return f"case when {d.fields(q)} >= 6 then 'dense' when {d.matches(q, d.ascii_word(IDENTIFIER))} then 'bm25' else 'balanced' end"


_WEIGHTS = "case kind when 'bm25' then 1.5e0 when 'dense' then 0.5e0 else 1e0 end as bm25_weight, case kind when 'bm25' then 0.5e0 when 'dense' then 1.5e0 else 1e0 end as dense_weight"
step("q7_query_type", lambda d: f"select session_id, ord, kind, {_WEIGHTS} from (select session_id, ord, {_kind(d, 'content')} as kind from {{s6_messages}} where role = 'user')")
step("query_kinds", lambda d: f"select query_id, kind, {_WEIGHTS} from (select query_id, {_kind(d, 'q')} as kind from {{search_queries}})", operator=False)
step("vector_queries", "select distinct asker as session_id, embedding from {search_queries} q join {vectors} v on v.session_id = q.asker", operator=False)


def _near(d, most: int, least: str, queries: str, own: str, made: str) -> str:
    """Nearest vectors: Spark multiplies blocks (``operators.vectors``), the checking engine all pairs."""
    if d.name == "spark":
        return f"select query_id, session_id, sim, place from {{{made}}}"
    return f"""select query_id, session_id, sim, place from (select query_id, session_id, sim, row_number() over (partition by query_id order by sim desc, session_id) as place from (
    select q.session_id as query_id, v.session_id, round({d.dot("q.embedding", "v.embedding")} / nullif(sqrt({d.dot("q.embedding", "q.embedding")}) * sqrt({d.dot("v.embedding", "v.embedding")}), 0e0), 6) as sim
    from {{vectors}} v cross join {{{queries}}} q where {own}) where {least}) where place <= {most}"""


step("q12_similar_sessions", lambda d: _near(d, 10, "sim is not null", "vectors", "q.session_id <> v.session_id", "nearest_sessions"))
step("dense_hits", lambda d: _near(d, 50, "sim > 0", "vector_queries", "true", "nearest_to_queries"), operator=False)
step(
    "q13_similar_to_vector",
    lambda d: f"""select session_id, sim from (select v.session_id, round({d.dot("q.embedding", "v.embedding")} / nullif(sqrt({d.dot("q.embedding", "q.embedding")}) * sqrt({d.dot("v.embedding", "v.embedding")}), 0e0), 6) as sim
    from {{vectors}} v cross join (select embedding from {{vectors}} where session_id = $like_session) q) where sim > $least_sim order by sim desc, session_id limit $nearest""",
    like_session=0, least_sim=0, nearest=30,
)
step(
    "q14_retrieve_context",
    lambda d: f"""select q.session_id, q.sim, 'Problem: ' || coalesce(k.problem, '') || chr(10) || 'Solution: ' || coalesce(k.solution, '') || chr(10) || {" || ".join(f"case when {d.size('k.' + c)} > 0 then '- {name}: ' || {d.flat('k.' + c)} || chr(10) else '' end" for name, c in (("decided", "decisions"), ("patterns", "code_patterns"), ("tech", "tech_used"), ("open", "open_questions")))} as context
    from (select session_id, sim from {{q13_similar_to_vector}} where sim > 0 order by sim desc, session_id limit $contexts) q left join {{knowledge}} k on k.session_id = q.session_id""",
    contexts=8,
)
# rankings of three kinds; each query's kind decides their weights
_BODY_RANKS = """select query_id, 'bm25' as source, session_id, row_number() over (partition by query_id order by place) as place from (select query_id, session_id, min(place) as place from {q3_search_exact} group by query_id, session_id)
    union all select q.query_id, 'dense', d.session_id, d.place from {search_queries} q join {dense_hits} d on d.query_id = q.asker"""
step("body_ranks", _BODY_RANKS, operator=False)
# among sessions that only their metadata rank, the first ones go first for any weight of 0 or more: further ones are asked for where another ranking has them
step(
    "needed_ranks",
    """select query_id, source, session_id, place from {body_rank_rows} union all select query_id, 'metadata', session_id, place from (
    select /*+ broadcast(q) */ q.query_id, p.session_id, p.place from {needle_places} p join {query_needles} q on q.needle = p.needle where p.place <= $most_hits union
    select b.query_id, b.session_id, p.place from (select distinct r.query_id, q.needle, r.session_id from {body_rank_rows} r join {query_needles} q on q.query_id = r.query_id) b join {needle_places} p on p.needle = b.needle and p.session_id = b.session_id)""",
    operator=False,
)
step(
    "rankings",
    lambda d: "select * from {needed_ranks}" if d.name == "spark" else _BODY_RANKS + """
    union all select query_id, 'metadata', session_id, row_number() over (partition by query_id order by session_id) from {metadata_hits}""",
    operator=False,
)
step("weighted", "select r.query_id, r.source, r.session_id, r.place, case r.source when 'bm25' then k.bm25_weight when 'dense' then k.dense_weight else $metadata_weight end as weight from {rankings} r join {query_kinds} k on k.query_id = r.query_id", operator=False, metadata_weight=0.7)
_MERGED = "{joined} as sources, max(case when source = 'bm25' then place end) as bm25_place, max(case when source = 'dense' then place end) as dense_place, max(case when source = 'metadata' then place end) as metadata_place"
step("q8_rrf_merge", lambda d: f"select query_id, session_id, score, sources, bm25_place, dense_place, metadata_place, place from (select *, row_number() over (partition by query_id order by score desc, session_id) as place from (select query_id, session_id, round(sum(cast(weight as double) / (60 + place)), 9) as score, {_MERGED.replace('{joined}', d.joined('source', 'source', '+'))} from {{weighted}} group by query_id, session_id)) where place <= $most_hits", most_hits=50)
step("q9_search_rrf", lambda d: "select r.query_id, r.place, r.session_id, r.score, 'rrf:' || r.sources as role, coalesce(f.snippet, m.snippet) as snippet from {merged} r left join {w7_first_match} f on f.query_id = r.query_id and f.session_id = r.session_id left join {details} m on m.query_id = r.query_id and m.session_id = r.session_id".replace("{merged}", "{merged_rows}" if d.name == "spark" else "{q8_rrf_merge}").replace("{details}", "{merged_details}" if d.name == "spark" else "{metadata_hits}"))
step("q10_explain", "select r.query_id, k.kind, k.bm25_weight, k.dense_weight, r.place, r.session_id, r.bm25_place, r.dense_place, r.metadata_place from {q8_rrf_merge} r join {query_kinds} k on k.query_id = r.query_id")
step("q16_exemplars", lambda d: f"""select label, session_id, k from (select v.label, v.session_id, row_number() over (partition by v.label order by round({d.dot("v.embedding", "c.embedding")} / nullif(sqrt({d.dot("v.embedding", "v.embedding")}), 0e0), 6) desc, v.session_id) as k from {{vectors}} v join {{centres}} c on v.label = c.label) where k <= 5""")
step("centres", lambda d: d.mean_vector("{vectors}", "label"), operator=False)  # the mean of all members
step("q17_cluster_members", lambda d: f"select label, count(*) as members, {d.joined('session_id', 'session_id')} as ids from {{vectors}} where label >= 0 group by label")
step("q18_index_health", "select count(*) as documents, count(l.doc_id) as labelled from {documents} d left join {labels} l on d.doc_id = l.doc_id")

step("patterns", lambda d: f"select session_id, generated_at, trim(p) as p from (select session_id, generated_at, {d.unnest('code_patterns')} as p from {{knowledge}}) where trim(p) <> ''", operator=False)
step("technologies", lambda d: f"select session_id, generated_at, trim(p) as p from (select session_id, generated_at, {d.unnest('tech_used')} as p from {{knowledge}}) where trim(p) <> ''", operator=False)


def _frequency(of: str):
    """How often each spelling-insensitive item is noted, its newest spelling and the five newest sessions; counted by spelling and session first."""
    # a frequent item's sessions are cut down in parts before they meet
    step(f"{of}_counts", f"select lower(p) as norm, session_id, p, max(generated_at) as generated_at, count(*) as n from {{{of}}} group by lower(p), session_id, p", operator=False)
    step(f"{of}_newest", f"select norm, session_id, generated_at, row_number() over (partition by norm, session_id % 64 order by generated_at desc, session_id) as k from (select norm, session_id, max(generated_at) as generated_at from {{{of}_counts}} group by norm, session_id)", operator=False)
    step(f"{of}_sessions", lambda d: f"select norm, {d.joined(d.text('session_id'), 'k')} as newest from (select norm, session_id, row_number() over (partition by norm order by generated_at desc, session_id) as k from {{{of}_newest}} where k <= 5) where k <= 5 group by norm", operator=False)
    return lambda d: f"select c.pattern, c.n, c.sessions, s.newest from (select norm, max_by(p, {d.row('generated_at', '-session_id', 'p')}) as pattern, cast(sum(n) as bigint) as n, count(distinct session_id) as sessions from {{{of}_counts}} group by norm) c join {{{of}_sessions}} s on c.norm = s.norm"


step("k1_top_patterns", lambda d, f=_frequency("patterns"): f(d) + " order by n desc, pattern limit $patterns", patterns=20)
step("k1_tech_frequency", lambda d, f=_frequency("technologies"): f(d).replace("c.pattern,", "c.pattern as tech,") + " order by n desc, tech")
step("decisions", lambda d: f"select session_id, generated_at, {d.unnest('decisions')} as decision from {{knowledge}}", operator=False)
step("k2_decision_history", "select session_id, generated_at, decision from {decisions} where trim(decision) <> '' order by generated_at desc, session_id, decision limit $decisions", decisions=50)
step("questions", lambda d: f"select session_id, generated_at, {d.unnest('open_questions')} as question from {{knowledge}}", operator=False)
step("k4_open_questions", lambda d: f"select session_id, question, greatest(0, cast(floor(($as_of_s - generated_at) / 86400e0) as bigint)) as age_days from {{questions}} where trim(question) <> '' order by age_days desc, session_id, question limit $questions", as_of_s=1706832000, questions=30)
# clusters of problems: Spark's are made by ``operators.recurring``, the checking engine's by the greedy loop
step("recurring", lambda d: "select representative, n from {recurring_rows}" if d.name == "spark" else f"select representative, n from ({checks.RECURRING})", operator=False)
step("k5_knowledge_aggregate", lambda d: f"select 'pattern' as part, pattern as item, n from {{k1_top_patterns}} union all select 'decision', decision, session_id from {{k2_decision_history}} union all select 'question', question, age_days from {{k4_open_questions}} union all select 'problem', representative, n from {{recurring}} union all select 'sessions', '', count(*) from {{knowledge}}")
step("k6_knowledge_of", lambda d: f"select session_id, generated_at, problem, solution, {d.size('decisions')} as n_decisions, {d.size('open_questions')} as n_questions from {{knowledge}} where {'startswith' if d.name == 'spark' else 'starts_with'}({d.text('session_id')}, '$session') order by generated_at desc, session_id", session="")
# conversations have no times of their own: a user's first and last event stand for them
step("standup_rows", lambda d: f"select c.*, t.start_time, substring({cost.title(d, 'c.summary', 'c.first_user_msg')}, 1, 2000) as title from {{chat_sessions}} c join (select user_id as session_id, min(ts) as start_time from {{event_rows}} group by user_id) t on t.session_id = c.session_id", operator=False)
_CLIPPED = "case when length(title) > {n} then substring(title, 1, {n} - 1) || '…' else title end"
step("k7_standup_timeline", lambda d: f"select cast(start_time as date) as day, session_id, '- [' || {d.clock('start_time')} || '] ' || {_CLIPPED.format(n=80)} || ' [' || {d.text('session_id')} || ']' as line, row_number() over (partition by cast(start_time as date) order by start_time, session_id) as place from {{standup_rows}}")
step("project_costs", "select project_dir, round(sum(coalesce(cost_usd, 0e0)), 8) as project_usd from {p1_session_cost} group by project_dir", operator=False)
step("k8_standup_project", lambda d: f"select s.project_dir, count(*) over (partition by s.project_dir) as sessions, p.project_usd, s.session_id, row_number() over (partition by s.project_dir order by s.start_time, s.session_id) as place, '- ' || {_CLIPPED.format(n=90)} || ' [' || {d.text('s.session_id')} || ']' as line from {{standup_rows}} s join {{project_costs}} p on p.project_dir = s.project_dir")
step("k9_standup_editorial", "select 1 as section, session_id, coalesce(solution, problem) as line from {knowledge} where coalesce(solution, problem) is not null union all select 2, session_id, decision from {decisions} where trim(decision) <> '' union all select 3, session_id, question from {questions} where trim(question) <> ''")
# insights come from replies too: a page's kind is its host's last part
step("k10_insights", lambda d: f"select kind, session_id, generated_at, title from (select *, row_number() over (partition by kind order by generated_at desc, session_id) as k from (select {d.extract('p.url', '^https?://[^/:?#]*')} as host, k.session_id, k.generated_at, k.solution as title, {d.extract(d.extract('p.url', '^https?://[^/:?#]*'), '[a-z]+$')} as kind from {{knowledge}} k join {{pages}} p on p.page_id = k.session_id where k.solution <> '')) where k <= $insights", insights=20)
