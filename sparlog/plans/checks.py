"""Checking SQL that more than one query uses."""

from __future__ import annotations

from ..operators.recurring import PROBLEM_STOPWORDS

_STOP = ", ".join(f"'{w}'" for w in PROBLEM_STOPWORDS)
PROBLEMS = rf"""problems as (select session_id, problem, words, row_number() over (order by said desc, session_id) as rank from (select page_id as session_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as problem, 1704067200 + page_id % 30 * 86400 + page_id % 7 * 3600 as said,
    list_sort(list_distinct(list_filter(regexp_split_to_array(lower(problem), '[^a-z0-9_-]+'), lambda w: length(w) >= 4 and not list_contains([{_STOP}], w)))) as words from pages) where problem <> '' and len(words) > 0)"""
BOTH = "len(list_intersect({a}, {b}))"
_ALIKE = "5 * {both} >= 2 * (len({a}) + len({b}) - {both})"


def alike(a: str, b: str) -> str:
    return _ALIKE.replace("{both}", BOTH).replace("{a}", a).replace("{b}", b)


#: The greedy loop itself: one problem after another against the first members so far.
RECURRING = f"""with recursive {PROBLEMS}, sets as (select list(words order by rank) as words, count(*) as n from problems),
pass(i, leaders, mine) as (select 0, cast([] as bigint[]), cast(0 as bigint) union all
    select i + 1, case when hit is null then list_append(leaders, cast(i + 1 as bigint)) else leaders end, coalesce(hit, i + 1) from (select p.i, p.leaders, list_filter(p.leaders, lambda l: {alike("s.words[l]", "s.words[p.i + 1]")})[1] as hit from pass p, sets s where p.i < s.n)),
found as (select p.*, x.mine as leader from pass x join problems p on p.rank = x.i),
clusters as (select leader, count(*) as n, arg_min(problem, row(-octet_length(encode(problem)), rank)) as representative from found group by leader having count(*) >= 2),
words as (select leader, word, count(*) as m from (select leader, unnest(words) as word from found) group by all having count(*) >= 2),
top as (select leader, string_agg(word, ',' order by m desc, word) as keywords from (select *, row_number() over (partition by leader order by m desc, word) as k from words) where k <= 5 group by leader),
told as (select leader, string_agg(cast(session_id as varchar), ',' order by rank) as sessions from (select *, row_number() over (partition by leader order by rank) as k from found) where k <= 10 group by leader)
select c.representative, c.n, coalesce(t.keywords, '') as keywords, s.sessions from clusters c left join top t on t.leader = c.leader join told s on s.leader = c.leader"""
