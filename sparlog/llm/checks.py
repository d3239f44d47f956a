"""Checking SQL (DuckDB) of the operators whose results SQL can express."""

from __future__ import annotations

_CRC_TABLE = "crc_table as (select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, (c & 1) * 3988292384)) order by i) as steps from (select unnest(range(256)) as i))"


def _crc32(text: str) -> str:
    """The unsigned CRC of a text's UTF-8 bytes, with ``steps`` of crc_table at hand."""
    digits = f"hex(encode({text}))"
    octets = f"list_transform(range(1, length({digits}) + 1, 2), lambda i: cast('0x' || substr({digits}, cast(i as integer), 2) as bigint))"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295)"


BURST_TRIE = f"""
with {_CRC_TABLE},
rows_ as (select cast(conv_id as bigint) as c, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, role, text) as pos from conversations where conv_id is not null),
convs as (select c, max(pos) as len, c - c % 20 as base from rows_ group by c),
held as (select c, len, base, {_crc32("cast(c as varchar)")} % 4 as h from convs, crc_table),
taken as (select x.c, x.base, x.h, least(x.h, coalesce(b.len, 0)) as taken from held x left join convs b on b.c = x.base),
built as (select t.c, r.pos as pos, r.role, r.text from taken t join rows_ r on r.c = t.base and r.pos <= t.taken
    union all select t.c, r.pos - t.h + t.taken, r.role, r.text from taken t join rows_ r on r.c = t.c and r.pos > t.h),
coded as (select c, pos, md5(length(role) || ':' || role || text) as code, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) as words from built),
prefixes as (select c, pos as depth, words, string_agg(code, '') over (partition by c order by pos) as prefix, max(pos) over (partition by c) as len from coded
    union all select t.c, 0, 0, '', coalesce(m.len, 0) from taken t left join (select c, max(pos) as len from coded group by c) m on m.c = t.c),
nodes as (select prefix, depth, min(c) as conv_id, count(*) as n_convs, any_value(words) as words, coalesce(string_agg(cast(c as varchar), ',' order by c) filter (where len = depth), '') as ends from prefixes group by prefix, depth),
linked as (select n.*, p.conv_id as parent_conv_id, (select count(*) from nodes k where k.depth = n.depth + 1 and left(k.prefix, 32 * n.depth) = n.prefix) as n_children from nodes n left join nodes p on p.depth = n.depth - 1 and p.prefix = left(n.prefix, 32 * p.depth)),
under as (select left(k.prefix, 32 * d) as prefix, d as depth, count(*) filter (where k.n_children = 0) as n_leaves, sum((k.n_convs - 1) * case when k.depth = 0 then 0 else k.words end) as saved
    from (select *, unnest(range(depth + 1)) as d from linked) k group by all)
select n.conv_id, cast(n.depth as bigint) as depth, n.parent_conv_id, n.n_convs, n.n_children, u.n_leaves, cast(u.saved as bigint) as saved_tokens, sha256(n.ends) as ends_sha256
from linked n join under u on u.prefix = n.prefix and u.depth = n.depth
"""

_MARK = r"([<\[])(\\*)(s>|/s>|ROLE\]|/ROLE\]|END\]|AND\]|INST\]|/INST\]|OUT\]|SYS\]|/SYS\]|\|im_start\|>|\|im_end\|>|\|endoftext\|>|pad>|unk>)"

CHAT_FORMATTING = f"""
with rows_ as (select cast(conv_id as bigint) as conv_id, cast(turn as bigint) as turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
turns as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as k, lag(role) over (partition by conv_id order by turn nulls first, role, text) as last,
    lead(role) over (partition by conv_id order by turn nulls first, role, text) as next, regexp_replace(text, '{_MARK}', '\\1\\2\\\\\\3', 'g') as escaped, regexp_replace(role, '{_MARK}', '\\1\\2\\\\\\3', 'g') as role_escaped from rows_),
sized as (select *, length(escaped) + case when last is not distinct from role and k > 1 then 5 when role = 'user' then 6 when role = 'assistant' then 5 else 13 + length(role_escaped) end
    + case when next is not distinct from role then 0 when role = 'user' then 7 when role = 'assistant' then 4 else 5 end as chars from turns)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256, cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
    sha256(coalesce(string_agg(text, '' order by k) filter (where role = 'assistant'), '')) as loss_sha256, cast(3 + sum(chars) as bigint) as formatted_chars from sized group by conv_id
"""

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_GRAMS = "unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as gram"

RESAMPLING = f"""
with {_CRC_TABLE},
words as (select cast(doc_id as bigint) as doc_id, {_WORDS} as w from documents),
grams as (select doc_id, gram, count(*) as n from (select doc_id, {_GRAMS} from words) group by all),
aims as (select gram, count(*) as n from (select {_GRAMS} from (select {_WORDS} as w from benchmark)) group by all),
coded as (select gram, {_crc32("gram")} % 10000 as bucket from (select gram from grams union select gram from aims), crc_table),
s as (select bucket, sum(n) as n from grams join coded using (gram) group by bucket),
t as (select bucket, sum(n) as n from aims join coded using (gram) group by bucket),
gains as (select coalesce(s.bucket, t.bucket) as bucket, cast(floor(1000 * ln((coalesce(cast(t.n as double), 0) + 1) * ((select cast(coalesce(sum(n), 0) as double) from s) + 10000) / ((coalesce(cast(s.n as double), 0) + 1) * ((select cast(coalesce(sum(n), 0) as double) from t) + 10000)))) as bigint) as gain from s full join t on s.bucket = t.bucket),
summed as (select g.doc_id, cast(sum(g.n) as bigint) as n_features, cast(sum(g.n * x.gain) as bigint) as total from grams g join coded using (gram) join gains x using (bucket) group by g.doc_id),
weighed as (select d.doc_id, len(d.w) as words, coalesce(n_features, 0) as n_features, coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) as weight, cast('0x' || substr(sha256('7:' || coalesce(cast(d.doc_id as varchar), '')), 1, 8) as bigint) as h from words d left join summed x on x.doc_id = d.doc_id),
scored as (select *, weight + cast(floor(-1000 * ln(-ln((h + 0.5e0) / 4294967296e0))) as bigint) as score from weighed),
ranked as (select doc_id, row_number() over (order by score desc, doc_id nulls first) as place, count(*) over () as n from scored where words >= 20)
select x.doc_id, x.n_features, x.weight, x.score, r.place as rank from scored x left join ranked r on r.doc_id = x.doc_id and r.place <= 25 * r.n // 100
"""

SQL = {"op11_burst_trie": BURST_TRIE, "op12_chat_formatting": CHAT_FORMATTING, "op13_importance_resampling": RESAMPLING}
