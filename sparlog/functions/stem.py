"""Porter's stemmer (M. F. Porter, An algorithm for suffix stripping, 1980, with the author's later rules) as column expressions, and accent folding.

A word passes through steps, each one expression over the step before. In them
a y that counts as a consonant is written Y.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

_C, _V = "[^aeiouy]", "[aeiouy]"
#: Stems of a measure (number of vowel and consonant runs) above 0 and above 1, and with a vowel.
_M0, _M1, _HAS_V = f"{_C}*{_V}+{_C}.*", f"{_C}*{_V}+{_C}+{_V}+{_C}.*", f".*{_V}.*"

#: Suffixes and what takes their place, where the stem's measure is above 0.
STEP2 = "ational ate,tional tion,enci ence,anci ance,izer ize,bli ble,alli al,entli ent,eli e,ousli ous,ization ize,ation ate,ator ate,alism al,iveness ive,fulness ful,ousness ous,aliti al,iviti ive,biliti ble,logi log"
STEP3 = "icate ic,ative ,alize al,iciti ic,ical ic,ful ,ness "
#: Suffixes that go where the measure is above 1.
STEP4 = "al,ance,ence,er,ic,able,ible,ant,ement,ment,ent,sion,tion,ou,ism,ate,iti,ous,ive,ize"
_DOUBLE = "|".join(2 * c for c in "bcdfghjkmnpqrtvwxY")


def _table(rules: list[tuple[str, str]], stem: str, end: Callable, change: Callable) -> str:
    """The longest suffix of ``rules`` that a word has goes, if its stem is of the kind."""
    cases = [f"when {end('w', s)} then {change('w', f'^({stem}){s}$', r)}" for s, r in sorted(rules, key=lambda x: (-len(x[0]), x[0]))]
    return f"case {' '.join(cases)} else w end"


def steps(d) -> list[str]:
    """Expressions over a column ``w``, to be applied one after another, in the spelling of dialect ``d``."""
    end = lambda c, s: f"{c} like '%{s}'"
    change = lambda c, pattern, new: d.changed(c, pattern, d.group1 + new)
    has = d.matches
    pairs = lambda text: [tuple(x.split(" ")) for x in text.split(",")]
    ed, ing = f"^({_HAS_V})ed$", f"^({_HAS_V})ing$"
    # a word that has just lost ed or ing ends with a mark, which the step after it takes away
    first = f"case when {end('w', 'eed')} then {change('w', f'^({_M0})eed$', 'ee')} when {has('w', ed)} then {change('w', ed, '#')} when {has('w', ing)} then {change('w', ing, '#')} else w end"
    mended = f"case when not {end('w', '#')} then w when {has('w', '(at|bl|iz)#$')} then {change('w', '^(.*)#$', 'e')} when {has('w', f'({_DOUBLE})#$')} then {change('w', '^(.*).#$', '')} when {has('w', f'^{_C}+{_V}[^aeiouywxY]#$')} then {change('w', '^(.*)#$', 'e')} else {change('w', '^(.*)#$', '')} end"
    last_e = f"case when {has('w', f'^{_M1}e$')} then {change('w', '^(.*)e$', '')} when {has('w', f'^{_C}*{_V}+{_C}+{_V}*e$')} and not {has('w', f'{_C}{_V}[^aeiouywxY]e$')} then {change('w', '^(.*)e$', '')} else w end"
    return [
        d.changed(d.changed("w", "^y", "Y"), "([aeiouy])y", d.group1 + "Y", every=True),
        f"case when {end('w', 'sses')} or {end('w', 'ies')} then {change('w', '^(.*)es$', '')} when {end('w', 's')} and not {end('w', 'ss')} then {change('w', '^(.*)s$', '')} else w end",
        first, mended, change("w", f"^({_HAS_V})[yY]$", "i"),
        _table(pairs(STEP2), _M0, end, change), _table(pairs(STEP3), _M0, end, change),
        _table([(s, s[:1] if s in ("sion", "tion") else "") for s in STEP4.split(",")], _M1, end, lambda c, p, r: change(c, f"^({_C}*{_V}+{_C}+{_V}+.*{r})ion$" if r else p, "")),
        last_e, change("w", f"^({_C}*{_V}+{_C}+{_V}.*l)l$", ""), "lower(w)",
    ]


def stemmed(d, column: str, source: str) -> str:
    """A SELECT of ``source`` with ``stem`` of its text ``column``: words of 3 to 64 characters are stemmed, others stay."""
    stem = column
    for expression in steps(d):
        stem = d.applied(stem, expression)  # each step names its word many times; the step before it is there once
    return f"select {column}, case when length({column}) between 3 and 64 then {stem} else {column} end as stem from {source}"


def folding() -> tuple[str, str]:
    """Letters with diacritics and the plain letters they go by, for ``translate``, from Unicode's decompositions."""
    plain = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]}
    plain = {c: p for c, p in plain.items() if p != c and c.islower() and p.isascii() and p.isalpha()}
    return "".join(plain), "".join(plain.values())
