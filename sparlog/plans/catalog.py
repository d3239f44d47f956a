"""A catalogue of named relational steps.

An operator is a SELECT over other steps or over input tables, named in braces.
``frame`` composes the steps of an operator into one DataFrame, so that Catalyst
sees a single plan; ``sql`` writes the same composition as one WITH statement
for another engine, which is how results are checked.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession


class Spark:
    """Fragments whose spelling differs between engines, as Spark writes them."""

    name = "spark"

    row = staticmethod(lambda *c: f"struct({', '.join(c)})")
    us = staticmethod(lambda a, b: f"timestampdiff(MICROSECOND, {a}, {b})")
    days = staticmethod(lambda a, b: f"datediff({b}, {a})")
    weekday = staticmethod(lambda t: f"weekday({t})")  # Monday is 0
    plus_days = staticmethod(lambda d, n: f"date_add({d}, {n})")
    series = staticmethod(lambda a, b: f"explode(sequence({a}, {b}))")
    ints = staticmethod(lambda a, b: f"explode(sequence({a}, {b}))")
    bool_sum = staticmethod(lambda c: f"count_if({c})")
    unnest = staticmethod(lambda a: f"explode({a})")
    matches = staticmethod(lambda s, r: f"({s} rlike '{r}')")
    extract = staticmethod(lambda s, r: f"regexp_extract({s}, '{r}', 0)")
    words = staticmethod(lambda s: f"regexp_extract_all({s}, '(?<![0-9A-Za-z_])[A-Za-z]+(?![0-9A-Za-z_])', 0)")
    joined = staticmethod(lambda x, order, by=",": f"array_join(transform(array_sort(collect_list(struct({order} as o, {x} as x))), s -> s.x), '{by}')")
    text = staticmethod(lambda x: f"cast({x} as string)")
    list = staticmethod(lambda x, order, where: f"transform(array_sort(collect_list(struct({order} as o, {x} as x)) filter (where {where})), s -> s.x)")
    table = staticmethod(lambda names, rows: "inline(array(" + ", ".join(f"struct({', '.join(r)})" for r in rows) + f")) as ({', '.join(names)})")
    ascii_word = staticmethod(lambda r: r.replace("\\", "\\\\"))
    lines = staticmethod(lambda x, order: Spark.joined(x, order, "\\n"))
    count_matches = staticmethod(lambda s, r: f"regexp_count({s}, '{r}')")
    mean_vector = staticmethod(lambda pairs, by: f"select {by}, transform(array_sort(collect_list(struct(i, m))), x -> x.m) as embedding from (select {by}, i, avg(cast(x as double)) as m from (select {by}, posexplode(embedding) as (i, x) from {pairs}) group by {by}, i) group by {by}")
    joined_set = staticmethod(lambda x: f"array_join(array_sort(collect_set({x})), ',')")
    log2 = staticmethod(lambda x: f"log2({x})")
    day_text = staticmethod(lambda d: f"cast({d} as string)")
    last_day = staticmethod(lambda d: f"last_day({d})")
    position = staticmethod(lambda needle, s: f"locate({needle}, {s})")
    size = staticmethod(lambda a: f"size({a})")
    item = staticmethod(lambda a, k: f"{a}[{k} - 1]")
    floor_div = staticmethod(lambda a, b: f"({a} div {b})")
    group1 = "$1"
    clock = staticmethod(lambda t: f"date_format({t}, 'HH:mm')")
    flat = staticmethod(lambda a: f"array_join({a}, '; ')")
    applied = staticmethod(lambda x, body: f"element_at(transform(array({x}), w -> {body}), 1)")
    changed = staticmethod(lambda s, r, new, every=False: f"regexp_replace({s}, '{r}', '{new}')")
    raw_tokens = staticmethod(lambda s: f"posexplode(regexp_extract_all({s}, '[\\\\pL\\\\pN]+', 0)) as (pos, raw)")
    distinct_over = staticmethod(lambda x, window: f"size(array_distinct(collect_list({x}) over ({window})))")
    first_words = staticmethod(lambda s, n: f"array_join(slice(regexp_extract_all({s}, '[^ \\\\n]+', 0), 1, cast({n} as int)), ' ')")
    fields = staticmethod(lambda s: f"size(regexp_extract_all({s}, '[^ \\\\t\\\\n\\\\r]+', 0))")
    dot = staticmethod(lambda a, b: f"aggregate(zip_with({a}, {b}, (p, q) -> cast(p as double) * cast(q as double)), cast(0 as double), (s, v) -> s + v)")


class Duck(Spark):
    """The same for the checking engine."""

    name = "duckdb"

    row = staticmethod(lambda *c: f"row({', '.join(c)})")
    us = staticmethod(lambda a, b: f"date_diff('microsecond', {a}, {b})")
    days = staticmethod(lambda a, b: f"date_diff('day', {a}, {b})")
    weekday = staticmethod(lambda t: f"cast(isodow({t}) - 1 as integer)")
    plus_days = staticmethod(lambda d, n: f"cast({d} + to_days(cast({n} as integer)) as date)")
    series = staticmethod(lambda a, b: f"cast(unnest(generate_series(cast({a} as timestamp), cast({b} as timestamp), interval 1 day)) as date)")
    ints = staticmethod(lambda a, b: f"cast(unnest(generate_series({a}, {b})) as integer)")
    bool_sum = staticmethod(lambda c: f"count(*) filter (where {c})")
    unnest = staticmethod(lambda a: f"unnest({a})")
    matches = staticmethod(lambda s, r: f"regexp_matches({s}, '{r}')")
    extract = staticmethod(lambda s, r: f"regexp_extract({s}, '{r}', 0)")
    words = staticmethod(lambda s: f"regexp_extract_all({s}, '\\b[A-Za-z]+\\b', 0)")
    joined = staticmethod(lambda x, order, by=",": f"array_to_string(list({x} order by {order}, {x}), '{by}')")
    text = staticmethod(lambda x: f"cast({x} as varchar)")
    list = staticmethod(lambda x, order, where: f"coalesce(list({x} order by {order}, {x}) filter (where {where}), [])")
    table = staticmethod(lambda names, rows: "unnest([" + ", ".join("{" + ", ".join(f"'{n}': {v}" for n, v in zip(names, r, strict=True)) + "}" for r in rows) + "], recursive := true)")
    ascii_word = staticmethod(lambda r: r)
    lines = staticmethod(lambda x, order: f"array_to_string(list({x} order by {order}, {x}), chr(10))")
    count_matches = staticmethod(lambda s, r: f"len(regexp_extract_all({s}, '{r}'))")
    mean_vector = staticmethod(lambda pairs, by: f"select {by}, list(m order by i) as embedding from (select {by}, i, avg(cast(x as double)) as m from (select {by}, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from {pairs}) group by {by}, i) group by {by}")
    joined_set = staticmethod(lambda x: f"array_to_string(list_sort(list(distinct {x})), ',')")
    last_day = staticmethod(lambda d: f"last_day({d})")
    position = staticmethod(lambda needle, s: f"position({needle} in {s})")
    size = staticmethod(lambda a: f"len({a})")
    item = staticmethod(lambda a, k: f"{a}[{k}]")
    floor_div = staticmethod(lambda a, b: f"({a} // {b})")
    day_text = staticmethod(lambda d: f"cast({d} as varchar)")
    group1 = "\\1"
    clock = staticmethod(lambda t: f"strftime({t}, '%H:%M')")
    flat = staticmethod(lambda a: f"array_to_string({a}, '; ')")
    applied = staticmethod(lambda x, body: f"list_transform([{x}], lambda w: {body})[1]")
    changed = staticmethod(lambda s, r, new, every=False: f"regexp_replace({s}, '{r}', '{new}'{', \'g\'' if every else ''})")
    raw_tokens = staticmethod(lambda s: f"unnest(regexp_extract_all({s}, '[\\pL\\pN]+')) as raw, generate_subscripts(regexp_extract_all({s}, '[\\pL\\pN]+'), 1) - 1 as pos")
    distinct_over = staticmethod(lambda x, window: f"len(list_distinct(list({x}) over ({window})))")
    first_words = staticmethod(lambda s, n: f"array_to_string(regexp_extract_all({s}, '[^ \\n]+')[1:{n}], ' ')")
    fields = staticmethod(lambda s: f"len(regexp_extract_all({s}, '[^ \\t\\n\\r]+'))")
    dot = staticmethod(lambda a, b: f"list_dot_product(cast({a} as double[]), cast({b} as double[]))")


Step = Callable[[type[Spark]], str]
STEPS: dict[str, Step] = {}
#: Parameters, named in a step's text with a dollar sign, and their defaults.
DEFAULTS: dict[str, object] = {}
#: What steps are where an input table that they need is not given.
ABSENT: dict[str, str] = {}
#: Names of the steps that are operators of their own.
OPERATORS: list[str] = []


def step(name: str, text: Step | str, /, operator: bool = True, absent: str | None = None, **defaults: object) -> None:
    """Add a step; ``defaults`` are parameters that its text names. Text parameters stand between quotes there. ``absent``: its text where ``frame`` has no input for it."""
    DEFAULTS.update(defaults)
    if absent is not None:
        ABSENT[name] = absent
    STEPS[name] = (lambda d, t=text: t) if isinstance(text, str) else text
    if operator:
        OPERATORS.append(name)


def needs(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", text)))


def _argument(name: str, arguments: Mapping[str, object]) -> object:
    v = arguments.get(name, DEFAULTS[name])
    if not isinstance(v, (int, float, str)) or isinstance(v, bool):
        raise TypeError(f"{name}: a number or a text, not {v!r}")
    if isinstance(v, str) and isinstance(DEFAULTS[name], (int, float)):
        raise TypeError(f"{name}: a number, not {v!r}")
    return v


def _text(text: str, arguments: Mapping[str, object], bound: dict[str, object] | None) -> str:
    """A step's text with the arguments in place of its parameters.

    Text arguments become parameters of the statement where ``bound`` collects
    them, and literals with doubled quotes elsewhere; times are literals.
    """

    def quoted(m: re.Match) -> str:
        v = str(_argument(m[2], arguments))
        if m[1]:
            return f"{m[1]}'{datetime.fromisoformat(v).isoformat(' ')}'"
        if bound is None:
            return "'" + v.replace("'", "''") + "'"
        bound[m[2]] = v
        return f":{m[2]}"

    text = re.sub(r"(timestamp )?'\$([a-z]\w*)'", quoted, text)
    return re.sub(r"\$([a-z]\w*)", lambda m: str(_argument(m[1], arguments)) if m[1] in DEFAULTS else m[0], text)


def _given(name: str, tables: Mapping[str, DataFrame]) -> bool:
    return name in tables or name in STEPS and all(_given(n, tables) for n in needs(STEPS[name](Spark)))


def frame(spark: SparkSession, name: str, tables: Mapping[str, DataFrame], made: dict[str, DataFrame] | None = None, **arguments: object) -> DataFrame:
    """The DataFrame of a step; ``tables`` holds input tables, or any step that is to be replaced by a given DataFrame.

    ``arguments`` replace defaults of the parameters that the step, or a step
    below it, names; an unknown one is an error.
    """
    if unknown := arguments.keys() - DEFAULTS.keys():
        raise TypeError(f"no such parameters: {sorted(unknown)}")
    made = {} if made is None else made
    if name in tables:
        return tables[name]
    if name not in made:
        bound: dict[str, object] = {}
        text = _text(ABSENT[name] if name in ABSENT and not _given(name, tables) else STEPS[name](Spark), arguments, bound)
        made[name] = spark.sql(text, bound or None, **{n: frame(spark, n, tables, made, **arguments) for n in needs(text)})
    return made[name]


def sql(name: str, **arguments: object) -> str:
    """One statement for the checking engine, over its tables."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in STEPS and n not in order:
            for m in needs(STEPS[n](Duck)):
                visit(m)
            order.append(n)

    visit(name)
    body = lambda n: re.sub(r"\{(\w+)\}", lambda m: m[1] + "_" if m[1] in STEPS else m[1], STEPS[n](Duck))
    parts = [f"{n}_ as ({_text(body(n), arguments, None)})" for n in order]
    return f"with {', '.join(parts)} select * from {name}_"
