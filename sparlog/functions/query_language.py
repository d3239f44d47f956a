"""The search line: ``project: branch: model: since: cost:`` filters, mode prefixes and the text that is left (P5)."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Mode prefixes, and microseconds of the units of a duration.
MODES = {":all": "hybrid", ":body": "fts", ":meta": "metadata", ":sim": "semantic"}
UNITS = {"ns": 0.001, "us": 1, "µs": 1, "μs": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000}
_DAY_US = 86_400_000_000
_PART = r"(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:ns|us|µs|μs|ms|s|m|h)"


@dataclass(frozen=True)
class Line:
    """A parsed search line; filters that it does not name are None."""

    text: str = ""
    mode: str = "hybrid"
    expand: bool | None = None
    project: str | None = None
    branch: str | None = None
    model: str | None = None
    since_us: int | None = None
    cost_min: float | None = None
    cost_max: float | None = None


def duration_us(text: str) -> int | None:
    """Microseconds of ``7d``, ``24h``, ``30m``, ``1h30m``, ``0``; None if it is no duration."""
    if text.endswith("d"):
        return int(text[:-1]) * _DAY_US if re.fullmatch(r"[+-]?[0-9]+", text[:-1]) else None
    if re.fullmatch(r"[+-]?0", text):
        return 0
    if not re.fullmatch(rf"[+-]?(?:{_PART})+", text):
        return None
    total = sum(float(n) * UNITS[u] for n, u in re.findall(r"([0-9.]+)(ns|us|µs|μs|ms|s|m|h)", text))
    return int(-total if text.startswith("-") else total)


def _number(text: str) -> float | None:
    return float(text) if re.fullmatch(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?", text) else None


def parse(line: str) -> Line:
    """Filters are words ``key:value``; keys are read in any case, of repeated ones the last counts, and words that are no good filters stay text."""
    line = line.strip()
    found: dict[str, object] = {}
    for prefix, mode in MODES.items():
        if line.startswith(prefix + " "):
            line, found["mode"] = line[len(prefix) :].strip(), mode
            if prefix == ":all":
                found["expand"] = True
            break
    rest = []
    for word in line.split():
        key, colon, value = word.partition(":")
        key = key.lower()
        if colon and key in ("project", "branch", "model"):
            found[key] = value.lower()
        elif colon and key == "since" and (us := duration_us(value)) is not None:
            found["since_us"] = us
        elif colon and key == "cost" and value[:1] in ("<", ">") and (n := _number(value[1:])) is not None:
            found["cost_min" if value[0] == ">" else "cost_max"] = n
        else:
            rest.append(word)
    return Line(text=" ".join(rest), **found)


def predicates(line: Line, as_of: datetime) -> list[Column]:
    """Conditions on sessions (project_dir, git_branch, model, start_time, cost_usd).

    Texts are looked for in any case; bounds are inclusive, negative ones are
    none; a session without a price costs 0; a span of 0 or less is no filter.
    """
    out = [F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(v)) for c, v in (("project_dir", line.project), ("git_branch", line.branch), ("model", line.model)) if v]
    if line.since_us and line.since_us > 0:
        out.append(F.unix_micros("start_time") >= F.unix_micros(F.lit(as_of)) - line.since_us)
    cost = F.coalesce("cost_usd", F.lit(0.0))
    if line.cost_min is not None and line.cost_min >= 0:
        out.append(cost >= line.cost_min)
    if line.cost_max is not None and line.cost_max >= 0:
        out.append(cost <= line.cost_max)
    return out


def search_filters(sessions: DataFrame, line: str | Line, as_of: datetime) -> DataFrame:
    """The sessions that pass a search line's filters, with the text that is left as ``residual`` (P5)."""
    parsed = parse(line) if isinstance(line, str) else line
    for p in predicates(parsed, as_of):
        sessions = sessions.where(p)
    return sessions.withColumn("residual", F.lit(parsed.text))


#: Fixed value: a session id, or six and more of its characters from the start.
ID_PREFIX = "(?i)^([0-9a-f]{6,8}|[0-9a-f]{8}-[0-9a-f]{0,4}|[0-9a-f]{8}(-[0-9a-f]{4}){1,2}-[0-9a-f]{0,4}|[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{0,12})$"


def resolve_session_ids(sessions: DataFrame, asked: DataFrame) -> DataFrame:
    """q, session_id: for each text ``q`` of ``asked`` that is an id or the beginning of one, the session it means.

    An equal id comes first, then the newest session whose id begins so, then
    the smaller id; case and outer blanks do not matter. Texts that are no
    beginning of an id, or of none that is there, have no row. Both sides meet
    on the first six characters.
    """
    q = asked.select("q", F.lower(F.trim("q")).alias("low")).where(F.col("low").rlike(ID_PREFIX)).distinct().withColumn("head", F.substring("low", 1, 6))
    ids = sessions.select("session_id", "start_time", F.lower("session_id").alias("id")).withColumn("head", F.substring("id", 1, 6))
    met = q.join(ids, "head").where(F.startswith("id", "low"))
    return met.groupBy("q").agg(F.min_by("session_id", F.struct(F.col("id") != F.col("low"), -F.unix_micros("start_time"), F.col("session_id"))).alias("session_id"))
