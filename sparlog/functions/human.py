"""Numbers and spans of time as people read them (F8)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _tenth(n: Column, unit: int, sign: str) -> Column:
    return F.concat(F.format_string("%.1f", n / float(unit)), F.lit(sign))


def humanize_tokens(n: Column) -> Column:
    """999, 1.5k, 2.0m, 3.1b."""
    return F.when(n >= 10**9, _tenth(n, 10**9, "b")).when(n >= 10**6, _tenth(n, 10**6, "m")).when(n >= 1000, _tenth(n, 1000, "k")).otherwise(n.cast("string"))


def humanize_duration(us: Column) -> Column:
    """Microseconds as 42s, 7m, 3h or 3h20m; parts that are not whole are cut."""
    s = F.floor(us / 1_000_000)
    h, m = F.floor(s / 3600), F.floor(s / 60) % 60
    hours = F.concat(h.cast("string"), F.lit("h"), F.when(m == 0, "").otherwise(F.concat(m.cast("string"), F.lit("m"))))
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m"))).otherwise(hours)


def humanize_count(n: Column) -> Column:
    """1,234,567."""
    return F.format_number(n, 0)
