"""Search by a search line over sessions and their messages."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import query_language
from ..plans import catalog, queries
from . import vectors


def search(spark: SparkSession, tables: Mapping[str, DataFrame], sessions: DataFrame, line: str, as_of: datetime, expand: bool = False, vector: list[float] | None = None) -> DataFrame:
    """session_id, place, role, snippet of what a search line finds.

    ``sessions``: what the catalogue's ``chat_sessions`` has, with start_time
    and cost_usd; its filters come first. A line of filters alone gives all
    sessions that pass. ``:body`` looks into messages (the first hit of each
    session), ``:meta`` at the sessions, ``:sim`` at ``vector`` (30 nearest),
    and a line without prefix, or with ``:all``, at both of the first two.
    """
    parsed = query_language.parse(line)
    passed = query_language.search_filters(sessions, parsed, as_of).drop("residual")
    if not parsed.text:
        return passed.select("session_id", F.lit(None).cast("long").alias("place"), F.lit("").alias("role"), F.lit("").alias("snippet"))
    if parsed.mode == "semantic":
        if vector is None:
            raise ValueError(":sim needs a vector")
        every = catalog.frame(spark, "vectors", tables).join(passed.select("session_id"), "session_id", "left_semi")
        asked = spark.createDataFrame([(-1, [float(x) for x in vector])], "session_id long, embedding array<double>")
        return vectors.nearest(asked, every, 30).select("session_id", F.col("place").cast("long").alias("place"), F.lit("similar").alias("role"), F.format_string("similarity: %.2f", "sim").alias("snippet"))
    one = spark.createDataFrame([("line", None, parsed.text)], "query_id string, asker long, q string")
    chosen = queries.Asked(spark, tables, {"search_queries": one, "chat_sessions": passed})
    step = {"fts": "w7_first_match", "metadata": "metadata_hits", "hybrid": "q6_search_hybrid"}[parsed.mode]
    found = catalog.frame(spark, step, chosen, expand=int(expand if parsed.expand is None else parsed.expand))
    if parsed.mode == "metadata":
        found = found.select("session_id", F.lit(None).cast("long").alias("place"), F.col("field").alias("role"), "snippet")
    elif parsed.mode == "fts":
        found = found.select("session_id", F.col("ord").alias("place"), "role", "snippet")
    return found.join(passed.select("session_id"), "session_id", "left_semi").select("session_id", F.col("place").cast("long").alias("place"), "role", "snippet")
