"""Knowledge rows from model replies, and replies rendered from web pages for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import logs

REPLY = "problem string, solution string, decisions array<struct<decision: string, rationale: string>>, learnings array<string>, code_patterns array<string>, tech_used array<string>, open_questions array<string>"


def knowledge_from_replies(replies: DataFrame) -> DataFrame:
    """session_id, generated_at, problem, solution, decisions, learnings, code_patterns, tech_used, open_questions of replies (session_id, generated_at, raw).

    A reply may wrap its JSON in fences and talk; replies that are not JSON
    give no row, missing lists are empty, and decisions keep their texts.
    """
    rows = logs.parse_model_json(replies.select(F.struct("session_id", "generated_at").alias("id"), "raw"), REPLY).where("error is null")
    empty = F.array().cast("array<string>")
    lists = [F.coalesce(c, empty).alias(c) for c in ("learnings", "code_patterns", "tech_used", "open_questions")]
    return rows.select("id.session_id", "id.generated_at", "problem", "solution", F.coalesce(F.transform("decisions", lambda d: d["decision"]), empty).alias("decisions"), *lists)


#: What a model would note of a page: its title, headline, navigation, bold beginnings, advertisements and footer, and its short paragraphs.
TITLE, HEADLINE, LINK, BOLD, ASIDE, SHORT = r"<title>([^<]*)</title>", r"<h1>([^<]*)</h1>", r"<li><a href=\"[^\"]*\">([^<]*)</a>", r"<p><b>([^<]*)<", r"(?:class=\"ad\">|&middot; )([^<]*)</", r"<p>([^<]{1,60})</p>"


def replies_from_pages(pages: DataFrame) -> DataFrame:
    """session_id, generated_at, raw: each page (page_id, html) told as a fenced reply."""
    every = lambda pattern: F.regexp_extract_all("html", F.lit(pattern), F.lit(1))
    told = F.struct(
        F.regexp_extract("html", TITLE, 1).alias("problem"), F.regexp_extract("html", HEADLINE, 1).alias("solution"),
        F.transform(every(BOLD), lambda x: F.struct(x.alias("decision"), F.lit("as the page says").alias("rationale"))).alias("decisions"),
        every(ASIDE).alias("code_patterns"), every(LINK).alias("tech_used"), every(SHORT).alias("open_questions"),
    )
    raw = F.concat(F.lit("Here is what I noted:\n```json\n"), F.to_json(told), F.lit("\n```\nAnything else?"))
    return pages.select(F.col("page_id").alias("session_id"), F.expr("1704067200 + page_id % 30 * 86400 + page_id % 7 * 3600").alias("generated_at"), raw.alias("raw"))
