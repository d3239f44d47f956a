import os

import duckdb
import pytest

from sparlog.plans import catalog, queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in queries.TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 5)
    return v.isoformat()[:19] if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", catalog.OPERATORS)
def test_equals_checking_engine(spark, duck, name):
    df = queries.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    rel = duck.sql(queries.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    want = sorted((tuple(plain(dict(zip(rel.columns, row, strict=True))[c]) for c in cols) for row in rel.fetchall()), key=repr)
    assert got == want


def test_price_of_a_session(spark):
    row = spark.createDataFrame([("s", "/p", None, "claude-sonnet-4-6", None, None, 1, 1, 0, 1_000_000, 100_000, 50_000, 500_000, 0)], "session_id string, project_dir string, git_branch string, model string, start_time timestamp, end_time timestamp, message_count long, user_messages long, assistant_messages long, input_tokens long, output_tokens long, cache_creation_tokens long, cache_read_tokens long, sidechain_agents long")
    prices = spark.createDataFrame([("claude-sonnet-4-6", 3.0, 15.0, 3.75, 0.30, 5.0)], "model string, input_rate double, output_rate double, cache_write_rate double, cache_read_rate double, brl_rate double")
    got = catalog.frame(spark, "p1_session_cost", {"sessions": row, "s19_load_pricing": prices}).first()
    assert round(got["cost_usd"], 6) == 4.8375 and round(got["cost_brl"], 6) == 24.1875
    none = catalog.frame(spark, "p1_session_cost", {"sessions": row, "s19_load_pricing": prices.where("model = 'x'")}).first()
    assert none["cost_usd"] is None


def test_arguments_of_operators(spark):
    tables = queries._Tables(spark, DATA)
    narrow = catalog.frame(spark, "r1_detect_loops", tables, min_count=2, window_s=60).count()
    wide = catalog.frame(spark, "r1_detect_loops", tables, min_count=2, window_s=10**7).count()
    assert narrow <= wide and wide > 0
    assert catalog.frame(spark, "r1_detect_loops", tables).count() == 0  # three calls within five minutes
    assert catalog.frame(spark, "q4_search_like", tables, text="it's {here}").count() == 0
    for wrong in ({"no_such": 1}, {"min_count": "1 or 1 = 1"}, {"min_count": None}):
        with pytest.raises(TypeError):
            catalog.frame(spark, "r1_detect_loops", tables, **wrong)
    later = catalog.frame(spark, "c16_project_history", tables, as_of="2024-02-10 00:00:00", history_days=3)
    assert {r["days_ago"] for r in later.collect()} == {0, 1, 2}


def test_replies_are_parsed_once(spark):
    """K5's steps read the knowledge of one table, and a reply's error is not asked for by another parse."""
    plan = queries.queries()["k5_knowledge_aggregate"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "parsejson" not in plan.lower()
    once = catalog.frame(spark, "knowledge", queries._Tables(spark, DATA))._jdf.queryExecution().optimizedPlan().toString()
    assert once.lower().count("parsejson") == 1 and once.count("Here is what I noted") == 1
