import os

import duckdb
import pytest

from sparlog.plans import feature_queries, log_queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", log_queries.queries())
def test_equals_checking_engine(spark, name):
    df = log_queries.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    assert got
    if name in log_queries.oracle_sql():
        con = duckdb.connect()
        for t in ("conversations", "events"):
            con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
        rel = con.sql(log_queries.oracle_sql()[name])
        assert sorted(rel.columns) == cols
        assert got == sorted((tuple(dict(zip(rel.columns, row, strict=True))[c] for c in cols) for row in rel.fetchall()), key=repr)


def test_lines_are_made_and_parsed_once(spark):
    """However many columns and filters ask for them."""
    for query in (log_queries.s9_tool_events_from_events, feature_queries.s11_input_preview):
        plan = query(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.lower().count("parsejson") == 1
