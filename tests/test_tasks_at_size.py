"""What one task holds does not grow with the input."""

from sparlog.plans import catalog, queries

DATA = "/root/testdata/sf0.001"


def test_lines_are_dealt_by_their_number(spark, monkeypatch):
    want = [tuple(r) for r in queries.queries()["r2_file_reuse"](spark, DATA).collect()]
    monkeypatch.setattr(queries, "LINES_A_TASK", 100)
    tables = queries._Tables(spark, DATA)
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    assert catalog.frame(spark, "dealt_lines", tables).rdd.getNumPartitions() == 1 + lines // 100
    got = [tuple(r) for r in catalog.frame(spark, "r2_file_reuse", tables).collect()]
    assert got == want and len(got) == 20


def test_technologies_of_tool_calls_count(spark):
    tables = {"s6_messages": spark.createDataFrame([("s", 0, "user", "python and docker")], "session_id string, ord long, role string, content string"), "tool_events": spark.createDataFrame([("s", "Bash", "kubectl get pods"), ("s", "Read", "a.sqlite"), ("s", "Bash", None)], "session_id string, tool_name string, input_preview string")}
    got = {r["tech"]: r["matches"] for r in catalog.frame(spark, "b12_detect_tech", tables).collect()}
    assert got == {"Python": 1, "Docker": 1, "Kubernetes": 1, "SQLite": 1}


def test_technologies_of_calls_without_a_name_or_an_input_count(spark):
    said = spark.createDataFrame([("s", 0, "user", "docker")], "session_id string, ord long, role string, content string")
    calls = spark.createDataFrame([("s", "git", None), ("s", None, "kubectl get pods"), ("s", None, None)], "session_id string, tool_name string, input_preview string")
    count = lambda tables: {r["tech"]: r["matches"] for r in catalog.frame(spark, "b12_detect_tech", tables).collect()}
    assert count({"s6_messages": said, "tool_events": calls}) == {"Docker": 1, "Git": 1, "Kubernetes": 1}
    assert count({"s6_messages": said}) == {"Docker": 1}


def test_nearest_multiplies_only_what_may_be_near_in_double_precision(spark):
    import numpy as np

    from sparlog.operators import vectors

    r = np.random.default_rng(5)
    v = r.normal(size=(1200, 8))
    v[600:] = v[:600] * r.uniform(1, 3, size=(600, 1))  # ties: directions that occur twice
    ids = r.permutation(1200)
    unit = v / np.sqrt((v * v).sum(1))[:, None]
    sims = np.round(unit @ unit.T, 6) + 0.0
    for i in range(3):
        order = sorted((j for j in range(1200) if j != i), key=lambda j: (-sims[i, j], ids[j]))[:5]
        by_id = np.argsort(ids)
        got = vectors._best(ids[i : i + 1], unit[i : i + 1], ids[by_id], unit[by_id], unit[by_id].astype(np.float32), 5, None, False)
        assert list(got[1]) == [ids[j] for j in order]
        assert len(vectors._best(ids[i : i + 1], unit[i : i + 1], ids[by_id], unit[by_id], unit[by_id].astype(np.float32), 5, 2.0, True)[0]) == 0
    table = spark.createDataFrame([(int(k), [float(x) for x in row]) for k, row in zip(ids, v)], "session_id long, embedding array<float>")
    assert vectors.nearest(table, table, 5, rows=32).count() == 6000


def test_loops_are_grouped_by_session_and_debounced_by_tool(spark, tmp_path):
    """A call of the state function costs much: one for a session, whatever its tools, and the alerts of each tool on their own."""
    import datetime

    from sparlog.streaming import live

    day, schema = datetime.datetime(2024, 1, 1), "session_id string, tool_name string, input_hash string, ts timestamp"
    rows = [(s, tool, "x", day + datetime.timedelta(seconds=i)) for s in "ab" for tool in ("Read", "Bash", None) for i in range(6)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    loops = live.stream_loops(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    plan = [x for x in loops._jdf.queryExecution().analyzed().toString().splitlines() if "FlatMapGroupsInPandasWithState" in x][0]
    assert "tool_name" not in plan.split("[session_id", 2)[1].split("]")[0]
    got = sorted((r["session_id"], r["tool_name"] or "", r["hits"], r["ts"].second) for r in live.drain(loops, str(tmp_path / "out")).collect())
    assert got == sorted((s, tool, 3, 2) for s in "ab" for tool in ("Read", "Bash", ""))


def test_joins_of_problems_do_not_go_through_the_driver(spark):
    from sparlog.operators import recurring

    sets = spark.createDataFrame([(1, ["word", "other"]), (2, ["word", "third"]), (3, ["word", "other", "third"])], "at long, words array<string>")
    buckets = recurring.prefix_buckets(sets)
    plan = recurring._met(buckets, buckets, (2, 5))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
