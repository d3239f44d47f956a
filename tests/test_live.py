import datetime
import json
import random

import pytest

from sparlog.streaming import live

START = datetime.datetime(2024, 1, 1)
SCHEMA = "session_id string, tool_name string, input_hash string, ts timestamp"


def rows():
    r = random.Random(3)
    out = [(r.choice("ab"), r.choice(["Read", "Bash"]), r.choice("xyz"), START + datetime.timedelta(seconds=r.randint(0, 900))) for _ in range(250)]
    return [*out, (None, "Read", "x", START), ("a", "Read", "x", None)]


def expected(calls, window=60, least=3, debounce=30):
    seen, last, out = {}, {}, []
    for s, tool, h, t in sorted((c for c in calls if c[0] and c[3]), key=lambda c: (c[3], c[2])):
        mine = seen[s, tool, h] = [u for u in seen.get((s, tool, h), []) if (t - u).total_seconds() < window] + [t]
        if len(mine) >= least:
            seen[s, tool, h] = []
            if (s, tool) not in last or (t - last[s, tool]).total_seconds() >= debounce:
                last[s, tool] = t
                out.append((s, tool, h, t))
    return sorted(out)


@pytest.fixture
def source(spark, tmp_path):
    spark.createDataFrame(rows(), SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))


def test_loops_equal_the_plain_rule(source, tmp_path):
    got = live.drain(live.stream_loops(source), str(tmp_path / "out")).collect()
    assert sorted((r["session_id"], r["tool_name"], r["input_hash"], r["ts"]) for r in got) == expected(rows())
    assert len(got) > 3


def test_usage_equals_batch(spark, source, tmp_path):
    want = live.windowed_usage(spark.createDataFrame(rows(), SCHEMA), "5 minutes").collect()
    got = live.drain(live.windowed_usage(source, "5 minutes"), str(tmp_path / "out"), "complete").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert live.bursts(spark.createDataFrame(rows(), SCHEMA), "10 seconds").count() > 5


def test_tools(spark):
    e = spark.createDataFrame(rows(), SCHEMA)
    assert {r[0] for r in live.chosen_tools(e, ("Read",), ("Read",)).select("tool_name").distinct().collect()} == {"Read"}
    assert {r[0] for r in live.chosen_tools(e, (), ("Read",)).select("tool_name").distinct().collect()} == {"Bash"}


def test_roll_up_replaces_sessions(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()

    def put(name, *texts):
        (logs / name).write_text("\n".join(json.dumps({"type": "user", "message": {"content": t}}) for t in texts))

    put("a.jsonl", "one")
    for k in (1, 2):
        live.roll_up_sessions(live.stream_lines(spark, str(logs)), str(tmp_path / "s"), str(tmp_path / "c")).awaitTermination()
        put(f"b{k}.jsonl", "two", "three")
    got = {r["session_id"]: r["message_count"] for r in spark.read.parquet(str(tmp_path / "s" / "1")).collect()}
    assert got == {"a": 1, "b1": 2}
