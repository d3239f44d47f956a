import datetime
import json

import pytest

from sparlog.sources import logs

T = "2024-03-01T10:00:{:02d}Z"


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("logs")

    def put(path, *rows):
        f = top / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))

    tool = lambda n, i: {"type": "tool_use", "name": n, "input": i}
    put(
        "-home-a/s1.jsonl", "", "{broken", "[1]",
        {"type": "user", "sessionId": "", "timestamp": "never", "message": {"content": " oi "}},
        {"type": "user", "sessionId": "s1", "gitBranch": "main", "timestamp": T.format(1), "message": {"content": [{"type": "tool_result", "content": [{"type": "text", "text": "deep"}]}]}},
        {"type": "assistant", "sessionId": "s1", "timestamp": T.format(2), "message": {"model": "m", "usage": {"input_tokens": 5, "cache_read_input_tokens": 7}, "content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "ok"}, tool("Read", {"file_path": "/x", "n": {"b": 1, "a": 2}})]}},
        {"type": "assistant", "sessionId": "s1", "timestamp": T.format(3), "isSidechain": True, "agentId": "g", "message": {"content": [tool("Read", {"n": {"a": 2, "b": 1}, "file_path": "/x"})]}},
        {"type": "user", "sessionId": "s1", "timestamp": T.format(4), "message": {"content": "Funcionou, obrigado"}},
        {"type": "summary"},
    )
    put("-home-a/s1/subagents/z.jsonl", {"type": "assistant", "message": {"content": "x"}})
    put("-home-b/s2.jsonl", {"type": "user", "message": {"content": "/clear now"}})
    put("-home-b/s3.jsonl", {"type": "summary"})
    return str(top)


@pytest.fixture(scope="module")
def events(spark, root):
    return logs.parse_events(logs.read_lines(spark, root)).cache()


def test_sessions(spark, root, events):
    agents = logs.parse_events(logs.read_lines(spark, root, agents=True))
    got = {r["session_id"]: r for r in logs.sessions(events, agents).collect()}
    assert set(got) == {"s1", "s2"}
    s = got["s1"]
    assert (s["user_messages"], s["assistant_messages"], s["git_branch"], s["model"], s["project_dir"]) == (3, 2, "main", "m", "/home/a")
    assert (s["first_user_msg"], s["last_user_msg"], s["input_tokens"], s["cache_read_tokens"]) == ("oi", "Funcionou, obrigado", 5, 7)
    assert (s["sidechain_turns"], s["sidechain_agents"], s["tools"], s["resolved_at_turn"]) == (2, 2, {"Read": 2}, 5)
    assert (s["end_time"] - s["start_time"]).total_seconds() == 3
    assert [r["session_id"] for r in logs.ingest_filter(logs.sessions(events)).collect()] == ["s1"]
    assert logs.sessions(events.where("false")).count() == 0


def test_messages_and_ledger(events):
    said = [r["text"] for r in logs.messages(events).where("session_id = 's1'").orderBy("ord").collect()]
    assert said == ["deep", "ok tool:Read /x", "tool:Read /x", "Funcionou, obrigado"]
    rows = logs.ledger(events).where("file_path like '%s1.jsonl'").orderBy("idx").collect()
    assert [(r["idx"], r["role"]) for r in rows] == list(enumerate(["user", "user", "thinking", "assistant", "tool_use", "tool_use", "user"]))


def test_tools_and_files(events):
    rows = logs.tool_events(events).collect()
    assert len(rows) == 2 and len({r["input_hash"] for r in rows}) == 1 and rows[0]["input_preview"] == "/x"
    assert [(r["path"], r["op_count"]) for r in logs.file_ops(events).collect()] == [("/x", 2)]


def test_incremental(spark):
    day = datetime.datetime(2024, 1, 1)
    files = spark.createDataFrame([("a", day), ("b", day), ("c", day)], "file_path string, mtime timestamp")
    old = spark.createDataFrame([("a", day, 1), ("b", day - datetime.timedelta(1), 1), ("d", day, 1)], "file_path string, mtime timestamp, parser_version int")
    assert dict(logs.incremental_plan(files, old, 1).collect()) == {"a": "unchanged", "b": "updated", "c": "new", "d": "removed"}
    assert logs.incremental_plan(files, old, 2).where("status = 'unchanged'").count() == 0
    t = spark.createDataFrame([(1, "x", 1), (2, "y", 2), (3, "z", 3)], "k int, s string, v int")
    u = spark.createDataFrame([(2, "", None), (4, "w", 4)], "k int, s string, v int")
    assert sorted(logs.upsert(t, u, "k", removed=t.where("k = 3")).select("k", "s").collect()) == [(1, "x"), (2, ""), (4, "w")]
    assert sorted(map(tuple, logs.merge_keep_nonempty(t, u, "k", ("s",), ("v",)).collect())) == [(1, "x", 1), (2, "y", 2), (3, "z", 3), (4, "w", 4)]


def test_cache_export_and_replies(spark, events):
    s = logs.sessions(events)
    none = spark.createDataFrame([], "session_id string, jsonl_mtime timestamp, summary string")
    assert logs.stale_cache(s, none).count() == 2
    assert logs.stale_cache(s, s.selectExpr("session_id", "mtime as jsonl_mtime", "'x' as summary")).count() == 0
    out = {r["session_id"]: json.loads(r["document"]) for r in logs.export_sessions(s, logs.messages(events)).collect()}
    assert len(out["s1"]["messages"]) == 4
    raw = spark.createDataFrame([(1, 'Sure:\n```json\n[{"t": "a"}, {"t": "b"}]\n```'), (2, "none"), (3, '{"t": "c"}')], "id int, raw string")
    got = sorted(map(tuple, logs.parse_model_json(raw, "t string").collect()), key=repr)
    assert got == [(1, "a", None), (1, "b", None), (2, None, "no JSON"), (3, "c", None)]
