"""Operators written with DataFrames, against plain Python: clustering, search, order statistics, topics, growing logs, roll-ups."""

import math
import os
import random
import re
import time
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparlog.functions import human, query_language, stem
from sparlog.operators import find, order, recurring, topics, vectors
from sparlog.plans import catalog, queries
from sparlog.sources import growing, knowledge, logs
from sparlog.streaming import rollup

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def words_of(text):
    return {w for w in re.split("[^a-z0-9_-]+", text.lower()) if len(w) >= 4 and w not in recurring.PROBLEM_STOPWORDS}


def greedy(rows):
    """Clusters in a plain pass, newest first: {first session: [sessions]}."""
    clusters = []
    for s, text, at in sorted(rows, key=lambda r: (-r[2], r[0])):
        w = words_of(text)
        for first, found in clusters:
            if w and first and 5 * len(w & first) >= 2 * len(w | first):
                found.append((s, text))
                break
        else:
            clusters.append((w, [(s, text)]))
    return [c for _, c in clusters if len(c) > 1]


def test_recurring_problems_equal_a_greedy_pass(spark):
    r = random.Random(4)
    pool = [f"word{k:02d}" for k in range(60)]
    rows = [(i, " ".join(r.sample(pool[: 60 if i % 2 else 14], r.randint(1, 7))), r.randint(0, 300)) for i in range(1000)]
    rows += [(2000 + i, "chain alpha beta gamma".replace("chain", ("aaaa", "bbbb", "cccc")[i]), 900 - i) for i in range(3)] + [(3000, "", 5), (3001, "the of a", 5), (3002, "the of a", 5)]
    table = spark.createDataFrame(rows + [(3003, None, 1)], "session_id long, problem string, generated_at long").repartition(3)
    want = sorted((len(c), max(c, key=lambda x: len(x[1]))[1], ",".join(str(s) for s, _ in c[:10])) for c in greedy(rows))
    got = recurring.recurring_problems(table).collect()
    assert sorted((x["n"], x["representative"], x["sessions"]) for x in got) == want and len(want) > 20
    for x in got[:5]:
        assert all(k in pool or len(k) == 4 or k in ("alpha", "beta", "gamma") for k in x["keywords"].split(","))
    assert recurring.recurring_problems(table.where("false")).count() == 0


def test_similar_problems_equal_all_pairs(spark):
    r = random.Random(5)
    rows = [(i, " ".join(r.choice("abcdefghij") * 4 for _ in range(r.randint(0, 8))), i) for i in range(150)]
    first = {}
    for s, text, at in sorted(rows, key=lambda x: (-x[2], x[0])):
        first.setdefault(frozenset(words_of(text)), s)
    want = {(s, t) for a, s in first.items() for b, t in first.items() if s > t and a and 5 * len(a & b) >= 2 * len(a | b)}
    got = recurring.similar_problems(spark.createDataFrame(rows, "session_id long, problem string, generated_at long"))
    assert {(x["first_session"], x["second_session"]) for x in got.collect()} == want and want


STEMS = """caresses caress,ponies poni,ties ti,cats cat,feed feed,agreed agre,plastered plaster,bled bled,motoring motor,sing sing,conflated conflat,troubled troubl,sized size,hopping hop,
falling fall,hissing hiss,fizzed fizz,failing fail,filing file,happy happi,sky sky,relational relat,conditional condit,rational ration,digitizer digit,radicalli radic,vietnamization vietnam,predication predic,
operator oper,feudalism feudal,decisiveness decis,hopefulness hope,formaliti formal,sensibiliti sensibl,triplicate triplic,formalize formal,electrical electr,goodness good,revival reviv,allowance allow,
airliner airlin,adjustable adjust,irritant irrit,replacement replac,adjustment adjust,adoption adopt,communism commun,effective effect,bowdlerize bowdler,probate probat,rate rate,cease ceas,controll control,
roll roll,generalizations gener,oscillators oscil,say sai,syzygy syzygi,triggers trigger,is is,été été"""


def test_stems_of_the_published_examples(spark):
    pairs = [tuple(x.strip().split(" ")) for x in STEMS.replace("\n", "").split(",")]
    spark.createDataFrame([(w,) for w, _ in pairs], "word string").createOrReplaceTempView("stem_words")
    assert {r["word"]: r["stem"] for r in spark.sql(stem.stemmed(catalog.Spark, "word", "stem_words")).collect()} == dict(pairs)


def index_of(spark, said):
    table = spark.createDataFrame(said, "session_id long, ord long, role string, content string")
    return {"s6_messages": table}


def search(spark, said, asked, step="q2_search_bm25", **more):
    tables = queries._Tables(spark, DATA)
    asked = spark.createDataFrame([(str(k), 0, q) for k, q in enumerate(asked)], "query_id string, asker long, q string")
    own = dict(index_of(spark, said), search_queries=asked, **more)
    own["spread_vocabulary"] = catalog.frame(spark, "vocabulary", own)
    own["index_rows"] = catalog.frame(spark, "token_stems", own)
    own["hit_rows"] = catalog.frame(spark, "scored_hits", own)
    return catalog.frame(spark, step, {**{n: tables[n] for n in ("events", "pages")}, **own}).collect()


SAID = [(1, 0, "user", "Postgres TRIGGERS fire twice, why?"), (1, 1, "assistant", "A trigger on postgres may be defined twice."), (2, 0, "user", "éléphant résumé"), (3, 0, "user", "nothing here " * 12 + "but a trigger and postgres " + "more words " * 20 + "trigger"), (4, 0, "user", "dock docker docked")]


def test_search_finds_stems_of_all_terms(spark):
    got = search(spark, SAID, ["postgres trigger", "RESUME elephant", "docks", "trigger nowhere", "assistant trigger"])
    assert [r["session_id"] for r in sorted((r for r in got if r["query_id"] == "0"), key=lambda r: r["place"])][0] == 1
    assert {(r["query_id"], r["session_id"], r["ord"]) for r in got} == {("0", 1, 0), ("0", 1, 1), ("0", 3, 0), ("1", 2, 0), ("2", 4, 0), ("4", 1, 1)}
    exact = search(spark, SAID, ["a trigger", "postgres trigger"], "q3_search_exact")
    assert {(r["query_id"], r["session_id"], r["ord"]) for r in exact} == {("0", 1, 1), ("0", 3, 0), ("1", 1, 0)}


def test_snippets_are_the_best_windows(spark):
    r = random.Random(6)
    said = [(i, 0, "user", " ".join(r.choice(["alpha", "beta", "gamma", *("filler" + str(k) for k in range(9))]) for _ in range(r.randint(1, 70)))) for i in range(40)]
    for x in search(spark, said, ["alpha beta", "gamma"]):
        terms = ({"alpha", "beta"}, {"gamma"})[int(x["query_id"])]
        tokens = said[x["session_id"]][3].split()
        def worth(at):
            inside = [t for t in tokens[at : at + 16] if t in terms]
            return (-len(set(inside)), -len(inside), at)
        at = min((worth(k) for k, t in enumerate(tokens) if t in terms))[2]
        at = 0 if len(tokens) <= 16 else min(at, len(tokens) - 16)
        body = " ".join(f"[{t}]" if t in terms else t for t in tokens[at : at + 16])
        assert x["snippet"] == ("…" if at else "") + body + ("…" if at + 16 < len(tokens) else "")


def test_search_lines():
    parse = query_language.parse
    assert parse("project:Web Branch:X model:OPUS since:7d cost:>1.5 cost:<9 fix it") == query_language.Line("fix it", "hybrid", None, "web", "x", "opus", 7 * 86_400_000_000, 1.5, 9.0)
    assert parse(":body  cost:free since:soon :x a:b cost:>x") == query_language.Line("cost:free since:soon :x a:b cost:>x", "fts")
    assert parse(":all hello") == query_language.Line("hello", "hybrid", True) and parse(":sim q").mode == "semantic" and parse(":meta q").mode == "metadata"
    assert [query_language.duration_us(x) for x in ("24h", "1h30m", "-5m", "0", "1.5s", "d", "5", "1w", "2x3m", "-2d")] == [86_400_000_000, 5_400_000_000, -300_000_000, 0, 1_500_000, None, None, None, None, -172_800_000_000]


def test_search_filters_and_lines_over_tables(spark):
    at = datetime(2024, 1, 30)
    rows = [(1, "/P/Web", "feat/x", "claude-opus", at, 2.0), (2, "/p/web", None, "claude-opus", at, None), (3, "/p/api", "feat/x", "sonnet", datetime(2024, 1, 1), 9.0)]
    sessions = spark.createDataFrame(rows, "session_id long, project_dir string, git_branch string, model string, start_time timestamp, cost_usd double")
    ids = lambda line: {r["session_id"] for r in query_language.search_filters(sessions, line, datetime(2024, 1, 31)).collect()}
    assert ids("project:WEB") == {1, 2} and ids("branch:feat") == {1, 3} and ids("since:7d") == {1, 2} and ids("since:-7d") == {1, 2, 3}
    assert ids("cost:>2") == {1, 3} and ids("cost:<2") == {1, 2} and ids("cost:>-1 cost:<-1") == {1, 2, 3} and ids("text only") == {1, 2, 3}
    tables = queries._Tables(spark, DATA)
    all_ = catalog.frame(spark, "chat_sessions", tables).withColumn("start_time", F.lit(at)).withColumn("cost_usd", F.col("session_id").cast("double"))
    assert {r["session_id"] for r in find.search(spark, tables, all_, "cost:<3", at).collect()} <= {0, 1, 2, 3}
    hits = find.search(spark, tables, all_, ":meta cost:<9 feat/cc-", at).collect()
    assert hits and all(r["role"] == "branch" and "[feat/CC-]" in r["snippet"] for r in hits)
    body = find.search(spark, tables, all_, ":body the", at)
    assert body.count() == body.select("session_id").distinct().count() > 0
    vector = catalog.frame(spark, "vectors", tables).where("session_id = 3").first()["embedding"]
    assert find.search(spark, tables, all_, ":sim this", at, vector=vector).orderBy("place").first()["session_id"] == 3


def test_session_ids(spark):
    ids = ["aaaaaaaa-0000-4000-8000-000000000001", "aaaaaaaa-0000-4000-8000-000000000002", "AAAAAAAB-0000-4000-8000-000000000003"]
    sessions = spark.createDataFrame([(s, datetime(2024, 1, k + 1)) for k, s in enumerate(ids)], "session_id string, start_time timestamp")
    asked = [ids[0], ids[0][:10], "aaaaaa", " AAAAAAAB ", "aaaaa", "aaaaaaaa0", "zzzzzz", "bbbbbb", None, "aaaaaaaa-0000-4000-8000-000000000001x"]
    got = {r["q"]: r["session_id"] for r in query_language.resolve_session_ids(sessions, spark.createDataFrame([(q,) for q in asked], "q string")).collect()}
    assert got == {ids[0]: ids[0], ids[0][:10]: ids[1], "aaaaaa": ids[2], " AAAAAAAB ": ids[2]}


def test_text_arguments_are_bound_as_they_are(spark):
    said = spark.createDataFrame([(1, 0, "user", "a{b} C:\\dir it's {here} $text"), (2, 0, "user", "ab C:dir")], "session_id long, ord long, role string, content string")
    found = lambda text: [r["session_id"] for r in catalog.frame(spark, "q4_search_like", {"s6_messages": said}, text=text).collect()]
    assert [found(t) for t in ("a{b", "C:\\dir", "it's", "{here}", "$text", "ab")] == [[1], [1], [1], [1], [1], [2]]
    assert "it''s {here}" in catalog.sql("q4_search_like", text="it's {here}")


def test_order_statistics_of_large_groups(spark):
    r = random.Random(7)
    groups = {"a": [r.randint(0, 9) for _ in range(5000)], "b": list(range(10)), "c": list(range(11)), "d": list(range(12)), "e": [3], None: [2, 1]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("f", None)]
    got = order.rank_percentiles(spark.createDataFrame(rows, "g string, v long").repartition(5), ["g"], "v", {"p90": ("floor", 0.9), "half": ("half", 0), "tenths": ("nine_tenths", 0)})
    want = {g: (len(v), sorted(v)[math.floor((len(v) - 1) * 0.9)], sorted(v)[len(v) // 2], sorted(v)[min(len(v) * 9 // 10, len(v) - 1)]) for g, v in groups.items()}
    assert {x["g"]: (x["n"], x["p90"], x["half"], x["tenths"]) for x in got.collect()} == want


def test_million_values_are_selected_in_many_tasks(spark):
    rows = spark.range(1_000_000).select(F.lit("one").alias("g"), ((F.col("id") * 7919) % 1_000_003).alias("v"))
    values = sorted((i * 7919) % 1_000_003 for i in range(1_000_000))
    got = order.rank_percentiles(rows, ["g"], "v", {"p50": ("floor", 0.5), "p90": ("floor", 0.9)}).first()
    assert (got["p50"], got["p90"]) == (values[499_999], values[899_999])
    assert order.numbered(rows, [F.col("v")]).where(F.col("number") == 10).first()["v"] == values[9]


def test_lanes_equal_a_global_order(spark):
    r = random.Random(8)
    rows = [(f"t{r.randint(0, 5)}", datetime(2024, 1, 1, r.randint(0, 20)), i) for i in range(300)]
    place = {x[2]: k for k, x in enumerate(sorted(rows, key=lambda x: (x[1], x[2])))}
    got = order.thread_lanes(spark.createDataFrame(rows, "t string, start_time timestamp, session_id long").repartition(4), ["t"]).collect()
    for x in got:
        mine = [place[i] for t, _, i in rows if t == x["t"]]
        assert (x["first_index"], x["last_index"], x["sessions"]) == (min(mine), max(mine), len(mine))


def test_nearest_vectors_equal_brute_force(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=5).tolist()) for i in range(120)] + [(200, [0.0] * 5), (201, None), (202, [1.0, 2.0]), (203, [2.0, 4.0])]
    rows += [(300 + k, rows[0][1]) for k in range(15)]  # ties
    table = spark.createDataFrame(rows, "session_id long, embedding array<double>").repartition(4)
    got = vectors.nearest(table, table, 4, rows=16)
    assert "Cartesian" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()
    unit = {i: np.asarray(v) / np.linalg.norm(v) for i, v in rows if v and any(v)}
    want = {}
    for i, a in unit.items():
        near = sorted((-round(float(a @ b), 6), j) for j, b in unit.items() if j != i and len(a) == len(b))[:4]
        want.update({(i, k + 1): (j, -s) for k, (s, j) in enumerate(near)})
    assert {(x["query_id"], x["place"]): (x["session_id"], pytest.approx(x["sim"], abs=1e-6)) for x in got.collect()} == want


def test_topics_follow_their_rules(spark):
    r = np.random.default_rng(2)
    rows = [(i, (r.normal(size=3) * 0.1 + 10 * (i % 4) * np.eye(3)[i % 3]).tolist()) for i in range(200)]
    table = spark.createDataFrame(rows, "session_id long, embedding array<double>")
    one, centres = topics.kmeans_topics(table.repartition(5), 6)
    two, _ = topics.kmeans_topics(table.repartition(2), 6)
    found = {x["session_id"]: x["topic"] for x in one.collect()}
    assert found == {x["session_id"]: x["topic"] for x in two.collect()} and len(found) == 200
    cost = 0.0
    for i, v in rows:
        d = ((centres - np.asarray(v)) ** 2).sum(1)
        assert found[i] == d.argmin()
        cost += d.min()
    for t in set(found.values()):  # centres are the means
        assert np.allclose(centres[t], np.mean([v for i, v in rows if found[i] == t], axis=0), atol=1e-6)
    for fewer in (1, 2):
        assert sum(topics.kmeans_topics(table, fewer)[0].agg(F.sum("distance")).first()) >= cost - 1e-9
    same = spark.createDataFrame([(1, [1.0]), (2, [1.0]), (3, [5.0])], "session_id long, embedding array<double>")
    assert topics.kmeans_topics(same, 10)[0].select("topic").distinct().count() == 2
    assert topics.kmeans_topics(same.limit(1))[0].count() == 0
    labelled = one.select("session_id", F.col("topic").alias("label")).join(table, "session_id")
    members = catalog.frame(spark, "q17_cluster_members", {"vectors": labelled}).collect()
    assert sum(m["members"] for m in members) == 200
    assert catalog.frame(spark, "q16_exemplars", {"vectors": labelled}).groupBy("label").count().where("count > 5").count() == 0


def test_human_numbers(spark):
    n = {0: "0", 999: "999", 1000: "1.0k", 1549: "1.5k", 2_000_000: "2.0m", 3_100_000_000: "3.1b"}
    us = {0: "0s", 59_999_999: "59s", 60_000_000: "1m", 3_600_000_000: "1h", 12_000_000_000: "3h20m"}
    one = spark.createDataFrame([(k, v) for k, v in n.items()], "n long, want string").select(human.humanize_tokens(F.col("n")).alias("got"), "want")
    two = spark.createDataFrame([(k, v) for k, v in us.items()], "n long, want string").select(human.humanize_duration(F.col("n")).alias("got"), "want")
    assert all(r["got"] == r["want"] for r in one.union(two).collect())
    assert spark.range(1).select(human.humanize_count(F.lit(1234567))).first()[0] == "1,234,567"


def test_knowledge_from_replies(spark):
    good = 'Sure:\n```json\n{"problem": "p", "decisions": [{"decision": "d", "rationale": "r"}], "tech_used": ["Go"]}\n```'
    replies = spark.createDataFrame([(1, 10, good), (2, 11, "no idea"), (3, 12, None)], "session_id long, generated_at long, raw string")
    got = knowledge.knowledge_from_replies(replies).collect()
    assert [(r["session_id"], r["generated_at"], r["problem"], r["decisions"], r["tech_used"], r["open_questions"]) for r in got] == [(1, 10, "p", ["d"], ["Go"], [])]


def test_technologies_and_commands_on_both_sides_of_their_bounds(spark):
    said = spark.createDataFrame([(1, 0, "user", "golang and GOLANG, docker; not pgolang"), (2, 1, "assistant", "Redis redis go build x")], "session_id long, ord long, role string, content string")
    assert {r["tech"]: r["matches"] for r in catalog.frame(spark, "b12_detect_tech", {"s6_messages": said}).collect()} == {"Go": 3, "Docker": 1, "Redis": 1}
    calls = [("curl https://api.github.com/x", 3), ("git diff --name-only", 4), ("kubectl get pods", 5), ("find . -type f", 4), ("grep -r x", 3)]
    lines = [f'{{"type":"assistant","sessionId":"s","timestamp":"2024-01-01T00:00:{k:02d}Z","message":{{"role":"assistant","content":[{{"type":"tool_use","name":"Bash","input":{{"command":"{c}"}}}}]}}}}' for c, n in calls for k in range(n)]
    rows = spark.createDataFrame([("/l/-p/s.jsonl", datetime(2024, 1, 1), (0, i), x) for i, x in enumerate(lines)], "file_path string, mtime timestamp, ord struct<block: long, row: long>, line string")
    events = logs.tool_events(logs.parse_events(rows))
    got = catalog.frame(spark, "r9_rule_cli", {"tool_events": events}).collect()
    assert {r["title"]: r["score"] for r in got} == {"gh": 12, "k9s": 20, "fd": 16}


def append(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "ab") as f:
        f.write(text.encode())


def test_growing_logs_are_read_from_where_they_ended(spark, tmp_path):
    spark.dataSource.register(growing.GrowingLogs)
    root, out, log = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        rows = spark.readStream.format("growing_logs").option("path", str(root)).option("pieceBytes", 16).load()
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
        return sorted((os.path.basename(r["file_path"]), r["at"], r["line"]) for r in spark.read.schema("file_path string, at long, line string").parquet(out).collect())

    append(root / "p" / "a.jsonl", "one\ntwo is a line longer than a piece of sixteen bytes\nhal")
    append(root / "p" / "x" / "subagents" / "b.jsonl", "not this\n")
    append(root / "p" / "c.txt", "nor this\n")
    first = run()
    assert [r[2] for r in first] == ["one", "two is a line longer than a piece of sixteen bytes"]
    append(root / "p" / "a.jsonl", "f\néé\n")
    append(root / "q" / "d.jsonl", "new file\n")
    second = run()
    assert [r[2] for r in second] == [*(r[2] for r in first), "half", "éé", "new file"]
    (root / "p" / "a.jsonl").write_text("anew\n")  # shorter: written from the start
    assert sorted(r[2] for r in run()) == sorted([*(r[2] for r in second), "anew"])
    assert len(run()) == len(second) + 1  # nothing new


def test_roll_ups_rewrite_changed_buckets_only(spark, tmp_path):
    where = "file://" + str(tmp_path / "table")
    table = rollup.Buckets(spark, where, "k", 8)
    rows = spark.range(40).selectExpr("cast(id as string) as k", "id as v")
    table.replace(0, rows)
    files = lambda: {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(tmp_path) for f in fs if f.endswith(".parquet")}
    before = files()
    time.sleep(0.05)
    update = spark.createDataFrame([("3", 300), ("new", 1)], "k string, v long")
    changed = table.replace(1, update)
    assert len(changed) <= 2
    kept = [f for f, t in files().items() if before.get(f) == t]
    assert len(kept) >= len(before) - len(changed) * 2
    want = {str(i): i for i in range(40)} | {"3": 300, "new": 1}
    read = lambda v=None: {r["k"]: r["v"] for r in table.read(rows.schema, v).collect()}
    assert read() == want and read(0) == {str(i): i for i in range(40)}
    table.replace(1, update)  # a batch that is run again
    assert read() == want
    table.replace(2, update.where("false"), removed=rows.where("v >= 20").select("k"))
    assert read() == {k: v for k, v in want.items() if k in ("new", "3") or v < 20}
    assert table.manifests() == [1, 2]
    table.replace(3, update)
    old = {int(d[1:]) for d in os.listdir(tmp_path / "table") if d.startswith("v")}
    assert all(any(v == o for m in table.manifests() for v in table.manifest(m).values()) for o in old)


def test_growing_logs_roll_up(spark, tmp_path):
    spark.dataSource.register(growing.GrowingLogs)
    root = tmp_path / "logs"
    line = lambda s, text: f'{{"type":"user","sessionId":"{s}","message":{{"role":"user","content":"{text}"}}}}\n'
    table = rollup.Buckets(spark, "file://" + str(tmp_path / "t"), "file_path", 4)

    def run():
        rows = spark.readStream.format("growing_logs").option("path", str(root)).load()
        rollup.roll_up_changed(rows, table, str(tmp_path / "c")).awaitTermination()
        schema = logs.sessions(logs.parse_events(logs.read_lines(spark, str(root)))).schema
        return {r["session_id"]: r["message_count"] for r in table.read(schema).collect()}

    append(root / "p" / "a.jsonl", line("a", "x") + line("a", "y"))
    append(root / "p" / "b.jsonl", line("b", "x"))
    assert run() == {"a": 2, "b": 1}
    append(root / "p" / "a.jsonl", line("a", "z"))
    assert run() == {"a": 3, "b": 1}
