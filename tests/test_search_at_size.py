"""Searches ask each distinct query once, and give the same places as all pairs."""

import datetime

from sparlog.plans import catalog, queries

LONG = "x" * 40 + "needle" + "y" * 40
TALKS = {0: "a b c", 1: "xa b cx a", 2: f"{LONG} b\nc", 3: "A B C a b c", 20: "needle", 40: "a  b c", 60: "a", 1100: "view a b cat", 3000: "b ca b c"}


class Given(queries._Tables):
    def __init__(self, spark, given):
        super().__init__(spark, "")
        self.given = given

    def __getitem__(self, name):
        return self.given[name] if name in self.given else super().__getitem__(name)

    def __contains__(self, name):
        return name in self.given or super().__contains__(name)


def test_places_of_needles_equal_all_pairs(spark):
    """Blanks within, parts of words, words longer than those looked up by substrings, tools, and ids in several ranges."""
    day = datetime.datetime(2024, 1, 1)
    given = {
        "conversations": spark.createDataFrame([(c, 0, "user", t) for c, t in TALKS.items()], "conv_id long, turn long, role string, text string"),
        "events": spark.createDataFrame([(i, day, u, t, 1.0, "{}") for i, (u, t) in enumerate([(0, "view"), (1, "click"), (20, "needle-tool")])], "event_id long, ts timestamp, user_id long, event_type string, value double, props string"),
        "pages": spark.createDataFrame([], "page_id long, url string, html string"),
    }
    needles = ["a b c", "needle", "b ca", "view", "x", "b\nc", "none at all", "a", "1100"]
    tables = Given(spark, given | {"needles": spark.createDataFrame([(n,) for n in needles if "\n" not in n], "needle string")})
    hay = {r["session_id"]: r["hay"] for r in catalog.frame(spark, "searched", tables).collect()}
    assert len(hay) == len(TALKS)
    want = set()
    for n in needles:
        if "\n" not in n:
            want |= {(n, s, k) for k, s in enumerate(sorted(s for s, h in hay.items() if n in h), 1)}
    got = {tuple(r) for r in catalog.frame(spark, "needle_places", tables).select("needle", "session_id", "place").collect()}
    assert got == want and len(want) > 15


def test_a_line_over_both_finds_what_its_own_query_asks_for(spark):
    from sparlog.operators import find

    day = datetime.datetime(2024, 1, 1)
    given = {
        "conversations": spark.createDataFrame([(c, 0, "user", t) for c, t in TALKS.items()], "conv_id long, turn long, role string, text string"),
        "events": spark.createDataFrame([(0, day, 60, "needle-tool", 1.0, "{}")], "event_id long, ts timestamp, user_id long, event_type string, value double, props string"),
        "pages": spark.createDataFrame([], "page_id long, url string, html string"),
    }
    tables = Given(spark, given)
    sessions = catalog.frame(spark, "chat_sessions", tables).selectExpr("*", "timestamp '2024-01-01 00:00:00' as start_time", "1d as cost_usd").where("session_id <> 20")
    found = {(r["session_id"], r["role"], r["snippet"]) for r in find.search(spark, tables, sessions, ":all needle", day).collect()}
    assert {(s, r) for s, r, _ in found} == {(2, "first_msg"), (60, "tool")} and all("needle" in x for _, _, x in found)
    body = find.search(spark, tables, sessions, ":body b c", day).collect()
    assert {r["session_id"] for r in body} == {0, 3, 40, 3000} and all("[b] [c]" in r["snippet"].lower() for r in body)


def test_equal_queries_are_scored_once(spark):
    """Two queries of the same words, and one of a frequent and a rare word, whose rare word alone leads to messages."""
    rows = [(c, 0, "user", "rare often" if c in (20, 40) else "often words") for c in range(0, 60)]
    tables = Given(spark, {"conversations": spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")})
    asked = catalog.frame(spark, "query_sets", tables).collect()
    seeds = catalog.frame(spark, "set_seeds", tables).groupBy("words").count().collect()
    assert len(asked) == 3 and len(seeds) <= 2
    assert all(r["count"] == 2 for r in seeds if "rare" in r["words"])


def test_parts_of_messages_give_only_what_may_be_among_the_first(spark, monkeypatch):
    """A set of frequent terms meets every message, yet each part gives its best ones, equal scores included; places equal those over all pairs."""
    from sparlog.operators import scoring

    rows = [(s, 0, "user", 3 + s % 5 * (s % 2), ["a", "b", "c"][: 1 + s % 3], [1 + s % 4, 2, 1][: 1 + s % 3]) for s in range(3000)]
    sets = [("a", ["a"], [0.5]), ("a b", ["b", "a"], [1.25, 0.5]), ("c a b", ["c", "b", "a"], [2.0, 1.25, 0.5]), ("a z", ["z", "a"], [3.0, 0.5])]
    monkeypatch.setattr(scoring, "MESSAGES_A_TASK", 1000)
    messages = spark.createDataFrame(rows, "session_id long, ord long, role string, len long, terms array<string>, tfs array<long>")
    seeds = scoring.first_messages(messages, spark.createDataFrame([(w, 4.0, t, i) for w, t, i in sets], "words string, mean_len double, terms array<string>, idf array<double>"), 20)
    assert max(r["count"] for r in seeds.groupBy("words").count().collect()) <= 4 * 20 * 2
    got = {}
    for r in seeds.collect():
        got.setdefault(r["words"], []).append((-round(r["score"], 6), r["session_id"]))
    for words, terms, idf in sets:
        want = []
        for s, _, _, n, held, tfs in rows:
            if set(terms) <= set(held):
                want.append((-round(sum(w * tfs[held.index(t)] * 2.2 / (tfs[held.index(t)] + 1.2 * (0.25 + 0.75 * n / 4.0)) for t, w in zip(terms, idf)), 6), s))
        assert sorted(got.get(words, []))[:20] == sorted(want)[:20]
