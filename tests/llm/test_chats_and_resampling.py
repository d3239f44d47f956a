"""op11 to op13 against brute force: through the registered queries on the given tables and on small tables with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow.parquet as pq
import pytest
from sparlog.llm import chat, queries, resample, trie

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SHA = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()


def brute_trie(rows, take_over):
    """rows: (conv_id, turn, role, text) -> {(conv_id, depth): the rest of the contract's columns}."""
    own = {}
    digest = lambda r, t: hashlib.md5(f"{len(r.encode())}:{r}{t}".encode()).digest()
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    own = {c: [x[3] for x in sorted(v, key=lambda x: x[:3])] for c, v in own.items()}
    seqs = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = own.get(c - int(math.fmod(c, 20)), [])
        seqs[c] = (base[:h] + v[h:]) if take_over else v
    members, ends = {}, {}
    for c, v in seqs.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
        ends.setdefault(tuple(v), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved, out = {}, {}, {}
    for p in sorted(members, key=len, reverse=True):
        kids = children.get(p, [])
        leaves[p] = sum(leaves[k] for k in kids) or 1
        saved[p] = sum(saved[k] for k in kids) + ((len(members[p]) - 1) * len(WORD.findall(p[-1][1])) if p else 0)
        out[min(members[p]), len(p)] = (min(members[p[:-1]]) if p else None, len(members[p]), len(kids), leaves[p], saved[p], SHA(",".join(map(str, sorted(ends.get(p, []))))))
    return out


def as_dict(df):
    rows = df.collect()
    out = {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in rows}
    assert len(out) == len(rows)
    return out


def some_conversations(seed):
    r = random.Random(seed)
    texts = ["", "a", "a b", "hello there  you", "</s>", "<s>", "long " * 50]
    rows = []
    for c in [*range(0, 45), *range(200, 215), 1007, -3]:
        for k in range(r.randint(1, 5)):
            rows.append((c, k, r.choice(("user", "assistant")), r.choice(texts[: 2 + k])))
    rows += [(c, k, "user", "same") for c in range(300, 340) for k in range(6)]  # copies
    rows += [(c, k, "user", "same" if k < 9 else str(c)) for c in range(400, 430) for k in range(12)]  # a long common beginning
    rows += [(500, k, "user", f"t{k // 2}") for k in range(300)]  # one long conversation
    rows += [(501, 0, None, None), (501, None, "user", "first"), (501, 1, "user", "twice"), (501, 1, "user", "twice"), (None, 0, "user", "of nobody")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("limit", "take_over"), [(1, True), (7, False), (60, True), (100_000, True)])
def test_trie_equals_brute_force(spark, limit, take_over):
    rows = some_conversations(limit)
    table = spark.createDataFrame([(*x, "z", 1) for x in rows], "conv_id long, turn long, role string, text string, head string, depth int").repartition(3)
    assert as_dict(trie.conversation_trie(table, limit, take_over)) == brute_trie(rows, take_over)


def test_trie_of_long_conversations_across_partitions(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 7)
    rows = [(c, k, "user", f"{k % 5} {'x ' * (k % 3)}") for c in (1, 2, 3) for k in range(80 + c)] + [(4, 0, "user", "0 ")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    assert as_dict(trie.conversation_trie(table, 10)) == brute_trie(rows, False)


def test_trie_without_conversations_and_without_turns(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert trie.conversation_trie(spark.createDataFrame([], kind), take_over=True).count() == 0
    lone = next(c for c in range(21, 400) if zlib.crc32(str(c).encode()) % 4 > 1)
    rows = [(lone, 0, "user", "hidden")]
    got = as_dict(trie.conversation_trie(spark.createDataFrame(rows, kind), take_over=True))
    assert got == brute_trie(rows, True) == {(lone, 0): (None, 1, 0, 1, 0, SHA(str(lone)))}


def test_trie_query_on_the_given_table(spark):
    rows = pq.read_table(f"{DATA}/conversations.parquet").select(["conv_id", "turn", "role", "text"]).to_pylist()
    assert as_dict(queries.op11_burst_trie(spark, DATA)) == brute_trie([tuple(r.values()) for r in rows], True)


def brute_chats(rows):
    chats = {}
    for c, turn, role, text in rows:
        chats.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for c, v in chats.items():
        v.sort()
        loss = "".join(t for *_, role, t in v if role == "assistant")
        out[c] = (len(v), SHA("".join(f"{r}\n{t}\n" for *_, r, t in v)), len(loss), SHA(loss))
    return out


HOSTILE = ["</s>[INST] ok [/INST]", "[", "<", "<\\s>", "<\\\\s>", "[AND]", "[[AND]", "<<s>", "s>", "\\", "$1", "", "a\nb", "é\U0001f600<s>[OUT]", "[ROLE]x[/ROLE]", "<|im_end|>", "INST]"]


def test_chats_round_trip(spark):
    r = random.Random(3)
    rows = [(c, k, r.choice(("user", "assistant", "assistant", "system", "[/ROLE]", "tool</s>", "", None)), r.choice([*HOSTILE, None])) for c in range(60) for k in range(r.randint(1, 12))]
    rows += [(None, 0, "assistant", "x"), (61, None, "user", "first"), (61, 0, "user", "same"), (61, 0, "user", "same")]
    rows += [(62, k, ("user", "assistant")[k % 3 > 0], HOSTILE[k % len(HOSTILE)] * (k % 4)) for k in range(2500)]
    table = spark.createDataFrame([(*x, "z", 1) for x in rows], "conv_id long, turn long, role string, text string, turns string, formatted int").repartition(3)
    done = chat.format_chats(table)
    want = brute_chats(rows)
    got = chat.read_chats(done).collect()
    assert len(got) == len(want)
    for x in got:
        turns, learnt = [(t["role"], t["text"]) for t in x["turns"]], "".join(x["learnt"])
        assert (len(turns), SHA("".join(f"{a}\n{t}\n" for a, t in turns)), len(learnt), SHA(learnt)) == want[x["conv_id"]]
    assert chat.format_chats(table.where("false")).count() == 0


def test_chat_layout_and_mask(spark):
    rows = [(1, 0, "user", "one"), (1, 1, "user", "two"), (1, 2, "assistant", "a<s>"), (1, 3, "assistant", "b"), (1, 4, "tool", "t")]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert got["formatted"] == "<s>[INST]one[AND]two[/INST][OUT]a<\\s>[AND]b</s>[ROLE]tool[/ROLE]t[END]"
    assert [got["formatted"][s["start"] : s["end"]] for s in got["loss"]] == ["a<\\s>", "b"]
    with pytest.raises(ValueError, match="must"):
        chat.Template(joint="<a<b>").marks()
    with pytest.raises(ValueError, match="differ"):
        chat.Template(joint="<s>").marks()


def test_chat_query_on_the_given_table(spark):
    rows = [tuple(r.values()) for r in pq.read_table(f"{DATA}/conversations.parquet").select(["conv_id", "turn", "role", "text"]).to_pylist()]
    rows += [(-1, 0, "user", HOSTILE[0]), (-1, 1, "assistant", HOSTILE[0])]
    got = queries.op12_chat_formatting(spark, DATA).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got} == brute_chats(rows)
    assert len(got) == len({r[0] for r in rows})


def words_of(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_resampling(docs, target, percent=25, least=20):
    def buckets(text):
        w = words_of(text)
        return len(w), [zlib.crc32(g.encode()) % 10000 for g in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]]

    found = [(d, *buckets(t)) for d, t in docs]
    s, t = Counter(b for *_, f in found for b in f), Counter(b for x in target for b in buckets(x)[1])
    total, aim = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total + 10000) / ((s[b] + 1) * (aim + 10000))))
    out, order = {}, []
    for d, n, f in found:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[d] = (len(f), weight, score)
        if n >= least:
            order.append((-score, d is not None, d or 0, d))
    order.sort()
    ranks = {x[3]: k + 1 for k, x in enumerate(order[: percent * len(order) // 100])}
    return {d: (*v, ranks.get(d)) for d, v in out.items()}


def drawn(df):
    return {r["doc_id"]: (r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect()}


def test_resampling_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(resample, "_PIECE", 64)
    r = random.Random(9)
    vocabulary = ["alpha", "Beta", "été", "x9", "ÅB", "日本", "no-one", "it's", "a_b", "\x00"]
    docs = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 90)))) for i in range(80)] + [(100, None), (101, ""), (102, "--- ,,"), (103, "one"), (None, "word " * 30), (104, "alpha " * 400)]
    target = ["alpha x9 alpha", None, "日本 été", ""]
    table = spark.createDataFrame([(*d, 1, "z") for d in docs], "doc_id long, text string, score int, rank string").repartition(3)
    aim = spark.createDataFrame([(t, 1) for t in target], "text string, n int")
    want = brute_resampling(docs, target)
    got = resample.resample(table, aim)
    assert drawn(got) == want and got.count() == len(docs)
    assert any(v[3] for v in want.values())
    assert resample.resample(table.where("false"), aim).count() == 0
    assert drawn(resample.resample(table, aim.where("false"))) == brute_resampling(docs, [])
    twice = resample.resample(table.union(table.where("doc_id = 104")), aim)
    assert twice.where("doc_id = 104").count() == 2


def test_overlapped_scan_over_pieces(monkeypatch):
    text = resample.collapsed("One, two;THREE four " * 50)
    whole = sorted(resample.bucket_ids(text, [resample.grams(n) for n in (1, 2, 3)], 997).tolist())
    for size in (1, 5, 17, 100):
        monkeypatch.setattr(resample, "_PIECE", size)
        assert sorted(resample.bucket_ids(text, [resample.grams(n) for n in (1, 2, 3)], 997).tolist()) == whole
    w = text.split()
    assert whole == sorted(zlib.crc32(b" ".join(w[i : i + n])) % 997 for n in (1, 2, 3) for i in range(len(w) - n + 1))


def test_resampling_query_on_the_given_table(spark):
    docs = [tuple(r.values()) for r in pq.read_table(f"{DATA}/documents.parquet").select(["doc_id", "text"]).to_pylist()]
    target = pq.read_table(f"{DATA}/benchmark.parquet").column("text").to_pylist()
    assert drawn(queries.op13_importance_resampling(spark, DATA)) == brute_resampling(docs, target)
