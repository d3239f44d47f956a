"""Each operator against brute force on small tables with nulls, empty texts, copies, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib

import pytest

import numpy as np
from sparlog.llm import contamination, lines, media, minhash, packing, pii, quality, sharding, suffix, toxicity
from sparlog.llm.queries import tokenizer_path

R = random.Random(5)
WORDS = ["".join(R.choice("abcdefgh") for _ in range(R.randint(2, 7))) for _ in range(400)]


def sentence(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


SHARED, LONG = sentence(60), sentence(3000)
TEXTS = [None, "", " ", "a", SHARED, SHARED, sentence(20) + " " + SHARED + " " + sentence(20), sentence(5) + " " + SHARED, LONG, LONG + " tail", "é" * 80, "aaaa" * 60, "aaaa" * 70, *(sentence(R.randint(1, 90)) for _ in range(20)), "a  b\n\n c ", SHARED.upper()]
ROWS = [(i, t, "x", i) for i, t in enumerate(TEXTS)] + [(4, SHARED, "x", 4)]


@pytest.fixture(scope="module")
def docs(spark):
    # extra columns whose names clash with those the operators use
    return spark.createDataFrame([(r[0], r[1], r[2], r[3]) for r in ROWS], "doc_id long, text string, component string, n long").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_suffix(docs, none):
    first, want = {}, {}
    for d, t in sorted((r[0], (r[1] or "").encode()) for r in ROWS):
        cov = bytearray(len(t))
        for i in range(len(t) - 49):
            if first.setdefault(t[i : i + 50], d) < d:
                cov[i : i + 50] = b"\1" * 50
        want[d] = (len(t), sum(cov), hashlib.sha256(bytes(x for x, c in zip(t, cov, strict=True) if not c)).hexdigest())
    got = suffix.repeated_bytes(docs).collect()
    assert len(got) == len(ROWS)
    assert all((r["n_bytes"], r["n_removed"], r["kept_sha256"]) == want[r["doc_id"]] for r in got)
    assert suffix.repeated_bytes(none).count() == 0
    assert suffix.repeat_groups(docs).where("length >= 50").count() > 0


def test_lcp_intervals():
    import numpy as np

    assert sorted(suffix.lcp_intervals(np.asarray([0, 5, 7, 5, 0, 6]), 5)) == [(5, 0, 3), (6, 4, 5), (7, 1, 2)]


def test_near_duplicates(docs, none):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = {d: shingles(t) for d, t, *_ in ROWS}
    comp = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    assert all((r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), comp[r["doc_id"]], comp[r["doc_id"]] == r["doc_id"]) for r in got)
    assert minhash.near_duplicates(none).count() == 0


def test_contamination(spark, docs, none):
    bench = spark.createDataFrame([(1, SHARED), (2, None), (3, "zz yy xx"), (4, " ".join(SHARED.split()[10:30]))], "item_id long, text string")
    got = {r["doc_id"]: r for r in contamination.match(docs, bench).collect()}
    assert got[4]["contaminated"] and got[4]["items"] == ["1", "4"] and got[4]["n_hit"] == 60 and got[4]["longest"] == 60
    assert got[6]["n_hit"] == 60 and not got[0]["contaminated"] and got[34]["n_hit"] == 60
    assert contamination.match(none, bench).count() == 0
    in_blocks = {r["doc_id"]: (r["n_hit"], r["items"]) for r in contamination.match(docs, bench, block_bytes=100).collect()}
    assert in_blocks == {d: (r["n_hit"], r["items"]) for d, r in got.items()}


def test_packing(docs, none):
    import numpy as np
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    tok.encode_special_tokens = True
    got = packing.pack(docs, tokenizer_path()).collect()
    pieces = {(r["doc_id"], r["piece"]): r for r in got}
    for d, t, *_ in ROWS:
        ids = np.asarray([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        mine = [pieces[d, k] for k in range(-(-len(ids) // 2048))]
        assert [r["start"] for r in mine[1:]] == list(range((len(ids) - 1) % 2048 + 1, len(ids), 2048))
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in mine)
    seqs = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert seqs.get(r["sequence_id"], 0) == r["offset"]
        seqs[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(seqs.values()) <= 2048
    assert packing.pack(none, tokenizer_path()).count() == 0


def test_bin_completion_is_exact_where_it_can_be():
    assert packing.plan_bins({7: 3, 3: 3, 6: 2, 4: 2}, 10).bins == 5


def test_media(docs, none):
    got = {r["doc_id"]: r for r in media.media_columns(docs).collect()}
    for d, t, *_ in ROWS:
        b = (t or "").encode()
        p = b.ljust(max(192, -(-len(b) // 192) * 192))
        assert (got[d]["n_bytes"], got[d]["payload_sha256"], got[d]["tail_crc32"]) == (len(b), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    assert got[4]["media_sha256"] == got[5]["media_sha256"]
    assert media.media_columns(none).count() == 0


def test_personal_data(spark, none):
    text = 'mail a.b@c.de or "x@y" +1 (212) 555-0123 at 10.0.0.255 not 300.1.1.1 card 4111 1111 1111 1111 token = "0b96a8c8d79c4a5085c919698889f59b72ab7bb6"'
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "é " * 30_000 + "1.2.3.4"), (5, "9" * 6000 + " " + "@" * 2000)], "doc_id long, text string")
    got = {r["doc_id"]: [(s["kind"], s["start"]) for s in r["spans"]] for r in pii.personal_data(docs).collect()}
    assert [k for k, _ in got[1]][:4] == ["email", "ip", "card", "phone"] and ("secret", text.index("0b96")) in got[1]
    assert got[2] == [] and got[3] == [] and got[4] == [("ip", 60_000)] and got[5] == []
    assert pii.personal_data(none).count() == 0


def test_toxicity(spark, none):
    bad = ["grumplefoo", "zarkinoid", "blatherskite"]
    rows = [(i, sentence(30) + (" " + bad[i % 3] if i % 3 == 0 or i % 7 == 0 else "")) for i in range(300)]
    labels = [(i, int(i % 3 == 0 or i % 7 == 0)) for i in range(240)]
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (902, "you gr7mplef00 z4rk1n0id"), (903, "a b l a t h e r s k i t e b")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    wrong = [i for i in range(240, 300) if got[i]["predicted"] != int(i % 3 == 0 or i % 7 == 0)]
    assert len(wrong) <= 3 and got[900]["predicted"] == got[901]["predicted"] == 0
    assert got[902]["predicted"] == 1 and toxicity.score(none, model).count() == 0


def test_quality(spark, none):
    rows = [(i, " ".join(w.upper() + "!!" for w in sentence(80).split()) if i % 2 else sentence(80) + ".") for i in range(200)]
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame([(i, 1 - i % 2) for i in range(150)], "doc_id long, quality int"))
    got = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    assert sum(got[i]["predicted"] == 1 - i % 2 for i in range(150, 200)) >= 48 and 0 <= got[900]["score"] <= 1
    assert quality.score(none, model).count() == 0


def test_lines(spark, none):
    a = sentence(40)
    b = a.split()
    b[7] = "changed"
    docs = spark.createDataFrame([(1, f"{a}\nfirst one here\n\n"), (2, f"{a}\n\nanother thing"), (3, None), (4, ""), (5, a.upper() + "!")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs).collect()}
    assert got == {1: f"{a}\nfirst one here\n\n", 2: "\nanother thing", 3: None, 4: "", 5: ""}
    report = {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in lines.line_report(docs).collect()}
    assert report[2] == (3, 1) and report[3] == (0, 0)
    near = lines._near(spark.createDataFrame([("a", "b", a, " ".join(b)), ("c", "d", a, sentence(40)), ("e", "f", "x y x", "x")], "a string, b string, ta string, tb string"), 0.8).collect()
    assert [r["a"] for r in near] == ["a"]
    assert lines.dedup_lines(none).count() == 0


def test_bins_against_the_optimum():
    from collections import Counter

    def least(items, room=100):
        items, best = sorted(items, reverse=True), len(items)

        def go(i, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if i == len(items):
                best = len(bins)
                return
            for j in sorted(set(bins)):
                if j + items[i] <= room:
                    rest = list(bins)
                    rest.remove(j)
                    go(i + 1, (*rest, j + items[i]))
            go(i + 1, (*bins, items[i]))

        go(0, ())
        return best

    for k in range(200):
        items = [R.randint(1, 60) if k % 2 else R.randint(10, 50) for _ in range(R.randint(1, 11))]
        plan = packing.plan_bins(Counter(items), 100)
        used = Counter()
        for times, pattern in plan.patterns:
            assert sum(n * c for n, c in pattern) <= 100
            for n, c in pattern:
                used[n] += times * c
        assert used == Counter(items) and plan.bins == plan.bound == least(items)
    assert packing.plan_bins(Counter([46, 50, 40, 22, 27, 44, 19, 30, 40, 30, 16, 35]), 100).bins == 4
    assert packing.plan_bins({1: 10**6}, 2048).bins == 489
    assert packing.plan_bins({}, 2048).patterns == []


def test_ids_of_every_character_are_the_tokenizers():
    import public_tokenizers

    enc = packing._encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert enc.fast is not None
    for low in range(0, 0x110000, 97 * 64):
        chars = [chr(c) for c in range(low, min(low + 64, 0x110000)) if not 0xD800 <= c < 0xE000]
        text = "".join(f"a{c} {c}a{c}{c}1{c} 1 {c}  {c}\n" for c in chars) + "<|endoftext|>"
        assert np.frombuffer(enc(text), "<u4").tolist() == enc.tok.encode(text, add_special_tokens=False).ids
    text = " " * 300_000 + "a"
    assert np.frombuffer(enc(text), "<u4").tolist() == enc.tok.encode(text, add_special_tokens=False).ids


def test_packing_many_empty_texts(spark):
    import public_tokenizers

    docs = spark.range(5000).selectExpr("id as doc_id", "if(id % 2 = 0, null, '') as text", "7 as length", "'x' as sequence_id")
    got = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert len(got) == 5000 and {r["sequences"] for r in got} == {3}
    places = {(r["sequence_id"], r["offset"]) for r in got}
    assert len(places) == 5000 and max(r["offset"] for r in got) == 2047


def test_sharding(docs, none):
    got = sharding.shard(docs, shards=5).collect()
    assert len(got) == len(ROWS)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    counts = [len(v) for v in by.values()]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.shard(none).count() == 0
