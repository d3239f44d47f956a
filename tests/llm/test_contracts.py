"""The registered queries of op1 to op10 on the smallest tables, column by column, against brute force over whole texts."""

import hashlib
import re
import zlib
from collections import defaultdict

import pyarrow.parquet as pq
import pytest
from sparlog.llm import queries

DATA = "/root/testdata/sf0.001"
SHA = lambda b: hashlib.sha256(b).hexdigest()
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def docs():
    return [(r["doc_id"], r["text"]) for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist()]


def found(df, *columns):
    rows = df.collect()
    out = {r["doc_id"]: tuple(r[c] for c in columns) for r in rows}
    assert len(out) == len(rows)
    return out


def test_op1(spark, docs):
    first, want = {}, {}
    for d, text in sorted(docs):
        t = (text or "").encode()
        gone = bytearray(len(t))
        for i in range(len(t) - 49):
            if first.setdefault(t[i : i + 50], d) < d:
                gone[i : i + 50] = b"\1" * 50
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        want[d] = (len(t), sum(gone), spans, SHA(bytes(x for x, g in zip(t, gone, strict=True) if not g)))
    assert found(queries.op1_suffix_array_dedup(spark, DATA), "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def luhn(s):
    digits = [int(c) for c in s if c.isdigit()][::-1]
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits)) % 10 == 0


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= sum(c.isdigit() for c in m) <= 19 and luhn(m)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= sum(c.isdigit() for c in m) <= 15),
}


def test_op2(spark, docs):
    want = {}
    for d, text in docs:
        spans = {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if good(m[0])] for k, (p, good) in BASE.items()}
        want[d] = (*(len(v) for v in spans.values()), SHA(",".join(f"{k}:{a}:{b}" for k, v in spans.items() for a, b in v).encode()))
    assert found(queries.op2_personal_data(spark, DATA), "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == want


@pytest.mark.parametrize(("query", "parts", "kept"), [(queries.op3_toxicity, 5, 0), (queries.op7_quality, 3, 1)])
def test_scores(spark, docs, query, parts, kept):
    got = found(query(spark, DATA), "held_out", "score", "predicted")
    assert set(got) == {d for d, _ in docs}
    assert all(v[0] == (zlib.crc32(str(d).encode()) % parts == kept) and 0 <= v[1] <= 1 and v[2] == int(v[1] >= 0.5) for d, v in got.items())


def test_op5(spark, docs):
    got = found(queries.op5_media_columns(spark, DATA), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")
    for d, text in docs:
        t = (text or "").encode()
        p = t + b" " * ((-len(t)) % 192 or (0 if t else 192))
        assert got[d] == (len(t), len(p), SHA(p), zlib.crc32(p[-16:]))


def test_op6(spark, docs):
    got = found(queries.op6_balanced_sharding(spark, DATA), "size", "text_crc32", "shard", "slot", "law", "grown_shard")
    slots = defaultdict(list)
    for d, text in docs:
        t = (text or "").encode()
        assert got[d][:2] == (len(t) + 8, zlib.crc32(t)) and got[d][4:] == ("rows", None)
        slots[got[d][2]].append(got[d][3])
    assert set(slots) == set(range(24)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    # texts of the same words mostly lie together
    shingles = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, t in docs for w in [(t or "").split()]}
    of = defaultdict(set)
    for d, s in shingles.items():
        for x in s:
            of[x].add(d)
    pairs = {(a, b) for v in of.values() for a in v for b in v if a < b}
    links = [(a, b) for a, b in pairs if 2 * len(shingles[a] & shingles[b]) >= len(shingles[a] | shingles[b])]
    assert links and sum(got[a][2] != got[b][2] for a, b in links) <= 0.4 * len(links)


def test_op8(spark, docs):
    words = lambda t: WORDS.findall((t or "").translate(LOW))
    windows = defaultdict(set)
    for r in pq.read_table(f"{DATA}/benchmark.parquet").to_pylist():
        w = words(r["text"])
        for i in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[i : i + 13])].add(str(r["item_id"]))
    sizes, want = {len(k) for k in windows}, {}
    for d, text in docs:
        w, items = words(text), set()
        hit = bytearray(len(w))
        for n in sizes:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    items |= own
                    hit[i : i + n] = b"\1" * n
        want[d] = (len(w), sum(hit), len(items), SHA(",".join(sorted(items)).encode()), sum(hit) > 0 and 20 * sum(hit) >= len(w))
    assert found(queries.op8_benchmark_decontamination(spark, DATA), "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want


def test_op9(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    rows = queries.op9_best_fit_packing(spark, DATA).collect()
    pieces, places, lengths = defaultdict(list), defaultdict(list), []
    for r in rows:
        pieces[r["doc_id"]].append(r)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, text in docs:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted(pieces[d], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and len(own) == -(-len(ids) // 2048)
        at = 0
        for r in own:
            part = ids[at : at + r["length"]]
            assert (r["start"], r["ids_crc32"]) == (at, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)))
            at += r["length"]
        assert at == len(ids)
        lengths.append(len(ids))
    for v in places.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(places) <= 1.02 * (sum(lengths) / 2048) + 1


def test_op10(spark, docs):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    sets = {}
    for d, text in docs:
        w = word.findall((text or "").translate(LOW))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    of = defaultdict(set)
    for d, s in sets.items():
        for x in s:
            of[x].add(d)
    for a, b in {(a, b) for v in of.values() for a in v for b in v if a < b}:
        if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    want = {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}
    assert found(queries.op10_minhash_near_dedup(spark, DATA), "n_shingles", "component_id", "kept") == want
