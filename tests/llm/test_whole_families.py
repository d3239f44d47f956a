"""op10_minhash_near_dedup against brute force on a large family of unequal documents."""

import random

from sparlog.llm import minhash


def components(sets, num, den):
    comp = list(range(len(sets)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if den * both >= num * (len(sets[i]) + len(sets[j]) - both) and find(i) != find(j):
                comp[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(sets))]


def family(r, n, words=140):
    """Documents around one text; each pair of neighbours is linked, few are linked with the first."""
    base = [f"w{r.randint(0, 10**6)}" for _ in range(words)]
    out = []
    for _ in range(n // 2):
        t = list(base)
        for k in r.sample(range(words), 3):
            t[k] = f"x{r.randint(0, 10**6)}"
        other = list(t)
        for k in r.sample(range(words), 2):
            other[k] = f"y{r.randint(0, 10**6)}"
        out += [" ".join(t), " ".join(other)]
    r.shuffle(out)
    return out


def sets_of(texts):
    return [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]


def test_large_family(spark):
    texts = family(random.Random(7), 400)
    want = components(sets_of(texts), 85, 100)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, need=(85, 100), rows=1, most=4).collect()}
    assert len(set(want)) > 100 and [got[i] for i in range(len(texts))] == want


def test_members_meet_by_rare_shingles_and_not_in_pairs(spark):
    """All links of a family are among the pairs, and once its groups are known few pairs are left."""
    r = random.Random(8)
    base = [f"w{r.randint(0, 10**6)}" for _ in range(140)]
    texts = []
    for k in range(300):
        t = list(base[: r.choice((130, 135, 140))])
        for i in r.sample(range(len(t)), r.choice((1, 2, 5, 6, 9))):
            t[i] = f"x{r.randint(0, 10**6)}"
        if k % 5 == 0 and texts:
            t = texts[r.randrange(len(texts))].split()
            t[r.randrange(len(t))] = "y"
        texts.append(" ".join(t))
    sets = sets_of(texts)
    links = {(i, j) for j in range(len(texts)) for i in range(j) if sets[i] != sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = minhash._sets(docs, docs.selectExpr("doc_id as node"), 5)
    alone = minhash._rarest(docs.selectExpr("doc_id as node", "doc_id as group"), held, (85, 100))
    found = {(p["a"], p["b"]) for p in alone.collect()}
    assert len(links) > 100 and links <= found
    want = components(sets, 85, 100)
    groups = spark.createDataFrame(list(enumerate(want)), "node long, group long")
    assert minhash._rarest(groups, held, (85, 100)).count() < len(texts) ** 2 / 2 / 20


def test_a_family_gives_few_pairs(spark, monkeypatch):
    """Members with changes of their own around one text: each meets the central member once, and not one in each band."""
    r = random.Random(9)
    base = [f"w{r.randint(0, 10**6)}" for _ in range(140)]
    texts = []
    for k in range(300):
        t = list(base)
        for i in r.sample(range(140), r.choice((1, 2, 2)) if k else 0):
            t[i] = f"x{r.randint(0, 10**6)}"
        texts.append(" ".join(t))
    look, count = minhash._look_alike, []
    monkeypatch.setattr(minhash, "_look_alike", lambda pairs, reps, lowest: count.append(pairs.count()) or look(pairs, reps, lowest))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(docs).collect()}
    assert [got[i] for i in range(300)] == components(sets_of(texts), 85, 100)
    assert sum(count) <= len(texts)
