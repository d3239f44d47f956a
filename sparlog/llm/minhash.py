"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard.

All signature coordinates come from two permutations of the universe of 32-bit
shingle codes: a first one, ``sigma``, scatters the codes, and the second,
``pi``, is used circularly shifted by k for coordinate k (Li and Li, 2021).
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MOST_BROADCAST_IDS, NULL_ID, connected_components, cut, discard, keyed, restore_id

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_TABLE = np.random.default_rng(20_231).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD_BASE = np.uint64(0xD6E8FEB86659FD93)
#: Members of larger buckets meet by their rarest shingles and not in pairs.
LARGE = 16


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_codes(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit codes of a text's word shingles; fewer words make one shingle, none make none."""
    raw = text.encode("utf-8", "surrogatepass").lower() if text else b""
    b = np.frombuffer(raw, dtype=np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64)
    inside = ~((b == 32) | ((b >= 9) & (b <= 13)))
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    # words: polynomial in the byte codes, from the word's own start
    place = np.arange(len(b)) - np.repeat(start, np.diff(np.append(start, len(b)))) if start[0] == 0 else np.concatenate([np.zeros(start[0], np.int64), np.arange(start[0], len(b)) - np.repeat(start, np.diff(np.append(start, len(b))))])
    top = int((end - start).max())
    powers = np.empty(max(top, int(place.max()) + 1), np.uint64)
    powers[0] = 1
    np.multiply.accumulate(np.full(len(powers) - 1, _BASE), out=powers[1:]) if len(powers) > 1 else None
    code = np.where(inside, _TABLE[b] * powers[place], np.uint64(0))
    words = _mix(np.add.reduceat(code, start) + (end - start).astype(np.uint64))
    if len(words) < size:
        acc = np.full(1, len(words), np.uint64)
        for w in words:
            acc = acc * _WORD_BASE + w
        return _mix(acc)
    acc = np.full(len(words) - size + 1, np.uint64(size))
    for k in range(size):
        acc = acc * _WORD_BASE + words[k : len(words) - size + 1 + k]
    return np.unique(_mix(acc))


def signature(codes: np.ndarray, coords: int) -> np.ndarray:
    """Circulant MinHash: coordinate k is the least pi(sigma(code) + k) over the set."""
    x = (codes >> np.uint64(32)).astype(np.uint32)
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)  # sigma
    out = np.full(coords, 0xFFFFFFFF, np.uint32)
    step = max(1, 32_768 // max(1, min(len(x), 32_768)))
    for a in range(0, len(x), 32_768):
        part = x[a : a + 32_768]
        for k in range(0, coords, step):
            y = part[None, :] + np.arange(k, min(k + step, coords), dtype=np.uint32)[:, None]
            y ^= y >> np.uint32(16)
            y *= np.uint32(0x85EBCA6B)
            y ^= y >> np.uint32(13)
            y *= np.uint32(0xC2B2AE35)
            y ^= y >> np.uint32(16)  # pi, shifted by k
            np.minimum(out[k : k + step], y.min(axis=1), out=out[k : k + step])
    return out


def _band_codes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    acc = np.arange(bands, dtype=np.uint64)
    grid = sig[: bands * rows].reshape(bands, rows).astype(np.uint64)
    for k in range(rows):
        acc = _mix(acc * _BASE + grid[:, k])
    return acc.view(np.int64)


def features(docs: DataFrame, size: int, coords: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, cls (digest of the shingle set, null if empty), sig (one byte a coordinate), bands."""

    def work(batches):
        for b in batches:
            out = {"n": [], "cls": [], "sig": [], "bands": []}
            for t in b.column("text").to_pylist():
                codes = shingle_codes(t, size)
                sig = signature(codes, coords) if len(codes) else None
                out["n"].append(len(codes))
                out["cls"].append(hashlib.blake2b(codes.tobytes(), digest_size=16).digest() if len(codes) else None)
                out["sig"].append(None if sig is None else sig.astype(np.uint8).tobytes())
                out["bands"].append(None if sig is None else _band_codes(sig, bands, rows))
            yield pa.record_batch([b.column("doc_id"), pa.array(out["n"], pa.int64()), pa.array(out["cls"], pa.binary()), pa.array(out["sig"], pa.binary()), pa.array(out["bands"], pa.list_(pa.int64()))], names=["doc_id", "n", "cls", "sig", "bands"])

    return docs.mapInArrow(work, "doc_id long, n long, cls binary, sig binary, bands array<long>")


@F.pandas_udf(T.DoubleType())
def _alike(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaccard estimate from one-byte coordinates, freed of chance agreement."""
    if not len(a):
        return pd.Series([], dtype="float64")
    x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) for s in (a, b))
    return pd.Series(((x == y).mean(axis=1) - 1 / 256) / (1 - 1 / 256))


@F.pandas_udf(T.LongType())
def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(a, b, strict=True)], dtype="int64")


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, codes) of the wanted documents' whole shingle sets."""

    def work(batches):
        for b in batches:
            yield pa.record_batch([b.column("doc_id"), pa.array([shingle_codes(t, size).tobytes() for t in b.column("text").to_pylist()], pa.binary())], names=["node", "codes"])

    wanted = wanted.withColumnRenamed("node", "doc_id")
    if wanted.count() <= MOST_BROADCAST_IDS:  # only the texts of these are shuffled
        wanted = F.broadcast(wanted)
    return docs.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"]).mapInArrow(work, "node long, codes binary")


def _verify(pairs: DataFrame, sets: DataFrame, need: tuple[int, int]) -> DataFrame:
    """The (a, b) pairs whose whole sets reach the similarity need[0] / need[1]."""
    n = lambda c: F.length(c) / 8
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("codes").alias("ca")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("codes").alias("cb")), "b")
    both = both.where((n("ca") * need[1] >= n("cb") * need[0]) & (n("cb") * need[1] >= n("ca") * need[0]))
    both = both.select("a", "b", (n("ca") + n("cb")).cast("long").alias("total"), _common("ca", "cb").alias("same"))
    return both.where(F.col("same") * need[1] >= (F.col("total") - F.col("same")) * need[0]).select("a", "b")


def _met(rows: DataFrame, reps: DataFrame, lowest: float) -> DataFrame:
    """Pairs (a, b) of (key, node, group) rows that share a key but no group and look alike; every pair once."""
    other = rows.select("key", F.col("node").alias("b"), F.col("group").alias("other"))
    return _look_alike(rows.withColumnRenamed("node", "a").join(other, "key").where("a < b and group <> other").select("a", "b").distinct(), reps, lowest)


def _listed(batches):
    """(node, group, n, codes) with the codes as numbers."""
    for b in batches:
        codes = b.column("codes").to_pylist()
        ends = np.cumsum([0, *(len(c) // 8 for c in codes)])
        listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(codes), np.int64)))
        yield pa.record_batch([b.column("node"), b.column("group"), pa.array(np.diff(ends), pa.int64()), listed], names=["node", "group", "n", "codes"])


def _rarest(members: DataFrame, sets: DataFrame, need: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of (node, group) rows of different groups, all those whose whole sets reach the similarity among them; every pair once.

    With one order for all shingles, rarest first, two sets of x and y that
    must share ``o`` have a common one among the first x - o + 1 and the first
    y - o + 1. The smaller set is kept under these shingles and its class of
    sizes, a hundredth wide; the larger one asks for each class that it can be
    similar to, by as many shingles as that class needs. Shingles that one
    set alone has are counted but meet nothing.
    """
    num, den = need
    shared = f"(({{}} + {{}}) * {num} + {num + den - 1}) div {num + den}".format
    smallest, size_class = f"(n * {num} + {den - 1}) div {den}", "cast(floor(ln({}) * 100) as int)".format
    held = members.join(sets, "node").select("node", "group", "codes").mapInArrow(_listed, "node long, group long, n long, codes array<long>")
    held = cut(held.select("node", "group", "n", F.explode("codes").alias("code")))
    often = held.groupBy("code").agg(F.count("*").alias("m"), F.min("group").alias("low"), F.max("group").alias("high")).where("m > 1")
    rows = held.join(often.selectExpr("code", "m", "low <> high as mixed"), "code")
    rows = rows.groupBy("node", "group", "n").agg(F.array_sort(F.collect_list(F.struct("m", "code", "mixed"))).alias("codes"))
    first = f"slice(codes, 1, cast(greatest(0, {{}} + 1 - (n - size(codes))) as int))".format
    # at: how many shingles of the set come before
    rows = rows.selectExpr("node", "group", "n", "n - size(codes) as alone", f"{first(f'n - {shared('n', smallest)}')} as codes")
    kept = rows.selectExpr("node as b", "group as other", "n as nb", "alone", f"{size_class('n')} as class", f"posexplode(slice(codes, 1, cast(greatest(0, n - {shared('n', 'n')} + 1 - alone) as int))) as (place, c)")
    kept = cut(kept.where("c.mixed").selectExpr("c.code as code", "class", "b", "other", "nb", "alone + place as bt"))
    asks = rows.selectExpr("*", f"explode(sequence({size_class(smallest)}, {size_class('n')})) as class")
    asks = asks.selectExpr("node as a", "group", "n as na", "alone", "class", f"posexplode(slice(codes, 1, cast(greatest(0, n - {shared('n', f'greatest({smallest}, cast(ceil(exp(class / 100)) as long) - 1)')} + 1 - alone) as int))) as (place, c)")
    asks = asks.where("c.mixed").selectExpr("c.code as code", "class", "a", "group", "na", "alone + place as at")
    asks = cut(asks.join(kept.select("code", "class").distinct(), ["code", "class"], "left_semi"))
    # of each key the largest group's members are not met with one another
    top = kept.groupBy("code", "class", "other").agg(F.count("*").alias("k")).groupBy("code", "class").agg(F.max_by("other", F.struct("k", "other")).alias("top"))
    kept, asks = kept.join(top, ["code", "class"]), asks.join(top, ["code", "class"])
    met = f"group <> other and (na > nb or na = nb and a > b) and least(na - at, nb - bt) >= {shared('na', 'nb')}"
    small = asks.drop("top").join(kept.where("other <> top").drop("top"), ["code", "class"]).where(met)
    large = asks.where("group <> top").drop("top").join(kept.where("other = top").drop("top"), ["code", "class"]).where(met)
    out = small.select("a", "b").union(large.select("a", "b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    out = cut(out)
    discard(held)
    return out


def _look_alike(pairs: DataFrame, reps: DataFrame, lowest: float) -> DataFrame:
    sig = reps.select("node", "n", "sig")
    pairs = pairs.join(sig.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb")), "b")
    return cut(pairs.where(_alike("sa", "sb") >= lowest).select("a", "b", "na", "nb"))


def candidates(reps: DataFrame, most: int, lowest: float, verified, similar, rounds: int = 3) -> tuple[DataFrame, DataFrame | None]:
    """(pairs, edges): all pairs (a, b, na, nb) of class representatives that share a band, look alike and may join two components, and the links found so far.

    ``reps``: node, n, sig, bands; ``verified`` gives enough of the true links
    among such pairs to join their components (all, if told that they are few), ``similar`` pairs of (node, group) rows across groups with all true
    links among them. Members of buckets of more than ``most`` are first
    verified against a member of one of their buckets, ``rounds`` times, which puts most copies of a
    family in one component. Then buckets of up to LARGE members give all
    their pairs across components, those of linked and not linked members
    included, and the members of larger ones go through ``similar``: no link
    between components is lost, and pairs within one are not needed.
    """
    rows = reps.select("node", F.explode("bands").alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    rows = cut(rows.join(sizes, "key").select("key", "node", "m"))
    hot, edges, comp = rows.where(F.col("m") > most), None, None

    def grouped(rows: DataFrame) -> DataFrame:
        if comp is None:
            return rows.select("key", "node", F.col("node").alias("group"))
        return rows.join(comp.select("node", "component"), "node", "left").select("key", "node", F.coalesce("component", "node").alias("group"))

    if not hot.isEmpty():
        central = cut(hot.groupBy("node").agg(F.sum("m").alias("weight")))
        used = None
        for _ in range(rounds):
            # one pair for each node, with the most central member of its buckets, and not one for each of its bands
            known = grouped(hot)
            free = known.join(central, "node")
            free = free if used is None else free.join(used, "node", "left_anti")
            tops = free.groupBy("key").agg(F.max_by(F.struct("weight", "node", "group"), F.struct("weight", "node")).alias("top"))
            pairs = known.join(tops, "key").where("group <> top.group").groupBy("node").agg(F.max(F.struct("top.weight", "top.node")).alias("top"))
            pairs = cut(pairs.select("node", F.col("top.node").alias("top")))
            tried = pairs.select(F.col("top").alias("node")).distinct()
            used = cut(tried if used is None else tried.union(used))
            pairs = _look_alike(pairs.select(F.least("node", "top").alias("a"), F.greatest("node", "top").alias("b")).distinct(), reps, lowest)
            new = verified(pairs, True)
            if edges is not None and new.isEmpty():
                break
            edges = new if edges is None else cut(edges.union(new))
            comp = connected_components(edges)
    rows = cut(grouped(rows))
    mixed = rows.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.count("*").alias("m")).where("low <> high").select("key", "m")
    rows = cut(rows.join(mixed, "key"))
    large = F.col("m") > min(most, LARGE)
    pairs = _met(rows.where(~large), reps, lowest)
    members = cut(rows.where(large).select("node", "group").distinct())
    if not members.isEmpty():
        pairs = cut(pairs.union(_look_alike(similar(members), reps, lowest)).distinct())
    return pairs, edges


def near_duplicates(docs: DataFrame, need: tuple[int, int] = (85, 100), size: int = 5, coords: int = 256, bands: int = 36, rows: int = 5, most: int = 48) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of (doc_id, text).

    Two documents are linked when need[1] x intersection >= need[0] x union of
    their word-shingle sets; component_id is the least doc_id reachable.
    Null, empty and word-less texts have no shingles and stand alone; rows of
    equal sets form one class and only its representative is compared;
    repeated rows come back repeated; a null doc_id counts as the least id
    and comes back null; columns besides doc_id and text are ignored.
    """
    whole = keyed(docs)
    seen = cut(features(whole, size, coords, bands, rows))
    classes = seen.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("node"))
    reps = seen.join(classes, (seen["cls"] == classes["cls"]) & (seen["doc_id"] == classes["node"])).select("node", "n", "sig", "bands").dropDuplicates(["node"])
    # five standard errors of the estimate below the threshold
    limit = need[0] / need[1]
    lowest = limit - 5 * (limit * (1 - limit) / coords) ** 0.5

    def verified(pairs: DataFrame, few: bool = False) -> DataFrame:
        pairs = cut(pairs.where((F.col("na") * need[1] >= F.col("nb") * need[0]) & (F.col("nb") * need[1] >= F.col("na") * need[0])).select("a", "b"))
        sets = cut(_sets(whole, pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), size))
        if few:
            out = cut(_verify(pairs, sets, need))
            discard(pairs, sets)
            return out
        # first one pair for each document; then only pairs that would still join two components
        first = cut(_verify(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), sets, need))
        comp = connected_components(first)
        of = lambda c, name: comp.select(F.col("node").alias(c), F.col("component").alias(name))
        open_pairs = pairs.join(of("a", "x"), "a", "left").join(of("b", "y"), "b", "left").where("coalesce(x, a) <> coalesce(y, b)").select("a", "b")
        out = cut(first.union(_verify(open_pairs.join(first, ["a", "b"], "left_anti"), sets, need)))
        discard(pairs, sets, first, comp)
        return out

    def similar(members: DataFrame) -> DataFrame:
        sets = cut(_sets(whole, members.select("node"), size))
        out = _rarest(members, sets, need)
        discard(sets)
        return out

    pairs, edges = candidates(reps, most, lowest, verified, similar)
    more = verified(pairs)
    comp = connected_components(more if edges is None else edges.union(more))
    member = classes.join(comp, "node", "left").select("cls", F.coalesce("component", "node").alias("component"))
    out = seen.join(member, "cls", "left").withColumn("component", F.coalesce("component", "doc_id"))
    return out.select(restore_id(), F.col("n").alias("n_shingles"), F.nullif("component", F.lit(NULL_ID)).alias("component_id"), (F.col("doc_id") == F.col("component")).alias("kept"))
