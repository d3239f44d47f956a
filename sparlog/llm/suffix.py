"""Repeated passages by enhanced suffix arrays.

Comparing every suffix of a corpus with every other in one place is what does
not scale, so suffixes meet in shards. Every ``length``-byte string names its
anchor, the least hash among its ``gram``-byte substrings, and equal strings
name equal anchors. What surrounds an anchor is its context:

1. Anchors are dealt out by gram. A context that a smaller document also has is
   repeated as a whole (D). One whose gram occurs in no other context repeats
   nothing. The rest may repeat in part (S).
2. The contexts of S anchors, dealt out by gram, form shards. In each, the
   suffixes of the contexts are sorted, a stack scan of the longest common
   prefixes gives the prefix intervals, and an interval whose suffixes differ
   in the byte before them is a maximal repeat, reported with all occurrences.
3. A gram with very many contexts (H) would make one shard too large: there
   every window is dealt out by its own hash and takes the least document by a
   map-side combined minimum.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, keyed, partitions, restore_id, stored

HOT_IN_BATCH, HOT = 128, 20_000

_B = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_M = np.uint64(0xD6E8FEB86659FD93)
_BYTE = np.random.default_rng(50_021).integers(1, 2**63, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M
    x = (x ^ (x >> np.uint64(32))) * _M
    return x ^ (x >> np.uint64(32))


class Hashes:
    """Hashes of any substrings of a byte array: differences of prefix sums, moved to a common origin."""

    _up = np.ones(1, np.uint64)
    _down = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data)
        if len(Hashes._up) <= n:
            size = max(n + 1, 2 * len(Hashes._up))
            for name, base in (("_up", _B), ("_down", _INV)):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                setattr(Hashes, name, np.multiply.accumulate(p))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * Hashes._up[:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * Hashes._down[start] + (end - start).astype(np.uint64))


def anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, gram hash, context hash) of the anchors of a text's ``length``-byte strings."""
    n, width = len(data), length - gram + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    h = Hashes(data)
    at = np.arange(n - gram + 1)
    g = h(at, at + gram)
    low = np.concatenate([sliding_window_view(g[a : a + 65_536 + width - 1], width).argmin(axis=1) + a for a in range(0, n - length + 1, 65_536)])
    low += np.arange(n - length + 1) - np.repeat(np.arange(0, n - length + 1, 65_536), np.minimum(65_536, n - length + 1 - np.arange(0, n - length + 1, 65_536)))
    p = low[np.concatenate([[True], low[1:] != low[:-1]])]
    left, right = np.minimum(p, width - 1), np.minimum(n - p, length)
    return p, g[p], mix(h(p - left, p + right) + (left * 256 + right).astype(np.uint64))


def _bytes(t: str | None) -> np.ndarray:
    return np.frombuffer((t or "").encode("utf-8", "surrogatepass"), np.uint8)


_ANCHORS = "bucket int, docs binary, counts binary, kg binary, c32 binary, c16 binary, pos binary, hot binary"
_MARKED = "doc_id long, pos binary, flag binary"


def _pack(bucket: int, doc: np.ndarray, kg, ctx, pos, hot) -> tuple:
    """Entries of one bucket, in order of (doc, pos)."""
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    return (bucket, doc[first].tobytes(), np.diff(np.append(first, len(doc))).astype(np.uint32).tobytes(), kg.astype(np.uint32).tobytes(), ctx.astype(np.uint32).tobytes(), (ctx >> np.uint64(32)).astype(np.uint16).tobytes(), pos.astype(np.uint32).tobytes(), hot.astype(np.uint64).tobytes())


def _anchor_rows(docs: DataFrame, length: int, gram: int, buckets: int) -> DataFrame:
    """One row for each (group of documents, bucket), and rows of bucket -1 with what is decided within the group.

    Within a group, a context is sent for its least document only; the others
    are D. A gram with many contexts is not sent at all, only named: its
    anchors are H.
    """

    def flush(ids, places, grams, ctxs):
        doc = np.repeat(np.asarray(ids, np.int64), [len(p) for p in places])
        pos, kg, ctx = np.concatenate(places), np.concatenate(grams), np.concatenate(ctxs)
        order = np.lexsort((pos, doc, ctx, kg))
        doc, pos, kg, ctx = doc[order], pos[order], kg[order], ctx[order]
        new_kg = np.concatenate([[True], kg[1:] != kg[:-1]])
        new = new_kg | np.concatenate([[True], ctx[1:] != ctx[:-1]])
        first = doc[np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))]
        many = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_kg))
        hot = np.repeat(many > HOT_IN_BATCH, np.diff(np.append(np.flatnonzero(new_kg), len(kg))))
        flag = np.where(doc > first, ord("D"), np.where(hot, ord("H"), 0)).astype(np.uint8)
        known, hot_kg = flag > 0, kg[new_kg & hot]
        rows = []
        if known.any():
            o = np.lexsort((pos[known], doc[known]))
            d, p, f = doc[known][o], pos[known][o], flag[known][o]
            rows += [_pack(-1, d, f, np.zeros(len(d), np.uint64), p, np.zeros(0))]
        keep = ~known
        doc, pos, kg, ctx = doc[keep], pos[keep], kg[keep], ctx[keep]
        to, hot_to = ((k >> np.uint64(32)) % np.uint64(buckets) for k in (kg, hot_kg))
        o = np.lexsort((pos, doc, to))
        doc, pos, kg, ctx, to = doc[o], pos[o], kg[o], ctx[o], to[o]
        cuts = np.searchsorted(to, np.arange(buckets + 1, dtype=np.uint64))
        for b in range(buckets):
            s = slice(cuts[b], cuts[b + 1])
            h = hot_kg[hot_to == b] & np.uint64(0xFFFFFFFF)
            if s.stop > s.start or len(h):
                rows.append(_pack(b, doc[s], kg[s], ctx[s], pos[s], h))
        cols = list(zip(*rows, strict=True))
        kinds = [pa.int32(), *[pa.binary()] * 7]
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in _ANCHORS.split(", ")])

    def work(batches):
        held: list[list] = [[], [], [], []]
        size = 0
        for b in batches:
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                found = anchors(_bytes(t), length, gram)
                if len(found[0]):
                    for into, x in zip(held, (d, *found), strict=True):
                        into.append(x)
                    size += len(found[0])
                    if size > 400_000:
                        yield flush(*held)
                        held, size = [[], [], [], []], 0
        if size:
            yield flush(*held)

    return docs.mapInArrow(work, _ANCHORS)


def _unpack(t: pa.Table) -> tuple[np.ndarray, ...]:
    def col(name, kind):
        return np.concatenate([np.frombuffer(x, kind) for x in t.column(name).to_pylist()] or [np.zeros(0, kind)])

    doc = np.repeat(col("docs", np.int64), col("counts", np.uint32))
    return doc, col("kg", np.uint32), col("c32", np.uint32).astype(np.uint64) | (col("c16", np.uint16).astype(np.uint64) << np.uint64(32)), col("pos", np.uint32), col("hot", np.uint64)


def _spans_of(doc: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of the runs of equal values."""
    if not len(doc):
        return []
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    return list(zip(first.tolist(), [*first[1:].tolist(), len(doc)], strict=True))


def _marked(doc: np.ndarray, pos: np.ndarray, flag: np.ndarray) -> pa.Table:
    o = np.lexsort((pos, doc))
    doc, pos, flag = doc[o], pos[o].astype(np.uint32), flag[o]
    spans = _spans_of(doc)
    return pa.table({"doc_id": pa.array([int(doc[a]) for a, _ in spans], pa.int64()), "pos": pa.array([pos[a:b].tobytes() for a, b in spans], pa.binary()), "flag": pa.array([flag[a:b].tobytes() for a, b in spans], pa.binary())})


def mark_anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc_id, pos, flag): packed anchor places of every document that are D, S or H; a document may have several rows."""
    buckets = partitions(docs.sparkSession)

    def judge(t: pa.Table) -> pa.Table:
        if t.num_rows and t.column("bucket")[0].as_py() < 0:
            doc, flag, _, pos, _ = _unpack(t)
            return _marked(doc, pos, flag.astype(np.uint8))
        doc, kg, ctx, pos, hot = _unpack(t)
        if not len(doc):
            return _marked(doc, pos, np.zeros(0, np.uint8))
        o = np.lexsort((pos, doc, ctx, kg))
        doc, kg, ctx, pos = doc[o], kg[o], ctx[o], pos[o]
        new_kg = np.concatenate([[True], kg[1:] != kg[:-1]])
        new = new_kg | np.concatenate([[True], ctx[1:] != ctx[:-1]])
        first = doc[np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))]
        begin = np.flatnonzero(new_kg)
        contexts = np.repeat(np.add.reduceat(new.astype(np.int64), begin), np.diff(np.append(begin, len(kg))))
        named = np.isin(kg, hot.astype(np.uint32))
        flag = np.where(doc > first, ord("D"), np.where(named | (contexts > HOT), ord("H"), np.where(contexts > 1, ord("S"), 0))).astype(np.uint8)
        return _marked(doc[flag > 0], pos[flag > 0], flag[flag > 0])

    rows = _anchor_rows(docs, length, gram, buckets)
    # what a group has decided by itself is not one bucket: it is dealt out at random
    rows = rows.withColumn("deal", F.when(F.col("bucket") < 0, -1 - F.pmod(F.xxhash64("docs"), F.lit(buckets))).otherwise(F.col("bucket").cast("long")))
    return cut(rows.groupBy("deal").applyInArrow(judge, _MARKED))


def _of_document(packed: list[dict] | None) -> tuple[np.ndarray, np.ndarray]:
    if not packed:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    return np.concatenate([np.frombuffer(x["pos"], np.uint32) for x in packed]).astype(np.int64), np.concatenate([np.frombuffer(x["flag"], np.uint8) for x in packed])


_CONTEXTS = "kind string, k1 long, k2 long, doc_id long, start int, lead int, body binary"


def _contexts(docs: DataFrame, marks: DataFrame, length: int, gram: int) -> DataFrame:
    """S rows: context bytes by gram; H rows: window hashes of hot contexts."""
    width = length - gram + 1

    def work(batches):
        for b in batches:
            out: list[tuple] = []
            for d, t, m in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("marks").to_pylist(), strict=True):
                pos, flag = _of_document(m)
                data = _bytes(t)
                n, h = len(data), None
                raw = data.tobytes()
                s = pos[flag == ord("S")]
                if len(s):
                    h = Hashes(data)
                    for p, g in zip(s.tolist(), h(s, s + gram).view(np.int64).tolist(), strict=True):
                        left = min(p, width - 1)
                        out.append(("S", g, 0, d, p - left, left, raw[p - left : p + length]))
                hot = pos[flag == ord("H")]
                if len(hot):
                    h = h or Hashes(data)
                    w = np.unique((hot[:, None] - np.arange(width)[None, :]).ravel())
                    w = w[(w >= 0) & (w + length <= n)]
                    k1 = h(w, w + length)
                    k2 = mix(h(w, w + length // 2) ^ (h(w + length // 3, w + length) * _M))
                    out += [("H", a, c, d, p, 0, None) for a, c, p in zip(k1.view(np.int64).tolist(), k2.view(np.int64).tolist(), w.tolist(), strict=True)]
                if len(out) > 100_000:
                    yield _context_batch(out)
                    out = []
            yield _context_batch(out)

    of_doc = marks.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "flag")).alias("marks"))
    return docs.join(of_doc, "doc_id").mapInArrow(work, _CONTEXTS)


def _context_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    cols = list(zip(*rows, strict=True)) or [[]] * 7
    return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in _CONTEXTS.split(", ")])


def lcp_intervals(lcp: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(length, first, last) of every interval of the sorted suffixes whose common prefix reaches ``least``: one stack scan.

    ``lcp[i]`` is the common prefix of suffixes i - 1 and i.
    """
    out, stack = [], []  # (length, first)
    for i in np.flatnonzero((lcp >= least) | np.concatenate([[False], lcp[:-1] >= least])).tolist():
        v, first = int(lcp[i]), i - 1
        while stack and stack[-1][0] > v:
            n, first = stack.pop()
            out.append((n, first, i - 1))
        if v >= least and (not stack or stack[-1][0] < v):
            stack.append((v, first))
    while stack:
        n, first = stack.pop()
        out.append((n, first, len(lcp) - 1))
    return out


def maximal_repeats(body: list[bytes], doc: np.ndarray, start: np.ndarray, length: int):
    """Enhanced suffix array of the given contexts: yields (length, suffix indices) of every left-diverse prefix interval.

    The first item yielded is (doc, start) of the suffixes in sorted order.
    What stands before a context is not in the shard, so its first suffix
    differs from everything on the left: the repeat goes on in the contexts of
    earlier anchors. Prefixes of ``length`` bytes are told apart by their hash,
    in whose order the array is; a prefix that one document alone has, or that
    the same byte always precedes, gives no interval and is left out before
    the suffixes are sorted by what follows it.
    """
    size = np.asarray([len(x) for x in body], np.int64)
    text = np.frombuffer(b"".join(body) + bytes(2 * length), np.uint8)
    base = np.concatenate([[0], np.cumsum(size)[:-1]])
    count = np.maximum(size - length + 1, 0)
    ctx = np.repeat(np.arange(len(body)), count)
    off = np.arange(len(ctx)) - np.repeat(np.cumsum(count) - count, count)
    at = base[ctx] + off
    if not len(at):
        yield doc[:0], start[:0]
        return
    h = Hashes(text)
    key = h(at, at + length)
    before = np.where(off > 0, text[np.maximum(at - 1, 0)].astype(np.int64), -1)
    order = np.argsort(key)
    key, own, left = key[order], doc[ctx[order]], before[order]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    low = np.minimum.reduceat(left, begin)
    good = (np.minimum.reduceat(own, begin) < np.maximum.reduceat(own, begin)) & ((low < 0) | (low < np.maximum.reduceat(left, begin)))
    group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(key))))
    keep = good[group]
    order, group = order[keep], group[keep]
    ctx, off, at, before = ctx[order], off[order], at[order], before[order]
    wide = -(-(length - 1) // 8) * 8
    room = np.minimum(base[ctx] + size[ctx] - at - length, wide)
    grid = text[np.minimum(at[:, None] + length + np.arange(wide)[None, :], len(text) - 1)]
    grid = np.where(np.arange(wide)[None, :] < room[:, None], grid, 0).astype(np.uint8)
    words = np.ascontiguousarray(grid).view(">u8").astype(np.uint64)
    used = max(1, -(-int(room.max(initial=0)) // 8))
    order = np.lexsort((room, *[words[:, k] for k in range(used)][::-1], group))
    ctx, off, at, before, room, group, grid = ctx[order], off[order], at[order], before[order], room[order], group[order], grid[order]
    lcp = np.zeros(len(at), np.int64)
    if len(at) > 1:
        differ = grid[1:] != grid[:-1]
        more = np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), wide), np.minimum(room[1:], room[:-1]))
        lcp[1:] = np.where(group[1:] == group[:-1], length + more, 0)
    yield doc[ctx], start[ctx] + off
    change = np.concatenate([[0], np.cumsum((before[1:] != before[:-1]) | (before[1:] < 0))]) if len(at) else np.zeros(0, np.int64)
    for n, a, b in lcp_intervals(lcp, length):
        if change[b] > change[a]:
            yield n, (a, b)


def _shard(mode: str, length: int):
    """Of one shard: "cover" gives what smaller documents have, "groups" the maximal repeats with all occurrences."""

    def work(t: pa.Table) -> pa.Table:
        gram = t.column("k1").to_numpy()
        order = np.argsort(gram, kind="stable")
        edge = np.append(np.flatnonzero(np.concatenate([[True], gram[order][1:] != gram[order][:-1]])), len(gram))
        parts, at = [], 0
        while at < len(edge) - 1:  # whole grams together, as few contexts at once as that allows
            to = max(at + 1, int(np.searchsorted(edge, edge[at] + 2_000, "right")) - 1)
            rows = t.take(pa.array(order[edge[at] : edge[to]]))
            found = maximal_repeats(rows.column("body").to_pylist(), rows.column("doc_id").to_numpy().astype(np.int64), rows.column("start").to_numpy().astype(np.int64), length)
            parts.append(_groups(found) if mode == "groups" else _cover(found))
            at = to
        return pa.concat_tables(parts) if parts else (_groups if mode == "groups" else _cover)(iter([(np.zeros(0, np.int64), np.zeros(0, np.int64))]))

    return work


def _groups(found) -> pa.Table:
    d, s = next(found)
    cols: list[list] = [[], [], [], []]
    for k, (n, (a, b)) in enumerate(found):
        cols[0] += [f"{n}:{int(d[a : b + 1].min())}:{int(s[a])}:{k}"] * (b - a + 1)
        cols[1] += [n] * (b - a + 1)
        cols[2] += d[a : b + 1].tolist()
        cols[3] += s[a : b + 1].tolist()
    return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["repeat", "length", "doc_id", "start"])


def _cover(found) -> pa.Table:
    d, s = next(found)
    reach = np.zeros(len(d), np.int64)
    for n, (a, b) in found:
        own = d[a : b + 1]
        part = reach[a : b + 1]
        np.maximum(part, np.where(own > own.min(), n, 0), out=part)
    hit = reach > 0
    d, s, e = d[hit], s[hit], s[hit] + reach[hit]
    o = np.lexsort((s, d))
    d, s, e = d[o], s[o], e[o]
    spans = _spans_of(d)
    packed = [np.stack(runs_of(s[a:b], e[a:b])).astype(np.uint32).tobytes() for a, b in spans]
    return pa.table({"doc_id": pa.array([int(d[a]) for a, _ in spans], pa.int64()), "runs": pa.array(packed, pa.binary())})


def runs_of(s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of [s, e) ranges."""
    if not len(s):
        return s, e
    o = np.argsort(s, kind="stable")
    s, top = s[o], np.maximum.accumulate(e[o])
    new = np.concatenate([[True], s[1:] > top[:-1]])
    return s[new], top[np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)]


def repeat_groups(docs: DataFrame, length: int = 50, gram: int = 20) -> DataFrame:
    """(repeat, length, doc_id, start): maximal repeats within contexts that are not whole copies, with all occurrences."""
    whole = keyed(docs)
    rows = stored(_contexts(whole, mark_anchors(whole, length, gram), length, gram), "contexts")
    shards = 4 * partitions(docs.sparkSession)
    return rows.where("kind = 'S'").withColumn("shard", F.pmod("k1", F.lit(shards))).groupBy("shard").applyInArrow(_shard("groups", length), "repeat string, length int, doc_id long, start long")


def repeated_bytes(docs: DataFrame, length: int = 50, gram: int = 20) -> DataFrame:
    """For every row of (doc_id, text): the bytes covered by ``length``-byte strings that a smaller doc_id also has.

    Returns doc_id, n_bytes, n_removed, n_spans, runs (flat start, end of the
    removed runs), kept_sha256. Texts are UTF-8 bytes; null and short texts
    lose nothing; strings are judged on the input; occurrences inside one
    document do not count against it; rows that repeat a doc_id share their
    result; a null doc_id is the smallest and comes back null; columns besides
    these are ignored.
    """
    whole = keyed(docs)
    marks = mark_anchors(whole, length, gram)
    rows = stored(_contexts(whole, marks, length, gram), "contexts")
    shards = 4 * partitions(docs.sparkSession)
    partly = rows.where("kind = 'S'").withColumn("shard", F.pmod("k1", F.lit(shards))).groupBy("shard").applyInArrow(_shard("cover", length), "doc_id long, runs binary")
    hot = rows.where("kind = 'H'").select("k1", "k2", "doc_id", "start")
    least = hot.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    again = hot.join(least, ["k1", "k2"]).where("doc_id > first").select("doc_id", "start")
    cover = partly.groupBy("doc_id").agg(F.collect_list("runs").alias("runs"))
    windows = again.groupBy("doc_id").agg(F.collect_set("start").alias("windows"))
    of_doc = marks.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "flag")).alias("marks"))
    width = length - gram + 1

    def finish(batches):
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for t, m, runs, win in zip(*(b.column(c).to_pylist() for c in ("text", "marks", "runs", "windows")), strict=True):
                data = _bytes(t)
                pos, flag = _of_document(m)
                p = pos[flag == ord("D")]
                parts = [np.frombuffer(x, np.uint32).astype(np.int64).reshape(2, -1) for x in runs or []]
                w = np.asarray(win or [], np.int64)
                s = np.concatenate([np.maximum(p - width + 1, 0), w, *(x[0] for x in parts)])
                e = np.concatenate([np.minimum(p + length, len(data)), w + length, *(x[1] for x in parts)])
                s, e = runs_of(s, e)
                keep = np.ones(len(data), bool)
                for x, y in zip(s.tolist(), e.tolist(), strict=True):
                    keep[x:y] = False
                out[0].append(len(data))
                out[1].append(int((e - s).sum()))
                out[2].append(len(s))
                out[3].append(np.stack([s, e], axis=1).ravel().tolist())
                out[4].append(hashlib.sha256(data[keep].tobytes()).hexdigest())
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.string())
            yield pa.record_batch([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "runs", "kept_sha256"])

    joined = whole.join(of_doc, "doc_id", "left").join(cover, "doc_id", "left").join(windows, "doc_id", "left")
    out = joined.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, runs array<int>, kept_sha256 string")
    return out.select(restore_id(), "n_bytes", "n_removed", "n_spans", "runs", "kept_sha256")
