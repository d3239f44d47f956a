"""Benchmark decontamination with suffix arrays over the training text.

Every Arrow batch of documents is a shard. Its words become integers (words
that no benchmark item has are 0, which also ends a document), a suffix array
over its word positions is sorted, and every benchmark suffix is found in it
by binary search. Nothing is shuffled; the benchmark is broadcast in blocks of
a bounded size.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_STATE = "doc_id long, text string, n_words long, hits array<int>, items array<string>, longest int, longest_item string, longest_at int, longest_item_at int"
_FINAL = ", n_hit long, items_sha256 string, contaminated boolean"


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: ASCII letters lower-cased, runs of digits, a-z and non-ASCII characters."""
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


class _Windows:
    """A block of the benchmark: vocabulary, distinct windows and the items that hold each."""

    def __init__(self, items: list[tuple[str, str | None]], size: int):
        self.size, self.vocab = size, {}
        owners: dict[tuple, set[tuple[str, int]]] = {}
        for item, text in items:
            ids = tuple(self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text))
            n = min(size, len(ids))
            for i in range(len(ids) - n + 1 if n else 0):
                owners.setdefault(ids[i : i + n], set()).add((item, i))
        self.windows = sorted(owners)
        self.places = [sorted(owners[w]) for w in self.windows]  # (item, place in it)
        self.lengths = np.asarray([len(w) for w in self.windows], dtype=np.int64)
        grid = np.zeros((len(self.windows), size), dtype=">u4")
        for k, w in enumerate(self.windows):
            grid[k, : len(w)] = w
        self.low = _keys(grid)
        self.high = _keys(np.where(np.arange(size)[None, :] < self.lengths[:, None], grid, np.uint32(0xFFFFFFFF)))
        self.ones = np.unique(grid[self.lengths == 1, 0]).astype(np.int64)
        base = len(self.vocab) + 1
        pair = lambda k, at: np.unique(grid[k, at].astype(np.int64) * base + grid[k, at + 1])
        self.base, two, four = base, self.lengths >= 2, self.lengths >= 4
        self.pairs = pair(two, 0) if size > 1 else np.zeros(0, np.int64)
        self.short_pairs = pair(two & ~four, 0) if size > 1 else np.zeros(0, np.int64)
        self.next_pairs = pair(four, 2) if size > 3 else self.pairs


def _keys(grid: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(grid.astype(">u4")).view(f"S{4 * grid.shape[1]}").ravel()


def _within(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    k = np.searchsorted(ordered, values)
    return ordered[np.minimum(k, len(ordered) - 1)] == values


def suffix_array(ids: np.ndarray, bench: _Windows) -> tuple[np.ndarray, np.ndarray]:
    """(positions, keys) of the suffixes, in order, that may begin a window; keys are their first ``size`` words.

    Suffixes whose first words begin no window can match none and are left out.
    """
    padded = np.concatenate([ids, np.zeros(bench.size + 4, ids.dtype)]).astype(np.int64)
    n = len(ids)
    pairs = padded[:-1] * bench.base + padded[1:]
    keep = _within(padded[:n], bench.ones)
    rest = np.flatnonzero(_within(pairs[:n], bench.pairs))
    short = _within(pairs[rest], bench.short_pairs)
    keep[rest[short | _within(pairs[rest + 2], bench.next_pairs)]] = True
    at = np.flatnonzero(keep)
    keys = _keys(padded[at[:, None] + np.arange(bench.size)[None, :]]) if len(at) else np.zeros(0, f"S{4 * bench.size}")
    order = np.argsort(keys, kind="stable")
    return at[order], keys[order]


def _scan(block: list[tuple[str, list[bytes]]], bench: _Windows) -> list[tuple]:
    """For each document of the block: hit word runs (flat start, end), items, longest match (words, item, place, place in the item)."""
    counts = np.asarray([len(w) for w in block], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(counts + 1)])
    get = bench.vocab.get
    ids = np.zeros(int(starts[-1]), dtype=np.int64)
    for k, words in enumerate(block):
        ids[starts[k] : starts[k] + counts[k]] = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
    at, keys = suffix_array(ids, bench)
    lo, hi = np.searchsorted(keys, bench.low, "left"), np.searchsorted(keys, bench.high, "right")
    found = [([], set(), (0, None, -1, -1)) for _ in block]
    hits: dict[int, list[tuple[int, int]]] = {}
    for w in np.flatnonzero(hi > lo):
        where = at[lo[w] : hi[w]]
        for p, k in zip(where.tolist(), (np.searchsorted(starts, where, "right") - 1).tolist(), strict=True):
            hits.setdefault(k, []).append((p - int(starts[k]), int(w)))
    for k, places in hits.items():
        runs, items, best = [], set(), (0, None, -1, -1)
        live: dict[tuple[str, int], tuple[int, int]] = {}  # (item, place there) -> place here and where that match began
        for p, w in sorted(places):
            end = p + int(bench.lengths[w])
            if runs and p <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], end)
            else:
                runs.append([p, end])
            for item, i in bench.places[w]:
                last = live.get((item, i - 1))  # a match goes on where it is next here and in the item
                begin = last[1] if last and last[0] == p - 1 else p
                live[item, i] = (p, begin)
                items.add(item)
                if end - begin > best[0]:
                    best = (end - begin, item, begin, i - (p - begin))
        found[k] = ([x for r in runs for x in r], items, best)
    return found


def match(docs: DataFrame, benchmark: DataFrame, window: int = 13, shard_words: int = 2_000_000, block_bytes: int = 16 << 20) -> DataFrame:
    """Verbatim benchmark matches of every document.

    ``docs``: (doc_id, text); ``benchmark``: (item_id, text). Returns doc_id,
    text, n_words, hits (flat word runs start, end), n_hit, items (sorted),
    longest, longest_item, longest_at and longest_item_at (words of the longest
    verbatim match of a window or more, its item and its places here and
    there), contaminated (n_hit > 0 and 20 n_hit >= n_words). Null texts have no words; items without words match
    nothing; ties for the longest match go to the earliest place; repeated
    rows give repeated results; an empty table gives no rows, and with an empty
    benchmark nothing is hit; columns besides these are ignored.

    The benchmark is read in blocks of at most about ``block_bytes`` of text,
    each broadcast on its own, so its size is not bounded by one task.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    state = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), F.lit(0).cast("long").alias("n_words"), F.array().cast("array<int>").alias("hits"), F.array().cast("array<string>").alias("items"), F.lit(0).alias("longest"), F.lit(None).cast("string").alias("longest_item"), F.lit(-1).alias("longest_at"), F.lit(-1).alias("longest_item_at"))
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        shared = spark.sparkContext.broadcast(_Windows([(r[0], r[1]) for r in part.collect()], window))  # a block of bounded size
        last = b == blocks - 1
        state = state.mapInArrow(_step(shared, shard_words, last), _STATE + _FINAL if last else _STATE)
        if not last:
            state = cut(state)  # one block at a time in a worker's memory
    return state


def _step(shared, shard_words: int, last: bool):
    def work(batches):
        bench = shared.value
        for b in batches:
            rows = b.to_pydict()
            n, at = b.num_rows, 0
            while at < n:
                block, size = [], 0
                begin = at
                while at < n and (not block or size < shard_words):
                    block.append(words_of(rows["text"][at]))
                    rows["n_words"][at] = len(block[-1])
                    size += len(block[-1])
                    at += 1
                for k, (runs, items, best) in enumerate(_scan(block, bench), begin):
                    if runs:
                        rows["hits"][k] = rows["hits"][k] + runs
                        rows["items"][k] = rows["items"][k] + sorted(items)
                        if best[0] > rows["longest"][k]:
                            rows["longest"][k], rows["longest_item"][k], rows["longest_at"][k], rows["longest_item_at"][k] = best
            yield _batch(_finish(rows) if last else rows)

    return work


def _batch(rows: dict) -> pa.RecordBatch:
    kinds = {"doc_id": pa.int64(), "text": pa.string(), "hits": pa.list_(pa.int32()), "items": pa.list_(pa.string()), "longest": pa.int32(), "longest_item": pa.string(), "longest_at": pa.int32(), "longest_item_at": pa.int32(), "n_words": pa.int64(), "n_hit": pa.int64(), "items_sha256": pa.string(), "contaminated": pa.bool_()}
    return pa.record_batch([pa.array(v, kinds[k]) for k, v in rows.items()], names=list(rows))


def merge_runs(flat: list[int]) -> list[int]:
    out: list[int] = []
    for s, e in sorted(zip(flat[::2], flat[1::2], strict=True)):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def _finish(rows: dict) -> dict:
    rows["hits"] = [merge_runs(h) if h else h for h in rows["hits"]]
    rows["items"] = [sorted(set(i)) for i in rows["items"]]
    rows["n_hit"] = [sum(h[1::2]) - sum(h[::2]) for h in rows["hits"]]
    rows["items_sha256"] = [hashlib.sha256(",".join(i).encode()).hexdigest() for i in rows["items"]]
    rows["contaminated"] = [h > 0 and 20 * h >= n for h, n in zip(rows["n_hit"], rows["n_words"], strict=True)]
    return rows


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """(doc_id, text) of the documents that ``match`` does not call contaminated."""
    return match(docs, benchmark, window).where(~F.col("contaminated")).select("doc_id", "text")
