"""Best-fit packing of tokenised documents by bin completion.

The whole corpus is reduced to a histogram of piece lengths, which has at most
``capacity`` rows whatever the corpus. Bin completion is solved on that
histogram and gives filling patterns with multiplicities; Spark then deals the
pieces into the patterns' places by their rank among pieces of equal length.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import NULL_ID, cut, keyed

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Fixed value: how byte-level BPE splits a text.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The faster encoder runs out of stack in white space of some hundred thousand characters.
_LONG_RUN = re.compile(r"\s{1000}")
_CACHE: dict[str, _Encoder] = {}


class _Encoder:
    """Ids of a text under the tokenizer file at ``path``, as little-endian uint32 bytes.

    A plain byte-level BPE file is read as ranks, which another encoder of the
    same vocabulary applies several times faster; any other file, and texts
    with very long runs of white space, go through the tokenizer itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            self.fast = _byte_bpe(json.load(f))

    def __call__(self, text: str) -> bytes:
        if self.fast is None or _LONG_RUN.search(text):
            ids = self.tok.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return array("I", ids).tobytes()


def _byte_bpe(spec: dict):
    """An encoder for a byte-level BPE file whose ids follow the order of its merges; None for any other file."""
    import tiktoken

    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("merges") is None or spec.get("normalizer") or (before.get("type"), before.get("add_prefix_space"), before.get("use_regex")) != ("ByteLevel", False, True):
        return None
    if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    vocab = {w: i for w, i in model["vocab"].items() if w not in special}
    merged = ("".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"])
    if any(vocab.get(w) != 256 + i for i, w in enumerate(merged)) or len(vocab) != 256 + len(model["merges"]):
        return None
    return tiktoken.Encoding("ranks", pat_str=_SPLIT, mergeable_ranks={bytes(byte_of[c] for c in w): i for w, i in vocab.items()}, special_tokens={})


def _encoder(path: str) -> _Encoder:
    if path not in _CACHE:
        _CACHE[path] = _Encoder(path)
    return _CACHE[path]


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32.

    A document is its ids followed by ``end_id``; only one longer than
    ``capacity`` is cut, from its end, so that all but the first piece are
    full. A null text is an empty one. Repeated rows give repeated pieces.
    """

    def work(batches):
        enc = _encoder(tokenizer_path)
        end = array("I", [end_id]).tobytes()
        for b in batches:
            out: list[tuple] = []
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = enc(t or "") + end
                n = len(ids) // 4
                at, size = 0, (n - 1) % capacity + 1
                for k in range((n - 1) // capacity + 1):
                    out.append((d, k, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])))
                    at, size = at + size, capacity
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return keyed(docs).mapInArrow(work, _PIECES)


#: A filling: (length, copies) runs in falling order of length.
Filling = tuple[tuple[int, int], ...]


@dataclass
class Plan:
    """(times, filling) patterns that use up a histogram; no packing has fewer than ``bound`` bins."""

    patterns: list[tuple[int, Filling]]
    bins: int
    bound: int


def least_bins(counts: np.ndarray, capacity: int) -> int:
    """Lower bound on the bins (Martello and Toth's L2): for every a up to half the capacity, pieces over capacity - a stand
    alone, pieces over half need a bin each, and what pieces of a or more cannot fill of those needs further bins."""
    size = np.arange(capacity + 1)
    n, mass = np.cumsum(counts), np.cumsum(counts * size)
    if not n[-1]:
        return 0
    a = np.arange(capacity // 2 + 1)
    half = capacity // 2
    large = n[capacity] - n[half]  # longer than half: no two together
    medium, medium_mass = n[capacity - a] - n[half], mass[capacity - a] - mass[half]
    small = mass[half] - np.where(a > 0, mass[np.maximum(a - 1, 0)], 0)
    return int((large + np.maximum(0, -(-(small - (medium * capacity - medium_mass)) // capacity))).max())


def _sums(filling: Filling) -> tuple[int, int]:
    """Bit sets of the sums of any of a filling's pieces, and of two or more of them."""
    any_, two = 1, 0
    for n, k in filling:
        for _ in range(k):
            two |= two << n | (any_ & ~1) << n
            any_ |= any_ << n
    return any_, two


def _dominated(filling: Filling, waste: int, others: int) -> bool:
    """Whether one of the lengths in the bit set ``others`` could take the place of some of the filling's pieces and use the bin
    as well or better: it is longer than their sum and fits, or equals the sum of two or more."""
    sums, two = _sums(filling)
    near, width = sums << 1 if waste else 0, 1
    while width < waste:
        step = min(width, waste - width)
        near |= near << step
        width += step
    return bool((near | two) & others)


class Budget:
    """Steps that a search may still take."""

    def __init__(self, steps: int):
        self.left = steps

    def spend(self) -> bool:
        self.left -= 1
        return self.left >= 0


def fillings(counts: np.ndarray, gap: int, budget: Budget) -> Iterator[Filling]:
    """Undominated fillings of ``gap`` with the lengths that ``counts`` holds, least waste first and then longest piece first; all
    of them, unless the budget ends.

    Bit sets of the sums that the shorter lengths can still make lead the
    search, so every branch ends in a filling of the waste in question. It
    takes a length with its number of copies at once: a million one-token
    pieces are one branch.
    """
    if gap <= 0:
        yield ()
        return
    if counts[gap]:  # fills the gap alone, which dominates all else
        yield ((gap, 1),)
        return
    lengths = np.flatnonzero(counts[: gap + 1]).tolist()
    full = (1 << (gap + 1)) - 1
    reach = [1]
    for n in lengths:
        r, left, step = reach[-1], min(int(counts[n]), gap // n), 1
        while left:
            step = min(step, left)
            r |= r << n * step
            left, step = left - step, 2 * step
        reach.append(r & full)
    have = sum(1 << n for n in lengths)
    for waste in range(gap + 1):
        if not reach[-1] >> (gap - waste) & 1:
            continue
        stack: list[tuple[int, int, Filling]] = [(len(lengths), gap - waste, ())]
        while stack:
            if not budget.spend():
                return
            i, room, chosen = stack.pop()
            if not room:
                used_up = sum(1 << n for n, k in chosen if counts[n] == k)
                if not _dominated(chosen, waste, have & ~used_up):
                    yield chosen
                continue
            n = lengths[i - 1]
            for k in range(min(room // n, int(counts[n])) + 1):  # the most copies are on top of the stack
                if reach[i - 1] >> (room - k * n) & 1:
                    stack.append((i - 1, room - k * n, (*chosen, (n, k)) if k else chosen))


def _with_top(top: int, filling: Filling) -> Filling:
    if filling and filling[0][0] == top:
        return ((top, filling[0][1] + 1), *filling[1:])
    return ((top, 1), *filling)


def _choices(counts: np.ndarray, capacity: int, budget: Budget) -> Iterator[tuple[int, Filling]]:
    """(times, pattern) for the bins of the largest piece; each pattern as often as the counts allow, and then less often."""
    top = int(np.flatnonzero(counts)[-1])
    rest = counts.copy()
    rest[top] -= 1
    for f in fillings(rest, capacity - top, budget):
        pattern = _with_top(top, f)
        most = min(int(counts[n]) // k for n, k in pattern)
        yield from ((t, pattern) for t in range(most, 0, -1))
        if sum(n * k for n, k in pattern) == capacity and len(f) <= 1 and sum(k for _, k in f) <= 1:
            return  # nothing is better than the one piece that fits exactly


def _best_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, Filling]]:
    """Largest piece first, each gap taken by the longest pieces that still fit."""
    left, plan = counts.copy(), []
    while left.any():
        room, pattern = capacity, []
        while room > 0 and len(fit := np.flatnonzero(left[: room + 1] - np.bincount([n for n, _ in pattern], [k for _, k in pattern], minlength=capacity + 1)[: room + 1])):
            n = int(fit[-1])
            k = min(room // n, int(left[n]))
            pattern.append((n, k))
            room -= n * k
        times = min(int(left[n]) // k for n, k in pattern)
        for n, k in pattern:
            left[n] -= times * k
        plan.append((times, tuple(pattern)))
    return plan


def plan_bins(histogram: dict[int, int], capacity: int, steps: int = 1_000_000) -> Plan:
    """Bin completion (Martello and Toth, Korf): the fewest bins for the histogram's pieces.

    Depth first: the largest piece left is completed by its undominated
    fillings in turn, in runs of equal bins, and the rest is packed in the same
    way. A branch is cut where its bins and the lower bound of what is left
    are no fewer than the incumbent has; the first incumbent is the best-fit
    packing. The search ends when the incumbent meets the lower bound, when all
    branches are done, or after ``steps`` steps; ``bins`` - ``bound`` then says
    how far from the least number the result may be at most.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for n, c in histogram.items():
        counts[n] = c
    best = _best_fit(counts, capacity)
    bins, bound = sum(t for t, _ in best), least_bins(counts, capacity)
    budget = Budget(steps)
    path: list[tuple[int, Filling]] = []
    stack = [(counts, 0, _choices(counts, capacity, budget))] if bins > bound else []
    seen: set[bytes] = set()
    while stack and budget.spend():
        left, used, choices = stack[-1]
        step = next(choices, None)
        if step is None:
            stack.pop()
            if path:
                path.pop()
            continue
        times, pattern = step
        then = left.copy()
        for n, k in pattern:
            then[n] -= times * k
        now = used + times
        if now + least_bins(then, capacity) >= bins:
            continue
        if not then.any():
            best, bins = [*path, step], now
            if bins == bound:
                break
            continue
        state = hashlib.blake2b(then.tobytes(), digest_size=16).digest() + now.to_bytes(8, "little")
        if state in seen:
            continue
        seen.add(state)
        path.append(step)
        stack.append((then, now, _choices(then, capacity, budget)))
    else:
        if not stack and budget.left > 0:
            bound = bins  # every branch is done
    return Plan(best, bins, bound)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, steps: int = 1_000_000) -> DataFrame:
    """Pack every document of (doc_id, text) into sequences of at most ``capacity`` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset for
    each piece, and sequences and least_sequences, the number of sequences and
    a lower bound of it. Null or empty texts are one-token pieces, equal
    lengths are dealt by (bucket, doc_id, piece), repeated rows are packed
    each, an empty table gives no rows, a text of any length is cut into
    pieces, and other columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    pieces = cut(tokenize_pieces(docs, tokenizer_path, capacity))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    plan = plan_bins(histogram, capacity, steps)
    rows, base, taken = [], 0, dict.fromkeys(histogram, 0)
    for times, pattern in plan.patterns:
        at = 0
        for n, k in pattern:
            rows.append((n, taken[n], taken[n] + times * k, k, base, at))
            taken[n] += times * k
            at += n * k
        base += times
    schema = T.StructType([T.StructField(x, T.LongType()) for x in ("length", "first", "last", "copies", "base", "offset")])
    places = spark.createDataFrame(rows, schema)  # a bin has at most 63 lengths up to 2048, and most patterns end a length
    # ranks among equal lengths, counted in buckets so that no length is one task
    buckets = max(16, sum(histogram.values()) // 1_000_000)
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = sizes.select("length", "bucket", (F.sum("n").over(W.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    ranked = dealt.withColumn("rank", F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start"))).join(before, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("rank") - 1 + F.col("before"))
    placed = ranked.alias("r").join(F.broadcast(places).alias("p"), F.expr("r.length = p.length and r.rank >= p.first and r.rank < p.last"))
    return placed.select(
        F.nullif(F.col("r.doc_id"), F.lit(NULL_ID)).alias("doc_id"), "piece", "start", F.col("r.length").alias("length"), "ids_crc32",
        F.expr("p.base + (r.rank - p.first) div p.copies").alias("sequence_id"), F.expr("p.offset + (r.rank - p.first) % p.copies * p.length").alias("offset"),
        F.lit(plan.bins).cast("long").alias("sequences"), F.lit(plan.bound).cast("long").alias("least_sequences"),
    )
