"""Prefix trie of conversations as a burst trie over shards.

A container holds the suffixes of the conversations under one trie head. Those
that are too large burst by the next turn id after all that their members have
in common, so that each burst branches; what is left is dealt to shards, where
each container is sorted and swept into nodes. Equal conversations are counted
first and go through as one; a suffix that is alone in its container is a chain
and needs no sweep. Heads take their sums from their children, the deepest
first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import cut, discard, partitions, stored

ROOT = b"\0" * 16
#: Joins on a conversation go by blocks of this many turns as well, so that one endless conversation is many keys.
BLOCK = 4096
#: Heads or sequences that a join may broadcast (some 20 MB).
MOST_BROADCAST = 200_000
#: A group of equal conversations above this share of all of them is joined by broadcast: there are at most 1 / HEAVY such groups.
HEAVY = 1e-4

_NODE = "head binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, turn_id binary, ended long"


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), turn_id, words, cum (words up to the turn) of every row of (conv_id, turn, role, text) with a conv_id.

    Rows are ranged over partitions by (conv_id, turn), numbered within them,
    and the few conversations that lie across partitions get offsets, so that
    no task needs to hold a conversation. The table is one of ``cut``.
    """
    role, text = (F.coalesce(conversations[c], F.lit("")) for c in ("role", "text"))
    rows = conversations.select(
        conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].cast("long").alias("turn"),
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))).alias("turn_id"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"), F.monotonically_increasing_id().alias("row"),
    ).where("conv_id is not null")
    n = partitions(conversations.sparkSession)
    ranged = rows.repartitionByRange(n, "conv_id", F.col("turn").asc_nulls_first(), "turn_id", "row").withColumn("part", F.spark_partition_id())
    here = W.partitionBy("part", "conv_id").orderBy(F.col("turn").asc_nulls_first(), "turn_id", "row")
    local = cut(ranged.select("conv_id", "part", "turn_id", "words", F.row_number().over(here).cast("long").alias("pos"), F.sum("words").over(here.rowsBetween(W.unboundedPreceding, 0)).alias("cum")))
    sums = local.groupBy("conv_id", "part").agg(F.max("pos").alias("n"), F.max("cum").alias("w"))
    before = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    # a partition goes on with at most one conversation of an earlier one: at most as many rows as partitions
    offsets = sums.select("conv_id", "part", F.sum("n").over(before).alias("n"), F.sum("w").over(before).alias("w")).where("n is not null")
    out = local.join(F.broadcast(offsets), ["conv_id", "part"], "left")
    out = cut(out.select("conv_id", (F.col("pos") + F.coalesce("n", F.lit(0))).alias("pos"), "turn_id", "words", (F.col("cum") + F.coalesce("w", F.lit(0))).alias("cum")))
    discard(local)
    return out


def _blocks(rows: DataFrame, low: str, high: str) -> DataFrame:
    """A row for each block of turns from ``low`` to ``high``."""
    return rows.withColumn("block", F.explode(F.expr(f"sequence(({low}) div {BLOCK}, ({high}) div {BLOCK})")))


def _in_blocks(turns: DataFrame) -> DataFrame:
    return turns.withColumn("block", F.expr(f"pos div {BLOCK}"))


def with_heads_of_others(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) with beginnings taken over: conversation c begins with the first h turns of c - c % ``every``, then its own after its first h.

    h is the unsigned CRC of c in decimal modulo ``most``. The second table has
    every conv_id, those without turns too.
    """
    lengths = turns.groupBy("conv_id").agg(F.max("pos").alias("len"), *(F.coalesce(F.max(F.when(F.col("pos") == k, F.col("cum"))), F.lit(0)).alias(f"w{k}") for k in range(1, most)))
    sums = F.array(F.lit(0).cast("long"), *(F.col(f"w{k}") for k in range(1, most)))
    lengths = cut(lengths.select("conv_id", "len", sums.alias("sums"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base")))
    bases = lengths.select(F.col("conv_id").alias("base"), F.col("len").alias("base_len"), F.col("sums").alias("base_sums"))
    convs = lengths.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_len", F.lit(0))))
    new_words = F.when(F.col("taken") > 0, F.get("base_sums", F.col("taken").cast("int"))).otherwise(0)
    convs = convs.select("conv_id", "len", "h", "base", "taken", (new_words - F.when(F.col("len") > F.col("h"), F.get("sums", F.col("h").cast("int"))).otherwise(0)).alias("shift"))
    convs = cut(convs)
    firsts = turns.where(f"pos < {most} and conv_id % {every} = 0").withColumnRenamed("conv_id", "base")
    heads = firsts.join(convs.select("conv_id", "base", "taken"), "base").where("pos <= taken").select("conv_id", "pos", "turn_id", "words", "cum")
    own = _in_blocks(turns).join(_blocks(convs.where("len > h").select("conv_id", "len", "h", "taken", "shift"), "0", "len"), ["conv_id", "block"]).where("pos > h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "turn_id", "words", (F.col("cum") + F.col("shift")).alias("cum"))
    out = cut(heads.unionByName(own)), cut(convs.select("conv_id"))
    discard(lengths, convs)
    return out


def _small(side: DataFrame) -> DataFrame:
    """``side`` for a join: broadcast where it is counted and small."""
    return F.broadcast(side) if side.count() <= MOST_BROADCAST else side


@dataclass
class _Suffix:
    ids: list[bytes]
    words: list[int]
    conv: int
    n: int


def sweep(suffixes: list[_Suffix], depth: int) -> list[list]:
    """Nodes of one container whose head is at ``depth``: [conv, depth, parent's index, n, children, leaves, saved, turn id, ended, words]."""
    suffixes.sort(key=lambda s: s.ids)
    nodes: list[list] = []
    path: list[int] = []
    before: list[bytes] = []

    def close(down_to: int) -> None:
        while len(path) > down_to:
            node = nodes[path.pop()]
            node[5] = node[5] or 1
            node[6] += (node[3] - 1) * node[9]
            if path:
                top = nodes[path[-1]]
                top[0], top[3], top[4], top[5], top[6] = min(top[0], node[0]), top[3] + node[3], top[4] + 1, top[5] + node[5], top[6] + node[6]

    for s in suffixes:
        same = 0
        while same < len(before) and same < len(s.ids) and before[same] == s.ids[same]:
            same += 1
        close(same)
        for k in range(same, len(s.ids)):
            nodes.append([s.conv, depth + k + 1, path[-1] if path else -1, 0, 0, 0, 0, s.ids[k], None, s.words[k]])
            path.append(len(nodes) - 1)
        last = nodes[path[-1]]
        last[0], last[3], last[8] = min(last[0], s.conv), last[3] + s.n, s.conv
        before = s.ids
    close(0)
    return nodes


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Containers one after another from rows in order of (head, conv_id, pos)."""
    columns = [c.split() for c in _NODE.split(", ")]
    kinds = {"binary": pa.binary(), "long": pa.int64()}
    head, parent, depth, suffixes = None, None, 0, []

    def done():
        nodes = sweep(suffixes, depth)
        out = [(head, parent, x[0], x[1], nodes[x[2]][0] if x[2] >= 0 else None, *x[3:9]) for x in nodes]
        return pa.record_batch([pa.array(v, kinds[k]) for v, (_, k) in zip(zip(*out, strict=True), columns, strict=True)], names=[c for c, _ in columns])

    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("head", "parent", "start", "conv_id", "n", "turn_id", "words")), strict=True):
            if row[0] != head:
                if suffixes:
                    yield done()
                head, parent, depth, suffixes = *row[:3], []
            if not suffixes or suffixes[-1].conv != row[3]:
                suffixes.append(_Suffix([], [], row[3], row[4]))
            suffixes[-1].ids.append(row[5])
            suffixes[-1].words.append(row[6])
    if suffixes:
        yield done()


def burst_trie(turns: DataFrame, members: DataFrame, limit: int = 2_000) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends) of the prefix trie of conversations.

    ``turns``: (conv_id, pos, turn_id, words, cum) as ``numbered_turns`` gives
    them; ``members``: every conv_id once. nodes: conv_id (the smallest member)
    and depth, which name a node, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and turn_id of its last turn. ends: conv_id and depth of the
    node and ``member``, one row for each conversation.

    A container of more than ``limit`` turns bursts. Conversations without
    turns end at the root; a conversation that is a prefix of others ends at
    their node; equal ones end together; without conversations there is no
    root and both tables are empty. A burst is a round of Spark jobs over the
    oversized containers; their number is that of branchings in a row above
    containers that large.
    """
    each = turns.groupBy("conv_id").agg(F.expr("bit_xor(xxhash64(pos, turn_id))").alias("f"), F.expr("bit_xor(xxhash64(turn_id, pos, 1))").alias("g"), F.max("pos").alias("len"))
    each = cut(each)
    total, first = members.agg(F.count(F.lit(1)), F.min("conv_id")).first()
    groups = cut(each.groupBy("f", "g", "len").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n")))
    rows = _in_blocks(turns).join(_blocks(groups.select("conv_id", "len", "n"), "0", "len"), ["conv_id", "block"])
    rows = stored(rows.select("conv_id", "block", "pos", "turn_id", "words", "cum", "n", "len"), "trie-turns")
    child = lambda head: F.unhex(F.md5(F.concat(head, F.col("turn_id"))))
    live = cut(rows.where("pos = 1").select("conv_id", "n", "len", child(F.lit(ROOT)).alias("head"), F.lit(ROOT).alias("parent"), F.lit(0).cast("long").alias("start")))
    kept, waste, heads = [], [each, groups, rows], []
    while True:
        sizes = cut(live.groupBy("head").agg(F.count(F.lit(1)).alias("m"), F.sum(F.col("len") - F.col("start")).alias("size")))
        big = cut(sizes.where((F.col("m") > 1) & (F.col("size") > limit)).select("head", "m"))
        kept.append((live.join(_small(big), "head", "left_anti"), sizes))
        waste += [live, sizes, big]
        if big.isEmpty():
            break
        active = cut(live.join(_small(big), "head"))
        waste.append(active)
        suffix = rows.select("conv_id", "block", "pos", "turn_id").join(_blocks(active.select("conv_id", "head", "m", "start", "len"), "start", "len"), ["conv_id", "block"]).where("pos > start")
        # min and max of hashed ids, grouped by place, tell where not all members agree any more
        places = suffix.groupBy("head", "m", "pos").agg(F.min("turn_id").alias("low"), F.max("turn_id").alias("high"), F.count(F.lit(1)).alias("c"))
        common = places.where("low <> high or c < m").groupBy("head").agg((F.min("pos") - 1).alias("depth"))
        split = cut(active.join(_small(cut(common)), "head"))
        waste.append(split)
        heads.append(cut(split.groupBy("head", "parent", "start", "depth").agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.max(F.when(F.col("len") == F.col("depth"), F.col("conv_id"))).alias("ended"))))
        following = split.where("len > depth").select("conv_id", "n", F.col("len"), F.col("head").alias("parent"), F.col("depth").alias("start"), (F.col("depth") + 1).alias("pos"))
        following = rows.select("conv_id", "pos", "turn_id").join(following, ["conv_id", "pos"])
        live = cut(following.select("conv_id", "n", "len", child(F.col("parent")).alias("head"), "parent", "start"))
    settled = [a.join(b.select("head", "m"), "head") if b.count() > MOST_BROADCAST else a.join(F.broadcast(b.select("head", "m")), "head") for a, b in kept]
    all_settled = settled[0]
    for s in settled[1:]:
        all_settled = all_settled.unionByName(s)
    all_settled = cut(all_settled)
    waste.append(all_settled)
    together = rows.select("conv_id", "block", "pos", "turn_id", "words").join(_blocks(all_settled.where("m > 1"), "start", "len"), ["conv_id", "block"]).where("pos > start")
    together = together.select("head", "parent", "start", "conv_id", "pos", "n", "turn_id", "words").repartition(partitions(turns.sparkSession), "head").sortWithinPartitions("head", "conv_id", "pos")
    swept = stored(together.mapInArrow(_swept, _NODE), "trie-nodes")
    # chains: lone suffixes, and what the members of a burst container have in common
    alone = all_settled.where("m = 1").select("parent", "conv_id", "start", F.col("len").alias("depth"), F.col("n").alias("n_convs"), F.lit(0).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("below"), F.col("conv_id").alias("ended"))

    def chained(chains: DataFrame) -> DataFrame:
        """``chains`` (conv_id, start, depth, n_convs) with ``top``, the words up to the deepest node, and ``saved`` of the whole chain."""
        deep = rows.select("conv_id", F.col("pos").alias("depth"), F.col("cum").alias("top"))
        high = rows.select("conv_id", (F.col("pos") - 1).alias("start"), (F.col("cum") - F.col("words")).alias("bottom"))
        out = chains.join(deep, ["conv_id", "depth"]).join(high, ["conv_id", "start"])
        return out.withColumn("saved", F.col("below") + (F.col("n_convs") - 1) * (F.col("top") - F.col("bottom"))).drop("bottom")

    chains = [cut(chained(alone))]
    tops = swept.where("parent_conv_id is null").select("parent", "n_leaves", "saved_tokens")
    tops = tops.unionByName(chains[0].select("parent", "n_leaves", F.col("saved").alias("saved_tokens")))
    sums = cut(tops.groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below")))
    waste.append(sums)
    for level in reversed(heads):
        done = cut(chained(level.join(sums.withColumnRenamed("parent", "head"), "head")).select("head", *chains[0].columns))
        chains.append(done)
        waste += [level, done]
        own = done.groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("below"))
        sums = cut(sums.unionByName(own).groupBy("parent").agg(*(F.sum(c).alias(c) for c in ("n_children", "n_leaves", "below"))))
        waste.append(sums)
    waste += [swept, chains[0]]
    lists = chains[0]
    convs = None
    for c in chains[1:]:
        lists = lists.unionByName(c.drop("head"))
        names = c.select(F.col("head").alias("parent"), F.col("conv_id").alias("above"))
        convs = names if convs is None else convs.unionByName(names)
    pieces = _blocks(lists, "start + 1", "depth").join(rows.select("conv_id", "block", "pos", "turn_id", "words", "cum"), ["conv_id", "block"]).where("pos > start and pos <= depth")
    at_end = F.col("pos") == F.col("depth")
    pieces = pieces.select(
        "parent", "conv_id", F.col("pos").alias("depth"), F.when(F.col("pos") > F.col("start") + 1, F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(at_end, F.col("n_children")).otherwise(1).alias("n_children"), "n_leaves", (F.col("below") + (F.col("n_convs") - 1) * (F.col("top") - F.col("cum") + F.col("words"))).alias("saved_tokens"),
        "turn_id", F.when(at_end, F.col("ended")).alias("ended"),
    )
    nodes = swept.drop("head").unionByName(pieces)
    above = F.when(F.col("parent") == F.lit(ROOT), F.lit(first).cast("long"))
    if convs is not None:
        nodes = nodes.join(_small(cut(convs)), "parent", "left")
        above = F.coalesce(F.col("above"), above)
    nodes = cut(nodes.withColumn("parent_conv_id", F.coalesce("parent_conv_id", above)).drop("parent", "above"))
    of_root = sums.where(F.col("parent") == F.lit(ROOT)).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_children", "n_leaves", "below")))
    root = of_root.select(F.lit(first).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(total).cast("long").alias("n_convs"), "n_children", F.greatest("n_leaves", F.lit(1).cast("long")).alias("n_leaves"), F.col("below").alias("saved_tokens"), F.lit(None).cast("binary").alias("turn_id")).where(F.lit(total > 0))
    # conversations end where their group's sequence does
    places = nodes.where("ended is not null").select(F.col("ended").alias("first"), F.col("conv_id").alias("node"), "depth")
    known = groups.withColumnRenamed("conv_id", "first").join(places, "first").select("f", "g", "len", "node", "depth", "n")
    known = cut(known)
    often = known.where(F.col("n") > F.lit(max(1000.0, total * HEAVY))).drop("n")
    few = known.where(F.col("n") <= F.lit(max(1000.0, total * HEAVY))).drop("n")
    # groups of many members are few and go by broadcast, so that no key of the other join has many rows
    member = each.withColumnRenamed("conv_id", "member")
    by_many = member.join(F.broadcast(often), ["f", "g", "len"])
    by_few = member.join(F.broadcast(often), ["f", "g", "len"], "left_anti").join(few, ["f", "g", "len"])
    ends = by_many.unionByName(by_few).select(F.col("node").alias("conv_id"), "depth", "member")
    turnless = members.join(each.select("conv_id"), "conv_id", "left_anti").select(F.lit(first).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.col("conv_id").alias("member"))
    ends = cut(ends.unionByName(turnless))
    out = cut(nodes.drop("ended").unionByName(root))
    discard(*waste, nodes, known)
    return out, ends


def digests(ends: DataFrame) -> DataFrame:
    """conv_id, depth, ends_sha256: SHA-256 of each node's sorted members in decimal, comma-joined; members stream through and are never gathered."""

    def work(batches):
        key, sha, keys, found = None, None, [], []
        for b in batches:
            for conv, depth, member in zip(*(b.column(c).to_pylist() for c in ("conv_id", "depth", "member")), strict=True):
                if (conv, depth) != key:
                    if sha:
                        keys.append(key)
                        found.append(sha.hexdigest())
                    key, sha = (conv, depth), hashlib.sha256(str(member).encode())
                else:
                    sha.update(f",{member}".encode())
            if keys:
                yield _digest_batch(keys, found)
                keys, found = [], []
        if sha:
            yield _digest_batch([*keys, key], [*found, sha.hexdigest()])

    rows = ends.repartition(partitions(ends.sparkSession), "conv_id", "depth").sortWithinPartitions("conv_id", "depth", "member")
    return rows.mapInArrow(work, "conv_id long, depth long, ends_sha256 string")


def _digest_batch(keys: list[tuple[int, int]], found: list[str]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(found)], names=["conv_id", "depth", "ends_sha256"])


def conversation_trie(conversations: DataFrame, limit: int = 2_000, take_over: bool = False) -> DataFrame:
    """A row for each node of the prefix trie of ``conversations`` (conv_id, turn, role, text), as ``burst_trie``, with ends_sha256.

    With ``take_over``, conversations first begin with turns of others
    (``with_heads_of_others``). Turns are in order of turn, null first, then of
    a digest of role and text; a null role or text counts as empty; repeated
    rows are turns each; rows without a conv_id belong to no conversation and
    are left out; an empty table gives no rows; other columns, whatever their
    names, are ignored; texts enter as digests and numbers of words, however
    long.
    """
    turns = numbered_turns(conversations)
    if take_over:
        before = turns
        turns, members = with_heads_of_others(turns)
        discard(before)
    else:
        members = cut(turns.select("conv_id").distinct())
    nodes, ends = burst_trie(turns, members, limit)
    discard(turns, members)
    none = hashlib.sha256(b"").hexdigest()
    out = nodes.join(digests(ends), ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(none)))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "turn_id")
