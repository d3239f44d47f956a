"""Topics of vectors: k-means with k-means++ seeds (Q15)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import Rounds


def _chance(seed: int, round_: int, ids: list[int]) -> np.ndarray:
    """A number between 0 and 1 for each id, the same wherever it lies."""
    code = lambda i: int.from_bytes(hashlib.blake2b(f"{seed}:{round_}:{i}".encode(), digest_size=8).digest(), "big")
    return (np.asarray([code(i) for i in ids], dtype=np.float64) + 0.5) / 2.0**64


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :], 0)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], np.ndarray]]:
    for b in batches:
        if b.num_rows:
            yield b.column(0).to_pylist(), np.asarray(b.column(1).flatten(), dtype=np.float64).reshape(b.num_rows, -1)


def kmeans_topics(vectors: DataFrame, k: int = 10, rounds: int = 50, seed: int = 42, id: str = "session_id") -> tuple[DataFrame, np.ndarray]:
    """(id, topic, distance of each vector to its centre squared) and the centres, for vectors (``id``, embedding) of one length.

    Seeds follow k-means++: each next one is drawn with a chance in proportion
    to its squared distance from those before, by hashes of the ids, so the
    result does not depend on how rows are dealt. Then each round assigns every
    vector to its nearest centre (ties to the lower topic) and moves centres to
    the means, at most ``rounds`` times or until none moves; an empty topic
    keeps its centre. There are at most as many topics as different vectors;
    fewer than two vectors give no rows. Null ids and vectors are left out.
    Only centres and sums of topics, k times the length, reach the driver.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(id).isNotNull() & F.col("embedding").isNotNull()).select(F.col(id).cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("x"))
    rows = Rounds(spark, "topics").keep(rows)
    out = f"{id} long, topic int, distance double"
    n = rows.limit(2).count()
    if n < 2:
        return spark.createDataFrame([], out), np.zeros((0, 0))

    def seed_of(round_: int, centres: np.ndarray | None):
        def best(batches):
            found = None
            for ids, x in _batches(batches):
                weight = np.ones(len(ids)) if centres is None else _distances(x, centres).min(1)
                with np.errstate(divide="ignore"):
                    key = np.where(weight > 1e-12, -np.log(_chance(seed, round_, ids)) / weight, np.inf)
                i = min(range(len(ids)), key=lambda j: (key[j], ids[j]))
                if np.isfinite(key[i]) and (found is None or (key[i], ids[i]) < found[:2]):
                    found = (float(key[i]), ids[i], x[i].tolist())
            if found:
                yield pa.record_batch([pa.array([v]) for v in found], names=["key", "id", "x"])

        return rows.mapInArrow(best, "key double, id long, x array<double>").orderBy("key", "id").first()

    centres: np.ndarray | None = None
    for r in range(k):
        row = seed_of(r, centres)
        if row is None:
            break  # no further different vector
        centres = np.asarray([row["x"]]) if centres is None else np.vstack([centres, row["x"]])

    def sums(now: np.ndarray):
        def work(batches):
            total, count = np.zeros_like(now), np.zeros(len(now), np.int64)
            for _, x in _batches(batches):
                topic = _distances(x, now).argmin(1)
                np.add.at(total, topic, x)
                count += np.bincount(topic, minlength=len(now))
            at = np.flatnonzero(count)
            if len(at):
                topics = np.repeat(at, now.shape[1])
                yield pa.record_batch([pa.array(topics), pa.array(np.tile(np.arange(now.shape[1]), len(at))), pa.array(total[at].ravel()), pa.array(np.repeat(count[at], now.shape[1]))], names=["topic", "i", "total", "n"])

        return rows.mapInArrow(work, "topic long, i long, total double, n long").groupBy("topic", "i").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()

    for _ in range(rounds):
        moved = centres.copy()
        for r in sums(centres):
            moved[r["topic"], r["i"]] = r["total"] / r["n"]
        still = np.allclose(moved, centres, rtol=0, atol=1e-9)
        centres = moved
        if still:
            break
    last = centres

    def assign(batches):
        for ids, x in _batches(batches):
            d = _distances(x, last)
            topic = d.argmin(1)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(topic, pa.int32()), pa.array(d[np.arange(len(ids)), topic])], names=[id, "topic", "distance"])

    return rows.mapInArrow(assign, out), last
