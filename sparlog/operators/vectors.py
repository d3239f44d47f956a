"""Nearest vectors by matrix products of blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


#: Numbers in a block, at most.
MOST_NUMBERS = 1 << 20
#: Query vectors that are compared at once, and the parts that the queries of a block of vectors are dealt into.
AT_ONCE, PARTS = 512, 4


def blocks(vectors: DataFrame, id: str, rows: int, name: str) -> DataFrame:
    """(name, ids, data): vectors scaled to length 1, up to ``rows`` of them in a binary; null vectors and those of length 0 are left out.

    Blocks are cut within partitions, so nothing is shuffled; ids rise within one.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, tuple[list, list]] = {}

        def block(width: int):
            ids, found = waiting.pop(width)
            order = np.argsort(np.asarray(ids, np.int64), kind="stable")
            m = np.asarray(found, dtype=np.float64)[order]
            return pa.record_batch([pa.array([width], pa.int32()), pa.array([np.asarray(ids, np.int64)[order].tobytes()]), pa.array([m.tobytes()])], names=["width", "ids", "data"])

        for b in batches:
            for key, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if key is None or not v.is_valid:
                    continue
                x = np.asarray(v.values, dtype=np.float64)
                norm = np.sqrt((x * x).sum())
                if not 0 < norm < np.inf:
                    continue
                ids, found = waiting.setdefault(len(x), ([], []))
                ids.append(key)
                found.append(x / norm)
                if len(ids) == min(rows, max(1, MOST_NUMBERS // len(x))):
                    yield block(len(x))
        for width in list(waiting):
            yield block(width)

    cut = vectors.select(F.col(id).cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(work, "width int, ids binary, data binary")
    return cut.withColumn(name, F.monotonically_increasing_id())


def _best(q_ids: np.ndarray, q: np.ndarray, v_ids: np.ndarray, v: np.ndarray, v32: np.ndarray, k: int, least: float | None, with_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, ids and rounded cosines of the ``k`` best of ``v`` for each of ``q``.

    Single precision finds what can be among them: ``k`` of the largest values
    of runs of columns are a bound, less than it by the greatest error is out.
    What is left is multiplied in double precision.
    """
    sims = q.astype(np.float32) @ v32.T
    error = 1.1e-6 + 2.4e-7 * (q.shape[1] + 4)
    own = 0 if with_self else int((np.searchsorted(v_ids, q_ids, "right") - np.searchsorted(v_ids, q_ids)).max(initial=0))
    n, most = sims.shape[1], k + own
    run = n // (8 * most)
    bound = np.full(len(q), -np.inf if least is None else least - error, np.float32)
    if run:
        tops = sims[:, : n // run * run].reshape(len(q), -1, run).max(2)
        bound = np.maximum(bound, np.partition(tops, -most, 1)[:, -most] - np.float32(error))
    row, column = np.nonzero(sims >= bound[:, None])
    found = np.round(np.einsum("ij,ij->i", q[row], v[column]), 6) + 0.0
    keep = found > (-2 if least is None else least)
    if not with_self:
        keep &= q_ids[row] != v_ids[column]
    row, column, found = row[keep], column[keep], found[keep]
    order = np.lexsort((v_ids[column], -found, row))
    row, column, found = row[order], column[order], found[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return q_ids[row[keep]], v_ids[column[keep]], found[keep]


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 10, least: float | None = None, id: str = "session_id", rows: int = 2048, with_self: bool = False) -> DataFrame:
    """query_id, session_id, sim, place: the ``k`` vectors of largest cosine for each query, ties by id; ``least``: only larger ones.

    ``queries`` and ``vectors``: (``id``, embedding). Vectors of one length
    are compared; without ``with_self`` a query does not find its own id. Every
    query block meets every vector block once, as a matrix product whose ``k``
    best per query go on. Vector blocks are eight times as large as query
    blocks, so that few copies of these are shuffled.
    """
    asked, stored = blocks(queries, id, rows, "q"), blocks(vectors, id, 8 * rows, "v")
    numbers = stored.select("width", "v").groupBy("width").agg(F.collect_list("v").alias("vs"))  # one number for each block
    pairs = asked.join(F.broadcast(numbers), "width").select("width", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.pmod("q", F.lit(PARTS)).cast("long").alias("part"), F.explode("vs").alias("v"))
    dealt = stored.select("v", F.col("ids").alias("v_ids"), F.col("data").alias("v_data"), F.explode(F.array(*(F.lit(i).cast("long") for i in range(PARTS)))).alias("part"))
    pairs = pairs.join(dealt, ["v", "part"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i].as_buffer() for c in b.schema.names}
                q_ids, v_ids = (np.frombuffer(r[c], np.int64) for c in ("q_ids", "v_ids"))
                q, v = np.frombuffer(r["q_data"]).reshape(len(q_ids), -1), np.frombuffer(r["v_data"]).reshape(len(v_ids), -1)
                v32 = v.astype(np.float32)
                for at in range(0, len(q), AT_ONCE):
                    found = _best(q_ids[at : at + AT_ONCE], q[at : at + AT_ONCE], v_ids, v, v32, k, least, with_self)
                    yield pa.record_batch([pa.array(x) for x in found], names=["query_id", "session_id", "sim"])

    found = pairs.select("q_ids", "q_data", "v_ids", "v_data").mapInArrow(work, "query_id long, session_id long, sim double")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("sim"), "session_id"))
    return found.withColumn("place", place).where(F.col("place") <= k)
