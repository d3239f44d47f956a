"""The best messages of many sets of terms by BM25: each part of the messages is scored by one task, which gives only what may be among the best."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Messages that a task scores at once.
MESSAGES_A_TASK = 32_768
#: Scores are rounded to six places afterwards: those this near to the last one wanted may still be equal to it.
NEAR = 2e-6


def _matched(postings, terms: np.ndarray, idf: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the messages that hold every one of ``terms``, the rarest of which comes first."""
    at, score = None, None
    for term, weight in zip(terms, idf, strict=True):
        places, tf = postings(term)
        if at is not None:
            here = np.minimum(np.searchsorted(places, at), max(len(places) - 1, 0))
            met = places[here] == at if len(places) else np.zeros(len(at), bool)
            at, score, tf = at[met], score[met], tf[here[met]]
        else:
            at, score = places, 0.0
        score = score + weight * tf * 2.2 / (tf + norm[at])
    return at, score


def _best(at: np.ndarray, score: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """What may be among the first ``most`` by rounded score and then by place; of equal scores no more than ``most``."""
    if len(at) > most:
        kept = score >= np.partition(score, -most)[-most] - NEAR
        at, score = at[kept], score[kept]
        order = np.lexsort((at, -score))
        at, score = at[order], score[order]
        run = np.maximum.accumulate(np.where(np.append(True, score[1:] != score[:-1]), np.arange(len(at)), 0))
        kept = np.arange(len(at)) - run < most
        at, score = at[kept], score[kept]
    return at, score


def first_messages(messages: DataFrame, sets: DataFrame, most: int = 100) -> DataFrame:
    """words, session_id, ord, role, score (not rounded): for each part of the messages the ``most`` best of each set, more only where rounding may tie them.

    ``messages``: session_id, ord, role, len, terms and their numbers tfs;
    ``sets``: words, mean_len, terms with the rarest first, and their weights
    idf. A set counts the messages that hold all its terms.
    """
    parts = 1 + messages.count() // MESSAGES_A_TASK
    schema = messages.select(F.lit("").alias("words"), "session_id", "ord", "role", F.lit(0.0).alias("score")).schema

    def work(part: pa.Table, asked: pa.Table) -> pa.Table:
        part, found = part.sort_by([("session_id", "ascending"), ("ord", "ascending")]), ([], [], [])
        if len(part) and len(asked):
            told, wanted = part["terms"].combine_chunks(), asked["terms"].combine_chunks()
            known = pc.unique(wanted.flatten())
            code = pc.fill_null(pc.index_in(told.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False)
            place = np.repeat(np.arange(len(part)), pc.list_value_length(told).to_numpy(zero_copy_only=False))
            order = np.argsort(code, kind="stable")
            place, tf, edges = place[order], part["tfs"].combine_chunks().flatten().to_numpy()[order], np.searchsorted(code[order], np.arange(len(known) + 1))
            norm = 1.2 * (0.25 + 0.75 * part["len"].to_numpy() / asked["mean_len"][0].as_py())
            terms, idf = pc.index_in(wanted.flatten(), value_set=known).to_numpy(), asked["idf"].combine_chunks().flatten().to_numpy()
            ends = np.cumsum(pc.list_value_length(wanted).to_numpy())
            for k, (a, b) in enumerate(zip(np.append(0, ends), ends)):  # noqa: B905
                at, score = _best(*_matched(lambda t: (place[edges[t] : edges[t + 1]], tf[edges[t] : edges[t + 1]]), terms[a:b], idf[a:b], norm), most)
                for column, values in zip(found, (np.full(len(at), k), at, score), strict=True):
                    column.append(values)
        which, at, score = (np.concatenate([np.zeros(0, kind), *x]) for x, kind in zip(found, (np.int64, np.int64, np.float64), strict=True))
        rows = part.select(["session_id", "ord", "role"]).take(pa.array(at))  # not the terms, which a message would repeat for every set it is given for
        return pa.table({"words": asked["words"].take(pa.array(which)), "session_id": rows["session_id"], "ord": rows["ord"], "role": rows["role"], "score": pa.array(score)})

    dealt = messages.withColumn("part", F.pmod(F.xxhash64("session_id", "ord"), F.lit(parts)))
    every = sets.withColumn("part", F.explode(F.expr(f"sequence(0L, {parts - 1}L)")))
    return dealt.groupBy("part").cogroup(every.groupBy("part")).applyInArrow(work, schema)
