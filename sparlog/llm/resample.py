"""Target-distribution importance resampling over hashed n-grams.

Separators are collapsed to single spaces, and overlapped regular expressions
with boundary lookarounds give every n-gram as a span of that text, whose CRC
is its bucket. Each text is scanned once: its buckets go to the shared folder,
are summed over the corpus, and are then weighed by the gains of the sums.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from operator import itemgetter
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import NULL_ID, discard, keyed, stored

#: ASCII letters in lower case; every byte that is no digit, no letter and no part of a non-ASCII character as a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Longer texts are scanned in pieces of about this many bytes, which share the words at their borders.
_PIECE = 1 << 20
_span = itemgetter(0)


def collapsed(text: str | None) -> bytes:
    """Words of a text, ASCII letters lower-cased, between single spaces."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split())


def grams(n: int) -> regex.Pattern:
    """Matches ``n`` adjoining words of a collapsed text; overlapped, it matches once at every word."""
    return regex.compile(rb"(?<![^ ])[^ ]+" + rb" [^ ]+" * (n - 1) + rb"(?![^ ])")


def _pieces(text: bytes, n: int) -> Iterator[bytes]:
    """The text in pieces that end at spaces, each with the n - 1 words after it: every run of n words is in just one."""
    at = 0
    while len(text) - at > _PIECE and (cut := text.find(b" ", at + _PIECE)) >= 0:
        end = cut
        for _ in range(n - 1):
            if (end := text.find(b" ", end + 1)) < 0:
                end = len(text)
                break
        yield text[at:end]
        at = cut + 1
    yield text[at:]


def bucket_ids(text: bytes, patterns: list[regex.Pattern], buckets: int) -> np.ndarray:
    """The bucket of every n-gram of a collapsed text, for patterns of 1, 2, ... words: CRC of its bytes modulo ``buckets``."""
    out = array("Q")
    for n, pattern in enumerate(patterns, 1):
        for piece in _pieces(text, n):
            out.extend(map(crc32, map(_span, pattern.finditer(piece, overlapped=True))))
    return (np.frombuffer(out, np.uint64) % buckets).astype("<u4")


def scanned(docs: DataFrame, longest: int = 2, buckets: int = 10_000) -> DataFrame:
    """doc_id, n_words, n_features, ids (binary: a little-endian 32-bit bucket for each n-gram of up to ``longest`` words) of every row."""

    def work(batches):
        patterns = [grams(n) for n in range(1, longest + 1)]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                words, found = [], []
                for text in part.column(1).to_pylist():
                    text = collapsed(text)
                    words.append(text.count(b" ") + 1 if text else 0)
                    found.append(bucket_ids(text, patterns, buckets) if text else np.zeros(0, "<u4"))
                yield pa.record_batch([part.column(0), pa.array(words, pa.int64()), pa.array([len(f) for f in found], pa.int64()), pa.array([f.tobytes() for f in found], pa.binary())], names=["doc_id", "n_words", "n_features", "ids"])

    return keyed(docs).mapInArrow(work, "doc_id long, n_words long, n_features long, ids binary")


def bucket_counts(rows: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs in rows of ``scanned``: tasks add up theirs, and at most ``buckets`` rows reach the driver."""

    def work(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                total += np.bincount(np.frombuffer(ids.as_buffer(), "<u4"), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in rows.select("ids").mapInArrow(work, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of target and source shares), counts raised by one each."""
    s, t, buckets = source.astype(float), target.astype(float), len(source)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, longest: int = 2, buckets: int = 10_000, seed: int = 7) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of ``docs`` (doc_id, text), towards the texts of ``target`` (text).

    weight is the floored mean of the gains of a document's n-grams, score adds
    Gumbel noise that the seed and the doc_id decide, and the ``percent`` of
    the documents of at least ``least_words`` words that score highest are
    drawn: their rank counts from 1 by score, ties by doc_id, and is null for
    the others.

    A null or empty text has no words and a weight of 0; a null doc_id counts
    as the text ``7:`` for its noise and comes first in ties; rows that repeat
    a doc_id are documents each and tie by their weights, then arbitrarily where
    equal; an empty ``target`` has counts of zero; an empty table gives no rows;
    other columns, whatever their names, are ignored. Long texts are scanned in
    pieces and wholly.
    """
    spark = docs.sparkSession
    rows = stored(scanned(docs, longest, buckets), "ngram-buckets")
    aim = scanned(target.select(F.lit(0).alias("doc_id"), target["text"].alias("text")), longest, buckets)
    shared = spark.sparkContext.broadcast(gains(bucket_counts(rows, buckets), bucket_counts(aim, buckets)))  # ``buckets`` numbers

    def weigh(batches):
        gain = shared.value
        for b in batches:
            n = b.column("n_features").to_numpy()
            sums = np.asarray([gain[np.frombuffer(ids.as_buffer(), "<u4")].sum() for ids in b.column("ids")], dtype=np.int64)
            weight = np.where(n > 0, sums // np.maximum(n, 1), 0)
            yield pa.record_batch([b.column("doc_id"), b.column("n_words"), b.column("n_features"), pa.array(weight, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    own = F.coalesce(F.nullif("doc_id", F.lit(NULL_ID)).cast("string"), F.lit(""))
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), own).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    score = F.col("weight") + F.floor(-1000 * F.ln(-F.ln((noise + 0.5) / 4294967296.0)))
    weighed = stored(rows.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long").withColumn("score", score.cast("long")), "document-weights")
    discard(rows)
    enough = F.col("n_words") >= least_words
    # scores are whole thousandths between fixed bounds, so their histogram has some 100,000 rows whatever the corpus
    counts = weighed.where(enough).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    higher = counts.select("score", (F.sum("n").over(W.orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("higher"), F.sum("n").over(W.partitionBy()).alias("all"))
    drawn = F.floor(F.col("all") * percent / 100)
    higher = higher.where(F.col("higher") < drawn).select("score", "higher", drawn.alias("drawn"))
    top = weighed.where(enough).join(F.broadcast(higher), "score")
    place = F.col("higher") + F.row_number().over(W.partitionBy("score").orderBy("doc_id", "weight"))
    top = top.select("doc_id", "n_words", "n_features", "weight", "score", place.alias("place"), "drawn")
    top = top.select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("place") <= F.col("drawn"), F.col("place")).alias("rank"))
    rest = weighed.join(F.broadcast(higher.select("score", F.lit(True).alias("high"))), "score", "left").where(~enough | F.col("high").isNull())
    out = top.unionByName(rest.select("doc_id", "n_words", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NULL_ID)))
