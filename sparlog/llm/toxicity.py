"""Toxicity of documents whose words may be disguised.

A trigram model of characters is counted over every text of the corpus. Words
written with digits and signs for letters, with stretched letters or with
spaced-out letters become lattices of characters, and the Viterbi path through
the lattice under that model is the word meant. Words and word beginnings of
the restored text are then weighed by what the labels say of them.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

#: Letters that a digit or sign may stand for.
LOOKS_LIKE = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou"}
ALPHABET = 64
_SPACED = re.compile(r"(?<!\w)(?:\w[ .\-_*]){2,}\w(?!\w)")
_STRETCHED = re.compile(r"([^\W\d_])\1\1")
_STRIP = ".,;:!?\"'()[]{}<>|*$%&#-_/\\=+~`"
_CLASS: list[np.ndarray] = []


def _letter(c: str) -> int:
    """0: no letter; 1 to 26: a to z; other letters share the rest."""
    if "a" <= c <= "z":
        return ord(c) - 96
    return 27 + ord(c) % (ALPHABET - 27) if c.isalpha() else 0


def _classes() -> np.ndarray:
    if not _CLASS:
        _CLASS.append(np.asarray([_letter(chr(i)) if not 0xD800 <= i < 0xE000 else 0 for i in range(0x10000)], np.uint8))
    return _CLASS[0]


def char_model(docs: DataFrame) -> np.ndarray:
    """log P(c | a, b) as an (A, A, A) array, counted over the whole of every text; at most A^3 rows reach the driver."""

    def work(batches):
        table, total = _classes(), np.zeros(ALPHABET**3, np.int64)
        for b in batches:
            for t in b.column("text").to_pylist():
                if t:
                    cp = np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
                    c = np.concatenate([[0, 0], table[np.minimum(cp, 0xFFFF)], [0]]).astype(np.int32)
                    total += np.bincount((c[:-2] * ALPHABET + c[1:-1]) * ALPHABET + c[2:], minlength=ALPHABET**3)
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["code", "n"])

    rows = docs.select("text").mapInArrow(work, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(ALPHABET**3)
    for r in rows:
        counts[r["code"]] = r["n"]
    counts = counts.reshape(ALPHABET, ALPHABET, ALPHABET)
    two, one = counts.sum(axis=0), counts.sum(axis=(0, 1))
    uni = (one + 0.5) / (one + 0.5).sum()
    bi = (two + 20 * uni[None, :]) / (two.sum(axis=1, keepdims=True) + 20)
    return np.log((counts + 10 * bi[None, :, :]) / (counts.sum(axis=2, keepdims=True) + 10)).astype(np.float32)


def decode(token: str, lm: np.ndarray, breaks: bool = False) -> str:
    """The likeliest word behind a disguised token: a Viterbi path over (last two letters) states.

    Each character is a letter, one of the letters that it looks like, a
    repetition that is dropped, or noise that is dropped. With ``breaks`` a
    separator may also end a word; the words are then joined by spaces.
    """
    states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    before = ""
    for c in token.lower():
        steps: list[tuple[float, str]] = []
        if c.isalpha():
            steps.append((0.0, c))
            if c == before:
                steps.append((-0.1, ""))
        else:
            steps += [(-1.5 - 0.7 * (len(LOOKS_LIKE[c]) > 1), x) for x in LOOKS_LIKE.get(c, "")]
            steps.append((-0.1 if c in " .-_*" else -7.0, ""))
            if breaks and c in " .-_*":
                steps.append((-0.1, " "))
        before = c
        then: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (p, word) in states.items():
            for cost, x in steps:
                if x:
                    k = _letter(x)
                    key, q = (b, k), p + cost + float(lm[a, b, k])
                else:
                    key, q = (a, b), p + cost
                if key not in then or q > then[key][0]:
                    then[key] = (q, word + x)
        states = then
    return max((p + float(lm[a, b, 0]), w) for (a, b), (p, w) in states.items())[1]


def decode_whole(token: str, lm: np.ndarray, size: int = 200, overlap: int = 80) -> str:
    """The words behind a token of any length, joined by spaces: pieces of ``size`` that overlap, spaced ones with and without word breaks."""
    found: dict[str, None] = {}
    for k in range(0, max(1, len(token) - overlap), size - overlap):
        piece = token[k : k + size]
        found.update(dict.fromkeys(decode(piece, lm).split()))
        if _SPACED.search(piece):
            found.update(dict.fromkeys(decode(piece, lm, True).split()))
    return " ".join(found)


def _spaced_out(tokens: list[str]) -> bool:
    """Whether a single character stands between two others, signs beside them left out."""
    single = [k for k, w in enumerate(tokens) if len(w) == 1]
    return any(0 < k < len(tokens) - 1 and len(tokens[k - 1].strip(_STRIP)) == 1 == len(tokens[k + 1].strip(_STRIP)) for k in single)


def words_of(text: str | None, lm: np.ndarray, known: dict[str, str] | None = None) -> tuple[set[str], dict[str, str]]:
    """(words of the restored text, disguised token -> word); known: a memory of decoded tokens."""
    if not text:
        return set(), {}
    low = text.lower()
    tokens = low.split()
    raw = set(tokens)
    known = {} if known is None else known
    words, restored = set(), {}
    odd = []
    for w in raw:
        if w.isalpha():
            words.add(w)
            continue
        s = w.strip(_STRIP)
        if s.isalpha():
            words.add(s)
        if any(c.isalpha() for c in w):
            if not s.isalpha():
                parts = re.split(r"[\W_]+", s)
                words.update(x for x in parts if x.isalpha())
                if len(s) <= 40:
                    odd.append(s)
                else:  # joined words: each part may be disguised by itself
                    odd += [x for x in re.split(r"[^\w$@!|(€£*+]+|_", s) if x and not x.isalpha() and any(c.isalpha() for c in x)]
            elif w[0] in "$@!|(" or w[-1] in "$@":
                odd.append(w)
    if _STRETCHED.search(low):
        odd += [s for s in words if _STRETCHED.search(s)]
    if _spaced_out(tokens):
        odd += [m.group() for m in _SPACED.finditer(low)]
    for s in odd:
        if s not in known:
            if len(known) > 200_000:
                known.clear()
            known[s] = decode_whole(s, lm)
        if known[s] and known[s] != s:
            restored[s] = known[s]
            words.update(known[s].split())
    return words, restored


def marks(words: set[str]) -> set[str]:
    """Words and their beginnings of 4 to 6 letters."""
    out = set(words)
    for w in words:
        n = len(w)
        if n > 4:
            out.add("^" + w[:4])
            if n > 5:
                out.add("^" + w[:5])
                if n > 6:
                    out.add("^" + w[:6])
    return out


@dataclass
class Model:
    """weight: log-odds of marks; chosen: the marks that chance does not explain; logit: bias and slopes of the final score.

    The last slope, of marks that are not chosen, is fixed and small: it orders texts and never decides.
    """

    lm: np.ndarray
    weight: dict[str, float] = field(default_factory=dict)
    chosen: set[str] = field(default_factory=set)
    logit: tuple[float, ...] = (-3.0, 0.0, 0.0, 0.03)


def _facts(found: list[str], model: Model) -> tuple[float, float, float]:
    """Highest chosen weight, number of chosen marks (log), highest other weight."""
    best, other, n = 0.0, 0.0, 0
    for m in found:
        w = model.weight[m]
        if m in model.chosen:
            n += 1
            best = max(best, w)
        else:
            other = max(other, w)
    return best, math.log1p(n), other


def fit(docs: DataFrame, labels: DataFrame, sample: int = 50_000, marks_kept: int = 20_000, least: int = 3, lm: np.ndarray | None = None) -> Model:
    """Fit on labelled documents.

    ``docs``: (doc_id, text); ``labels``: (doc_id, toxic). At most ``sample``
    labelled rows, the first by a hash of their id, are learnt from, and at
    most ``marks_kept`` marks are weighed. The character model is counted over
    all of ``docs``. Rows with a null id or label teach nothing; with no
    usable label every score is the same and below one half.
    """
    spark = docs.sparkSession
    model = Model(char_model(docs) if lm is None else lm)
    shared = spark.sparkContext.broadcast(model.lm)
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").dropDuplicates(["doc_id"])
    told = cut(told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).join(F.broadcast(told), "doc_id")  # at most `sample` ids

    def count(wanted):
        def work(batches):
            kept, known, total = None if wanted is None else wanted.value, {}, {}
            for b in batches:
                for t, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                    if kept is None and not y:
                        continue
                    found = marks(words_of(t, shared.value, known)[0])
                    for m in found if kept is None else found & kept:
                        total.setdefault(m, [0, 0])[y and 1] += 1
            yield pa.record_batch([pa.array(list(total), pa.string()), pa.array([v[0] for v in total.values()], pa.int64()), pa.array([v[1] for v in total.values()], pa.int64())], names=["mark", "clean", "toxic"])

        return rows.mapInArrow(work, "mark string, clean long, toxic long").groupBy("mark").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))

    sizes = {r["toxic"]: r["n"] for r in told.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return model
    often = count(None).where(F.col("toxic") >= least).orderBy(F.desc("toxic"), "mark").limit(marks_kept).select("mark").collect()
    wanted = spark.sparkContext.broadcast({r["mark"] for r in often})
    for r in count(wanted).collect():  # at most marks_kept rows
        w = math.log((r["toxic"] + 0.5) / (n_toxic + 1)) - math.log((r["clean"] + 0.5) / (n_clean + 1))
        if w > 2.5:
            model.weight[r["mark"]] = w
    bag = spark.sparkContext.broadcast(set(model.weight))

    def bags(batches):
        known = {}
        for b in batches:
            got = [sorted(marks(words_of(t, shared.value, known)[0]) & bag.value) for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("toxic"), pa.array(got, pa.list_(pa.string()))], names=["toxic", "marks"])

    seen = [(r["toxic"], r["marks"]) for r in rows.mapInArrow(bags, "toxic int, marks array<string>").collect()]  # at most `sample` rows
    # a mark is chosen when chance hardly explains that its holders are toxic; near copies of one text count once
    rate, tested = n_toxic / (n_toxic + n_clean), max(1, len(often))
    t, c = Counter(), Counter()
    kept: set[tuple] = set()
    for y, found in seen:
        if y and len(found) >= 12:
            low = [tuple(sorted(zlib.crc32(f"{k}{m}".encode()) for m in found)[:2]) for k in range(3)]
            copy = any(x in kept for x in low)
            kept.update(low)
            if copy:
                continue
        (t if y else c).update(found)
    for m, n in t.items():
        q = n / (n + c[m])
        away = q * math.log(q / rate) + ((1 - q) * math.log((1 - q) / (1 - rate)) if q < 1 else 0.0)
        if q > rate and math.log(tested / 0.05) < (n + c[m]) * away:
            model.chosen.add(m)
    x = np.asarray([(1.0, *_facts(found, model)[:2]) for _, found in seen])
    y = np.asarray([t for t, _ in seen], float)
    beta = np.asarray([-3.0, 0.5, 0.5])
    for _ in range(60):  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-x @ beta))
        grad = x.T @ (y - p) - 0.05 * beta
        beta = beta + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3), grad) * 0.7
    model.logit = (*(float(v) for v in beta), model.logit[3])
    return model


_SCORED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("marks", T.ArrayType(T.StringType())), T.StructField("restored", T.ArrayType(T.StringType()))])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted, marks (chosen marks found), restored ("token>word" of toxic words that were disguised).

    One row for every row of ``docs``, repeated rows too; null and empty texts
    have the score of a text without marks; texts of any length are read whole;
    an empty table gives no rows; columns besides doc_id and text, whatever
    their names, are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        m, known = shared.value, {}
        bag = m.weight.keys()
        for b in batches:
            rows: list[list] = [[], [], [], []]
            for t in b.column("text").to_pylist():
                words, restored = words_of(t, m.lm, known)
                found = marks(words) & bag
                z = sum(a * v for a, v in zip(m.logit, (1.0, *_facts(found, m)), strict=True))
                s = 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))
                rows[0].append(s)
                rows[1].append(int(s >= 0.5))
                rows[2].append(sorted(found & m.chosen))
                rows[3].append(sorted(f"{a}>{w}" for a, w in restored.items() if marks(set(w.split())) & m.chosen) if rows[2][-1] else [])
            yield pa.record_batch([b.column("doc_id"), pa.array(rows[0], pa.float64()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.list_(pa.string())), pa.array(rows[3], pa.list_(pa.string()))], names=_SCORED.names)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(work, _SCORED)
