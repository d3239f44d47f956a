"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded from its characters
and words; gated attention (Ilse, Tomczak and Welling, 2018), learnt from
document labels alone, weighs the passages, and the weighted passage
representation is scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

PASSAGE = 600
#: Characters counted on their own.
SIGNS = ".,;:!?|*$%&#@<>{}()[]=/\\\"'-_"
_KINDS = 8
_TABLE: list[np.ndarray] = []
WIDTH = len(SIGNS) + _KINDS + _KINDS * _KINDS + 6


def _table() -> tuple[np.ndarray, np.ndarray]:
    """(kind, sign) of a code point: kinds are lower, upper, other letter, digit, space, line feed, sign, other."""
    if not _TABLE:
        kind, sign = np.full(0x10000, 7, np.uint8), np.full(0x10000, len(SIGNS), np.uint8)
        for i in range(0x10000):
            c = chr(i)
            if c == "\n":
                kind[i] = 5
            elif c.isspace():
                kind[i] = 4
            elif c.islower():
                kind[i] = 0
            elif c.isupper():
                kind[i] = 1
            elif c.isalpha():
                kind[i] = 2
            elif c.isdigit():
                kind[i] = 3
            elif i < 128:
                kind[i] = 6
        for k, c in enumerate(SIGNS):
            sign[ord(c)] = k
        _TABLE.extend([kind, sign])
    return _TABLE[0], _TABLE[1]


def encode(text: str | None, passage: int = PASSAGE) -> np.ndarray:
    """(passages, WIDTH) encodings of a whole text, cut every ``passage`` characters; an empty one is one blank passage."""
    if not text:
        return np.zeros((1, WIDTH), np.float32)
    kinds, signs = _table()
    cp = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 0xFFFF)
    n = len(cp)
    m = -(-n // passage)
    at = np.arange(n) // passage
    size = np.bincount(at, minlength=m).astype(np.float64)
    kind, sign = kinds[cp].astype(np.int64), signs[cp].astype(np.int64)
    out = np.zeros((m, WIDTH))
    s = len(SIGNS)
    out[:, :s] = np.bincount(at * (s + 1) + sign, minlength=m * (s + 1)).reshape(m, s + 1)[:, :s] / size[:, None]
    out[:, s : s + _KINDS] = np.bincount(at * _KINDS + kind, minlength=m * _KINDS).reshape(m, _KINDS) / size[:, None]
    pair = np.bincount((at[1:] * _KINDS + kind[:-1]) * _KINDS + kind[1:], minlength=m * _KINDS**2)
    out[:, s + _KINDS : s + _KINDS + _KINDS**2] = pair.reshape(m, _KINDS**2) / size[:, None]
    solid = (kind != 4) & (kind != 5)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    if len(begin):
        code = np.add.reduceat(np.where(solid, cp.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.uint64(0)) ^ np.uint64(0), begin) + (end - begin).astype(np.uint64)
        where = begin // passage
        words = np.maximum(np.bincount(where, minlength=m), 1)
        same = np.concatenate([[False], code[1:] == code[:-1]])
        fresh = np.zeros(len(code), bool)
        fresh[np.unique((code ^ (where.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))), return_index=True)[1]] = True
        k = s + _KINDS + _KINDS**2
        length = end - begin
        out[:, k] = np.bincount(where, length, minlength=m) / words / 10
        out[:, k + 1] = np.bincount(where, same, minlength=m) / words
        out[:, k + 2] = np.bincount(where, fresh, minlength=m) / words
        out[:, k + 3] = np.bincount(where, length > 14, minlength=m) / words
        out[:, k + 4] = np.bincount(where, length <= 3, minlength=m) / words
    out[:, -1] = np.log1p(size) / 10
    return (out * 4).astype(np.float32)


def _segments(x: np.ndarray, begin: np.ndarray, how) -> np.ndarray:
    return how.reduceat(x, begin, axis=0)


class Attention:
    """h = tanh(W x); a = softmax over the bag of w . (tanh(V h) * sigmoid(U h)); score = sigmoid(c . sum a h)."""

    def __init__(self, width: int, hidden: int = 24, gate: int = 12, seed: int = 7):
        r = np.random.default_rng(seed)
        d = lambda *s: (r.normal(0, 1 / np.sqrt(s[0]), s)).astype(np.float32)
        self.mean, self.scale = np.zeros(width, np.float32), np.ones(width, np.float32)
        self.p = {"W": d(width, hidden), "b": np.zeros(hidden, np.float32), "V": d(hidden, gate), "U": d(hidden, gate), "w": d(gate, 1)[:, 0], "c": d(hidden, 1)[:, 0], "c0": np.zeros(1, np.float32)}

    def forward(self, x: np.ndarray, begin: np.ndarray):
        p = self.p
        bag = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(x))))
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["W"] + p["b"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (v * u) @ p["w"]
        a = np.exp(e - _segments(e, begin, np.maximum)[bag])
        a /= _segments(a, begin, np.add)[bag]
        z = _segments(a[:, None] * h, begin, np.add)
        s = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["c0"][0], -30, 30)))
        return x, bag, h, v, u, a, z, s

    def fit(self, x: np.ndarray, begin: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 256, rate: float = 0.01, seed: int = 7) -> None:
        """Adam on the cross-entropy of the bags' labels."""
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 0.05
        r, end = np.random.default_rng(seed), np.append(begin[1:], len(x))
        mom = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        t = 0
        for _ in range(epochs):
            order = r.permutation(len(begin))
            for i in range(0, len(order), batch):
                own = order[i : i + batch]
                xs = np.concatenate([x[begin[k] : end[k]] for k in own])
                at = np.concatenate([[0], np.cumsum(end[own] - begin[own])[:-1]]).astype(np.int64)
                g = self._gradient(xs, at, y[own])
                t += 1
                for k, v in self.p.items():
                    m, q = mom[k]
                    gk = g[k] + 1e-4 * v
                    m += 0.1 * (gk - m)
                    q += 0.001 * (gk * gk - q)
                    v -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(q / (1 - 0.999**t)) + 1e-8)).astype(np.float32)

    def _gradient(self, x: np.ndarray, begin: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        x, bag, h, v, u, a, z, s = self.forward(x, begin)
        ds = (s - y) / len(y)
        dz = ds[:, None] * p["c"]
        da = (dz[bag] * h).sum(axis=1)
        de = a * (da - _segments(a * da, begin, np.add)[bag])
        dg = de[:, None] * p["w"]
        dv, du = dg * u * (1 - v * v), dg * v * u * (1 - u)
        dh = a[:, None] * dz[bag] + dv @ p["V"].T + du @ p["U"].T
        dx = dh * (1 - h * h)
        return {"W": x.T @ dx, "b": dx.sum(axis=0), "V": h.T @ dv, "U": h.T @ du, "w": (v * u).T @ de, "c": z.T @ ds, "c0": np.asarray([ds.sum()])}


def fit(docs: DataFrame, labels: DataFrame, sample: int = 8_000, epochs: int = 60) -> Attention:
    """Fit on at most ``sample`` labelled documents, the first by a hash of their id.

    ``docs``: (doc_id, text); ``labels``: (doc_id, quality). Their passages
    are encoded whole by Spark and the encodings are collected. Rows with a
    null id or label teach nothing, nor do labels of ids without a document;
    without labels every score is one half, and with labels of one kind only
    it is close to that.
    """
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null").dropDuplicates(["doc_id"])
    told = cut(told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).join(F.broadcast(told), "doc_id")  # at most `sample` ids

    def work(batches):
        for b in batches:
            for i, t in enumerate(b.column("text").to_pylist()):
                x = encode(t)
                yield pa.record_batch([b.column("quality").slice(i, 1), pa.array([x.astype(np.float16).tobytes()], pa.binary())], names=["quality", "bag"])

    seen = rows.mapInArrow(work, "quality int, bag binary").collect()
    model, kinds = Attention(WIDTH), {r["quality"] for r in seen}
    if len(kinds) < 2:  # nothing to tell apart
        model.p["c"][:] = 0
        model.p["c0"][:] = 0 if not kinds else (4 if kinds == {1} else -4)
        return model
    bags = [np.frombuffer(r["bag"], np.float16).reshape(-1, WIDTH).astype(np.float32) for r in seen]
    begin = np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]]).astype(np.int64)
    model.fit(np.concatenate(bags), begin, np.asarray([r["quality"] for r in seen], np.float32), epochs)
    return model


def score(docs: DataFrame, model: Attention) -> DataFrame:
    """doc_id, score, predicted, passages, focus (place of the passage with most weight) for every row of ``docs``.

    A null or empty text is one blank passage; a text of any length is encoded
    whole; repeated rows are scored each; an empty table gives no rows; columns
    besides doc_id and text, whatever their names, are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        m = shared.value
        for b in batches:
            texts, out, at = b.column("text").to_pylist(), [[], [], [], []], 0
            while at < len(texts):
                bags, size = [], 0
                while at < len(texts) and (not bags or size < 20_000):
                    bags.append(encode(texts[at]))
                    size += len(bags[-1])
                    at += 1
                counts = np.asarray([len(x) for x in bags])
                begin = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
                *_, a, _, s = m.forward(np.concatenate(bags), begin)
                out[0] += s.astype(float).tolist()
                out[1] += (s >= 0.5).astype(int).tolist()
                out[2] += counts.tolist()
                out[3] += [int(np.argmax(a[i : i + c])) for i, c in zip(begin, counts, strict=True)]
            yield pa.record_batch([b.column("doc_id"), pa.array(out[0], pa.float64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32())], names=["doc_id", "score", "predicted", "passages", "focus"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(work, "doc_id long, score double, predicted int, passages int, focus int")
