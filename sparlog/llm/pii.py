"""Personal data by weak supervision.

Base patterns are always reported. Beside them, candidate spans of further
kinds are voted on by labelers (patterns, gazetteers, context words); their
reliabilities are estimated by expectation-maximisation over the counts of
vote patterns, and a span classifier trained on the estimated labels decides
which candidates are added.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "local_phone", "secret", "ssn")
KINDS = BASE + ADDED
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_ADDED = {
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "local_phone": re.compile(r"(?<![0-9+])(?<!\+[0-9] )\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    "secret": re.compile(r"(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]{0,80}[0-9])(?=[0-9]{0,80}[A-Za-z])[A-Za-z0-9_]{16,80}(?![A-Za-z0-9_])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
}
#: Context words for and against, and known beginnings.
FOR = {
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "local_phone": ("phone", "tel", "call", "mobile", "fax", "cell"),
    "secret": ("token", "password", "secret", "api", "key", "passwd", "auth", "bearer", "credential"),
    "ssn": ("ssn", "social", "security"),
}
AGAINST = ("version", "isbn", "issn", "commit", "sha", "checksum", "hash", "page", "figure", "order", "ticket")
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "sk_", "pk_", "xoxb", "xoxp", "AIza", "eyJ")
LABELERS = ("pattern", "mixture", "prefix", "context_for", "context_against", "assigned")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        total += v if k % 2 == 0 else v * 2 - 9 * (v > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, in time linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as in BASE and then by start; null texts have none."""
    if not text:
        return []
    out = [("email", *s) for s in emails(text)] if "@" in text else []
    if not _DIGITS.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.findall(m.group())) <= 15:
                out.append(("phone", *m.span()))
    return out


def _votes(kind: str, text: str, s: int, e: int) -> str:
    """One character a labeler: 1 personal, 0 not, - abstains."""
    span = text[s:e]
    before = text[max(0, s - 40) : s].lower()
    words = set(re.findall(r"[a-z]+", before))
    digits = sum(c.isdigit() for c in span)
    mixed = 0.15 <= digits / len(span) <= 0.9 and len(set(span)) >= 8
    shape = {"iban": len(span.replace(" ", "")) >= 15 and _iban(span.replace(" ", "")), "local_phone": span[-4:].isdigit(), "secret": bool(re.fullmatch(r"[0-9a-f]{16,}|[A-Z0-9]{16,}", span)), "ssn": span[:3] not in ("000", "666") and span[0] != "9"}[kind]
    v = ["1" if shape else "0", "1" if mixed else ("0" if kind == "secret" else "-"), "1" if span.startswith(PREFIXES) else "-", "1" if words & set(FOR[kind]) else "-", "0" if words & set(AGAINST) else "-", "1" if re.search(r"[=:]\s*[\"']?$", before) else "-"]
    return "".join(v)


def _iban(s: str) -> bool:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _facts(kind: str, text: str, s: int, e: int) -> list[float]:
    """What the span classifier sees: the span's shape and neighbourhood, not the votes."""
    span = text[s:e]
    n = len(span)
    freq = np.bincount(np.frombuffer(span.encode("utf-8"), np.uint8))
    p = freq[freq > 0] / n
    before = text[max(0, s - 24) : s].lower()
    buckets = [0.0] * 16
    for w in re.findall(r"[a-z]+", before)[-2:]:
        buckets[int.from_bytes(hashlib.blake2b(w.encode(), digest_size=2).digest(), "little") % 16] = 1.0
    return [1.0, *(float(kind == k) for k in ADDED), n / 40, sum(c.isdigit() for c in span) / n, sum(c.isupper() for c in span) / n, sum(c in " .-_" for c in span) / n, float(-(p * np.log2(p)).sum()) / 4, float(before[-1:] in "\"'"), float("=" in before[-4:] or ":" in before[-4:]), *buckets]


def candidates(text: str | None) -> list[tuple[str, int, int, str, list[float]]]:
    """Spans of the added kinds that no base span touches, with votes and facts."""
    if not text or not _DIGITS.search(text):
        return []
    taken = [(s, e) for _, s, e in base_spans(text)]
    out = []
    for kind in ADDED:
        for m in _ADDED[kind].finditer(text):
            s, e = m.span()
            if not any(a < e and s < b for a, b in taken):
                out.append((kind, s, e, _votes(kind, text, s, e), _facts(kind, text, s, e)))
                taken.append((s, e))
    return out


_FOUND = "doc_id long, base array<struct<kind:string,start:int,end:int>>, added array<struct<kind:string,start:int,end:int,votes:string,facts:array<float>>>"


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, base spans and voted candidates of every row of (doc_id, text)."""

    def work(batches):
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        more = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("votes", pa.string()), ("facts", pa.list_(pa.float32()))])
        for b in batches:
            texts = b.column("text").to_pylist()
            base = [[{"kind": k, "start": s, "end": e} for k, s, e in base_spans(t)] for t in texts]
            added = [[{"kind": k, "start": s, "end": e, "votes": v, "facts": f} for k, s, e, v, f in candidates(t)] for t in texts]
            yield pa.record_batch([b.column("doc_id"), pa.array(base, pa.list_(kind)), pa.array(added, pa.list_(more))], names=["doc_id", "base", "added"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(work, _FOUND)


@dataclass
class Model:
    reliability: dict[str, tuple[float, float]]  # labeler -> P(votes 1 | personal), P(votes 1 | not), given that it votes
    prior: float
    beta: np.ndarray


def estimate(counts: dict[str, int], rounds: int = 100) -> tuple[dict[str, tuple[float, float]], float, dict[str, float]]:
    """EM for two classes: (reliabilities, prior, P(personal | pattern)); counts has a bounded number of vote patterns."""
    pats = sorted(counts)
    n = np.asarray([counts[p] for p in pats], float)
    one = np.asarray([[c == "1" for c in p] for p in pats], float).reshape(len(pats), len(LABELERS))
    zero = np.asarray([[c == "0" for c in p] for p in pats], float).reshape(len(pats), len(LABELERS))
    hit, miss, prior = np.full(len(LABELERS), 0.8), np.full(len(LABELERS), 0.3), 0.5
    post = np.full(len(pats), 0.5)
    for _ in range(rounds):
        a = np.log(prior) + one @ np.log(hit) + zero @ np.log(1 - hit)
        b = np.log(1 - prior) + one @ np.log(miss) + zero @ np.log(1 - miss)
        post = 1 / (1 + np.exp(np.clip(b - a, -50, 50)))
        w, v = n * post, n * (1 - post)
        # pseudo-counts keep labelers that never vote one way, and the classes' meaning, in place
        hit = (w @ one + 8) / (w @ (one + zero) + 10)
        miss = (v @ one + 3) / (v @ (one + zero) + 10)
        prior = float(np.clip((w.sum() + 1) / (n.sum() + 2), 0.02, 0.98))
    return {k: (float(h), float(m)) for k, h, m in zip(LABELERS, hit, miss, strict=True)}, prior, dict(zip(pats, post.tolist(), strict=True))


def fit(found: DataFrame, sample: int = 20_000) -> Model:
    """Reliabilities from the vote patterns of all candidates; the classifier from at most ``sample`` of them, by hash."""
    spans = found.select("doc_id", F.inline("added"))
    counts = {r["votes"]: r["n"] for r in spans.groupBy("votes").agg(F.count("*").alias("n")).collect()}  # <= 3 ** labelers rows
    reliability, prior, post = estimate(counts)
    rows = spans.select("votes", "facts", F.xxhash64("doc_id", "start", "kind").alias("h")).orderBy("h", "votes").limit(sample).collect()
    beta = np.zeros(28)
    if rows:
        x = np.asarray([r["facts"] for r in rows], float)
        y = np.asarray([post[r["votes"]] for r in rows])
        beta = np.zeros(x.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            beta = beta + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(beta)), x.T @ (y - p) - 0.5 * beta)
    return Model(reliability, prior, beta)


def decide(found: DataFrame, model: Model) -> DataFrame:
    """doc_id, spans: array of (kind, start, end, score), base spans (score 1) first; one row for every row of ``found``."""
    beta = model.beta.tolist()

    def work(batches):
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
        for b in batches:
            out = []
            for base, added in zip(b.column("base").to_pylist(), b.column("added").to_pylist(), strict=True):
                spans = [{**s, "score": 1.0} for s in base]
                for s in sorted(added, key=lambda s: (s["kind"], s["start"])):
                    p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(u * v for u, v in zip(beta, s["facts"], strict=True))))))
                    if p >= 0.5:
                        spans.append({"kind": s["kind"], "start": s["start"], "end": s["end"], "score": p})
                out.append(spans)
            yield pa.record_batch([b.column("doc_id"), pa.array(out, pa.list_(kind))], names=["doc_id", "spans"])

    return found.mapInArrow(work, "doc_id long, spans array<struct<kind:string,start:int,end:int,score:double>>")


def personal_data(docs: DataFrame, sample: int = 20_000) -> DataFrame:
    """doc_id, spans for every row of (doc_id, text).

    Null and empty texts have no spans, overlapping spans of different base
    kinds are all kept, an added span never touches a base one, repeated rows
    give repeated results, other columns are ignored, and an empty table gives
    no rows.
    """
    found = cut(find_spans(docs))
    return decide(found, fit(found, sample))
