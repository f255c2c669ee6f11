"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs the labelers, and
the resulting soft labels train a final span classifier.

1. Base spans (email, ip, card, phone) are found by their patterns and always stay.
2. Candidates are further spans: quoted or long secrets, digit groups and addresses that the base rules rejected, and
   names after an honorific.
3. Labelers of three sorts vote on each candidate, for, against, or not at all: patterns, gazetteers (cue words around the
   span, honorifics) and context (punctuation before and after, other spans near it).
4. Votes are counted by pattern, over all documents: the patterns are few whatever the corpus. Expectation-maximisation
   on those counts estimates how reliable each labeler is for a true and for a false span.
5. The posteriors train a logistic classifier on the span's own features, which unlike the votes never abstain. A
   candidate that it scores at least ``ACCEPT`` becomes a span, unless it overlaps a base span or an earlier one.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_rows, only

KINDS = ("email", "ip", "card", "phone", "secret", "name", "number")
ACCEPT = 0.8

_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_host = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_local_end = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_any = re.compile(r"[0-9@]")
_secret = re.compile(r"[A-Za-z0-9_+/-]{16,}=*")
_name = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Herr|Frau|Madame|Monsieur|Señor|Señora)\.? ((?:[^\W\d_]+[ ]){0,2}[^\W\d_]+)")
#: Every honorific has one of these in it, so a text without them has no name for :data:`_name`.
_STEMS = ("Mr", "Ms", "Dr", "Herr", "Frau", "Madame", "Monsieur", "Señor")
#: How near a base span counts as near.
NEAR = 80

# Cue words.
CUES = frozenset("api account auth bearer bank card cell contact credential credit cvv dial email fax iban ip key login mail mobile number passport password passwd phone pin pwd secret ssn tel telephone token user visa".split())
AGAINST = frozenset("chapter copyright figure isbn item page section table version volume year".split())


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of the address pattern, in time linear in the text: each ``@`` is looked at once."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _local:
            start -= 1
        m = _host.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        else:
            end = at + 1
        at = text.find("@", max(end, at + 1))
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_and_rejected(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, kind, end) of the base spans, sorted, and of pattern matches that their checks dropped."""
    good: list[tuple[int, int, int]] = []
    bad: list[tuple[int, int, int]] = []
    if "@" in text:
        good += [(s, 0, e) for s, e in emails(text)]
    for m in _ip.finditer(text):
        (good if all(map(_small, m[0].split("."))) else bad).append((m.start(), 1, m.end()))
    for m in _card.finditer(text):
        n = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(n) <= 19:
            (good if luhn(n) else bad).append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _phone.finditer(text):
            n = sum(map(str.isdigit, m[0]))
            if 9 <= n <= 15:
                good.append((m.start(), 3, m.end()))
    return sorted(good), bad


@dataclass
class Candidate:
    start: int
    end: int
    kind: int
    votes: tuple[int, ...]  # 1 for, 0 against, -1 abstains
    features: tuple[int, ...]


LABELERS = ("pattern_mixed", "pattern_hex", "pattern_digits", "gazetteer_cue", "gazetteer_against", "context_assigned", "context_quoted", "context_near_base", "context_in_word")
FEATURES = ("bias", "digits_some", "digits_most", "letters_both_cases", "long", "very_long", "cue_near", "against_near", "assigned", "quoted", "near_base", "in_word", "is_secret", "is_name", "is_digits")


def _judge(text: str, start: int, end: int, kind: int, near: bool) -> Candidate:
    s = text[start:end]
    digits = sum(map(str.isdigit, s))
    letters = sum(map(str.isalpha, s))
    before, after = text[max(0, start - 40) : start], text[end : end + 1]
    cues = {w.lower() for w in re.findall(r"[^\W\d_]+", before)[-4:]}
    bare = before.rstrip("\"'` ")
    assigned, quoted = bare[-1:] in ("=", ":"), before[-1:] in ("\"", "'", "`") and after in ("\"", "'", "`")
    inside = before[-1:].isalnum() or after.isalnum()
    hexa = kind == 4 and digits and letters and all(c in "0123456789abcdefABCDEF" for c in s)
    cue, against = bool(cues & CUES), bool(cues & AGAINST)
    votes = (
        (1 if digits and letters and digits * 8 > len(s) else 0) if kind == 4 else -1,
        1 if hexa and len(s) >= 32 else -1,
        0 if kind in (1, 2, 6) and not cue else -1,
        1 if cue or kind == 5 else -1,
        0 if against else -1,
        1 if assigned else -1,
        1 if quoted else -1,
        1 if near and kind != 4 and cue else -1,
        0 if inside else -1,
    )
    features = (1, digits > 0, digits * 2 > len(s), any(map(str.isupper, s)) and any(map(str.islower, s)), len(s) >= 24, len(s) >= 36, cue, against, assigned, quoted, near, inside, kind == 4, kind == 5, kind in (1, 2, 6))
    return Candidate(start, end, kind, votes, tuple(map(int, features)))


class BaseSpans:
    """All base spans of a text, to be asked by bisection whether one overlaps a span or begins or ends near it."""

    def __init__(self, base: list[tuple[int, int, int]]):
        self.starts = [s for s, _, _ in base]
        self.ends = sorted(e for _, _, e in base)
        self.reach = list(accumulate((e for _, _, e in base), max))  # the farthest end of the spans up to each one

    def overlap(self, start: int, end: int) -> bool:
        i = bisect_left(self.starts, end)
        return i > 0 and self.reach[i - 1] > start

    def near(self, start: int, end: int) -> bool:
        """Whether a base span begins less than ``NEAR`` from ``end``, or ends less than that from ``start``."""
        return any(bisect_right(at, x - NEAR) < bisect_left(at, x + NEAR) for at, x in ((self.starts, end), (self.ends, start)))


def candidates(text: str) -> tuple[list[tuple[int, int, int]], list[Candidate]]:
    """The base spans and the judged candidates of a text; no candidate overlaps a base span."""
    names = [(m.start(1), 5, m.end(1)) for m in _name.finditer(text)] if any(s in text for s in _STEMS) else []
    if not names and not _any.search(text):
        return [], []
    base, bad = base_and_rejected(text)
    rest = [(s, 6 if k == 2 else k, e) for s, k, e in bad] + names
    rest += [(m.start(), 4, m.end()) for m in _secret.finditer(text) if re.search(r"[0-9]", m[0])]
    among = BaseSpans(base)
    return base, [_judge(text, s, e, k, among.near(s, e)) for s, k, e in sorted(rest) if not among.overlap(s, e)]


def vote_counts(docs: DataFrame) -> DataFrame:
    """How many candidates of all documents have each pair of votes and features."""

    def run(b: pa.RecordBatch) -> dict:
        c = Counter()
        for t in b.column("text").to_pylist():
            for x in candidates(t or "")[1]:
                c[",".join(map(str, x.votes)) + ";" + ",".join(map(str, x.features))] += 1
        return {"pattern": list(c), "n": list(c.values())}

    return map_rows(only(docs, "text"), run, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


def reliabilities(votes: np.ndarray, n: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation of a two-class model in which labelers vote independently given the class.

    Returns each vote pattern's posterior, each labeler's vote probabilities (labeler, class, vote) and the share of
    true spans. It starts from the majority vote, so the classes keep their meaning.
    """
    v = votes + 1
    p = np.clip(0.5 + 0.15 * ((votes == 1).sum(1) - (votes == 0).sum(1)), 0.05, 0.95)
    for _ in range(rounds):
        m = np.stack([n * (1 - p), n * p], 1)
        prior = np.clip(m[:, 1].sum() / m.sum(), 0.01, 0.99)
        theta = np.stack([[np.bincount(v[:, j], m[:, c], minlength=3) + 1 for c in (0, 1)] for j in range(v.shape[1])])
        theta /= theta.sum(2, keepdims=True)
        logs = np.log([1 - prior, prior]) + sum(np.log(theta[j][:, v[:, j]]).T for j in range(v.shape[1]))
        new = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -50, 50)))
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return p, theta, float(prior)


def fit(docs: DataFrame) -> np.ndarray | None:
    """The classifier's weights, learned from the votes of all documents; None where there is no candidate."""
    rows = sorted((r.pattern, r.n) for r in vote_counts(docs).collect())  # as many rows as there are patterns of votes and features
    if not rows:
        return None
    split = [r[0].split(";") for r in rows]
    votes, feats = (np.array([[int(x) for x in s[k].split(",")] for s in split]) for k in (0, 1))
    n = np.array([r[1] for r in rows], float)
    soft, _, _ = reliabilities(votes, n)
    w, x = np.zeros(feats.shape[1]), feats.astype(float)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (n * p * (1 - p))[:, None]).T @ x / n.sum() + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (n * (soft - p)) / n.sum() - 1e-3 * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    return w


def find(text: str, weights: np.ndarray | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans of a text, as (start, kind, end), sorted."""
    base, more = candidates(text)
    every, end = list(base), -1
    for c in more:
        if weights is not None and c.start >= end and 1 / (1 + np.exp(-float(np.dot(weights, c.features)))) >= ACCEPT:
            every.append((c.start, c.kind, c.end))
            end = c.end
    return base, sorted(every)


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def spans(docs: DataFrame, weights: np.ndarray | None) -> DataFrame:
    """Counts of base spans, a hash of them, and all spans, for each row of ``docs`` (doc_id, text).

    Null and empty texts have no spans. Repeated rows each give a row, with the same spans; a null doc_id stays null. Of
    spans that begin at one place the kind listed first comes first. Texts are searched whole, in time near linear in
    their length. Other columns are ignored. An empty table gives an empty result.
    """

    def run(b: pa.RecordBatch) -> dict:
        out: dict = {k: [] for k in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")}
        for t in b.column("text").to_pylist():
            base, every = find(t or "", weights)
            count = Counter(k for _, k, _ in base)
            for k, v in zip(out, (count[0], count[1], count[2], count[3], hashlib.sha256(told(base).encode()).hexdigest(), told(every))):
                out[k].append(v)
        return {"doc_id": b.column("doc_id")} | out

    return map_rows(only(docs, "doc_id", "text"), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame, weights: np.ndarray | None) -> DataFrame:
    """``docs`` with each span of its text replaced by its kind in brackets; all other columns pass through.

    Overlapping spans become one, named after the first; of spans that begin together, after the kind listed first. Null
    and empty texts stay as they are. Repeated rows each give a row. An empty table gives an empty result.
    """
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def clean(t: str | None) -> str | None:
        every = find(t, weights)[1] if t else []
        if not every:
            return t
        out, at = [], 0
        for s, k, e in every:
            if s >= at:
                out += [t[at:s], f"[{KINDS[k].upper()}]"]
            at = max(at, e)
        return "".join(out) + t[at:]

    def run(b: pa.RecordBatch) -> dict:
        return {n: [clean(t) for t in b.column("text").to_pylist()] if n == "text" else b.column(n) for n in fields}

    return map_rows(docs, run, ", ".join(f"`{n}` {t}" for n, t in fields.items()))


def op7_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans and the added ones of every whole document, by a classifier fitted on the votes of all of them."""
    docs = documents(spark, sf_dir)
    return spans(docs, fit(docs))
