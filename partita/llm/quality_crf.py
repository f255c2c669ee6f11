"""Quality rules: base counts of each document, and a linear-chain conditional random field over its lines.

Each \\n-separated line with a word gets features; the field's Viterbi path marks it content or boilerplate, and the share
of a document's words in content lines decides whether it is kept.

The field is trained here. Labels are per document, so line labels are found in two rounds: lines of low-quality
documents start as boilerplate, a logistic model relabels them, then the chain is fitted to the relabelled sequences.
Training reads at most ``TRAIN_DOCS`` labelled documents of at most ``TRAIN_LINES`` lines, those with the smallest hash
of doc_id; where there are no labels of both kinds, documented default weights hold.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, documents, drop_cache, map_rows, mix, only, text_batches, written

#: Bounds of the labelled sample that the field is fitted on: documents, and lines of all of them.
TRAIN_DOCS, TRAIN_LINES = 1500, 400_000
#: Lines of a block of a sequence, see :class:`_Blocks`.
CHAIN_BLOCK = 128
#: A document is kept if at least this share of its words is in content lines.
MIN_CONTENT = 0.5

_words = re.compile(r"[^\x20\x09-\x0D]+").findall
_symbols = re.compile(r"[#*$%&|<>]").findall
_upper = re.compile(r"[A-ZÀ-ÖØ-Þ]").findall
_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
FEATURES = ("bias", "symbols", "bars", "upper", "repeats", "no_stop", "short", "length", "digits", "marks", "earlier", "word_length")
#: Used where nothing can be fitted: emission scores for boilerplate, and one score for staying in a label.
DEFAULT = (np.array([-2.0, 4.0, 6.0, 5.0, 5.0, 0.3, 0.3, -0.3, 1.0, 2.0, 0.3, 0.0]), 0.7)


def line_features(text: str) -> tuple[np.ndarray, list[int]]:
    """Features of each line that has a word, and the lines' word counts."""
    rows, counts, seen = [], [], set()
    for line in text.split("\n"):
        w = _words(line)
        n = len(w)
        if not n:
            continue
        chars = sum(map(len, w))
        rows.append((
            1.0, min(len(_symbols(line)) / n, 2.0), w.count("|") / n, len(_upper(line)) / chars, 1 - len(set(w)) / n if n > 3 else 0.0,
            0.0 if w[-1][-1] in ".!?:;\"')" else 1.0, 1.0 if n < 4 else 0.0, min(n, 100) / 50, sum(map(line.count, "0123456789")) / chars,
            min(line.count("!") / n, 1.0), 1.0 if line in seen else 0.0, min(chars / n, 20) / 10,
        ))
        seen.add(line)
        counts.append(n)
    return np.array(rows).reshape(len(rows), len(FEATURES)), counts


def viterbi(scores: np.ndarray, stay: float) -> list[bool]:
    """The best label path of one document; True is boilerplate. Ties go to content."""
    a, b, back = 0.0, 0.0, []
    for s in scores.tolist():
        # a: best score that ends in content, b: in boilerplate
        from_b, to_b = b > a + stay, b + stay > a
        back.append((from_b, to_b))
        a, b = (b if from_b else a + stay), (b + stay if to_b else a) + s
    path, now = [], b > a
    for from_b, to_b in reversed(back):
        path.append(now)
        now = to_b if now else from_b
    return path[::-1]


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, rounds: int = 25) -> np.ndarray:
    """Newton's method for a ridge logistic regression on weights 0..1."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + l2 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) / len(y) - l2 * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


class _Blocks:
    """Sequences cut into blocks of at most ``CHAIN_BLOCK`` lines, for forward and backward sums of the two-label chain.

    Lines are held once, in their order; the sums go through all blocks at a time, line by line, and then from block to
    block. So memory follows the number of lines, and steps that of a block's lines and of the longest text's blocks.
    """

    def __init__(self, sizes: np.ndarray):
        begin = np.cumsum(sizes) - sizes
        count = -(-sizes // CHAIN_BLOCK)
        self.seq = np.repeat(np.arange(len(sizes)), count)
        nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        self.start = begin[self.seq] + nth * CHAIN_BLOCK
        self.size = np.minimum(CHAIN_BLOCK, sizes[self.seq] - nth * CHAIN_BLOCK)
        self.steps = [np.flatnonzero(self.size > t) for t in range(CHAIN_BLOCK)]
        self.steps = [on for on in self.steps if len(on)]
        self.chained = [np.flatnonzero(nth == r) for r in range(1, int(count.max()))]  # the blocks that follow their r-th

    def sums(self, e: np.ndarray, stay: float) -> tuple[np.ndarray, np.ndarray]:
        """Log forward and backward sums (line, label) for emission scores ``e`` of boilerplate."""
        trans, n = np.array([[stay, 0.0], [0.0, stay]]), len(self.start)
        gain = lambda i: np.stack([np.zeros(len(i)), e[i]], 1)
        # What a block does to the label before it: m[i, j], from label i before it to j at its last line.
        m = np.zeros((n, 2, 2))
        for t, on in enumerate(self.steps):
            g = gain(self.start[on] + t)[:, None, :]
            m[on] = (trans + g) if not t else np.logaddexp(m[on][:, :, :1] + trans[0], m[on][:, :, 1:] + trans[1]) + g
        enter = np.full((n, 2), -np.logaddexp(stay, 0.0))  # before the first line: adds up to nothing for either label
        leave = np.zeros((n, 2))
        for on in self.chained:
            enter[on] = np.logaddexp(enter[on - 1][:, :1] + m[on - 1][:, 0], enter[on - 1][:, 1:] + m[on - 1][:, 1])
        for on in self.chained[::-1]:
            leave[on - 1] = np.logaddexp(m[on][:, :, 0] + leave[on][:, :1], m[on][:, :, 1] + leave[on][:, 1:])
        alpha, beta = np.empty((len(e), 2)), np.empty((len(e), 2))
        for t, on in enumerate(self.steps):
            i = self.start[on] + t
            was = enter[on] if not t else alpha[i - 1]
            alpha[i] = np.logaddexp(was[:, :1] + trans[0], was[:, 1:] + trans[1]) + gain(i)
        beta[self.start + self.size - 1] = leave
        for t in range(len(self.steps) - 1, 0, -1):
            i = self.start[self.steps[t]] + t
            nxt = beta[i] + gain(i)
            beta[i - 1] = np.logaddexp(nxt[:, :1] + trans[:, 0], nxt[:, 1:] + trans[:, 1])
        return alpha, beta


def fit_chain(seqs: list[np.ndarray], labels: list[np.ndarray], l2: float = 1e-3, rounds: int = 150, rate: float = 0.2) -> tuple[np.ndarray, float]:
    """Emission weights and the stay score of the two-label chain, by gradient ascent (Adam) on the conditional likelihood.

    Empty sequences say nothing and are left out; there must be one that is not.
    """
    kept = [i for i, s in enumerate(seqs) if len(s)]
    x, y = np.concatenate([seqs[i] for i in kept]), np.concatenate([labels[i] for i in kept])
    sizes = np.array([len(seqs[i]) for i in kept])
    blocks, d, total = _Blocks(sizes), x.shape[1], len(y)
    first = np.zeros(total, bool)
    first[np.cumsum(sizes) - sizes] = True
    at = np.flatnonzero(~first)  # lines with one before them
    seen_x, seen_stay = y @ x, float((y[at] == y[at - 1]).sum())
    last = np.repeat(np.cumsum(sizes) - 1, sizes)
    theta, m, v = np.concatenate([DEFAULT[0] * 0.1, [0.1]]), np.zeros(d + 1), np.zeros(d + 1)
    for r in range(1, rounds + 1):
        w, stay = theta[:d], theta[d]
        e = x @ w
        alpha, beta = blocks.sums(e, stay)
        z = np.logaddexp(alpha[last, 0], alpha[last, 1])
        p = np.exp(alpha[:, 1] + beta[:, 1] - z)
        both = alpha[at - 1] + stay + np.stack([np.zeros(len(at)), e[at]], 1) + beta[at] - z[at, None]
        g = np.concatenate([seen_x - p @ x, [seen_stay - np.exp(np.minimum(both, 0)).sum()]]) / total - l2 * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-9)
    return theta[:d], float(theta[d])


def train(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_DOCS, lines: int = TRAIN_LINES) -> tuple[np.ndarray, float]:
    """Fit the field on the labelled sample. ``labels`` has doc_id and quality; rows with a null in either, or with both
    values for one doc_id, are left out.

    The sample is the ``bound`` labelled documents with the smallest hash of doc_id, less those that would bring the lines
    read above ``lines``, in that order; its texts are read whole. Of rows that share a doc_id the text that sorts first
    counts. Null and empty texts say nothing. Without lines of both kinds, as for empty tables, ``DEFAULT`` is returned.
    """
    given = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("q2"))
    sample = given.where("q = q2").orderBy(mix(F.col("doc_id"), 11), "doc_id").limit(bound)
    found = only(docs, "doc_id", "text").join(F.broadcast(sample.select("doc_id", F.col("q").cast("int").alias("q"))), "doc_id")
    text = written(found.groupBy("doc_id", "q").agg(F.min("text").alias("text")), "quality-sample")  # at most ``bound`` rows
    sizes = text.select("doc_id", mix(F.col("doc_id"), 11).alias("h"), F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n")).collect()
    picked, room = [], lines
    for r in sorted(sizes, key=lambda r: (r.h, r.doc_id)):
        if r.n <= room:
            picked.append((r.doc_id,))
            room -= r.n
    chosen = text.join(F.broadcast(docs.sparkSession.createDataFrame(picked, "doc_id long")), "doc_id")

    def run(b: pa.RecordBatch) -> dict:
        feats = [line_features(t or "")[0] for t in b.column("text").to_pylist()]
        return {"doc_id": b.column("doc_id"), "q": b.column("q"), "x": [f.astype("<f8").tobytes() for f in feats]}

    rows = sorted(((r.doc_id, bytes(r.x), r.q) for r in map_rows(chosen.select("doc_id", "text", "q"), run, "doc_id long, q int, x binary").collect()))
    discard(text)
    seqs = [np.frombuffer(x, "<f8").reshape(-1, len(FEATURES)) for _, x, _ in rows]
    bad = [q == 0 for *_, q in rows]
    seqs, bad = zip(*[(s, b) for s, b in zip(seqs, bad) if len(s)]) if any(map(len, seqs)) else ((), ())
    if not any(bad) or all(bad):
        return DEFAULT
    x = np.concatenate(seqs)
    y = np.concatenate([np.full(len(s), float(b)) for s, b in zip(seqs, bad)])
    w = fit_logistic(x, y)
    marked = [np.full(len(s), 0.0) if not b else (s @ w > 0).astype(float) for s, b in zip(seqs, bad)]
    return fit_chain(list(seqs), marked)


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    w = text.encode("utf-8", "surrogatepass").split()
    n = len(w)
    seen: set[str] = set()
    dup = 0
    if n:
        for line in text.split("\n"):
            if line in seen:
                dup += 1
            elif line.strip(_SPACE):
                seen.add(line)
    repeat = 0
    if n > 5:
        win = list(zip(w, w[1:], w[2:], w[3:], w[4:]))
        if len(set(win)) < len(win):
            often = {k for k, c in Counter(win).items() if c > 1}
            end = 0
            for i, k in enumerate(win):
                if k in often:
                    repeat += i + 5 - max(i, end)
                    end = i + 5
    return n, len(text) - sum(map(text.count, _SPACE)), len(_symbols(text)), dup, repeat


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept")


def judge(text: str, model: tuple[np.ndarray, float], min_content: float = MIN_CONTENT) -> tuple:
    """The values of ``COLUMNS`` for a text."""
    weights, stay = model
    n, chars, symbols, dup, repeat = base_counts(text)
    failed = n < 10 or 100 * repeat > 20 * n
    x, counts = line_features(text)
    boiler = viterbi(x @ weights, stay) if len(x) else []
    share = sum(c for c, bad in zip(counts, boiler) if not bad) / n if n else 0.0
    return n, chars, symbols, dup, repeat, failed, share, not failed and share >= min_content


def quality(docs: DataFrame, model: tuple[np.ndarray, float], min_content: float = MIN_CONTENT) -> DataFrame:
    """Counts, base_failed, content_share and kept for each row of ``docs`` (doc_id, text).

    Null and empty texts have no words: all counts are 0, content_share is 0.0, base_failed is true and kept false.
    Repeated rows each give a row; a null doc_id stays null.
    """

    def run(b: pa.RecordBatch) -> dict:
        rows = [judge(t or "", model, min_content) for t in b.column("text").to_pylist()]
        return {"doc_id": b.column("doc_id")} | dict(zip(COLUMNS, map(list, zip(*rows))))

    return map_rows(only(docs, "doc_id", "text"), run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean")


def keep(docs: DataFrame, model: tuple[np.ndarray, float], min_content: float = MIN_CONTENT) -> DataFrame:
    """The rows of ``docs`` that :func:`quality` would keep, with all their columns.

    Null and empty texts go; repeated rows stay or go together; a share of exactly ``min_content`` stays. A null doc_id is
    one more value. An empty table stays empty.
    """
    text_batches(docs.sparkSession)

    def run(batches):
        drop_cache()
        for b in batches:
            yield b.filter(pa.array([judge(t or "", model, min_content)[-1] for t in b.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every whole document, by a field fitted on a bounded sample of the labelled ones."""
    docs = documents(spark, sf_dir)
    return quality(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
