"""Quality rules: the chain's fit against a plain one, the verdict against brute force, odd tables."""

import itertools
import os
import re
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from partita.llm import quality_crf

from .test_training import DATA, ODD, docs_of, needs_data


def by_enumeration(x, y, w, stay):
    """Gradient of the conditional log-likelihood of one sequence, over all label paths."""
    paths = list(itertools.product((0, 1), repeat=len(x)))
    score = np.array([sum(b * (r @ w) for b, r in zip(p, x)) + stay * sum(a == b for a, b in zip(p, p[1:])) for p in paths])
    share = np.exp(score - score.max())
    share /= share.sum()
    feats = lambda p: np.concatenate([sum((b * r for b, r in zip(p, x)), np.zeros(len(w))), [sum(a == b for a, b in zip(p, p[1:]))]])
    return feats(y) - sum(s * feats(p) for s, p in zip(share, paths))


@pytest.mark.parametrize("block", [1, 2, 3, 128])
def test_forward_and_backward_sums_over_blocks(block, monkeypatch):
    monkeypatch.setattr(quality_crf, "CHAIN_BLOCK", block)
    rng = np.random.default_rng(block)
    sizes = np.array([5, 1, 3, 8])
    e, stay = rng.normal(size=sizes.sum()), 0.7
    alpha, beta = quality_crf._Blocks(sizes).sums(e, stay)
    at = 0
    for n in sizes:
        part = slice(at, at + n)
        paths = np.array(list(itertools.product((0, 1), repeat=int(n))))
        score = paths @ e[part] + stay * (paths[:, 1:] == paths[:, :-1]).sum(1)
        z = np.logaddexp.reduce(score)
        for t in range(n):
            for lab in (0, 1):
                assert (alpha + beta)[at + t, lab] == pytest.approx(np.logaddexp.reduce(score[paths[:, t] == lab]))
            assert np.logaddexp(*(alpha + beta)[at + t]) == pytest.approx(z)
        at += n


def test_one_step_follows_the_gradient_of_all_paths():
    rng = np.random.default_rng(3)
    d = len(quality_crf.FEATURES)
    seqs = [rng.normal(size=(n, d)) for n in (4, 1, 6)]
    labels = [(rng.random(len(s)) < 0.5).astype(float) for s in seqs]
    start = np.concatenate([quality_crf.DEFAULT[0] * 0.1, [0.1]])
    g = sum(by_enumeration(s, lab, start[:d], start[d]) for s, lab in zip(seqs, labels)) / 11 - 1e-3 * start
    w, stay = quality_crf.fit_chain([*seqs, np.zeros((0, d))], [*labels, np.zeros(0)], rounds=1)
    assert np.allclose(np.concatenate([w, [stay]]) - start, 0.2 * g / (np.abs(g) + 1e-9), atol=1e-6)


def test_a_very_long_labelled_text_trains_in_bounded_memory():
    code = """
import numpy as np, resource
from partita.llm import quality_crf as q
rng = np.random.default_rng(1)
sizes = [5] * 1500 + [100_000]
labels = [(rng.random(n) < 0.4).astype(float) for n in sizes]
seqs = []
for y in labels:
    x = np.zeros((len(y), len(q.FEATURES)))
    x[:, 0], x[:, 1] = 1, y + 0.1 * rng.normal(size=len(y))
    seqs.append(x)
w, stay = q.fit_chain(seqs, labels)
right = np.mean(np.array(q.viterbi(seqs[-1] @ w, stay)) == labels[-1])
print(right, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, env={**os.environ, "PYTHONPATH": os.getcwd()}).stdout.split()
    assert float(out[0]) > 0.98 and int(out[1]) < 1 << 20  # kilobytes


def naive_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    hit = {j for i, k in enumerate(wins) if wins.count(k) > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def naive_verdict(text, model, least):
    n, *_, repeat = naive_counts(text)
    x, counts = quality_crf.line_features(text)
    if n < 10 or 100 * repeat > 20 * n:
        return False
    weights, stay = model
    e = x @ weights
    best = None
    for path in itertools.product((False, True), repeat=len(e)):
        s = sum(v for v, b in zip(e, path) if b) + stay * sum(a == b for a, b in zip(path, path[1:]))
        if best is None or s > best[0] + 1e-12:
            best = (s, path)
    return sum(c for c, b in zip(counts, best[1]) if not b) / n >= least


@needs_data
def test_counts_and_verdict_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = quality_crf.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    got = {r.doc_id: r for r in quality_crf.quality(docs, model).collect()}
    judged = 0
    for r in docs.collect():
        g, t = got[r.doc_id], r.text or ""
        if len(t) < 20_000:
            assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == naive_counts(t)
        if len(quality_crf.line_features(t)[1]) <= 12 and len(t) < 20_000:
            judged += 1
            assert g.kept == naive_verdict(t, model, quality_crf.MIN_CONTENT)
    assert judged > 50


def test_odd_tables(spark):
    d = docs_of(spark, [*ODD, "a b c d e f g h i j k l."] * 2, [*range(10), *range(10)]).withColumn("kept", F.lit("x")).withColumn("n_words", F.lit(-1)).withColumn("q", F.lit(0))
    rows = quality_crf.quality(d, quality_crf.DEFAULT).collect()
    assert len(rows) == 20 and len({(r.doc_id, r.n_words, r.kept) for r in rows}) == 10
    assert quality_crf.keep(d, quality_crf.DEFAULT).columns == d.columns
    labels = spark.createDataFrame([(9, 1, 0), (5, 0, 0), (5, 0, 1), (3, 1, 0), (3, 0, 0), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("no"))
    w, _ = quality_crf.train(d, labels)
    again, _ = quality_crf.train(d.repartition(3), labels)
    assert np.array_equal(w, again) and len(w) == len(quality_crf.FEATURES)
    assert quality_crf.train(d, labels, lines=0) is quality_crf.DEFAULT
    assert quality_crf.quality(d.limit(0), quality_crf.DEFAULT).count() == 0
