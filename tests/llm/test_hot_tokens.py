"""The n-gram join where very many texts share tokens."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from partita.llm import ngram_join

from .test_training import brute_components, docs_of, prose


@pytest.mark.parametrize("num, den", [(90, 100), (80, 100), (100, 100), (1, 2)])
def test_cross_pairs_are_those_that_positions_allow(spark, num, den):
    rng = random.Random(num)
    rows = [(rng.randint(0, 2), i, rng.randint(1, 40), rng.randint(0, 9), rng.randint(0, 12), False) for i in range(150)]
    rows = [(t, i, n + p, p, c, c == 3) for t, i, n, p, c, _ in rows]
    want = set()
    for x, y in itertools.combinations(rows, 2):
        both = min(x[2] - x[3], y[2] - y[3])
        if x[0] == y[0] and x[4] != y[4] and den * both >= num * (x[2] + y[2] - both):
            want.add((min(x[1], y[1]), max(x[1], y[1]), x[0]))
    d = spark.createDataFrame(rows, "token long, doc_id long, n long, pos int, comp long, in_main boolean")
    for limit in (10, 4_000_000):
        got = [(min(r.a, r.b), max(r.a, r.b), r.token) for r in ngram_join.cross_pairs(d, num, den, limit).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_a_template_of_many_texts_that_do_not_link_forms_no_pairs(spark):
    """20,000 texts of one template with private words in front: 12 of 100 shingles are private, so nothing links."""
    rows = [(7, i, 100 + i % 3, 12, i, False) for i in range(20_000)]
    d = spark.createDataFrame(rows, "token long, doc_id long, n long, pos int, comp long, in_main boolean")
    assert ngram_join.cross_pairs(d, 90, 100).count() == 0


def test_template_texts_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT", 4)
    monkeypatch.setattr(ngram_join, "PAIRS_A_TASK", 50)
    rng = random.Random(8)
    template = prose(rng, 60).split()
    texts = []
    for i in range(160):
        w = list(template)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
            w[rng.randrange(60)] = f"x{i}{rng.randrange(99)}"
        texts.append(" ".join(w))
    for k, num in ((3, 90), (5, 80)):
        sizes, comp = brute_components(texts, k, num, 100)
        got = {r.doc_id: r for r in ngram_join.components(docs_of(spark, texts).withColumn("token", F.lit(0)), k, num, 100).collect()}
        assert [got[i].component_id for i in range(len(texts))] == comp and [got[i].n_shingles for i in range(len(texts))] == sizes
