"""Neighbour search: few probed lists, short lists, repeated and extreme vectors, against brute force."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from partita.llm import ann_scan


def table(spark, ids, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in zip(ids, x)], "vec_id long, embedding array<double>")


def found(df):
    got = collections.defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    return got


def brute(ids, x, q, k=5):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u[ids.index(q)]
    at = [i for i in range(len(ids)) if ids[i] != q]
    return [(ids[i], s[i]) for i in sorted(at, key=lambda i: (-round(s[i], 12), ids[i]))[:k]]


def test_recall_with_few_of_the_lists_probed(spark, monkeypatch):
    seen = []
    whole = ann_scan.Index.grouped
    monkeypatch.setattr(ann_scan.Index, "grouped", lambda self, *a: seen.append((self.probes, len(self.centroids))) or whole(self, *a))
    monkeypatch.setattr(ann_scan, "LEAST_GROUP", 200)
    rng = np.random.default_rng(11)
    x = rng.normal(size=(3000, 24)) + 4 * rng.normal(size=(40, 24))[rng.integers(0, 40, 3000)]
    ids = list(range(3000))
    got = found(ann_scan.nearest(table(spark, ids, x).repartition(3).withColumn("score", F.lit(1)).withColumn("list", F.lit("x"))))
    hit = sum(len({v for v, _ in brute(ids, x, q)} & {v for v, _ in got[q]}) for q in range(0, 3000, 50))
    assert hit / 300 >= 0.9 and len(got) == 60 and all(len(v) == 5 for v in got.values())
    probes, lists = seen[-1]
    assert lists == 55 and probes <= lists // 2


def test_a_query_in_a_tiny_list_still_finds_k(spark, monkeypatch):
    monkeypatch.setattr(ann_scan, "SAMPLE_RECALL", 0.0)  # one list probed
    rng = np.random.default_rng(12)
    x = rng.normal(size=(900, 8)) + 6 * rng.normal(size=(30, 8))[np.arange(900) % 30]
    x[0] = -50 * x[1:].mean(0)
    x[50:52] = [[1] + [0] * 7, [1, 0.01] + [0] * 6]
    got = found(ann_scan.nearest(table(spark, list(range(900)), x)))
    assert len(got) == 18 and all(len(v) == 5 and len({i for i, _ in v}) == 5 for v in got.values())


def test_few_candidates_repeats_and_extreme_lengths(spark):
    x = np.array([[1.0, 0, 0], [1, 1, 0], [0, 1, 0], [1e300, 1e300, 0], [1e-300, 0, 0]])
    got = found(ann_scan.nearest(table(spark, [0, 1, 2, 3, 3], x)))
    assert [v for v, _ in got[0]] == [3, 1, 3, 2]
    assert [s for _, s in got[0]] == pytest.approx([1, 0.5**0.5, 0.5**0.5, 0])
    same = found(ann_scan.nearest(table(spark, [0, 0, 1, 2, 2], np.array([[1.0, 0], [0, 1], [1, 1], [1, 2], [1, 2]]))))
    assert [v for v, _ in same[0]] == [2, 2, 1]  # the query is the row with the smallest bytes; its id's others are no candidates
    assert found(ann_scan.nearest(table(spark, [0], np.ones((1, 3))))) == {}


@pytest.mark.parametrize("seed", range(4))
def test_carried_bounds_lose_nothing_that_the_test_would_keep(seed):
    rng = np.random.default_rng(seed)
    x, q = rng.normal(size=(600, 16)), rng.normal(size=(30, 16))
    lists = rng.integers(0, 12, 600)
    of = ann_scan.Vectors.of
    probed = [rng.permutation(12)[: rng.integers(1, 12)] for _ in range(30)]
    i, j, s = ann_scan.scan_group(of(np.arange(600), x, None), lists, of(np.arange(1000, 1030), q, None), probed, np.full(30, np.inf), 4)
    u, v = x / np.linalg.norm(x, axis=1, keepdims=True), q / np.linalg.norm(q, axis=1, keepdims=True)
    for n in range(30):
        rows = np.flatnonzero(np.isin(lists, probed[n]))
        want = rows[np.argsort(-(u[rows] @ v[n]))][:4]
        assert j[i == n].tolist() == want.tolist() and s[i == n] == pytest.approx(u[want] @ v[n])
