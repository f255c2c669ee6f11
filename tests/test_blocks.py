"""Kernels whose entries are never listed, against numpy and against listed entries."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from partita.operators import similarity, transport
from partita.operators.similarity import Kernel


@pytest.fixture
def narrow(monkeypatch):
    monkeypatch.setattr(similarity, "WIDE", 16)
    monkeypatch.setattr(similarity, "STRIP", 5)


def _rows(spark, n=61):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 4))
    x[7] = x[3]
    df = spark.createDataFrame([(i * 3, [float(v) for v in r], i % 3 % 2, 1.0 + i % 4) for i, r in enumerate(x)] + [(1, None, 0, 1.0)], "obs_id long, x array<double>, fold int, w double")
    return x, df


def test_kernel_sums_of_more_rows_than_are_listed(spark, monkeypatch, narrow):
    x, df = _rows(spark)
    d2 = ((x[:, None] - x) ** 2).sum(-1)
    listed = similarity.kernel_edges(df, "rbf", 0.5).cache()
    listed.count()
    monkeypatch.setattr(similarity, "kernel_edges", None)
    k = Kernel(df, "rbf", 0.5)
    got = {r.obs_id: (r.row_sum, r.n) for r in k.row_sums().collect()}
    assert {i: v[0] for i, v in got.items()} == pytest.approx({i * 3: v for i, v in enumerate(np.exp(-0.5 * d2).sum(1))})
    assert {v[1] for v in got.values()} == {61}
    assign = df.where("x is not null")
    a, b = (transport.mmd_pairs(e, assign).collect() for e in (k, listed))
    assert len(a) == len(b) == 1 and (a[0].fold_a, a[0].fold_b) == (0, 1) and a[0].mmd2 == pytest.approx(b[0].mmd2)
    a, b = ({r.obs_id: r.gradient for r in transport.mmd_gradient(e, assign).collect()} for e in (k, listed))
    assert len(a) == 61 and a == pytest.approx(b)
    assert tuple(transport.mmd_scales(k).first()) == pytest.approx(tuple(transport.mmd_scales(listed).first()))


@pytest.mark.parametrize("most", [0, 50])
def test_median_of_all_pairs_is_exact(spark, monkeypatch, narrow, most):
    monkeypatch.setattr(similarity, "LISTED", most)
    for n in (60, 61):
        x, df = _rows(spark, max(n, 8))
        df = df.where(F.col("obs_id") < 3 * n)
        d2 = ((x[:n, None] - x[:n]) ** 2).sum(-1)
        assert similarity.median_bandwidth(df).first().bandwidth == pytest.approx(np.median(d2), abs=1e-12)
        for level in (0.1, 1.0):
            assert Kernel(df, "dot").middle(level) == pytest.approx(np.quantile(x[:n] @ x[:n].T, level))
    same = df.withColumn("x", F.array(F.lit(2.0)))
    assert similarity.median_bandwidth(same).first().bandwidth == 0.0
    assert similarity.median_bandwidth(df.limit(0)).first().bandwidth is None
    assert Kernel(df.limit(0)).row_sums().count() == 0


def test_empty_kernels_have_no_terms(spark):
    _, df = _rows(spark)
    k = Kernel(df.limit(0))
    assert transport.mmd_pairs(k, df.limit(0)).count() == transport.mmd_gradient(k, df.limit(0)).count() == 0
    assert tuple(transport.mmd_scales(k).first()) == (None, None)


def test_packed_edges_give_what_listed_ones_give(spark, monkeypatch, narrow):
    from partita.operators import assign, graph, select

    monkeypatch.setattr(similarity, "PACKED", 9)
    _, df = _rows(spark)
    listed, packed = similarity.edges_within(df, "cosine", 0.3).cache(), similarity.packed_edges(df, "cosine", 0.3)
    pairs = {(e.src, e.dst): e.val for e in listed.collect()}
    got = packed.listed().collect()
    assert len(got) == len(pairs) > 300 and {(e.src, e.dst): e.val for e in got} == pytest.approx(pairs)
    some = df.where("obs_id % 7 <> 0")  # edges of rows without a fold drop out
    for a in (df, some):
        for f in (graph.cut_energy, graph.leakage):
            assert tuple(f(packed, a).first()) == pytest.approx(tuple(f(listed, a).first()))
    three = some.withColumn("fold", (F.col("obs_id") % 3).cast("int"))
    x, y = ({(r.obs_id, r.fold): r.gradient for r in graph.cut_gradient(e, three, 3).collect()} for e in (packed, listed))
    assert x == pytest.approx(y)
    assert tuple(select.stage0_cut(df, packed, 20).first()) == pytest.approx(tuple(select.stage0_cut(df, listed, 20).first()))
    x, y = ({r.obs_id: r.fold for r in assign.swap_for_leakage(some, e, (0.3, 0.7)).collect()} for e in (packed, listed))
    assert x == y
    none = similarity.packed_edges(df, "cosine", 2.0)
    assert none.listed().count() == 0 and graph.cut_energy(none, df).first().energy == 0.0
    assert similarity.packed_edges(df.limit(0), "cosine", 0.3).listed().count() == 0
