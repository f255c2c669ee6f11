"""Small fixtures with results worked out by hand or by brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from partita.functions import prefix
from partita.functions.prefix import running_sums
from partita.operators import assign, baselines, coarsen, folds, graph, prep, similarity, stratify, transport
from partita.plans import catalogue, fixtures
from partita.plans.engine import SplitSpec, level_tables, multi_split, split, sweep


def cliques(spark):
    e = [(a, b, 1.0) for c in (range(4), range(4, 8)) for a in c for b in c if a != b] + [(3, 4, 0.5), (4, 3, 0.5)]
    return spark.createDataFrame(e, "src long, dst long, val double")


def test_cut_of_two_cliques_is_the_bridge_both_ways(spark):
    a = spark.createDataFrame([(i, int(i >= 4)) for i in range(8)], "obs_id long, fold int")
    assert graph.cut_energy(cliques(spark), a).first().energy == 1.0
    one = a.withColumn("fold", F.lit(0))
    assert graph.leakage(cliques(spark), one).first().scaled == 0.0


def test_cut_gradient_is_the_derivative(spark):
    rng = np.random.default_rng(1)
    m = rng.random((6, 6))
    m = np.triu(m, 1) + np.triu(m, 1).T
    z = np.eye(2)[[0, 1, 0, 0, 1, 1]]
    e = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(6) for j in range(6) if i != j], "src long, dst long, val double")
    a = spark.createDataFrame([(i, int(z[i, 1])) for i in range(6)], "obs_id long, fold int")
    want = 2 * (np.diag(m.sum(1)) - m) @ z
    for r in graph.cut_gradient(e, a).collect():
        assert r.gradient == pytest.approx(want[r.obs_id, r.fold])


def test_galerkin_keeps_the_cut_of_lifted_folds(spark):
    e = cliques(spark)
    lab = spark.createDataFrame([(i, i // 2) for i in range(8)], "obs_id long, super_id long")
    sf = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1)], "super_id long, fold int")
    lifted = coarsen.lift(lab, sf)
    assert graph.cut_energy(graph.galerkin(e, lab), sf.withColumnRenamed("super_id", "obs_id")).first().energy == graph.cut_energy(e, lifted).first().energy


def test_two_fold_assignment_is_optimal(spark):
    rng = np.random.default_rng(0)
    for case in range(6):
        n, share, eps = 7, 3 / 7, 1 / 7 + 1e-9
        delta = rng.normal(size=n).round(3)
        df = spark.createDataFrame([(i, 1.0, float(delta[i])) for i in range(n)], "obs_id long, w double, delta double")
        got = [r.fold for r in assign.assign_two(df, share, eps).orderBy("obs_id").collect()]
        best = min(float(np.dot(z, delta)) for z in itertools.product((0, 1), repeat=n) if abs(sum(z) - 3) <= 1)
        assert float(np.dot(got, delta)) == pytest.approx(best), case


def test_running_sums_do_not_depend_on_ranges(spark):
    df = spark.createDataFrame([(i, float(i % 5), 1.0 + i) for i in range(40)], "obs_id long, v double, w double")
    a, b = (sorted((r.obs_id, r.c) for r in running_sums(df, "v", {"c": "w"}, rows=k).collect()) for k in (100, 7))
    assert a == b
    a, b = (sorted((r.obs_id, r.c) for r in running_sums(df, "v", {"c": "w"}, keys=("v",), ties=("obs_id",), rows=k).collect()) for k in (100, 7))
    assert a == b


def test_integrity_counts_split_groups_and_no_rows_of_empty_ones(spark):
    m = spark.createDataFrame([("a", 1, 0, 1.0), ("a", 1, 0, 2.0), ("a", 2, 0, 1.0), ("a", 2, 1, 1.0)], "level string, group_id long, fold int, w double")
    rows = {r.level: r for r in folds.group_integrity(m).collect()}
    assert (rows["a"].groups, rows["a"].split, rows["a"].intact_mass, rows[None].mass) == (2, 1, 3.0, 5.0)


def test_majority_ties_go_to_the_lower_fold_and_null_entities_stay(spark):
    d = spark.createDataFrame([(1, "x", 1, 1.0), (2, "x", 0, 1.0), (3, None, 1, 1.0)], "obs_id long, e string, fold int, w double")
    assert {r.obs_id: r.fold for r in folds.entity_repair(d, "e").collect()} == {1: 0, 2: 0, 3: 1}


def test_moments_and_distances_of_equal_folds(spark):
    d = spark.createDataFrame([(i, i % 2, 1.0, 5.0) for i in range(8)], "obs_id long, fold int, w double, y double")
    assert stratify.wasserstein1(d).first().w1 == 0
    assert [r.ks for r in stratify.ks(d).collect()] == [0.0, 0.0]
    assert all(r.residual == 0 for r in stratify.moment_residual(d).collect())


def test_moment_gradient_is_the_derivative(spark):
    rng = np.random.default_rng(3)
    y, w, f = rng.normal(size=8), np.ones(8), np.array([0, 0, 0, 0, 1, 1, 1, 1])
    d = spark.createDataFrame([(i, int(f[i]), 1.0, float(y[i])) for i in range(8)], "obs_id long, fold int, w double, y double")
    every = y.mean()

    def loss(m):
        return (np.dot(m[f == 0], y[f == 0]) / m[f == 0].sum() - every) ** 2

    g = {r.obs_id: r.gradient for r in stratify.moment_gradient(d).collect()}
    for i in range(4):
        up, down = w.copy(), w.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        assert g[i] == pytest.approx((loss(up) - loss(down)) / 2e-6, abs=1e-6)


def test_sinkhorn_meets_the_marginals(spark):
    rng = np.random.default_rng(2)
    c = rng.random((12, 3))
    d = spark.createDataFrame([(1.0, [float(v) for v in r]) for r in c], "w double, c array<double>")
    g, cost = transport.sinkhorn(d, [0.5, 0.3, 0.2], 0.1, 200)
    z = (np.array(g) - c) / 0.1
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True) / 12
    assert p.sum(0) == pytest.approx([0.5, 0.3, 0.2], abs=1e-6)
    assert cost == pytest.approx((p * c).sum(), abs=1e-9)


def test_blocks_give_the_pairs_of_one_block(spark, monkeypatch):
    rng = np.random.default_rng(4)
    d = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=5)]) for i in range(60)] + [(99, None)], "obs_id long, x array<double>")
    rows = lambda: sorted((r.src, r["rank"], r.dst, round(r.val, 9)) for r in similarity.nearest(d, d, 3).collect())
    want = rows()
    monkeypatch.setattr(similarity, "BLOCK", 16)
    assert rows() == want and len(want) == 180


def test_components_include_isolated_rows_and_long_paths(spark):
    e = [(i, i + 1, 1.0) for i in range(20)]
    e = spark.createDataFrame(e + [(b, a, v) for a, b, v in e], "src long, dst long, val double")
    got = {r.obs_id: r.component for r in graph.components(e, spark.range(25).withColumnRenamed("id", "obs_id")).collect()}
    assert {got[i] for i in range(21)} == {0} and [got[i] for i in range(21, 25)] == [21, 22, 23, 24]


def test_two_tier_lookup_refuses_ambiguous_keys(spark):
    d = spark.createDataFrame([(1, "a", "x"), (2, "a", "z"), (3, "b", "q"), (4, "c", "x")], "obs_id long, k string, f string")
    ref = spark.createDataFrame([("a", "x", 0), ("a", "y", 0), ("b", "x", 0), ("b", "y", 1)], "k string, f string, v int")
    got = {r.obs_id: (r.v, r.tier) for r in prep.two_tier_lookup(d, ref, ("k", "f"), "k", "v").collect()}
    assert got == {1: (0, 1), 2: (0, 2), 3: (None, 0), 4: (None, 0)}


def test_composition_and_kmers(spark):
    d = spark.createDataFrame([("Fe2O3",), ("bad",), (None,)], "f string")
    got = [r.m for r in d.select(prep.parse_composition(F.col("f")).alias("m")).collect()]
    assert got[0] == pytest.approx({"Fe": 0.4, "O": 0.6}) and got[1:] == [None, None]
    assert spark.range(1).select(prep.kmers(F.lit("abcd"), 3).alias("k"), prep.kmers(F.lit("ab"), 3).alias("n")).first() == (["abc", "bcd"], [])


def test_balanced_kmeans_with_more_clusters_than_rows(spark):
    d = spark.createDataFrame([(i, 1.0, [float(i)]) for i in range(3)], "obs_id long, w double, x array<double>")
    assert [r.super_id for r in coarsen.balanced_kmeans(d, 5).orderBy("obs_id").collect()] == [0, 1, 2]


def test_split_finds_the_cliques(spark):
    obs = spark.createDataFrame([(i, 1.0) for i in range(8)], "obs_id long, w double")
    res = split(SplitSpec(obs, share=0.5, edges=cliques(spark), provenance="given", eps=0.01, max_iter=6))
    assert res.assignment.count() == 8
    assert {r.n for r in res.assignment.groupBy("fold").agg(F.count("*").alias("n")).collect()} == {4}
    assert res.history_table().where("term = 'M'").count() == len(res.history)


def test_split_keeps_entities_whole(spark):
    obs = spark.createDataFrame([(i, 1.0, i % 4) for i in range(16)], "obs_id long, w double, e long")
    a = split(SplitSpec(obs, share=0.5, edges=cliques(spark), provenance="given", entity="e", max_iter=3)).assignment
    assert folds.entity_straddle(a.join(obs, "obs_id"), "e").first().straddling == 0


def test_sweep_and_multi_split(spark):
    obs = spark.createDataFrame([(i, 1.0) for i in range(8)], "obs_id long, w double")
    spec = SplitSpec(obs, share=0.5, edges=cliques(spark), provenance="given", max_iter=2)
    table, best, results = sweep(spec, (1.0,), (0.5, 1.0), (1.0,))
    assert table.count() == 2 == len(results) and best.count() == 1
    assert multi_split(spec, 2, 0.5)[1].count() == 1


@pytest.mark.parametrize(
    "change, says",
    [({"edges": None}, "term"), ({"provenance": None}, "provenance"), ({"share": 1.5}, "share"), ({"stratify": True}, "needs y"), ({"entity": "nope"}, "no column"), ({"beta": -1.0}, "negative")],
)
def test_contradictory_inputs_raise(spark, change, says):
    obs = spark.createDataFrame([(i, 1.0) for i in range(8)], "obs_id long, w double")
    with pytest.raises(ValueError, match=says):
        SplitSpec(**({"obs": obs, "edges": cliques(spark), "provenance": "given"} | change)).check()


def test_duplicate_ids_and_weights_raise(spark):
    for rows, says in (([(1, 1.0), (1, 1.0)], "unique"), ([(1, 0.0)], "positive")):
        obs = spark.createDataFrame(rows, "obs_id long, w double")
        with pytest.raises(ValueError, match=says):
            SplitSpec(obs, edges=cliques(spark), provenance="given").check()


def test_baselines_cover_every_row_once(spark):
    d = spark.createDataFrame([(i, "a" if i % 3 else None, float(i % 4)) for i in range(20)], "obs_id long, g string, y double")
    for out in (baselines.random(d), baselines.stratified(d, "g"), baselines.group_stop(d, "g"), baselines.group_skip(d, "g"), baselines.ordered(d, F.col("y")), baselines.kfold(d, "g")):
        assert out.count() == 20 and out.where("fold is null").count() == 0


def test_hull_of_a_square(spark):
    from partita.operators import geometry

    pts = [(i, 0, float(u), float(v)) for i, (u, v) in enumerate(itertools.product((0, 1, 2), repeat=2))]
    d = spark.createDataFrame(pts + [(20, 1, 1.0, 0.5), (21, 1, 3.0, 1.0), (22, 1, 1.0, 3.0), (23, 1, 3.0, 3.0)], "obs_id long, fold int, u double, v double")
    assert sorted(geometry.training_hull(d)) == [(0.0, 0.0), (0.0, 2.0), (2.0, 0.0), (2.0, 2.0)]
    assert geometry.outside_hull_rate(d).first().rate == 0.75
    other = d.where("fold = 0").unionByName(d.where("fold = 0").selectExpr("obs_id", "1 as fold", "u + 1 as u", "v"))
    assert geometry.hull_overlap(other).first().iou == pytest.approx(2 / 6)


def test_swaps_keep_counts_and_bootstrap_surrounds_the_mean(spark):
    from partita.operators import select

    d = spark.createDataFrame([(i, i % 2) for i in range(6)], "obs_id long, fold int")
    g = spark.createDataFrame([(0, 5.0), (2, -1.0), (4, -9.0), (1, 1.0), (3, 0.5), (5, -3.0)], "obs_id long, gain double")
    got = {r.obs_id: r.fold for r in assign.swap_pairs(d, g).collect()}
    assert got == {0: 1, 1: 0, 2: 0, 3: 1, 4: 0, 5: 1}
    b = select.bootstrap_mean(spark.range(200).selectExpr("id as obs_id", "cast(id % 10 as double) as v"), "v").first()
    assert b.lo < b.mean < b.hi and b.mean == pytest.approx(4.5)


def test_source_edges_reads_every_pair(spark, tmp_path):
    rows = [(1, 2), (1, 2), (2, 1), (150, 7), (150, 7), (7, 150), (300, 300), (5000, 9)]
    spark.createDataFrame([(a, b, 1.0) for a, b in rows], "l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    w = {p: rows.count(p) for p in rows if p[0] != p[1]}
    want = {(a, b): float(max(w.get((a, b), 0), w.get((b, a), 0))) for p in w for a, b in (p, p[::-1])}
    got = catalogue.queries()["source_edges"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {(r.src, r.dst): r.val for r in got} == want


def test_laplace_kernel_sums_over_every_vector(spark):
    d = "/root/testdata/sf0.001"
    rows = fixtures.vectors(spark, d).select("obs_id", "x").collect()
    x = np.array([r.x for r in rows], np.float64)
    got = {r.src: r.row_sum for r in catalogue.queries()["laplace_kernel"](spark, d).collect()}
    want = {r.obs_id: float(np.exp(-0.1 * np.abs(x - v).sum(1)).sum()) for r, v in zip(rows, x)}
    assert len(rows) > 100 and got == pytest.approx(want, abs=2e-6)


def test_one_value_is_split_by_its_ties_into_ranges_of_bounded_size(spark):
    df = spark.range(20_000).select(F.col("id").alias("obs_id"), F.lit(1.0).alias("v"), F.lit(1).alias("w"))
    ranged = prefix._ranged(df, 20_000, 1000, ("v", "obs_id"))
    sizes = [r["count"] for r in ranged.groupBy("_range").count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 2500
    out = running_sums(df, "v", {"c": "w"}, ties=("obs_id",), rows=1000)
    assert out.where("c <> obs_id + 1").count() == 0 and out.count() == 20_000


def test_percentiles_and_next_values_over_ranges(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=300).round(2), [0.5] * 200])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)] + [(999, None)], "obs_id long, v double")
    levels = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    for rows in (10, 10_000):
        assert prefix.percentiles(df, "v", levels, rows).first().q == pytest.approx(np.quantile(x, levels).tolist())
    d = df.where("v is not null").select("v").distinct().withColumn("key", F.col("v") > 0)
    a, b = (sorted(map(str, prefix.next_value(d, "v", "n", ("key",), rows).collect())) for rows in (9, 10_000))
    assert a == b


def test_leaders_cover_every_row_of_an_arc(spark):
    angles = [i * 0.02 for i in range(60)]
    df = spark.createDataFrame([(i, [float(np.cos(t)), float(np.sin(t))]) for i, t in enumerate(angles)], "obs_id long, x array<double>")
    got = {r.obs_id: r.leader for r in baselines.leaders(df, 0.999).collect()}
    assert len(got) == 60 and all(np.cos(angles[i] - angles[j]) >= 0.999 - 1e-9 for i, j in got.items())


def test_large_cliques_are_refused(spark):
    nodes = spark.createDataFrame([(i, 0) for i in range(5)], "obs_id long, key int")
    none = spark.createDataFrame([], "src long, dst long, val double")
    assert graph.singleton_clique(none, nodes, 1.0, 5).count() == 20
    with pytest.raises(ValueError):
        graph.singleton_clique(none, nodes, 1.0, 4)


def test_first_fit_by_sizes_is_that_of_groups_one_by_one(spark):
    rng = np.random.default_rng(7)
    for case in range(3):
        sizes = rng.integers(1, 9, 40)
        df = spark.createDataFrame([(100 * g + i, f"g{g}") for g, n in enumerate(sizes) for i in range(int(n))], "obs_id long, g string")
        got = {r.g: r.fold for r in baselines.group_skip(df, "g", 0.55).collect()}
        have, most = 0, 0.55 * sizes.sum()
        for g in sorted(range(40), key=lambda g: (-sizes[g], f"g{g}")):
            fits = have + sizes[g] <= most
            have += sizes[g] if fits else 0
            assert got[f"g{g}"] == (0 if fits else 1), case


def test_k_folds_keep_their_shares(spark):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i, 1.0, [float(v) for v in rng.normal(size=4)]) for i in range(400)], "obs_id long, w double, g array<double>")
    r = (0.4, 0.3, 0.2, 0.1)
    got = assign.assign_folds(df, r, 0.03).collect()
    n = np.bincount([x.fold for x in got], minlength=4)
    assert len({x.obs_id for x in got}) == 400 and np.abs(n / 400 - r).max() <= 0.03 + 4 / 400
    cost = {x.obs_id: x.g for x in df.collect()}
    assert sum(cost[x.obs_id][x.fold] for x in got) < -150


def test_contradictions_of_the_new_modes_are_refused(spark):
    obs = spark.createDataFrame([(i, 1.0, float(i), i % 3) for i in range(9)], "obs_id long, w double, y double, e int")
    for kw in ({"shares": (0.5, 0.6)}, {"shares": (1.0,)}, {"cold": "right"}, {"cold": "both", "other": "e"}, {"stratify": "no"}, {"supers": "gone"}):
        with pytest.raises(ValueError):
            split(SplitSpec(obs, **({"stratify": True} | kw)))


def _moments_of(y, w):
    m = np.average(y, weights=w)
    return np.array([m] + [np.average((y - m) ** p, weights=w) for p in (2, 3, 4)])


def test_moment_gradient_is_the_derivative_by_a_rows_mass(spark):
    rng = np.random.default_rng(1)
    y, w, f = rng.normal(size=20), rng.uniform(1, 2, 20), np.arange(20) % 2
    df = spark.createDataFrame([(i, float(a), float(b), int(c)) for i, (a, b, c) in enumerate(zip(y, w, f))], "obs_id long, y double, w double, fold int")
    got = {r.obs_id: r.gradient for r in stratify.moment_gradient(df, (1.0, 0.5, 0.2, 0.1)).collect()}
    omega, every = np.array([1.0, 0.5, 0.2, 0.1]), _moments_of(y, w)

    def value(i, step):
        v = w.copy()
        v[i] += step
        return (omega * (_moments_of(y[f == f[i]], v[f == f[i]]) - every) ** 2).sum()

    for i in range(20):
        assert got[i] == pytest.approx(w[i] * (value(i, 1e-6) - value(i, -1e-6)) / 2e-6, rel=1e-4, abs=1e-7)


def test_sliced_gradient_is_squared_distance_to_the_value_at_the_level(spark):
    rng = np.random.default_rng(2)
    rows = [(i, 1.0 + i % 2, rng.normal(size=1).tolist(), i % 2) for i in range(30)]
    df = spark.createDataFrame(rows, "obs_id long, w double, x array<double>, fold int")
    got = {(r.obs_id, r.fold): r.gradient for r in stratify.sliced_gradient(df, 1, 8).collect()}
    x, f, w = np.array([r[2][0] for r in rows]), np.array([r[3] for r in rows]), np.array([r[1] for r in rows])
    levels = (np.arange(8) + 0.5) / 8
    ways = []
    for sign in (1, -1):  # one direction in one dimension is +1 or -1
        want = {}
        for k in (0, 1):
            q, qa = np.quantile(sign * x[f == k], levels), np.quantile(sign * x, levels)
            for i in range(30):
                at = min(max(int((q <= sign * x[i]).sum()), 1), 8) - 1
                want[i, k] = w[i] / w[f == k].sum() * (sign * x[i] - qa[at]) ** 2
        ways.append(want)
    assert any(all(got[key] == pytest.approx(v, abs=1e-9) for key, v in want.items()) for want in ways)


def test_match_pulls_folds_to_their_targets(spark):
    obs = spark.createDataFrame([(i, 1.0, float(i % 10)) for i in range(200)], "obs_id long, w double, y double")
    spec = SplitSpec(obs, share=0.5, match=(0.0, 9.0), targets=((0.9, 0.1), (0.1, 0.9)), max_iter=4)
    res = split(spec)
    assert min(h["D"] for h in res.history) < 0.9 * res.history[0]["D"]
    d = res.assignment.join(obs, "obs_id")
    m = {r.fold: r.m for r in d.groupBy("fold").agg({"y": "avg"}).withColumnRenamed("avg(y)", "m").collect()}
    assert m[0] < m[1]
    assert transport.match_cost(transport.bin_costs(d, (0.0, 9.0)), spec.targets).count() == 2


def test_level_tables_and_the_term_of_levels(spark):
    obs = spark.createDataFrame([(i, 1.0, None if i == 9 else f"g{i % 3}", [1.0, float(i % 3 == 2)]) for i in range(12)], "obs_id long, w double, grp string, x array<double>")
    levels, members, edges = level_tables(obs, {"grp": 2.0}, 0.95)
    assert members.count() == 11 and "g0" in {r.group_id for r in members.collect()}
    assert {(r.g, r.h) for r in edges.collect()} == {("g0", "g0"), ("g1", "g1"), ("g2", "g2"), ("g0", "g1")}
    res = split(SplitSpec(obs.select("obs_id", "w", "grp"), share=0.5, levels=levels, members=members, level_edges=edges, max_iter=3))
    assert all(0 <= h["H"] <= 1 for h in res.history)
    assert min(h["H"] for h in res.history) <= res.history[0]["H"]


@pytest.mark.parametrize("bad", [{"match": (1.0,)}, {"match": (0.0, 1.0), "targets": ((1.0, 0.0),)}, {"stratify": "slices"}, {"stratify": "sliced"}, {"targets": ((1.0,), (1.0,)), "stratify": True}])
def test_contradictory_terms_are_refused(spark, bad):
    obs = spark.createDataFrame([(1, 1.0, 2.0)], "obs_id long, w double, y double")
    with pytest.raises(ValueError):
        split(SplitSpec(obs, **bad))


def test_rounds_end_when_little_is_gained(spark):
    obs = spark.createDataFrame([(i, 1.0, float(i * 7 % 50)) for i in range(100)], "obs_id long, w double, y double")
    res = split(SplitSpec(obs, stratify=True, mu=1.0, least_gain=1e9, patience=9))
    assert res.stopped in ("flat", "still") and all("moved" in h for h in res.history)


def test_tables_wide_exports_and_metadata_come_back_from_files(spark, tmp_path):
    import json

    from partita.sources import writers

    a = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("b", 1, 1), ("b", 2, 1)], "config_id string, obs_id long, fold int")
    writers.write_wide(a, ["a", "b"], str(tmp_path / "wide"))
    wide = spark.read.parquet(str(tmp_path / "wide"))
    assert sorted(tuple(r) for r in wide.select("obs_id", "a", "b").collect()) == [(1, 0, 1), (2, 1, 1)]
    for kind in ("csv", "json", "parquet"):
        writers.write_table(a, str(tmp_path / kind), kind)
        back = spark.read.option("header", True).csv(str(tmp_path / kind)) if kind == "csv" else spark.read.format(kind).load(str(tmp_path / kind))
        assert sorted((r.config_id, int(r.obs_id), int(r.fold)) for r in back.collect()) == sorted(tuple(r) for r in a.collect())
    writers.write_metadata(spark, {"seed": 4, "terms": ["M", "S"]}, str(tmp_path / "meta"))
    assert json.loads(spark.read.text(str(tmp_path / "meta")).first().value) == {"seed": 4, "terms": ["M", "S"]}


def test_a_kernel_without_a_worst_scale_falls_back(spark):
    from partita.plans.engine import normalisers

    obs = spark.createDataFrame([(1, 1.0), (2, 1.0)], "obs_id long, w double")
    flat = spark.createDataFrame([(i, j, 1.0) for i in (1, 2) for j in (1, 2)], "src long, dst long, val double")
    loose = flat.where("src <> dst")
    assert normalisers(SplitSpec(obs, kernel=flat))["kernel"] == 1.0
    assert normalisers(SplitSpec(obs, kernel=loose))["kernel"] == 1.0
