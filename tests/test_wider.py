"""Group quantiles over many ranges, similarity joins over many blocks, class repair, entity folds, arrays, names, writers and grids, on small fixtures."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from partita.functions.prefix import group_percentiles
from partita.operators import assign, coarsen, folds, prep, select, similarity, stratify, transport
from partita.plans import engine, q_wider
from partita.plans.engine import SplitSpec, ablation, sweep_inputs
from partita.sources import readers, writers


@pytest.mark.parametrize("rows", [None, 16])
def test_group_percentiles_equal_numpy(spark, rows):
    rng = np.random.default_rng(3)
    data = [(k, float(v)) for k, n in (("hot", 150), ("few", 7), ("one", 1)) for v in np.round(rng.normal(size=n), 1)] + [("hot", None), (None, 2.0), (None, 4.0)]
    levels = (0.0, 0.1, 0.5, 0.77, 1.0)
    got = {r.k: r.q for r in group_percentiles(spark.createDataFrame(data, "k string, v double"), ["k"], "v", levels, rows).collect()}
    for k in ("hot", "few", "one", None):
        assert got[k] == pytest.approx(np.quantile([v for g, v in data if g == k and v is not None], levels))
    assert group_percentiles(spark.createDataFrame([], "k string, v double"), ["k"], "v", levels, rows).count() == 0


def test_class_repair_never_grows_a_gap_and_leaves_frozen_rows(spark):
    r = (0.5, 0.3, 0.2)
    data = [(i, 1.0 + i % 2, ("a", "b", None)[i % 3], 0 if i % 4 else 2, [0.0, float(i % 5), float(i % 7)], i % 10 == 0) for i in range(240)]
    df = spark.createDataFrame(data, "obs_id long, w double, cls string, fold int, cost array<double>, held boolean")
    out = assign.class_repair(df, r, "cls", "cost", "held")
    assert out.columns == df.columns
    after = {x.obs_id: x for x in out.collect()}
    assert all(after[d[0]].fold == d[3] for d in data if d[5])

    def gaps(rows):
        g = {}
        for c, f, w in rows:
            g[c, f] = g.get((c, f), 0.0) + w
        total = {c: sum(v for (k, _), v in g.items() if k == c) for c in ("a", "b", None)}
        return {(c, f): abs(g.get((c, f), 0.0) - r[f] * total[c]) for c in total for f in range(3)}

    before, now = gaps([(d[2], d[3], d[1]) for d in data]), gaps([(x.cls, x.fold, x.w) for x in after.values()])
    assert all(now[k] <= before[k] + 1e-9 for k in now) and sum(now.values()) < 0.3 * sum(before.values())


def test_class_repair_takes_the_cheapest(spark):
    df = spark.createDataFrame([(i, 1.0, "a", 0, [0.0, float(-i)]) for i in range(10)], "obs_id long, w double, cls string, fold int, cost array<double>")
    moved = assign.class_repair(df, (0.8, 0.2), "cls", "cost").where("fold = 1")
    assert sorted(x.obs_id for x in moved.collect()) == [8, 9]
    assert assign.class_repair(df.limit(0), (0.8, 0.2), "cls").count() == 0


def test_entity_folds_ties_absent_and_null(spark):
    a = spark.createDataFrame([("s0", 1, 1), ("s0", 2, 0), ("s0", 3, 1), ("s1", 1, 0), ("s0", 4, 1)], "config_id string, obs_id long, fold int")
    obs = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None)], "obs_id long, e string")
    assert sorted(map(tuple, folds.entity_folds(a, obs, "e", ("s0", "s1")).collect())) == [("x", 0, 0), ("y", 1, -1)]


def test_information_without_rows(spark):
    none = spark.createDataFrame([], "obs_id long, fold int, label string")
    assert folds.entropy(none, "label").first().entropy == 0.0
    one = spark.createDataFrame([(1, 0, "x"), (2, 1, None)], "obs_id long, fold int, label string")
    assert folds.entropy(one, "label").first().entropy == 0.0


def test_pearson_matrix_equals_numpy_and_constant_is_null(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(60, 2)) + 1e4
    df = spark.createDataFrame([(1.0, float(a), float(b), 3.0) for a, b in m] + [(1.0, None, 1.0, 3.0)], "w double, a double, b double, c double")
    got = {(x.a, x.b): x.r for x in stratify.pearson_matrix(df, ("a", "b", "c")).collect()}
    assert got["a", "b"] == pytest.approx(np.corrcoef(m.T)[0, 1]) and got["a", "c"] is None and len(got) == 3


def test_sliced_scale_is_the_trace(spark):
    x = np.random.default_rng(6).normal(size=(30, 3))
    got = stratify.sliced_scale(readers.read_arrays(spark, x), 3).first().scale
    assert got == pytest.approx(3 * np.trace(np.cov(x.T, bias=True)))


def test_gradient_magnitudes_first_name_of_ties(spark):
    g = spark.createDataFrame([("B", 1, 0, 3.0), ("A", 1, 0, 3.0)], "term string, obs_id long, fold int, g double")
    assert {x.term: x.dominant for x in select.gradient_magnitudes(g, {"A": 1.0, "B": 1.0}).collect()} == {"A": True, "B": False}


def test_adaptive_refine_keeps_small_groups(spark):
    df = spark.createDataFrame([(i, "big" if i < 30 else "small", float(i % 7)) for i in range(36)] + [(99, None, 0.0)], "obs_id long, g string, y double")
    cells = {x.obs_id: x.cell for x in coarsen.adaptive_refine(df, "g", "y", 6).collect()}
    assert 99 not in cells and {c for i, c in cells.items() if i >= 30} == {"small:0"}
    assert sorted(np.unique([c for i, c in cells.items() if i < 30], return_counts=True)[1]) == [6] * 5


def test_arrays_in_slices_and_shapes(spark):
    d = readers.read_arrays(spark, np.arange(10).reshape(5, 2), y=range(5), rows=2)
    assert [(r.obs_id, list(r.x), r.w, r.y) for r in d.orderBy("obs_id").collect()][3] == (3, [6.0, 7.0], 1.0, 3.0) and d.count() == 5
    assert readers.read_arrays(spark, np.zeros((0, 2))).count() == 0
    with pytest.raises(ValueError):
        readers.read_arrays(spark, [[1.0], [2.0]], w=[1.0])
    with pytest.raises(ValueError):
        readers.read_arrays(spark, [1.0, 2.0])


def test_prefix_and_derived(spark):
    df = spark.createDataFrame([(0.0, None, "x")], "p_a double, p_b double, a string")
    assert prep.rename_prefix(df, "p_", "q_").columns == ["q_a", "q_b", "a"]
    with pytest.raises(ValueError):
        prep.rename_prefix(df, "p_")
    r = prep.derived(df, {"ratio": ("p_a", "p_a"), "none": ("p_a", "p_b")}, {"l": "p_a", "ln": "p_b"}, {"c": ("p_b", 0, 1)}, 0.1).first()
    assert (r.ratio, r.none, r.l, r.ln, r.c) == (0.0, None, -1.0, None, None)


def test_writers_round_trip(spark, tmp_path):
    a = spark.createDataFrame([("s0", 1, 1), ("s1", 1, 0), ("s0", 2, 0)], "config_id string, obs_id long, fold int")
    writers.write_wide(a, ("s0", "s1"), f"{tmp_path}/wide")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/wide").select("obs_id", "s0", "s1").collect()), key=str) == [(1, 1, 0), (2, 0, None)]
    writers.write_metadata(spark, {"b": [1, 2], "a": "é"}, f"{tmp_path}/meta")
    assert json.loads(spark.read.text(f"{tmp_path}/meta").first().value) == {"a": "é", "b": [1, 2]}


def test_grids_have_a_row_for_each_choice(spark):
    obs = spark.createDataFrame([(i, 1.0, i // 4) for i in range(16)], "obs_id long, w double, grp int")
    edges = spark.createDataFrame([(a, b, 1.0) for g in range(4) for a in range(4 * g, 4 * g + 4) for b in range(4 * g, 4 * g + 4) if a != b], "src long, dst long, val double")
    spec = SplitSpec(obs, share=0.5, hierarchy="grp", edges=edges, provenance="by hand", max_iter=1)
    table, results = ablation(spec)
    assert sorted(x.config_id for x in table.collect()) == ["H", "HM", "M"] and set(results) == {"H", "HM", "M"}
    assert table.where("H > 1e-9 or M > 1e-9 or D is not null").count() == 0  # groups are whole, so nothing is cut
    swept, _ = sweep_inputs(spec, {"as is": {}, "half": {"beta": 0.5}})
    assert {x.config_id: x.imbalance for x in swept.collect()} == {"as is": 0.0, "half": 0.0}


def test_split_inputs_goes_on_until_it_settles(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6, 8))[rng.integers(0, 6, 240)] + rng.normal(size=(240, 8))
    rows = [(i, [float(v) for v in x[i]], "a") for i in range(240)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string").write.parquet(f"{tmp_path}/embeddings.parquet")
    done, split = [], engine.split
    monkeypatch.setattr(engine, "split", lambda *a: done.append(split(*a)) or done[-1])
    got = q_wider.QUERIES["split_inputs"](spark, str(tmp_path)).collect()
    assert sorted(x.config_id for x in got) == ["cosine_0.3", "cosine_0.4", "supers_40"] and len(done) == 3
    for res in done:
        values = [h["composite"] for h in res.history]
        assert res.stopped == "still" or res.stopped == "patience" and min(values[-3:]) >= min(values[:-3])  # no bound on rounds ended it
        assert res.assignment.count() == 240


def _random_sets(spark, seed, n):
    rng = np.random.default_rng(seed)
    sets = {}
    for i in range(n):
        # small changes of a few templates, so that sizes and overlaps lie about the bound, and a hot item in every set
        base = np.random.default_rng(i % 9).choice(60, 4 + 3 * (i % 9), replace=False)
        sets[i] = {int(v) for v in base if rng.random() > 0.15} | {int(v) for v in rng.choice(60, rng.integers(0, 4))} | {99}
    return sets, spark.createDataFrame([(i, f"t{v}", (None, "a", "b", "b")[i % 4]) for i, s in sets.items() for v in s], "obs_id long, item string, key string")


@pytest.mark.parametrize("bound", [0.0, 0.3, 0.5, 0.6, 0.8, 1.0])
@pytest.mark.parametrize("key", [None, "key"])
def test_set_edges_equal_brute_force(spark, bound, key):
    sets, rows = _random_sets(spark, 11, 60)
    side = {i: (None, "a", "b", "b")[i % 4] for i in sets}
    want = {}
    for i, s in sets.items():
        for j, t in sets.items():
            v = len(s & t) / len(s | t)
            if i != j and v >= bound and (key is None or side[i] is not None and side[i] == side[j]):
                want[i, j] = v
    got = similarity.set_edges(rows, bound, key).collect()
    assert len(got) == len({(e.src, e.dst) for e in got}) and {(e.src, e.dst): e.val for e in got} == pytest.approx(want)


@pytest.mark.parametrize("keyed", [False, True])
def test_blocks_meet_once_and_give_both_directions(spark, monkeypatch, keyed):
    monkeypatch.setattr(similarity, "BLOCK", 8)
    rng = np.random.default_rng(12)
    x = rng.normal(size=(45, 3))
    key = ["hot" if i < 30 else None if i == 44 else f"k{i % 3}" for i in range(45)]
    df = spark.createDataFrame([(i, [float(v) for v in r], k) for i, (r, k) in enumerate(zip(x, key))] + [(100, None, "hot")], "obs_id long, x array<double>, key string")
    d2 = ((x[:, None] - x) ** 2).sum(-1)
    want = {(i, j) for i in range(45) for j in range(45) if i != j and d2[i, j] <= 2.0 and (not keyed or key[i] is not None and key[i] == key[j])}
    got = [(e.src, e.dst) for e in similarity.edges_within(df, "sqdist", 2.0, same_key=keyed).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    if not keyed:
        k = {(e.src, e.dst): e.val for e in similarity.kernel_edges(df, "rbf", 0.5).collect()}
        assert len(k) == 45 * 45 and k[3, 40] == pytest.approx(np.exp(-0.5 * d2[3, 40]))
        sums = {r.obs_id: r.row_sum for r in similarity.kernel_row_sums(df, "rbf", 0.5).collect()}
        assert [sums[i] for i in range(45)] == pytest.approx(list(np.exp(-0.5 * d2).sum(1)))


def test_sinkhorn_of_folds_equals_numpy(spark):
    rng = np.random.default_rng(21)
    c, w, fold = rng.random((40, 3)) * 3, rng.random(40) + 0.1, np.arange(40) % 3
    targets = [[0.2, 0.5, 0.3], [1.0, 1.0, 2.0], [0.0, 0.5, 0.5], [0.5, 0.25, 0.25]]
    df = spark.createDataFrame([(i, int(fold[i]), float(w[i]), [float(v) for v in c[i]]) for i in range(40)], "obs_id long, fold int, w double, c array<double>")
    eps, cost, grad = 0.05, {}, {}
    for k in range(3):
        at = np.flatnonzero(fold == k)
        a, b, g = w[at] / w[at].sum(), np.maximum(np.array(targets[k]) / sum(targets[k]), 1e-300), np.zeros(3)
        soft = lambda z: (z.max(1) + np.log(np.exp(z - z.max(1, keepdims=True)).sum(1)))
        for _ in range(40):
            f = eps * (np.log(a) - soft((g - c[at]) / eps))
            g = eps * (np.log(b) - soft(((f[:, None] - c[at]) / eps).T))
        f = eps * (np.log(a) - soft((g - c[at]) / eps))
        cost[k] = (c[at] * np.exp((f[:, None] + g - c[at]) / eps)).sum()
        grad |= {int(i): 2.0 * (f[n] - (a * f).sum()) * a[n] for n, i in enumerate(at)}
    got = {r.fold: r.cost for r in transport.match_cost(df, targets, eps, 40).collect()}
    assert got == pytest.approx(cost | {3: 0.0}, abs=1e-6)
    g = {r.obs_id: r.gradient for r in transport.match_gradient(df, targets, eps, 40, [2.0] * 4).collect()}
    assert g == pytest.approx(grad, abs=1e-6)
    assert transport.match_gradient(df.limit(0), targets).count() == 0 and transport.sinkhorn(df.limit(0), targets[0]) == ([0.0] * 3, 0.0)
