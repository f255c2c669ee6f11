"""Queries of assignment, repair and baseline splitters, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import norm
from ..operators import assign as asg
from ..operators import baselines as base
from ..operators import folds, stratify
from ..operators import similarity as sim
from .fixtures import CUSTOMERS, ORDERS, PARTS, VECTORS, customers, orders, parts, sql_hash, table, vectors
from .q_folds import _BEST, _DOCS, R, _docs, _round
from .q_graph import _EPS, EPS

_N = "floor(0.8::DOUBLE * count(*) OVER () + 0.5)"


def _cut(order, src, extra=""):
    return f"SELECT obs_id, (CASE WHEN row_number() OVER (ORDER BY {order}, obs_id) <= {_N} THEN 0 ELSE 1 END) AS fold FROM {src} {extra}"


def _strat(src, key):
    return f"SELECT obs_id, (CASE WHEN row_number() OVER (PARTITION BY {key} ORDER BY {sql_hash('obs_id')}, obs_id) <= floor(0.8::DOUBLE * count(*) OVER (PARTITION BY {key}) + 0.5) THEN 0 ELSE 1 END) AS fold FROM {src}"


def _folds(df):
    return df.select("obs_id", F.col("fold").cast("int").alias("fold"))


def _costs(s, d):
    """delta: a signed cost of each order."""
    return orders(s, d).select("obs_id", "w", "fold", F.round((F.col("y") - 150000) / 1000, 4).alias("delta"))


_COSTS = f"{ORDERS}, costs AS (SELECT obs_id, w, fold, round((y - 150000) / 1000, 4) AS delta FROM ords), cum AS (SELECT *, delta / w AS dd, sum(w) OVER (ORDER BY delta / w, obs_id ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER () AS tw FROM costs)"
_K2 = _COSTS + ", z AS (SELECT obs_id, greatest(0, least(1, (greatest({lo} * tw, least({hi} * tw, {stop})) - (c - w)) / w))::DOUBLE AS z1 FROM cum) SELECT obs_id, (z1 >= 0.5)::INT AS fold, round(z1, 6) AS z1 FROM z"


def _fractions(s, d):
    z1 = F.round(F.pmod(F.col("obs_id") * 37, F.lit(1000)) / 1000.0, 3)
    return customers(s, d).select("obs_id", "w", F.array(1 - z1, z1).alias("z"))


_ROUND = f"{CUSTOMERS}, c0 AS (SELECT obs_id, w, round((obs_id * 37 % 1000) / 1000::DOUBLE, 3) AS z1 FROM customers), f0 AS (SELECT obs_id, w, 1 - z1 AS z0, z1, (CASE WHEN 1 - z1 >= z1 THEN 0 ELSE 1 END) AS fold FROM c0)"


def _shift_sql(src, out, a, b):
    za, zb = f"z{a}", f"z{b}"
    return f", {out}_m AS (SELECT least(sum(CASE WHEN fold = {a} THEN w ELSE 0 END) - {R[a]}::DOUBLE * sum(w), {R[b]}::DOUBLE * sum(w) - sum(CASE WHEN fold = {b} THEN w ELSE 0 END)) AS gap FROM {src}), {out}_c AS (SELECT obs_id, sum(w) OVER (ORDER BY {za} - {zb}, obs_id ROWS UNBOUNDED PRECEDING) AS c FROM {src} WHERE fold = {a}), {out} AS (SELECT s.obs_id, w, z0, z1, (CASE WHEN c <= gap + 1e-9::DOUBLE THEN {b} ELSE fold END) AS fold FROM {src} s LEFT JOIN {out}_c USING (obs_id), {out}_m)"


def _hier(s, d):
    c = customers(s, d)
    members = c.select(F.lit("nation").alias("level"), F.col("nation").alias("group_id"), F.when(F.col("nation") % 4 == 0, F.col("fold")).otherwise((F.col("nation") % 3 == 0).cast("int")).alias("fold"))
    n = table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), "n_regionkey")
    a, b = n.withColumnsRenamed({"k": "g", "n_regionkey": "ra"}), n.withColumnsRenamed({"k": "h", "n_regionkey": "rb"})
    edges = a.join(b, F.col("g") != F.col("h")).select(F.lit("nation").alias("level"), "g", "h", F.when(F.col("ra") == F.col("rb"), 1.0).otherwise(0.25).alias("s"))
    return members, edges, s.createDataFrame([("nation", 2.0)], "level string, lam double")


_HIER = f"WITH {CUSTOMERS}, m AS (SELECT nation AS g, min(f) AS lo, max(f) AS hi FROM (SELECT nation, (CASE WHEN nation % 4 = 0 THEN fold ELSE (nation % 3 = 0)::INT END) AS f FROM customers) GROUP BY 1), y AS (SELECT g, CASE WHEN lo = hi THEN lo END AS f FROM m), e AS (SELECT a.n_nationkey::BIGINT AS g, b.n_nationkey::BIGINT AS h, (CASE WHEN a.n_regionkey = b.n_regionkey THEN 1.0 ELSE 0.25 END)::DOUBLE AS s FROM nation a JOIN nation b ON a.n_nationkey <> b.n_nationkey)"


def _entity_orders(s, d):
    return orders(s, d).select("obs_id", "entity", "w", "fold")


QUERIES = {
    "fold_random_hash": lambda s, d: _folds(base.random(customers(s, d).drop("fold"))),
    "fold_class_stratified": lambda s, d: _folds(base.stratified(customers(s, d).drop("fold"), "cls")),
    "fold_multilabel_stratified": lambda s, d: _folds(base.stratified(_docs(s, d).drop("fold"), "quality", "toxic")),
    "fold_quantile_stratified": lambda s, d: _folds(base.stratified(stratify.quantile_bins(orders(s, d).drop("fold"), 10), "bin")),
    "fold_kfold_stratified": lambda s, d: _folds(base.kfold(customers(s, d).drop("fold"), "cls", 5)),
    "fold_group_stop": lambda s, d: _folds(base.group_stop(parts(s, d).drop("fold"), "brand")),
    "fold_leave_group_out": lambda s, d: _folds(base.group_stop(customers(s, d).drop("fold"), "nation", order="hash")),
    "fold_group_ffd_skip": lambda s, d: _folds(base.group_skip(parts(s, d).drop("fold"), "brand")),
    "fold_cluster_flag": lambda s, d: _folds(base.largest_cluster(parts(s, d), "kind")),
    "fold_precomputed_map": lambda s, d: _folds(base.precomputed(table(s, d, "documents").select(F.col("doc_id").alias("obs_id"), F.element_at(F.split(F.lit("train,val,test,none"), ","), (F.col("doc_id") % 4 + 1).cast("int")).alias("split")), "split", {"train": 0, "val": 1, "test": 1})),
    "fold_sorted_prefix": lambda s, d: _folds(base.ordered(parts(s, d).drop("fold"), F.col("y"))),
    "fold_weight_desc": lambda s, d: _folds(base.ordered(orders(s, d).drop("fold"), -F.col("y"))),
    "fold_farthest_centroid": lambda s, d: _folds(base.farthest(vectors(s, d).drop("fold"))),
    "fold_norm_prefix": lambda s, d: _folds(base.ordered(vectors(s, d).drop("fold"), F.round(norm(F.col("x")), 9))),
    "fold_pc1_cut": lambda s, d: _folds(base.first_component(vectors(s, d).drop("fold"))),
    "fold_kmeans_pack": lambda s, d: _folds(base.kmeans_pack(vectors(s, d).drop("fold"))),
    "fold_agglomerative": lambda s, d: _folds(base.agglomerative_pack(vectors(s, d).drop("fold"))),
    "fold_leader_cluster": lambda s, d: base.leaders(vectors(s, d), 0.35),
    "fold_maxmin": lambda s, d: base.maxmin(vectors(s, d), 12),
    "fold_nearest_cluster": lambda s, d: base.nearest_cluster(vectors(s, d), vectors(s, d).where("obs_id % 10 = 0").withColumn("cluster", F.col("cls"))),
    "random_balanced_init": lambda s, d: _folds(asg.random_balanced(orders(s, d), R)),
    "assign_k2_greedy": lambda s, d: _round(asg.assign_two(_costs(s, d), 0.2, 0.02), "z1"),
    "assign_k2_penalty": lambda s, d: _round(asg.assign_two(_costs(s, d), 0.2, 0.1, 0.02), "z1"),
    "round_confidence_gap": lambda s, d: _folds(asg.round_by_confidence(_fractions(s, d), R)),
    "round_by_draw": lambda s, d: _folds(asg.round_by_draw(_fractions(s, d), R)),
    "swap_leakage_capped": lambda s, d: _folds(asg.swap_for_leakage(vectors(s, d).withColumn("fold", (F.col("obs_id") % 2).cast("int")), sim.edges_within(vectors(s, d), "cosine", EPS), R)),
    "hierarchy_pack_init": lambda s, d: _folds(asg.pack_hierarchy(customers(s, d), "nation", R)),
    "hierarchy_value": lambda s, d: _round(asg.hierarchy_value(*_hier(s, d)), "value"),
    "hierarchy_gradient": lambda s, d: _round(asg.hierarchy_gradient(*_hier(s, d)), "gradient"),
    "hierarchy_repair": lambda s, d: _folds(asg.hierarchy_repair(parts(s, d), "kind", R, 0.05)),
    "entity_cold_repair": lambda s, d: _folds(folds.entity_repair(_entity_orders(s, d), "entity")),
}

_SORTED_GROUPS = "{0}, g AS (SELECT {1} AS k, count(*) AS n FROM {2} GROUP BY 1), c AS (SELECT k, sum(n) OVER (ORDER BY {3}, k ROWS UNBOUNDED PRECEDING) AS c, sum(n) OVER () AS tn FROM g) SELECT obs_id, (CASE WHEN c <= 0.8::DOUBLE * tn THEN 0 ELSE 1 END) AS fold FROM {2} JOIN c ON k = {1}"

ORACLE = {
    "fold_random_hash": f"WITH {CUSTOMERS} {_cut(sql_hash('obs_id'), 'customers')}",
    "fold_class_stratified": f"WITH {CUSTOMERS} {_strat('customers', 'cls')}",
    "fold_multilabel_stratified": f"WITH {_DOCS} {_strat('docs', 'quality, toxic')}",
    "fold_quantile_stratified": f"WITH {ORDERS}, ed AS (SELECT quantile_cont(y, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS e FROM ords), b AS (SELECT obs_id, len(list_filter(e, lambda v: v < y)) AS bin FROM ords, ed) {_strat('b', 'bin')}",
    "fold_kfold_stratified": f"WITH {CUSTOMERS} SELECT obs_id, ((row_number() OVER (PARTITION BY cls ORDER BY {sql_hash('obs_id')}, obs_id) - 1) % 5)::INT AS fold FROM customers",
    "fold_group_stop": "WITH " + _SORTED_GROUPS.format(PARTS, "brand", "parts", "n DESC"),
    "fold_leave_group_out": "WITH " + _SORTED_GROUPS.format(CUSTOMERS, "nation", "customers", sql_hash("k")),
    "fold_group_ffd_skip": f"WITH RECURSIVE {PARTS}, g AS (SELECT brand, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, brand) AS i FROM parts GROUP BY 1), t AS (SELECT sum(n) * 0.8::DOUBLE AS most FROM g), w AS (SELECT 0::BIGINT AS i, 0::DOUBLE AS have, NULL::VARCHAR AS brand, 0 AS fold UNION ALL SELECT g.i, w.have + (CASE WHEN w.have + g.n <= most THEN g.n ELSE 0 END), g.brand, (CASE WHEN w.have + g.n <= most THEN 0 ELSE 1 END) FROM w JOIN g ON g.i = w.i + 1, t) SELECT obs_id, w.fold FROM parts JOIN w USING (brand)",
    "fold_cluster_flag": f"WITH {PARTS}, t AS (SELECT kind FROM parts GROUP BY 1 ORDER BY count(*) DESC, kind LIMIT 1) SELECT obs_id, (CASE WHEN parts.kind = t.kind THEN 0 ELSE 1 END) AS fold FROM parts, t",
    "fold_precomputed_map": "SELECT doc_id AS obs_id, (CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 1 END) AS fold FROM documents WHERE doc_id % 4 <> 3",
    "fold_sorted_prefix": f"WITH {PARTS} {_cut('y', 'parts')}",
    "fold_weight_desc": f"WITH {ORDERS} {_cut('y DESC', 'ords')}",
    "fold_farthest_centroid": f"WITH {VECTORS}, mu AS (SELECT list(m ORDER BY i) AS m FROM (SELECT i, avg(x[i]) AS m FROM vecs, range(1, 65) r(i) GROUP BY 1)), f AS (SELECT obs_id, round(pow(list_distance(x, m), 2), 9) AS far FROM vecs, mu) {_cut('far', 'f')}",
    "fold_norm_prefix": f"WITH {VECTORS}, f AS (SELECT obs_id, round(sqrt(list_dot_product(x, x)), 9) AS k FROM vecs) {_cut('k', 'f')}",
    "fold_maxmin": f"WITH RECURSIVE {VECTORS}, p AS (SELECT 0 AS step, [(SELECT min(obs_id) FROM vecs)] AS got UNION ALL SELECT step + 1, list_append(got, (SELECT a.obs_id FROM vecs a JOIN vecs b ON list_contains(p.got, b.obs_id) WHERE NOT list_contains(p.got, a.obs_id) GROUP BY 1 ORDER BY min(round(pow(list_distance(a.x, b.x), 2), 9)) DESC, a.obs_id LIMIT 1)) FROM p WHERE step < 11) SELECT got[i]::BIGINT AS obs_id, (i - 1)::INT AS step FROM p, range(1, 13) r(i) WHERE step = 11",
    "fold_nearest_cluster": f"WITH {VECTORS} SELECT a.obs_id, arg_min(b.cls, (round(pow(list_distance(a.x, b.x), 2), 9), b.obs_id)) AS cluster FROM vecs a JOIN vecs b ON b.obs_id % 10 = 0 AND a.obs_id <> b.obs_id GROUP BY 1",
    "random_balanced_init": f"WITH {ORDERS} SELECT obs_id, (CASE WHEN sum(w) OVER (ORDER BY {sql_hash('obs_id')}, obs_id ROWS UNBOUNDED PRECEDING) - w / 2 <= 0.8::DOUBLE * sum(w) OVER () THEN 0 ELSE 1 END) AS fold FROM ords",
    "assign_k2_greedy": "WITH " + _K2.format(lo="0.18::DOUBLE", hi="0.22::DOUBLE", stop="(CASE WHEN dd < 0 THEN c ELSE c - w END)"),
    "assign_k2_penalty": "WITH " + _K2.format(lo="0.1::DOUBLE", hi="0.3::DOUBLE", stop="(0.2::DOUBLE * tw - dd / 0.08::DOUBLE)"),
    "round_confidence_gap": f"WITH {_ROUND}{_shift_sql('f0', 'f1', 0, 1)}{_shift_sql('f1', 'f2', 1, 0)} SELECT obs_id, fold FROM f2",
    "round_by_draw": f"WITH {_ROUND}, d0 AS (SELECT obs_id, w, z0, z1, (CASE WHEN z0 <= {sql_hash('obs_id')} / 4294967296.0::DOUBLE THEN 1 ELSE 0 END) AS fold FROM f0){_shift_sql('d0', 'f1', 0, 1)}{_shift_sql('f1', 'f2', 1, 0)} SELECT obs_id, fold FROM f2",
    "swap_leakage_capped": f"WITH {_EPS}, v AS (SELECT obs_id, w, (obs_id % 2)::INT AS fold FROM vecs), gn AS (SELECT src AS obs_id, sum(CASE WHEN src % 2 <> dst % 2 THEN val ELSE -val END) AS gain FROM edges GROUP BY 1), m AS (SELECT sum(CASE WHEN fold = 0 THEN w ELSE 0 END) - 0.8::DOUBLE * sum(w) AS x FROM v), c AS (SELECT obs_id, sum(w) OVER (ORDER BY -gain, obs_id ROWS UNBOUNDED PRECEDING) AS c FROM v JOIN gn USING (obs_id), m WHERE gain > 0 AND fold = (CASE WHEN x > 0 THEN 0 ELSE 1 END)) SELECT v.obs_id, (CASE WHEN c <= abs(x) + 1e-9::DOUBLE THEN 1 - fold ELSE fold END)::INT AS fold FROM v LEFT JOIN c USING (obs_id), m",
    "hierarchy_value": _HIER + " SELECT round(sum(2 * s * (CASE WHEN a.f = b.f THEN 0 ELSE 1 END)), 6)::DOUBLE AS value FROM e JOIN y a ON a.g = e.g JOIN y b ON b.g = e.h",
    "hierarchy_gradient": _HIER + ", ms AS (SELECT g, sum(s) AS m FROM (SELECT g, s FROM e UNION ALL SELECT h, s FROM e) GROUP BY 1) SELECT 'nation' AS level, y.g AS group_id, k::INT AS fold, round(2 * m * (1 - 2 * (CASE WHEN y.f = k THEN 1 ELSE 0 END)), 6)::DOUBLE AS gradient FROM y JOIN ms ON ms.g = y.g, (VALUES (0), (1)) v(k)",
    "entity_cold_repair": f"WITH {ORDERS}, b AS ({_BEST.format('entity', 'ords')}) SELECT obs_id, b.fold FROM ords JOIN b USING (entity)",
}
