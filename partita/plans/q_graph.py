"""Queries of similarity joins, graphs and leakage metrics, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import folds, graph, similarity as sim

from .fixtures import VECTORS, table, vectors
from .q_folds import _round

EPS = 0.3
_COS = "list_cosine_similarity(a.x, b.x)"
_SQ = "pow(list_distance(a.x, b.x), 2)"
_EPS = f"{VECTORS}, edges AS (SELECT a.obs_id AS src, b.obs_id AS dst, {_COS} AS val FROM vecs a JOIN vecs b ON a.obs_id <> b.obs_id WHERE {_COS} >= 0.3)"
_KNN = f"{VECTORS}, nn AS (SELECT * FROM (SELECT src, dst, val, row_number() OVER (PARTITION BY src ORDER BY val, dst) AS rank FROM (SELECT a.obs_id AS src, b.obs_id AS dst, round({_SQ}, 10) AS val FROM vecs a JOIN vecs b ON a.obs_id <> b.obs_id)) WHERE rank <= 10)"
_FE = _EPS + ", fe AS (SELECT e.*, a.fold AS fs, b.fold AS fd FROM edges e JOIN vecs a ON a.obs_id = src JOIN vecs b ON b.obs_id = dst)"


def _edges(s, d):
    return sim.edges_within(vectors(s, d), "cosine", EPS)


def _knn(s, d, k=10):
    v = vectors(s, d)
    return sim.nearest(v, v, k)


def _supers(s, d):
    return vectors(s, d).select("obs_id", (F.col("obs_id") % 20).alias("super_id"))


def _texts(s, d):
    return table(s, d, "documents").select(F.col("doc_id").alias("obs_id"), "lang", "text")


def _shingles(s, d):
    return sim.shingles(_texts(s, d), "lang")


_SHINGLES = "sh AS (SELECT DISTINCT obs_id, lang, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS item FROM (SELECT doc_id AS obs_id, lang, string_split(lower(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM documents), range(1, 100000) r(i) WHERE i <= len(w) - 2), sn AS (SELECT obs_id, any_value(lang) AS lang, count(*) AS n FROM sh GROUP BY 1), common AS (SELECT a.obs_id AS src, b.obs_id AS dst, count(*) AS c FROM sh a JOIN sh b ON a.item = b.item AND a.obs_id <> b.obs_id GROUP BY 1, 2)"


def _leaders(s, d):
    v = vectors(s, d)
    return sim.nearest_leader(v, v.where("obs_id % 25 = 0"))


def _unlinked(s, d):
    return sim.edges_within(vectors(s, d), "cosine", 0.42)


_HI = f"{VECTORS}, hi AS (SELECT a.obs_id AS src, b.obs_id AS dst, {_COS} AS val FROM vecs a JOIN vecs b ON a.obs_id <> b.obs_id WHERE {_COS} >= 0.42), alone AS (SELECT * FROM vecs WHERE obs_id NOT IN (SELECT src FROM hi))"

QUERIES = {
    "pairwise_cosine_eps": lambda s, d: _round(_edges(s, d), "val"),
    "pairwise_sqdist_topk": lambda s, d: _round(_knn(s, d), "val"),
    "pairwise_euclidean_eps": lambda s, d: _round(sim.edges_within(vectors(s, d), "euclidean", 1.1), "val"),
    "rbf_kernel": lambda s, d: _round(sim.Kernel(vectors(s, d), "rbf", 0.5).row_sums().withColumnRenamed("obs_id", "src"), "row_sum"),
    "laplace_kernel": lambda s, d: _round(sim.kernel_row_sums(vectors(s, d), "laplace", 0.1).withColumnRenamed("obs_id", "src"), "row_sum"),
    "generalised_tanimoto": lambda s, d: _round(sim.edges_within(vectors(s, d), "tanimoto", 0.2), "val"),
    "median_bandwidth": lambda s, d: _round(sim.median_bandwidth(vectors(s, d)), "bandwidth"),
    "knn_graph_sym": lambda s, d: sim.knn_graph(vectors(s, d), 10),
    "knn_graph_inverse": lambda s, d: _round(sim.knn_graph(vectors(s, d), 10, "inverse"), "val"),
    "knn_graph_gaussian": lambda s, d: _round(sim.knn_graph(vectors(s, d), 10, "gaussian"), "val"),
    "knn_other_cluster": lambda s, d: _round(sim.nearest(*[vectors(s, d).withColumn("key", F.col("cls"))] * 2, 5, other_key=True), "val"),
    "blocked_similarity_join": lambda s, d: _round(sim.edges_within(vectors(s, d).withColumn("key", F.col("cls")), "cosine", 0.2, same_key=True), "val"),
    "tanimoto_doc_edges": lambda s, d: _round(sim.shingle_edges(_texts(s, d), 0.6), "val"),
    "tanimoto_blocked": lambda s, d: _round(sim.shingle_edges(_texts(s, d), 0.5, "lang"), "val"),
    "nearest_leader": lambda s, d: _round(_leaders(s, d), "val"),
    "graph_degree": lambda s, d: _round(graph.degrees(_edges(s, d)), "degree"),
    "graph_components": lambda s, d: graph.components(_unlinked(s, d), vectors(s, d)),
    "component_sizes": lambda s, d: graph.components(_unlinked(s, d), vectors(s, d)).groupBy("component").agg(F.count("*").alias("n")),
    "isolated_rescue": lambda s, d: _round(graph.rescue_isolated(_unlinked(s, d), vectors(s, d), 0.05), "val"),
    "singleton_key_clique": lambda s, d: _round(graph.singleton_clique(_unlinked(s, d), vectors(s, d).select("obs_id", F.col("cls").alias("key")), 0.5, 1000), "val"),
    "singleton_key_chain": lambda s, d: _round(graph.singleton_chain(_unlinked(s, d), vectors(s, d).select("obs_id", F.col("cls").alias("key")), 0.5), "val"),
    "eps_calibration": lambda s, d: _round(graph.calibrate(_edges(s, d), vectors(s, d).count(), (0.3, 0.32, 0.35, 0.4, 0.45, 0.5), 2.0), "density", "mean_degree", "isolated"),
    "cut_energy": lambda s, d: _round(graph.cut_energy(_edges(s, d), vectors(s, d)), "energy"),
    "cut_gradient": lambda s, d: _round(graph.cut_gradient(_edges(s, d), vectors(s, d)), "gradient"),
    "galerkin_project": lambda s, d: _round(graph.galerkin(_edges(s, d), _supers(s, d)), "val"),
    "galerkin_mean": lambda s, d: _round(graph.galerkin(_edges(s, d), _supers(s, d), "mean"), "val"),
    "mass_weighted_edges": lambda s, d: _round(graph.mass_weighted(_edges(s, d), vectors(s, d)), "val"),
    "lpi_scaled": lambda s, d: _round(graph.leakage(_edges(s, d), vectors(s, d)), "raw", "total", "scaled"),
    "lpi_mass_weighted": lambda s, d: _round(graph.leakage(_edges(s, d), vectors(s, d), vectors(s, d)), "raw", "total", "scaled"),
    "laplacian_entries": lambda s, d: _round(graph.laplacian(_edges(s, d)), "val"),
    "laplacian_normalised": lambda s, d: _round(graph.laplacian(_edges(s, d), True), "val"),
    "knn_purity": lambda s, d: _round(graph.knn_purity(_knn(s, d), vectors(s, d)), "purity"),
    "nn_distance_stats": lambda s, d: _round(graph.nearest_distance_stats(vectors(s, d)), "mean", "p95", "max"),
    "tpl": lambda s, d: _round(graph.proximity_leakage(vectors(s, d)), "tpl"),
    "knn_predict": lambda s, d: graph.knn_predict(_knn(s, d), vectors(s, d).select("obs_id", "cls")),
    "predicted_information": lambda s, d: _round(folds.mutual_information(graph.knn_predict(_knn(s, d), vectors(s, d).select("obs_id", "cls")).join(vectors(s, d).select("obs_id", "fold"), "obs_id"), "predicted"), "mi"),
    "edge_union_half_sum": lambda s, d: _round(sim.symmetrise(_knn(s, d, 5).select("src", "dst", (1 / (1 + F.col("val"))).alias("val")), "sum"), "val"),
}

_SYM = ", sy AS (SELECT src, dst, max(val) AS val FROM (SELECT src, dst, {0} AS val FROM nn UNION ALL SELECT dst, src, {0} FROM nn) GROUP BY 1, 2) SELECT src, dst, round(val, 6)::DOUBLE AS val FROM sy"

ORACLE = {
    "pairwise_cosine_eps": f"WITH {_EPS} SELECT src, dst, round(val, 6) AS val FROM edges",
    "pairwise_sqdist_topk": f"WITH {_KNN} SELECT src, rank::INT AS rank, dst, round(val, 6) AS val FROM nn",
    "pairwise_euclidean_eps": f"WITH {VECTORS} SELECT a.obs_id AS src, b.obs_id AS dst, round(list_distance(a.x, b.x), 6) AS val FROM vecs a JOIN vecs b ON a.obs_id <> b.obs_id WHERE list_distance(a.x, b.x) <= 1.1",
    "rbf_kernel": f"WITH {VECTORS} SELECT a.obs_id AS src, round(sum(exp(-0.5 * {_SQ})), 6) AS row_sum, count(*) AS n FROM vecs a, vecs b GROUP BY 1",
    "laplace_kernel": f"WITH {VECTORS} SELECT a.obs_id AS src, round(sum(exp(-0.1 * list_sum(list_transform(list_zip(a.x, b.x), lambda z: abs(z[1] - z[2]))))), 6) AS row_sum FROM vecs a, vecs b GROUP BY 1",
    "generalised_tanimoto": f"WITH {VECTORS}, p AS (SELECT a.obs_id AS src, b.obs_id AS dst, list_dot_product(a.x, b.x) AS g, list_dot_product(a.x, a.x) + list_dot_product(b.x, b.x) AS n FROM vecs a JOIN vecs b ON a.obs_id <> b.obs_id) SELECT src, dst, round(g / (n - g), 6) AS val FROM p WHERE g / (n - g) >= 0.2",
    "median_bandwidth": f"WITH {VECTORS} SELECT round(quantile_cont({_SQ}, 0.5), 6) AS bandwidth FROM vecs a, vecs b",
    "knn_graph_sym": f"WITH {_KNN}" + _SYM.format("1.0::DOUBLE"),
    "knn_graph_inverse": f"WITH {_KNN}" + _SYM.format("1 / (1 + val)"),
    "knn_graph_gaussian": f"WITH {_KNN}" + _SYM.format("exp(-val / (SELECT quantile_cont(val, 0.5) FROM nn))"),
    "knn_other_cluster": f"WITH {VECTORS} SELECT src, rank::INT AS rank, dst, round(val, 6) AS val FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY val, dst) AS rank FROM (SELECT a.obs_id AS src, b.obs_id AS dst, {_SQ} AS val FROM vecs a JOIN vecs b ON a.cls <> b.cls)) WHERE rank <= 5",
    "blocked_similarity_join": f"WITH {VECTORS} SELECT a.obs_id AS src, b.obs_id AS dst, round({_COS}, 6) AS val FROM vecs a JOIN vecs b ON a.cls = b.cls AND a.obs_id <> b.obs_id WHERE {_COS} >= 0.2",
    "tanimoto_doc_edges": f"WITH {_SHINGLES} SELECT src, dst, round(c / (a.n + b.n - c)::DOUBLE, 6) AS val FROM common JOIN sn a ON a.obs_id = src JOIN sn b ON b.obs_id = dst WHERE c / (a.n + b.n - c)::DOUBLE >= 0.6",
    "tanimoto_blocked": f"WITH {_SHINGLES} SELECT src, dst, round(c / (a.n + b.n - c)::DOUBLE, 6) AS val FROM common JOIN sn a ON a.obs_id = src JOIN sn b ON b.obs_id = dst WHERE a.lang = b.lang AND c / (a.n + b.n - c)::DOUBLE >= 0.5",
    "nearest_leader": f"WITH {VECTORS}, c AS (SELECT a.obs_id, b.obs_id AS leader, CASE WHEN a.obs_id = b.obs_id THEN 1 ELSE {_COS} END AS val FROM vecs a, vecs b WHERE b.obs_id % 25 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY obs_id ORDER BY (obs_id = leader)::INT DESC, val DESC, leader) AS k FROM c) SELECT obs_id, leader, round(val, 6)::DOUBLE AS val FROM r WHERE k = 1",
    "graph_degree": f"WITH {_EPS} SELECT src AS obs_id, round(sum(val), 6) AS degree, count(*) AS neighbours FROM edges GROUP BY 1",
    "graph_components": f"WITH RECURSIVE {_HI}, reach AS (SELECT obs_id, obs_id AS r FROM vecs UNION SELECT reach.obs_id, hi.dst FROM reach JOIN hi ON hi.src = reach.r) SELECT obs_id, min(r) AS component FROM reach GROUP BY 1",
    "component_sizes": f"WITH RECURSIVE {_HI}, reach AS (SELECT obs_id, obs_id AS r FROM vecs UNION SELECT reach.obs_id, hi.dst FROM reach JOIN hi ON hi.src = reach.r) SELECT component, count(*) AS n FROM (SELECT obs_id, min(r) AS component FROM reach GROUP BY 1) GROUP BY 1",
    "isolated_rescue": f"WITH {_HI}, nw AS (SELECT * FROM (SELECT a.obs_id AS src, b.obs_id AS dst, row_number() OVER (PARTITION BY a.obs_id ORDER BY {_COS} DESC, b.obs_id) AS k FROM alone a JOIN vecs b ON a.obs_id <> b.obs_id) WHERE k <= 3) SELECT src, dst, round(max(val), 6)::DOUBLE AS val FROM (SELECT src, dst, val FROM hi UNION ALL SELECT src, dst, 0.05::DOUBLE FROM nw UNION ALL SELECT dst, src, 0.05::DOUBLE FROM nw) GROUP BY 1, 2",
    "singleton_key_clique": f"WITH {_HI} SELECT src, dst, round(val, 6)::DOUBLE AS val FROM hi UNION ALL SELECT a.obs_id, b.obs_id, 0.5::DOUBLE FROM alone a JOIN alone b ON a.cls = b.cls AND a.obs_id <> b.obs_id",
    "singleton_key_chain": f"WITH {_HI}, ch AS (SELECT * FROM (SELECT obs_id AS src, lead(obs_id) OVER (PARTITION BY cls ORDER BY obs_id) AS dst FROM alone) WHERE dst IS NOT NULL) SELECT src, dst, round(val, 6)::DOUBLE AS val FROM hi UNION ALL SELECT src, dst, 0.5::DOUBLE FROM ch UNION ALL SELECT dst, src, 0.5::DOUBLE FROM ch",
    "eps_calibration": f"WITH {_EPS}, n AS (SELECT count(*)::DOUBLE AS n FROM vecs), t AS (SELECT eps::DOUBLE AS eps, count(src) AS m, count(DISTINCT src) AS l FROM (VALUES (0.3), (0.32), (0.35), (0.4), (0.45), (0.5)) g(eps) LEFT JOIN edges ON val >= eps GROUP BY 1), u AS (SELECT eps, m / (n * (n - 1)) AS density, m / n AS mean_degree, 1 - l / n AS isolated FROM t, n) SELECT eps, round(density, 6) AS density, round(mean_degree, 6) AS mean_degree, round(isolated, 6) AS isolated, coalesce(eps = (SELECT max(eps) FROM u WHERE mean_degree >= 2), false) AS chosen FROM u",
    "cut_energy": f"WITH {_FE} SELECT round(sum(CASE WHEN fs <> fd THEN val ELSE 0 END), 6) AS energy FROM fe",
    "cut_gradient": f"WITH {_FE} SELECT src AS obs_id, f::INT AS fold, round(2 * (CASE WHEN any_value(fs) = f THEN sum(val) ELSE 0 END - sum(CASE WHEN fd = f THEN val ELSE 0 END)), 6)::DOUBLE AS gradient FROM fe, (VALUES (0), (1)) v(f) GROUP BY src, f",
    "galerkin_project": f"WITH {_EPS} SELECT src % 20 AS src, dst % 20 AS dst, round(sum(val), 6) AS val FROM edges GROUP BY 1, 2",
    "galerkin_mean": f"WITH {_EPS} SELECT src % 20 AS src, dst % 20 AS dst, round(avg(val), 6) AS val FROM edges GROUP BY 1, 2",
    "mass_weighted_edges": f"WITH {_EPS} SELECT src, dst, round(val * (1 + src % 3) * (1 + dst % 3), 6) AS val FROM edges",
    "lpi_scaled": f"WITH {_FE} SELECT round(sum(CASE WHEN fs <> fd THEN val ELSE 0 END), 6) AS raw, round(sum(val), 6) AS total, round(sum(CASE WHEN fs <> fd THEN val ELSE 0 END) / sum(val), 6) AS scaled FROM fe",
    "lpi_mass_weighted": f"WITH {_FE}, m AS (SELECT fs, fd, val * (1 + src % 3) * (1 + dst % 3) AS val FROM fe) SELECT round(sum(CASE WHEN fs <> fd THEN val ELSE 0 END), 6) AS raw, round(sum(val), 6) AS total, round(sum(CASE WHEN fs <> fd THEN val ELSE 0 END) / sum(val), 6) AS scaled FROM m",
    "laplacian_entries": f"WITH {_EPS} SELECT src, dst, round(-val, 6) AS val FROM edges UNION ALL SELECT src, src, round(sum(val), 6) FROM edges GROUP BY src",
    "laplacian_normalised": f"WITH {_EPS}, dg AS (SELECT src, sum(val) AS d FROM edges GROUP BY 1) SELECT e.src, e.dst, round(-val / sqrt(a.d * b.d), 6)::DOUBLE AS val FROM edges e JOIN dg a ON a.src = e.src JOIN dg b ON b.src = e.dst UNION ALL SELECT src, src, 1.0::DOUBLE FROM dg",
    "knn_purity": f"WITH {_KNN} SELECT round(avg((b.fold = 0)::INT), 6) AS purity FROM nn JOIN vecs a ON a.obs_id = src JOIN vecs b ON b.obs_id = dst WHERE a.fold = 1",
    "nn_distance_stats": f"WITH {VECTORS}, m AS (SELECT min(list_distance(a.x, b.x)) AS v FROM vecs a JOIN vecs b ON a.fold = 1 AND b.fold = 0 GROUP BY a.obs_id) SELECT round(avg(v), 6) AS mean, round(quantile_cont(v, 0.95), 6) AS p95, round(max(v), 6) AS max FROM m",
    "tpl": f"WITH {VECTORS}, p AS (SELECT a.obs_id, a.fold, {_SQ} AS v, row_number() OVER (PARTITION BY a.obs_id ORDER BY {_SQ}, b.obs_id) AS k FROM vecs a JOIN vecs b ON b.fold = 0 AND a.obs_id <> b.obs_id), h AS (SELECT quantile_cont(sqrt(v), 0.5) AS h FROM p WHERE k = 1), f AS (SELECT obs_id, any_value(fold) AS fold, round(avg(exp(-v / (2 * h * h))), 12) AS y FROM p, h WHERE k <= 64 GROUP BY 1) SELECT round(2 * avg(CASE WHEN a.y > b.y THEN 1.0 WHEN a.y = b.y THEN 0.5 ELSE 0 END) - 1, 6)::DOUBLE AS tpl FROM f a, f b WHERE a.fold = 0 AND b.fold = 1",
    "knn_predict": f"WITH {_KNN}, v AS (SELECT src, cls, count(*) AS n FROM nn JOIN vecs ON obs_id = dst GROUP BY 1, 2) SELECT src AS obs_id, cls AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, cls) AS k FROM v) WHERE k = 1",
    "predicted_information": f"WITH {_KNN}, v AS (SELECT src, cls, count(*) AS n FROM nn JOIN vecs ON obs_id = dst GROUP BY 1, 2), pr AS (SELECT src, cls AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, cls) AS k FROM v) WHERE k = 1), j AS (SELECT fold, predicted, count(*)::DOUBLE AS n FROM pr JOIN vecs ON obs_id = src GROUP BY 1, 2), m AS (SELECT n, sum(n) OVER (PARTITION BY fold) AS a, sum(n) OVER (PARTITION BY predicted) AS b, sum(n) OVER () AS t FROM j) SELECT round(greatest(sum(n / t * ln(n * t / (a * b))), 0), 6) AS mi FROM m",
    "edge_union_half_sum": f"WITH {_KNN} SELECT src, dst, round(sum(val) / 2, 6) AS val FROM (SELECT src, dst, 1 / (1 + val) AS val FROM nn WHERE rank <= 5 UNION ALL SELECT dst, src, 1 / (1 + val) FROM nn WHERE rank <= 5) GROUP BY 1, 2",
}
