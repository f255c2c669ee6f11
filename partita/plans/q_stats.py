"""Queries of target stratification, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stratify as st
from .fixtures import ORDERS, PARTS, VECTORS, customers, orders, parts, sql_hash, vectors
from .q_folds import _round

R = (0.8, 0.2)


def _scaled(spark, d):
    return parts(spark, d).withColumn("y", F.col("y") / 1000)


_SCALED = f"{PARTS}, sc AS (SELECT obs_id, fold, w, size, y / 1000 AS y FROM parts)"


def _binned(spark, d, n=10):
    return st.quantile_bins(orders(spark, d), n)


_EDGES = "[" + ", ".join(f"{i / 10}" for i in range(1, 10)) + "]"
_BINNED = f"{ORDERS}, ed AS (SELECT quantile_cont(y, {_EDGES}) AS e FROM ords), binned AS (SELECT ords.*, len(list_filter(e, lambda v: v < y))::INT AS bin FROM ords, ed), tally AS (SELECT b.bin, f.fold, coalesce(sum(t.w), 0) AS mass, tot.m AS total FROM (SELECT DISTINCT bin FROM binned) b CROSS JOIN (VALUES (0), (1)) f(fold) JOIN (SELECT bin, sum(w) AS m FROM binned GROUP BY 1) tot ON tot.bin = b.bin LEFT JOIN binned t ON t.bin = b.bin AND t.fold = f.fold GROUP BY 1, 2, 4)"
_RK = "(CASE fold WHEN 0 THEN 0.8::DOUBLE ELSE 0.2::DOUBLE END)"
_STEPS = f"{ORDERS}, st AS (SELECT y, sum(w) AS a, sum(CASE WHEN fold = 0 THEN w ELSE 0 END) AS f0, sum(CASE WHEN fold = 1 THEN w ELSE 0 END) AS f1 FROM ords GROUP BY y), cs AS (SELECT y, a, f0, f1, sum(a) OVER o AS ca, sum(f0) OVER o AS c0, sum(f1) OVER o AS c1, sum(a) OVER () AS ta, sum(f0) OVER () AS t0, sum(f1) OVER () AS t1, lead(y) OVER (ORDER BY y) AS nxt FROM st WINDOW o AS (ORDER BY y))"
_MOM = "SELECT fold, sum(w) AS mass, any_value(mean) AS mean, sum(w * pow(y - mean, 2)) / sum(w) AS m2, sum(w * pow(y - mean, 3)) / sum(w) AS m3, sum(w * pow(y - mean, 4)) / sum(w) AS m4 FROM (SELECT *, sum(w * y) OVER (PARTITION BY fold) / sum(w) OVER (PARTITION BY fold) AS mean FROM {0}) GROUP BY fold"
_RANK = "(rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2::DOUBLE)"
_SP = f"WITH {PARTS}, r AS (SELECT fold, w, {_RANK.format('y')} AS ra, {_RANK.format('size')} AS rb FROM parts), c AS (SELECT fold, w, ra - (SELECT count(*) / 2 FROM r) AS ra, rb - (SELECT count(*) / 2 FROM r) AS rb FROM r)"
_PEAR = "(sum(w * ra * rb) / sum(w) - sum(w * ra) / sum(w) * (sum(w * rb) / sum(w))) / sqrt((sum(w * ra * ra) / sum(w) - pow(sum(w * ra) / sum(w), 2)) * (sum(w * rb * rb) / sum(w) - pow(sum(w * rb) / sum(w), 2)))"

QUERIES = {
    "moments_per_fold": lambda s, d: _round(st.moments(_scaled(s, d)), "mass", "mean", "m2", "m3", "m4"),
    "moment_residual": lambda s, d: _round(st.moment_residual(_scaled(s, d)), "residual", n=9),
    "moment_gradient": lambda s, d: st.moment_gradient(_scaled(s, d)).select("obs_id", F.round(F.col("gradient") * 1e6, 4).alias("gradient_e6")),
    "moment_scale": lambda s, d: _round(st.moment_scale(_scaled(s, d)), "scale"),
    "fourth_moment_se": lambda s, d: _round(st.fourth_moment_error(_scaled(s, d)), "se", n=9),
    "quantile_bins": lambda s, d: _binned(s, d).select("obs_id", "bin"),
    "quantile_residual": lambda s, d: _round(st.quantile_residual(_binned(s, d), R), "residual", n=4),
    "quantile_gradient": lambda s, d: _round(st.quantile_gradient(_binned(s, d), R), "gradient", n=4),
    "quantile_scale": lambda s, d: _round(st.quantile_scale(_binned(s, d), R), "scale", n=3),
    "wasserstein1": lambda s, d: _round(st.wasserstein1(orders(s, d)), "w1", n=4),
    "ks_per_fold": lambda s, d: _round(st.ks(orders(s, d)), "ks"),
    "ad_per_fold": lambda s, d: _round(st.anderson_darling(orders(s, d)), "ad", n=9),
    "qq_table": lambda s, d: _round(st.qq_table(orders(s, d)), "q0", "q1", n=4),
    "weighted_quantile": lambda s, d: _round(st.weighted_quantile(orders(s, d), (0.1, 0.25, 0.5, 0.75, 0.9)), "value", n=4),
    "ecdf": lambda s, d: st._steps(orders(s, d), 1).select("y", F.round(F.col("ca") / F.col("ta"), 9).alias("cdf")),
    "rank_average": lambda s, d: st.average_rank(parts(s, d).select("obs_id", "size"), "size").select("obs_id", "rank"),
    "spearman_deviation": lambda s, d: _round(st.spearman_deviation(parts(s, d), "y", "size"), "rho", "deviation"),
    "weighted_pearson": lambda s, d: parts(s, d).withColumns({"a": F.col("y") - 1400, "b": F.col("size") - 25}).groupBy("fold").agg(F.round(st.weighted_pearson(None, "a", "b"), 6).alias("r")),
    "mann_whitney": lambda s, d: _round(st.mann_whitney(customers(s, d)), "u", "share"),
    "sliced_w2": lambda s, d: _round(st.sliced_wasserstein2(vectors(s, d)), "sw2", "se", n=9),
}

ORACLE = {
    "moments_per_fold": f"WITH {_SCALED}, m AS ({_MOM.format('sc')}) SELECT fold, round(mass, 6) AS mass, round(mean, 6) AS mean, round(m2, 6) AS m2, round(m3, 6) AS m3, round(m4, 6) AS m4 FROM m",
    "moment_residual": f"WITH {_SCALED}, m AS ({_MOM.format('sc')}), one AS (SELECT 0 AS fold, w, y FROM sc), a AS ({_MOM.format('one')}) SELECT m.fold, round(pow(m.mean - a.mean, 2) + pow(m.m2 - a.m2, 2) + pow(m.m3 - a.m3, 2) + pow(m.m4 - a.m4, 2), 9) AS residual FROM m, a",
    "moment_gradient": f"WITH {_SCALED}, m AS ({_MOM.format('sc')}), one AS (SELECT 0 AS fold, w, y FROM sc), a AS ({_MOM.format('one')}) SELECT obs_id, round(1e6 * (2 * (m.mean - a.mean) * (y - m.mean) * w / m.mass), 4) AS gradient_e6 FROM sc JOIN m ON sc.fold = m.fold, a",
    "moment_scale": f"WITH {_SCALED}, c AS (SELECT w / sum(w) OVER () AS p, y - sum(w * y) OVER () / sum(w) OVER () AS c FROM sc) SELECT round(sum(p * c * c) - pow(sum(p * c), 2) + sum(p * pow(c, 4)) - pow(sum(p * c * c), 2) + sum(p * pow(c, 6)) - pow(sum(p * pow(c, 3)), 2) + sum(p * pow(c, 8)) - pow(sum(p * pow(c, 4)), 2), 6) AS scale FROM c",
    "fourth_moment_se": f"WITH {_SCALED}, c AS (SELECT fold, pow(y - avg(y) OVER (PARTITION BY fold), 4) AS q FROM sc) SELECT fold, round(stddev_pop(q) / sqrt(count(*)), 9) AS se FROM c GROUP BY 1",
    "quantile_bins": f"WITH {_BINNED} SELECT obs_id, bin FROM binned",
    "quantile_residual": f"WITH {_BINNED} SELECT round(sum(pow(mass - {_RK} * total, 2)), 4) AS residual FROM tally",
    "quantile_gradient": f"WITH {_BINNED} SELECT b.obs_id, t.fold, round(b.w * 2 * (mass - (CASE t.fold WHEN 0 THEN 0.8::DOUBLE ELSE 0.2::DOUBLE END) * total), 4) AS gradient FROM binned b JOIN tally t ON b.bin = t.bin",
    "quantile_scale": f"WITH {_BINNED} SELECT round(sum(m * m) * (1 - 2 * 0.2::DOUBLE + 0.64::DOUBLE + 0.04::DOUBLE), 3) AS scale FROM (SELECT sum(w) AS m FROM binned GROUP BY bin)",
    "wasserstein1": f"WITH {_STEPS} SELECT round(sum(abs(c0 / t0 - c1 / t1) * (nxt - y)), 4) AS w1 FROM cs WHERE nxt IS NOT NULL",
    "ks_per_fold": f"WITH {_STEPS} SELECT 0 AS fold, round(max(abs(c0 / t0 - ca / ta)), 6) AS ks FROM cs UNION ALL SELECT 1, round(max(abs(c1 / t1 - ca / ta)), 6) FROM cs",
    "ad_per_fold": f"WITH {_STEPS}, u AS (SELECT *, greatest(least(ca / ta, 1 - 1e-7::DOUBLE), 1e-7::DOUBLE) AS u FROM cs) SELECT 0 AS fold, round(sum(f0 * pow(c0 / t0 - u, 2) / (u * (1 - u))) / max(t0), 9) AS ad FROM u UNION ALL SELECT 1, round(sum(f1 * pow(c1 / t1 - u, 2) / (u * (1 - u))) / max(t1), 9) FROM u",
    "qq_table": f"WITH {ORDERS}, g AS (SELECT list_transform(range(101), lambda i: i / 100::DOUBLE) AS l), q AS (SELECT i, (SELECT quantile_cont(y, {[i / 100 for i in range(101)]}) FROM ords WHERE fold = 0) AS a, (SELECT quantile_cont(y, {[i / 100 for i in range(101)]}) FROM ords WHERE fold = 1) AS b FROM range(101) r(i)) SELECT i / 100::DOUBLE AS level, round(a[i + 1], 4) AS q0, round(b[i + 1], 4) AS q1 FROM q",
    "weighted_quantile": f"WITH {_STEPS} SELECT l::DOUBLE AS level, (SELECT round(min(y), 4) FROM cs WHERE ca / ta >= l::DOUBLE - 1e-12::DOUBLE) AS value FROM (VALUES (0.1), (0.25), (0.5), (0.75), (0.9)) v(l)",
    "ecdf": f"WITH {_STEPS} SELECT y, round(ca / ta, 9) AS cdf FROM cs",
    "rank_average": f"WITH {PARTS} SELECT obs_id, {_RANK.format('size')} AS rank FROM parts",
    "spearman_deviation": f"{_SP}, a AS (SELECT {_PEAR} AS r FROM c) SELECT fold, round(rho, 6) AS rho, round(abs(rho - r), 6) AS deviation FROM (SELECT fold, {_PEAR} AS rho FROM c GROUP BY fold), a",
    "weighted_pearson": f"WITH {PARTS}, c AS (SELECT fold, w, y - 1400 AS ra, size - 25 AS rb FROM parts) SELECT fold, round({_PEAR}, 6) AS r FROM c GROUP BY fold",
    "mann_whitney": f"WITH c AS (SELECT c_custkey AS k, c_acctbal AS y, (CASE WHEN {sql_hash('c_custkey')} < 3435973837 THEN 0 ELSE 1 END) AS fold FROM customer JOIN nation ON c_nationkey = n_nationkey), r AS (SELECT fold, {_RANK.format('y')} AS r FROM c), g AS (SELECT sum(CASE WHEN fold = 0 THEN r END) AS r0, sum((fold = 0)::INT)::DOUBLE AS n0, sum((fold = 1)::INT)::DOUBLE AS n1 FROM r) SELECT round(r0 - n0 * (n0 + 1) / 2, 6) AS u, round((r0 - n0 * (n0 + 1) / 2) / (n0 * n1), 6) AS share FROM g",
    "sliced_w2": f"WITH {VECTORS}, g AS (SELECT p, a, sqrt(-2 * ln(({sql_hash('p * 100003 + a', 5)} + 1) / 4294967296.0::DOUBLE)) * cos(2 * 3.141592653589793::DOUBLE * ({sql_hash('p * 100003 + a', 6)} / 4294967296.0::DOUBLE)) AS g FROM range(8) x(p), range((SELECT max(len(x)) FROM vecs)) y(a)), dirs AS (SELECT p, list(g ORDER BY a) AS v, sqrt(sum(g * g)) AS n FROM g GROUP BY p), rows AS (SELECT fold, p, list_dot_product(x, v) / n AS v FROM vecs, dirs), e AS (SELECT p, quantile_cont(v, {[(i + 0.5) / 64 for i in range(64)]}) AS q FROM rows GROUP BY p), f AS (SELECT p, fold, quantile_cont(v, {[(i + 0.5) / 64 for i in range(64)]}) AS q FROM rows GROUP BY p, fold), dd AS (SELECT fold, list_sum(list_transform(list_zip(f.q, e.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / 64 AS d FROM f JOIN e USING (p)) SELECT fold, round(avg(d), 9) AS sw2, round(stddev_samp(d) / sqrt(count(*)), 9) AS se FROM dd GROUP BY fold",
}
