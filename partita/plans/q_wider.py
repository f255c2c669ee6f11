"""Queries of derived columns, information, scales, containment, class repair, arrays and the splitter's grids, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assign as asg
from ..operators import coarsen, folds, graph, prep, select, transport
from ..operators import similarity as sim
from ..operators import stratify as st
from ..sources import readers
from .engine import SplitSpec, ablation, sweep_inputs
from .fixtures import CUSTOMERS, PARTS, VECTORS, customers, parts, table, vectors
from .q_assign import _HIER, _hier
from .q_folds import _round
from .q_graph import _EPS, EPS
from .q_terms import _CENTRES, _SAMPLES, _assignments, _costs

R = (0.8, 0.2)
_MATRIX = ((1.0, 2.0, 0.5), (0.0, -1.5, 4.0), (2.25, 0.0, 0.0))


def _derived(s, d):
    p = prep.derived(parts(s, d), {"ratio": ("y", "size")}, {"log_y": "y"}, {"capped": ("size", 5, 40)}, 1.0)
    return _round(p.select("obs_id", "ratio", "log_y", "capped"), "ratio", "log_y")


def _labelled(s, d):
    docs = table(s, d, "documents")
    return docs.drop("text", "n_chars").join(table(s, d, "labels").where("quality is not null").select("doc_id", "quality"), "doc_id").select("doc_id", F.col("quality").cast("long").alias("quality"))


def _renamed(s, d):
    return prep.rename_prefix(table(s, d, "nation").select("n_nationkey", "n_name"), "n_", "country_")


def _gradients(s, d):
    m = graph.cut_gradient(sim.edges_within(vectors(s, d), "cosine", EPS), vectors(s, d)).select(F.lit("M").alias("term"), "obs_id", "fold", F.col("gradient").alias("g"))
    return m.unionByName(vectors(s, d).select(F.lit("B").alias("term"), "obs_id", "fold", F.col("w").alias("g")))


def _repaired(s, d):
    return asg.class_repair(customers(s, d), R, "cls").select("obs_id", "fold")


def _grouped(s, d, **rounds):
    return SplitSpec(vectors(s, d).select("obs_id", "w", (F.col("obs_id") % 60).alias("grp")), hierarchy="grp", edges=sim.packed_edges(vectors(s, d), "cosine", EPS), provenance="cosine", **rounds)


def _ablated(s, d):
    return ablation(_grouped(s, d, max_iter=1, patience=1))[0].select("config_id", (F.col("H") >= 0).alias("h_given"), (F.col("M") >= 0).alias("m_given"), F.col("D").isNull().alias("d_absent"))


def _swept(s, d):
    """Rounds go on until they settle, by the splitter's own patience, however many that takes."""
    v, spec = vectors(s, d), _grouped(s, d, max_iter=None)
    tables = {"cosine_0.3": {}, "cosine_0.4": {"edges": sim.packed_edges(v, "cosine", 0.4)}, "supers_40": {"hierarchy": None, "obs": v.select("obs_id", "w", (F.col("obs_id") % 40).alias("sup")), "supers": "sup"}}
    return sweep_inputs(spec, tables)[0].select("config_id", (F.col("imbalance") <= 0.05 + 0.05).alias("balanced"), F.col("composite").isNotNull().alias("valued"))


QUERIES = {
    "derived_columns": _derived,
    "filter_labelled": _labelled,
    "rename_prefix": _renamed,
    "entropy": lambda s, d: _round(folds.entropy(parts(s, d), "brand"), "entropy"),
    "mi_targets": lambda s, d: _round(folds.mutual_information_targets(parts(s, d), ("y", "size")), "mi"),
    "pearson_matrix": lambda s, d: _round(st.pearson_matrix(parts(s, d).withColumn("k", F.col("obs_id").cast("double")), ("y", "size", "k")), "r"),
    "sliced_scale": lambda s, d: _round(st.sliced_scale(vectors(s, d)), "scale"),
    "stability_flags": lambda s, d: _round(folds.stability(_assignments(s, d), 0.32), "distance"),
    "entity_fold_matrix": lambda s, d: folds.entity_folds(_assignments(s, d), vectors(s, d), "cls", ("s0", "s1", "s2", "s3", "s4")),
    "gradient_magnitudes": lambda s, d: _round(select.gradient_magnitudes(_gradients(s, d), {"M": 0.5, "B": 2.0}, {"M": 10.0}), "raw", "effective", n=5),
    "containment": lambda s, d: asg.containment(_hier(s, d)[0]),
    "containment_products": lambda s, d: asg.containment_products(*_hier(s, d)[:2]),
    "class_repair": _repaired,
    "adaptive_refine": lambda s, d: coarsen.adaptive_refine(parts(s, d), "brand", "y", 40),
    "similarity_costs": lambda s, d: _round(transport.similarity_costs(sim.edges_within(vectors(s, d), "cosine", EPS)), "val"),
    "source_arrays": lambda s, d: readers.read_arrays(s, _MATRIX, y=(0.5, 1.5, 2.5)).select("obs_id", F.posexplode("x").alias("axis", "v"), "w", "y"),
    "source_sparse": lambda s, d: readers.read_sparse(s, (0, 1, 2, 2), (1, 0, 0, 2), (0.5, 0.75, 0.25, 9.0)),
    "split_ablation": _ablated,
    "split_inputs": _swept,
}

_TARGETS = [[0.2] * 5, [0.1, 0.2, 0.3, 0.2, 0.2]]
QUERIES["match_gradient"] = lambda s, d: transport.match_gradient(_costs(s, d), _TARGETS).select("obs_id", "fold", F.round(F.col("gradient") * 1e6, 1).alias("gradient_e6"))


def _match_sql(rounds: int) -> str:
    """Rounds of the same updates for both folds, by recursion over arrays of duals."""
    m = range(len(_CENTRES))
    soft = "0.05::DOUBLE * (ln(a) - ln(" + " + ".join(f"exp((g[{j + 1}] - c[{j + 1}]) / 0.05::DOUBLE)" for j in m) + "))"
    raw = ", ".join(f"abs(y - {c}) / most" for c in _CENTRES)
    step = ", ".join(f"0.05::DOUBLE * (ln(b[{j + 1}]) - ln(sum(exp((f - c[{j + 1}]) / 0.05::DOUBLE))))" for j in m)
    return (
        f"WITH RECURSIVE {PARTS}, mx AS (SELECT max(greatest({', '.join(f'abs(y - {c})' for c in _CENTRES)})) AS most FROM parts), "
        f"r AS MATERIALIZED (SELECT obs_id, fold, w / sum(w) OVER (PARTITION BY fold) AS a, [{raw}] AS c FROM parts, mx), "
        f"tg AS (SELECT * FROM (VALUES (0, {_TARGETS[0]}::DOUBLE[]), (1, {_TARGETS[1]}::DOUBLE[])) t(fold, b)), "
        "it AS (SELECT 0 AS i, fold, [0, 0, 0, 0, 0]::DOUBLE[] AS g FROM tg UNION ALL "
        f"SELECT i + 1, fold, [{step}] FROM (SELECT it.i, it.fold, b, c, {soft} AS f FROM it JOIN r ON r.fold = it.fold JOIN tg ON tg.fold = it.fold WHERE i < {rounds}) GROUP BY i, fold, b), "
        f"ff AS (SELECT r.*, g, {soft} AS f FROM r JOIN it ON it.fold = r.fold AND i = {rounds})"
    )


_PACK = f"WITH RECURSIVE {CUSTOMERS}, n AS (SELECT *, row_number() OVER (ORDER BY mass DESC, nation::VARCHAR) AS k, sum(mass) OVER () AS total FROM (SELECT nation, sum(w) AS mass FROM customers GROUP BY 1)), p AS (SELECT 0::BIGINT AS k, NULL::BIGINT AS nation, -1 AS f, 0::DOUBLE AS h0, 0::DOUBLE AS h1 UNION ALL SELECT k, nation, f, CASE WHEN f = 0 THEN h0 + mass ELSE h0 END, CASE WHEN f = 1 THEN h1 + mass ELSE h1 END FROM (SELECT n.k, n.nation, mass, h0, h1, CASE WHEN 0.8::DOUBLE * total - h0 >= 0.2::DOUBLE * total - h1 THEN 0 ELSE 1 END AS f FROM p JOIN n ON n.k = p.k + 1))"

_RANGE = "SELECT fold, least(floor(({0} - lo) / (hi - lo) * 32), 31)::INT AS b FROM parts, (SELECT min({0}) - 1e-6::DOUBLE AS lo, max({0}) + 1e-6::DOUBLE AS hi FROM parts)"
_MI = "(SELECT sum(n / a * ln(n * a / (nf * nl))) FROM (SELECT n, sum(n) OVER (PARTITION BY fold) AS nf, sum(n) OVER (PARTITION BY b) AS nl, sum(n) OVER () AS a FROM (SELECT fold, b, count(*)::DOUBLE AS n FROM ({0}) GROUP BY 1, 2)))"


def _corr(a: str, b: str) -> str:
    return f"SELECT '{a}' AS a, '{b}' AS b, round(sum(w * {a} * {b}) / sqrt(sum(w * {a} * {a}) * sum(w * {b} * {b})), 6) AS r FROM c"


_CENTRED = "c AS (SELECT w, " + ", ".join(f"{e} - (SELECT sum(w * {e}) / sum(w) FROM parts) AS {n}" for e, n in (("y", "y"), ("size", "size"), ("obs_id", "k"))) + " FROM parts)"

ORACLE = {
    "derived_columns": f"WITH {PARTS} SELECT obs_id, round(y / greatest(size, 1), 6) AS ratio, round(log10(greatest(y, 1)), 6) AS log_y, greatest(5::DOUBLE, least(40::DOUBLE, size)) AS capped FROM parts",
    "filter_labelled": "SELECT doc_id, quality::BIGINT AS quality FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL",
    "rename_prefix": "SELECT n_nationkey AS country_nationkey, n_name AS country_name FROM nation",
    "entropy": f"WITH {PARTS}, n AS (SELECT count(*)::DOUBLE AS n FROM parts GROUP BY brand) SELECT round(-sum(n / t * ln(n / t)), 6) AS entropy FROM n, (SELECT sum(n) AS t FROM n)",
    "mi_targets": f"WITH {PARTS} SELECT round(({_MI.format(_RANGE.format('y'))} + {_MI.format(_RANGE.format('size'))}) / 2, 6) AS mi",
    "pearson_matrix": f"WITH {PARTS}, {_CENTRED} {_corr('y', 'size')} UNION ALL {_corr('y', 'k')} UNION ALL {_corr('size', 'k')}",
    "sliced_scale": f"WITH {VECTORS}, e AS (SELECT w, unnest(x) AS v, generate_subscripts(x, 1) AS axis FROM vecs), m AS (SELECT axis, sum(w * v) / sum(w) AS m FROM e GROUP BY 1) SELECT round(2 * sum(q), 6) AS scale FROM (SELECT sum(w * (v - m) * (v - m)) / sum(w) AS q FROM e JOIN m USING (axis) GROUP BY axis)",
    "stability_flags": f"WITH {_SAMPLES.format(n=5)}, h AS (SELECT 's' || a.sample AS config_a, 's' || b.sample AS config_b, avg((a.fold <> b.fold)::INT) AS d FROM smp a JOIN smp b ON a.obs_id = b.obs_id AND a.sample < b.sample GROUP BY 1, 2) SELECT config_a, config_b, round(d, 6) AS distance, d > 0.32 AS unstable FROM h",
    "entity_fold_matrix": f"WITH {_SAMPLES.format(n=5)}, b AS (SELECT cls, sample, arg_min(fold, -n * 2 + fold) AS f FROM (SELECT v.cls, s.sample, s.fold, count(*) AS n FROM smp s JOIN vecs v ON v.obs_id = s.obs_id WHERE v.cls IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2) SELECT cls, " + ", ".join(f"coalesce(max(CASE WHEN sample = {i} THEN f END), -1)::INT AS s{i}" for i in range(5)) + " FROM b GROUP BY 1",
    "gradient_magnitudes": f"WITH {_EPS}, g AS (SELECT src AS obs_id, f AS fold, 2 * (CASE WHEN any_value(a.fold) = f THEN sum(val) ELSE 0 END - sum(CASE WHEN b.fold = f THEN val ELSE 0 END)) AS g FROM edges JOIN vecs a ON a.obs_id = src JOIN vecs b ON b.obs_id = dst, (VALUES (0), (1)) v(f) GROUP BY src, f), n AS (SELECT 'M' AS term, sqrt(sum(g * g)) AS raw, 0.05::DOUBLE AS c FROM g UNION ALL SELECT 'B', sqrt(sum(w * w)), 2 FROM vecs) SELECT term, round(raw, 5) AS raw, round(raw * c, 5) AS effective, raw * c = (SELECT max(raw * c) FROM n) AS dominant FROM n",
    "containment": _HIER + " SELECT 'nation' AS level, g AS group_id, fold::INT AS fold, (f IS NOT NULL AND f = fold)::INT::DOUBLE AS y FROM y, (VALUES (0), (1)) k(fold)",
    "containment_products": _HIER + " SELECT 'nation' AS level, e.g, e.h, fold::INT AS fold, (coalesce(a.f = fold, false) AND coalesce(b.f = fold, false))::INT::DOUBLE AS p FROM e JOIN y a ON a.g = e.g JOIN y b ON b.g = e.h, (VALUES (0), (1)) k(fold)",
    "class_repair": f"WITH {CUSTOMERS}, t AS (SELECT cls, sum(CASE WHEN fold = 0 THEN w ELSE 0 END) - 0.8::DOUBLE * sum(w) AS over FROM customers GROUP BY 1), c AS (SELECT c.*, over, sum(w) OVER (PARTITION BY c.cls, fold ORDER BY obs_id ROWS UNBOUNDED PRECEDING) AS m FROM customers c JOIN t ON t.cls IS NOT DISTINCT FROM c.cls) SELECT obs_id, (CASE WHEN over > 0 AND fold = 0 AND m <= over + 1e-9::DOUBLE THEN 1 WHEN over < 0 AND fold = 1 AND m <= -over + 1e-9::DOUBLE THEN 0 ELSE fold END)::INT AS fold FROM c",
    "adaptive_refine": f"WITH {PARTS}, n AS (SELECT *, count(*) OVER (PARTITION BY brand) AS n, row_number() OVER (PARTITION BY brand ORDER BY y, obs_id) - 1 AS r, greatest(count(*) OVER () / 40::DOUBLE, 1) AS mean FROM parts) SELECT obs_id, brand || ':' || floor(r * (CASE WHEN n <= mean * 1.25::DOUBLE THEN 1 ELSE greatest(2, round_even(n / mean, 0)) END) / n)::BIGINT AS cell FROM n",
    "similarity_costs": f"WITH {_EPS} SELECT src, dst, round(greatest(1 - val, 0), 6) AS val FROM edges",
    "source_arrays": "SELECT i::BIGINT AS obs_id, a::INT AS axis, v::DOUBLE AS v, 1::DOUBLE AS w, (i + 0.5)::DOUBLE AS y FROM (VALUES " + ", ".join(f"({i}, {a}, {v})" for i, row in enumerate(_MATRIX) for a, v in enumerate(row)) + ") t(i, a, v)",
    "source_sparse": "SELECT src::BIGINT AS src, dst::BIGINT AS dst, val::DOUBLE AS val FROM (VALUES (0, 1, 0.75), (1, 0, 0.75), (2, 0, 0.25), (0, 2, 0.25)) t(src, dst, val)",
    "match_gradient": _match_sql(50) + ", m AS (SELECT fold, sum(a * f) / sum(a) AS mean FROM ff GROUP BY 1) SELECT obs_id, ff.fold, round((f - mean) * a * 1e6, 1) AS gradient_e6 FROM ff JOIN m ON m.fold = ff.fold",
    "match_cost": _match_sql(50) + " SELECT fold, round(sum(" + " + ".join(f"c[{j}] * exp((f + g[{j}] - c[{j}]) / 0.05::DOUBLE)" for j in range(1, 6)) + "), 4) AS cost FROM ff GROUP BY fold",
    "hierarchy_pack_init": _PACK + " SELECT obs_id, f::INT AS fold FROM customers JOIN p ON p.nation = customers.nation",
    "split_ablation": "SELECT c AS config_id, true AS h_given, true AS m_given, true AS d_absent FROM (VALUES ('H'), ('M'), ('HM')) t(c)",
    "split_inputs": "SELECT c AS config_id, true AS balanced, true AS valued FROM (VALUES ('cosine_0.3'), ('cosine_0.4'), ('supers_40')) t(c)",
}
