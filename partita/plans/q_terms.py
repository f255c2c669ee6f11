"""Queries of distribution terms, coarsening, selection, the splitter, sources and the stream, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import coarsen, folds, graph, select, transport
from ..operators import similarity as sim
from ..sources import read_csv, read_edges, read_json_split, read_precomputed, write_assignment, write_table
from ..streaming.incremental import assign_stream
from .engine import SplitSpec, multi_split, split, sweep
from .fixtures import CUSTOMERS, PAIRS, PARTS, VECTORS, customers, pairs, parts, sql_hash, table, vectors
from .q_folds import R, _round
from .q_graph import _EPS, _SQ, EPS, _shingles

_CENTRES = (950.0, 1150.0, 1350.0, 1550.0, 1750.0)


def _kernel(s, d):
    return sim.Kernel(vectors(s, d), "rbf", 0.5)


_KERNEL = f"{VECTORS}, ker AS (SELECT a.obs_id AS src, b.obs_id AS dst, exp(-0.5 * {_SQ}) AS val FROM vecs a, vecs b), mass AS (SELECT fold, sum(w) AS tw FROM vecs GROUP BY 1), u AS (SELECT obs_id, fold, w / tw AS u FROM vecs JOIN mass USING (fold))"


def _costs(s, d):
    return transport.bin_costs(parts(s, d), _CENTRES)


def _sinkhorn_sql(rounds: int) -> str:
    """Unrolled rounds of the same updates, over five columns."""
    m = len(_CENTRES)
    raw = ", ".join(f"abs(y - {c}) / most AS c{j}" for j, c in enumerate(_CENTRES))
    q = f"WITH {PARTS}, mx AS (SELECT max(greatest({', '.join(f'abs(y - {c})' for c in _CENTRES)})) AS most FROM parts), r AS (SELECT obs_id, w / sum(w) OVER () AS a, {raw} FROM parts, mx), g0 AS (SELECT {', '.join(f'0.0::DOUBLE AS g{j}' for j in range(m))})"
    soft = lambda g: f"0.05::DOUBLE * (ln(a) - ln({' + '.join(f'exp((g{j} - c{j}) / 0.05::DOUBLE)' for j in range(m))}))"
    for i in range(rounds):
        q += f", f{i} AS (SELECT r.*, {soft(i)} AS f FROM r, g{i}), g{i + 1} AS (SELECT {', '.join(f'0.05::DOUBLE * (ln(0.2::DOUBLE) - ln(sum(exp((f - c{j}) / 0.05::DOUBLE)))) AS g{j}' for j in range(m))} FROM f{i})"
    q += f", ff AS (SELECT r.*, g{rounds}.*, {soft(rounds)} AS f FROM r, g{rounds}) SELECT round(sum({' + '.join(f'c{j} * exp((f + g{j} - c{j}) / 0.05::DOUBLE)' for j in range(m))}), 6) AS cost FROM ff"
    return q


def _sinkhorn(s, d):
    cost = transport.sinkhorn(_costs(s, d), [0.2] * 5, 0.05, 3, 0.0)[1]
    return s.createDataFrame([(round(cost, 6),)], "cost double")


def _super_rows(s, d):
    return vectors(s, d).withColumns({"super_id": F.col("obs_id") % 20, "y": F.col("obs_id").cast("double")})


def _super_members(s, d):
    return customers(s, d).select(F.lit("region").alias("level"), F.col("region").alias("group_id"), "obs_id"), customers(s, d).select("obs_id", (F.col("obs_id") % 40).alias("super_id"))


def _configs(s, d):
    """Metrics of forty hashed assignments of the vectors: a table to choose from."""
    a = select.random_assignments(vectors(s, d), 40, 0.8)
    m = a.groupBy("sample").agg(F.sum(F.when(F.col("fold") == 0, F.col("w")).otherwise(0.0)).alias("m0"), F.sum(F.when(F.col("fold") == 1, F.col("obs_id")).otherwise(0)).cast("double").alias("m1"), F.sum(F.when(F.col("fold") == 0, F.col("obs_id") % 7).otherwise(0)).cast("double").alias("m2"))
    return m.select(F.concat(F.lit("c"), F.lpad(F.col("sample").cast("string"), 3, "0")).alias("config_id"), "m0", "m1", "m2")


_SMP = f"smp AS (SELECT s AS sample, obs_id, w, (CASE WHEN {sql_hash("s || '-' || obs_id", 11)} < 3435973836 THEN 0 ELSE 1 END) AS fold FROM vecs, range({{n}}) t(s))"
_SAMPLES = VECTORS + ", " + _SMP
_CONFIGS = _SAMPLES.format(n=40) + ", cfg AS (SELECT 'c' || lpad(sample::VARCHAR, 3, '0') AS config_id, sum(CASE WHEN fold = 0 THEN w ELSE 0 END)::DOUBLE AS m0, sum(CASE WHEN fold = 1 THEN obs_id ELSE 0 END)::DOUBLE AS m1, sum(CASE WHEN fold = 0 THEN obs_id % 7 ELSE 0 END)::DOUBLE AS m2 FROM smp GROUP BY sample)"
_PARETO = _CONFIGS + ", par AS (SELECT a.*, NOT EXISTS (SELECT 1 FROM cfg b WHERE b.m0 <= a.m0 AND b.m1 <= a.m1 AND b.m2 <= a.m2 AND (b.m0 < a.m0 OR b.m1 < a.m1 OR b.m2 < a.m2)) AS is_pareto FROM cfg a), nrm AS (SELECT *, (m0 - min(m0) OVER ()) / (max(m0) OVER () - min(m0) OVER ()) AS n0, (m1 - min(m1) OVER ()) / (max(m1) OVER () - min(m1) OVER ()) AS n1, (m2 - min(m2) OVER ()) / (max(m2) OVER () - min(m2) OVER ()) AS n2 FROM par)"
_METRICS = ("m0", "m1", "m2")


def _rec(rule):
    return lambda s, d: select.recommend(_configs(s, d), _METRICS, rule)


def _rec_sql(score):
    return f"WITH {_PARETO} SELECT config_id, m0, m1, m2, round({score}, 9) AS score FROM nrm WHERE is_pareto ORDER BY round({score}, 9), round((n0 + n1 + n2) / 3, 9), config_id LIMIT 1"


def _assignments(s, d):
    return select.random_assignments(vectors(s, d), 5, 0.8).select(F.concat(F.lit("s"), F.col("sample").cast("string")).alias("config_id"), "obs_id", "fold")


def _spec(s, d, **more) -> SplitSpec:
    v = graph.cut_lineage(vectors(s, d).select("obs_id", "w", "x", "cls"))
    return SplitSpec(v.drop("x"), edges=sim.packed_edges(v, "cosine", EPS), provenance="cosine of embeddings", max_iter=3, **more)


def _split_report(s, d) -> DataFrame:
    spec = _spec(s, d)
    a = split(spec).assignment
    return folds.balance_residual(a.join(spec.obs, "obs_id"), R).join(graph.leakage(spec.edges, a).select(F.col("scaled").alias("leakage")))


def _hierarchy_split(s, d):
    c = customers(s, d).select("obs_id", "w", "nation", "y")
    a = split(SplitSpec(c, hierarchy="nation", stratify=True, mu=1.0, eps=0.1, max_iter=2)).assignment
    return folds.entity_straddle(a.join(c, "obs_id"), "nation")


def _files(s, d, name):
    graph.cut_lineage(s.range(0))  # sets the folder where none is set
    return f"{s.conf.get('spark.checkpoint.dir').rstrip('/')}/partita-sources-{name}-{abs(hash(d)) % 10**8}"


def _csv(s, d):
    path = _files(s, d, "csv")
    write_table(table(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), path, "csv")
    return read_csv(s, path, "n_nationkey int, n_name string, n_regionkey int")


def _latin1(s, d):
    path = _files(s, d, "latin")
    t = table(s, d, "nation").select("n_nationkey", F.concat(F.lit("é "), "n_name").alias("name"))
    t.write.mode("overwrite").option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return read_csv(s, path, "n_nationkey int, name string", "ISO-8859-1")


def _json(s, d):
    path = _files(s, d, "json")
    t = table(s, d, "nation").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("r"))
    t = t.select(F.to_json(F.struct(F.array(F.lit("key"), F.lit("name")).alias("columns"), F.transform("r", lambda r: r["n_nationkey"]).alias("index"), F.transform("r", lambda r: F.array(r["n_nationkey"].cast("string"), r["n_name"])).alias("data"))).alias("value"))
    t.coalesce(1).write.mode("overwrite").text(path)
    return read_json_split(s, path).select("index", F.col("key").cast("int").alias("key"), "name")


def _roundtrip(s, d):
    path = _files(s, d, "assign")
    write_assignment(customers(s, d), path)
    return read_csv(s, path, "obs_id long, fold int")


def _stream(s, d):
    """The stream's own result, written by a stream that reads the vectors from a folder of files."""
    src, out, chk = (_files(s, d, x) for x in ("stream-in", "stream-out", "stream-chk"))
    v = vectors(s, d).select("obs_id", "x")
    v.write.mode("overwrite").parquet(src)
    supers = vectors(s, d).where("obs_id % 25 = 0").select(F.col("obs_id").alias("super_id"), "x", "fold")
    jvm = s.sparkContext._jvm
    for p in (out, chk):
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    q = assign_stream(s.readStream.schema(v.schema).parquet(src), supers).writeStream.format("parquet").option("path", out).option("checkpointLocation", chk).trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.parquet(out).select("obs_id", "super_id", "fold", F.round("distance", 6).alias("distance"))


QUERIES = {
    "mmd_pairs": lambda s, d: _round(transport.mmd_pairs(_kernel(s, d), vectors(s, d)), "mmd2", n=9),
    "mmd_gradient": lambda s, d: transport.mmd_gradient(_kernel(s, d), vectors(s, d)).select("obs_id", F.round(F.col("gradient") * 1e3, 6).alias("gradient_e3")),
    "mmd_scales": lambda s, d: _round(transport.mmd_scales(_kernel(s, d)), "worst", "average"),
    "bin_costs": lambda s, d: _costs(s, d).select("obs_id", F.explode("c").alias("c")).groupBy("obs_id").agg(F.round(F.sum("c"), 6).alias("total"), F.round(F.min("c"), 6).alias("least")),
    "sinkhorn_fixed_iters": _sinkhorn,
    "match_cost": lambda s, d: _round(transport.match_cost(_costs(s, d), [[0.2] * 5, [0.1, 0.2, 0.3, 0.2, 0.2]]), "cost", n=4),
    "supernode_aggregate": lambda s, d: coarsen.supernode_aggregate(_super_rows(s, d)).select("super_id", F.round("w", 6).alias("w"), "n", F.round("y", 6).alias("y"), "cls", F.round(F.col("x")[0], 6).alias("x0"), F.round(F.col("x")[63], 6).alias("x63")),
    "lift_assignment": lambda s, d: coarsen.lift(vectors(s, d).select("obs_id", (F.col("obs_id") % 20).alias("super_id")), s.range(20).select(F.col("id").alias("super_id"), (F.col("id") % 2).cast("int").alias("fold"))),
    "project_folds": lambda s, d: coarsen.project_folds(_super_rows(s, d)),
    "soft_mass": lambda s, d: _round(coarsen.soft_mass(_super_rows(s, d)), "share"),
    "hierarchy_remap_majority": lambda s, d: coarsen.remap_majority(*_super_members(s, d)),
    "pure_cells_ntile": lambda s, d: coarsen.pure_cells(parts(s, d), "brand", "kind", "y", 5),
    "lsh_candidates": lambda s, d: coarsen.lsh_candidates(_shingles(s, d)),
    "balanced_kmeans": lambda s, d: coarsen.balanced_kmeans(vectors(s, d), 8),
    "spectral_init": lambda s, d: coarsen.spectral_init(sim.edges_within(vectors(s, d), "cosine", EPS), vectors(s, d), rounds=12),
    "pareto_frontier": lambda s, d: select.pareto(_configs(s, d), _METRICS),
    "recommend_min_max": _rec("min_of_normalized"),
    "recommend_min_mean": _rec("min_mean"),
    "recommend_closest": _rec("pareto_closest"),
    "stage0_normalizers": lambda s, d: _round(select.stage0_cut(vectors(s, d), sim.edges_within(vectors(s, d), "cosine", EPS), 10), "mean_cut", "mean_balance"),
    "hamming_matrix": lambda s, d: _round(folds.hamming(_assignments(s, d)), "distance"),
    "fold_wide_export": lambda s, d: folds.fold_wide(_assignments(s, d), ("s0", "s1", "s2")),
    "gradient_alignment": lambda s, d: _round(select.gradient_alignment(graph.cut_gradient(sim.edges_within(vectors(s, d), "cosine", EPS), vectors(s, d)).select(F.lit("M").alias("term"), "obs_id", "fold", F.col("gradient").alias("g")).unionByName(vectors(s, d).select(F.lit("B").alias("term"), "obs_id", "fold", F.col("w").alias("g")))), "cosine"),
    "split_end_to_end": _split_report,
    "split_hierarchy": _hierarchy_split,
    "multi_split": lambda s, d: multi_split(_spec(s, d), 2, 0.5)[1],
    "sweep_table": lambda s, d: sweep(_spec(s, d), (1.0,), (0.5, 1.0), (1.0,))[0],
    "source_csv": _csv,
    "source_csv_latin1": _latin1,
    "source_json_split": _json,
    "source_precomputed": lambda s, d: read_precomputed(parts(s, d).select("obs_id", "kind"), "obs_id", "kind", {"ECONOMY": 0, "STANDARD": 1}),
    "source_edges": lambda s, d: read_edges(pairs(s, d).select("left_id", "right_id", "w"), "left_id", "right_id", "w"),
    "sink_assignment": _roundtrip,
    "stream_incremental": _stream,
}

ORACLE = {
    "mmd_pairs": f"WITH {_KERNEL}, c AS (SELECT a.fold AS fa, b.fold AS fb, sum(a.u * b.u * val) AS c FROM ker JOIN u a ON a.obs_id = src JOIN u b ON b.obs_id = dst GROUP BY 1, 2) SELECT 0 AS fold_a, 1 AS fold_b, round(greatest((SELECT c FROM c WHERE fa = 0 AND fb = 0) + (SELECT c FROM c WHERE fa = 1 AND fb = 1) - 2 * (SELECT c FROM c WHERE fa = 0 AND fb = 1), 0), 9)::DOUBLE AS mmd2",
    "mmd_gradient": f"WITH {_KERNEL} SELECT a.obs_id, round(1e3 * (-2 * any_value(a.u) * sum((CASE WHEN a.fold = b.fold THEN 1 ELSE -1 END) * val * b.u)), 6)::DOUBLE AS gradient_e3 FROM ker JOIN u a ON a.obs_id = src JOIN u b ON b.obs_id = dst GROUP BY 1",
    "mmd_scales": f"WITH {_KERNEL} SELECT round(2 * (max(CASE WHEN src = dst THEN val END) - min(val)), 6) AS worst, round(2 * (avg(CASE WHEN src = dst THEN val END) - avg(val)), 6) AS average FROM ker",
    "bin_costs": f"WITH {PARTS}, x AS (SELECT obs_id, [abs(y - 950), abs(y - 1150), abs(y - 1350), abs(y - 1550), abs(y - 1750)] AS c FROM parts), m AS (SELECT max(list_max(c)) AS most FROM x) SELECT obs_id, round(list_sum(c) / most, 6) AS total, round(list_min(c) / most, 6) AS least FROM x, m",
    "sinkhorn_fixed_iters": _sinkhorn_sql(3),
    "supernode_aggregate": f"WITH {VECTORS}, s AS (SELECT *, obs_id % 20 AS super_id FROM vecs), k AS (SELECT super_id, cls, row_number() OVER (PARTITION BY super_id ORDER BY sum(w) DESC, cls) AS r FROM s GROUP BY 1, 2) SELECT s.super_id, round(sum(w), 6) AS w, count(*) AS n, round(sum(w * obs_id) / sum(w), 6) AS y, any_value(k.cls) AS cls, round(sum(w * x[1]) / sum(w), 6) AS x0, round(sum(w * x[64]) / sum(w), 6) AS x63 FROM s JOIN k ON k.super_id = s.super_id AND r = 1 GROUP BY 1",
    "lift_assignment": "SELECT vec_id AS obs_id, (vec_id % 20 % 2)::INT AS fold FROM embeddings",
    "project_folds": f"WITH {VECTORS} SELECT super_id, fold FROM (SELECT obs_id % 20 AS super_id, fold, row_number() OVER (PARTITION BY obs_id % 20 ORDER BY sum(w) DESC, fold) AS r FROM vecs GROUP BY 1, 2) WHERE r = 1",
    "soft_mass": f"WITH {VECTORS} SELECT obs_id % 20 AS super_id, fold, round(sum(w) / sum(sum(w)) OVER (PARTITION BY obs_id % 20), 6) AS share FROM vecs GROUP BY 1, 2",
    "hierarchy_remap_majority": f"WITH {CUSTOMERS} SELECT 'region' AS level, super_id, region AS group_id FROM (SELECT obs_id % 40 AS super_id, region, row_number() OVER (PARTITION BY obs_id % 40 ORDER BY count(*) DESC, region) AS r FROM customers GROUP BY 1, 2) WHERE r = 1",
    "pure_cells_ntile": f"WITH {PARTS} SELECT obs_id, brand || ':' || kind || ':' || floor((row_number() OVER (PARTITION BY brand, kind ORDER BY y, obs_id) - 1) * ceil(count(*) OVER (PARTITION BY brand, kind) / 5) / count(*) OVER (PARTITION BY brand, kind))::BIGINT AS cell FROM parts",
    "pareto_frontier": f"WITH {_PARETO} SELECT config_id, m0, m1, m2, is_pareto FROM par",
    "recommend_min_max": _rec_sql("greatest(n0, n1, n2)"),
    "recommend_min_mean": _rec_sql("(n0 + n1 + n2) / 3"),
    "recommend_closest": _rec_sql("sqrt(n0 * n0 + n1 * n1 + n2 * n2)"),
    "stage0_normalizers": f"WITH {_EPS}, {_SMP.format(n=10)}, c AS (SELECT a.sample, sum(CASE WHEN a.fold <> b.fold THEN val ELSE 0 END) AS cut FROM edges JOIN smp a ON a.obs_id = src JOIN smp b ON b.obs_id = dst AND a.sample = b.sample GROUP BY 1), r AS (SELECT sample, sum(CASE WHEN fold = 0 THEN w ELSE 0 END) - 0.8::DOUBLE * sum(w) AS r FROM smp GROUP BY 1) SELECT round(avg(cut), 6) AS mean_cut, round(avg(r * r), 6) AS mean_balance FROM c JOIN r USING (sample)",
    "hamming_matrix": f"WITH {_SAMPLES.format(n=5)} SELECT 's' || a.sample AS config_a, 's' || b.sample AS config_b, round(avg((a.fold <> b.fold)::INT), 6) AS distance FROM smp a JOIN smp b ON a.obs_id = b.obs_id AND a.sample < b.sample GROUP BY 1, 2",
    "fold_wide_export": f"WITH {_SAMPLES.format(n=5)} SELECT obs_id, max(CASE WHEN sample = 0 THEN fold END) AS s0, max(CASE WHEN sample = 1 THEN fold END) AS s1, max(CASE WHEN sample = 2 THEN fold END) AS s2 FROM smp GROUP BY 1",
    "gradient_alignment": f"WITH {_EPS}, g AS (SELECT src AS obs_id, f AS fold, 2 * (CASE WHEN any_value(a.fold) = f THEN sum(val) ELSE 0 END - sum(CASE WHEN b.fold = f THEN val ELSE 0 END)) AS g FROM edges JOIN vecs a ON a.obs_id = src JOIN vecs b ON b.obs_id = dst, (VALUES (0), (1)) v(f) GROUP BY src, f) SELECT 'B' AS term_a, 'M' AS term_b, round((SELECT sum(g * w) FROM g JOIN vecs USING (obs_id, fold)) / (sqrt((SELECT sum(g * g) FROM g)) * sqrt((SELECT sum(w * w) FROM vecs))), 6)::DOUBLE AS cosine",
    "source_csv": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
    "source_csv_latin1": "SELECT n_nationkey, 'é ' || n_name AS name FROM nation",
    "source_json_split": "SELECT n_nationkey::BIGINT AS index, n_nationkey AS key, n_name AS name FROM nation",
    "source_precomputed": f"WITH {PARTS} SELECT obs_id, (CASE kind WHEN 'ECONOMY' THEN 0 WHEN 'STANDARD' THEN 1 ELSE -1 END) AS fold FROM parts",
    "source_edges": f"WITH {PAIRS}, e AS (SELECT left_id AS a, right_id AS b, w FROM prs WHERE left_id <> right_id) SELECT src, dst, max(w)::DOUBLE AS val FROM (SELECT a AS src, b AS dst, w FROM e UNION ALL SELECT b, a, w FROM e) GROUP BY 1, 2",
    "sink_assignment": f"WITH {CUSTOMERS} SELECT obs_id, fold FROM customers",
    "stream_incremental": f"WITH {VECTORS}, c AS (SELECT a.obs_id, b.obs_id AS super_id, b.fold, {_SQ} AS dd FROM vecs a JOIN vecs b ON b.obs_id % 25 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY obs_id ORDER BY dd, super_id) AS k FROM c) SELECT obs_id, super_id, fold, round(dd, 6) AS distance FROM r WHERE k = 1",
}
