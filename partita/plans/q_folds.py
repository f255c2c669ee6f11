"""Queries of fold aggregations and preparation, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import folds, prep
from .fixtures import CUSTOMERS, ORDERS, PAIRS, PARTS, customers, fold_of, orders, pairs, parts, sql_fold, sql_hash, table

R = (0.8, 0.2)


def _levels(spark, d):
    c = customers(spark, d)
    return c.select(F.lit("nation").alias("level"), F.col("nation").alias("group_id"), "fold", "w").unionByName(c.select(F.lit("region").alias("level"), F.col("region").alias("group_id"), "fold", "w"))


_LEVELS = f"WITH {CUSTOMERS}, members AS (SELECT 'nation' AS level, nation AS group_id, fold, w FROM customers UNION ALL SELECT 'region', region, fold, w FROM customers)"


def _entity_folds(spark, d):
    p = pairs(spark, d)
    return p, folds.majority_fold(p, "left_id"), folds.majority_fold(p, "right_id")


_BEST = "SELECT {0}, fold FROM (SELECT {0}, fold, row_number() OVER (PARTITION BY {0} ORDER BY m DESC, fold) AS k FROM (SELECT {0}, fold, sum(w) AS m FROM {1} WHERE {0} IS NOT NULL GROUP BY 1, 2)) WHERE k = 1"
_DISCARD = f"WITH {PAIRS}, lf AS ({_BEST.format('left_id', 'prs')}), rf AS ({_BEST.format('right_id', 'prs')}), j AS (SELECT prs.w, lf.fold = rf.fold AS kept FROM prs JOIN lf USING (left_id) JOIN rf USING (right_id))"


def _docs(spark, d):
    x = table(spark, d, "documents").select(F.col("doc_id").alias("obs_id"), "lang", "source", "n_chars")
    return x.join(table(spark, d, "labels").select(F.col("doc_id").alias("obs_id"), "quality", "toxic"), "obs_id", "left").withColumn("fold", fold_of(F.col("obs_id")))


_DOCS = f"docs AS (SELECT d.doc_id AS obs_id, lang, source, n_chars, quality, toxic, {sql_fold('d.doc_id')} AS fold FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
_MI = "SELECT sum(n / a * ln(n * a / (nf * nl))) AS mi FROM (SELECT n, sum(n) OVER (PARTITION BY fold) AS nf, sum(n) OVER (PARTITION BY lab) AS nl, sum(n) OVER () AS a FROM (SELECT fold, lab, count(*)::DOUBLE AS n FROM {0} WHERE lab IS NOT NULL GROUP BY 1, 2))"


def _round(df, *cols, n=6):
    return df.select(*(F.round(c, n).alias(c) if c in cols else F.col(c) for c in df.columns))


def _lookup(spark, d):
    p = parts(spark, d)
    ref = p.where(F.col("obs_id") % 2 == 0).select("brand", "kind", F.col("size").alias("known"))
    ref = ref.groupBy("brand", "kind").agg(F.min("known").alias("known")).where(F.col("known") <= 5)
    return prep.two_tier_lookup(p.select("obs_id", "brand", "kind"), ref, ("brand", "kind"), "brand", "known")


QUERIES = {
    "fold_sizes": lambda s, d: _round(folds.fold_sizes(customers(s, d)), "mass"),
    "balance_residual": lambda s, d: _round(folds.balance_residual(customers(s, d), R), "mass", "residual"),
    "class_fold_tally": lambda s, d: _round(folds.class_fold_tally(customers(s, d)), "mass"),
    "class_max_violation": lambda s, d: _round(folds.class_max_violation(customers(s, d), R), "violation"),
    "hierarchy_integrity_rollup": lambda s, d: folds.group_integrity(_levels(s, d)).select(F.coalesce("level", F.lit("_aggregate")).alias("level"), "groups", "split", F.round("intact_mass", 6).alias("intact_mass"), F.round("mass", 6).alias("mass")),
    "hierarchy_minority_mass": lambda s, d: _round(folds.minority_mass(_levels(s, d)), "minority"),
    "entity_majority_fold": lambda s, d: folds.majority_fold(pairs(s, d), "left_id"),
    "entity_majority_repair": lambda s, d: folds.entity_repair(pairs(s, d), "right_id").groupBy("right_id").agg(F.min("fold").alias("lo"), F.max("fold").alias("hi"), F.count("*").alias("n")),
    "entity_straddle": lambda s, d: folds.entity_straddle(pairs(s, d), "left_id"),
    "entity_degrees": lambda s, d: _round(folds.entity_degrees(pairs(s, d), "left_id"), "mean_degree"),
    "cold_compound_groups": lambda s, d: _round(folds.compound_groups(pairs(s, d).select("left_id", F.col("right_id"), "w")), "mass"),
    "cold_discard_report": lambda s, d: _round(folds.discard_report(*_entity_folds(s, d)), "mass"),
    "weighted_discard": lambda s, d: _round(folds.weighted_discard(*_entity_folds(s, d)), "pair_fraction", "mass_fraction"),
    "pair_fold_stats": lambda s, d: _round(folds.pair_fold_stats(pairs(s, d)), "mean", "std"),
    "mi_discrete": lambda s, d: _round(folds.mutual_information(customers(s, d), "cls"), "mi", n=9),
    "mi_continuous": lambda s, d: _round(folds.mutual_information_continuous(orders(s, d)), "mi", n=9),
    "class_retention": lambda s, d: _round(folds.class_retention(_docs(s, d), "quality"), "rate", "deviation"),
    "eta_squared": lambda s, d: _round(folds.eta_squared(parts(s, d), "brand"), "eta2"),
    "impute_mean": lambda s, d: _round(prep.impute_mean(_docs(s, d).select("obs_id", F.col("quality").cast("double").alias("quality"), F.col("toxic").cast("double").alias("toxic")), "quality", "toxic"), "quality", "toxic"),
    "impute_median": lambda s, d: _round(prep.impute_median(_docs(s, d).select("obs_id", F.when(F.col("lang") != "fr", F.col("n_chars").cast("double")).otherwise(F.lit(float("nan"))).alias("size")), "size"), "size"),
    "zscore": lambda s, d: _round(prep.zscore(parts(s, d).select("obs_id", "y", "size"), "y", "size"), "y", "size"),
    "pool_rare": lambda s, d: prep.pool_rare(_docs(s, d).select("obs_id", F.concat_ws("|", "lang", "source").alias("cat")), "cat", 10),
    "family_floor_cap": lambda s, d: prep.family_floor_cap(parts(s, d).select("obs_id", "y", F.concat_ws("|", "brand", "kind").alias("family")), "family", "y", 8, 14).select("obs_id", "family"),
    "label_encode": lambda s, d: prep.label_encode(parts(s, d).select("obs_id", "kind"), "kind", "code"),
    "bin_edges": lambda s, d: parts(s, d).select("obs_id", prep.bin_edges(F.col("y"), (950, 1100, 1300, 1700)).cast("int").alias("bin")),
    "canonical_strings": lambda s, d: table(s, d, "part").select(F.col("p_partkey").alias("obs_id"), prep.canonical(F.concat(F.lit("  "), "p_name", F.lit("  – "), "p_type")).alias("text")),
    "composite_signature": lambda s, d: table(s, d, "part").select(F.col("p_partkey").alias("obs_id"), prep.signature(F.split(F.lower(F.concat_ws(" ", "p_type", "p_brand", "p_type")), " ")).alias("sig")),
    "composition_parse": lambda s, d: parts(s, d).select("obs_id", F.explode(prep.parse_composition(F.concat(F.lit("Fe"), F.col("size").cast("int").cast("string"), F.lit("O"), (F.col("obs_id") % 7).cast("string"), F.lit("C")))).alias("element", "fraction")).select("obs_id", "element", F.round("fraction", 6).alias("fraction")),
    "kmer_counts": lambda s, d: table(s, d, "nation").select(F.explode(prep.kmers(F.lower("n_name"), 3)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n")),
    "subsample": lambda s, d: prep.subsample(parts(s, d).select("obs_id", "y"), 100),
    "stratified_sample": lambda s, d: prep.stratified_sample(parts(s, d).select("obs_id", "brand"), "brand", 0.25),
    "two_tier_lookup": _lookup,
    "two_tier_accounting": lambda s, d: _lookup(s, d).groupBy("tier").agg(F.count("*").alias("n")),
    "lookup_absent_rows": lambda s, d: parts(s, d).select("obs_id", "brand").join(table(s, d, "lineitem").where("l_quantity >= 45").select(F.col("l_partkey").alias("obs_id")), "obs_id", "left_anti"),
    "drop_null_rows": lambda s, d: _docs(s, d).dropna(subset=["quality"]).select("obs_id", "quality", "toxic"),
}

_REF = "ref AS (SELECT * FROM (SELECT brand, kind, min(size) AS known FROM parts WHERE obs_id % 2 = 0 GROUP BY 1, 2) WHERE known <= 5), t1 AS (SELECT brand, kind, min(known) AS v FROM ref GROUP BY 1, 2 HAVING count(DISTINCT known) = 1), t2 AS (SELECT brand, min(known) AS v FROM ref GROUP BY 1 HAVING count(DISTINCT known) = 1), looked AS (SELECT p.obs_id, p.brand, p.kind, coalesce(t1.v, t2.v) AS known, (CASE WHEN t1.v IS NOT NULL THEN 1 WHEN t2.v IS NOT NULL THEN 2 ELSE 0 END) AS tier FROM parts p LEFT JOIN t1 ON p.brand = t1.brand AND p.kind = t1.kind LEFT JOIN t2 ON p.brand = t2.brand)"

ORACLE = {
    "fold_sizes": f"WITH {CUSTOMERS} SELECT fold, count(*) AS n, round(sum(w), 6) AS mass FROM customers GROUP BY fold",
    "balance_residual": f"WITH {CUSTOMERS} SELECT fold, round(m, 6) AS mass, round(m - (CASE fold WHEN 0 THEN 0.8::DOUBLE ELSE 0.2::DOUBLE END) * sum(m) OVER (), 6) AS residual FROM (SELECT fold, sum(w) AS m FROM customers GROUP BY fold)",
    "class_fold_tally": f"WITH {CUSTOMERS} SELECT g.cls, g.fold, round(coalesce(sum(c.w), 0), 6) AS mass FROM (SELECT DISTINCT cls, f AS fold FROM customers, (VALUES (0), (1)) v(f)) g LEFT JOIN customers c ON c.cls = g.cls AND c.fold = g.fold GROUP BY 1, 2",
    "class_max_violation": f"WITH {CUSTOMERS}, t AS (SELECT cls, sum(w) AS a, sum(CASE WHEN fold = 0 THEN w ELSE 0 END) AS m0, sum(CASE WHEN fold = 1 THEN w ELSE 0 END) AS m1 FROM customers GROUP BY cls) SELECT round(max(greatest(abs(m0 - 0.8::DOUBLE * a), abs(m1 - 0.2::DOUBLE * a)) / a), 6) AS violation FROM t",
    "hierarchy_integrity_rollup": _LEVELS + ", g AS (SELECT level, group_id, count(DISTINCT fold) AS folds, sum(w) AS mass FROM members GROUP BY 1, 2) SELECT coalesce(level, '_aggregate') AS level, count(*) AS groups, sum((folds > 1)::INT)::BIGINT AS split, round(sum(CASE WHEN folds = 1 THEN mass ELSE 0 END), 6) AS intact_mass, round(sum(mass), 6) AS mass FROM g GROUP BY ROLLUP (level)",
    "hierarchy_minority_mass": _LEVELS + ", f AS (SELECT level, group_id, fold, sum(w) AS m FROM members GROUP BY 1, 2, 3), g AS (SELECT level, group_id, sum(m) - max(m) AS k FROM f GROUP BY 1, 2) SELECT level, round(sum(k), 6) AS minority FROM g GROUP BY 1",
    "entity_majority_fold": f"WITH {PAIRS} {_BEST.format('left_id', 'prs')}",
    "entity_majority_repair": f"WITH {PAIRS}, b AS ({_BEST.format('right_id', 'prs')}) SELECT p.right_id, min(b.fold) AS lo, max(b.fold) AS hi, count(*) AS n FROM prs p JOIN b ON p.right_id = b.right_id GROUP BY 1",
    "entity_straddle": f"WITH {PAIRS} SELECT count(*) AS entities, sum((k > 1)::INT)::BIGINT AS straddling FROM (SELECT left_id, count(DISTINCT fold) AS k FROM prs GROUP BY 1)",
    "entity_degrees": f"WITH {PAIRS} SELECT count(*) AS entities, round(avg(k), 6) AS mean_degree, min(k) AS min_degree, max(k) AS max_degree FROM (SELECT left_id, count(*) AS k FROM prs GROUP BY 1)",
    "cold_compound_groups": f"WITH {PAIRS} SELECT left_id, right_id, count(*) AS n, round(sum(w), 6) AS mass FROM prs GROUP BY 1, 2",
    "cold_discard_report": _DISCARD + " SELECT kept, count(*) AS n, round(sum(w), 6) AS mass FROM j GROUP BY 1",
    "weighted_discard": _DISCARD + " SELECT round(avg((NOT kept)::INT), 6) AS pair_fraction, round(sum(CASE WHEN kept THEN 0 ELSE w END) / sum(w), 6) AS mass_fraction FROM j",
    "pair_fold_stats": f"WITH {PAIRS} SELECT fold, count(*) AS n, round(avg(y), 6) AS mean, round(coalesce(stddev_samp(y), 0), 6) AS std FROM prs GROUP BY 1",
    "mi_discrete": f"WITH {CUSTOMERS}, x AS (SELECT fold, cls AS lab FROM customers) SELECT round(mi, 9) AS mi FROM ({_MI.format('x')})",
    "mi_continuous": f"WITH {ORDERS}, e AS (SELECT min(y) - 1e-6::DOUBLE AS lo, max(y) + 1e-6::DOUBLE AS hi FROM ords), x AS (SELECT fold, least(floor((y - lo) / (hi - lo) * 32), 31) AS lab FROM ords, e) SELECT round(mi, 9) AS mi FROM ({_MI.format('x')})",
    "class_retention": f"WITH {_DOCS}, a AS (SELECT avg(quality) AS r FROM docs), g AS (SELECT fold, avg(quality) AS rate, count(quality) AS n FROM docs WHERE quality IS NOT NULL GROUP BY 1) SELECT fold, round(rate, 6) AS rate, round(abs(rate - r), 6) AS deviation FROM g, a WHERE n >= 5",
    "eta_squared": f"WITH {PARTS}, g AS (SELECT y, avg(y) OVER (PARTITION BY brand) AS gm, avg(y) OVER () AS am FROM parts) SELECT round(sum((gm - am) * (gm - am)) / sum((y - am) * (y - am)), 6) AS eta2 FROM g",
    "impute_mean": f"WITH {_DOCS} SELECT obs_id, round(coalesce(quality, avg(quality) OVER ()), 6)::DOUBLE AS quality, round(coalesce(toxic, avg(toxic) OVER ()), 6)::DOUBLE AS toxic FROM docs",
    "impute_median": f"WITH {_DOCS}, m AS (SELECT quantile_cont(n_chars::DOUBLE, 0.5) AS q FROM docs WHERE lang <> 'fr') SELECT obs_id, round(CASE WHEN lang <> 'fr' THEN n_chars ELSE q END, 6)::DOUBLE AS size FROM docs, m",
    "zscore": f"WITH {PARTS} SELECT obs_id, round((y - avg(y) OVER ()) / stddev_pop(y) OVER (), 6) AS y, round((size - avg(size) OVER ()) / stddev_pop(size) OVER (), 6) AS size FROM parts",
    "pool_rare": f"WITH {_DOCS}, x AS (SELECT obs_id, lang || '|' || source AS cat FROM docs) SELECT obs_id, CASE WHEN count(*) OVER (PARTITION BY cat) < 10 THEN 'other' ELSE cat END AS cat FROM x",
    "family_floor_cap": f"WITH {PARTS}, x AS (SELECT obs_id, brand || '|' || kind AS family, count(*) OVER (PARTITION BY brand, kind) AS n, row_number() OVER (PARTITION BY brand, kind ORDER BY y, obs_id) AS r FROM parts) SELECT obs_id, CASE WHEN n < 8 THEN 'minor' WHEN n > 14 THEN family || '#' || floor((r - 1) * ceil(n / 14) / n)::INT ELSE family END AS family FROM x",
    "label_encode": f"WITH {PARTS}, f AS (SELECT kind, row_number() OVER (ORDER BY min(obs_id)) - 1 AS code FROM parts GROUP BY kind) SELECT obs_id, kind, code::INT AS code FROM parts JOIN f USING (kind)",
    "bin_edges": f"WITH {PARTS} SELECT obs_id, (y > 950)::INT + (y > 1100)::INT + (y > 1300)::INT + (y > 1700)::INT AS bin FROM parts",
    "canonical_strings": "SELECT p_partkey AS obs_id, lower(trim(regexp_replace(regexp_replace('  ' || p_name || '  – ' || p_type, '[‐-―−]', '-', 'g'), '\\s+', ' ', 'g'))) AS text FROM part",
    "composite_signature": "SELECT p_partkey AS obs_id, array_to_string(list_sort(list_distinct(string_split(lower(p_type || ' ' || p_brand || ' ' || p_type), ' '))), '-') AS sig FROM part",
    "composition_parse": f"WITH {PARTS}, x AS (SELECT obs_id, size AS fe, (obs_id % 7)::DOUBLE AS o FROM parts) SELECT obs_id, u.e AS element, round(u.v / (fe + o + 1), 6) AS fraction FROM x, unnest([{{'e': 'Fe', 'v': fe}}, {{'e': 'O', 'v': o}}, {{'e': 'C', 'v': 1.0::DOUBLE}}]) t(u)",
    "kmer_counts": "SELECT substr(lower(n_name), i, 3) AS kmer, count(*) AS n FROM nation, range(1, 100) r(i) WHERE i <= length(n_name) - 2 GROUP BY 1",
    "subsample": f"WITH {PARTS} SELECT obs_id, y FROM parts ORDER BY {sql_hash('obs_id')}, obs_id LIMIT 100",
    "stratified_sample": f"WITH {PARTS}, x AS (SELECT obs_id, brand, row_number() OVER (PARTITION BY brand ORDER BY {sql_hash('obs_id')}, obs_id) AS r, count(*) OVER (PARTITION BY brand) AS n FROM parts) SELECT obs_id, brand FROM x WHERE r <= floor(0.25 * n + 0.5)",
    "two_tier_lookup": f"WITH {PARTS}, {_REF} SELECT * FROM looked",
    "two_tier_accounting": f"WITH {PARTS}, {_REF} SELECT tier, count(*) AS n FROM looked GROUP BY 1",
    "lookup_absent_rows": "SELECT p_partkey AS obs_id, p_brand AS brand FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 45)",
    "drop_null_rows": f"WITH {_DOCS} SELECT obs_id, quality, toxic FROM docs WHERE quality IS NOT NULL",
}
