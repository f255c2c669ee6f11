"""Choosing among configurations: Pareto front, recommendation, calibration by random assignments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rng import SPAN, hash_int
from .similarity import BlockEdges


def pareto(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """``df`` (config_id, metrics to minimise) with is_pareto: no other row is as good in all and better in one. Rows are
    configurations of a sweep, which are few; equal rows are all kept."""
    a, b = df.alias("a"), F.broadcast(df.alias("b"))
    le = [F.col(f"b.{m}") <= F.col(f"a.{m}") for m in metrics]
    lt = [F.col(f"b.{m}") < F.col(f"a.{m}") for m in metrics]
    cond, better = le[0], lt[0]
    for x, y in zip(le[1:], lt[1:]):
        cond, better = cond & x, better | y
    beaten = a.join(b, cond & better, "left_semi").select(F.col("a.config_id").alias("config_id"), F.lit(False).alias("_p"))
    return df.join(beaten, "config_id", "left").select(*df.columns, F.coalesce("_p", F.lit(True)).alias("is_pareto"))


def recommend(df: DataFrame, metrics: Sequence[str], rule: str = "min_of_normalized") -> DataFrame:
    """One row of the Pareto front, with score: metrics are scaled to 0..1 by their range, which also orders negative
    values rightly. Rules: the smallest largest metric, the smallest mean (``min_mean``), or the smallest distance to the
    ideal point (``pareto_closest``); ties go to the smaller mean, then config_id."""
    p = pareto(df, metrics)
    lo = {m: F.min(m).over(Window.partitionBy()) for m in metrics}
    hi = {m: F.max(m).over(Window.partitionBy()) for m in metrics}
    n = p.select("*", *(F.coalesce((F.col(m) - lo[m]) / F.nullif(hi[m] - lo[m], F.lit(0.0)), F.lit(0.0)).alias(f"_{m}") for m in metrics))
    cols = [F.col(f"_{m}") for m in metrics]
    mean = sum(cols[1:], cols[0]) / len(cols)
    score = {"min_of_normalized": F.greatest(*cols) if len(cols) > 1 else cols[0], "min_mean": mean, "pareto_closest": F.sqrt(sum((c * c for c in cols[1:]), cols[0] * cols[0]))}[rule]
    return n.where("is_pareto").select(*df.columns, F.round(score, 9).alias("score"), F.round(mean, 9).alias("_mean")).orderBy("score", "_mean", "config_id").limit(1).drop("_mean")


def random_assignments(df: DataFrame, samples: int, share: float, seed: int = 11) -> DataFrame:
    """sample, obs_id, fold, w: ``samples`` hashed assignments of every row to two folds, in one table."""
    s = df.select("obs_id", "w", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample"))
    key = F.concat_ws("-", "sample", "obs_id")
    return s.select("sample", "obs_id", F.when(hash_int(key, seed) < int(share * SPAN), 0).otherwise(1).alias("fold"), "w")


def stage0_cut(df: DataFrame, edges: DataFrame | BlockEdges, samples: int = 20, share: float = 0.8, seed: int = 11) -> DataFrame:
    """One row, mean_cut and mean_balance: absolute terms averaged over random assignments, the scale that a term is
    divided by. Each edge meets its ends' folds, so all samples are one join."""
    a = random_assignments(df, samples, share, seed)
    if isinstance(edges, BlockEdges) and 1 < samples < 63:
        bits = a.groupBy("obs_id").agg(F.sum(F.col("fold") * F.pow(F.lit(2.0), "sample").cast("long")).alias("label"))
        cut = edges.cuts(bits, samples).select(F.posexplode("cut").alias("sample", "cut"))
    else:
        cut = _sample_cuts(edges.listed() if isinstance(edges, BlockEdges) else edges, a)
    bal = a.groupBy("sample").agg((F.sum(F.when(F.col("fold") == 0, F.col("w")).otherwise(0.0)) - share * F.sum("w")).alias("r"))
    return cut.join(bal, "sample").agg(F.avg(F.abs("cut")).alias("mean_cut"), F.avg(F.col("r") * F.col("r")).alias("mean_balance"))


def _sample_cuts(edges: DataFrame, a: DataFrame) -> DataFrame:
    j = edges.join(a.select("sample", F.col("obs_id").alias("src"), F.col("fold").alias("fs")), "src").join(a.select("sample", F.col("obs_id").alias("dst"), F.col("fold").alias("fd")), ["dst", "sample"])
    return j.groupBy("sample").agg(F.sum(F.when(F.col("fs") != F.col("fd"), F.col("val")).otherwise(0.0)).alias("cut"))


def gradient_alignment(terms: DataFrame) -> DataFrame:
    """term_a, term_b, cosine of gradients given as rows (term, obs_id, fold, g)."""
    a, b = terms.withColumnsRenamed({"term": "term_a", "g": "ga"}), terms.withColumnsRenamed({"term": "term_b", "g": "gb"})
    dot = a.join(b, ["obs_id", "fold"]).where("term_a < term_b").groupBy("term_a", "term_b").agg(F.sum(F.col("ga") * F.col("gb")).alias("d"))
    n = terms.groupBy("term").agg(F.sqrt(F.sum(F.col("g") * F.col("g"))).alias("n"))
    j = dot.join(F.broadcast(n.withColumnsRenamed({"term": "term_a", "n": "na"})), "term_a").join(F.broadcast(n.withColumnsRenamed({"term": "term_b", "n": "nb"})), "term_b")
    return j.select("term_a", "term_b", (F.col("d") / F.nullif(F.col("na") * F.col("nb"), F.lit(0.0))).alias("cosine"))


def bootstrap_mean(df: DataFrame, value: str, samples: int = 100, seed: int = 19) -> DataFrame:
    """One row, mean, lo and hi: a 95 % interval of the mean by the Poisson bootstrap, in one pass: every row counts in
    each sample as often as a Poisson(1) draw from the portable hash says."""
    import math

    cum = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(8)]
    s = df.where(F.col(value).isNotNull()).select("obs_id", F.col(value).cast("double").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample"))
    u = hash_int(F.concat_ws("-", "sample", "obs_id"), seed) / F.lit(float(SPAN))
    k = sum(((u >= c).cast("int") for c in cum[1:]), (u >= cum[0]).cast("int"))
    m = s.withColumn("k", k).groupBy("sample").agg((F.sum(F.col("k") * F.col("v")) / F.nullif(F.sum("k"), F.lit(0))).alias("m"))
    ends = m.agg(F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi"))
    return df.agg(F.avg(value).alias("mean")).join(F.broadcast(ends))


def gradient_magnitudes(terms: DataFrame, coefficients: dict[str, float], scale: dict[str, float] | None = None) -> DataFrame:
    """term, raw, effective and dominant: norms of gradients given as rows (term, obs_id, fold, g), the same times the
    term's coefficient over its scale, and whether that is the largest (the first name of ties)."""
    weigh = F.create_map(*(F.lit(x) for t, c in coefficients.items() for x in (t, float(c) / (scale or {}).get(t, 1.0))))
    n = terms.groupBy("term").agg(F.sqrt(F.sum(F.col("g") * F.col("g"))).alias("raw")).withColumn("effective", F.col("raw") * weigh[F.col("term")])
    top = n.agg(F.min_by("term", F.struct(-F.col("effective"), F.col("term"))).alias("_top"))
    return n.join(F.broadcast(top)).select("term", "raw", "effective", (F.col("term") == F.col("_top")).alias("dominant"))
