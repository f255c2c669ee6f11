"""Graph operators on edge tables (src, dst, val), both directions present, and assignments (obs_id, fold).

Matrices are never dense: products with an assignment are two equi-joins and a sum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut_lineage
from ..functions.prefix import next_value, percentiles
from .similarity import BlockEdges, nearest


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("obs_id")).agg(F.sum("val").alias("degree"), F.count("*").alias("neighbours"))


def with_folds(edges: DataFrame, assign: DataFrame) -> DataFrame:
    """Edges with fold_src and fold_dst; edges of unassigned rows drop out."""
    a = assign.select("obs_id", "fold")
    return edges.join(a.withColumnsRenamed({"obs_id": "src", "fold": "fold_src"}), "src").join(a.withColumnsRenamed({"obs_id": "dst", "fold": "fold_dst"}), "dst")


def cut_energy(edges: DataFrame | BlockEdges, assign: DataFrame) -> DataFrame:
    """One row, energy: the weight of directed edges between folds."""
    if isinstance(edges, BlockEdges):
        return edges.cuts(assign.select("obs_id", F.col("fold").alias("label"))).select(F.col("cut")[0].alias("energy"))
    return with_folds(edges, assign).agg(F.coalesce(F.sum(F.when(F.col("fold_src") != F.col("fold_dst"), F.col("val"))), F.lit(0.0)).alias("energy"))


def leakage(edges: DataFrame | BlockEdges, assign: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """One row, raw, total and scaled: cross-fold similarity mass and its share; with ``weights`` (obs_id, w) each edge
    counts w_src w_dst times."""
    if isinstance(edges, BlockEdges) and weights is None:
        s = edges.cuts(assign.select("obs_id", F.col("fold").alias("label"))).select(F.col("cut")[0].alias("raw"), "total")
    else:
        e = edges.listed() if isinstance(edges, BlockEdges) else edges
        e = mass_weighted(e, weights) if weights is not None else e
        s = with_folds(e, assign).agg(F.coalesce(F.sum(F.when(F.col("fold_src") != F.col("fold_dst"), F.col("val"))), F.lit(0.0)).alias("raw"), F.sum("val").alias("total"))
    return s.withColumn("scaled", F.col("raw") / F.nullif(F.col("total"), F.lit(0.0)))


def mass_weighted(edges: DataFrame, weights: DataFrame) -> DataFrame:
    w = weights.select("obs_id", "w")
    j = edges.join(w.withColumnsRenamed({"obs_id": "src", "w": "ws"}), "src").join(w.withColumnsRenamed({"obs_id": "dst", "w": "wd"}), "dst")
    return j.select("src", "dst", (F.col("val") * F.col("ws") * F.col("wd")).alias("val"))


def cut_gradient(edges: DataFrame | BlockEdges, assign: DataFrame, k: int = 2) -> DataFrame:
    """obs_id, fold, gradient of the cut, 2 (D z - A z), for every row with an edge and every fold."""
    if isinstance(edges, BlockEdges):
        g = edges.affinities(assign, k)
    else:
        to = [F.sum(F.when(F.col("fold_dst") == i, F.col("val")).otherwise(0.0)).alias(f"a{i}") for i in range(k)]
        g = with_folds(edges, assign).groupBy("src", "fold_src").agg(F.sum("val").alias("deg"), *to)
    rows = F.array(*(F.struct(F.lit(i).alias("fold"), (2 * (F.when(F.col("fold_src") == i, F.col("deg")).otherwise(0.0) - F.col(f"a{i}"))).alias("gradient")) for i in range(k)))
    return g.select(F.col("src").alias("obs_id"), F.explode(rows).alias("r")).select("obs_id", "r.fold", "r.gradient")


def galerkin(edges: DataFrame, labels: DataFrame, how: str = "sum") -> DataFrame:
    """Edges between super-nodes (obs_id, super_id), diagonal included: weights summed, or averaged for kernels."""
    a = labels.select("obs_id", "super_id")
    j = edges.join(a.withColumnsRenamed({"obs_id": "src", "super_id": "s"}), "src").join(a.withColumnsRenamed({"obs_id": "dst", "super_id": "t"}), "dst")
    return j.groupBy(F.col("s").alias("src"), F.col("t").alias("dst")).agg((F.sum if how == "sum" else F.avg)("val").alias("val"))


def laplacian(edges: DataFrame, normalised: bool = False) -> DataFrame:
    """Entries of D - A, or of I - D^-1/2 A D^-1/2; rows without edges have none."""
    d = edges.groupBy("src").agg(F.sum("val").alias("d"))
    if not normalised:
        return edges.select("src", "dst", (-F.col("val")).alias("val")).unionByName(d.select("src", F.col("src").alias("dst"), F.col("d").alias("val"))).groupBy("src", "dst").agg(F.sum("val").alias("val"))
    j = edges.join(d, "src").join(d.withColumnsRenamed({"src": "dst", "d": "e"}), "dst")
    off = j.select("src", "dst", (-F.col("val") / F.sqrt(F.col("d") * F.col("e"))).alias("val"))
    return off.unionByName(d.select("src", F.col("src").alias("dst"), F.lit(1.0).alias("val"))).groupBy("src", "dst").agg(F.sum("val").alias("val"))


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """obs_id, component (its smallest id); isolated nodes are their own. Minimum labels with pointer jumping."""
    e = cut_lineage(edges.select("src", "dst").distinct())
    labels = cut_lineage(nodes.select("obs_id", F.col("obs_id").alias("component")))
    while True:
        near = e.join(labels, e.dst == labels.obs_id).groupBy("src").agg(F.min("component").alias("near"))
        moved = labels.join(near, labels.obs_id == near.src, "left").select("obs_id", F.col("component").alias("old"), F.least("component", "near").alias("c"))
        up = labels.select(F.col("obs_id").alias("c"), F.col("component").alias("up"))
        new = cut_lineage(moved.join(up, "c", "left").select("obs_id", "old", F.least("c", "up").alias("component")))
        labels = new.select("obs_id", "component")
        if new.where("old <> component").isEmpty():
            return labels


def rescue_isolated(edges: DataFrame, df: DataFrame, weight: float, links: int = 3, metric: str = "cosine") -> DataFrame:
    """Edges in which each row of ``df`` (obs_id, x) without one is linked, both ways, to its nearest rows."""
    alone = df.join(edges.select(F.col("src").alias("obs_id")).distinct(), "obs_id", "left_anti")
    new = nearest(alone, df, links, metric).select("src", "dst", F.lit(float(weight)).alias("val"))
    every = edges.select("src", "dst", "val").unionByName(new).unionByName(new.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "val"))
    return every.groupBy("src", "dst").agg(F.max("val").alias("val"))


def singleton_chain(edges: DataFrame, nodes: DataFrame, weight: float) -> DataFrame:
    """Edges that link rows without an edge to the next such row of the same coarse key (``key``), both ways: one
    component a key with linearly many edges, where a clique would have quadratically many."""
    alone = nodes.join(edges.select(F.col("src").alias("obs_id")).distinct(), "obs_id", "left_anti")
    c = next_value(alone.where("key is not null").select("key", "obs_id"), "obs_id", "dst", keys=("key",))
    c = c.select(F.col("obs_id").alias("src"), "dst").where("dst is not null").withColumn("val", F.lit(float(weight)))
    return edges.select("src", "dst", "val").unionByName(c).unionByName(c.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "val"))


def singleton_clique(edges: DataFrame, nodes: DataFrame, weight: float, most: int = 64) -> DataFrame:
    """Like :func:`singleton_chain`, but all pairs of a key's isolated rows. Raises ValueError where a key has more than
    ``most`` of them, as edges grow with the square: the chain joins the same components."""
    alone = nodes.join(edges.select(F.col("src").alias("obs_id")).distinct(), "obs_id", "left_anti").where("key is not null")
    largest = alone.groupBy("key").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > most:
        raise ValueError(f"a key has {largest} isolated rows, more than {most}: use singleton_chain")
    pairs = alone.select(F.col("obs_id").alias("src"), "key").join(alone.select(F.col("obs_id").alias("dst"), "key"), "key").where("src <> dst").select("src", "dst", F.lit(float(weight)).alias("val"))
    return edges.select("src", "dst", "val").unionByName(pairs)


def calibrate(edges: DataFrame, n: int, grid: Sequence[float], floor: float | None = None) -> DataFrame:
    """eps, density, mean_degree, isolated, chosen for similarity bounds: the largest whose mean degree reaches ``floor``
    (max(4, log2 n) by default) is chosen. Edges must hold all pairs above the smallest bound."""
    import math

    least = max(4.0, math.log2(max(n, 2))) if floor is None else floor
    hits = edges.select("src", F.explode(F.filter(F.array(*map(F.lit, map(float, grid))), lambda e: F.col("val") >= e)).alias("eps"))
    per = hits.groupBy("eps", "src").agg(F.count("*").alias("d")).groupBy("eps").agg(F.sum("d").alias("m"), F.count("*").alias("linked"))
    spark = edges.sparkSession
    t = spark.createDataFrame([(float(g),) for g in grid], "eps double").join(per, "eps", "left")
    m, linked = F.coalesce("m", F.lit(0)), F.coalesce("linked", F.lit(0))
    t = t.select("eps", (m / (n * (n - 1.0))).alias("density"), (m / n).alias("mean_degree"), (1 - linked / n).alias("isolated"))
    best = F.max(F.when(F.col("mean_degree") >= least, F.col("eps"))).over(Window.partitionBy())
    return t.withColumn("chosen", F.coalesce(F.col("eps") == best, F.lit(False)))


# Leakage and out-of-distribution metrics on neighbours


def knn_purity(neighbours: DataFrame, assign: DataFrame, test: int = 1, train: int = 0) -> DataFrame:
    """One row, purity: the share of test rows' neighbours (src, rank, dst, val) that lie in the training fold."""
    j = with_folds(neighbours, assign).where(F.col("fold_src") == test)
    return j.agg(F.avg((F.col("fold_dst") == train).cast("double")).alias("purity"))


def nearest_distance_stats(df: DataFrame, metric: str = "euclidean", test: int = 1, train: int = 0) -> DataFrame:
    """One row: mean, p95 and max of test rows' distance to their nearest training row."""
    d = nearest(df.where(F.col("fold") == test), df.where(F.col("fold") == train), 1, metric)
    d = cut_lineage(d)
    p95 = percentiles(d, "val", [0.95]).select(F.col("q")[0].alias("p95"))
    return d.agg(F.avg("val").alias("mean"), F.max("val").alias("max")).join(F.broadcast(p95)).select("mean", "p95", "max")


def proximity_leakage(df: DataFrame, m: int = 64, test: int = 1, train: int = 0) -> DataFrame:
    """One row, tpl: 2 P(phi_train > phi_test) - 1, phi being a row's mean Gaussian kernel over its m nearest training rows
    and the bandwidth the median distance to the nearest; ties count a half."""
    from .stratify import mann_whitney

    rows = df.where(F.col("fold").isin(test, train))
    nn = cut_lineage(nearest(rows, df.where(F.col("fold") == train), m, "sqdist").withColumnRenamed("src", "obs_id"))
    h = percentiles(nn.where("rank = 1").select(F.sqrt("val").alias("d")), "d", [0.5]).select(F.col("q")[0].alias("h"))
    phi = nn.join(F.broadcast(h)).groupBy("obs_id").agg(F.avg(F.exp(-F.col("val") / (2 * F.col("h") * F.col("h")))).alias("y"))
    y = rows.select("obs_id", F.when(F.col("fold") == train, 0).otherwise(1).alias("fold")).join(phi, "obs_id").withColumn("y", F.round("y", 12))
    return mann_whitney(y).select((2 * F.col("share") - 1).alias("tpl"))


def knn_predict(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """obs_id, predicted: the commonest label among a row's neighbours, the smallest of ties."""
    v = neighbours.join(labels.withColumnsRenamed({"obs_id": "dst", "cls": "vote"}), "dst").groupBy("src", "vote").agg(F.count("*").alias("n"))
    return v.groupBy(F.col("src").alias("obs_id")).agg(F.max_by(F.col("vote"), F.struct("n", -F.col("vote"))).alias("predicted"))
