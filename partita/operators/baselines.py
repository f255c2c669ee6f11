"""Baseline splitters: each gives ``df`` (obs_id, ...) a fold, 0 for training and 1 for test, by a rule of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut_lineage, small
from ..functions.prefix import running_sums
from ..functions.rng import hash_int
from ..functions.vectors import sqdist
from .similarity import nearest


def _rank_cut(df: DataFrame, by: Column, share: float) -> DataFrame:
    """Fold 0 for the first round(share n) rows by ``by``, then obs_id: ranks come from running sums, not one task."""
    d = df.withColumns({"_by": by.cast("double"), "_one": F.lit(1)})
    d = running_sums(d, "_by", {"_rank": "_one"}, ties=("obs_id",))
    n = df.agg(F.floor(F.lit(share) * F.count("*") + 0.5).alias("_n"))
    return d.join(F.broadcast(n)).select(*df.columns, F.when(F.col("_rank") <= F.col("_n"), 0).otherwise(1).alias("fold"))


def random(df: DataFrame, share: float = 0.8, seed: int = 42) -> DataFrame:
    return _rank_cut(df, hash_int(F.col("obs_id"), seed), share)


def ordered(df: DataFrame, by: Column, share: float = 0.8) -> DataFrame:
    """The first rows by an expression train: sorted values, weights, projections, distances."""
    return _rank_cut(df, by, share)


def stratified(df: DataFrame, *by: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """The same share of each stratum, of hashed rows; nulls are a stratum. Strata are split over ranges of the hash."""
    d = df.withColumn("_h", hash_int(F.col("obs_id"), seed))
    d = d.withColumns({"_key": F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in by)), "_one": F.lit(1)})
    d = running_sums(d, "_h", {"_rank": "_one"}, keys=("_key",), ties=("obs_id",))
    n = d.groupBy("_key").agg(F.floor(F.lit(share) * F.count("*") + 0.5).alias("_n"))
    return d.join(n, "_key").select(*df.columns, F.when(F.col("_rank") <= F.col("_n"), 0).otherwise(1).alias("fold"))


def kfold(df: DataFrame, by: str, k: int = 5, seed: int = 42) -> DataFrame:
    """fold 0 .. k-1, dealt in turn to each class's hashed rows."""
    d = df.withColumns({"_h": hash_int(F.col("obs_id"), seed), "_one": F.lit(1), "_key": F.coalesce(F.col(by).cast("string"), F.lit("?"))})
    d = running_sums(d, "_h", {"_rank": "_one"}, keys=("_key",), ties=("obs_id",))
    return d.select(*df.columns, ((F.col("_rank") - 1) % k).cast("int").alias("fold"))


def group_stop(df: DataFrame, group: str, share: float = 0.8, order: str = "size", seed: int = 42) -> DataFrame:
    """Whole groups, largest first (``size``) or in hashed order, train until the first that would exceed the share."""
    g = df.groupBy(group).agg(F.count("*").alias("_n"))
    by = -F.col("_n") if order == "size" else hash_int(F.col(group), seed)
    g = running_sums(g.withColumn("_by", by.cast("double")), "_by", {"_c": "_n"}, ties=(group,))
    n = df.agg((F.lit(share) * F.count("*")).alias("_most"))
    g = g.join(F.broadcast(n)).select(F.col(group).alias("_g"), F.when(F.col("_c") <= F.col("_most"), 0).otherwise(1).alias("fold"))
    return df.drop("fold").join(g, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def group_skip(df: DataFrame, group: str, share: float = 0.8) -> DataFrame:
    """First-fit-decreasing: whole groups, largest first, then by name, train if they still fit.

    Of groups of one size the first ones fit until one does not, so the sequential part runs over the distinct sizes with
    their counts, of which n rows have at most sqrt(2 n), and groups are then ranked within their size.
    """
    g = cut_lineage(df.groupBy(group).agg(F.count("*").alias("_n")).withColumn("_name", F.coalesce(F.col(group).cast("string"), F.lit("None"))))
    sizes = sorted(((x["_n"], x.k) for x in g.groupBy("_n").agg(F.count("*").alias("k")).collect()), reverse=True)
    most, have, fits = share * sum(n * k for n, k in sizes), 0, []
    for n, k in sizes:
        some = min(k, int((most - have) // n))
        have += n * some
        fits.append((n, some))
    g = running_sums(g.withColumn("_one", F.lit(1)), "_name", {"_rank": "_one"}, keys=("_n",), ties=(group,))
    t = g.join(F.broadcast(df.sparkSession.createDataFrame(fits, "_n long, _fits long")), "_n").select(F.col(group).alias("_g"), F.when(F.col("_rank") <= F.col("_fits"), 0).otherwise(1).alias("fold"))
    return df.drop("fold").join(small(t), F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def largest_cluster(df: DataFrame, cluster: str) -> DataFrame:
    """The largest cluster trains, the smallest name of ties; all else is test."""
    top = df.groupBy(cluster).agg(F.count("*").alias("n")).agg(F.min_by(F.col(cluster), F.struct(-F.col("n"), F.col(cluster))).alias("_top"))
    return df.join(F.broadcast(top)).select(*(c for c in df.columns if c != "fold"), F.when(F.col(cluster) == F.col("_top"), 0).otherwise(1).alias("fold"))


def precomputed(df: DataFrame, split: str, codes: dict[str, int]) -> DataFrame:
    """Folds of an external split; names without a code, and nulls, are left out."""
    m = F.create_map(*(F.lit(x) for kv in codes.items() for x in kv))
    return df.withColumn("fold", m[F.col(split)].cast("int")).where("fold is not null")


def centroid_distance(df: DataFrame, x: str = "x") -> DataFrame:
    """``df`` with _far, the squared distance to the mean vector, which is one row, broadcast."""
    axes = df.select(F.posexplode(x).alias("axis", "v")).groupBy("axis").agg(F.avg("v").alias("m"))
    mean = axes.agg(F.transform(F.array_sort(F.collect_list(F.struct("axis", "m"))), lambda s: s["m"]).alias("_mean"))
    return df.join(F.broadcast(mean)).withColumn("_far", sqdist(F.col(x), F.col("_mean"))).drop("_mean")


def farthest(df: DataFrame, share: float = 0.8) -> DataFrame:
    """Rows farthest from the mean vector are test."""
    d = centroid_distance(df).withColumn("_far", F.round("_far", 9))
    return _rank_cut(d, F.col("_far"), share).drop("_far")


def first_component(df: DataFrame, share: float = 0.8, x: str = "x") -> DataFrame:
    """Rows with the largest projections on the first principal axis are test. The covariance, of the vectors' few
    dimensions, is summed by the cluster; its axis is found on the driver."""
    import numpy as np
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    m = PCA(k=1, inputCol="_v", outputCol="_p").fit(df.select(array_to_vector(x).alias("_v")))
    axis = m.pc.toArray()[:, 0]
    if axis[int(np.abs(axis).argmax())] < 0:
        axis = -axis
    d = m.transform(df.withColumn("_v", array_to_vector(x)))
    sign = 1.0 if np.allclose(axis, m.pc.toArray()[:, 0]) else -1.0
    d = d.withColumn("_s", sign * vector_to_array("_p")[0]).drop("_v", "_p")
    return _rank_cut(d, F.col("_s"), share).drop("_s")


def leaders(df: DataFrame, threshold: float, metric: str = "cosine") -> DataFrame:
    """obs_id, leader by sphere exclusion: in rounds, each not yet covered row that no uncovered row of smaller hash is
    similar to becomes a leader and covers the rows similar to it. All leaders of a round are found at once, and each round
    covers at least the uncovered row of smallest hash, so rounds go on until every row has a leader."""
    from .similarity import edges_within

    e = cut_lineage(edges_within(df, metric, threshold))
    left = cut_lineage(df.select("obs_id", hash_int(F.col("obs_id"), 7).alias("h")))
    done = None
    while True:
        a, b = left.withColumnsRenamed({"obs_id": "src", "h": "hs"}), left.withColumnsRenamed({"obs_id": "dst", "h": "hd"})
        near = e.join(a, "src").join(b, "dst")
        beaten = near.where((F.col("hd") < F.col("hs")) | ((F.col("hd") == F.col("hs")) & (F.col("dst") < F.col("src")))).select(F.col("src").alias("obs_id")).distinct()
        lead = left.join(beaten, "obs_id", "left_anti").select("obs_id")
        own = lead.select("obs_id", F.col("obs_id").alias("leader"))
        covered = near.join(lead.withColumnRenamed("obs_id", "dst"), "dst", "left_semi").groupBy(F.col("src").alias("obs_id")).agg(F.min(F.struct("hd", "dst")).alias("m")).select("obs_id", F.col("m.dst").alias("leader"))
        new = cut_lineage(own.unionByName(covered))
        done = new if done is None else done.unionByName(new)
        left = cut_lineage(left.join(new, "obs_id", "left_anti"))
        if left.isEmpty():
            return done


def maxmin(df: DataFrame, n: int, metric: str = "sqdist") -> DataFrame:
    """obs_id, step: n rows picked one after another, each the farthest from those picked; starts at the smallest obs_id.
    Every round updates running minima by one broadcast vector; n is a number of picks, not of rows."""
    cur = df.select("obs_id", "x", F.lit(1e300).alias("_m"))
    last = cur.orderBy("obs_id").limit(1).collect()
    out = []
    for step in range(n):
        if not last:
            break
        out.append((last[0].obs_id, step))
        x = F.array(*map(F.lit, last[0].x))
        cur = cur.where(F.col("obs_id") != last[0].obs_id).select("obs_id", "x", F.least("_m", F.round(sqdist(F.col("x"), x), 9)).alias("_m"))
        if step % 8 == 7:
            cur = cut_lineage(cur)
        last = cur.orderBy(F.desc("_m"), "obs_id").limit(1).collect()
    return df.sparkSession.createDataFrame(out, "obs_id long, step int")


def kmeans_pack(df: DataFrame, k: int = 10, share: float = 0.8, seed: int = 1) -> DataFrame:
    """Whole k-means clusters, packed first-fit-decreasing."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    d = df.withColumn("_v", array_to_vector("x"))
    return group_skip(KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="_cluster").fit(d).transform(d).drop("_v"), "_cluster", share).drop("_cluster")


def agglomerative_pack(df: DataFrame, k: int = 10, share: float = 0.8, seed: int = 1) -> DataFrame:
    """Whole clusters of a bisecting tree, packed likewise; divisive, as merging all rows does not distribute."""
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.functions import array_to_vector

    d = df.withColumn("_v", array_to_vector("x"))
    return group_skip(BisectingKMeans(k=k, seed=seed, featuresCol="_v", predictionCol="_cluster").fit(d).transform(d).drop("_v"), "_cluster", share).drop("_cluster")


def nearest_cluster(df: DataFrame, labelled: DataFrame) -> DataFrame:
    """obs_id, cluster of rows, each by its nearest labelled one (obs_id, x, cluster)."""
    hit = nearest(df, labelled, 1)
    return hit.join(labelled.select(F.col("obs_id").alias("dst"), "cluster"), "dst").select(F.col("src").alias("obs_id"), "cluster")
