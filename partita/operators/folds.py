"""Aggregations over fold assignments. Inputs have ``fold`` and, unless told otherwise, ``w`` (weight), ``cls`` and ``obs_id``.

All are group-bys with partial aggregation; what is joined back has a row per fold, class or group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold_sizes(df: DataFrame) -> DataFrame:
    """fold, n, mass."""
    return df.groupBy("fold").agg(F.count("*").alias("n"), F.sum("w").alias("mass"))


def target_share(r: Sequence[float]) -> Column:
    """The target share of the row's fold."""
    return F.element_at(F.array(*map(F.lit, map(float, r))), F.col("fold") + 1)


def balance_residual(df: DataFrame, r: Sequence[float]) -> DataFrame:
    """fold, mass and residual (mass less its target); a fold without rows has no row."""
    every = Window.partitionBy()
    return fold_sizes(df).select("fold", "mass", (F.col("mass") - target_share(r) * F.sum("mass").over(every)).alias("residual"))


def class_fold_tally(df: DataFrame, k: int = 2) -> DataFrame:
    """cls, fold, mass over the full grid of classes and folds (0 where empty); null classes are left out."""
    d = df.where("cls is not null")
    grid = d.select("cls").distinct().select("cls", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold"))
    return grid.join(d.groupBy("cls", "fold").agg(F.sum("w").alias("mass")), ["cls", "fold"], "left").select("cls", "fold", F.coalesce("mass", F.lit(0.0)).alias("mass"))


def class_max_violation(df: DataFrame, r: Sequence[float]) -> DataFrame:
    """One row, violation: the largest share of a class's mass by which a fold misses its target (null without classes)."""
    of_class = F.sum("mass").over(Window.partitionBy("cls"))
    t = class_fold_tally(df, len(r)).withColumn("of_class", of_class).where("of_class > 0")
    return t.agg(F.max(F.abs(F.col("mass") - target_share(r) * F.col("of_class")) / F.col("of_class")).alias("violation"))


def group_integrity(members: DataFrame) -> DataFrame:
    """level, groups, split, intact_mass, mass from rows of level, group_id, fold, w; level null is the total over levels.

    A group is intact if all its rows are in one fold.
    """
    g = members.groupBy("level", "group_id").agg(F.countDistinct("fold").alias("folds"), F.sum("w").alias("mass"))
    return g.rollup("level").agg(
        F.count("*").alias("groups"), F.sum((F.col("folds") > 1).cast("long")).alias("split"),
        F.sum(F.when(F.col("folds") == 1, F.col("mass")).otherwise(0.0)).alias("intact_mass"), F.sum("mass").alias("mass"),
    )


def minority_mass(members: DataFrame) -> DataFrame:
    """level, minority: the mass outside each group's largest fold, summed over groups."""
    f = members.groupBy("level", "group_id", "fold").agg(F.sum("w").alias("m"))
    g = f.groupBy("level", "group_id").agg((F.sum("m") - F.max("m")).alias("minority"))
    return g.groupBy("level").agg(F.sum("minority").alias("minority"))


def majority_fold(df: DataFrame, entity: str) -> DataFrame:
    """entity, fold: the fold with the entity's largest mass, the lower one of ties; null entities are free and left out."""
    f = df.where(F.col(entity).isNotNull()).groupBy(entity, "fold").agg(F.sum("w").alias("m"))
    return f.groupBy(entity).agg(F.max_by(F.col("fold"), F.struct("m", -F.col("fold"))).alias("fold"))


def entity_repair(df: DataFrame, entity: str) -> DataFrame:
    """``df`` with each row moved to its entity's majority fold; rows without entity stay."""
    best = majority_fold(df, entity).withColumnRenamed("fold", "_best")
    return df.join(best, entity, "left").select(*(F.coalesce("_best", "fold").alias("fold") if c == "fold" else c for c in df.columns))


def entity_straddle(df: DataFrame, entity: str) -> DataFrame:
    """One row: entities, and how many of them have rows in several folds."""
    g = df.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.countDistinct("fold").alias("folds"))
    return g.agg(F.count("*").alias("entities"), F.coalesce(F.sum((F.col("folds") > 1).cast("long")), F.lit(0)).alias("straddling"))


def entity_degrees(df: DataFrame, entity: str) -> DataFrame:
    """One row: entities and the mean, least and largest number of rows of one."""
    return df.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.count("*").alias("d")).agg(F.count("*").alias("entities"), F.avg("d").alias("mean_degree"), F.min("d").alias("min_degree"), F.max("d").alias("max_degree"))


def compound_groups(df: DataFrame, left: str = "left_id", right: str = "right_id") -> DataFrame:
    """left, right, n, mass: the cells that a constraint on both entities keeps whole."""
    return df.groupBy(left, right).agg(F.count("*").alias("n"), F.sum("w").alias("mass"))


def discard_report(pairs: DataFrame, left_folds: DataFrame, right_folds: DataFrame) -> DataFrame:
    """kept, n, mass: pairs whose two entities lie in one fold are kept, others are discarded.

    ``left_folds`` has left_id and fold, ``right_folds`` right_id and fold; pairs without a fold on a side drop out.
    """
    j = pairs.join(left_folds.withColumnRenamed("fold", "lf"), "left_id").join(right_folds.withColumnRenamed("fold", "rf"), "right_id")
    return j.groupBy((F.col("lf") == F.col("rf")).alias("kept")).agg(F.count("*").alias("n"), F.sum("w").alias("mass"))


def weighted_discard(pairs: DataFrame, left_folds: DataFrame, right_folds: DataFrame) -> DataFrame:
    """One row: the shares of pairs and of mass that :func:`discard_report` discards."""
    out = F.when(~F.col("kept"), F.lit(1.0)).otherwise(0.0)
    return discard_report(pairs, left_folds, right_folds).agg((F.sum(out * F.col("n")) / F.sum("n")).alias("pair_fraction"), (F.sum(out * F.col("mass")) / F.sum("mass")).alias("mass_fraction"))


def pair_fold_stats(df: DataFrame) -> DataFrame:
    """fold, n, mean and sample deviation of y (0 for a single row)."""
    return df.groupBy("fold").agg(F.count("*").alias("n"), F.avg("y").alias("mean"), F.coalesce(F.stddev_samp("y"), F.lit(0.0)).alias("std"))


def mutual_information(df: DataFrame, label: str) -> DataFrame:
    """One row, mi: mutual information of fold and label in nats, by counts; rows with a null label are left out."""
    j = df.where(F.col(label).isNotNull()).groupBy("fold", label).agg(F.count("*").cast("double").alias("n"))
    j = j.withColumns({"nf": F.sum("n").over(Window.partitionBy("fold")), "nl": F.sum("n").over(Window.partitionBy(label)), "all": F.sum("n").over(Window.partitionBy())})
    return j.agg(F.coalesce(F.sum(F.col("n") / F.col("all") * F.log(F.col("n") * F.col("all") / (F.col("nf") * F.col("nl")))), F.lit(0.0)).alias("mi"))


def equal_width_bin(df: DataFrame, y: str, bins: int, out: str = "bin") -> DataFrame:
    """``df`` with the number, from 0, of y's bin of equal width over its range, the range widened by 1e-6 on both ends."""
    ends = df.agg(F.min(y).alias("_lo"), F.max(y).alias("_hi"))
    d = df.join(F.broadcast(ends))
    lo, hi = F.col("_lo") - 1e-6, F.col("_hi") + 1e-6
    return d.withColumn(out, F.least(F.floor((F.col(y) - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")).drop("_lo", "_hi")


def mutual_information_continuous(df: DataFrame, y: str = "y", bins: int = 32) -> DataFrame:
    return mutual_information(equal_width_bin(df, y, bins, "_bin"), "_bin")


def class_retention(df: DataFrame, label: str, min_support: int = 5) -> DataFrame:
    """fold, rate and deviation: how far a 0/1 label's rate in a fold is from the rate over all rows; folds with fewer
    labelled rows than ``min_support`` are left out."""
    g = df.where(F.col(label).isNotNull()).groupBy("fold").agg(F.sum(F.col(label).cast("double")).alias("s"), F.count("*").alias("n"))
    every = Window.partitionBy()
    rate = F.col("s") / F.col("n")
    return g.select("fold", "n", rate.alias("rate"), F.abs(rate - F.sum("s").over(every) / F.sum("n").over(every)).alias("deviation")).where(F.col("n") >= min_support).drop("n")


def eta_squared(df: DataFrame, group: str, y: str = "y") -> DataFrame:
    """One row, eta2: the share of y's variance that lies between groups."""
    g = df.groupBy(group).agg(F.count(y).alias("n"), F.avg(y).alias("m"), F.var_pop(y).alias("v"))
    s = g.agg(F.sum(F.col("n") * F.col("v")).alias("within"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("s1"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("s2"))
    between = F.col("s2") - F.col("s1") * F.col("s1") / F.col("n")
    return s.select((between / (between + F.col("within"))).alias("eta2"))


def hamming(assignments: DataFrame) -> DataFrame:
    """config_a, config_b, distance: the share of observations that two assignments (config_id, obs_id, fold) place
    differently, for each pair of configurations. Each observation's few configurations are paired, not rows."""
    per = assignments.groupBy("obs_id").agg(F.collect_list(F.struct("config_id", "fold")).alias("s"))
    one = per.select("s", F.explode("s").alias("a")).select("a", F.explode("s").alias("b")).where("a.config_id < b.config_id")
    return one.groupBy(F.col("a.config_id").alias("config_a"), F.col("b.config_id").alias("config_b")).agg(F.avg((F.col("a.fold") != F.col("b.fold")).cast("double")).alias("distance"))


def fold_wide(assignments: DataFrame, configs: Sequence[str]) -> DataFrame:
    """obs_id and one fold column for each configuration."""
    return assignments.groupBy("obs_id").pivot("config_id", list(configs)).agg(F.first("fold"))


def mutual_information_targets(df: DataFrame, targets: Sequence[str], bins: int = 32) -> DataFrame:
    """One row, mi: the mean over several numeric targets of the information that the fold has on each."""
    every = None
    for y in targets:
        one = mutual_information_continuous(df.where(F.col(y).isNotNull()), y, bins)
        every = one if every is None else every.unionByName(one)
    return every.agg(F.avg("mi").alias("mi"))


def entropy(df: DataFrame, label: str) -> DataFrame:
    """One row, entropy in nats of the counts of a column's values, nulls left out; 0 without rows."""
    n = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").cast("double").alias("n"))
    return n.agg(F.coalesce(F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n"), F.lit(0.0)).alias("entropy"))


def stability(assignments: DataFrame, most: float = 0.25) -> DataFrame:
    """config_a, config_b, distance and unstable: whether two assignments place more than that share of rows differently."""
    return hamming(assignments).withColumn("unstable", F.col("distance") > most)


def entity_folds(assignments: DataFrame, obs: DataFrame, entity: str, configs: Sequence[str]) -> DataFrame:
    """The entity and, for each configuration of (config_id, obs_id, fold), the fold of most of its rows (the lowest of
    ties, -1 without rows); rows without an entity are left out."""
    j = assignments.join(obs.where(F.col(entity).isNotNull()).select("obs_id", entity), "obs_id")
    n = j.groupBy(entity, "config_id", "fold").agg(F.count("*").alias("n"))
    best = n.groupBy(entity, "config_id").agg(F.min_by("fold", F.struct(-F.col("n"), F.col("fold"))).alias("fold"))
    return best.groupBy(entity).pivot("config_id", list(configs)).agg(F.first("fold")).fillna(-1, subset=list(configs))
