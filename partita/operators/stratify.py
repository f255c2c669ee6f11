"""Target stratification: moments, quantile bins, distances between distributions, ranks and correlations.

Inputs have ``fold``, ``y`` and ``w``. Everything over a global order goes through running sums in value ranges, so no
task holds the order; ties are evaluated at their end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut_lineage
from ..functions.prefix import group_percentiles, next_value, percentiles, running_sums
from ..functions.rng import gaussian
from .folds import target_share



def moments(df: DataFrame) -> DataFrame:
    """fold, mass, mean and the weighted central moments m2, m3, m4 of y, in two passes."""
    means = df.groupBy("fold").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("mean"))
    c = F.col("y") - F.col("mean")
    return df.join(F.broadcast(means), "fold").groupBy("fold").agg(F.sum("w").alias("mass"), F.first("mean").alias("mean"), *((F.sum(F.col("w") * F.pow(c, F.lit(p))) / F.sum("w")).alias(f"m{p}") for p in (2, 3, 4)))


def overall_moments(df: DataFrame) -> DataFrame:
    """One row, like :func:`moments` over all rows."""
    return moments(df.withColumn("fold", F.lit(0))).drop("fold")


def moment_residual(df: DataFrame, omega: Sequence[float] = (1.0, 1.0, 1.0, 1.0)) -> DataFrame:
    """fold, residual: the omega-weighted sum of squared differences of a fold's four moments from those of all rows."""
    m = overall_moments(df).select(*(F.col(c).alias(f"_{c}") for c in ("mean", "m2", "m3", "m4")))
    terms = [F.lit(float(o)) * F.pow(F.col(c) - F.col(f"_{c}"), F.lit(2)) for o, c in zip(omega, ("mean", "m2", "m3", "m4"))]
    return moments(df).join(F.broadcast(m)).select("fold", sum(terms[1:], terms[0]).alias("residual"))


def moment_gradient(df: DataFrame, omega: Sequence[float] = (1.0, 0.0, 0.0, 0.0)) -> DataFrame:
    """obs_id, gradient of the omega-weighted squared residuals by the row's share in its fold; by default of the mean's
    alone, 2 (mean_k - mean) (y - mean_k) w / W_k. With c = y - mean_k the p-th central moment moves by
    (c**p - m_p - p m_(p-1) c) w / W_k."""
    names = ("mean", "m2", "m3", "m4")
    m = moments(df).select("fold", F.col("mass").alias("_W"), *(F.col(n).alias(f"_k_{n}") for n in names))
    every = overall_moments(df).select(*(F.col(n).alias(f"_a_{n}") for n in names))
    c, lower = F.col("y") - F.col("_k_mean"), {1: F.lit(1.0), 2: F.lit(0.0), 3: F.col("_k_m2"), 4: F.col("_k_m3")}
    parts = []
    for i, (n, o) in enumerate(zip(names, omega), 1):
        if o:
            step = c if i == 1 else F.pow(c, F.lit(i)) - F.col(f"_k_{n}") - i * lower[i] * c
            parts.append(2 * F.lit(float(o)) * (F.col(f"_k_{n}") - F.col(f"_a_{n}")) * step)
    return df.join(F.broadcast(m), "fold").join(F.broadcast(every)).select("obs_id", (sum(parts, F.lit(0.0)) * F.col("w") / F.col("_W")).alias("gradient"))


def moment_scale(df: DataFrame) -> DataFrame:
    """One row, scale: the sum over orders 1 to 4 of the second moment of (y - mean)**p about its mean."""
    mean = df.agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("_m"))
    c = F.col("y") - F.col("_m")
    agg = df.join(F.broadcast(mean)).agg(*(f for p in (1, 2, 3, 4) for f in ((F.sum(F.col("w") * F.pow(c, F.lit(p))) / F.sum("w")).alias(f"a{p}"), (F.sum(F.col("w") * F.pow(c, F.lit(2 * p))) / F.sum("w")).alias(f"b{p}"))))
    return agg.select(sum((F.col(f"b{p}") - F.col(f"a{p}") * F.col(f"a{p}") for p in (2, 3, 4)), F.col("b1") - F.col("a1") * F.col("a1")).alias("scale"))


def fourth_moment_error(df: DataFrame) -> DataFrame:
    """fold, se: the standard error of the fourth central moment, from the spread of (y - mean)**4."""
    means = df.groupBy("fold").agg(F.avg("y").alias("_m"))
    return df.join(F.broadcast(means), "fold").groupBy("fold").agg((F.stddev_pop(F.pow(F.col("y") - F.col("_m"), F.lit(4))) / F.sqrt(F.count("*"))).alias("se"))


def quantile_edges(df: DataFrame, bins: int, y: str = "y") -> DataFrame:
    """One row, edges: the inner quantiles, by linear interpolation."""
    return percentiles(df, y, [i / bins for i in range(1, bins)]).withColumnRenamed("q", "edges")


def quantile_bins(df: DataFrame, bins: int, y: str = "y", out: str = "bin") -> DataFrame:
    """``df`` with the number of quantile edges below y; null for a null y."""
    below = F.size(F.filter("edges", lambda e: e < F.col(y)))
    return df.join(F.broadcast(quantile_edges(df, bins, y))).withColumn(out, F.when(F.col(y).isNotNull(), below)).drop("edges")


def bin_tally(df: DataFrame, k: int = 2) -> DataFrame:
    """bin, fold, mass over the full grid, and total, the bin's mass."""
    t = df.groupBy("bin", "fold").agg(F.sum("w").alias("mass"))
    grid = t.select("bin").distinct().select("bin", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold"))
    t = grid.join(t, ["bin", "fold"], "left").select("bin", "fold", F.coalesce("mass", F.lit(0.0)).alias("mass"))
    return t.withColumn("total", F.sum("mass").over(Window.partitionBy("bin")))


def quantile_residual(df: DataFrame, r: Sequence[float]) -> DataFrame:
    """One row, residual: the squared differences of bin masses from their targets, summed over bins and folds."""
    d = F.col("mass") - target_share(r) * F.col("total")
    return bin_tally(df, len(r)).agg(F.sum(d * d).alias("residual"))


def quantile_gradient(df: DataFrame, r: Sequence[float]) -> DataFrame:
    """obs_id, fold, gradient 2 w (tally - target) for every row and fold."""
    t = bin_tally(df, len(r)).withColumn("_g", 2 * (F.col("mass") - target_share(r) * F.col("total"))).select("bin", "fold", "_g")
    return df.select("obs_id", "bin", "w").join(F.broadcast(t), "bin").select("obs_id", "fold", (F.col("w") * F.col("_g")).alias("gradient"))


def quantile_scale(df: DataFrame, r: Sequence[float]) -> DataFrame:
    """One row, scale: the residual's largest possible value."""
    most = 1 - 2 * min(r) + sum(x * x for x in r)
    t = df.groupBy("bin").agg(F.sum("w").alias("m"))
    return t.agg((F.sum(F.col("m") * F.col("m")) * F.lit(most)).alias("scale"))


def _steps(df: DataFrame, k: int, weights: bool = True) -> DataFrame:
    """One row per distinct y: mass in all (``a``) and per fold (``f0`` ...), with running sums ``ca``, ``c0`` ... and totals."""
    w = F.col("w") if weights else F.lit(1.0)
    s = df.where("y is not null").groupBy("y").agg(F.sum(w).alias("a"), *(F.sum(F.when(F.col("fold") == i, w).otherwise(0.0)).alias(f"f{i}") for i in range(k)))
    s = running_sums(s, "y", {"ca": "a"} | {f"c{i}": f"f{i}" for i in range(k)})
    t = s.agg(F.sum("a").alias("ta"), *(F.sum(f"f{i}").alias(f"t{i}") for i in range(k)))
    return s.join(F.broadcast(t))


def ks(df: DataFrame, k: int = 2) -> DataFrame:
    """fold, ks: the largest distance of a fold's weighted distribution function from that of all rows; 0 for folds with
    fewer than two rows."""
    s = _steps(df, k)
    far = s.agg(*(F.max(F.abs(F.col(f"c{i}") / F.nullif(F.col(f"t{i}"), F.lit(0.0)) - F.col("ca") / F.col("ta"))).alias(f"k{i}") for i in range(k)))
    rows = far.select(F.explode(F.array(*(F.struct(F.lit(i).alias("fold"), F.col(f"k{i}").alias("ks")) for i in range(k)))).alias("x")).select("x.*")
    n = df.groupBy("fold").agg(F.count("*").alias("n"))
    return rows.join(n, "fold", "left").select("fold", F.when(F.col("n") >= 2, F.col("ks")).otherwise(0.0).alias("ks"))


def anderson_darling(df: DataFrame, k: int = 2) -> DataFrame:
    """fold, ad: the mean over a fold's rows of (F_k - u)**2 / (u (1 - u)), u being the distribution function of all rows,
    kept within 1e-7 of 0 and 1."""
    s = _steps(df, k)
    u = F.greatest(F.least(F.col("ca") / F.col("ta"), F.lit(1 - 1e-7)), F.lit(1e-7))
    terms = [F.sum(F.col(f"f{i}") * F.pow(F.col(f"c{i}") / F.nullif(F.col(f"t{i}"), F.lit(0.0)) - u, F.lit(2)) / (u * (1 - u))) / F.max(f"t{i}") for i in range(k)]
    a = s.agg(*(t.alias(f"a{i}") for i, t in enumerate(terms)))
    return a.select(F.explode(F.array(*(F.struct(F.lit(i).alias("fold"), F.coalesce(F.col(f"a{i}"), F.lit(0.0)).alias("ad")) for i in range(k)))).alias("x")).select("x.*")


def wasserstein1(df: DataFrame) -> DataFrame:
    """One row, w1: the distance of the weighted distributions of y in folds 0 and 1."""
    d = next_value(cut_lineage(_steps(df, 2)), "y", "_next")
    gap = F.col("_next") - F.col("y")
    d = d.select((F.abs(F.col("c0") / F.col("t0") - F.col("c1") / F.col("t1")) * gap).alias("x"))
    return d.agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("w1"))


def weighted_quantile(df: DataFrame, levels: Sequence[float]) -> DataFrame:
    """level, value: the smallest y at which the running share of mass reaches the level."""
    s = _steps(df, 1).select("y", (F.col("ca") / F.col("ta")).alias("share"))
    out = s.agg(*(F.min(F.when(F.col("share") >= F.lit(float(q)) - 1e-12, F.col("y"))).alias(f"q{i}") for i, q in enumerate(levels)))
    return out.select(F.explode(F.array(*(F.struct(F.lit(float(q)).alias("level"), F.col(f"q{i}").alias("value")) for i, q in enumerate(levels)))).alias("x")).select("x.*")


def qq_table(df: DataFrame, points: int = 100) -> DataFrame:
    """level, q0, q1: quantiles of y in folds 0 and 1, by linear interpolation."""
    a, b = (percentiles(df.where(F.col("fold") == i), "y", [i / points for i in range(points + 1)]).withColumnRenamed("q", n) for i, n in ((0, "a"), (1, "b")))
    return a.join(F.broadcast(b)).select(F.posexplode("a").alias("i", "q0"), "b").select((F.col("i") / points).alias("level"), "q0", F.col("b")[F.col("i")].alias("q1"))


def average_rank(df: DataFrame, y: str = "y", out: str = "rank") -> DataFrame:
    """``df`` with y's rank from 1, the mean rank for ties: ranks are found per distinct value, then joined."""
    v = df.where(F.col(y).isNotNull()).groupBy(F.col(y).alias("_v")).agg(F.count("*").cast("double").alias("_n"))
    v = running_sums(v, "_v", {"_c": "_n"}).select("_v", (F.col("_c") - (F.col("_n") - 1) / 2).alias(out))
    return df.join(v, F.col(y) == F.col("_v"), "left").drop("_v")


def weighted_pearson(df: DataFrame, a: str, b: str, w: str = "w") -> Column:
    """Aggregate expression: the weighted population correlation of two columns, from centred columns ``a`` and ``b``."""
    x, y, m = F.col(a), F.col(b), F.sum(w)
    mx, my = F.sum(F.col(w) * x) / m, F.sum(F.col(w) * y) / m
    return (F.sum(F.col(w) * x * y) / m - mx * my) / F.sqrt((F.sum(F.col(w) * x * x) / m - mx * mx) * (F.sum(F.col(w) * y * y) / m - my * my))


def spearman_deviation(df: DataFrame, a: str, b: str) -> DataFrame:
    """fold, rho, deviation: a fold's weighted rank correlation of two columns (ranks over all rows) and how far it is
    from that of all rows."""
    r = average_rank(average_rank(df, a, "_ra"), b, "_rb")
    n = df.agg((F.count("*") / 2).alias("_c"))
    r = r.join(F.broadcast(n)).withColumns({"_ra": F.col("_ra") - F.col("_c"), "_rb": F.col("_rb") - F.col("_c")})
    every = r.agg(weighted_pearson(r, "_ra", "_rb").alias("_all"))
    return r.groupBy("fold").agg(weighted_pearson(r, "_ra", "_rb").alias("rho")).join(F.broadcast(every)).select("fold", "rho", F.abs(F.col("rho") - F.col("_all")).alias("deviation"))


def mann_whitney(df: DataFrame, y: str = "y") -> DataFrame:
    """One row, u and share: pairs (row of fold 0, row of fold 1) in which fold 0's y is larger, ties counting a half."""
    g = average_rank(df, y, "_r").agg(F.sum(F.when(F.col("fold") == 0, F.col("_r"))).alias("r0"), F.sum((F.col("fold") == 0).cast("double")).alias("n0"), F.sum((F.col("fold") == 1).cast("double")).alias("n1"))
    u = F.col("r0") - F.col("n0") * (F.col("n0") + 1) / 2
    return g.select(u.alias("u"), (u / (F.col("n0") * F.col("n1"))).alias("share"))


def _projected(df: DataFrame, projections: int, seed: int, x: str, *columns: str) -> DataFrame:
    """``columns``, p and v: each row on each of a few random unit directions, which come from the portable hash."""
    from ..functions.vectors import dot

    axes = df.select(F.posexplode(x).alias("axis", "v")).select("axis").distinct()
    dirs = axes.select("axis", F.explode(F.sequence(F.lit(0), F.lit(projections - 1))).alias("p"))
    dirs = dirs.withColumn("g", gaussian(F.col("p") * 100003 + F.col("axis"), seed))
    dirs = dirs.withColumn("g", F.col("g") / F.sqrt(F.sum(F.col("g") * F.col("g")).over(Window.partitionBy("p"))))
    flat = dirs.groupBy("p").agg(F.transform(F.array_sort(F.collect_list(F.struct("axis", "g"))), lambda s: s["g"]).alias("_d"))
    return df.select(*columns, x).join(F.broadcast(flat)).select(*columns, "p", dot(F.col(x), F.col("_d")).alias("v"))


def sliced_wasserstein2(df: DataFrame, projections: int = 8, grid: int = 64, seed: int = 5, x: str = "x", k: int = 2) -> DataFrame:
    """fold, sw2, se: the mean over random directions of the squared quantile differences between a fold's projections and
    those of all rows, and its Monte-Carlo error."""
    rows = _projected(df, projections, seed, x, "fold")
    levels = [(i + 0.5) / grid for i in range(grid)]
    every = group_percentiles(rows, ["p"], "v", levels).withColumnRenamed("q", "qa")
    each = group_percentiles(rows, ["p", "fold"], "v", levels)
    gap = F.aggregate(F.zip_with("q", "qa", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v) / grid
    return each.join(every, "p").select("fold", gap.alias("d")).groupBy("fold").agg(F.avg("d").alias("sw2"), (F.coalesce(F.stddev_samp("d"), F.lit(0.0)) / F.sqrt(F.count("*"))).alias("se"))


def sliced_gradient(df: DataFrame, projections: int = 8, grid: int = 64, seed: int = 5, x: str = "x") -> DataFrame:
    """obs_id, fold, gradient for each fold that has rows: w / W of the fold times the mean over directions of the squared
    distance from the row's projection to the value that all rows have at the row's level in the fold.

    The level is the number of the fold's grid quantiles not above the projection; the quantiles are a row of ``grid``
    numbers a direction and fold, which is what is broadcast."""
    rows = _projected(df, projections, seed, x, "obs_id", "w", "fold")
    levels = [(i + 0.5) / grid for i in range(grid)]
    every = group_percentiles(rows, ["p"], "v", levels).withColumnRenamed("q", "_qa")
    each = group_percentiles(rows, ["p", "fold"], "v", levels).join(every, "p").select("p", F.col("fold").alias("_f"), F.col("q").alias("_q"), "_qa")
    mass = df.groupBy(F.col("fold").alias("_f")).agg(F.sum("w").alias("_W"))
    at = F.least(F.greatest(F.size(F.filter("_q", lambda q: q <= F.col("v"))), F.lit(1)), F.lit(grid))
    gap = F.col("v") - F.element_at("_qa", at)
    d = rows.drop("fold").join(F.broadcast(each.join(mass, "_f")), "p")
    return d.groupBy("obs_id", F.col("_f").alias("fold")).agg((F.avg(gap * gap) * F.first(F.col("w") / F.col("_W"))).alias("gradient"))


def sliced_scale(df: DataFrame, k: int = 2, x: str = "x") -> DataFrame:
    """One row, scale: k times the trace of the weighted covariance of a vector column, which the sliced term is held against."""
    axes = df.select("w", F.posexplode(x).alias("axis", "v"))
    mean = axes.groupBy("axis").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("_m"))
    gap = F.col("v") - F.col("_m")
    var = axes.join(F.broadcast(mean), "axis").groupBy("axis").agg((F.sum(F.col("w") * gap * gap) / F.sum("w")).alias("var"))
    return var.agg((k * F.sum("var")).alias("scale"))


def pearson_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b, r: weighted population correlations of each two columns (a before b in ``columns``), in one pass over centred
    values; rows with a null in any of them are left out, and r is null where a column is constant."""
    d = df.dropna(subset=list(columns))
    mean = d.agg(*((F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(f"_m_{c}") for c in columns))
    d = d.join(F.broadcast(mean)).select("w", *((F.col(c) - F.col(f"_m_{c}")).alias(c) for c in columns))
    two = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    s = d.agg(*(F.sum(F.col("w") * F.col(a) * F.col(b)).alias(f"_{a}_{b}") for a, b in two))
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.col(f"_{a}_{b}") / F.nullif(F.sqrt(F.col(f"_{a}_{a}") * F.col(f"_{b}_{b}")), F.lit(0.0))).alias("r")) for a, b in two if a != b]
    return s.select(F.inline(F.array(*cells)))
