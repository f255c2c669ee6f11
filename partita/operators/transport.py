"""Distribution terms: mean discrepancy of folds under a kernel, and entropic optimal transport to target marginals."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut_lineage
from ..functions.vectors import logsumexp, total
from .graph import with_folds
from .similarity import Kernel


def _shares(assign: DataFrame) -> DataFrame:
    """obs_id, fold, u: rows' shares of their fold's mass."""
    mass = assign.groupBy("fold").agg(F.sum("w").alias("_W"))
    return assign.join(F.broadcast(mass), "fold").select("obs_id", "fold", (F.col("w") / F.col("_W")).alias("u"))


def _products(kernel: Kernel, assign: DataFrame) -> tuple[DataFrame, list]:
    """The kernel's products with the shares of each fold's rows, and the folds in the order of s."""
    u = _shares(assign)
    names = sorted(r.fold for r in u.select("fold").distinct().collect())
    return kernel.products(u, names), names


def mmd_pairs(kernel: DataFrame | Kernel, assign: DataFrame) -> DataFrame:
    """fold_a, fold_b, mmd2: squared mean discrepancy of each pair of folds from a kernel or its edges (diagonal included);
    rows weigh w over their fold's mass. Never below 0."""
    if isinstance(kernel, Kernel):
        k, names = _products(kernel, assign)
        pair = F.array(*(F.struct(F.lit(f).alias("fold_dst"), (F.col("u") * F.col("s")[i]).alias("c")) for i, f in enumerate(names)))
        m = cut_lineage(k.select(F.col("fold").alias("fold_src"), F.explode(pair).alias("r")).groupBy("fold_src", "r.fold_dst").agg(F.sum("r.c").alias("c"))) if names else None
        if m is None:
            return assign.sparkSession.createDataFrame([], "fold_a int, fold_b int, mmd2 double")
        return _discrepancies(m)
    u = _shares(assign).select("obs_id", "u")
    j = with_folds(kernel, assign).join(u.withColumnsRenamed({"obs_id": "src", "u": "us"}), "src").join(u.withColumnsRenamed({"obs_id": "dst", "u": "ud"}), "dst")
    return _discrepancies(j.groupBy("fold_src", "fold_dst").agg(F.sum(F.col("us") * F.col("ud") * F.col("val")).alias("c")))


def _discrepancies(m: DataFrame) -> DataFrame:
    own = m.where("fold_src = fold_dst").select("fold_src", F.col("c").alias("d"))
    cross = m.where("fold_src < fold_dst").withColumnsRenamed({"fold_src": "fold_a", "fold_dst": "fold_b"})
    x = cross.join(own.withColumnsRenamed({"fold_src": "fold_a", "d": "da"}), "fold_a").join(own.withColumnsRenamed({"fold_src": "fold_b", "d": "db"}), "fold_b")
    return x.select("fold_a", "fold_b", F.greatest(F.col("da") + F.col("db") - 2 * F.col("c"), F.lit(0.0)).alias("mmd2"))


def mmd_gradient(kernel: DataFrame | Kernel, assign: DataFrame) -> DataFrame:
    """obs_id, gradient of minus the two folds' squared discrepancy by a row's place in its own fold:
    -2 w / W_k ((K u_k)_i - (K u_k')_i)."""
    if isinstance(kernel, Kernel):
        k, names = _products(kernel, assign)
        if not names:
            return assign.sparkSession.createDataFrame([], "obs_id long, gradient double")
        own = F.element_at("s", F.array_position(F.array(*map(F.lit, names)), F.col("fold")).cast("int"))
        return k.select("obs_id", (-2 * F.col("u") * (2 * own - total(F.col("s")))).alias("gradient"))
    u = _shares(assign).select("obs_id", "u")
    j = with_folds(kernel, assign).join(u.withColumnsRenamed({"obs_id": "dst", "u": "ud"}), "dst")
    side = F.when(F.col("fold_src") == F.col("fold_dst"), 1.0).otherwise(-1.0)
    g = j.groupBy(F.col("src").alias("obs_id")).agg(F.sum(side * F.col("val") * F.col("ud")).alias("g"))
    return g.join(u, "obs_id").select("obs_id", (-2 * F.col("u") * F.col("g")).alias("gradient"))


def mmd_scales(kernel: DataFrame | Kernel) -> DataFrame:
    """One row of reference scales: worst (the largest diagonal less the smallest entry, twice) and average."""
    if isinstance(kernel, Kernel):
        mean = lambda s, n: F.col(s) / F.nullif(F.col(n), F.lit(0))
        return kernel.scales().select((2 * (F.col("top") - F.col("least"))).alias("worst"), (2 * (mean("diag", "nd") - mean("every", "n"))).alias("average"))
    diag, every = F.when(F.col("src") == F.col("dst"), F.col("val")), F.col("val")
    return kernel.agg((2 * (F.max(diag) - F.min(every))).alias("worst"), (2 * (F.avg(diag) - F.avg(every))).alias("average"))


def bin_costs(df: DataFrame, centres: Sequence[float], y: str = "y") -> DataFrame:
    """``df`` with c, the distances of y to a few bin centres over the largest such distance: a small support for costs."""
    raw = F.array(*(F.abs(F.col(y) - F.lit(float(m))) for m in centres))
    d = df.withColumn("_c", raw)
    most = d.agg(F.max(F.array_max("_c")).alias("_most"))
    return d.join(F.broadcast(most)).withColumn("c", F.transform("_c", lambda v: v / F.col("_most"))).drop("_c", "_most")


def _duals(df: DataFrame, targets: Sequence[Sequence[float]], eps: float, rounds: int, tol: float) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """Rows with mass, written once (fold, a, c and their own columns), and each fold's column duals.

    One aggregate a round serves all folds: with the rows' duals set, plan entries exp((f + g - c) / eps) sum to a within a
    row, so a column's mass P needs no maximum first, and its dual moves by eps log(b / P). Only a column whose mass would
    vanish in double precision asks for a maximum. The driver holds one number per fold and column. A fold is done when
    none of its duals moves by more than ``tol``.
    """
    b = [np.array(t, float) / sum(t) for t in targets]
    m = len(b[0])
    mass = df.groupBy("fold").agg(F.sum("w").alias("_W"))
    rows = df.join(F.broadcast(mass), "fold").withColumn("a", F.col("w") / F.col("_W")).where((F.col("a") > 0) & F.col("fold").between(0, len(b) - 1)).drop("_W")
    rows = cut_lineage(rows)
    g = {r.fold: np.zeros(m) for r in rows.select("fold").distinct().collect()}
    open_ = set(g)
    for _ in range(rounds):
        if not open_:
            break
        d = _with_dual(rows.where(F.col("fold").isin(sorted(open_))), g, eps)
        z = [(F.col("f") + F.element_at("g", j + 1) - F.element_at("c", j + 1)) / eps for j in range(m)]
        for x in d.groupBy("fold").agg(*(F.sum(F.exp(v)).alias(f"s{j}") for j, v in enumerate(z)), *(F.max(v).alias(f"t{j}") for j, v in enumerate(z))).collect():
            log_mass = np.array([np.log(x[f"s{j}"]) if x[f"s{j}"] > 1e-290 else x[f"t{j}"] for j in range(m)])
            step = eps * (np.log(np.maximum(b[x.fold], 1e-300)) - log_mass)
            g[x.fold] = g[x.fold] + step
            if np.abs(step).max() < tol:
                open_.discard(x.fold)
    return rows, g


def _with_dual(rows: DataFrame, g: dict[int, np.ndarray], eps: float) -> DataFrame:
    """``rows`` with g (their fold's column duals) and f, the row dual that gives the row its mass."""
    if not g:
        return rows.withColumns({"g": F.lit(None).cast("array<double>"), "f": F.lit(None).cast("double")})
    duals = F.create_map(*(x for k, v in sorted(g.items()) for x in (F.lit(k), F.array(*(F.lit(float(y)) for y in v)))))
    d = rows.withColumn("g", F.element_at(duals, F.col("fold").cast("int")))
    return d.withColumn("f", F.lit(eps) * (F.log("a") - logsumexp(F.zip_with("c", "g", lambda c, x: (x - c) / eps))))


def _plan_costs(d: DataFrame, eps: float) -> dict[int, float]:
    plan = F.zip_with("c", "g", lambda c, x: c * F.exp((F.col("f") + x - c) / eps))
    return {r.fold: float(r.cost) for r in d.groupBy("fold").agg(F.sum(total(plan)).alias("cost")).collect()}


def sinkhorn(df: DataFrame, target: Sequence[float], eps: float = 0.05, rounds: int = 50, tol: float = 1e-9) -> tuple[list[float], float]:
    """Column duals and cost of the entropic plan from rows (w, c array of costs) to ``target``; zeros without rows."""
    rows, g = _duals(df.drop("fold").withColumn("fold", F.lit(0)), [target], eps, rounds, tol)
    if not g:
        return [0.0] * len(target), 0.0
    return g[0].tolist(), _plan_costs(_with_dual(rows, g, eps), eps)[0]


def match_cost(df: DataFrame, targets: Sequence[Sequence[float]], eps: float = 0.05, rounds: int = 50) -> DataFrame:
    """fold, cost: transport cost of each fold's rows (fold, w, c) to the fold's target marginal; 0 for an empty fold."""
    rows, g = _duals(df, targets, eps, rounds, 1e-9)
    cost = _plan_costs(_with_dual(rows, g, eps), eps) if g else {}
    return df.sparkSession.createDataFrame([(k, cost.get(k, 0.0)) for k in range(len(targets))], "fold int, cost double")


def match_gradient(df: DataFrame, targets: Sequence[Sequence[float]], eps: float = 0.05, rounds: int = 50, weights: Sequence[float] | None = None) -> DataFrame:
    """obs_id, fold, gradient of the matching term by a row's place in its fold: weight x (f - mean f) x w / W of the fold,
    f being the row's dual and its mean that by mass, as duals are known up to a constant only."""
    rows, g = _duals(df, targets, eps, rounds, 1e-9)
    d = _with_dual(rows, g, eps)
    mean = d.groupBy("fold").agg((F.sum(F.col("a") * F.col("f")) / F.sum("a")).alias("_f"))
    rho = F.element_at(F.array(*(F.lit(float(x)) for x in weights or [1.0] * len(targets))), F.col("fold") + 1)
    return d.join(F.broadcast(mean), "fold").select("obs_id", "fold", (rho * (F.col("f") - F.col("_f")) * F.col("a")).alias("gradient"))


def similarity_costs(edges: DataFrame) -> DataFrame:
    """src, dst, val: costs 1 - similarity of edges, never below 0; pairs without an edge cost 1 and are not listed."""
    return edges.select("src", "dst", F.greatest(1 - F.col("val"), F.lit(0.0)).alias("val"))
