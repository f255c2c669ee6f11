"""The splitter: block-coordinate search for an assignment to folds, sweeps over coefficients, and several splits by seed.

State of the loop is one table (obs_id, fold); each round is a handful of joins on the edge tables, ordered prefixes for
the assignment, and a repair. Terms without an input add nothing to the plan. Two folds are assigned exactly for the
linearised objective; more are filled one after another, each by such an assignment among the rows that are left.

Whole units are assigned where entities, groups or super-nodes must not straddle: gradients are summed over a unit, which
is coarsening, and its fold holds for all its rows, which is the lift back.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut_lineage, release
from ..functions.prefix import row_numbers
from ..functions.rng import gaussian, uniform
from ..operators import assign as asg
from ..operators import folds, graph, similarity, stratify, transport
from ..operators.select import pareto, recommend, stage0_cut


@dataclass(frozen=True)
class SplitSpec:
    """What to split and what to weigh. ``obs`` has obs_id and w, and what the terms ask for: y, cls, an entity column."""

    obs: DataFrame
    share: float = 0.8
    shares: tuple[float, ...] | None = None  # of all folds, if these are not (share, 1 - share)
    edges: DataFrame | similarity.BlockEdges | None = None  # src, dst, val or packed pairs: the cut term
    kernel: DataFrame | similarity.Kernel | None = None  # src, dst, val or vectors' kernel: the term that drives folds apart
    hierarchy: str | None = None  # a column of obs whose groups are to stay whole
    levels: DataFrame | None = None  # level, lam: levels of groups that are alike, with
    members: DataFrame | None = None  # level, group_id, obs_id, and
    level_edges: DataFrame | None = None  # level, g, h, s: whole groups that are alike are to share a fold
    match: tuple[float, ...] | None = None  # centres of bins of y: the term that pulls folds to target marginals over them
    targets: tuple[tuple[float, ...], ...] | None = None  # each fold's marginal; that of all rows if not given
    stratify: bool | str = False  # by quantiles of y (True or "quantile"), its moments ("moment") or slices of x ("sliced")
    entity: str | None = None  # a column of obs whose rows may not straddle folds
    other: str | None = None  # a second entity column
    cold: str = "left"  # which may not straddle: "left" (entity), "right" (other), or "both"
    supers: str | None = None  # a column of super-nodes that are assigned whole
    repair: bool = False  # mend split groups and swap for leakage at the end, where that is no worse
    provenance: str | None = None  # where the edges come from; required with them
    alpha: float = 1.0
    beta: float = 1.0
    gamma: float = 1.0
    mu: float = 0.0
    eta: float = 0.0
    eps: float = 0.05
    noise: float = 0.0
    max_iter: int | None = 10  # rounds at most; None: as many as ``patience`` allows
    patience: int = 3
    seed: int = 42
    least_moved: float = 0.0  # end where a smaller share of rows changes fold
    least_gain: float = 0.0  # end where the objective changes by a smaller share of itself

    @property
    def r(self) -> tuple[float, ...]:
        return tuple(self.shares) if self.shares else (self.share, 1 - self.share)

    @property
    def unit(self) -> str | None:
        """The column whose values are assigned whole."""
        return self.supers or (self.other if self.cold == "right" else self.entity) or self.hierarchy

    def check(self) -> None:
        """Raise ValueError for inputs that contradict one another."""
        have = set(self.obs.columns)
        if not {"obs_id", "w"} <= have:
            raise ValueError("obs needs obs_id and w")
        if self.edges is None and self.kernel is None and not self.hierarchy and not self.stratify and not self.match and self.levels is None:
            raise ValueError("at least one term is needed: edges, kernel, match, hierarchy, levels or stratify")
        if self.match and self.kernel is not None:
            raise ValueError("folds are driven apart by the kernel or matched to targets, not both")
        if self.match and ("y" not in have or len(self.match) < 2):
            raise ValueError("match needs y and two bins at least")
        if self.targets and (not self.match or len(self.targets) != len(self.r) or any(len(t) != len(self.match) or min(t) < 0 or sum(t) <= 0 for t in self.targets)):
            raise ValueError("targets need match, and one marginal over its bins for each fold")
        given = [x is not None for x in (self.levels, self.members, self.level_edges)]
        if any(given) and not all(given):
            raise ValueError("levels, members and level_edges belong together")
        if self.hierarchy and self.levels is not None:
            raise ValueError("groups come from one column (hierarchy) or from levels, not both")
        if self.edges is not None and not self.provenance:
            raise ValueError("edges need a provenance")
        if not 0 < self.share < 1:
            raise ValueError("share must lie between 0 and 1")
        if len(self.r) < 2 or min(self.r) <= 0 or abs(sum(self.r) - 1) > 1e-9:
            raise ValueError("shares must be positive, of two folds at least, and add up to 1")
        if self.kernel is not None and len(self.r) > 2:
            raise ValueError("the kernel term drives two folds apart")
        if self.cold not in ("left", "right", "both") or self.cold != "left" and not self.other or self.cold == "both" and not self.entity:
            raise ValueError("cold is left, right (needs other) or both (needs entity and other)")
        if self.stratify not in (False, True, "quantile", "moment", "sliced"):
            raise ValueError("stratify is quantile, moment or sliced")
        if self.eps < 0 or min(self.alpha, self.beta, self.gamma, self.mu, self.eta, self.noise) < 0:
            raise ValueError("coefficients must not be negative")
        if self.stratify and ("x" if self.stratify == "sliced" else "y") not in have:
            raise ValueError("stratify needs y, or x for slices")
        for c in (self.hierarchy, self.entity, self.other, self.supers):
            if c and c not in have:
                raise ValueError(f"obs has no column {c}")
        for name, e in (("edges", self.edges), ("kernel", self.kernel)):
            if isinstance(e, DataFrame) and not {"src", "dst", "val"} <= set(e.columns):
                raise ValueError(f"{name} need src, dst and val")
        bad = self.obs.agg(F.count("*").alias("n"), F.countDistinct("obs_id").alias("k"), F.coalesce(F.min("w"), F.lit(0.0)).alias("lo")).first()
        if bad.n != bad.k:
            raise ValueError("obs_id must be unique and not null")
        if bad.n and bad.lo <= 0:
            raise ValueError("weights must be positive")


@dataclass
class SplitResult:
    assignment: DataFrame
    history: list[dict] = field(default_factory=list)
    stopped: str = ""  # why rounds ended: "patience", "rounds", "still" (few rows or none moved), "flat" (little gained)

    def history_table(self) -> DataFrame:
        rows = [(h["iteration"], t, float(h[t])) for h in self.history for t in h if t != "iteration"]
        return self.assignment.sparkSession.createDataFrame(rows, "iteration int, term string, value double")


def level_tables(obs: DataFrame, lam: dict[str, float], eps: float | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Levels (level, lam), members (level, group_id, obs_id) and edges (level, g, h, s) from columns of ``obs``.

    Every group is its own edge with s = 1, so split groups cost; with ``eps`` groups whose weighted mean vectors of x have
    a cosine of at least ``eps`` are edges too, each unordered pair once. Null group values belong to no group.
    """
    levels = obs.sparkSession.createDataFrame([(c, float(v)) for c, v in lam.items()], "level string, lam double")
    members = edges = None
    for c in lam:
        d = obs.where(F.col(c).isNotNull()).withColumn("group_id", F.col(c).cast("string"))
        m = d.select(F.lit(c).alias("level"), "group_id", "obs_id")
        e = m.select("level", F.col("group_id").alias("g"), F.col("group_id").alias("h"), F.lit(1.0).alias("s")).distinct()
        if eps is not None:
            axes = d.select("group_id", "w", F.posexplode("x").alias("axis", "v")).groupBy("group_id", "axis").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("m"))
            mean = axes.groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("axis", "m"))), lambda s: s["m"]).alias("x"))
            ids = cut_lineage(row_numbers(mean, "group_id", "_n", ties=()).select(F.col("_n").cast("long").alias("obs_id"), "group_id", "x"))
            near = similarity.edges_within(ids.select("obs_id", "x"), "cosine", eps).where("src < dst")
            name = ids.select("obs_id", "group_id")
            near = near.join(name.withColumnsRenamed({"obs_id": "src", "group_id": "g"}), "src").join(name.withColumnsRenamed({"obs_id": "dst", "group_id": "h"}), "dst")
            e = e.unionByName(near.select(F.lit(c).alias("level"), "g", "h", F.col("val").alias("s")))
        members, edges = (m, e) if members is None else (members.unionByName(m), edges.unionByName(e))
    return levels, members, edges


def _costs(spec: SplitSpec, d: DataFrame) -> tuple[DataFrame, list[list[float]]]:
    """Rows with a y (obs_id, fold, w, c) and each fold's target marginal over the bins."""
    d = transport.bin_costs(d.where("y is not null"), spec.match)
    if spec.targets:
        return d, [list(t) for t in spec.targets]
    nearest = F.array_position("c", F.array_min("c"))
    mass = {r.b: r.m for r in d.groupBy(nearest.alias("b")).agg(F.sum("w").alias("m")).collect()}
    return d, [[mass.get(i + 1, 0.0) + 1e-12 for i in range(len(spec.match))]] * len(spec.r)


def _whole(spec: SplitSpec, cur: DataFrame) -> DataFrame:
    return spec.members.join(cur, "obs_id").select("level", "group_id", "obs_id", "fold")


def _terms(spec: SplitSpec, cur: DataFrame, scale: dict[str, float]) -> dict[str, float]:
    """The terms' values, scaled, and the objective."""
    r = spec.r
    d = cur.join(spec.obs.drop("fold"), "obs_id")
    out: dict[str, float] = {}
    if spec.hierarchy:
        m = d.select(F.lit("h").alias("level"), F.col(spec.hierarchy).alias("group_id"), "fold", "w")
        row = folds.minority_mass(m).first()
        out["H"] = spec.alpha * (row.minority if row else 0.0) / scale["W"]
    if spec.levels is not None:
        out["H"] = spec.alpha * asg.hierarchy_value(_whole(spec, cur), spec.level_edges, spec.levels).first().value / scale["levels"]
    if spec.edges is not None:
        out["M"] = spec.beta * graph.cut_energy(spec.edges, cur).first().energy / scale["cut"]
    if spec.kernel is not None:
        row = transport.mmd_pairs(spec.kernel, d).first()
        out["D"] = -spec.gamma * (row.mmd2 if row else 0.0) / scale["kernel"]
    if spec.match:
        rows, targets = _costs(spec, d)
        out["D"] = spec.gamma * sum(r[x.fold] * x.cost for x in transport.match_cost(rows, targets, rounds=20).collect())
    if spec.stratify == "sliced":
        out["S"] = spec.mu * (stratify.sliced_wasserstein2(d).agg(F.sum("sw2")).first()[0] or 0.0) / scale["strata"]
    elif spec.stratify == "moment":
        out["S"] = spec.mu * (stratify.moment_residual(d).agg(F.sum("residual")).first()[0] or 0.0) / scale["strata"]
    elif spec.stratify:
        b = stratify.quantile_bins(d, 10)
        out["S"] = spec.mu * stratify.quantile_residual(b, r).first().residual / scale["strata"]
    out["composite"] = sum(out.values())
    s = folds.balance_residual(d, r).agg(F.max(F.abs("residual"))).first()[0]
    out["imbalance"] = (s or 0.0) / scale["W"]
    return out


def _gradients(spec: SplitSpec, cur: DataFrame, scale: dict[str, float]) -> DataFrame:
    """obs_id, g: the linearised objective's change, per row, for each fold it may be in (an array)."""
    d, k = cur.join(spec.obs.drop("fold"), "obs_id"), len(spec.r)
    parts = [spec.obs.select("obs_id", F.lit(0).alias("fold"), F.lit(0.0).alias("g"))]

    def add(g: DataFrame, weight: float) -> None:
        parts.append(g.select("obs_id", "fold", (F.col("gradient") * weight).alias("g")))

    if spec.edges is not None:
        add(graph.cut_gradient(spec.edges, cur, k), spec.beta / scale["cut"])
    if spec.kernel is not None:
        add(transport.mmd_gradient(spec.kernel, d).join(cur, "obs_id"), spec.gamma / scale["kernel"])
    if spec.match:
        rows, targets = _costs(spec, d)
        add(transport.match_gradient(rows, targets, rounds=20, weights=spec.r), spec.gamma)
    if spec.levels is not None:
        whole = _whole(spec, cur)
        size = whole.groupBy("level", "group_id").agg(F.count("*").alias("_n"))
        g = asg.hierarchy_gradient(whole, spec.level_edges, spec.levels, k).join(size, ["level", "group_id"]).select("level", "group_id", F.col("fold").alias("_f"), (F.col("gradient") / F.col("_n")).alias("gradient"))
        add(whole.join(g, ["level", "group_id"]).select("obs_id", F.col("_f").alias("fold"), "gradient"), spec.alpha / scale["levels"])
    if spec.stratify == "sliced":
        add(stratify.sliced_gradient(d), spec.mu / scale["strata"])
    elif spec.stratify == "moment":
        add(stratify.moment_gradient(d, (1.0, 1.0, 1.0, 1.0)).join(cur, "obs_id"), spec.mu / scale["strata"])
    elif spec.stratify:
        add(stratify.quantile_gradient(stratify.quantile_bins(d, 10), spec.r), spec.mu / scale["strata"])
    if spec.noise:
        for i in range(1, k):
            parts.append(spec.obs.select("obs_id", F.lit(i).alias("fold"), (gaussian(F.col(spec.unit or "obs_id"), spec.seed + 1009 * (i - 1)) * spec.noise).alias("g")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("obs_id").agg(F.array(*(F.sum(F.when(F.col("fold") == i, F.col("g")).otherwise(0.0)) for i in range(k))).alias("g"))


def _assign(spec: SplitSpec, gradients: DataFrame) -> DataFrame:
    """Rows, or whole units as one row each, assigned by ordered prefixes."""
    d = spec.obs.select("obs_id", "w", *([spec.unit] if spec.unit else [])).join(gradients, "obs_id")
    if not spec.unit:
        return asg.assign_folds(d, spec.r, spec.eps, spec.eta)
    d = d.withColumn("_unit", F.coalesce(F.concat(F.lit("u"), F.col(spec.unit).cast("string")), F.concat(F.lit("r"), F.col("obs_id").cast("string"))))
    each = [F.sum(F.col("g")[i]) for i in range(len(spec.r))]
    g = cut_lineage(d.groupBy(F.col("_unit").alias("obs_id")).agg(F.sum("w").alias("w"), F.array(*each).alias("g")))
    z = asg.assign_folds(g, spec.r, spec.eps, spec.eta).withColumnRenamed("obs_id", "_unit")
    return d.select("obs_id", "_unit").join(z, "_unit").select("obs_id", "fold")


def cold_both(assignment: DataFrame, obs: DataFrame, entity: str, other: str, r: Sequence[float], eps: float) -> DataFrame:
    """The rows whose two entities lie in one fold; the rest is discarded, so neither entity straddles.

    The other entities get folds of their own, with the folds' shares of mass, where least of their rows' mass lies apart
    from the first entities' folds. Rows without the other entity stay.
    """
    d = assignment.join(obs.select("obs_id", "w", F.col(entity).alias("_l"), F.col(other).alias("_r")), "obs_id")
    apart = F.array(*(F.sum(F.when(F.col("fold") != i, F.col("w")).otherwise(0.0)) for i in range(len(r))))
    right = cut_lineage(d.where("_r is not null").groupBy(F.col("_r").alias("obs_id")).agg(F.sum("w").alias("w"), apart.alias("g")))
    right = asg.assign_folds(right, r, eps).select(F.col("obs_id").alias("_r"), F.col("fold").alias("_f"))
    return d.join(right, "_r", "left").where("_f is null or _f = fold").select("obs_id", "fold")


def _mended(spec: SplitSpec, cur: DataFrame) -> list[DataFrame]:
    """Candidates for the end: groups made whole within the band, then rows swapped for leakage (two folds)."""
    d = cur.join(spec.obs.drop("fold"), "obs_id")
    out = []
    if spec.hierarchy and not spec.unit:
        out.append(cut_lineage(asg.hierarchy_repair(d, spec.hierarchy, spec.r, spec.eps).select("obs_id", "fold")))
    if spec.edges is not None and len(spec.r) == 2 and not spec.unit:
        base = out[-1].join(spec.obs.drop("fold"), "obs_id") if out else d
        out.append(cut_lineage(asg.swap_for_leakage(base, spec.edges, spec.r)))
    return out


def normalisers(spec: SplitSpec) -> dict[str, float]:
    """Scales of the terms, from the inputs alone: mass, cut of random assignments, kernel and strata scales."""
    out = {"W": spec.obs.agg(F.sum("w")).first()[0] or 1.0, "cut": 1.0, "kernel": 1.0, "strata": 1.0, "levels": 1.0}
    if spec.edges is not None:
        out["cut"] = stage0_cut(spec.obs, spec.edges, 20, max(spec.r), spec.seed).first().mean_cut or 1.0
    if spec.kernel is not None:
        scales = transport.mmd_scales(spec.kernel).first()  # edges without a diagonal have no worst; constant ones neither
        out["kernel"] = next((x for x in (scales.worst, scales.average) if x and x > 0), 1.0)
    if spec.levels is not None:
        out["levels"] = spec.level_edges.join(F.broadcast(spec.levels), "level").agg(F.sum(F.col("lam") * F.col("s"))).first()[0] or 1.0
    if spec.stratify == "sliced":
        out["strata"] = stratify.sliced_scale(spec.obs, len(spec.r)).first().scale or 1.0
    elif spec.stratify == "moment":
        out["strata"] = stratify.moment_scale(spec.obs).first().scale or 1.0
    elif spec.stratify:
        out["strata"] = stratify.quantile_scale(stratify.quantile_bins(spec.obs, 10), spec.r).first().scale or 1.0
    return out


def split(spec: SplitSpec, scale: dict[str, float] | None = None) -> SplitResult:
    """The best assignment met. Rounds end after ``patience`` without a better objective, when less than ``least_moved`` of
    the rows change fold or nothing does, or when the objective changes by less than ``least_gain`` of itself. With ``cold="both"`` rows whose two entities lie apart are left out of it."""
    spec.check()
    scale = scale or normalisers(spec)
    if spec.unit:
        start = F.array(*(F.lit(0.0) if not i else uniform(F.col(spec.unit), spec.seed + i) - 0.5 for i in range(len(spec.r))))
        cur = _assign(spec, spec.obs.select("obs_id", F.coalesce(start, F.array(*[F.lit(0.0)] * len(spec.r))).alias("g")))
    else:
        cur = asg.random_balanced(spec.obs, spec.r, spec.seed)
    cur = cut_lineage(cur)
    n = cur.count()
    best, best_value, best_gap, stale, history, stopped = cur, float("inf"), 0.0, 0, [], ""
    moved = 0
    i = 0
    while not stopped:
        t = _terms(spec, cur, scale)
        release(cur.sparkSession)
        flat = bool(history) and abs(history[-1]["composite"] - t["composite"]) < spec.least_gain * abs(t["composite"])
        history.append({"iteration": i, "moved": moved / max(n, 1)} | t)
        stale += 1
        if t["composite"] < best_value - 1e-12:
            best, best_value, best_gap, stale = cur, t["composite"], t["imbalance"], 0
        if flat or stale >= spec.patience or i == spec.max_iter:
            stopped = "flat" if flat else "rounds" if i == spec.max_iter else "patience"
            break
        new = cut_lineage(_assign(spec, _gradients(spec, cur, scale)))
        moved = new.join(cur.withColumnRenamed("fold", "_f"), "obs_id").where("fold <> _f").count()
        release(cur.sparkSession)  # a round's shuffles are as large as the table each
        if moved <= spec.least_moved * n:
            stopped = "still"
        cur, i = new, i + 1
        if stopped and moved:
            t = _terms(spec, cur, scale)
            history.append({"iteration": i, "moved": moved / n} | t)
            if t["composite"] < best_value - 1e-12:
                best, best_value, best_gap = cur, t["composite"], t["imbalance"]
    for mended in _mended(spec, best) if spec.repair else []:
        t = _terms(spec, mended, scale)
        if t["composite"] <= best_value and t["imbalance"] <= max(spec.eps, best_gap) + 1e-9:
            best, best_value, best_gap = mended, t["composite"], t["imbalance"]
            history.append({"iteration": len(history)} | t)
    if spec.cold == "both":
        best = cut_lineage(cold_both(best, spec.obs, spec.entity, spec.other, spec.r, spec.eps))
    return SplitResult(best, history, stopped)


def sweep(spec: SplitSpec, alphas: Sequence[float], betas: Sequence[float], gammas: Sequence[float], rule: str = "min_of_normalized") -> tuple[DataFrame, DataFrame, dict[str, SplitResult]]:
    """A split for each point of the grid, with one set of normalisers: the table of configurations with unweighted terms
    and the Pareto front, the recommended row, and the results by config_id."""
    scale = normalisers(spec)
    rows, results = [], {}
    for n, (a, b, g) in enumerate(itertools.product(alphas, betas, gammas)):
        res = split(replace(spec, alpha=a, beta=b, gamma=g), scale)
        t = _terms(replace(spec, alpha=1.0, beta=1.0, gamma=1.0), res.assignment, scale)
        name = f"c{n:03d}"
        results[name] = res
        rows.append((name, float(a), float(b), float(g), *(float(t.get(k, 0.0)) for k in "HMD")))
    table = spec.obs.sparkSession.createDataFrame(rows, "config_id string, alpha double, beta double, gamma double, H double, M double, D double")
    return pareto(table, ("H", "M", "D")), recommend(table, ("H", "M", "D"), rule), results


def multi_split(spec: SplitSpec, n_splits: int, strength: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Assignments (config_id, obs_id, fold) of several seeds with diversity noise, and their pairwise Hamming distances."""
    if n_splits < 1 or strength < 0:
        raise ValueError("n_splits must be positive and strength not negative")
    scale = normalisers(spec)
    every = None
    for n in range(n_splits):
        a = split(replace(spec, seed=spec.seed + n, noise=strength), scale).assignment.select(F.lit(f"s{n}").alias("config_id"), "obs_id", "fold")
        every = a if every is None else every.unionByName(a)
    return every, folds.hamming(every)


def ablation(spec: SplitSpec) -> tuple[DataFrame, dict[str, SplitResult]]:
    """A split for every choice of the hierarchy (H), cut (M) and discrepancy (D) terms that the input allows, with one set
    of normalisers: config_id (the letters of the terms that are on) and the unweighted value of each term, on or off."""
    scale = normalisers(spec)
    have = [t for t, x in (("H", spec.hierarchy), ("M", spec.edges), ("D", spec.kernel)) if x is not None]
    on = {"H": "alpha", "M": "beta", "D": "gamma"}
    rows, results = [], {}
    for n in range(1, len(have) + 1):
        for chosen in itertools.combinations(have, n):
            res = split(replace(spec, **{on[t]: 0.0 for t in have if t not in chosen}), scale)
            t = _terms(replace(spec, alpha=1.0, beta=1.0, gamma=1.0), res.assignment, scale)
            results["".join(chosen)] = res
            rows.append(("".join(chosen), *(float(t[k]) if k in t else None for k in "HMD")))
    return spec.obs.sparkSession.createDataFrame(rows, "config_id string, H double, M double, D double"), results


def sweep_inputs(spec: SplitSpec, inputs: dict[str, dict]) -> tuple[DataFrame, dict[str, SplitResult]]:
    """A split for each named replacement of parts of ``spec``: other edge tables, kernels, super-nodes of other sizes or
    coefficients. config_id, the objective and the imbalance, each with normalisers of its own input."""
    rows, results = [], {}
    for name, change in inputs.items():
        s = replace(spec, **change)
        scale = normalisers(s)
        results[name] = split(s, scale)
        t = _terms(s, results[name].assignment, scale)
        rows.append((name, float(t["composite"]), float(t["imbalance"])))
    return spec.obs.sparkSession.createDataFrame(rows, "config_id string, composite double, imbalance double"), results
