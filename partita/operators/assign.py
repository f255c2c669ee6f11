"""Assignment, rounding and repair on tables of observations.

Two folds: the linear assignment with a balance band is a fractional knapsack, solved exactly by an ordered prefix. The
order is never in one task: running sums go through value ranges. Ties are broken by obs_id throughout.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut_lineage, small
from ..functions.prefix import running_sums
from ..functions.rng import uniform



def assign_two(df: DataFrame, share: float, eps: float = 0.0, eta: float = 0.0) -> DataFrame:
    """obs_id, fold, z1 for two folds: minimises the sum of ``delta`` over fold 1 (delta is the cost of fold 1 over fold 0)
    plus 2 eta s**2, s being fold 1's mass less share W, with that mass in share W +- eps W.

    Rows enter fold 1 by rising delta / w while they lower the objective or the band's lower end asks for them, up to its
    upper end. z1 is the fraction of the last row; fold is 1 where z1 is at least a half.
    """
    d = df.select("obs_id", "w", "delta", (F.col("delta") / F.col("w")).alias("_d"))
    d = running_sums(d, "_d", {"_c": "w"}, ties=("obs_id",))
    d = d.join(F.broadcast(df.agg(F.sum("w").alias("_W"))))
    lo, hi, t = (share - eps) * F.col("_W"), (share + eps) * F.col("_W"), share * F.col("_W")
    # Mass at which the marginal cost turns positive, row by row: delta / w + 4 eta s = 0.
    stop = t - F.col("_d") / (4 * eta) if eta > 0 else F.when(F.col("_d") < 0, F.col("_c")).otherwise(F.col("_c") - F.col("w"))
    upto = F.greatest(lo, F.least(hi, stop))
    z = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (upto - (F.col("_c") - F.col("w"))) / F.col("w")))
    return d.select("obs_id", F.when(z >= 0.5, 1).otherwise(0).alias("fold"), z.alias("z1"))


def assign_folds(df: DataFrame, r: Sequence[float], eps: float = 0.0, eta: float = 0.0) -> DataFrame:
    """obs_id, fold for rows (obs_id, w, g): ``g`` is the cost of each fold. Two folds go by :func:`assign_two`. More are
    filled from the last to the second, each by that among the rows that are left, at its cost over the cheapest fold
    still open; the band is shared, so every fold stays within eps W of its share but for the last row's rounding."""
    left, out = df.select("obs_id", "w", "g"), None
    for f in range(len(r) - 1, 0, -1):
        others = F.array_min(F.slice("g", 1, f))
        d = left.withColumn("delta", F.col("g")[f] - others)
        z = assign_two(d.select("obs_id", "w", "delta"), r[f] / sum(r[: f + 1]), eps / (len(r) - 1), eta).select("obs_id", "fold")
        if f < len(r) - 1 or f > 1:
            z = cut_lineage(z)
        took = z.where("fold = 1").select("obs_id", F.lit(f).alias("fold"))
        out = took if out is None else out.unionByName(took)
        if f == 1:
            return out.unionByName(z.where("fold = 0").select("obs_id", F.lit(0).alias("fold")))
        left = cut_lineage(left.join(z.where("fold = 0").select("obs_id"), "obs_id"))
    return df.select("obs_id", F.lit(0).alias("fold"))


def round_by_confidence(z: DataFrame, r: Sequence[float]) -> DataFrame:
    """obs_id, fold from fractions ``z`` (array) of rows (obs_id, w, z): the largest, then one pass per ordered pair of
    folds that moves the least certain rows from the fold above its target to the one below, as few as cover the gap."""
    k = len(r)
    best = F.array_max("z")
    cur = z.select("obs_id", "w", "z", (F.array_position("z", best) - 1).cast("int").alias("fold"))
    for a in range(k):
        for b in range(k):
            if a != b:
                cur = _shift(cur, a, b, r, F.element_at("z", a + 1) - F.element_at("z", b + 1))
    return cur.select("obs_id", "fold")


def _shift(cur: DataFrame, a: int, b: int, r: Sequence[float], score) -> DataFrame:
    """Move rows of fold a to fold b by rising score while the moved mass is within both folds' gaps."""
    m = cur.agg(F.sum("w").alias("_W"), *(F.sum(F.when(F.col("fold") == i, F.col("w")).otherwise(0.0)).alias(f"_m{i}") for i in (a, b)))
    gap = F.least(F.col(f"_m{a}") - r[a] * F.col("_W"), r[b] * F.col("_W") - F.col(f"_m{b}"))
    movable = cur.where(F.col("fold") == a).withColumn("_s", score.cast("double"))
    move = running_sums(movable.select("obs_id", "w", "_s"), "_s", {"_c": "w"}, ties=("obs_id",)).join(F.broadcast(m))
    move = move.where(F.col("_c") <= gap + 1e-9).select("obs_id", F.lit(b).alias("_to"))
    return cur.join(move, "obs_id", "left").select(*(F.coalesce("_to", "fold").cast("int").alias("fold") if c == "fold" else F.col(c) for c in cur.columns))


def round_by_draw(z: DataFrame, r: Sequence[float], seed: int = 42) -> DataFrame:
    """obs_id, fold: each row's fold is drawn from its fractions by the portable hash, then masses are rebalanced like
    :func:`round_by_confidence`."""
    u = uniform(F.col("obs_id"), seed)
    cum = F.transform("z", lambda x, i: F.aggregate(F.slice("z", F.lit(1), i + 1), F.lit(0.0), lambda s, v: s + v))
    pick = F.least(F.size(F.filter(cum, lambda c: c <= u)), F.lit(len(r) - 1)).cast("int")
    cur = z.select("obs_id", "w", "z", pick.alias("fold"))
    for a in range(len(r)):
        for b in range(len(r)):
            if a != b:
                cur = _shift(cur, a, b, r, F.element_at("z", a + 1) - F.element_at("z", b + 1))
    return cur.select("obs_id", "fold")


def swap_for_leakage(df: DataFrame, edges: DataFrame, r: Sequence[float]) -> DataFrame:
    """obs_id, fold after moving rows from the fold above its target to the one below: those with most affinity to the
    target over their own fold first, only while that is positive, and never more mass than the gap (two folds)."""
    from .graph import BlockEdges, with_folds

    if isinstance(edges, BlockEdges):
        own = F.when(F.col("fold_src") == 0, F.col("a0")).otherwise(F.col("a1"))
        a = edges.affinities(df, 2).select(F.col("src").alias("obs_id"), (F.col("deg") - 2 * own).alias("_gain"))
    else:
        a = with_folds(edges, df).groupBy(F.col("src").alias("obs_id")).agg(F.sum(F.when(F.col("fold_src") != F.col("fold_dst"), F.col("val")).otherwise(-F.col("val"))).alias("_gain"))
    d = df.select("obs_id", "fold", "w").join(a, "obs_id", "left").withColumn("_gain", F.coalesce("_gain", F.lit(0.0)))
    m = d.agg(F.sum("w").alias("_W"), F.sum(F.when(F.col("fold") == 0, F.col("w")).otherwise(0.0)).alias("_m0"))
    over = F.when(F.col("_m0") > r[0] * F.col("_W"), 0).otherwise(1)
    gap = F.abs(F.col("_m0") - r[0] * F.col("_W"))
    cand = d.join(F.broadcast(m)).where((F.col("fold") == over) & (F.col("_gain") > 0)).select("obs_id", "w", (-F.col("_gain")).alias("_s"), gap.alias("_gap"))
    move = running_sums(cand, "_s", {"_c": "w"}, ties=("obs_id",)).where(F.col("_c") <= F.col("_gap") + 1e-9).select("obs_id", F.lit(1).alias("_moved"))
    return d.join(move, "obs_id", "left").select("obs_id", F.when(F.col("_moved").isNotNull(), 1 - F.col("fold")).otherwise(F.col("fold")).cast("int").alias("fold"))


def random_balanced(df: DataFrame, r: Sequence[float], seed: int = 42) -> DataFrame:
    """obs_id, fold: rows in hashed order fill the folds up to their shares of mass."""
    d = running_sums(df.select("obs_id", "w").withColumn("_u", uniform(F.col("obs_id"), seed)), "_u", {"_c": "w"}, ties=("obs_id",))
    d = d.join(F.broadcast(df.agg(F.sum("w").alias("_W"))))
    fold, at = F.lit(len(r) - 1), sum(r[:-1])
    for i in range(len(r) - 2, -1, -1):
        fold = F.when(F.col("_c") - F.col("w") / 2 <= F.lit(at) * F.col("_W"), i).otherwise(fold)
        at -= r[i]
    return d.select("obs_id", fold.cast("int").alias("fold"))


#: Groups that a sequential rule takes to the driver.
MOST_GROUPS = 2_000_000


def _counted(groups: DataFrame) -> None:
    n = groups.count()
    if n > MOST_GROUPS:
        raise ValueError(f"{n} groups are packed one after another on the driver, which takes {MOST_GROUPS}: use baselines.group_skip or group_stop")


def pack_groups(groups: DataFrame, r: Sequence[float]) -> list[tuple[object, int]]:
    """Folds of groups (group_id, mass): largest first, each into the fold farthest below its target. Sequential, on the
    table of groups; raises ValueError for more than ``MOST_GROUPS``."""
    _counted(groups)
    rows = sorted(((g.group_id, float(g.mass)) for g in groups.select("group_id", "mass").collect()), key=lambda x: (-x[1], str(x[0])))
    total = sum(m for _, m in rows)
    have, out = [0.0] * len(r), []
    for g, m in rows:
        f = max(range(len(r)), key=lambda i: (r[i] * total - have[i], -i))
        have[f] += m
        out.append((g, f))
    return out


def pack_hierarchy(df: DataFrame, group: str, r: Sequence[float]) -> DataFrame:
    """``df`` with fold set so that every group is whole: :func:`pack_groups` on its groups, joined back."""
    g = df.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("group_id")).agg(F.sum("w").alias("mass"))
    kind = g.schema["group_id"].dataType.simpleString()
    packed = df.sparkSession.createDataFrame(pack_groups(g, r), f"group_id {kind}, fold int")
    return df.drop("fold").join(small(packed), F.col(group) == F.col("group_id"), "left").drop("group_id")


def hierarchy_value(members: DataFrame, edges: DataFrame, levels: DataFrame) -> DataFrame:
    """One row, value: over levels (level, lam), lambda times the sum over edges (level, g, h, s) of s unless both groups
    are whole and in one fold. Members have level, group_id, fold; empty groups are dropped."""
    whole = members.groupBy("level", "group_id").agg(F.min("fold").alias("f"), F.max("fold").alias("_x")).select("level", "group_id", F.when(F.col("f") == F.col("_x"), F.col("f")).alias("f"))
    j = edges.join(whole.withColumnsRenamed({"group_id": "g", "f": "fg"}), ["level", "g"]).join(whole.withColumnsRenamed({"group_id": "h", "f": "fh"}), ["level", "h"])
    return j.join(F.broadcast(levels), "level").agg(F.coalesce(F.sum(F.col("lam") * F.col("s") * F.when(F.col("fg") == F.col("fh"), 0.0).otherwise(1.0)), F.lit(0.0)).alias("value"))


def hierarchy_gradient(members: DataFrame, edges: DataFrame, levels: DataFrame, k: int = 2) -> DataFrame:
    """level, group_id, fold, gradient: lambda x the group's similarity mass x (1 - 2 y), y being 1 where the whole group
    is in the fold; the mass counts an edge at both of its ends."""
    whole = members.groupBy("level", "group_id").agg(F.min("fold").alias("f"), F.max("fold").alias("_x"))
    ends = edges.select("level", F.col("g").alias("group_id"), "s").unionByName(edges.select("level", F.col("h").alias("group_id"), "s"))
    mass = ends.groupBy("level", "group_id").agg(F.sum("s").alias("m"))
    j = whole.join(mass, ["level", "group_id"]).join(F.broadcast(levels), "level").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    y = F.when((F.col("f") == F.col("_x")) & (F.col("f") == F.col("fold")), 1.0).otherwise(0.0)
    return j.select("level", "group_id", "fold", (F.col("lam") * F.col("m") * (1 - 2 * y)).alias("gradient"))


def hierarchy_repair(df: DataFrame, group: str, r: Sequence[float], eps: float) -> DataFrame:
    """``df`` with split groups made whole in their majority fold, smallest escaping mass first, as long as that fold
    keeps within (r + eps) W. Sequential on the split groups alone; raises ValueError for more than ``MOST_GROUPS``."""
    g = df.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("group_id"), "fold").agg(F.sum("w").alias("m"))
    split = g.join(g.groupBy("group_id").agg(F.count("*").alias("_k")).where("_k > 1"), "group_id", "left_semi")
    _counted(split.select("group_id").distinct())
    total = {x.fold: x.m for x in df.groupBy("fold").agg(F.sum("w").alias("m")).collect()}
    by: dict = {}
    for x in split.collect():
        by.setdefault(x.group_id, {})[x.fold] = x.m
    every, moved = sum(total.values()), []
    for gid, m in sorted(by.items(), key=lambda i: (sum(i[1].values()) - max(i[1].values()), str(i[0]))):
        to = max(m, key=lambda f: (m[f], -f))
        come = sum(v for f, v in m.items() if f != to)
        if total.get(to, 0.0) + come <= (r[to] + eps) * every + 1e-9:
            for f, v in m.items():
                total[f] -= v
            total[to] = total.get(to, 0.0) + sum(m.values())
            moved.append((gid, int(to)))
    kind = g.schema["group_id"].dataType.simpleString()
    new = df.sparkSession.createDataFrame(moved, f"_g {kind}, _f int")
    return df.join(small(new), F.col(group) == F.col("_g"), "left").select(*(F.coalesce("_f", "fold").alias("fold") if c == "fold" else F.col(c) for c in df.columns))


def swap_pairs(df: DataFrame, gains: DataFrame) -> DataFrame:
    """obs_id, fold after one round of pairwise exchange between folds 0 and 1, which keeps counts: the i-th best mover of
    one fold (obs_id, gain) changes places with the i-th best of the other while their joint gain is positive. A local
    search in place of an exact integer programme; nothing is claimed about optimality."""
    d = df.select("obs_id", "fold").join(gains, "obs_id").withColumns({"_s": -F.col("gain"), "_one": F.lit(1)})
    d = running_sums(d, "_s", {"_rank": "_one"}, keys=("fold",), ties=("obs_id",))
    a, b = d.where("fold = 0").select("_rank", F.col("obs_id").alias("a"), F.col("gain").alias("ga")), d.where("fold = 1").select("_rank", F.col("obs_id").alias("b"), F.col("gain").alias("gb"))
    pairs = a.join(b, "_rank").where("ga + gb > 0").select(F.explode(F.array("a", "b")).alias("obs_id"), F.lit(1).alias("_swap"))
    return df.select("obs_id", "fold").join(pairs, "obs_id", "left").select("obs_id", F.when(F.col("_swap").isNotNull(), 1 - F.col("fold")).otherwise(F.col("fold")).cast("int").alias("fold"))


def pinned_rows(df: DataFrame, group: str, share: float = 0.9) -> DataFrame:
    """obs_id, fold of the rows to hold fast: those of groups with at least ``share`` of their mass in one fold."""
    g = df.groupBy(group, "fold").agg(F.sum("w").alias("m"))
    top = g.groupBy(group).agg(F.max_by("fold", F.struct("m", -F.col("fold"))).alias("_f"), (F.max("m") / F.sum("m")).alias("_share")).where(F.col("_share") >= share)
    return df.join(top.select(F.col(group).alias("_g"), "_f"), F.col(group) == F.col("_g")).select("obs_id", F.col("_f").alias("fold"))


def containment(members: DataFrame, k: int = 2) -> DataFrame:
    """level, group_id, fold, y for each fold: y is the least membership of the group's rows (level, group_id, fold), the
    linear programme's optimum in closed form: 1 where the whole group lies in the fold, else 0."""
    g = members.groupBy("level", "group_id").agg(F.min("fold").alias("_lo"), F.max("fold").alias("_hi")).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return g.select("level", "group_id", "fold", ((F.col("_lo") == F.col("_hi")) & (F.col("_lo") == F.col("fold"))).cast("double").alias("y"))


def containment_products(members: DataFrame, edges: DataFrame, k: int = 2) -> DataFrame:
    """level, g, h, fold, p: the product of two similar groups' containment for each edge (level, g, h, s) and fold."""
    y = containment(members, k)
    a, b = y.withColumnsRenamed({"group_id": "g", "y": "_a"}), y.withColumnsRenamed({"group_id": "h", "y": "_b"})
    return edges.select("level", "g", "h").join(a, ["level", "g"]).join(b, ["level", "h", "fold"]).select("level", "g", "h", "fold", (F.col("_a") * F.col("_b")).alias("p"))


def class_repair(df: DataFrame, r: Sequence[float], cls: str, cost: str | None = None, frozen: str | None = None) -> DataFrame:
    """``df`` after moves that mend balance within classes: for each ordered pair of folds and each class, rows go from the
    fold above the class's target to the one below, cheapest first by the array ``cost`` (target fold's less own fold's),
    then by obs_id, while the moved mass is within both gaps. So no class's and no fold's deviation grows. Rows where
    ``frozen`` holds, as those of entities that must not straddle, stay; nulls are a class of their own."""
    cur = df.withColumn("_class", F.col(cls))
    for a in range(len(r)):
        for b in range(len(r)):
            if a == b:
                continue
            mass = [F.sum(F.when(F.col("fold") == i, F.col("w")).otherwise(0.0)) for i in (a, b)]
            gap = F.least(mass[0] - r[a] * F.sum("w"), r[b] * F.sum("w") - mass[1])
            g = cur.groupBy(F.col("_class").alias("_c_gap")).agg(gap.alias("_gap")).where("_gap > 0")
            step = (F.element_at(cost, b + 1) - F.element_at(cost, a + 1)).cast("double") if cost else F.lit(0.0)
            free = cur.where((F.col("fold") == a) & (~F.coalesce(F.col(frozen), F.lit(False)) if frozen else F.lit(True)))
            free = free.select("obs_id", "w", "_class", step.alias("_s")).join(small(g), F.col("_class").eqNullSafe(F.col("_c_gap")))
            move = running_sums(free, "_s", {"_m": "w"}, keys=("_class",), ties=("obs_id",)).where("_m <= _gap + 1e-9").select("obs_id", F.lit(b).alias("_to"))
            cur = cut_lineage(cur.join(move, "obs_id", "left").select(*(F.coalesce("_to", "fold").cast("int").alias("fold") if c == "fold" else F.col(c) for c in cur.columns)))
    return cur.drop("_class")
