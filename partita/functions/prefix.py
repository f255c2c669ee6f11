"""Global orders without a single-task window: ranges of about ``RANGE_ROWS`` rows, then offsets of the ranges' totals.

Tables of at most that many rows are one range and cost one window. Larger ones are range-partitioned by (value, ties) and
written once, so that all steps see the same ranges; a value that many rows share is split by its ties.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut_lineage

#: Rows of one range, about: what one task orders.
RANGE_ROWS = 1 << 18


def _ranged(df: DataFrame, n: int, rows: int, by: Sequence[str]) -> DataFrame:
    """``df`` with ``_range``: ascending ranges of about ``rows`` rows in the order of ``by``."""
    return cut_lineage(df.repartitionByRange(math.ceil(n / rows), *by).withColumn("_range", F.spark_partition_id()))


def running_sums(df: DataFrame, by: str, values: dict[str, str], keys: tuple[str, ...] = (), ties: tuple[str, ...] | None = None, rows: int | None = None) -> DataFrame:
    """``df`` with, for each ``{out: value}``, the sum of value over the rows of the same keys up to this one by ``by``.

    Rows with equal ``by`` get the sum at the end of their ties, or, if ``ties`` names columns, are ordered by these.
    No task orders more than about ``rows`` rows, whatever the keys and values; nulls come first.
    """
    rows = rows or RANGE_ROWS
    n = df.count()
    if n <= rows:
        w = Window.partitionBy(*keys).orderBy(by, *(ties or ()))
        w = w.rowsBetween(Window.unboundedPreceding, 0) if ties is not None else w.rangeBetween(Window.unboundedPreceding, 0)
        return df.select(*(F.col(c) for c in df.columns), *(F.sum(v).over(w).alias(o) for o, v in values.items()))
    if ties is None:  # a sum at the end of ties is one number a value
        per = df.groupBy(*keys, by).agg(*(F.sum(v).alias(f"_v{i}") for i, v in enumerate(values.values())))
        per = running_sums(per, by, {o: f"_v{i}" for i, o in enumerate(values)}, keys, (), rows)
        per = per.select(*(F.col(c).alias(f"_k_{c}") for c in (*keys, by)), *values)
        on = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in (*keys, by)]
        return df.join(per, on).select(*(F.col(c) for c in df.columns), *values)
    d = _ranged(df, n, rows, (by, *ties))
    sums = d.groupBy(*keys, "_range").agg(*(F.sum(v).alias(f"_sum_{o}") for o, v in values.items()))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*(F.col(c).alias(f"_k_{c}") for c in keys), F.col("_range").alias("_r"), *(F.coalesce(F.sum(f"_sum_{o}").over(earlier), F.lit(0)).alias(f"_off_{o}") for o in values))
    w = Window.partitionBy(*keys, "_range").orderBy(by, *ties).rowsBetween(Window.unboundedPreceding, 0)
    joined = d.join(offsets, [F.col("_range") == F.col("_r"), *(F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys)])
    return joined.select(*(F.col(c) for c in df.columns), *((F.sum(v).over(w) + F.col(f"_off_{o}")).alias(o) for o, v in values.items()))


def row_numbers(df: DataFrame, by: str, out: str, keys: tuple[str, ...] = (), ties: tuple[str, ...] = ("obs_id",)) -> DataFrame:
    """``df`` with each row's number, from 1, among the rows of its keys."""
    return running_sums(df.withColumn("_one", F.lit(1)), by, {out: "_one"}, keys, ties).drop("_one")


def next_value(df: DataFrame, by: str, out: str, keys: tuple[str, ...] = (), rows: int | None = None) -> DataFrame:
    """``df`` with the next larger ``by`` among the rows of the same keys, null at the last; (keys, ``by``) must be unique."""
    rows = rows or RANGE_ROWS
    n = df.count()
    if n <= rows:
        return df.withColumn(out, F.lead(by).over(Window.partitionBy(*keys).orderBy(by)))
    d = _ranged(df, n, rows, (by,))
    firsts = d.groupBy(*keys, "_range").agg(F.min(by).alias("_first"))
    after = firsts.select(*(F.col(c).alias(f"_k_{c}") for c in keys), F.col("_range").alias("_r"), F.lead("_first").over(Window.partitionBy(*keys).orderBy("_range")).alias("_after"))
    d = d.join(after, [F.col("_range") == F.col("_r"), *(F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys)])
    inside = F.lead(by).over(Window.partitionBy(*keys, "_range").orderBy(by))
    return d.select(*(F.col(c) for c in df.columns), F.coalesce(inside, F.col("_after")).alias(out))


def percentiles(df: DataFrame, value: str, levels: Sequence[float], rows: int | None = None) -> DataFrame:
    """One row, q: exact quantiles of a column by linear interpolation, nulls left out.

    Up to ``rows`` values one aggregate holds them; beyond that they are counted, and found by their running counts.
    """
    d = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_v"))
    n = d.count()
    if n <= (rows or RANGE_ROWS):
        return d.agg(F.percentile("_v", F.array(*map(F.lit, levels))).alias("q"))
    c = running_sums(d.groupBy("_v").agg(F.count("*").alias("_n")), "_v", {"_c": "_n"}, ties=(), rows=rows)
    at = [(n - 1) * q for q in levels]
    nth = {i: F.min(F.when(F.col("_c") > i, F.col("_v"))) for i in sorted({f(h) for h in at for f in (math.floor, math.ceil)})}
    found = c.agg(*(e.alias(f"_{i}") for i, e in nth.items()))
    between = [F.col(f"_{math.floor(h)}") + (h - math.floor(h)) * (F.col(f"_{math.ceil(h)}") - F.col(f"_{math.floor(h)}")) for h in at]
    return found.select(F.array(*between).alias("q"))


def group_percentiles(df: DataFrame, keys: Sequence[str], value: str, levels: Sequence[float], rows: int | None = None) -> DataFrame:
    """keys, q: exact quantiles of each group by linear interpolation, nulls left out.

    As :func:`percentiles`: beyond ``rows`` values, distinct values are counted and each level's two neighbours are the
    values whose running counts span its places, so no group has to fit into one task.
    """
    d = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    if d.count() <= (rows or RANGE_ROWS):
        return d.groupBy(*keys).agg(F.percentile("_v", F.array(*map(F.lit, levels))).alias("q"))
    counts = cut_lineage(d.groupBy(*keys, "_v").agg(F.count("*").alias("_n")))
    size = counts.groupBy(*keys).agg(F.sum("_n").alias("_all")).select(*(F.col(c).alias(f"_k_{c}") for c in keys), "_all")
    c = running_sums(counts, "_v", {"_c": "_n"}, tuple(keys), (), rows).join(size, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    places = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q")) for i, q in enumerate(levels)))

    def here(end):
        return F.filter(places, lambda p: (end((F.col("_all") - 1) * p["q"]) >= F.col("_c") - F.col("_n")) & (end((F.col("_all") - 1) * p["q"]) < F.col("_c")))

    ends = F.concat(F.transform(here(F.floor), lambda p: F.struct(p["i"].alias("i"), p["q"].alias("q"), F.lit(0).alias("up"))), F.transform(here(F.ceil), lambda p: F.struct(p["i"].alias("i"), p["q"].alias("q"), F.lit(1).alias("up"))))
    e = c.select(*keys, "_v", "_all", F.explode(ends).alias("e")).groupBy(*keys, "e.i", "e.q").agg(
        F.max(F.when(F.col("e.up") == 0, F.col("_v"))).alias("a"), F.max(F.when(F.col("e.up") == 1, F.col("_v"))).alias("b"), F.max((F.col("_all") - 1) * F.col("e.q")).alias("h")
    )
    v = F.col("a") + (F.col("h") - F.floor("h")) * (F.col("b") - F.col("a"))
    return e.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", v.alias("v")))), lambda s: s["v"]).alias("q"))
