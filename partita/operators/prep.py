"""Cleaning and preparation: imputation, scaling, pooling, binning, sampling, parsing, and two-tier lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import small
from ..functions.prefix import percentiles, row_numbers
from ..functions.rng import hash_int


def impute_mean(df: DataFrame, *cols: str) -> DataFrame:
    """Nulls become the column's mean; the means are one row, broadcast."""
    means = df.agg(*(F.avg(c).alias(f"_m_{c}") for c in cols))
    return df.join(F.broadcast(means)).select(*(F.coalesce(c, f"_m_{c}").alias(c) if c in cols else c for c in df.columns))


def impute_median(df: DataFrame, *cols: str) -> DataFrame:
    """Nulls and non-finite values become the exact median of the finite ones."""
    finite = {c: F.when(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.col(c)) for c in cols}
    d = df
    for c in cols:
        d = d.join(F.broadcast(percentiles(df.select(finite[c].alias("_v")), "_v", [0.5]).select(F.col("q")[0].alias(f"_m_{c}"))))
    return d.select(*(F.coalesce(finite[c], F.col(f"_m_{c}")).alias(c) if c in cols else F.col(c) for c in df.columns))


def zscore(df: DataFrame, *cols: str) -> DataFrame:
    """Columns less their mean over their population deviation; a constant column becomes 0."""
    s = df.agg(*(f for c in cols for f in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))))
    z = lambda c: F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(F.when(F.col(c).isNotNull(), 0.0)).alias(c)
    return df.join(F.broadcast(s)).select(*(z(c) if c in cols else F.col(c) for c in df.columns))


def pool_rare(df: DataFrame, col: str, least: int = 10, other: str = "other") -> DataFrame:
    """Categories with fewer rows than ``least`` become ``other``; the counts are joined, so one category's rows spread."""
    n = df.groupBy(F.col(col).alias("_c")).agg(F.count("*").alias("_n"))
    d = df.join(n, F.col(col).eqNullSafe(F.col("_c")), "left")
    return d.select(*(F.when(F.col("_n") < least, F.lit(other)).otherwise(F.col(c)).alias(c) if c == col else F.col(c) for c in df.columns))


def family_floor_cap(df: DataFrame, family: str, order: str, floor: int, cap: int) -> DataFrame:
    """Family sizes between bounds: families below ``floor`` become ``minor``, those above ``cap`` split into
    ``name#chunk`` of about equal size by ``order``."""
    n = df.groupBy(family).agg(F.count("*").alias("_n"))
    d = df.join(n, family)
    d = row_numbers(d, order, "_rank", keys=(family,))
    chunk = F.floor((F.col("_rank") - 1) * F.ceil(F.col("_n") / cap) / F.col("_n")).cast("int")
    name = F.when(F.col("_n") < floor, F.lit("minor")).when(F.col("_n") > cap, F.concat(F.col(family), F.lit("#"), chunk)).otherwise(F.col(family))
    return d.select(*(name.alias(c) if c == family else F.col(c) for c in df.columns))


def label_encode(df: DataFrame, col: str, out: str) -> DataFrame:
    """Codes from 0 in the order in which values first appear by obs_id; values are ranked apart from rows, in ranges, and
    broadcast only if a count says that they are few."""
    first = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.min("obs_id").alias("_first"))
    codes = row_numbers(first, "_first", out, ties=(col,)).select(col, (F.col(out) - 1).cast("int").alias(out))
    return df.join(small(codes), col, "left")


def bin_edges(y: Column, edges: Sequence[float]) -> Column:
    """How many of the edges lie below y."""
    return sum(((y > F.lit(float(e))).cast("int") for e in edges), F.lit(0))


def canonical(text: Column) -> Column:
    """Trimmed, white space collapsed, dashes of any kind as ``-``, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(text, "[‐-―−]", "-"), r"\s+", " ")))


def signature(items: Column) -> Column:
    """Distinct items, sorted and joined by ``-``."""
    return F.array_join(F.array_sort(F.array_distinct(items)), "-")


def parse_composition(formula: Column) -> Column:
    """Map from element to fraction for formulas like ``Fe2O3`` (a missing number is 1); null for anything else."""
    names = F.regexp_extract_all(formula, F.lit("([A-Z][a-z]?)([0-9.]*)"), F.lit(1))
    raw = F.regexp_extract_all(formula, F.lit("([A-Z][a-z]?)([0-9.]*)"), F.lit(2))
    amounts = F.transform(raw, lambda x: F.when(x == "", F.lit(1.0)).otherwise(x.try_cast("double")))
    elements = F.array_sort(F.array_distinct(names))
    amount = lambda e: F.aggregate(F.arrays_zip(names.alias("n"), amounts.alias("a")), F.lit(0.0), lambda s, x: s + F.when(x["n"] == e, x["a"]).otherwise(0.0))
    every = F.aggregate(amounts, F.lit(0.0), lambda s, x: s + x)
    valid = formula.rlike("^([A-Z][a-z]?([0-9]+(\\.[0-9]+)?)?)+$") & (every > 0)
    return F.when(valid, F.map_from_arrays(elements, F.transform(elements, lambda e: amount(e) / every)))


def kmers(text: Column, k: int) -> Column:
    """All substrings of length k, in order; empty for shorter texts."""
    return F.when(F.length(text) >= k, F.transform(F.sequence(F.lit(1), F.length(text) - k + 1), lambda i: F.substring(text, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def subsample(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """The n rows with the smallest hash of obs_id: a sampling operator, deterministic."""
    return df.orderBy(hash_int(F.col("obs_id"), seed), "obs_id").limit(n)


def stratified_sample(df: DataFrame, group: str, share: float, seed: int = 42) -> DataFrame:
    """The same share of each group's rows, those with the smallest hash; shares round half up."""
    n = df.groupBy(group).agg(F.count("*").alias("_n"))
    d = row_numbers(df.join(n, group).withColumn("_h", hash_int(F.col("obs_id"), seed)), "_h", "_r", keys=(group,))
    return d.where(F.col("_r") <= F.floor(F.lit(share) * F.col("_n") + 0.5)).select(*df.columns)


def two_tier_lookup(df: DataFrame, ref: DataFrame, fine: Sequence[str], coarse: str, value: str) -> DataFrame:
    """``df`` with ``value`` and ``tier`` from ``ref``: tier 1 by all of ``fine``, else tier 2 by ``coarse`` alone, where
    all reference rows of the key agree on the value; tier 0 and null if neither holds."""
    agreed = lambda keys: ref.groupBy(*keys).agg(F.min(value).alias("_v"), F.countDistinct(value).alias("_k")).where("_k = 1").drop("_k")
    d = df.join(agreed(fine).withColumnRenamed("_v", "_v1"), list(fine), "left").join(agreed([coarse]).withColumnRenamed("_v", "_v2"), coarse, "left")
    return d.select(*df.columns, F.coalesce("_v1", "_v2").alias(value), F.when(F.col("_v1").isNotNull(), 1).when(F.col("_v2").isNotNull(), 2).otherwise(0).alias("tier"))


def derived(df: DataFrame, ratios: dict[str, tuple[str, str]] | None = None, logs: dict[str, str] | None = None, clips: dict[str, tuple[str, float, float]] | None = None, floor: float = 1e-9) -> DataFrame:
    """``df`` with ratios {out: (over, under)}, base-10 logarithms {out: column} (both of values raised to ``floor``) and
    clipped columns {out: (column, low, high)}; a null stays null."""

    def raised(c: str):
        return F.when(F.col(c).isNotNull(), F.greatest(F.col(c).cast("double"), F.lit(floor)))

    def clipped(c: str, lo: float, hi: float):
        return F.when(F.col(c).isNotNull(), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), F.col(c).cast("double"))))

    new = {o: F.col(a) / raised(b) for o, (a, b) in (ratios or {}).items()} | {o: F.log10(raised(c)) for o, c in (logs or {}).items()}
    return df.withColumns(new | {o: clipped(*c) for o, c in (clips or {}).items()})


def rename_prefix(df: DataFrame, prefix: str, to: str = "") -> DataFrame:
    """``df`` with the prefix of its column names replaced; raises ValueError if two names would then be equal."""
    names = [to + c[len(prefix) :] if c.startswith(prefix) else c for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"replacing {prefix!r} by {to!r} makes two columns of one name")
    return df.toDF(*names)
