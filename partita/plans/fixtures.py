"""The engine's input tables, derived from the star schema, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rng import hash_int

#: Share of fold 0, as a bound on the hash.
_CUT = 3435973837


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def fold_of(key: Column, seed: int = 42) -> Column:
    return F.when(hash_int(key, seed) < _CUT, 0).otherwise(1).cast("int")


def sql_hash(key: str, seed: int = 42) -> str:
    return f"('0x' || substr(md5('{seed}:' || ({key})), 1, 8))::BIGINT"


def sql_fold(key: str, seed: int = 42) -> str:
    return f"(CASE WHEN {sql_hash(key, seed)} < {_CUT} THEN 0 ELSE 1 END)"


def customers(spark: SparkSession, d: str) -> DataFrame:
    """obs_id, nation, region, cls, y, w, fold."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("c_custkey").alias("obs_id"), F.col("c_nationkey").cast("long").alias("nation"), F.col("n_regionkey").cast("long").alias("region"), F.col("c_mktsegment").alias("cls"),
        F.col("c_acctbal").alias("y"), (1.0 + F.col("c_custkey") % 3).alias("w"), fold_of(F.col("c_custkey")).alias("fold"),
    )


CUSTOMERS = f"customers AS (SELECT c_custkey AS obs_id, c_nationkey::BIGINT AS nation, n_regionkey::BIGINT AS region, c_mktsegment AS cls, c_acctbal AS y, (1 + c_custkey % 3)::DOUBLE AS w, {sql_fold('c_custkey')} AS fold FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def parts(spark: SparkSession, d: str) -> DataFrame:
    """obs_id, brand, kind, size, y, w, fold."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("obs_id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("y"), (1.0 + F.col("p_partkey") % 3).alias("w"), fold_of(F.col("p_partkey")).alias("fold"))


PARTS = f"parts AS (SELECT p_partkey AS obs_id, p_brand AS brand, p_type AS kind, p_size::DOUBLE AS size, p_retailprice AS y, (1 + p_partkey % 3)::DOUBLE AS w, {sql_fold('p_partkey')} AS fold FROM part)"


def orders(spark: SparkSession, d: str) -> DataFrame:
    """obs_id, entity, cls, y, w, fold."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("obs_id"), F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("cls"), F.col("o_totalprice").alias("y"), (1.0 + F.col("o_orderkey") % 3).alias("w"), fold_of(F.col("o_orderkey")).alias("fold"))


ORDERS = f"ords AS (SELECT o_orderkey AS obs_id, o_custkey AS entity, o_orderpriority AS cls, o_totalprice AS y, (1 + o_orderkey % 3)::DOUBLE AS w, {sql_fold('o_orderkey')} AS fold FROM orders)"


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """left_id, right_id, w, y, fold: two-entity observations."""
    g = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("left_id"), F.col("l_suppkey").alias("right_id")).agg(F.count("*").cast("double").alias("w"), F.avg("l_quantity").alias("y"))
    return g.withColumn("fold", fold_of(F.concat_ws("-", "left_id", "right_id")))


PAIRS = f"prs AS (SELECT *, {sql_fold("left_id || '-' || right_id")} AS fold FROM (SELECT l_partkey AS left_id, l_suppkey AS right_id, count(*)::DOUBLE AS w, avg(l_quantity) AS y FROM lineitem GROUP BY 1, 2))"


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """obs_id, x, cls, w, fold."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("obs_id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").alias("cls"), (1.0 + F.col("vec_id") % 3).alias("w"), fold_of(F.col("vec_id")).alias("fold"))


VECTORS = f"vecs AS (SELECT vec_id AS obs_id, embedding::DOUBLE[] AS x, label AS cls, (1 + vec_id % 3)::DOUBLE AS w, {sql_fold('vec_id')} AS fold FROM embeddings)"
