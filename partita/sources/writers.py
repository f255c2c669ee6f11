"""Writers. All go through Spark, so paths may be in any store that it knows."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..operators.folds import fold_wide


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    w = df.write.mode("overwrite")
    w.option("header", True).csv(path) if kind == "csv" else w.format(kind).save(path)


def write_assignment(df: DataFrame, path: str, kind: str = "csv") -> None:
    """obs_id and fold."""
    write_table(df.select("obs_id", "fold"), path, kind)


def write_wide(assignments: DataFrame, configs: Sequence[str], path: str, kind: str = "parquet") -> None:
    """One fold column for each configuration of (config_id, obs_id, fold)."""
    write_table(fold_wide(assignments, configs), path, kind)


def write_metadata(spark: SparkSession, meta: dict, path: str) -> None:
    """A JSON document on one line."""
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
