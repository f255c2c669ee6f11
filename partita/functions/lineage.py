"""Tables written between steps, and broadcasts of a counted size."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which :func:`small` broadcasts a table.
BROADCAST_ROWS = 500_000


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write an iteration's table to the cluster's checkpoint folder, so that later rounds don't repeat it.

    Where ``spark.checkpoint.dir`` is unset a local session gets a folder of its own; a cluster has to name one.
    """
    spark = df.sparkSession
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="partita-")
        spark.conf.set("spark.checkpoint.dir", path)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return df.checkpoint()


def small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if its rows, counted first, are few; else it is joined by shuffling."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def release(spark: SparkSession) -> None:
    """Have the shuffle files of frames that nothing refers to any more deleted; else they stay until the driver happens to
    collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
