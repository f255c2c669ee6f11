"""Connected components of an edge table, by minimum labels and pointer jumping; each round is written, nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` has a and b (long); returns v and label, the smallest vertex of v's component, for each vertex of an edge.

    Null ends and loops are no edges. An empty table has no vertices. Each round a label moves to all neighbours and then
    twice as far along labels, so rounds grow with the logarithm of the longest path that labels take.
    """
    e = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = written(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = written(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "cc-labels")
    while True:
        near = both.join(labels, both.b == labels.v).groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        moved = labels.join(near, "v", "left").select("v", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("v").alias("label"), F.col("label").alias("up"))
        jumped = moved.join(up, "label", "left").select("v", "old", F.least("label", "up").alias("label"))
        new = written(jumped, "cc-labels")
        done = new.where("old <> label").isEmpty()
        discard(labels)
        path = new._partita_path
        labels = new.select("v", "label")
        labels._partita_path = path
        if done:
            discard(both)
            return labels
