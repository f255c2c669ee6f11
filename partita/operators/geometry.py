"""Out-of-distribution metrics in two dimensions, and how well features give a row's group away."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def convex_hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners of the hull, counter-clockwise (monotone chain)."""
    p = sorted(set(points))
    if len(p) < 3:
        return p

    def half(seq):
        out: list = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return half(p) + half(p[::-1])


def training_hull(df: DataFrame, train: int = 0) -> list[tuple[float, float]]:
    """The hull of training rows (fold, u, v): each task sends on the corners of its own rows only."""

    def run(batches):
        corners: list = []
        for b in batches:
            corners = convex_hull(corners + list(zip(b["u"].tolist(), b["v"].tolist())))
        yield pd.DataFrame(corners, columns=["u", "v"])

    part = df.where((F.col("fold") == train) & F.col("u").isNotNull() & F.col("v").isNotNull()).select("u", "v").mapInPandas(run, "u double, v double")
    return convex_hull([(r.u, r.v) for r in part.collect()])


def outside_hull_rate(df: DataFrame, test: int = 1, train: int = 0) -> DataFrame:
    """One row, rate: the share of test rows outside the training rows' hull; all are outside a degenerate one."""
    h = training_hull(df, train)
    t = df.where(F.col("fold") == test)
    if len(h) < 3:
        return t.agg(F.when(F.count("*") > 0, F.lit(1.0)).alias("rate"))
    inside = F.lit(True)
    for (ax, ay), (bx, by) in zip(h, h[1:] + h[:1]):
        inside = inside & ((F.lit(bx - ax) * (F.col("v") - ay) - F.lit(by - ay) * (F.col("u") - ax)) >= -1e-12)
    return t.agg(F.avg(F.when(inside, 0.0).otherwise(1.0)).alias("rate"))


def hull_overlap(df: DataFrame) -> DataFrame:
    """One row, iou: area shared by the two folds' hulls over their joint area; a substitute for concave outlines."""
    a, b = training_hull(df, 0), training_hull(df, 1)
    area = lambda p: abs(sum(x * w - z * y for (x, y), (z, w) in zip(p, p[1:] + p[:1]))) / 2 if len(p) > 2 else 0.0
    cut = list(a)
    for (ax, ay), (bx, by) in zip(b, b[1:] + b[:1]) if len(b) > 2 else ():
        side = lambda q: (bx - ax) * (q[1] - ay) - (by - ay) * (q[0] - ax)  # noqa: B023, E731
        out = []
        for p, q in zip(cut, cut[1:] + cut[:1]):
            sp, sq = side(p), side(q)
            if sp >= 0:
                out.append(p)
            if sp * sq < 0:
                f = sp / (sp - sq)
                out.append((p[0] + f * (q[0] - p[0]), p[1] + f * (q[1] - p[1])))
        cut = out
    both = area(cut) if len(b) > 2 else 0.0
    every = area(a) + area(b) - both
    return df.sparkSession.createDataFrame([(both / every if every else 0.0,)], "iou double")


def group_identifiability(df: DataFrame, group: str, folds: int = 3, trees: int = 20, seed: int = 5) -> DataFrame:
    """One row, accuracy: cross-validated accuracy of a random forest that guesses ``group`` from x."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.functions import array_to_vector

    from .baselines import kfold

    d = kfold(df.drop("fold"), group, folds).withColumn("_v", array_to_vector("x"))
    d = StringIndexer(inputCol=group, outputCol="_label").fit(d).transform(d)
    rf = RandomForestClassifier(labelCol="_label", featuresCol="_v", numTrees=trees, seed=seed)
    score = MulticlassClassificationEvaluator(labelCol="_label", metricName="accuracy")
    got = [score.evaluate(rf.fit(d.where(F.col("fold") != k)).transform(d.where(F.col("fold") == k))) for k in range(folds)]
    return df.sparkSession.createDataFrame([(sum(got) / folds,)], "accuracy double")
