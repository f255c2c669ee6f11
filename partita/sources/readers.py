"""Readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None, encoding: str = "UTF-8", null: str = "") -> DataFrame:
    """A CSV with a header. Without a schema all columns are strings: no pass over the data to guess types."""
    r = spark.read.option("header", True).option("encoding", encoding).option("nullValue", null).option("escape", '"')
    return (r.schema(schema) if schema else r).csv(path)


def read_json_split(spark: SparkSession, path: str) -> DataFrame:
    """A document of ``columns``, ``index`` and ``data`` (rows as arrays) as a table of strings, with ``index``."""
    names = spark.read.option("multiLine", True).json(path).select("columns").first()[0]
    kind = "columns array<string>, index array<long>, data array<array<string>>"
    d = spark.read.schema(kind).option("multiLine", True).option("primitivesAsString", True).json(path)
    rows = d.select(F.posexplode("data").alias("pos", "row"), "index")
    return rows.select(F.col("index")[F.col("pos")].alias("index"), *(F.col("row")[i].alias(n) for i, n in enumerate(names)))


def read_precomputed(splits: DataFrame, key: str, split: str, codes: dict[str, int]) -> DataFrame:
    """key, fold of an external split, -1 for names without a code and for nulls."""
    m = F.create_map(*(F.lit(x) for kv in codes.items() for x in kv))
    return splits.select(key, F.coalesce(m[F.col(split)], F.lit(-1)).cast("int").alias("fold"))


def read_edges(df: DataFrame, src: str = "src", dst: str = "dst", val: str = "val", symmetric: bool = True) -> DataFrame:
    """An edge table without loops or nulls; with ``symmetric``, both directions of every edge (the larger value wins)."""
    e = df.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"), F.col(val).cast("double").alias("val")).where("src <> dst and val is not null")
    if symmetric:
        e = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "val"))
    return e.groupBy("src", "dst").agg(F.max("val").alias("val"))


def read_arrays(spark: SparkSession, x, w=None, y=None, first_id: int = 0, rows: int = 100_000) -> DataFrame:
    """obs_id, x, w and, if given, y of matrices or lists in the driver's memory, sent as Arrow in slices of ``rows`` rows.
    w is 1 where it is not given. Raises ValueError if lengths differ or ``x`` is not a matrix."""
    import numpy as np
    import pyarrow as pa

    x = np.asarray(x, dtype="float64")
    if x.ndim != 2 or any(v is not None and len(v) != len(x) for v in (w, y)):
        raise ValueError("x is a matrix; w and y have a value for each of its rows")
    w = np.ones(len(x)) if w is None else np.asarray(w, dtype="float64")
    out = None
    for i in range(0, max(len(x), 1), rows):
        part = x[i : i + rows]
        cols = {"obs_id": pa.array(np.arange(first_id + i, first_id + i + len(part)), pa.int64()), "x": pa.array(list(part), pa.list_(pa.float64())), "w": pa.array(w[i : i + rows], pa.float64())}
        if y is not None:
            cols["y"] = pa.array(np.asarray(y, dtype="float64")[i : i + rows], pa.float64())
        d = spark.createDataFrame(pa.table(cols))
        out = d if out is None else out.unionByName(d)
    return out


def read_sparse(spark: SparkSession, rows, cols, vals, symmetric: bool = True) -> DataFrame:
    """An edge table of a sparse matrix's coordinates (three sequences of one length), as :func:`read_edges` makes it."""
    import numpy as np
    import pyarrow as pa

    d = pa.table({"src": pa.array(np.asarray(rows), pa.int64()), "dst": pa.array(np.asarray(cols), pa.int64()), "val": pa.array(np.asarray(vals, dtype="float64"), pa.float64())})
    return read_edges(spark.createDataFrame(d), symmetric=symmetric)
