"""Helpers that the training-data operators share: the shared work folder, written tables, Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch of whole texts. Bounds a Python worker's memory whatever the session's default is.
TEXT_BATCH_ROWS = 400


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one set here where it is unset (local tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="partita-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_dir(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/partita/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_dir(spark, tag)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._partita_path = path
    return back


def discard(*frames: DataFrame) -> None:
    """Delete tables made by :func:`written` that nothing reads any more, and let Spark drop the shuffle files of finished
    steps: it does so when the driver's garbage is collected, which a large heap may put off until disks are full."""
    for df in frames:
        df.sparkSession.sparkContext._jvm.System.gc()
        break
    for df in frames:
        path = getattr(df, "_partita_path", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def text_batches(spark: SparkSession, rows: int = TEXT_BATCH_ROWS) -> None:
    """Bound the rows of an Arrow batch in this session, as texts may be very long."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


_cache: dict = {}


def cached(key, make: Callable[[], object]):
    """A worker's one large cache, kept from task to task while tasks ask for the same key."""
    if key not in _cache:
        drop_cache()
        _cache[key] = make()
    return _cache[key]


def drop_cache() -> None:
    """Free the cache that an earlier stage left in this worker, which serves all stages in turn."""
    if _cache:
        _cache.clear()
        gc.collect()
        trim()


def trim() -> None:
    """Hand freed memory back, so that idle workers don't hold what their last batches took."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc can do so on demand
        ctypes.CDLL(None).malloc_trim(0)


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, list] | None], schema: str, keeps_cache: bool = False) -> DataFrame:
    """``mapInArrow`` with a function from a batch to columns; ``schema`` is Spark DDL. ``keeps_cache``: the function uses
    :func:`cached`."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    text_batches(df.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps_cache:
            drop_cache()
        for b in batches:
            if b.num_rows:
                out = fn(b)
                yield pa.RecordBatch.from_arrays([_array(out[f.name], f.type) for f in arrow], schema=arrow)
        trim()

    return df.mapInArrow(run, schema)


def _array(values, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, type=kind)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that extra columns can't clash."""
    return df.select(*(F.col(f"`{n}`") for n in names))


def mix(c: Column, seed: int) -> Column:
    return F.xxhash64(c, F.lit(seed))


#: Rows up to which :func:`small` broadcasts a table of ids or short lists.
BROADCAST_ROWS = 500_000


def small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if its rows, counted first, are few; else it is joined by shuffling."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
