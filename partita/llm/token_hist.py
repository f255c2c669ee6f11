"""Exact length histogram: documents aggregated by encoded length; suffix sums answer every context limit.

The histogram has a row per distinct length, so it grows with the longest document, not with the corpus. Null texts
count as empty documents of length 0 (plus the end id, where one is set). An empty table gives an empty histogram.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import MEMO_CHUNKS, encoder, tokenizer_path
from .common import documents, map_rows, only, written

#: Lengths per block of the two-level running sums.
BLOCK = 256


def token_lengths(docs: DataFrame, tokenizer: str | None = None, extra: int = 0, keep: tuple[str, ...] = ("doc_id",), memo_chunks: int = MEMO_CHUNKS) -> DataFrame:
    """``keep`` columns and n_tokens of every whole text; ``extra`` ids are added to each document. ``memo_chunks`` bounds
    what a worker remembers, about 300 bytes a chunk."""
    path = tokenizer or tokenizer_path()
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(b: pa.RecordBatch) -> dict:
        ids = encoder(path, memo_chunks).encode([t or "" for t in b.column("text").to_pylist()])
        return {k: b.column(k) for k in keep} | {"n_tokens": [len(x) // 4 + extra for x in ids]}

    return map_rows(only(docs, *keep, "text"), run, "".join(f"`{k}` {fields[k]}, " for k in keep) + "n_tokens long", keeps_cache=True)


def length_histogram(docs: DataFrame, tokenizer: str | None = None, extra: int = 0) -> DataFrame:
    """length, n_docs: how many documents have each encoded length."""
    return token_lengths(docs, tokenizer, extra, keep=()).groupBy(F.col("n_tokens").alias("length")).agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """Add, per length L: docs_ge and tokens_ge (documents of at least L ids, and their ids), docs_le and tokens_le,
    and truncated_total (ids that remain when every document is cut to L).

    Sums run in blocks of lengths, then over the blocks' totals, so no task holds all lengths.
    """
    h = hist.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("tokens"), F.floor(F.col("length") / BLOCK).alias("block"))
    b = h.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy()
    b = b.select(
        "block",
        F.coalesce(F.sum("bd").over(later), F.lit(0)).alias("after_docs"),
        F.coalesce(F.sum("bt").over(later), F.lit(0)).alias("after_tokens"),
        F.sum("bd").over(total).alias("all_docs"),
        F.sum("bt").over(total).alias("all_tokens"),
    )
    w = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    s = h.join(b, "block").select(
        "length", "n_docs", "tokens", "all_docs", "all_tokens",
        (F.col("after_docs") + F.sum("n_docs").over(w)).alias("docs_ge"),
        (F.col("after_tokens") + F.sum("tokens").over(w)).alias("tokens_ge"),
    )
    return s.select(
        "length", "n_docs", "tokens", "docs_ge", "tokens_ge",
        (F.col("all_docs") - F.col("docs_ge") + F.col("n_docs")).alias("docs_le"),
        (F.col("all_tokens") - F.col("tokens_ge") + F.col("tokens")).alias("tokens_le"),
        (F.col("all_tokens") - F.col("tokens_ge") + F.col("length") * F.col("docs_ge")).alias("truncated_total"),
    )


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """One row, total: the ids that remain when each document is cut to ``limit``, for any limit, from the sums alone."""
    up = sums.where(F.col("length") >= limit).orderBy("length").limit(1).select((F.col("tokens_le") - F.col("tokens") + F.lit(limit) * F.col("docs_ge")).alias("total"))
    rest = sums.agg(F.max("tokens_le").alias("total"))
    return up.unionByName(rest).agg(F.coalesce(F.min("total"), F.lit(0)).alias("total"))


def length_quantile(sums: DataFrame, q: float) -> DataFrame:
    """One row, length: the smallest length that at least the share ``q`` of documents do not exceed."""
    n = F.max("docs_le").over(Window.partitionBy())
    return sums.withColumn("n", n).where(F.col("docs_le") >= F.ceil(F.lit(q) * F.col("n"))).agg(F.min("length").alias("length"))


def op8_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram with its suffix sums over every whole document; the end id counts."""
    return suffix_sums(written(length_histogram(documents(spark, sf_dir), extra=1), "length-histogram"))
