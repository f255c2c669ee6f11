"""Conflict-constrained best-fit packing of documents into sequences of fixed capacity.

Open bins stand in order of what is free in them. Each bin carries two bitmaps, of the sources and of the duplicate
clusters that it holds. A piece goes into the bin with the least free room that takes it and shares neither source nor
cluster with it: the search begins at the tightest bin that has room and goes on to its successors until one is
compatible; if none is, a new bin opens.

Pieces are packed longest first, in shards. A shard is a bounded number of documents, dealt out by a hash of the row's
place in the written table of lengths, so no source, cluster or group of repeated rows is in one task; within a shard the
result is exactly that of best-fit with these conflicts.

Clusters are the caller's, as by :func:`partita.llm.ngram_join.components`; by default equal texts are one cluster.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import MEMO_CHUNKS
from .common import documents, mix, written
from .token_hist import token_lengths

CAPACITY = 4096
#: Documents of a shard, on average: what one task packs at a time.
SHARD_DOCS = 4096


def pack(pieces: Iterable[tuple[int, int, int]], capacity: int) -> list[int]:
    """Bin numbers of pieces (length, source, cluster), in their order; lengths must be 1 to capacity.

    Sources and clusters are small numbers: each is a bit of a bin's two bitmaps. Of equally tight bins the oldest wins.

    Open bins are kept by (free, number). Bisection finds the tightest with room; from there the walk goes on, bin by bin,
    as far as bitmaps conflict, at most over the bins of a shard.
    """
    open_bins: list[tuple[int, int]] = []  # (free, number), ascending
    sources: list[int] = []
    clusters: list[int] = []
    out = []
    for length, source, cluster in pieces:
        s, c = 1 << source, 1 << cluster
        at = bisect_left(open_bins, (length, -1))
        while at < len(open_bins):
            number = open_bins[at][1]
            if not sources[number] & s and not clusters[number] & c:
                break
            at += 1
        if at < len(open_bins):
            free, number = open_bins.pop(at)
            sources[number] |= s
            clusters[number] |= c
        else:
            free, number = capacity, len(sources)
            sources.append(s)
            clusters.append(c)
        if free > length:
            insort(open_bins, (free - length, number))
        out.append(number)
    return out


def best_fit(docs: DataFrame, capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Pack ``docs`` (doc_id, n_tokens, source, cluster); returns doc_id, piece, piece_tokens, shard, bin, bin_id.

    A document longer than the capacity is cut into whole bins of its own and one remaining piece. Documents without
    tokens, or with a null length, get one piece of length 0 in no bin (bin_id null). A null source or cluster conflicts
    with nothing. Repeated rows are documents of their own, spread over the shards; a null doc_id is packed like any
    other. Documents of one length are packed by doc_id, null last. bin_id is ``shard:bin``; whole-bin pieces have bins of
    their own. Other columns are ignored. An empty table gives an empty result. ``docs`` should be a stored table: a
    row's shard follows from its place there.
    """
    n = docs.count()
    shards = max(1, math.ceil(n / shard_docs))
    d = docs.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"), F.col("source").cast("string").alias("source"), F.col("cluster").cast("string").alias("cluster"))
    d = d.withColumn("shard", F.pmod(mix(F.monotonically_increasing_id(), 17), F.lit(shards)).cast("int"))
    out = T.StructType.fromDDL("doc_id long, piece int, piece_tokens long, shard int, bin long")

    def run(key, pdf):
        rows = pdf.sort_values(["n_tokens", "doc_id", "source", "cluster"], ascending=[False, True, True, True], kind="stable")
        names = [{x: i for i, x in enumerate(rows[c].dropna().unique())} for c in ("source", "cluster")]
        done: list[tuple] = []
        rest: list[tuple] = []
        for doc_id, length, source, cluster in rows[["doc_id", "n_tokens", "source", "cluster"]].itertuples(index=False, name=None):
            whole, left = divmod(length, capacity)
            done += [(doc_id, i, capacity, "whole") for i in range(whole)]
            if left:
                rest.append((left, doc_id, whole, source, cluster))
            elif not whole:
                done.append((doc_id, 0, 0, None))
        rest.sort(key=lambda r: -r[0])
        free = [len(n) for n in names]
        keys = []
        for left, _, _, source, cluster in rest:
            bits = []
            for k, x in enumerate((source, cluster)):
                b = names[k].get(x)
                if b is None:  # a null has a bit of its own
                    b, free[k] = free[k], free[k] + 1
                bits.append(b)
            keys.append((left, *bits))
        bins = pack(keys, capacity)
        rows_out = [(r[1], r[2], r[0], b) for r, b in zip(rest, bins)]
        top = max(bins, default=-1) + 1
        for doc_id, piece, size, kind in done:
            rows_out.append((doc_id, piece, size, top if kind else None))
            top += kind is not None
        res = pd.DataFrame(rows_out, columns=["doc_id", "piece", "piece_tokens", "bin"])
        return res.assign(shard=key[0], bin=res["bin"].astype("Int64"), doc_id=res["doc_id"].astype("Int64"))[["doc_id", "piece", "piece_tokens", "shard", "bin"]]

    packed = d.groupBy("shard").applyInPandas(run, out)
    return packed.withColumn("bin_id", F.concat_ws(":", "shard", F.col("bin").cast("string"))).withColumn("bin_id", F.when(F.col("bin").isNotNull(), F.col("bin_id")))


def duplicate_cluster(text):
    """A cluster key of equal texts; null and blank texts have none."""
    return F.when(F.length(F.trim(text)) > 0, F.md5(text))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS, memo_chunks: int = MEMO_CHUNKS, clusters: DataFrame | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text, source) with an end id each and pack them; other columns are ignored.

    ``clusters`` (doc_id, component_id) gives duplicate clusters; documents that it lacks, or has with a null, conflict
    with no cluster, and of several rows for a doc_id the smallest component counts. Without it equal texts are one
    cluster. Null and empty texts have the end id alone and no cluster.
    """
    keyed = docs.select("doc_id", "text", "source", duplicate_cluster(F.col("text")).alias("cluster"))
    lengths = written(token_lengths(keyed, extra=1, keep=("doc_id", "source", "cluster"), memo_chunks=memo_chunks), "packing-lengths")
    if clusters is not None:
        given = clusters.where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").cast("string").alias("cluster"))
        lengths = written(lengths.drop("cluster").join(given, "doc_id", "left"), "packing-clusters")
    return best_fit(lengths, capacity, shard_docs)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document's place in a bin; equal texts are one cluster."""
    return pack_documents(documents(spark, sf_dir))
