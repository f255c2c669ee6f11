"""Token files' sizes, and packing with clusters, hot ids and a plain version of each shard."""

import collections
import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from partita.llm import ngram_join, packing, token_output
from partita.llm.common import new_dir, written

from .test_training import docs_of, naive_pack, prose


def test_files_follow_the_bytes_also_within_one_hot_id(spark):
    rng = random.Random(1)
    texts = [prose(rng, 150) for _ in range(900)]
    ids = [None if i % 3 == 0 else 7 if i % 3 == 1 else i for i in range(900)]
    total = sum(len(t) + token_output.ROW_BYTES for t in texts)
    d = docs_of(spark, texts, ids).withColumn("place", F.lit(0)).withColumn("n", F.lit(0))
    files = written(token_output.write_token_files(d, new_dir(spark, "t"), file_bytes=total // 10), "t")
    assert 8 <= files.count() <= 11 and files.agg(F.max("n_docs")).first()[0] < 200
    rows = sorted(token_output.read_token_files(files).collect(), key=lambda r: r.start)
    assert [r.start for r in rows] == list(itertools.accumulate([0, *(r.n_tokens for r in rows)]))[:-1]
    assert [r.doc_id for r in rows] == [None] * 300 + [2, 5] + [7] * 300 + [i for i in range(8, 900) if i % 3 == 2]
    more = written(token_output.write_token_files(d.unionByName(d), new_dir(spark, "t"), file_bytes=total // 10), "t")
    assert 17 <= more.count() <= 21


def test_long_documents_close_together_fill_more_files(spark):
    rng = random.Random(2)
    texts = [prose(rng, 2000 if i < 30 else 10) for i in range(600)]
    files = written(token_output.write_token_files(docs_of(spark, texts), new_dir(spark, "t"), files=8), "t").toPandas()
    assert files["n_tokens"].max() < 2.2 * files["n_tokens"].sum() / 8


def test_a_shard_is_packed_as_by_the_plain_version(spark):
    rng = random.Random(3)
    rows = [(i, rng.randint(1, 60), f"s{rng.randint(0, 5)}", f"c{rng.randint(0, 30)}") for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, n_tokens long, source string, cluster string")
    by = collections.defaultdict(list)
    for r in packing.best_fit(d, capacity=64, shard_docs=100).collect():
        by[r.shard].append(r)
    assert len(by) == 4
    for placed in by.values():
        order = sorted(placed, key=lambda r: (-r.piece_tokens, r.doc_id))
        want = naive_pack([(r.piece_tokens, rows[r.doc_id][2], rows[r.doc_id][3]) for r in order], 64)
        assert [r.bin for r in order] == want


def test_repeated_rows_of_one_id_are_spread_over_shards(spark):
    d = spark.createDataFrame([(None, 5, "s", "c")] * 2000 + [(1, 5, "s", "c")] * 2000, "doc_id long, n_tokens long, source string, cluster string")
    sizes = packing.best_fit(d, capacity=64, shard_docs=250).groupBy("shard").count().toPandas()["count"]
    assert len(sizes) == 16 and sizes.max() < 400 and sizes.sum() == 4000


def test_near_copies_share_no_bin(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(12):
        w = prose(rng, 60).split()
        for _ in range(3):
            texts.append(" ".join([*w[:-1], prose(rng, 1)]))
    d = docs_of(spark, texts).withColumn("source", F.col("doc_id").cast("string")).withColumn("cluster", F.lit("x"))
    groups = ngram_join.components(d, 5, 80, 100)
    out = packing.pack_documents(d, capacity=4096, clusters=groups).collect()
    bins = collections.defaultdict(list)
    for r in out:
        bins[r.bin_id].append(r.doc_id // 3)
    assert len(bins) == 3 and all(len(v) == len(set(v)) for v in bins.values())
    assert len({r.bin_id for r in packing.pack_documents(d, capacity=4096).collect()}) < 3
