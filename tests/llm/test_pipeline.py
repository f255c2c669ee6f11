"""The pipeline's stages against brute-force versions, on the smallest tables."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from partita.llm import ngram_join, pii, quality_crf
from partita.llm.common import written

from .test_training import DOC, brute_components, docs_of

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_stages_take_effect_and_keep_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    kept = written(corpus_pipeline.quality_stage(spark, docs, DATA), "t")
    model = quality_crf.train(docs, labels)
    want = {r.doc_id for r in docs.collect() if quality_crf.judge(r.text or "", model)[-1]}
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == docs.columns

    lines = written(corpus_pipeline.line_stage(spark, kept, DATA), "t")
    assert lines.columns == docs.columns and lines.where("n_chars <> length(text)").count() == 0

    rows = sorted(lines.collect())
    _, comp = brute_components([r.text for r in rows], 5, 80, 100)
    joined = written(corpus_pipeline.join_stage(spark, lines, DATA), "t")
    assert {r.doc_id for r in joined.collect()} == {r.doc_id for i, r in enumerate(rows) if comp[i] == i}

    clean = written(corpus_pipeline.pii_stage(spark, joined, DATA), "t")
    assert clean.columns == docs.columns and clean.count() == joined.count()
    assert not any(pii.base_and_rejected(r.text)[0] for r in clean.collect() if r.text)

    packed = corpus_pipeline.packing_stage(spark, clean, DATA).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in clean.collect()}
    whole = corpus_pipeline.run(spark, DATA)
    assert sorted((r.doc_id, r.piece, r.piece_tokens) for r in whole.collect()) == sorted((r.doc_id, r.piece, r.piece_tokens) for r in packed)


def test_stages_of_an_empty_table_and_odd_rows(spark, tmp_path):
    d = f"file://{tmp_path}"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    for table in (docs_of(spark, []), spark.createDataFrame([(None, None, None, None, None), (1, "", None, None, None), (1, "a b c d e f g h i j k l", None, "s", 1), (1, "a b c d e f g h i j k l", None, "s", 1)], DOC)):
        cur = table.withColumn("n", F.lit(1))
        for _, stage in corpus_pipeline.STAGES[:-1]:
            cur = written(stage(spark, cur, d), "t")
            assert cur.columns == [*table.columns, "n"]
        corpus_pipeline.STAGES[-1][1](spark, cur, d).count()


def test_rows_of_one_group_leave_its_first(spark):
    text = " ".join(f"w{i}" for i in range(60))
    d = docs_of(spark, [text, text, text + " more", "other words here entirely"])
    assert [r.doc_id for r in corpus_pipeline.join_stage(spark, d, "").orderBy("doc_id").collect()] == [0, 3]
    assert ngram_join.components(d, 5, 80, 100).where("doc_id <> component_id").count() == 2
