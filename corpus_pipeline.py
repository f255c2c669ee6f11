"""Corpus pipeline: quality rules, line dedup, n-gram Jaccard join, PII and best-fit packing, each on what the one before kept.

Every stage but the last returns the columns of ``documents``; n_chars follows the text. Null texts fail the quality rules.
Rows that share a doc_id are one document to the Jaccard join and stay or go together. An empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partita.llm import line_template, ngram_join, packing, pii, quality_crf
from partita.llm.common import small, written


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep."""
    return quality_crf.keep(docs, quality_crf.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; one that has nothing else goes, as its lines stay in the first that has them."""
    out = line_template.dedup_lines(docs).where("n_dropped = 0 or length(trim(text)) > 0")
    return _measured(out.select(*docs.columns))


def join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group that five-word shingles link at 0.8 or more."""
    groups = written(ngram_join.components(docs, k=5, num=80, den=100).where("doc_id <> component_id").select("doc_id").distinct(), "pipeline-copies")
    return docs.join(small(groups), "doc_id", "left_anti").select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return _measured(pii.redact(docs, pii.fit(docs)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's place in a bin. The encoder's memo is small, as executors still hold what earlier stages left."""
    return packing.pack_documents(docs, memo_chunks=120_000)


STAGES = [("quality", quality_stage), ("lines", line_stage), ("near_copies", join_stage), ("pii", pii_stage), ("packing", packing_stage)]

#: SQL can't express these stages (a trained chain, a trained classifier, a search over bins); tests hold them against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
