"""Language identification by rank-order profiles.

A profile is the list of the ``TOP`` most frequent character n-grams (n = 1 to 3, within words padded by a space, letters
lower-cased). A document's profile is compared with each language's by the out-of-place distance: the sum, over the
document's n-grams, of how far their ranks lie apart, ``TOP`` for an n-gram that the language's profile lacks.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, drop_cache, map_rows, only, text_batches

TOP = 300
#: Counts that a learning task holds before it passes them on.
HELD = 2_000_000
_other = re.compile(r"[\W\d_]+")
_BITS = 21


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams (three code points of 21 bits, missing ones 0) and how often each occurs; none without a letter."""
    s = _other.sub(" ", text).lower().strip(" ")
    if not any(map(str.isalpha, s)):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = np.frombuffer(f" {s} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    two = (c[:-1] << _BITS) | c[1:]
    three = (two[:-1] << _BITS) | c[2:]
    return np.unique(np.concatenate([c[c != 32], two, three[c[1:-1] != 32]]), return_counts=True)


def profile(codes: np.ndarray, counts: np.ndarray, top: int = TOP) -> np.ndarray:
    """The codes of the most frequent n-grams, most frequent first, ties to the smaller code."""
    if len(codes) > top:
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        pick = counts >= least
        codes, counts = codes[pick], counts[pick]
    return codes[np.lexsort((codes, -counts))][:top]


def learn(docs: DataFrame, top: int = TOP) -> dict[str, np.ndarray]:
    """Language profiles from all rows of ``docs`` (text, lang) with a language and a letter.

    Each task adds its n-grams' counts up before the shuffle, and passes them on whenever ``HELD`` are held, so its memory
    does not follow its rows; what reaches the driver is ``top`` rows a language. Repeated rows count as often as they
    come; ties go to the smaller code; very long texts count whole. Other columns are ignored. Nothing to learn from
    gives no profiles.
    """
    src = only(docs.where("lang is not null and text is not null"), "text", "lang")
    text_batches(src.sparkSession)

    def run(batches):
        drop_cache()
        held: dict[str, list] = {}
        size = 0

        def out():
            for lang, parts in held.items():
                codes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                n = np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)
                for k in range(0, len(codes), 50_000):
                    part = codes[k : k + 50_000]
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(part)), "code": pa.array(part), "n": pa.array(n[k : k + 50_000])})

        for b in batches:
            for t, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
                codes, n = ngram_counts(t)
                if len(codes):
                    held.setdefault(lang, []).append((codes, n))
                    size += len(codes)
                if size > HELD:
                    yield from out()
                    held, size = {}, 0
        yield from out()

    counts = src.mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    rows = counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("lang", "code", "rank").collect()
    out: dict[str, list] = {}
    for lang, code, rank in rows:
        out.setdefault(lang, []).append((rank, code))
    return {lang: np.array([c for _, c in sorted(out[lang])], np.int64) for lang in sorted(out)}


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], top: int = TOP, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``extra`` columns, lang_pred and score (1 less the distance as a share of the largest possible).

    Null texts, texts without a letter, and all texts where nothing was learned give ``und`` with score 0. Ties between
    languages go to the first by name. Repeated rows each give a row; a null doc_id stays null; texts count whole. Columns
    beyond doc_id, text and ``extra`` are ignored, whatever their names. An empty table gives an empty result.
    """
    langs = list(profiles)
    every = np.unique(np.concatenate([*profiles.values(), np.zeros(0, np.int64)]))
    ranks = np.full((len(langs), len(every) + 1), -1, np.int64)
    for i, name in enumerate(langs):
        ranks[i, np.searchsorted(every, profiles[name])] = np.arange(len(profiles[name]))

    def one(text: str | None) -> tuple[str, float]:
        codes, n = ngram_counts(text or "")
        if not len(codes) or not langs:
            return "und", 0.0
        p = profile(codes, n, top)
        at = np.minimum(np.searchsorted(every, p), len(every) - 1)
        at = np.where(every[at] == p, at, len(every))
        r = ranks[:, at]
        far = np.where(r < 0, top, np.abs(r - np.arange(len(p)))).sum(1)
        k = int(far.argmin())
        return langs[k], 1.0 - float(far[k]) / (top * len(p))

    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(b: pa.RecordBatch) -> dict:
        got = [one(t) for t in b.column("text").to_pylist()]
        return {"doc_id": b.column("doc_id"), "lang_pred": [g[0] for g in got], "score": [g[1] for g in got]} | {k: b.column(k) for k in extra}

    return map_rows(only(docs, "doc_id", "text", *extra), run, "doc_id long, " + "".join(f"`{k}` {fields[k]}, " for k in extra) + "lang_pred string, score double")


def op9_rank_order_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole document, by profiles of those that are not held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", (F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % 3 == 1).alias("held_out"))
    return predict(docs, learn(docs.where("not held_out")), extra=("held_out",))


def crc_of(doc_id: int) -> int:
    """The CRC-32 that decides what is held out, as a plain function for tests."""
    return zlib.crc32(str(doc_id).encode())
