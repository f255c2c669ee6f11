"""Language identification against a plain out-of-place distance."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from partita.llm import langid

from .test_training import DATA, ODD, docs_of, naive_profile, needs_data


def naive_learn(rows, top):
    import re

    code = lambda g: sum(ord(ch) << (21 * i) for i, ch in enumerate(reversed(g)))
    total = collections.defaultdict(collections.Counter)
    for text, lang in rows:
        s = re.sub(r"[\W\d_]+", " ", text or "").lower().strip(" ")
        if lang is not None and any(map(str.isalpha, s)):
            s = f" {s} "
            total[lang].update(g for n in (1, 2, 3) for g in (s[i : i + n] for i in range(len(s) - n + 1)) if g != " " and not (n == 3 and g[1] == " "))
    return {lang: [code(g) for g, _ in sorted(c.items(), key=lambda x: (-x[1], code(x[0])))][:top] for lang, c in total.items()}


def naive_predict(text, profiles, top):
    p = naive_profile(text or "", top) if any(map(str.isalpha, text or "")) else []
    if not p or not profiles:
        return "und", 0.0
    far = {lang: sum(abs(i - ranks.index(g)) if g in ranks else top for i, g in enumerate(p)) for lang, ranks in profiles.items()}
    best = min(sorted(far), key=far.get)
    return best, 1 - far[best] / (top * len(p))


@pytest.mark.parametrize("held", [1, 2_000_000])
def test_profiles_distance_and_choice_against_brute_force(spark, held, monkeypatch):
    monkeypatch.setattr(langid, "HELD", held)
    rng = random.Random(2)
    words = {"aa": "abcdefg", "bb": "efghijk", "cc": "uvwxyzé"}
    rows = [(" ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 60))), lang) for lang, letters in words.items() for _ in range(12)]
    rows += [(t, "aa" if i % 2 else None) for i, t in enumerate(ODD)] + rows[:3]
    d = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string").repartition(3)
    for top in (300, 20):
        learned = langid.learn(d, top)
        want = naive_learn(rows, top)
        assert {k: v.tolist() for k, v in learned.items()} == want
        for r in langid.predict(d, learned, top).collect():
            lang, score = naive_predict(rows[r.doc_id][0], want, top)
            assert r.lang_pred == lang and r.score == pytest.approx(score)


@needs_data
def test_real_texts_against_brute_force(spark):
    d = spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) < 3000")
    rows = d.select("doc_id", "text", "lang").collect()
    want = naive_learn([(r.text, r.lang) for r in rows], langid.TOP)
    got = {r.doc_id: r for r in langid.predict(d, langid.learn(d)).collect()}
    for r in rows[:60]:
        lang, score = naive_predict(r.text, want, langid.TOP)
        assert got[r.doc_id].lang_pred == lang and got[r.doc_id].score == pytest.approx(score)


def test_repeated_rows_and_clashing_columns(spark):
    d = docs_of(spark, ["eins zwei drei", "eins zwei drei", None], [1, 1, None]).withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit(3))
    rows = langid.predict(d, langid.learn(d)).collect()
    assert len(rows) == 3 and rows[0].lang_pred == "en" and len({r.score for r in rows if r.doc_id}) == 1
