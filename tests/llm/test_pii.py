"""Personal data: candidates, votes and added spans against plain versions that look at everything."""

import collections
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from partita.llm import pii

from .test_training import docs_of, naive_base, prose

HONORIFICS = "Mr Mrs Ms Dr Herr Frau Madame Monsieur Señor Señora".split()


def naive_candidates(text):
    base, bad = pii.base_and_rejected(text)
    rest = [(s, 6 if k == 2 else k, e) for s, k, e in bad]
    rest += [(m.start(1), 5, m.end(1)) for m in pii._name.finditer(text)]
    rest += [(m.start(), 4, m.end()) for m in pii._secret.finditer(text) if any(c in "0123456789" for c in m[0])]
    out = []
    for s, k, e in sorted(rest):
        if not any(b < e and s < x for b, _, x in base):
            near = any(abs(b - e) < pii.NEAR or abs(s - x) < pii.NEAR for b, _, x in base)
            out.append(pii._judge(text, s, e, k, near))
    return out


def test_no_candidate_overlaps_any_of_many_base_spans():
    base, more = pii.candidates("1.1.1.1 " * 24 + 'key="abcdef1234567890abcd@example.com"')
    assert base[-1] == (197, 0, 229) and not more
    assert not pii.candidates("4111111111111111, " * 40 + "x@" + "4111111111111111." * 30 + "com")[1]


@pytest.mark.parametrize("title", HONORIFICS)
def test_a_name_is_found_after_every_honorific(title):
    for text in (f"{title} Diana left at 5", f"{title}. Wells has not come"):
        assert [c.kind for c in pii.candidates(text)[1]] == [5]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["1.1.1.1", "999.1.1.1", "a@b.co", "4111 1111 1111 1111", "4111 1111 1111 1112", "Ms Diana", "Dr Wu", "key=", '"', "abcdef1234567890abcd", "x" * 90, "+1 (123) 555-1234", " ", "@example.com", "\n"]), max_size=60))
def test_candidates_are_those_that_a_look_at_all_spans_gives(parts):
    text = "".join(parts)
    assert pii.candidates(text)[1] == naive_candidates(text) and pii.candidates(text)[0] == naive_base(text)


def test_expectation_maximisation_is_that_of_single_votes():
    rng = np.random.default_rng(4)
    truth = rng.random(3000) < 0.3
    right = np.array([0.9, 0.8, 0.7, 0.95])
    votes = np.where(rng.random((3000, 4)) < right, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random((3000, 4)) < 0.3] = -1
    p = np.clip(0.5 + 0.15 * ((votes == 1).sum(1) - (votes == 0).sum(1)), 0.05, 0.95)
    for _ in range(100):  # candidate by candidate, by the model's definition
        prior = min(max(p.mean(), 0.01), 0.99)
        theta = {}
        for j in range(4):
            for c, weight in ((0, 1 - p), (1, p)):
                n = [1 + weight[votes[:, j] == v].sum() for v in (-1, 0, 1)]
                theta[j, c] = [x / sum(n) for x in n]
        new = []
        for row in votes:
            like = [math.log(x) + sum(math.log(theta[j, c][v + 1]) for j, v in enumerate(row)) for c, x in ((0, 1 - prior), (1, prior))]
            new.append(1 / (1 + math.exp(like[0] - like[1])))
        new = np.array(new)
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    kinds, counts = zip(*sorted(collections.Counter(map(tuple, votes.tolist())).items()))
    soft, _, prior = pii.reliabilities(np.array(kinds), np.array(counts, float))
    by = dict(zip(kinds, soft))
    assert max(abs(by[tuple(v)] - x) for v, x in zip(votes.tolist(), p)) < 1e-6
    assert np.mean([(by[tuple(v)] > 0.5) == t for v, t in zip(votes.tolist(), truth)]) > 0.9 and abs(prior - 0.3) < 0.05


def test_added_spans_are_found_and_clean_text_is_left_alone(spark):
    rng = random.Random(12)
    def secret(i):
        return "".join(rng.choice("0123456789abcdef") for _ in range(40))
    texts = [f'{prose(rng, 9)} password = "{secret(i)}" {prose(rng, 5)}' for i in range(80)]
    texts += [f"{prose(rng, 5)} {rng.choice(HONORIFICS)} Jane Doe {prose(rng, 4)}" for _ in range(40)]
    clean = [f"{prose(rng, 12)} chapter {i} of volume {i % 7}" for i in range(80)]
    d = docs_of(spark, texts + clean + texts[:1])
    got = {}
    for r in pii.spans(d, pii.fit(d)).collect():
        got[r.doc_id] = r.spans
    assert sum("secret" in got[i] for i in range(80)) >= 76
    assert not any(got[i] for i in range(120, 200)) and got[200] == got[0]
    for i, t in enumerate(texts):
        for span in filter(None, got[i].split(",")):
            kind, s, e = span.split(":")
            assert kind != "secret" or re.fullmatch("[0-9a-f]{40}", t[int(s) : int(e)])
