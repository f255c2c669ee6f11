"""Sampled segmentations where masses are tiny, segments are long and rows are odd."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from partita.llm import sentencepiece_topk as sp

from .test_training import all_paths, docs_of


@pytest.mark.parametrize("text, alpha", [("because", 3.0), ("the cat", 3.0), ("because", 8.0), ("be", 1.0), ("because", 0.3)])
def test_every_segmentation_comes_however_improbable(text, alpha):
    lat = sp.Lattices(sp.model_path(), alpha)
    starts = lat.nodes([text])[0]
    paths = all_paths(lat, starts)
    assert math.fsum(math.exp(v) for v in paths.values()) == pytest.approx(1, abs=1e-9)
    asked = min(len(paths) - 1, 50)
    found, kappa = sp.sample_batch(lat, [starts], sp.row_keys([3], 1), asked)
    got = [tuple(e.tolist()) for e, _, _ in found[0]]
    assert len(set(got)) == asked and set(got) <= set(paths) and math.isfinite(kappa[0])
    assert all(lp == pytest.approx(paths[g], abs=1e-8) for g, (_, lp, _) in zip(got, found[0]))
    values = [v for *_, v in found[0]]
    assert values == sorted(values, reverse=True) and values[-1] >= kappa[0]
    assert {tuple(e.tolist()) for e, _, _ in sp.sample_batch(lat, [starts], sp.row_keys([3], 1), len(paths) + 3)[0][0]} == set(paths)


def test_probabilities_are_those_of_the_scores_at_a_high_power():
    lat = sp.Lattices(sp.model_path(), 6.0)
    paths = all_paths(lat, lat.nodes(["because"])[0])
    by_id = {i: s for i, s in lat.pieces.values()}
    raw = {p: sum(by_id[i] for i in lat.token_ids(np.array(p)).tolist()) for p in paths}
    top = max(raw.values())
    z = top + math.log(math.fsum(math.exp(v - top) for v in raw.values()))
    assert all(v == pytest.approx(raw[p] - z, abs=1e-8) for p, v in paths.items())


def test_powers_out_of_range_are_refused():
    for alpha in (0, -1, 9, float("nan")):
        with pytest.raises(ValueError):
            sp.Lattices(sp.model_path(), alpha)


def test_long_segments_leave_nothing_behind():
    rng, lat, seen = random.Random(5), sp.Lattices(sp.model_path()), []
    for i in range(200):
        texts = ["".join(rng.choice("abcdefghij") for _ in range(600)) for _ in range(3)]
        for a, b, nodes in lat.groups(lat.segments([*texts, "short text", ""])):
            found, _ = sp.sample_batch(lat, nodes, sp.row_keys(list(range(a, b)), 1), 2)
            for t, paths in zip([*texts, "short text", ""][a:b], found):
                assert all(lat.decode(lat.token_ids(e)) == t for e, _, _ in paths)
        lat.forget()
        seen.append((len(lat.starts), lat.n_edges, len(lat.raw), sum(getattr(lat, n).nbytes for n in ("first_edge", "cum", "logp", "step", "piece"))))
    assert len(set(seen[20:])) == 1 and lat.n_edges < 1000


def test_edges_are_bounded_and_a_reset_changes_nothing():
    rng = random.Random(6)
    small, large = sp.Lattices(sp.model_path(), memo=500), sp.Lattices(sp.model_path())
    for i in range(30):
        texts = ["".join(rng.choice("abcd efgh ") for _ in range(60)) for _ in range(5)]
        got = [[(lat.token_ids(e).tolist(), round(lp, 9)) for f in sp.sample_batch(lat, lat.nodes(texts), sp.row_keys(list(range(5)), i), 3)[0] for e, lp, _ in f] for lat in (small, large)]
        assert got[0] == got[1]
    assert small.n_edges < large.n_edges


def test_clashing_columns_and_repeated_rows(spark):
    d = docs_of(spark, ["one two", "one two", "x"], [7, 7, None]).withColumn("sample", F.lit("no")).withColumn("ids", F.lit(1))
    rows = sp.sample_documents(d, k=2).collect()
    by = [sorted((r["sample"], tuple(r.ids)) for r in rows if r.doc_id == 7)]
    assert len(by[0]) == 4 and by[0][0] == by[0][1] and by[0][2] == by[0][3] and sum(r.doc_id is None for r in rows) >= 1
