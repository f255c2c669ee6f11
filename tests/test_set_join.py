"""The packed set join: what leaves a task, splits of hot codes and large cells, texts as they are, copies."""

import random

import numpy as np
import pyarrow as pa
import pytest

from partita.operators import set_join, similarity


def _words(text):
    out, at_gap = [""], False
    for c in text.lower():
        if c in " \t\n\f\r":
            if not at_gap:
                out.append("")
            at_gap = True
        else:
            out[-1] += c
            at_gap = False
    return out


def _shingles(text):
    w = _words(text)
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def _brute(sets, bound):
    out = {}
    for i, s in sets.items():
        for j, t in sets.items():
            if i != j and s and t and len(s & t) / len(s | t) >= bound:
                out[i, j] = len(s & t) / len(s | t)
    return out


def _texts(seed, n):
    """Copies of a few templates with words changed, exact copies, odd spaces, short and empty texts, none."""
    rng = random.Random(seed)
    out = {}
    for i in range(n):
        base = random.Random(i % 7)
        words = [base.choice(["Alpha", "beta", "été", "x\x0by", "İz", "d", "e", "f"]) + str(base.randrange(40)) for _ in range(20 + 9 * (i % 7))]
        words = [rng.choice("uvw") if rng.random() < 0.02 * (i % 4) else w for w in words]
        out[i] = rng.choice(["", " ", "\n\t "]) + "".join(w + rng.choice([" ", "  ", "\n", "\r\n", "\f"]) for w in words)
    out |= {n: "two words", n + 1: "", n + 2: None, n + 3: "a b ", n + 4: " a b", n + 5: "A\tb\n", n + 6: "one", n + 7: " ", n + 8: out[3], n + 9: out[3], n + 10: out[3].upper()}
    return out


@pytest.fixture
def tiny(monkeypatch):
    """Limits so low that hot codes and cells are split and every buffer is passed on many times."""
    for name, value in (("HELD", 50), ("TEXT_BYTES", 300), ("PAIRS_A_TASK", 20), ("CELL", 300), ("SETS_A_RANGE", 8), ("FREQUENT", 3)):
        monkeypatch.setattr(set_join, name, value)


def _run(edges):
    rows = edges.collect()
    assert len(rows) == len({(r.src, r.dst) for r in rows})
    return {(r.src, r.dst): r.val for r in rows}


def test_reading_texts_gives_the_sets_of_the_words(tiny):
    texts = {i: t for i, t in _texts(1, 40).items() if t is not None and len(_words(t)) > 2}
    batch = pa.RecordBatch.from_pydict({"obs_id": pa.array(list(texts), pa.int64()), "salt": pa.array([0] * len(texts), pa.int64()), "text": [t.lower() for t in texts.values()]})
    of = {}
    for part in (batch, batch.slice(3, 9)):
        for ids, codes, starts in set_join.read_shingles(part):
            for i, s, e in zip(ids.tolist(), starts[:-1], starts[1:]):
                own = codes[s:e]
                assert len(own) == len(_shingles(texts[i])) and (np.diff(own.astype(object)) > 0).all()
                of.setdefault(i, own.tolist())
                assert of[i] == own.tolist()
    for i, a in of.items():
        for j, b in of.items():
            assert len(set(a) & set(b)) == len(_shingles(texts[i]) & _shingles(texts[j]))


def test_pairs_of_parts_are_all_pairs(tiny):
    rng = np.random.default_rng(5)
    run = np.sort(rng.integers(0, 6, 80))
    ids, n = rng.permutation(80).astype(np.int64), rng.integers(5, 12, 80)
    order, counts = set_join._meet(run, n, 0.6)
    found = np.concatenate(list(set_join._paired(ids[order], n[order], np.zeros(80, np.int64), 0, counts, 0.6)), axis=1)
    want = {tuple(sorted((ids[i], ids[j]))) for i in range(80) for j in range(80) if i != j and run[i] == run[j] and 1.6 * min(n[i], n[j]) >= 0.6 * (n[i] + n[j])}
    assert len(counts) == 80 and {(a, b) for a, b, *_ in found.T.tolist()} == want and found.shape[1] == len(want)


@pytest.mark.parametrize("bound", [0.5, 0.6, 1.0])
def test_shingle_edges_equal_brute_force_with_everything_split(spark, tiny, bound):
    texts = _texts(2, 60)
    df = spark.createDataFrame([(i, t, (None, "a", "b")[i % 3]) for i, t in texts.items()], "obs_id long, text string, lang string")
    sets = {i: _shingles(t or "") for i, t in texts.items()}
    assert _run(similarity.shingle_edges(df.drop("lang"), bound)) == pytest.approx(_brute(sets, bound))
    want = {(i, j): v for (i, j), v in _brute(sets, bound).items() if i % 3 and i % 3 == j % 3}
    assert _run(similarity.shingle_edges(df, bound, "lang")) == pytest.approx(want)


def test_rows_of_one_id_have_one_set(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (3, "a b c d"), (3, "d e f g"), (None, "a b c d e f g")]
    sets = {1: _shingles("a b c d e f g"), 2: _shingles("a b c d e f g"), 3: _shingles("a b c d") | _shingles("d e f g")}
    assert _run(similarity.shingle_edges(spark.createDataFrame(rows, "obs_id long, text string"), 0.5)) == pytest.approx(_brute(sets, 0.5))


def test_set_edges_of_named_sets(spark):
    sets = {"x": {1, 2, 3}, "y": {2, 3, 4}, "z": {9}, "w": {1, 2, 3}}
    df = spark.createDataFrame([(k, v) for k, s in sets.items() for v in s], "obs_id string, item int")
    assert _run(similarity.set_edges(df, 0.5)) == pytest.approx(_brute(sets, 0.5))


def test_prefixes_and_candidates_take_few_bytes(spark):
    """Sets with rare codes of their own: a row of a prefix is packed in less than 14 bytes, and one shared code among
    many makes no candidate."""
    rng = np.random.default_rng(3)
    rows = [(i, [7, 8, *(int(v) for v in rng.integers(-(1 << 63), 1 << 63, 300))]) for i in range(200)]
    df = spark.createDataFrame(rows, "obs_id long, codes array<long>").coalesce(1)
    sets = set_join.Sets(df, set_join.read_codes, spark.createDataFrame([], "rep long, obs_id long"))
    found = set_join._prefixes(sets, 0.6, 4).selectExpr("sum(rows) AS rows", "sum(length(data)) AS bytes").first()
    assert found.rows == 200 * (302 - 182 + 1) and found.bytes < 14 * found.rows
    twin = spark.createDataFrame([(1000, rows[0][1][:250]), (1001, [5, 6, 7])], "obs_id long, codes array<long>")
    sets.df = df.unionByName(twin)
    assert [(r.a, r.b) for r in set_join._candidates(sets, 0.6, 4).collect()] == [(0, 1000)]
