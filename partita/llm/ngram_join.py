"""N-gram Jaccard self-join with several global token orders.

Two sets whose Jaccard similarity reaches t share a token among the first ``n - ceil(t n) + 1`` of each, under *any* order
of all tokens. Candidates must pass that test under every one of ``ORDERS`` different orders before they are verified
on the whole sets: the first order's prefixes are joined, the others' are intersected pair by pair.

The orders put frequent tokens last (by the logarithm of a count that is taken over all documents), then follow a
pseudo-random sequence of their own. So passages that many documents share seldom lead to candidates.

Links are found without emitting all pairs of a group:

1. Documents with equal sets are one class, which its smallest doc_id stands for.
2. Positions bound the overlap: at the first token that two prefixes share, all tokens before it are in one set only. A
   pair is made at a token only if its sets could still be similar with that token as their first; a similar pair is
   made there. Private words come first in the order, so copies edited in different places are mostly told apart here.
3. Round one pairs each class with one pivot per prefix token and band of sizes (the class that has the token earliest),
   filters, verifies, and takes connected components.
4. Round two takes what is left, exactly: for each prefix token whose classes are in several components, pairs across
   components, so that the members of the largest one are never paired with each other. A set's position at a token tells
   how large a partner may be. The smaller set of a pair goes to the size bands that it may reach, the larger one to its
   own, and bands are join keys: texts that share a template but differ in more than the threshold allows meet nowhere.
   A token and band with many pairs is dealt out over several tasks.

A link between classes of different components would be found in round two, so components are exact.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, documents, drop_cache, map_rows, only, small, text_batches, written
from .components import connected_components
from .shingles import order_codes, shingle_set

ORDERS = 3
#: A token counts as frequent from this many documents on; this many of the most frequent ones are told to the tasks.
FREQUENT, MOST_FREQUENT = 24, 1 << 18
#: Pairs of rows of one token and band beyond which several tasks share them.
PAIRS_A_TASK = 4_000_000


def prefix_size(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1 if n else 0


def frequent_tokens(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the most frequent shingles, ascending, and the logarithm of their counts.

    Each task counts its own rows first. Of the codes that it sees once, it passes on a quarter (by their value), so
    the shuffle stays small; any fixed counts make valid orders.
    """
    src = only(docs, "text")
    text_batches(src.sparkSession)

    def run(batches):
        drop_cache()
        held: list[np.ndarray] = []
        total = 0

        def out():
            codes, n = np.unique(np.concatenate(held), return_counts=True)
            pick = (n > 1) | (codes < np.uint64(1 << 62))
            codes, n = codes[pick].view(np.int64), n[pick]
            for i in range(0, len(codes), 100_000):
                yield pa.RecordBatch.from_pydict({"code": pa.array(codes[i : i + 100_000]), "n": pa.array(n[i : i + 100_000].astype(np.int64))})

        for b in batches:
            for t in b.column("text").to_pylist():
                held.append(shingle_set(t, k))
                total += len(held[-1])
            if total > 2_000_000:
                yield from out()
                held, total = [], 0
        if total:
            yield from out()

    counts = src.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    rows = counts.orderBy(F.desc("n"), "code").limit(MOST_FREQUENT).toPandas()
    codes = rows["code"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(codes)
    return codes[order], np.log2(np.maximum(rows["n"].to_numpy(np.float64), 1))[order].astype(np.uint64)


def _keys(codes: np.ndarray, seed: int, often: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Sort keys of one order: 6 bits of the frequency's logarithm, then 58 pseudo-random bits."""
    key = order_codes(codes, seed) >> np.uint64(6)
    if len(often):
        at = np.minimum(np.searchsorted(often, codes), len(often) - 1)
        key |= np.where(often[at] == codes, bucket[at], np.uint64(0)) << np.uint64(58)
    return key


def prefix_table(docs: DataFrame, k: int, num: int, den: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, n (set size), set_key (16 bytes that stand for the set), p0 (the first order's prefix) and more (32-bit
    prefixes of the other orders; shortening can only let more candidates through)."""
    often = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(b: pa.RecordBatch) -> dict:
        out: dict = {"doc_id": b.column("doc_id"), "n": [], "set_key": [], "p0": [], "more": []}
        for t in b.column("text").to_pylist():
            codes = shingle_set(t, k)
            p = prefix_size(len(codes), num, den)
            keys = [_keys(codes, s, *often.value) for s in range(ORDERS)]
            first = [key if len(key) <= p else np.partition(key, p - 1)[:p] for key in keys]
            first[0] = np.sort(first[0])
            out["n"].append(len(codes))
            out["set_key"].append(xxhash.xxh3_128_digest(codes.tobytes()))
            out["p0"].append(first[0].view(np.int64))
            out["more"].append([f.astype(np.uint32).view(np.int32) for f in first[1:]])
        return out

    return map_rows(only(docs, "doc_id", "text"), run, "doc_id long, n long, set_key binary, p0 array<long>, more array<array<int>>")


def _may_link(num: int, den: int) -> str:
    """Whether sets of na and nb tokens can reach num / den if their first common token has pa and pb tokens before it."""
    both = "least(na - pa, nb - pb)"
    return f"{den} * {both} >= {num} * (na + nb - {both})"


def _size_band(n: str, num: int, den: int) -> str:
    """A band of set sizes, rising with the size ``n``; a set reaches its partners' sizes over some five bands."""
    return f"cast(floor(ln({n}) / {math.log1p((den / num - 1) / 4)!r}) as int)" if num < den else f"cast({n} as int)"


def cross_pairs(rest: DataFrame, num: int, den: int, pairs_a_task: int = PAIRS_A_TASK) -> DataFrame:
    """a, b and token of the pairs of different components that may link with ``token`` as their first common one.

    ``rest`` has token, doc_id, n, pos, comp and in_main (whether comp is the token's largest one). A pair's smaller set
    (ties: the smaller doc_id) is met in each band of sizes up to ``most``, the largest partner that its position allows.
    """
    most = f"cast(floor((n - pos) * {num + den} / {num}) as long) - n"
    side = rest.withColumn("most", F.expr(most))
    low = side.where("most >= n").withColumn("band", F.explode(F.sequence(F.expr(_size_band("n", num, den)), F.expr(_size_band("most", num, den)))))
    high = side.withColumn("band", F.expr(_size_band("n", num, den)))
    keys = ["token", "band"]
    load = low.groupBy(*keys).agg(F.count("*").alias("x")).join(high.groupBy(*keys).agg(F.count("*").alias("y")), keys)
    heavy = load.where(F.col("x") * F.col("y") > pairs_a_task).select(*keys, F.least(F.col("x"), F.ceil(F.col("x") * F.col("y") / pairs_a_task)).cast("int").alias("parts"))
    heavy = small(written(heavy, "ngram-heavy"))
    low = low.join(heavy, keys, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"), F.lit(0)))
    high = high.join(heavy, keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0)))))
    keys.append("salt")
    x = low.select(*keys, F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("comp").alias("ka"), F.col("in_main").alias("ma"))
    y = high.select(*keys, F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("comp").alias("kb"), F.col("in_main").alias("mb"))
    on = f"ka <> kb and (na < nb or na = nb and a < b) and {_may_link(num, den)}"
    return x.where("not ma").join(y, keys).where(on).unionByName(x.where("ma").join(y.where("not mb"), keys).where(on)).select("a", "b", "token")


def verify(pairs: DataFrame, table: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Of candidate pairs (a, b), those that pass every further order and whose whole sets reach num / den."""
    pairs = written(pairs, "ngram-pairs")
    ids = written(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "ngram-ids")
    more = table.select("doc_id", "more").join(small(ids), "doc_id", "left_semi")
    kept = (
        pairs.join(more.withColumnsRenamed({"doc_id": "a", "more": "ma"}), "a")
        .join(more.withColumnsRenamed({"doc_id": "b", "more": "mb"}), "b")
        .where(" and ".join(f"arrays_overlap(ma[{i}], mb[{i}])" for i in range(ORDERS - 1)))
    )
    kept = written(kept.select("a", "b").distinct(), "ngram-candidates")
    discard(pairs, ids)
    ids = written(kept.select(F.col("a").alias("doc_id")).unionByName(kept.select(F.col("b").alias("doc_id"))).distinct(), "ngram-ids")
    texts = only(docs, "doc_id", "text").join(small(ids), "doc_id", "left_semi")

    def codes(b: pa.RecordBatch) -> dict:
        return {"doc_id": b.column("doc_id"), "codes": [shingle_set(t, k).tobytes() for t in b.column("text").to_pylist()]}

    sets = map_rows(texts, codes, "doc_id long, codes binary")

    def similar(b: pa.RecordBatch) -> dict:
        keep = []
        for x, y in zip(b.column("ca"), b.column("cb")):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
            keep.append(den * both >= num * (len(x) + len(y) - both))
        return {"a": b.column("a"), "b": b.column("b"), "ok": keep}

    full = kept.join(sets.withColumnsRenamed({"doc_id": "a", "codes": "ca"}), "a").join(sets.withColumnsRenamed({"doc_id": "b", "codes": "cb"}), "b")
    links = written(map_rows(full.select("a", "b", "ca", "cb"), similar, "a long, b long, ok boolean").where("ok").select("a", "b"), "ngram-links")
    discard(kept, ids)
    return links.distinct()


def components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, class_id and component_id of each row of ``docs`` (doc_id, text).

    Texts link when ``den`` x their common shingles >= ``num`` x all their shingles. class_id is the smallest doc_id with
    the same set, component_id the smallest that links lead to. Null, empty and blank texts have no shingles and link
    with nothing, not even each other: they are their own class and component. Rows that share a doc_id are one document,
    with the links of any of them; a null doc_id has null ids and takes no part. An empty table gives an empty result.
    """
    table = written(prefix_table(docs, k, num, den, frequent_tokens(docs, k)), "ngram-prefixes")
    named = table.where("doc_id is not null and n > 0")
    classes = written(named.groupBy("set_key").agg(F.min("doc_id").alias("class_id")), "ngram-classes")
    reps = named.join(small(classes.select(F.col("class_id").alias("doc_id"))), "doc_id", "left_semi")

    band = F.floor(F.log(F.col("n").cast("double")) / math.log(den / num)).alias("band") if num < den else F.col("n").alias("band")
    spread = reps.select("doc_id", "n", F.posexplode("p0").alias("pos", "token"))
    shared = spread.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    entries = written(spread.join(shared, "token"), "ngram-entries")

    banded = entries.select("token", "doc_id", "n", "pos", band)
    pivots = banded.groupBy("token", "band").agg(F.min(F.struct("pos", "doc_id", "n")).alias("m"), F.count("*").alias("c")).where("c > 1").select("token", "band", F.col("m.doc_id").alias("a"), F.col("m.n").alias("na"), F.col("m.pos").alias("pa"))
    first = banded.withColumnsRenamed({"n": "nb", "pos": "pb"}).join(pivots, ["token", "band"]).where(f"a <> doc_id and {_may_link(num, den)}")
    first = first.select(F.least("a", "doc_id").alias("a"), F.greatest("a", "doc_id").alias("b")).distinct()
    links = verify(first, table, docs, k, num, den)

    one = connected_components(links)
    placed = entries.join(one, entries.doc_id == one.v, "left").select("token", "doc_id", "n", "pos", F.coalesce("label", "doc_id").alias("comp"))
    tally = placed.groupBy("token", "comp").agg(F.count("*").alias("c"))
    main = tally.groupBy("token").agg(F.max(F.struct("c", "comp")).alias("m"), F.count("*").alias("comps")).where("comps > 1").select("token", F.col("m.comp").alias("main"))
    rest = written(placed.join(main, "token").select("token", "doc_id", "n", "pos", "comp", (F.col("comp") == F.col("main")).alias("in_main")), "ngram-rest")
    cross = cross_pairs(rest, num, den)
    second = cross.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = verify(second, table, docs, k, num, den)
    discard(entries, rest)

    members = named.join(classes, "set_key").select("doc_id", "class_id")
    twice = members.groupBy("doc_id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("b")).where("a <> b").select("a", "b")
    last = connected_components(links.unionByName(more).unionByName(twice))
    found = members.groupBy("doc_id").agg(F.min("class_id").alias("class_id")).join(last, F.col("class_id") == F.col("v"), "left").select("doc_id", "class_id", F.coalesce("label", "class_id").alias("component_id"))
    return table.select("doc_id", F.col("n").alias("n_shingles")).join(found, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3-word shingles, similarity of at least 0.9, over every whole document."""
    return components(documents(spark, sf_dir), k=3, num=90, den=100)


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words),
classes AS (SELECT min(doc_id) AS doc_id, s FROM (SELECT doc_id, list_sort(s) AS s FROM sets WHERE len(s) > 0) GROUP BY s),
members AS (SELECT a.doc_id, c.doc_id AS class_id, len(a.s) AS n FROM sets a LEFT JOIN classes c ON list_sort(a.s) = c.s),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM classes),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM classes UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comps AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT m.doc_id, m.n AS n_shingles, coalesce(m.class_id, m.doc_id) AS class_id, coalesce(c.component_id, m.doc_id) AS component_id FROM members m LEFT JOIN comps c ON m.class_id = c.a
"""
