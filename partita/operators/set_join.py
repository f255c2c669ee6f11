"""Similarity join of sets: candidates by prefixes in packed rows, verification on the whole sets where similar ones meet.

Sets are lists of 64-bit codes that :class:`Sets` makes anew whenever they are needed, so they are never written as a
table. A shuffle carries only

* counts of codes, of which the most frequent ones fix an order: frequent codes last;
* each set's prefix, the ``n - ceil(bound n) + 1`` first codes in that order, packed by ranges of codes. Two sets that
  reach the bound share codes of their prefixes: at least so many that the rest of either set can make up what lacks, so
  pairs are told by the number of such codes;
* the sets of candidates, once for each cell of candidates that have a neighbour in common, to be compared there.

Sets known to be equal take part once and are expanded at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut_lineage, release, small

#: A code counts as frequent from this many sets on; this many of the most frequent ones are told to the tasks.
FREQUENT, MOST_FREQUENT = 8, 1 << 18
#: Codes or prefix rows held by a task before it passes them on, and bytes of text that are worked on at once.
HELD, TEXT_BYTES = 1_000_000, 1 << 20
#: Candidates of one code beyond which several tasks share them, codes of a cell's sets beyond which it is split.
PAIRS_A_TASK, CELL = 4_000_000, 1_000_000
#: Sets for each range of codes.
SETS_A_RANGE = 4096

_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
#: What parts words, as a class of a regular expression (RE2's ``\\s``; Java's has a vertical tab besides).
SPACES = r"[ \t\n\f\r]"
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 12, 13, 32]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: ids, codes (ascending and distinct in a set), and where each set starts, with the end.
Chunk = tuple[np.ndarray, np.ndarray, np.ndarray]


@dataclass
class Sets:
    """Sets as rows of ``df`` (obs_id long, distinct, and what ``read`` needs), no set empty; ``read`` makes chunks of a
    batch. ``members`` has rep and obs_id of the sets that are known to be equal, for groups of two or more; of such a
    group ``df`` holds rep only."""

    df: DataFrame
    read: Callable[[pa.RecordBatch], Iterator[Chunk]]
    members: DataFrame


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which each bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, b in enumerate((_BASE, _INVERSE)):
            t = np.full(max(n, TEXT_BYTES + 1), b, np.uint64)
            t[0] = 1
            _powers[i] = np.multiply.accumulate(t)
    return _powers


def _distinct(ids: np.ndarray, codes: np.ndarray, starts: np.ndarray) -> Chunk:
    for s, e in pairwise(starts.tolist()):
        codes[s:e].sort()
    keep = np.ones(len(codes), bool)
    keep[1:] = codes[1:] != codes[:-1]
    keep[starts[:-1]] = True
    return ids, codes[keep], np.concatenate([[0], np.cumsum(keep)])[starts]


def _longs(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def read_shingles(batch: pa.RecordBatch) -> Iterator[Chunk]:
    """Codes of all three words in a row of ``text``, which has three at least. Runs of ``SPACES`` part words, and one at an
    end borders an empty word. Texts of different ``salt`` have no code in common."""
    ids, salt = _longs(batch, "obs_id"), _longs(batch, "salt").view(np.uint64)
    text = batch.column("text").cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2], np.uint8)
    m = np.uint64(0x9E3779B97F4A7C15)
    i = 0
    while i < len(ids):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + TEXT_BYTES, "right")) - 1)
        raw, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        power, inverse = _power_tables(len(raw) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], dtype=np.uint64)])
        gap = _GAP[raw]
        begins, ends = gap.copy(), gap.copy()
        begins[1:] &= ~gap[:-1]
        ends[:-1] &= ~gap[1:]
        begins[at[:-1]], ends[at[1:] - 1] = gap[at[:-1]], gap[at[1:] - 1]
        begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        words = np.bincount(np.searchsorted(at, begins, "right") - 1, minlength=j - i) + 1
        start, end = np.sort(np.concatenate([at[:-1], ends])), np.sort(np.concatenate([begins, at[1:]]))
        w = _mix((sums[end] - sums[start]) * inverse[start])
        doc = np.repeat(np.arange(j - i), words)
        codes = _mix((_mix(w[:-2] * m + w[1:-1]) * m + w[2:])[doc[:-2] == doc[2:]])
        codes = _mix(codes ^ np.repeat(salt[i:j], words - 2))
        yield _distinct(ids[i:j], codes, np.concatenate([[0], np.cumsum(words - 2)]))
        i = j


def read_codes(batch: pa.RecordBatch) -> Iterator[Chunk]:
    """The lists of longs in ``codes``."""
    lists = batch.column("codes")
    codes = np.array(lists.flatten().to_numpy(zero_copy_only=False)).view(np.uint64)
    yield _distinct(_longs(batch, "obs_id"), codes, np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64))


def once(df: DataFrame, same: str) -> tuple[DataFrame, DataFrame]:
    """``df`` without the rows whose ``same`` a smaller obs_id has too; rep and obs_id of groups of two or more."""
    groups = df.groupBy(same).agg(F.sort_array(F.collect_list("obs_id")).alias("_ids")).where(F.size("_ids") > 1)
    members = cut_lineage(groups.select(F.col("_ids")[0].alias("rep"), F.explode("_ids").alias("obs_id")))
    later = small(members.where("obs_id <> rep").select("obs_id"))
    return df.drop(same).join(later, "obs_id", "left_anti"), members


def _frequent(sets: Sets) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent codes, ascending, and the logarithm of their counts. Each task counts its own sets first; of the
    codes that it sees once it passes on a sixteenth, by their value. Any fixed counts make a valid order."""
    read = sets.read

    def run(batches):
        held, total = [], 0

        def out():
            codes, n = np.unique(np.concatenate(held), return_counts=True)
            pick = (n > 1) | (codes < np.uint64(1 << 60))
            codes, n = codes[pick].view(np.int64), n[pick].astype(np.int64)
            for i in range(0, len(codes), 100_000):
                yield pa.RecordBatch.from_pydict({"code": codes[i : i + 100_000], "n": n[i : i + 100_000]})

        for b in batches:
            for _, codes, _ in read(b):
                held.append(codes)
                total += len(codes)
                if total > 2 * HELD:
                    yield from out()
                    held, total = [], 0
        if total:
            yield from out()

    counts = sets.df.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    rows = counts.orderBy(F.desc("n"), "code").limit(MOST_FREQUENT).toPandas()
    codes = rows["code"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(codes)
    return codes[order], np.log2(np.maximum(rows["n"].to_numpy(np.float64), 1))[order].astype(np.int64)


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers, a byte of all rows after the other, compressed."""
    return pa.compress(np.stack([c.astype("<i8") for c in columns]).view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1).tobytes(), "zstd", asbytes=True)


def _unpack(data: bytes, rows: int, columns: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(data, rows * columns * 8, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(columns, 8, rows).transpose(0, 2, 1)).view("<i8")[:, :, 0]


def _groups(batches, key: str) -> Iterator[pa.Table]:
    """Rows of one key each, of batches that are sorted by it."""
    held, at = [], None
    for b in batches:
        if b.num_rows:
            k = _longs(b, key)
            for s, e in pairwise([0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]):
                if held and k[s] != at:
                    yield pa.Table.from_batches(held)
                    held = []
                at = k[s]
                held.append(b.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def _prefixes(sets: Sets, bound: float, ranges: int) -> DataFrame:
    """range, rows and data: packed code, obs_id, n (size of the set) and r (codes before this one) of all prefixes."""
    read, often = sets.read, sets.df.sparkSession.sparkContext.broadcast(_frequent(sets))

    def run(batches):
        often_codes, often_log = often.value
        held, total = [], 0

        def out():
            code, *rest = (np.concatenate(x) for x in zip(*held))
            where = (code % np.uint64(ranges)).astype(np.int64)
            order = np.argsort(where, kind="stable")
            cuts = np.searchsorted(where[order], np.arange(ranges + 1)).tolist()
            columns = [x[order] for x in ((code >> np.uint64(24)), *rest)]
            found = [(k, e - s, _pack(*(x[s:e] for x in columns))) for k, (s, e) in enumerate(pairwise(cuts)) if e > s]
            yield pa.RecordBatch.from_pydict(dict(zip(("range", "rows", "data"), map(pa.array, zip(*found)))))

        for b in batches:
            for ids, codes, starts in read(b):
                n = np.diff(starts)
                doc = np.repeat(np.arange(len(ids)), n)
                rank = doc << 6
                if len(often_codes):
                    at = np.minimum(np.searchsorted(often_codes, codes), len(often_codes) - 1)
                    rank = rank | np.where(often_codes[at] == codes, often_log[at], 0)
                # Stable: codes of one rank stay in ascending order, so all sets have the same order.
                codes = codes[np.argsort(rank, kind="stable")]
                r = np.arange(len(codes)) - starts[doc]
                pick = r < (n - np.ceil(bound * n - 1e-9).astype(np.int64) + 1)[doc]
                doc = doc[pick]
                held.append((codes[pick], ids[doc], n[doc], r[pick]))
                total += len(doc)
                if total > HELD:
                    yield from out()
                    held, total = [], 0
        if total:
            yield from out()

    return sets.df.mapInArrow(run, "range long, rows long, data binary")


def _meet(run: np.ndarray, n: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """Sort order of rows by run and size, and how many of the next rows in it each may be similar to by size."""
    order = np.lexsort((n, run))
    key = (run[order] << 32) + n[order]
    most = np.minimum(np.floor(n[order] / bound + 1e-6) if bound > 0 else np.full(len(n), 2.0**31), 2**31).astype(np.int64)
    return order, np.searchsorted(key, (run[order] << 32) + most, "right") - np.arange(len(n)) - 1


def _paired(ids: np.ndarray, n: np.ndarray, r: np.ndarray, first: int, counts: np.ndarray, bound: float) -> Iterator[np.ndarray]:
    """a, b, na, nb and the number of common codes (a < b) of each row from ``first`` on with its next ``counts``, if a
    code at their places lets them reach the bound."""
    known, local = np.unique(ids, return_inverse=True)
    ends = np.cumsum(counts)
    lo = 0
    while lo < len(counts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + HELD, "right")))
        c = counts[lo:hi]
        i = np.repeat(np.arange(first + lo, first + hi), c)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
        reach = np.minimum(n[i] - r[i], n[j] - r[j]) + np.minimum(r[i], r[j])
        pick = ((1 + bound) * reach >= bound * (n[i] + n[j]) - 1e-6) & (local[i] != local[j])
        i, j = i[pick], j[pick]
        swap = local[i] > local[j]
        a, b = np.where(swap, j, i), np.where(swap, i, j)
        _, at, common = np.unique(local[a] * len(known) + local[b], return_index=True, return_counts=True)
        if len(at):
            a, b = a[at], b[at]
            yield np.stack([ids[a], ids[b], n[a], n[b], common])
        lo = hi


def _candidates(sets: Sets, bound: float, ranges: int) -> DataFrame:
    """a, b (a < b), na and nb of pairs that may reach the bound: by the number of codes that both have in their prefixes,
    and what the rest of one of them can add."""

    def packed(start: int, columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"start": [start], "rows": [columns.shape[1]], "data": [_pack(*columns)]})

    def run(batches):
        for t in _groups(batches, "range"):
            code, ids, n, r = np.concatenate([_unpack(d, m, 4) for m, d in zip(t["rows"].to_pylist(), t["data"].to_pylist())], axis=1)
            order = np.argsort(code, kind="stable")
            code = code[order]
            same = code[1:] == code[:-1]
            more = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            pick, code = order[more], code[more]
            if not len(code):
                continue
            group = np.concatenate([[0], np.cumsum(code[1:] != code[:-1])])
            order, counts = _meet(group, n[pick], bound)
            ids, n, r = ids[pick][order], n[pick][order], r[pick][order]
            load = np.bincount(group, counts)
            # Many pairs of one code leave as its rows, once for each task that is to pair a part of them.
            for g in np.flatnonzero(load > PAIRS_A_TASK).tolist():
                s, e = np.searchsorted(group, [g, g + 1]).tolist()
                part = (np.cumsum(counts[s:e]) - 1) // PAIRS_A_TASK
                for x, y in pairwise([0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), e - s]):
                    own = np.where((np.arange(e - s) >= x) & (np.arange(e - s) < y), counts[s:e], 0)
                    yield packed(x, np.stack([ids[s:e], n[s:e], r[s:e], own]))
            for pairs in _paired(ids, n, r, 0, np.where(load[group] > PAIRS_A_TASK, 0, counts), bound):
                yield packed(-1, pairs)

    def rest(batches):
        for b in batches:
            for start, m, data in zip(*(b.column(c).to_pylist() for c in ("start", "rows", "data"))):
                if start < 0:
                    found = [_unpack(data, m, 5)]
                else:
                    ids, n, r, counts = _unpack(data, m, 4)
                    found = _paired(ids, n, r, 0, counts, bound)
                for x in found:
                    for k in range(0, x.shape[1], 100_000):
                        yield pa.RecordBatch.from_pydict(dict(zip(("a", "b", "na", "nb", "common"), x[:, k : k + 100_000])))

    met = cut_lineage(_prefixes(sets, bound, ranges).repartition("range").sortWithinPartitions("range").mapInArrow(run, "start long, rows long, data binary"))
    hot = met.where("start >= 0").repartition(F.xxhash64("start", "data"))
    pairs = met.where("start < 0").unionByName(hot).mapInArrow(rest, "a long, b long, na long, nb long, common long")
    pairs = pairs.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum("common").alias("common"))
    # What a set has after its prefix; the pair's common codes beyond the shorter reach of the two prefixes are among it.
    after = F.greatest(*(F.ceil(bound * F.col(x) - 1e-9) - 1 for x in ("na", "nb")))
    return pairs.where((1 + bound) * (F.col("common") + after) >= bound * (F.col("na") + F.col("nb")) - 1e-6).drop("common")


def _placed(pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b, na, nb) with the cell where their sets meet: sets take the smallest id at most two steps away as
    their label, a cell has pairs of two labels, and a large one is split by blocks of sets."""
    both = pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y")))
    near = both.groupBy("x").agg(F.least("x", F.min("y")).alias("_l"))
    label = cut_lineage(both.join(near.withColumnRenamed("x", "y"), "y").groupBy("x").agg(F.min("_l").alias("_l")))
    at = pairs.join(label.select(F.col("x").alias("a"), F.col("_l").alias("_la")), "a").join(label.select(F.col("x").alias("b"), F.col("_l").alias("_lb")), "b")
    at = cut_lineage(at.select("a", "b", "na", "nb", F.xxhash64(F.least("_la", "_lb"), F.greatest("_la", "_lb")).alias("_c")))
    ends = at.select("_c", F.inline(F.array(F.struct(F.col("a").alias("x"), F.col("na").alias("n")), F.struct(F.col("b").alias("x"), F.col("nb").alias("n")))))
    large = ends.distinct().groupBy("_c").agg(F.ceil(F.sum("n") / CELL).alias("_k")).where("_k > 1")
    at = at.join(small(large), "_c", "left")
    side = [F.coalesce(F.pmod(F.xxhash64(x), F.col("_k")), F.lit(0)) for x in ("a", "b")]
    return cut_lineage(at.select("a", "b", F.xxhash64("_c", F.least(*side), F.greatest(*side)).alias("cell")))


def _verified(sets: Sets, pairs: DataFrame, bound: float) -> DataFrame:
    """a, b and val of ``pairs`` (a, b, cell) that reach the bound."""
    read = sets.read
    ends = pairs.select("cell", F.explode(F.array("a", "b")).alias("obs_id")).groupBy("obs_id").agg(F.collect_set("cell").alias("cells"))
    needed = sets.df.join(small(cut_lineage(ends)), "obs_id")

    def send(batches):
        for b in batches:
            cells = dict(zip(b.column("obs_id").to_pylist(), b.column("cells").to_pylist()))
            for ids, codes, starts in read(b):
                for i, s, e in zip(ids.tolist(), starts[:-1].tolist(), starts[1:].tolist()):
                    to = cells[i]
                    data = codes[s:e].tobytes()
                    for k in range(0, len(to), 1024):
                        m = len(to[k : k + 1024])
                        yield pa.RecordBatch.from_pydict({"cell": pa.array(to[k : k + 1024], pa.int64()), "a": pa.array([i] * m, pa.int64()), "b": pa.nulls(m, pa.int64()), "data": pa.array([data] * m, pa.binary())})

    def compare(batches):
        for t in _groups(batches, "cell"):
            a, b, data = (t[c].combine_chunks() for c in ("a", "b", "data"))
            is_set = b.is_null().to_numpy(zero_copy_only=False)
            left = a.to_numpy(zero_copy_only=False)
            ids, first = np.unique(left[is_set], return_index=True)
            codes = [np.frombuffer(x, np.uint64) for x in data.filter(pa.array(is_set)).to_pylist()]
            codes = [codes[k] for k in first.tolist()]
            n = np.array([len(x) for x in codes])
            starts = np.concatenate([[0], np.cumsum(n)])
            values, code = np.unique(np.concatenate(codes), return_inverse=True)
            mark = np.zeros(len(values), np.int64)
            x = np.searchsorted(ids, left[~is_set])
            y = np.searchsorted(ids, b.filter(pa.array(~is_set)).to_numpy(zero_copy_only=False))
            order = np.argsort(x, kind="stable")
            x, y = x[order], y[order]
            common = np.zeros(len(x), np.int64)
            for s, e in pairwise([0, *(np.flatnonzero(x[1:] != x[:-1]) + 1).tolist(), len(x)]):
                own = code[starts[x[s]] : starts[x[s] + 1]]
                mark[own] = 1
                part = np.cumsum(n[y[s:e]]) // HELD
                for u, v in pairwise([s, *(s + 1 + np.flatnonzero(np.diff(part))).tolist(), e]):
                    theirs = np.concatenate([code[starts[k] : starts[k + 1]] for k in y[u:v].tolist()])
                    common[u:v] = np.add.reduceat(mark[theirs], np.cumsum(n[y[u:v]]) - n[y[u:v]])
                mark[own] = 0
            val = common / (n[x] + n[y] - common)
            pick = val >= bound
            yield pa.RecordBatch.from_pydict({"a": ids[x[pick]], "b": ids[y[pick]], "val": val[pick]})

    sent = needed.mapInArrow(send, "cell long, a long, b long, data binary")
    rows = sent.unionByName(pairs.select("cell", "a", "b", F.lit(None).cast("binary").alias("data")))
    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(compare, "a long, b long, val double")


def similar_sets(sets: Sets, bound: float) -> DataFrame:
    """src, dst, val of all pairs of ``sets``, both ways, whose Tanimoto similarity is at least ``bound``."""
    spark = sets.df.sparkSession
    ranges = min(max(16, sets.df.count() // SETS_A_RANGE), 1 << 14)
    pairs = cut_lineage(_candidates(sets, bound, ranges))
    release(spark)
    hits = cut_lineage(_verified(sets, _placed(pairs), bound))
    release(spark)
    both = hits.select(F.col("a").alias("src"), F.col("b").alias("dst"), "val").unionByName(hits.select(F.col("b").alias("src"), F.col("a").alias("dst"), "val"))
    for end in ("src", "dst"):
        known = small(sets.members.select(F.col("rep").alias(end), F.col("obs_id").alias("_o")))
        both = both.join(known, end, "left").withColumn(end, F.coalesce("_o", end)).drop("_o")
    if bound > 1:
        return both.select("src", "dst", "val")
    one, two = sets.members.select("rep", F.col("obs_id").alias("src")), small(sets.members.select("rep", F.col("obs_id").alias("dst")))
    equal = one.join(two, "rep").where("src <> dst").select("src", "dst", F.lit(1.0).alias("val"))
    return both.select("src", "dst", "val").unionByName(equal)
