"""Similarity joins over feature arrays, by blocks: all pairs of a block of rows and a block of others as one matrix product.

A task holds two blocks of at most about ``BLOCK`` rows, whatever the table's size; only pairs that a threshold or a
top-k keeps leave it. Rows with a null vector take no part. Ties go to the smaller id.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import BROADCAST_ROWS, cut_lineage, release, small
from ..functions.prefix import percentiles
from . import set_join

BLOCK = 2048
#: Rows of a block, and of the strips that a task works through, where only sums or packed pairs leave a task: the fewer
#: blocks, the less often a row is sent.
WIDE, STRIP = 8192, 256
METRICS = ("cosine", "dot", "sqdist", "euclidean", "rbf", "laplace", "tanimoto")
#: For these, smaller is nearer.
DISTANCES = frozenset(("sqdist", "euclidean"))


def block_values(a: np.ndarray, b: np.ndarray, metric: str, scale: float = 1.0) -> np.ndarray:
    """The metric of all pairs of rows; ``scale`` is gamma of the two kernels."""
    if metric == "cosine":
        na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
        return (a @ b.T) / np.maximum(np.outer(na, nb), 1e-300)
    g = a @ b.T
    if metric == "dot":
        return g
    if metric == "tanimoto":
        return np.clip(g / np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - g, 1e-300), 0, 1)
    if metric == "laplace":
        apart = np.zeros((len(a), len(b)))
        for x, y in zip(a.T, b.T):  # by column: all at once take a block's pairs times the columns
            apart += np.abs(x[:, None] - y)
        return np.exp(-scale * apart)
    d = np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * g, 0)
    return d if metric == "sqdist" else np.sqrt(d) if metric == "euclidean" else np.exp(-scale * d)


def _blocks(df: DataFrame) -> int:
    return max(1, -(-df.count() // BLOCK))


def _join(left: DataFrame, right: DataFrame, pick, schema: str) -> DataFrame:
    """Cogroup every block of ``left`` with every block of ``right``; both have obs_id and x, and may have ``key``."""
    nl, nr = _blocks(left), _blocks(right)
    keep = [c for c in ("obs_id", "x", "key") if c in left.columns]
    place = lambda d, n: d.where("x is not null").select(*(F.col(c).alias(c) for c in keep), F.pmod(F.xxhash64("obs_id"), F.lit(n)).alias("_own"))
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    a = place(left, nl).select(*keep, F.col("_own").cast("int").alias("bl"), every(nr, "br"))
    b = place(right, nr).select(*keep, F.col("_own").cast("int").alias("br"), every(nl, "bl"))

    def run(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if p.empty or q.empty:
            return pd.DataFrame({"src": [], "dst": [], "val": []}).astype({"src": "int64", "dst": "int64"})
        i, j, v = pick(p, q, np.array(p["x"].tolist(), np.float64), np.array(q["x"].tolist(), np.float64))
        return pd.DataFrame({"src": p["obs_id"].to_numpy()[i], "dst": q["obs_id"].to_numpy()[j], "val": v})

    return a.groupBy("bl", "br").cogroup(b.groupBy("bl", "br")).applyInPandas(run, schema)


_EDGE = "src long, dst long, val double"


def _self_join(df: DataFrame, pick, keyed: bool = False) -> DataFrame:
    """src, dst, val from every unordered pair of blocks of ``df``, once: ``pick(p, q, a, b, apart)`` gets two blocks and
    whether they differ, and gives ids and values for both directions of their pairs.

    With ``keyed`` only blocks of one part meet: a key of more than ``BLOCK`` rows is a part cut into blocks, smaller keys
    share parts; rows with a null key are left out. Without, all rows are one part.
    """
    d = df.where("x is not null")
    if keyed:
        n = d.where("key is not null").groupBy(F.col("key").alias("_key")).agg(F.ceil(F.count("*") / BLOCK).alias("_n"))
        shared = F.concat(F.lit("s"), F.pmod(F.xxhash64("key"), F.lit(_blocks(d))).cast("string"))
        d = d.join(small(n), F.col("key") == F.col("_key")).withColumn("_part", F.when(F.col("_n") > 1, F.concat(F.lit("k"), F.col("key").cast("string"))).otherwise(shared))
    else:
        d = d.withColumns({"_n": F.lit(_blocks(d)).cast("long"), "_part": F.lit("")})
    keep = ["_part", *(c for c in ("obs_id", "x", "key") if c in df.columns)]
    d = d.select(*keep, F.col("_n"), F.pmod(F.xxhash64("obs_id"), F.col("_n")).alias("_own"))
    a = d.select(*keep, F.col("_own").alias("bl"), F.explode(F.sequence("_own", F.col("_n") - 1)).alias("br"))
    b = d.select(*(F.col(c).alias(c) for c in keep), F.explode(F.sequence(F.lit(0).cast("long"), "_own")).alias("bl"), F.col("_own").alias("br"))

    def run(place: tuple, p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if p.empty or q.empty:
            return pd.DataFrame({"src": [], "dst": [], "val": []}).astype({"src": "int64", "dst": "int64"})
        i, j, v = pick(p, q, np.array(p["x"].tolist(), np.float64), np.array(q["x"].tolist(), np.float64), place[1] != place[2])
        return pd.DataFrame({"src": i, "dst": j, "val": v})

    at = ["_part", "bl", "br"]
    return a.groupBy(*at).cogroup(b.groupBy(*at)).applyInPandas(run, _EDGE)


def _both_ways(p: pd.DataFrame, q: pd.DataFrame, i, j, v, apart: bool) -> tuple:
    src, dst = p["obs_id"].to_numpy()[i], q["obs_id"].to_numpy()[j]
    return (np.concatenate([src, dst]), np.concatenate([dst, src]), np.concatenate([v, v])) if apart else (src, dst, v)


def edges_within(df: DataFrame, metric: str, bound: float, scale: float = 1.0, same_key: bool = False) -> DataFrame:
    """src, dst, val of all ordered pairs that are similar (val >= bound) or, for distances, near (val <= bound).

    With ``same_key`` only rows with equal ``key`` are compared, and only their blocks meet; null keys equal nothing.
    """

    def pick(p, q, a, b, apart):
        v = block_values(a, b, metric, scale)
        ok = v <= bound if metric in DISTANCES else v >= bound
        ok &= p["obs_id"].to_numpy()[:, None] != q["obs_id"].to_numpy()
        if same_key:
            ok &= p["key"].to_numpy()[:, None] == q["key"].to_numpy()
        i, j = np.nonzero(ok)
        return _both_ways(p, q, i, j, v[i, j], apart)

    return _self_join(df, pick, same_key)


def nearest(queries: DataFrame, base: DataFrame, k: int, metric: str = "sqdist", scale: float = 1.0, other_key: bool = False) -> DataFrame:
    """src, rank, dst, val: the k rows of ``base`` nearest to each query, itself (by id) left out; with ``other_key`` only
    rows of another ``key`` count. Each block pair sends on its k best, so the final ranking sees few rows a query."""
    sign = 1.0 if metric in DISTANCES else -1.0

    def pick(p, q, a, b):
        v = sign * block_values(a, b, metric, scale)
        v[p["obs_id"].to_numpy()[:, None] == q["obs_id"].to_numpy()] = np.inf
        if other_key:
            v[p["key"].to_numpy()[:, None] == q["key"].to_numpy()] = np.inf
        m = min(k, v.shape[1])
        edge = np.partition(v, m - 1, axis=1)[:, m - 1]
        i, j = np.nonzero((v <= edge[:, None]) & np.isfinite(v))  # with ties at the edge, which are ranked by id later
        return i, j, sign * v[i, j]

    hits = _join(queries, base, pick, _EDGE)
    w = Window.partitionBy("src").orderBy(F.col("val") * sign, "dst")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("src", "rank", "dst", "val")


def kernel_edges(df: DataFrame, metric: str = "rbf", scale: float = 1.0, most: int = 50_000) -> DataFrame:
    """src, dst, val of a dense kernel, diagonal included; refused above ``most`` rows, where kNN edges are to be used."""
    if df.count() > most:
        raise ValueError(f"a dense kernel of more than {most} rows: use nearest() for a sparse one")

    def pick(p, q, a, b, apart):
        v = block_values(a, b, metric, scale)
        i, j = np.divmod(np.arange(v.size), v.shape[1])
        return _both_ways(p, q, i, j, v.ravel(), apart)

    return _self_join(df, pick)


def _own(df: DataFrame) -> Column:
    """The wide block of a row of ``df``, whose rows are counted."""
    return F.pmod(F.xxhash64("obs_id"), F.lit(max(1, -(-df.count() // WIDE)))).cast("int")


def _wide_join(df: DataFrame, run, schema: str) -> DataFrame:
    """``run(p, q, a, b, apart, place)`` on every unordered pair of wide blocks of ``df`` (obs_id, x and more columns), once.
    Blocks are in the order of obs_id, so a value is the same to the last bit whenever it is computed again."""
    d = df.where("x is not null")
    n = max(1, -(-d.count() // WIDE))
    own = F.pmod(F.xxhash64("obs_id"), F.lit(n)).cast("int")
    a = d.select(*d.columns, own.alias("bl"), F.explode(F.sequence(own, F.lit(n - 1))).alias("br"))
    b = d.select(*(F.col(c).alias(c) for c in d.columns), F.explode(F.sequence(F.lit(0), own)).alias("bl"), own.alias("br"))
    empty = [c.split()[0] for c in schema.split(", ")]

    def each(place: tuple, p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if p.empty or q.empty:
            return pd.DataFrame(columns=empty)
        p, q = (t.sort_values("obs_id", kind="stable", ignore_index=True) for t in (p, q))
        return run(p, q, np.array(p["x"].tolist(), np.float64), np.array(q["x"].tolist(), np.float64), bool(place[0] != place[1]), place)

    return a.groupBy("bl", "br").cogroup(b.groupBy("bl", "br")).applyInPandas(each, schema)


def _strips(n: int):
    return (slice(i, i + STRIP) for i in range(0, n, STRIP))


def _kernel_sums(df: DataFrame, metric: str, scale: float, k: int) -> DataFrame:
    """obs_id, n (rows met) and s0 to s(k-1): products of the dense kernel, diagonal included, with k columns u0 to u(k-1)."""
    us = [f"u{i}" for i in range(k)]

    def run(p, q, a, b, apart, place):
        up, uq = p[us].to_numpy(np.float64), q[us].to_numpy(np.float64)
        sp, sq = np.zeros((len(a), k)), np.zeros((len(b), k))
        for at in _strips(len(a)):
            v = block_values(a[at], b, metric, scale)
            sp[at] = v @ uq
            if apart:
                sq += v.T @ up[at]
        out = [(p, sp, len(b))] + [(q, sq, len(a))] * apart
        return pd.concat([pd.DataFrame({"obs_id": t["obs_id"], "n": n} | {f"s{i}": s[:, i] for i in range(k)}) for t, s, n in out], ignore_index=True)

    each = [f"s{i}" for i in range(k)]
    return _wide_join(df.select("obs_id", "x", *us), run, ", ".join(["obs_id long, n long", *(f"{c} double" for c in each)])).groupBy("obs_id").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in each))


@dataclass(frozen=True)
class Kernel:
    """A dense kernel over rows (obs_id, x), diagonal included, whose entries are never listed: block pairs give sums. For
    tables of any size, though the work grows with the square of the rows."""

    rows: DataFrame
    metric: str = "rbf"
    scale: float = 1.0

    def row_sums(self) -> DataFrame:
        """obs_id, row_sum, n."""
        s = _kernel_sums(self.rows.select("obs_id", "x", F.lit(1.0).alias("u0")), self.metric, self.scale, 1)
        return s.select("obs_id", F.col("s0").alias("row_sum"), "n")

    def products(self, u: DataFrame, folds: list) -> DataFrame:
        """obs_id, fold, u and s, the kernel's product with u (obs_id, fold, u) of the rows of each of ``folds``."""
        d = self.rows.select("obs_id", "x").join(u, "obs_id")
        mine = [F.when(F.col("fold") == f, F.col("u")).otherwise(0.0).alias(f"u{i}") for i, f in enumerate(folds)]
        s = _kernel_sums(d.select("obs_id", "x", *mine), self.metric, self.scale, len(folds))
        return s.select("obs_id", F.array(*(F.col(f"s{i}") for i in range(len(folds)))).alias("s")).join(u, "obs_id")

    def scales(self) -> DataFrame:
        """One row: the least entry, the sum and number of all, and the largest, sum and number of the diagonal."""
        metric, scale = self.metric, self.scale

        def run(p, q, a, b, apart, place):
            least, every, top, diag, nd = np.inf, 0.0, None, 0.0, 0
            ids, other = p["obs_id"].to_numpy(), q["obs_id"].to_numpy()
            for at in _strips(len(a)):
                v = block_values(a[at], b, metric, scale)
                least, every = min(least, v.min()), every + v.sum()
                if not apart:
                    own = v[ids[at][:, None] == other]
                    top, diag, nd = max(own.max(), -np.inf if top is None else top), diag + own.sum(), nd + len(own)
            n = len(a) * len(b) * (1 + apart)
            return pd.DataFrame({"least": [least], "every": [every * (1 + apart)], "n": [n], "top": [top], "diag": [diag], "nd": [nd]})

        d = _wide_join(self.rows.select("obs_id", "x"), run, "least double, every double, n long, top double, diag double, nd long")
        return d.agg(F.min("least").alias("least"), F.sum("every").alias("every"), F.sum("n").alias("n"), F.max("top").alias("top"), F.sum("diag").alias("diag"), F.sum("nd").alias("nd"))

    def middle(self, level: float) -> float | None:
        """The exact quantile of all entries by linear interpolation, found digit by digit: each pass counts the entries
        below the digits known so far by their next 16 bits, in the order of doubles, until few enough are left to list."""
        metric, scale, sign = self.metric, self.scale, np.uint64(1 << 63)

        def counts(prefix: int, known: int, width: int) -> dict[int, int]:
            """How many entries that begin with the ``known`` bits ``prefix`` have which next ``width`` bits."""

            def run(p, q, a, b, apart, place):
                found, ones = np.zeros(1 << 16, np.int64), []
                for at in _strips(len(a)):
                    bits = (block_values(a[at], b, metric, scale).ravel() + 0.0).view(np.uint64)
                    key = np.where(bits >= sign, ~bits, bits | sign)
                    if known:
                        key = key[key >> np.uint64(64 - known) == np.uint64(prefix)]
                    if width == 16:
                        found += np.bincount((key >> np.uint64(48 - known) & np.uint64(0xFFFF)).astype(np.int64), minlength=1 << 16)
                    else:
                        ones.append((key & np.uint64((1 << width) - 1)).view(np.int64))
                if width == 16:
                    digit = np.flatnonzero(found)
                    n = found[digit]
                else:
                    digit, n = np.unique(np.concatenate(ones), return_counts=True)
                return pd.DataFrame({"digit": digit, "n": n * (1 + apart)})

            d = _wide_join(self.rows.select("obs_id", "x"), run, "digit long, n long").groupBy("digit").agg(F.sum("n").alias("n"))
            out = {r.digit: r.n for r in d.collect()}
            release(self.rows.sparkSession)
            return out

        first = counts(0, 0, 16)
        n = sum(first.values())
        if not n:
            return None
        h, value, seen = (n - 1) * level, {}, {(0, 0, 16): first}
        for rank in {math.floor(h), math.ceil(h)}:
            prefix, known, width, below = 0, 0, 16, 0
            while known < 64:
                at = (prefix, known, width)
                seen[at] = seen.get(at) or counts(*at)
                for digit in sorted(seen[at]):
                    if below + seen[at][digit] > rank:
                        break
                    below += seen[at][digit]
                prefix, known = prefix << width | digit, known + width
                width = 64 - known if known and seen[at][digit] <= LISTED and known < 64 else 16
            key = np.uint64(prefix)
            value[rank] = float(np.array([key ^ sign if key >= sign else ~key], np.uint64).view(np.float64)[0])
        lo, hi = value[math.floor(h)], value[math.ceil(h)]
        return lo if lo == hi else lo + (h - math.floor(h)) * (hi - lo)


@dataclass(frozen=True)
class BlockEdges:
    """Edges of all pairs of rows that are similar, packed by pairs of blocks: each unordered pair once, in 12 bytes, so a
    pass over them needs neither a join nor a shuffle of edges. Made by :func:`packed_edges`.

    ``pairs`` (bl, br, i, j, val) has, in bytes, places in the two blocks and values; ``members`` (block, ids) has the
    blocks' obs_ids in order. Passes leave out edges of rows without a label.
    """

    pairs: DataFrame
    members: DataFrame

    def _with_labels(self, labels: DataFrame) -> DataFrame:
        """Packed pairs with lp and lq, the (bigint) labels of both blocks' rows in their order, and their ids."""
        m = self.members.select("block", F.posexplode("ids").alias("at", "obs_id")).join(labels.select("obs_id", F.col("label").cast("long").alias("label")), "obs_id", "left")
        m = m.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "obs_id", F.coalesce("label", F.lit(_NONE)).alias("label")))).alias("r"))
        m = cut_lineage(m.select("block", F.col("r.obs_id").alias("ids"), F.col("r.label").alias("l")))
        few = (m.agg(F.sum(F.size("ids"))).first()[0] or 0) <= BROADCAST_ROWS
        side = lambda at, ids, label: (F.broadcast if few else lambda x: x)(m.select(F.col("block").alias(at), F.col("ids").alias(ids), F.col("l").alias(label)))
        return self.pairs.join(side("bl", "ip", "lp"), "bl").join(side("br", "iq", "lq"), "br")

    def _pass(self, labels: DataFrame, work, schema: str) -> DataFrame:
        """What ``work`` yields from a task's (block, ids, other block, its ids, i, j, val, labels of i, labels of j)."""

        def rows(batches):
            for b in batches:
                for n in range(b.num_rows):
                    get = lambda c: b.column(b.schema.get_field_index(c))[n]  # noqa: B023, E731
                    i, j = (np.frombuffer(get(c).as_py(), np.uint16) for c in "ij")
                    v = np.frombuffer(get("val").as_py(), np.float64)
                    ip, iq, lp, lq = (get(c).values.to_numpy(zero_copy_only=False) for c in ("ip", "iq", "lp", "lq"))
                    li, lj = lp[i], lq[j]
                    ok = (li != _NONE) & (lj != _NONE)
                    if not ok.all():
                        i, j, v, li, lj = i[ok], j[ok], v[ok], li[ok], lj[ok]
                    yield get("bl").as_py(), ip, get("br").as_py(), iq, i, j, v, li, lj

        conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
        spark = self.pairs.sparkSession
        if int(spark.conf.get(conf, "10000")) > 400:  # rows of labels are long
            spark.conf.set(conf, "400")
        return self._with_labels(labels).mapInArrow(lambda batches: work(rows(batches)), schema)

    def cuts(self, labels: DataFrame, samples: int = 1) -> DataFrame:
        """One row: total, the weight of directed edges, and cut, an array of those whose ends' labels (obs_id, label) differ;
        with ``samples`` above 1, differ in each of the labels' lowest bits."""

        def work(rows):
            cut, every = np.zeros(samples), 0.0
            for *_, v, li, lj in rows:
                every += v.sum()
                apart = li ^ lj
                for s in range(samples):
                    cut[s] += v[apart != 0 if samples == 1 else apart >> s & 1 == 1].sum()
            yield pa.RecordBatch.from_pydict({f"c{s}": [2 * x] for s, x in enumerate(cut)} | {"total": [2 * every]})

        names = [f"c{s}" for s in range(samples)]
        d = self._pass(labels, work, ", ".join(f"{c} double" for c in (*names, "total")))
        return d.agg(F.coalesce(F.sum("total"), F.lit(0.0)).alias("total"), F.array(*(F.coalesce(F.sum(c), F.lit(0.0)) for c in names)).alias("cut"))

    def affinities(self, assign: DataFrame, k: int) -> DataFrame:
        """src, fold_src, deg and a0 to a(k-1): the weight of each row's edges, of all and by the fold of their other end."""

        def work(rows):
            have: dict = {}
            for bl, ip, br, iq, i, j, v, li, lj in rows:
                for b, ids, at, of, to in ((bl, ip, i, li, lj), (br, iq, j, lj, li)):
                    s = have.setdefault(b, (ids, np.zeros((len(ids), k + 2)), np.zeros(len(ids), np.int64)))
                    s[1][:, k] += np.bincount(at, v, len(ids))
                    s[1][:, k + 1] += np.bincount(at, minlength=len(ids))
                    s[2][at] = of
                    for f in range(k):
                        s[1][:, f] += np.bincount(at[to == f], v[to == f], len(ids))
            for ids, s, own in have.values():
                n = s[:, k + 1] > 0
                yield pa.RecordBatch.from_pydict({"src": ids[n], "fold_src": own[n]} | {f"a{f}": s[n, f] for f in range(k)} | {"deg": s[n, k]})

        each = [f"a{f}" for f in range(k)]
        d = self._pass(assign.select("obs_id", F.col("fold").alias("label")), work, ", ".join(["src long, fold_src long", *(f"{c} double" for c in (*each, "deg"))]))
        return d.groupBy("src", F.col("fold_src").cast("int").alias("fold_src")).agg(*(F.sum(c).alias(c) for c in (*each, "deg")))

    def listed(self) -> DataFrame:
        """src, dst, val: every edge in both directions as rows."""

        def work(rows):
            for _, ip, _, iq, i, j, v, *_ in rows:
                yield pa.RecordBatch.from_pydict({"src": np.concatenate([ip[i], iq[j]]), "dst": np.concatenate([iq[j], ip[i]]), "val": np.concatenate([v, v])})

        every = self.members.select(F.explode("ids").alias("obs_id"), F.lit(0).alias("label"))
        return self._pass(every, work, _EDGE)


#: The label of rows that have none; edges that a row of packed pairs has, about, at most.
_NONE, PACKED = -(1 << 63), 1 << 19


def packed_edges(df: DataFrame, metric: str, bound: float, scale: float = 1.0) -> BlockEdges:
    """The edges of :func:`edges_within`, packed and written once. obs_id must be unique."""

    def run(p, q, a, b, apart, place):
        ip, iq, out, kept = p["obs_id"].to_numpy(), q["obs_id"].to_numpy(), [], []
        if max(len(ip), len(iq)) > 1 << 16 or len(np.unique(ip)) < len(ip):
            raise ValueError("obs_id must be unique")

        def put():
            i, j, v = (np.concatenate(x) for x in zip(*kept))
            out.append((int(place[0]), int(place[1]), i.astype(np.uint16).tobytes(), j.astype(np.uint16).tobytes(), v.tobytes()))
            kept.clear()

        for at in _strips(len(a)):
            v = block_values(a[at], b, metric, scale)
            ok = v <= bound if metric in DISTANCES else v >= bound
            i, j = np.nonzero(ok if apart else np.triu(ok, at.start + 1))
            kept.append((i + at.start, j, v[i, j]))
            if sum(len(x[0]) for x in kept) >= PACKED:
                put()
        if sum(len(x[0]) for x in kept):
            put()
        return pd.DataFrame(out, columns=["bl", "br", "i", "j", "val"])

    d = df.where("x is not null").select("obs_id", "x")
    members = d.select(_own(d).alias("block"), "obs_id").groupBy("block").agg(F.array_sort(F.collect_list("obs_id")).alias("ids"))
    pairs = cut_lineage(_wide_join(d, run, "bl int, br int, i binary, j binary, val binary"))
    return BlockEdges(pairs, cut_lineage(members))


#: Entries that :meth:`Kernel.middle` lists in the end rather than counts by digit.
LISTED = 1 << 16


def kernel_row_sums(df: DataFrame, metric: str = "rbf", scale: float = 1.0) -> DataFrame:
    """obs_id, row_sum of the dense kernel, diagonal included, for tables of any size: a block pair gives a sum a row, and
    no entry leaves its task. The work still grows with the square of the rows."""
    return Kernel(df, metric, scale).row_sums().drop("n")


def symmetrise(edges: DataFrame, how: str = "max") -> DataFrame:
    """Both directions of every edge, merged by ``max`` or by half the ``sum``."""
    both = edges.select("src", "dst", "val").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "val"))
    return both.groupBy("src", "dst").agg((F.max("val") if how == "max" else F.sum("val") / 2).alias("val"))


def knn_graph(df: DataFrame, k: int, weight: str = "binary", metric: str = "sqdist") -> DataFrame:
    """Symmetric nearest-neighbour edges weighted 1 (``binary``), 1 / (1 + d2) (``inverse``) or exp(-d2 / median d2)
    (``gaussian``)."""
    e = nearest(df, df, k, metric)
    if weight == "gaussian":
        e = cut_lineage(e)
        e = e.join(F.broadcast(percentiles(e, "val", [0.5]).select(F.col("q")[0].alias("_s")))).withColumn("val", F.exp(-F.col("val") / F.col("_s")))
    else:
        e = e.withColumn("val", F.lit(1.0) if weight == "binary" else 1 / (1 + F.col("val")))
    return symmetrise(e)


def median_bandwidth(df: DataFrame, metric: str = "sqdist") -> DataFrame:
    """One row, bandwidth: the median of all pairwise squared distances, zeros of the diagonal included; null without rows."""
    return df.sparkSession.createDataFrame([(Kernel(df, metric).middle(0.5),)], "bandwidth double")


def nearest_leader(df: DataFrame, leaders: DataFrame, metric: str = "cosine") -> DataFrame:
    """obs_id, leader, val: the best leader of each row; a leader leads itself."""
    own = leaders.select(F.col("obs_id").alias("src"), F.lit(1).alias("rank"), F.col("obs_id").alias("dst"), F.lit(0.0 if metric in DISTANCES else 1.0).alias("val"))
    rest = nearest(df.join(leaders.select("obs_id"), "obs_id", "left_anti"), leaders, 1, metric)
    return own.unionByName(rest).select(F.col("src").alias("obs_id"), F.col("dst").alias("leader"), "val")


def set_edges(sets: DataFrame, bound: float, key: str | None = None) -> DataFrame:
    """src, dst, val: Tanimoto similarity of sets (obs_id, item rows, distinct) of at least ``bound``, by shared items.

    Items are told apart by 64-bit hashes. With ``key`` (one for each obs_id) only sets with equal keys are compared, and
    null keys with none. How pairs are found is told in ``set_join``; the result holds every pair.
    """
    kind = dict(sets.dtypes)["obs_id"]
    rows = sets.where(F.col("obs_id").isNotNull() & (F.col(key).isNotNull() if key else F.lit(True))).withColumn("_code", F.xxhash64("item", *([key] if key else [])))
    ids = None
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        ids = cut_lineage(rows.select("obs_id").distinct().withColumn("_id", F.monotonically_increasing_id()))
        rows = rows.join(ids, "obs_id").withColumn("obs_id", F.col("_id"))
    lists = rows.groupBy(F.col("obs_id").cast("long").alias("obs_id")).agg(F.sort_array(F.collect_set("_code")).alias("codes"))
    same = F.sha2(F.concat_ws(",", F.col("codes").cast("array<string>")), 256)
    one, members = set_join.once(cut_lineage(lists).withColumn("_same", same), "_same")
    found = set_join.similar_sets(set_join.Sets(one, set_join.read_codes, members), bound)
    if ids is None:
        return found.select(F.col("src").cast(kind).alias("src"), F.col("dst").cast(kind).alias("dst"), "val")
    for end in ("src", "dst"):
        found = found.join(ids.select(F.col("_id").alias(end), F.col("obs_id").alias("_o")), end).withColumn(end, F.col("_o")).drop("_o")
    return found.select("src", "dst", "val")


def shingle_edges(texts: DataFrame, bound: float, key: str | None = None) -> DataFrame:
    """src, dst, val as :func:`set_edges` gives them, for the sets of three words in a row of texts (obs_id long, text rows).

    Case and the kind and number of spaces between words are ignored; a space at an end borders an empty word. Texts with
    fewer than three words have no set. Rows of one obs_id have one set together, which takes the plainer way by items.
    """
    keys = [key] if key else []
    rows = texts.where("obs_id IS NOT NULL").where(F.col(key).isNotNull() if key else F.lit(True))
    if rows.groupBy("obs_id").count().where("count > 1").limit(1).count():
        return set_edges(shingles(rows, *keys).distinct(), bound, key)
    salt = F.xxhash64(key) if key else F.lit(0).cast("long")
    rows = rows.where(F.col("text").rlike(f"{set_join.SPACES}[^{set_join.SPACES[1:]}+{set_join.SPACES}")).select("obs_id", F.lower("text").alias("text"), salt.alias("salt"))
    one, members = set_join.once(rows.withColumn("_same", F.concat("salt", F.lit(" "), F.sha2("text", 256))), "_same")
    return set_join.similar_sets(set_join.Sets(one, set_join.read_shingles, members), bound)


def shingles(texts: DataFrame, *more: str) -> DataFrame:
    """obs_id, ``more`` and item: a row for each distinct three words in a row of a text, hashed."""
    words = F.split(F.lower(F.regexp_replace("text", f"{set_join.SPACES}+", " ")), " ")
    w = texts.select("obs_id", *more, words.alias("w")).where(F.size("w") >= 3)
    grams = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.slice("w", i + 1, 3)))
    return w.select("obs_id", *more, F.explode(F.array_distinct(grams)).alias("item"))


def two_channel_edges(df: DataFrame, bound: float) -> DataFrame:
    """src, dst, val of two-entity rows (obs_id, p, l, w): max(p p', 0) x max(l l', 0) x w w' of at least ``bound``."""
    d = df.select("obs_id", F.concat("p", "l", F.array(F.col("w").cast("double"))).alias("x"))
    cut = df.select(F.size("p").alias("n")).limit(1).collect()
    if not cut:
        return df.sparkSession.createDataFrame([], _EDGE)
    n = cut[0].n

    def pick(p, q, a, b, apart):
        v = np.maximum(a[:, :n] @ b[:, :n].T, 0) * np.maximum(a[:, n:-1] @ b[:, n:-1].T, 0) * np.outer(a[:, -1], b[:, -1])
        i, j = np.nonzero((v >= bound) & (p["obs_id"].to_numpy()[:, None] != q["obs_id"].to_numpy()))
        return _both_ways(p, q, i, j, v[i, j], apart)

    return _self_join(d, pick)


def augment_by_target(edges: DataFrame, targets: DataFrame, nu: float, justification: str) -> DataFrame:
    """Edges with nu exp(-(y - y')**2) added; targets (obs_id, y) leak into the affinity, so a justification is required."""
    if not justification:
        raise ValueError("adding targets to the affinity needs a justification")
    t = targets.select("obs_id", "y")
    j = edges.join(t.withColumnsRenamed({"obs_id": "src", "y": "ys"}), "src").join(t.withColumnsRenamed({"obs_id": "dst", "y": "yd"}), "dst")
    return j.select("src", "dst", (F.col("val") + F.lit(float(nu)) * F.exp(-(F.col("ys") - F.col("yd")) * (F.col("ys") - F.col("yd")))).alias("val"))
