"""Approximate nearest neighbours by cosine: inverted lists, scanned with an adaptive number of dimensions.

Unit vectors are turned by a random rotation, so that the first t of d coordinates are a fair sample of a distance. Within
a probed list, coordinates are read in column blocks. After each block a hypothesis test abandons every candidate whose
partial distance, scaled by d / t, is beyond the query's bound by more than ``EPSILON`` / sqrt(t) of it: such a candidate
is farther than the bound with high probability. The bound is the query's k-th smallest full distance so far: it is
carried from list to list, and a first pass over each query's nearest lists hands it to the pass over the others. Only
where a query has no bound yet is it taken from the candidates that look best after the first block. Survivors are scored
exactly, on the original vectors, in double precision.

There are about sqrt(n) lists. Centroids and the number of lists to probe are fitted on a sample (smallest hash of
vec_id) of ``SAMPLE_A_LIST`` vectors a list, at most ``SAMPLE_BYTES``; every vector is in the index. Neighbouring lists
share a group of at most about ``GROUP`` vectors and a list beyond that has several, so a common vector or a large list is
spread over tasks. A query goes once to each group that has lists it probes. A query that finds fewer than k neighbours
so is searched again over all lists.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, map_rows, mix, written

SAMPLE_A_LIST, SAMPLE_BYTES, LEAST_SAMPLE = 32, 256 << 20, 4096
#: Vectors of a group (fewer in small tables), and queries that meet it in one task.
GROUP, LEAST_GROUP, QUERY_BLOCK = 16_384, 2048, 32_768
MOST_LISTS = 4096
#: Share of the probed lists that a query's first pass covers.
FIRST_PASS = 0.1
EPSILON, COLUMNS = 2.1, 16
#: Recall that the number of probed lists must reach on the sample.
SAMPLE_RECALL = 0.97


@dataclass
class Index:
    """Lists of the most common dimension, then one list for each other dimension; groups of lists."""

    dim: int
    rotation: np.ndarray
    centroids: np.ndarray
    probes: int
    other: dict[int, int] = field(default_factory=dict)  # dimension -> its list
    first_group: np.ndarray | None = None  # per list, and how many groups it has of its own
    groups: np.ndarray | None = None

    def order(self, unit: np.ndarray) -> np.ndarray:
        """All lists of the common dimension for each unit vector, nearest first."""
        return np.argsort((self.centroids**2).sum(1) - 2 * unit @ self.centroids.T, axis=1, kind="stable")

    def grouped(self, sizes: dict[int, int], dims: list[int], group: int) -> "Index":
        """With groups for lists of these sizes."""
        lists = len(self.centroids)
        other = {d: lists + i for i, d in enumerate(dims)}
        first, count, at, room = np.zeros(lists + len(dims), np.int64), np.ones(lists + len(dims), np.int64), 0, 0
        for i in range(len(first)):
            n = sizes.get(i, 0)
            if n > room or i >= lists:
                first[i], count[i] = at, max(1, -(-n // group))
                at += int(count[i])
                room = group - n if count[i] == 1 and i < lists else 0
            else:
                first[i], room = at - 1, room - n
        return replace(self, other=other, first_group=first, groups=count)


def valid_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, dim and vec (doubles, as bytes) of the rows that take part: not null, not zero, all components finite."""

    def run(b: pa.RecordBatch) -> dict:
        out: dict = {"vec_id": [], "dim": [], "vec": []}
        for i, v in zip(b.column("vec_id").to_pylist(), b.column("v").to_pylist()):
            if i is None or not v or None in v:
                continue
            x = np.array(v, np.float64)
            if np.isfinite(x).all() and x.any():
                out["vec_id"].append(i)
                out["dim"].append(len(x))
                out["vec"].append(x.tobytes())
        return out

    return map_rows(rows.select("vec_id", F.col("embedding").cast("array<double>").alias("v")), run, "vec_id long, dim int, vec binary")


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow or underflow of squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(vectors: DataFrame, k: int, rounds: int = 8) -> Index | None:
    """Rotation, centroids and number of probes from the sample's most common dimension; None without vectors."""
    n, widest = vectors.agg(F.count("*"), F.max("dim")).first()
    if not n:
        return None
    lists = int(np.clip(round(n**0.5), 1, MOST_LISTS))
    sample = max(1, min(max(LEAST_SAMPLE, SAMPLE_A_LIST * lists), SAMPLE_BYTES // (8 * widest)))
    got = vectors.orderBy(mix(F.col("vec_id"), 23), "vec_id", "vec").limit(sample).select("dim", "vec").collect()
    dims, counts = np.unique([r.dim for r in got], return_counts=True)
    dim = int(dims[len(dims) - 1 - counts[::-1].argmax()])
    x = _unit(np.frombuffer(b"".join(bytes(r.vec) for r in got if r.dim == dim), np.float64).reshape(-1, dim))
    rng = np.random.default_rng(7)
    q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
    lists = min(lists, max(1, len(x) // 8))
    c = x[rng.choice(len(x), lists, replace=False)]

    def nearest_list() -> np.ndarray:
        return np.concatenate([((c**2).sum(1) - 2 * x[i : i + 8192] @ c.T).argmin(1) for i in range(0, len(x), 8192)])

    for _ in range(rounds):
        near = nearest_list()
        size = np.bincount(near, minlength=lists)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], c)
    index = Index(dim, q * np.sign(np.diag(r)), c, lists)
    asked = x[:300]
    sims = asked @ x.T
    sims[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    near = nearest_list()
    true = np.argsort(-sims, axis=1)[:, : min(k, len(x) - 1)]
    if true.size:
        rank = np.argsort(index.order(asked), axis=1)
        need = np.sort(np.take_along_axis(rank, near[true], 1).ravel())
        index.probes = int(need[min(len(need) - 1, int(np.ceil(SAMPLE_RECALL * len(need))) - 1)]) + 1
    return index


@dataclass
class Vectors:
    """Some rows' ids and vectors, their lengths, and the rotated unit vectors."""

    ids: np.ndarray
    vec: np.ndarray
    norm: np.ndarray
    turned: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, vec: np.ndarray, rotation: np.ndarray | None) -> "Vectors":
        unit = _unit(vec)
        return cls(ids, vec, np.linalg.norm(vec, axis=1), unit if rotation is None else unit @ rotation)

    def __getitem__(self, at) -> "Vectors":
        return Vectors(self.ids[at], self.vec[at], self.norm[at], self.turned[at])

    def __len__(self) -> int:
        return len(self.ids)


def scan_list(base: Vectors, queries: Vectors, k: int, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The k best rows of one list for each query, but for those beyond its ``bound`` (squared distance of unit vectors):
    query row, base row, exact cosine, and how many coordinates were read."""
    d, read, found = base.turned.shape[1], 0, []
    bu = base.turned
    for at in range(0, len(queries), 256):
        part_q = queries[at : at + 256]
        q = part_q.turned
        most = np.full(len(q), np.inf) if bound is None else bound[at : at + 256].copy()
        t = min(COLUMNS, d)
        part = np.maximum((q[:, :t] ** 2).sum(1)[:, None] + (bu[:, :t] ** 2).sum(1) - 2 * q[:, :t] @ bu[:, :t].T, 0)
        part[part_q.ids[:, None] == base.ids] = np.inf
        read += part.size * t
        free = np.flatnonzero(~np.isfinite(most))
        if len(free) and part.shape[1] >= k:
            first = np.argpartition(part[free], k - 1, axis=1)[:, :k]
            full = ((q[free][:, None, :] - bu[first]) ** 2).sum(2)
            full[~np.isfinite(np.take_along_axis(part[free], first, 1))] = np.inf
            most[free] = full.max(1)
            read += first.size * (d - t)
        slack = (1 + EPSILON / np.sqrt(t)) ** 2 * t / d if t < d else 1 + 1e-9
        i, j = np.nonzero((part <= (most * slack)[:, None] + 1e-12) & np.isfinite(part))
        dist = part[i, j]
        while t < d:
            s = min(t + COLUMNS, d)
            gap = q[i, t:s] - bu[j, t:s]
            dist = dist + np.einsum("ij,ij->i", gap, gap)
            read += len(i) * (s - t)
            t = s
            slack = (1 + EPSILON / np.sqrt(t)) ** 2 * t / d if t < d else 1 + 1e-9
            live = dist <= most[i] * slack + 1e-12
            i, j, dist = i[live], j[live], dist[live]
        score = cosines(part_q, base, i, j)
        order = np.lexsort((base.ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        top = np.arange(len(i)) - np.searchsorted(i, i, "left") < k
        found.append((i[top] + at, j[top], score[top]))
    return *(np.concatenate(x) for x in zip(*found)), read


def cosines(queries: Vectors, base: Vectors, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact cosines of pairs of rows, on the original vectors."""
    with np.errstate(all="ignore"):
        dot = np.einsum("ij,ij->i", queries.vec[i], base.vec[j])
    with np.errstate(all="ignore"):
        score = dot / (queries.norm[i] * base.norm[j])
    lengths = np.stack([queries.norm[i], base.norm[j]])
    odd = np.flatnonzero(~((lengths > 1e-140) & (lengths < 1e140)).all(0))
    if len(odd):  # products may be out of a double's range
        score[odd] = np.einsum("ij,ij->i", _unit(queries.vec[i[odd]]), _unit(base.vec[j[odd]]))
    return score


def scan_group(base: Vectors, lists: np.ndarray, queries: Vectors, probed: list[np.ndarray], bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of a group's rows for each query: query row, base row, exact cosine. ``lists`` is each row's list, and
    ``probed`` the lists that each query probes, nearest first; bounds tighten from list to list."""
    best = np.full((len(queries), k), -np.inf)
    who = np.repeat(np.arange(len(probed)), list(map(len, probed)))
    rank = np.concatenate([np.arange(len(p)) for p in probed])
    which = np.concatenate(probed)
    found = []
    # Lists in the order of their mean rank among the queries that probe them.
    names, at, n = np.unique(which, return_inverse=True, return_counts=True)
    for name in names[np.argsort(np.bincount(at, rank) / n, kind="stable")]:
        rows = np.flatnonzero(lists == name)
        if not len(rows):
            continue
        asked = who[which == name]
        limit = np.minimum(bound[asked], 2 - 2 * best[asked, k - 1])
        i, j, score, _ = scan_list(base[rows], queries[asked], k, np.where(np.isfinite(limit), limit + 1e-12, np.inf))
        if not len(i):
            continue
        nth = np.arange(len(i)) - np.searchsorted(i, i, "left")
        both = np.full((len(asked), 2 * k), -np.inf)
        both[:, :k] = best[asked]
        both[i, k + nth] = score
        best[asked] = -np.sort(-both, axis=1)[:, :k]
        found.append((asked[i], rows[j], score))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    i, j, score = (np.concatenate(x) for x in zip(*found))
    keep = score >= best[i, k - 1]
    i, j, score = i[keep], j[keep], score[keep]
    order = np.lexsort((base.ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    top = np.arange(len(i)) - np.searchsorted(i, i, "left") < k
    return i[top], j[top], score[top]


def nearest(rows: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows found to each row whose vec_id is divisible by ``every``.

    Rows with a null id, or whose vector is null, empty, zero, or has null or non-finite components, take no part. Rows
    of the most common dimension are searched through the index; each other dimension is a list of its own, searched
    whole: vectors of different dimensions are not compared. Of rows that share a query's id, the query is the one with
    the smallest bytes and none is its candidate; repeated candidates each count. Ties go to the smaller vec_id. A query
    without candidates has no rows, as an empty table has none. Columns other than vec_id and embedding are ignored.
    """
    spark = rows.sparkSession
    vectors = written(valid_vectors(rows), "ann-vectors")
    index = fit(vectors, k)
    if index is None:
        discard(vectors)
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = sorted(r.dim for r in vectors.where(F.col("dim") != index.dim).select("dim").distinct().collect())
    index = index.grouped({}, dims, GROUP)
    shared = spark.sparkContext.broadcast(index)

    def to_list(b: pa.RecordBatch) -> dict:
        index, dim = shared.value, b.column("dim").to_numpy()
        place = np.array([index.other.get(d, 0) for d in dim.tolist()], np.int64)
        same = np.flatnonzero(dim == index.dim)
        if len(same):
            vecs = b.column("vec").to_pylist()
            place[same] = index.order(_unit(np.frombuffer(b"".join(bytes(vecs[i]) for i in same), np.float64).reshape(-1, index.dim)))[:, 0]
        return {"vec_id": b.column("vec_id"), "list": place.tolist(), "vec": b.column("vec")}

    base = written(map_rows(vectors, to_list, "vec_id long, list int, vec binary"), "ann-lists")
    own = vectors.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("vec", "dim")).alias("m")).select("vec_id", "m.dim", "m.vec")

    def to_near(b: pa.RecordBatch) -> dict:
        index, dim, vecs = shared.value, b.column("dim").to_numpy(), b.column("vec").to_pylist()
        near = [[index.other.get(d)] for d in dim.tolist()]
        same = np.flatnonzero(dim == index.dim)
        if len(same):
            order = index.order(_unit(np.frombuffer(b"".join(bytes(vecs[i]) for i in same), np.float64).reshape(-1, index.dim)))
            for i, lists in zip(same.tolist(), order[:, : index.probes].tolist()):
                near[i] = lists
        return {"vec_id": b.column("vec_id"), "dim": dim.tolist(), "vec": b.column("vec"), "near": near}

    asked = written(map_rows(own, to_near, "vec_id long, dim int, vec binary, near array<int>"), "ann-queries")
    discard(vectors)
    sizes = {r["list"]: r.n for r in base.groupBy("list").agg(F.count("*").alias("n")).collect()}  # a row a list: at most MOST_LISTS and the other dimensions
    index = index.grouped(sizes, dims, int(np.clip(sum(sizes.values()) // 64, LEAST_GROUP, GROUP)))
    shared = spark.sparkContext.broadcast(index)
    of_list = spark.createDataFrame([(i, int(f), int(c)) for i, (f, c) in enumerate(zip(index.first_group, index.groups))], "list int, first int, count int")
    base = base.join(F.broadcast(of_list), "list").select("vec_id", "list", "vec", (F.col("first") + F.pmod(mix(F.col("vec_id"), 29), F.col("count"))).cast("int").alias("group"))

    def to_groups(b: pa.RecordBatch) -> dict:
        index = shared.value
        out: dict = {"vec_id": [], "group": [], "lists": [], "bound": [], "vec": []}
        for i, near, bound, vec in zip(*(b.column(c).to_pylist() for c in ("vec_id", "near", "bound", "vec"))):
            near = np.array(near, np.int64)
            count = index.groups[near]
            lists = np.repeat(near, count)
            place = index.first_group[lists] + np.arange(len(lists)) - np.repeat(np.cumsum(count) - count, count)
            for g in np.unique(place).tolist():
                for name, v in zip(out, (i, g, lists[place == g].tolist(), bound, vec)):
                    out[name].append(v)
        return out

    def search(b, q):
        if b.empty or q.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        x, y = (np.frombuffer(b"".join(map(bytes, t["vec"])), np.float64).reshape(len(t), -1) for t in (b, q))
        rotation = shared.value.rotation if x.shape[1] == shared.value.dim else None
        base, queries = (Vectors.of(t["vec_id"].to_numpy(), v, rotation) for t, v in ((b, x), (q, y)))
        i, j, score = scan_group(base, b["list"].to_numpy(), queries, [np.asarray(p) for p in q["lists"]], q["bound"].to_numpy(np.float64), k)
        return pd.DataFrame({"query_id": queries.ids[i], "vec_id": base.ids[j], "score": score})

    def hits(queries: DataFrame) -> DataFrame:
        """The k best rows that each group has for a query in its near lists."""
        sent = written(map_rows(queries.where("size(near) > 0").select("vec_id", "near", "bound", "vec"), to_groups, "vec_id long, group int, lists array<int>, bound double, vec binary"), "ann-sent")
        loads = sent.groupBy("group").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("parts"))  # a row a group
        left = base.join(loads, "group").select("vec_id", "list", "vec", "group", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        right = sent.join(loads, "group").select("vec_id", "lists", "bound", "vec", "group", F.pmod(mix(F.col("vec_id"), 31), F.col("parts")).cast("int").alias("part"))
        keys = ["group", "part"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score double")

    def best(found: DataFrame) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    def bounded(found: DataFrame) -> DataFrame:
        """The queries with their k-th best squared distance so far."""
        kth = found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), (2 - 2 * F.col("score")).alias("bound"))
        return asked.join(kth, "vec_id", "left").select("vec_id", "dim", "vec", "near", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))

    # Lists that a query has met are stored with it, so passes can't meet one twice.
    first = max(1, round(FIRST_PASS * index.probes))
    near = F.col("near")
    found = written(best(hits(asked.select("vec_id", "vec", F.slice(near, 1, first).alias("near"), F.lit(float("inf")).alias("bound")))), "ann-first")
    if first < index.probes:
        rest = bounded(found).select("vec_id", "vec", F.slice(near, first + 1, index.probes).alias("near"), "bound")
        found = written(best(found.select("query_id", "vec_id", "score").unionByName(hits(rest))), "ann-found")
    if index.probes < len(index.centroids):
        short = bounded(found).where((F.col("bound") == float("inf")) & (F.col("dim") == index.dim))
        if not short.isEmpty():
            rest = short.select("vec_id", "vec", F.array_except(F.sequence(F.lit(0), F.lit(len(index.centroids) - 1)), near).alias("near"), "bound")
            found = best(found.select("query_id", "vec_id", "score").unionByName(hits(rest)))
    return found


def op4_adaptive_scan_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors found to each whose vec_id is divisible by 50, of all."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
