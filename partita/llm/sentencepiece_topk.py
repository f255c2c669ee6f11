"""SentencePiece segmentations sampled without replacement: Gumbel top-k by a perturbed A* search over the lattice.

The lattice of a text has an edge for every vocabulary piece that matches somewhere, and byte pieces for characters that
no piece has. A segmentation's probability is the product of its pieces' scores to the power ``alpha``, over the sum for
all segmentations.

Each segmentation's log-probability is perturbed by an independent Gumbel variable; the k largest are a sample of k
*without replacement*. They are found top-down, without visiting others: a search node is a set of segmentations, a
shared prefix and the edges that may not follow it, valued by the largest perturbed log-probability in it. That value
is exact, drawn from a truncated Gumbel with the set's log-mass (backward sums over the lattice give it), so best-first
search pops one new segmentation at a time: it draws the path that attains the value, and pushes, for every step of it,
the set of those that leave the path there. The largest value left after k pops, kappa, gives the inclusion probability
``1 - exp(-exp(log p - kappa))``.

Probabilities are held as logarithms. A node's most probable edge has that of one plus the sum of the others' ratios to
it, so the mass that remains beside an edge is exact however small it is, and no segmentation is lost beside a sure one.

Pieces never cross certain boundaries (before a blank, between letters and other characters), which is checked against
the vocabulary; the lattice is a chain of segments' lattices, built once per distinct segment. Long segments' lattices are
dropped with the texts that need them, and the others all at once when there are too many edges. All draws for a text
come from a generator that is seeded by its key.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import cached, documents, map_rows, only
from .shingles import mix64

BLANK = "▁"
#: Edges that are held at a time, about 21 bytes each, and the longest segment whose lattice is held.
MEMO_EDGES, MEMO_CHARS = 12_000_000, 40
#: Characters of long segments that are sampled at a time, beyond a single text's.
SCRATCH_CHARS = 1 << 18
#: Up to this power the ratios of the masses that leave a node stay within what a double holds.
MAX_ALPHA = 8.0
#: Piece r (by rank) has log-probability -log(r + ZIPF), less a constant: the file has merge ranks, not probabilities.
ZIPF = 10.0
#: Texts sampled at a time: their arrays should fit a core's cache.
SUB_BATCH = 48
_fine = re.compile(r"▁*[^\W\d_²]+|▁*(?:[^\w▁\n]|[_²])+|▁+|\n|\d|\w").findall
_coarse = re.compile("▁*[^▁]+|▁+").findall


_HASH = np.uint64(0x9E3779B97F4A7C15)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Lattices:
    """Lattices of segments, flat: nodes with a range of edges, edges with cumulative probability, target and ids.

    ``alpha`` must be positive and at most ``MAX_ALPHA``. At most ``memo`` edges are held from batch to batch, and the
    long segments of one group of texts (see :meth:`groups`).
    """

    def __init__(self, path: str, alpha: float = 1.0, memo: int = MEMO_EDGES):
        from sentencepiece import SentencePieceProcessor

        if not 0 < alpha <= MAX_ALPHA:
            raise ValueError(f"alpha must be above 0 and at most {MAX_ALPHA}")

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.alpha, self.memo = alpha, memo
        self.bytes_of = [b""] * n
        pieces: dict[str, int] = {}
        byte_ids: dict[int, int] = {}
        for i in range(n):
            if sp.is_byte(i):
                byte_ids[int(sp.id_to_piece(i)[1:-1], 16)] = i
                self.bytes_of[i] = bytes([int(sp.id_to_piece(i)[1:-1], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                pieces[sp.id_to_piece(i)] = i
                self.bytes_of[i] = sp.id_to_piece(i).encode()
        first = min(pieces.values())
        scores = np.array([-math.log(i - first + ZIPF) for i in pieces.values()])
        scores -= np.log(np.exp(scores).sum())
        self.pieces = {p: (i, alpha * float(s)) for (p, i), s in zip(pieces.items(), scores)}
        self.byte_ids, self.byte_score = byte_ids, alpha * (float(scores.min()) - 2.0)
        self.longest = max(map(len, pieces))
        self.cut = _fine if all(len(_fine(p)) == 1 for p in pieces) else _coarse
        self.unk = sp.unk_id()
        # Per length: hashes of all pieces' beginnings of that length, ascending, and the piece that it is (or -1).
        self.by_length = {}
        for n in range(1, self.longest + 1):
            some = {p[:n]: (-1, 0.0) for p in self.pieces if len(p) >= n}
            some.update((p, x) for p, x in self.pieces.items() if len(p) == n)
            code = np.zeros(len(some), np.uint64)
            for c in np.array([list(map(ord, p)) for p in some], np.uint64).T:
                code = code * _HASH + c + np.uint64(1)
            order = np.argsort(code)
            self.by_length[n] = (code[order], np.array([i for i, _ in some.values()])[order], np.array([x for _, x in some.values()])[order])
        self.reset()

    def reset(self) -> None:
        self.starts: dict[str, int] = {}
        self.passing: list[str] = []
        self.long: set[str] = set()
        self.n_nodes = self.n_edges = 0
        self.raw: list[list[int]] = []  # ids of characters that are no piece; such an edge has -1 - index as its piece
        # Per node its first edge; per edge the running probability at its node (2 at the last), the logarithm of its own,
        # how many characters it takes (0: all that are left), and its piece.
        kinds = {"first_edge": np.int64, "cum": np.float64, "logp": np.float64, "step": np.uint8, "piece": np.int32}
        for name, kind in kinds.items():
            setattr(self, name, np.zeros(1 << 16, kind))
        self.kept = (0, 0, 0)

    def forget(self) -> None:
        """Drop the long segments' lattices, which stand behind the others."""
        n, e, r = self.kept
        self.n_nodes, self.n_edges = n, e
        del self.raw[r:]
        for s in self.passing:
            del self.starts[s]
        self.passing = []
        for name, used in (("first_edge", n), ("cum", e), ("logp", e), ("step", e), ("piece", e)):
            a = getattr(self, name)
            if len(a) > 2 * used + (1 << 22):
                setattr(self, name, a[: used + (1 << 16)].copy())

    def _put(self, name: str, start: int, values: np.ndarray) -> None:
        a = getattr(self, name)
        if len(a) < start + len(values):
            a = np.concatenate([a, np.zeros(max(len(a) // 2, start + len(values) - len(a)), a.dtype)])
            setattr(self, name, a)
        a[start : start + len(values)] = values

    def build(self, segments: list[str]) -> None:
        """Add segments' lattices, all at once; edges stand in order of falling probability at each node."""
        if not segments:
            return
        size = np.fromiter(map(len, segments), np.int64, len(segments))
        chars = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        n = len(chars)
        begin = np.cumsum(size) - size
        left = np.repeat(begin + size, size) - np.arange(n)  # characters to the segment's end
        # Edges: substrings that are pieces, found by their hash, length by length.
        src, length, piece, score = [], [], [], []
        at, code, single = np.arange(n), np.zeros(n, np.uint64), np.zeros(n, bool)
        for size_now in range(1, min(self.longest, int(left.max())) + 1):
            on = left[at] >= size_now
            at, code = at[on], code[on]
            code = code * _HASH + chars[at + size_now - 1]
            codes, ids, scores = self.by_length[size_now]
            k = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            on = np.flatnonzero(codes[k] == code)
            at, code, k = at[on], code[on], k[on]
            hit = np.flatnonzero(ids[k] >= 0)
            src.append(at[hit])
            length.append(np.full(len(hit), size_now))
            piece.append(ids[k[hit]])
            score.append(scores[k[hit]])
            if size_now == 1:
                single[at[hit]] = True
        alone = np.flatnonzero(~single)
        raw = [chr(int(chars[i]) - 1).encode("utf-8", "surrogatepass") for i in alone.tolist()]
        src, length = np.concatenate([*src, alone]), np.concatenate([*length, np.ones(len(alone), np.int64)])
        piece = np.concatenate([*piece, -1 - np.arange(len(alone))]).astype(np.int64)
        score = np.concatenate([*score, self.byte_score * np.fromiter(map(len, raw), np.float64, len(raw))])
        # Backward sums, from the segments' ends to their starts.
        order = np.argsort(left[src] * n + src, kind="stable")
        src, length, piece, score = src[order], length[order], piece[order], score[order]
        beta, weight = np.zeros(n), np.empty(len(src))
        levels = np.searchsorted(left[src], np.arange(1, int(left.max()) + 2))
        for a, b in zip(levels[:-1].tolist(), levels[1:].tolist()):
            i, j = src[a:b], src[a:b] + length[a:b]
            w = score[a:b] + np.where(length[a:b] < left[i], beta[np.minimum(j, n - 1)], 0.0)
            heads = np.flatnonzero(np.diff(i, prepend=-1))
            top = np.maximum.reduceat(w, heads)
            total = np.add.reduceat(np.exp(w - np.repeat(top, np.diff(heads, append=len(i)))), heads)
            beta[i[heads]] = top + np.log(total)
            weight[a:b] = w
        logp = weight - beta[src]
        order = np.argsort(src - np.exp(logp) * 0.999, kind="stable")
        src, length, piece, logp = src[order], length[order], piece[order], logp[order]
        heads = np.flatnonzero(np.diff(src, prepend=-1))
        degree = np.diff(heads, append=len(src))
        ratio = np.exp(logp - np.repeat(logp[heads], degree))
        ratio[heads] = 0.0
        logp[heads] = -np.log1p(np.add.reduceat(ratio, heads))
        prob = np.exp(logp)
        cum = np.cumsum(prob)
        cum -= np.repeat(cum[heads] - prob[heads], degree)
        cum[heads + degree - 1] = 2.0
        node0, edge0 = self.n_nodes, self.n_edges
        self._put("first_edge", node0, edge0 + heads)
        self._put("cum", edge0, cum)
        self._put("logp", edge0, logp)
        self._put("step", edge0, np.where(length < left[src], length, 0))
        self._put("piece", edge0, np.where(piece < 0, piece - len(self.raw), piece))
        self.raw += [[self.byte_ids.get(b, self.unk) for b in x] for x in raw]
        self.starts.update(zip(segments, (node0 + begin).tolist()))
        self.n_nodes, self.n_edges = node0 + n, edge0 + len(src)

    def segments(self, texts: list[str]) -> list[list[str]]:
        """Each text's segments, as SentencePiece reads it: a blank first, blanks for spaces. Short ones' lattices are built."""
        self.forget()
        if self.n_edges > self.memo:
            self.reset()
        cut = [self.cut(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        new = {s for c in cut for s in c}.difference(self.starts)
        self.long = {s for s in new if len(s) > MEMO_CHARS}
        self.build(list(new - self.long))
        self.kept = (self.n_nodes, self.n_edges, len(self.raw))
        return cut

    def groups(self, cut: list[list[str]]) -> Iterator[tuple[int, int, list[np.ndarray]]]:
        """Texts from .. to that are sampled together and the first node of each of their segments.

        Long segments' lattices are built here, and dropped when the next group is asked for.
        """
        i = 0
        while i < len(cut):
            j, new, chars = i, set(), 0
            while j < len(cut) and j - i < SUB_BATCH and (j == i or chars < SCRATCH_CHARS):
                if self.long:
                    more = self.long.intersection(cut[j]).difference(new)
                    chars += sum(map(len, more))
                    new |= more
                j += 1
            if self.passing:
                self.forget()
            self.passing = list(new)
            self.build(self.passing)
            get = self.starts.__getitem__
            yield i, j, [np.fromiter(map(get, c), np.int64, len(c)) for c in cut[i:j]]
            i = j

    def nodes(self, texts: list[str]) -> list[np.ndarray]:
        """The first nodes of the texts' segments, for a few texts at a time."""
        return [n for _, _, nodes in self.groups(self.segments(texts)) for n in nodes]

    def walk(self, nodes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges of a path drawn from each node on to its segment's end, one after another, and how many each took.

        The draws of a path are a function of its key.
        """
        taken, who = [], []
        live, step = np.arange(len(nodes)), 0
        while len(live):
            step += 1
            u = _uniform(keys, step)
            e = self.first_edge[nodes]
            far = np.flatnonzero(u > self.cum[e])
            v, x = u[far], e[far]
            while len(far):
                x = x + 1
                on = v > self.cum[x]
                e[far] = x
                far, v, x = far[on], v[on], x[on]
            taken.append(e)
            who.append(live)
            ahead = self.step[e]
            on = np.flatnonzero(ahead)
            live, nodes, keys = live[on], nodes[on] + ahead[on], keys[on]
        if not taken:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        count = np.zeros(len(taken[0]), np.int64)
        for w in who:
            count[w] += 1
        start = np.cumsum(count) - count
        edges = np.empty(int(count.sum()), np.int64)
        for t, (w, e) in enumerate(zip(who, taken)):
            edges[start[w] + t] = e
        return edges, count

    def node_of(self, edge: int) -> int:
        """The node that an edge leaves."""
        return int(np.searchsorted(self.first_edge[: self.n_nodes], edge, "right")) - 1

    def token_ids(self, edges: np.ndarray) -> np.ndarray:
        p = self.piece[edges]
        odd = np.flatnonzero(p < 0)
        if not len(odd):
            return p.astype("<u4")
        at = [0, *(odd + 1).tolist()]
        parts = [x for i, j, k in zip(at, odd.tolist(), odd.tolist()) for x in (p[i:j], self.raw[-1 - int(p[k])])]
        return np.concatenate([*parts, p[at[-1] :]]).astype("<u4")

    def joined(self, ids: np.ndarray) -> bytes:
        """The bytes of ids' pieces, with their blanks."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: blanks back to spaces, the first one dropped."""
        text = self.joined(ids).decode("utf-8", "replace").replace(BLANK, " ")
        return text[1:] if text[:1] == " " else text


def _uniform(keys: np.ndarray, salt: int) -> np.ndarray:
    """Uniform variables in (0, 1), a function of keys and salt."""
    x = mix64(keys + np.uint64((salt * 0x9E3779B97F4A7C15) & (2**64 - 1)))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class _Path:
    """One round's paths of a batch of texts: each one's edges and their segments, and the flat range of values that stand
    in the queue for its steps from ``at`` on; the steps before are an earlier path's."""

    def __init__(self, edges: list[np.ndarray], segs: list[np.ndarray], at: list[int]):
        self.edges, self.segs, self.at = edges, segs, at
        self.size = np.array([len(e) for e in edges]) - at
        self.begin = np.cumsum(self.size) - self.size
        self.barred: dict[int, list[int]] = {}


def _log_beside(logp: np.ndarray) -> np.ndarray:
    """log(1 - exp(logp)), exact for small and large probabilities; -inf beside a sure one."""
    return np.log(-np.expm1(logp))


def sample_batch(lat: Lattices, texts: list[np.ndarray], keys: np.ndarray, k: int) -> tuple[list[list[tuple[np.ndarray, float, float]]], np.ndarray]:
    """For each text, a chain of segments given by their first nodes, up to k distinct paths, best first: (edges,
    log-probability, perturbed value); and each text's kappa. A text's result depends on its own key alone."""
    n = len(texts)
    found: list[list] = [[(np.zeros(0, np.int64), 0.0, 0.0)] if k and not len(t) else [] for t in texts]
    kappa = np.full(n, -np.inf)
    if k < 1:
        return found, kappa
    which = [i for i in range(n) if len(texts[i])]
    # A set's value, its text, round and place there; the best of each round is kept up to date.
    value = -np.log(-np.log(_uniform(keys, 0x10001)))
    rounds: list[tuple[_Path, np.ndarray, np.ndarray, list[int], np.ndarray]] = []
    branch: dict[int, tuple[int, int]] = {}
    for r in range(k):
        if not which:
            break
        own = mix64(keys[which] + np.uint64(r + 1))
        heads, first_seg, rest = [], [], []
        ahead_of = np.zeros(len(which))  # log-probability of the steps taken over
        barred: dict[int, tuple[list[int], list[int]]] = {}  # edges that may not follow here, and those that still may
        for j, i in enumerate(which):
            if not r:
                heads.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
                first_seg.append(0)
                rest.append(texts[i])
                continue
            q, spot = branch[i]
            path, _, _, members, before = rounds[q]
            m = members.index(i) if members[min(j, len(members) - 1)] != i else j
            e_old, s_old = path.edges[m], path.segs[m]
            at = spot - int(path.begin[m]) + path.at[m]
            ahead_of[j] = before[spot]
            out = path.barred.get(spot) or [int(e_old[at])]
            s = int(s_old[at])
            node = lat.node_of(int(e_old[at]))
            lo = hi = int(lat.first_edge[node])
            while lat.cum[hi] < 1.5:
                hi += 1
            free = [e for e in range(lo, hi + 1) if e not in out]
            p = lat.logp[free]
            p = np.cumsum(np.exp(p - p.max()))
            e = free.pop(min(int(np.searchsorted(p, float(_uniform(own[j : j + 1], 0x10003)[0]) * p[-1])), len(free) - 1))
            barred[j] = [*out, e], free
            ahead = int(lat.step[e])
            nxt = node + ahead if ahead else -1
            heads.append((np.append(e_old[:at], e), s_old[: at + 1]))
            first_seg.append(s + (nxt < 0))
            rest.append(texts[i][s + 1 :] if nxt < 0 else np.concatenate([[nxt], texts[i][s + 1 :]]))
        sizes = np.array([len(x) for x in rest])
        begin = np.cumsum(sizes) - sizes
        index = np.arange(int(sizes.sum())) - np.repeat(begin, sizes) + np.repeat(first_seg, sizes)
        tails, count = lat.walk(np.concatenate(rest), mix64(np.repeat(own, sizes) + index.astype(np.uint64)))
        tail_segs = np.repeat(index, count)
        ends = np.concatenate([[0], np.cumsum(count)])
        cut = ends[np.append(begin, len(count))]
        edges, segs, ats = [], [], []
        for j, (e, s) in enumerate(heads):
            edges.append(np.concatenate([e, tails[cut[j] : cut[j + 1]]]))
            segs.append(np.concatenate([s, tail_segs[cut[j] : cut[j + 1]]]))
            ats.append(max(0, len(e) - 1))
        path = _Path(edges, segs, ats)
        logs = lat.logp[np.concatenate([e[at:] for e, at in zip(edges, ats)])]
        sums = np.cumsum(logs)
        base = np.where(path.begin > 0, sums[path.begin - 1], 0.0) - ahead_of
        owner = np.repeat(np.arange(len(which)), path.size)
        with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
            left = _log_beside(logs)
            for j, (out, free) in barred.items():
                spot = int(path.begin[j])
                left[spot] = np.logaddexp.reduce(lat.logp[free]) if free else -np.inf
                path.barred[spot] = out
            before = sums - logs - base[owner]
            mass = before + left
            step = np.arange(len(owner)) + (np.array(ats) - path.begin)[owner]
            noise = -np.log(_uniform(own[owner] + step.astype(np.uint64), 0x10007))
            values = mass - np.log(np.exp(mass - value[which][owner]) + noise)
        total = sums[path.begin + path.size - 1] - base
        for j, i in enumerate(which):
            found[i].append((edges[j], float(total[j]), float(value[i])))
        rounds.append((path, values, np.maximum.reduceat(values, path.begin), list(which), before))
        top, branch = {}, {}
        for q, (_, _, best, members, _) in enumerate(rounds):
            for m, i in enumerate(members):
                if best[m] > top.get(i, (-np.inf,))[0]:
                    top[i] = (float(best[m]), q, m)
        kappa[:] = -np.inf
        for i, (x, q, m) in top.items():
            kappa[i] = value[i] = x
            path, values, best, _, _ = rounds[q]
            a, z = int(path.begin[m]), int(path.begin[m] + path.size[m])
            spot = a + int(values[a:z].argmax())
            branch[i] = (q, spot)
            if r + 1 < k:
                values[spot] = -np.inf
                best[m] = values[a:z].max()
        which = sorted(top)
    return found, kappa


def inclusion(log_p: float, kappa: float) -> float:
    """The probability that a segmentation is among the k, given the threshold kappa."""
    return 1.0 if kappa == -math.inf else -math.expm1(-math.exp(min(log_p - kappa, 700.0)))


def row_keys(ids: list, seed: int) -> np.ndarray:
    """A 64-bit key of each row."""
    x = np.array([(0 if i is None else 2 * int(i) + 1) & (2**64 - 1) for i in ids], np.uint64)
    return mix64(mix64(x) ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 1) & (2**64 - 1)))


def sample_documents(docs: DataFrame, k: int = 3, alpha: float = 1.0, seed: int = 1, model: str | None = None, digest: bool = False) -> DataFrame:
    """k segmentations, sampled without replacement, of each whole text of ``docs`` (doc_id, text).

    Columns: doc_id, sample (from 1, by falling perturbed value), n_tokens, log_prob, inclusion, and ids or, with
    ``digest``, ids_crc32 and round_trip (decoding gives the text back). A text with fewer than k segmentations gives
    them all, with inclusion 1. Null and empty texts have one segmentation, of no pieces. Draws depend on doc_id and
    ``seed`` alone: rows that share a doc_id and text get the same samples; null ids share one seed. ``alpha`` above
    ``MAX_ALPHA``, or not positive, is refused. Very long texts are sampled whole; a worker holds the lattice of one
    text's long segments at a time. Other columns are ignored. An empty table gives an empty result.
    """
    path = model or model_path()

    def run(b: pa.RecordBatch) -> dict:
        lat = _lattices(path, alpha)
        keys, texts = b.column("doc_id").to_pylist(), [t or "" for t in b.column("text").to_pylist()]
        out: dict = {n: [] for n in ("doc_id", "sample", "n_tokens", "log_prob", "inclusion", *(("ids_crc32", "round_trip") if digest else ("ids",)))}
        seeds = row_keys(keys, seed)
        for i, j, nodes in lat.groups(lat.segments(texts)):
            found, kappas = sample_batch(lat, nodes, seeds[i:j], k)
            for key, text, paths, kappa in zip(keys[i:j], texts[i:j], found, kappas.tolist()):
                whole = (BLANK + text.replace(" ", BLANK)).encode("utf-8", "surrogatepass") if digest and text and BLANK not in text else None
                for r, (edges, log_p, _) in enumerate(paths, 1):
                    ids = lat.token_ids(edges)
                    row = (key, r, len(ids), log_p, inclusion(log_p, kappa))
                    row += (zlib.crc32(ids.tobytes()), lat.joined(ids) == whole if whole else lat.decode(ids) == text) if digest else (ids.astype(np.int32),)
                    for name, v in zip(out, row):
                        out[name].append(v)
        return out

    last = "ids_crc32 long, round_trip boolean" if digest else "ids array<int>"
    return map_rows(only(docs, "doc_id", "text"), run, f"doc_id long, sample int, n_tokens long, log_prob double, inclusion double, {last}", keeps_cache=True)


def _lattices(path: str, alpha: float) -> Lattices:
    return cached(("lattices", path, alpha), lambda: Lattices(path, alpha))


def op1_sentencepiece_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three segmentations of every whole document, with their digests."""
    return sample_documents(documents(spark, sf_dir), digest=True)
