"""Embedding near-dedup with a navigable small-world graph per shard.

Different vectors are dealt by hash into shards; each shard's hierarchical graph is built once and
written with its vectors. A cell is an unordered pair of shards: its task searches each one's graph
with the vectors of the other, many searches at a time in lockstep through NumPy, so every vector
queries every shard. A search starts from rows that the graph's levels lead to and from rows that share
a key of random hyperplanes with the query: among unlike vectors the levels alone miss a lone partner
the more often the larger the graph is. A beam is widened until an audit passes, in which a sample drawn over all of
the cell's queries, and probes made at the threshold's distance from known vectors, are also answered by
brute force. The last widening, for a query whose whole beam lies inside the threshold and for a
shard whose audit fails, is the whole shard by blocked products. Pairs are verified by cosine in
double precision and counted at both ends, whichever end found them; links are joined into
components. Tasks emit a spanning forest of their links and a count for each vector, never the pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .components import connected_components

THRESHOLD = 0.9
#: Shards: at least SHARDS, and as many as keep the vectors of each within SHARD_BYTES (8 bytes a component).
SHARDS, SHARD_BYTES = 6, 64 << 20
#: Neighbours of a node (twice as many on the ground level), places for edges to nodes that none leads to.
DEGREE, BRIDGES = 12, 4
#: Beams of building and, at first, of searching.
BUILD_BEAM, BEAM = 48, 16
#: The audit: so many queries of a cell and as many probes, and the least share of their links that a beam must find.
AUDIT, RECALL = 256, 1.0
#: The highest level has at most so many nodes: it is read whole.
TOP = 1024
#: Keys of a graph's rows: tables, keys of a query in each, rows of a key and rows to start from at most, bits at most. They only give starts.
TABLES, KEYS, CROWD, STARTS, BITS = 12, 32, 4, 4, 20
#: Queries that advance together, candidates each expands in a step, products computed at once.
LOCKSTEP, EXPAND, BLOCK = 512, 4, 1 << 24


class Keys:
    """Rows by the sides of random hyperplanes on which they lie, several bits to a key and a key in each table: rows near each other share keys
    often, and a query also asks for the keys of its least certain bits turned over. What they give are rows for a search of the graph to start from."""

    def __init__(self, x: np.ndarray, seed: int = 0) -> None:
        n, dims = x.shape
        rng = np.random.default_rng(seed)
        self.bits = min(BITS, max(1, int(n).bit_length() - 1))
        width = min(dims, TABLES * self.bits)
        turns = [np.linalg.qr(rng.standard_normal((dims, width)))[0] for _ in range(-(-TABLES * self.bits // width))]
        self.turns = np.concatenate(turns, axis=1)[:, : TABLES * self.bits].astype(np.float32)
        off = x @ self.turns
        self.mid = np.median(off[:: max(1, n // 4096)], axis=0)
        off -= self.mid
        code, self.marks = self._codes(off), self._marks(off)
        size = 1 << self.bits
        flat = (code + size * np.arange(TABLES)).T.ravel()
        self.rows = (np.argsort(flat, kind="stable") % n).astype(np.int32)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=TABLES * size))]).astype(np.int32)
        least = min(self.bits, 10)
        sets = sorted((sum(r * (r + 1) for r in c), c) for k in range(min(least, 5) + 1) for c in itertools.combinations(range(1, least + 1), k))[:KEYS]
        self.turned = np.zeros((least, len(sets)), np.float32)
        for i, (_, c) in enumerate(sets):
            self.turned[[r - 1 for r in c], i] = 1

    def _codes(self, off: np.ndarray) -> np.ndarray:
        sides = (off > 0).reshape(-1, self.bits).astype(np.float32)
        return (sides @ (2.0 ** np.arange(self.bits, dtype=np.float32))).astype(np.int64).reshape(-1, TABLES)

    def _marks(self, off: np.ndarray) -> list[np.ndarray]:
        """All bits of a row, 64 to a number."""
        packed = np.packbits(off > 0, axis=1)
        packed = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))
        return list(np.ascontiguousarray(packed.view(np.uint64).T))

    def near(self, q: np.ndarray) -> np.ndarray:
        """For each row of q up to STARTS rows that share a key with it and two thirds of all bits, those with most bits first; -1 where there are fewer."""
        out = np.full((len(q), STARTS), -1, np.int64)
        off = q @ self.turns - self.mid
        unsure = np.argsort(np.abs(off).reshape(len(q), TABLES, self.bits), axis=2)[:, :, : len(self.turned)]
        turned = ((2.0**unsure).astype(np.float32).reshape(-1, len(self.turned)) @ self.turned).astype(np.int64).reshape(len(q), TABLES, -1)
        code = (turned ^ self._codes(off)[:, :, None]) + (np.arange(TABLES) << self.bits)[:, None]
        code = code.reshape(len(q), -1)
        first = self.starts[code]
        count = np.minimum(self.starts[code + 1] - first, CROWD)
        held = count > 0
        r, first, count = np.nonzero(held)[0], first[held], count[held]
        to = self.rows[np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())]
        r = np.repeat(r, count)
        unlike = np.zeros(len(r), np.int64)
        for own, asked in zip(self.marks, self._marks(off), strict=True):
            unlike += np.bitwise_count(own.take(to) ^ asked.take(r))
        good = np.flatnonzero(3 * unlike <= TABLES * self.bits)
        code = np.unique((r[good] * 1024 + unlike[good]) << 32 | to[good])
        r, to = code >> 42, code & 0xFFFFFFFF
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        out[r[rank < STARTS], rank[rank < STARTS]] = to[rank < STARTS]
        return out


class Graph:
    """A hierarchical navigable small-world graph over unit vectors (rows of x, in single precision).

    levels: from the ground up, ids of its nodes (rows, ascending) and their neighbours (places in ids, -1: none).
    entries: rows beside the levels' own from which some part of the ground can be reached only.
    keys: rows to start from beside those that the levels give, so that beams need not grow with the graph.
    """

    keys: Keys | None = None

    def __init__(self, x: np.ndarray, seed: int = 0) -> None:
        self.x, self.levels, self.entries = x, [], np.zeros(0, np.int64)
        n = len(x)
        height = (-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(16)).astype(int)
        h = 0
        while np.sum(height >= h) > TOP:
            h += 1
        for level in range(h, -1, -1):
            ids = np.arange(n) if level == 0 else np.flatnonzero(height >= level)
            self.levels.insert(0, (ids, self._built(ids, DEGREE if level else 2 * DEGREE)))
        self._connect()

    @classmethod
    def of_rows(cls, x: np.ndarray, near: list[bytes], up: list[bytes], entry: np.ndarray) -> Graph:
        """The graph that rows() wrote."""
        g = cls.__new__(cls)
        g.x, g.entries = x, np.flatnonzero(entry)
        g.levels = [(np.arange(len(x)), np.frombuffer(b"".join(near), "<i4").reshape(len(x), -1))]
        height = np.fromiter((len(b) for b in up), np.int64, len(up)) // (4 * DEGREE)
        for h in range(height.max(initial=0)):
            ids = np.flatnonzero(height > h)
            to = np.frombuffer(b"".join(up[i][4 * DEGREE * h : 4 * DEGREE * (h + 1)] for i in ids), "<i4").reshape(len(ids), -1)
            g.levels.append((ids, np.where(to < 0, -1, np.searchsorted(ids, to))))
        return g

    def rows(self) -> tuple[list[bytes], list[bytes], np.ndarray]:
        """For each row: its neighbours on the ground, those on each level above, and whether it is an entry."""
        n = len(self.x)
        up = [b""] * n
        for ids, near in self.levels[1:]:
            to = np.where(near < 0, -1, ids[near]).astype("<i4")
            for i, row in zip(ids.tolist(), to, strict=True):
                up[i] += row.tobytes()
        entry = np.zeros(n, bool)
        entry[self.entries] = True
        return [row.tobytes() for row in self.levels[0][1].astype("<i4")], up, entry

    def _built(self, ids: np.ndarray, degree: int) -> np.ndarray:
        """The neighbours of a level whose nodes are ids; batches that double in size search what stands so far."""
        n, x = len(ids), self.x[ids]
        near = np.full((n, degree), -1, np.int32)
        done = min(n, 256)
        _link(x, near, np.arange(done), None, degree)
        while done < n:
            batch = np.arange(done, min(n, done + max(256, done // 2)))
            for i in range(0, len(batch), 4096):
                part = batch[i : i + 4096]
                at = np.searchsorted(ids, self.entry(x[part])) if self.levels else np.zeros((len(part), 1), np.int64)
                at = np.where(at < done, at, 0)
                found = [search(x, near, x[part[j : j + LOCKSTEP]], at[j : j + LOCKSTEP], BUILD_BEAM)[0] for j in range(0, len(part), LOCKSTEP)]
                _link(x, near, part, np.concatenate(found), degree)
            done += len(batch)
        return near

    def entry(self, q: np.ndarray, width: int = 4) -> np.ndarray:
        """Rows to start from: the best of the highest level, followed down by narrow beams."""
        ids = self.levels[-1][0]
        out = _best(q, self.x[ids], ids, width)
        for ids, near in reversed(self.levels[1:-1]):
            x = self.x[ids]
            parts = [search(x, near, q[i : i + LOCKSTEP], np.searchsorted(ids, out[i : i + LOCKSTEP]), 2 * width)[0][:, :width] for i in range(0, len(q), LOCKSTEP)]
            out = ids[np.concatenate(parts)] if parts else out
        return out

    def query(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and similarities of the beam of each row of q, best first; -1 and -3 where there are fewer."""
        start = self.entry(q) if len(self.levels) > 1 else np.zeros((len(q), 1), np.int64)
        if self.entries.size:
            start = np.concatenate([start, _best(q, self.x[self.entries], self.entries, 2)], axis=1)
        if len(self.levels) > 1 and len(q):
            self.keys = self.keys or Keys(self.x)
            known = np.concatenate([self.keys.near(q[i : i + 2 * LOCKSTEP]) for i in range(0, len(q), 2 * LOCKSTEP)])
            start = np.concatenate([start, np.where(known < 0, start[:, :1], known)], axis=1)
        start.sort(axis=1)
        beam = max(beam, start.shape[1])
        got = [search(self.x, self.levels[0][1], q[i : i + LOCKSTEP], start[i : i + LOCKSTEP], beam) for i in range(0, len(q), LOCKSTEP)]
        return np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])

    def _connect(self) -> None:
        """Makes every row reachable: a node that no edge leads to gets one from a neighbour of its own;
        of a part that has no edge to the rest, one row becomes an entry."""
        n, near = len(self.x), self.levels[0][1]
        near = np.concatenate([near, np.full((n, BRIDGES), -1, np.int32)], axis=1)
        own, used = near.shape[1] - BRIDGES, np.zeros(n, np.int64)
        seen = np.zeros(n, bool)
        entries = []

        def spread(front: np.ndarray) -> None:
            while front.size:
                seen[front] = True
                front = np.unique(near[front])
                front = front[front >= 0]
                front = front[~seen[front]]

        spread(np.unique(self.levels[-1][0]) if len(self.levels) > 1 else np.zeros(min(n, 1), np.int64))
        while not seen.all():
            added = []
            for k in range(own):
                lost = np.flatnonzero(~seen)
                to = near[lost, k]
                fit = (to >= 0) & seen[to] & (used[to] < BRIDGES)
                to, at = np.unique(to[fit], return_index=True)
                lost = lost[fit][at]
                near[to, own + used[to]] = lost
                used[to] += 1
                seen[lost] = True
                added.append(lost)
            if lost_and_found := [a for a in added if a.size]:
                spread(np.concatenate(lost_and_found))
            else:
                entries.append(int(np.flatnonzero(~seen)[0]))
                spread(np.array(entries[-1:]))
        self.levels[0] = (self.levels[0][0], near)
        self.entries = np.array(entries, np.int64)


def _best(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """For each row of q the ids of the k rows of x most similar to it."""
    k = min(k, len(ids))
    step = max(1, BLOCK // max(1, len(ids)))
    parts = [np.argpartition(-(q[i : i + step] @ x.T), k - 1, axis=1)[:, :k] for i in range(0, len(q), step)]
    return ids[np.concatenate(parts)] if parts else np.zeros((0, k), np.int64)


def _link(x: np.ndarray, near: np.ndarray, new: np.ndarray, found: np.ndarray | None, degree: int) -> None:
    """Gives each new node diverse neighbours among found ones and the batch itself, and links back."""
    k = min(degree, len(new) - 1)
    cand = np.zeros((len(new), 0), np.int64) if found is None else found
    if k > 0:
        sims = x[new] @ x[new].T
        np.fill_diagonal(sims, -2)
        cand = np.concatenate([cand, new[np.argpartition(-sims, k - 1, axis=1)[:, :k]]], axis=1)
    near[new] = diverse(x, x[new], cand, degree)
    # Back links: each target chooses anew among its neighbours and those that chose it.
    src = np.repeat(new, degree)
    dst = near[new].ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    at, start, count = np.unique(dst, return_index=True, return_counts=True)
    width = 2 * degree
    rank = np.arange(len(dst)) - np.repeat(start, count)
    extra = np.full((len(at), width), -1, np.int64)
    row = np.repeat(np.arange(len(at)), count)
    extra[row[rank < width], rank[rank < width]] = src[rank < width]
    near[at] = diverse(x, x[at], np.concatenate([near[at].astype(np.int64), extra], axis=1), degree)


def diverse(x: np.ndarray, q: np.ndarray, cand: np.ndarray, degree: int) -> np.ndarray:
    """For each row of q up to degree of its candidates, nearest first, skipping those nearer to a
    chosen one than to q; places left over are filled with the nearest skipped ones."""
    out = np.full((len(q), degree), -1, np.int32)
    for i in range(0, len(q), 1024):
        c = np.sort(cand[i : i + 1024], axis=1)
        c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
        sims = np.where(c >= 0, np.matmul(x[c], q[i : i + 1024, :, None])[:, :, 0], np.float32(-3))
        top = np.argsort(-sims, axis=1)[:, : 2 * degree]
        c, sims = np.take_along_axis(c, top, 1), np.take_along_axis(sims, top, 1)
        v = x[c]
        between = np.matmul(v, v.transpose(0, 2, 1))
        keep = np.zeros(c.shape, bool)
        for k in range(c.shape[1]):
            keep[:, k] = (c[:, k] >= 0) & ~((between[:, k, :k] > sims[:, k, None]) & keep[:, :k]).any(1)
        rank = np.argsort(np.where(keep, 0, np.where(c >= 0, 1, 2)), axis=1, kind="stable")[:, :degree]
        got = np.take_along_axis(c, rank, 1)
        out[i : i + 1024, : got.shape[1]] = got
    return out


def _dots(x: np.ndarray, i: np.ndarray, q: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Dot products of rows i of x with rows j of q, so many at once as stay near the processor."""
    out = np.empty(len(i), np.float32)
    for k in range(0, len(i), 2048):
        out[k : k + 2048] = np.einsum("nd,nd->n", x.take(i[k : k + 2048], axis=0, mode="clip"), q.take(j[k : k + 2048], axis=0, mode="clip"))
    return out


def search(x: np.ndarray, near: np.ndarray, q: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of all rows of q in lockstep: ids and similarities, best first, -1 and -3 where fewer.
    start: rows of x to begin at, at most beam of them; a row's repeats count once."""
    n, rows = len(q), np.arange(len(q))[:, None]
    seen = np.zeros((n, len(x)), bool)
    ids = np.full((n, beam), -1, np.int64)
    sims = np.full((n, beam), -3, np.float32)
    start = np.sort(start, axis=1)
    k = start.shape[1]
    again = np.zeros(start.shape, bool)
    again[:, 1:] = start[:, 1:] == start[:, :-1]
    first = np.where(again, np.float32(-3), np.matmul(x[start], q[:, :, None])[:, :, 0])
    order = np.argsort(-first, axis=1)
    sims[:, :k] = np.take_along_axis(first, order, 1)
    ids[:, :k] = np.where(sims[:, :k] > -2, np.take_along_axis(start, order, 1), -1)
    open_ = ids >= 0
    seen[rows, start] = True
    been = seen.ravel()  # the same places by one number
    live = np.arange(n)
    while live.size:
        o = open_[live]
        pick = np.argsort(~o, axis=1, kind="stable")[:, :EXPAND]  # beams are sorted: the best open ones
        on = np.take_along_axis(o, pick, 1)
        nodes = np.where(on, np.take_along_axis(ids[live], pick, 1), -1)
        o[np.arange(len(live))[:, None], pick] = False
        nxt = np.where(nodes[:, :, None] >= 0, near[nodes], -1).reshape(len(live), -1)
        nxt.sort(axis=1)
        new = nxt >= 0
        new[:, 1:] &= nxt[:, 1:] != nxt[:, :-1]
        at = np.flatnonzero(new)
        r, to = at // nxt.shape[1], nxt.ravel()[at].astype(np.int64)
        place = live[r] * len(x) + to
        fresh = np.flatnonzero(~been.take(place))
        r, to = r[fresh], to[fresh]
        been[place[fresh]] = True
        found = _dots(x, to, q, live[r])
        better = found > sims[live[r], -1]
        r, to, found = r[better], to[better], found[better]
        count = np.bincount(r, minlength=len(live))
        width = int(count.max(initial=0))
        place = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
        more_ids, more_sims = np.full((len(live), width), -1, np.int64), np.full((len(live), width), -3, np.float32)
        more_ids[r, place], more_sims[r, place] = to, found
        all_sims = np.concatenate([sims[live], more_sims], axis=1)
        top = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
        ids[live] = np.take_along_axis(np.concatenate([ids[live], more_ids], axis=1), top, 1)
        sims[live] = np.take_along_axis(all_sims, top, 1)
        open_[live] = np.take_along_axis(np.concatenate([o, more_ids >= 0], axis=1), top, 1)
        live = live[open_[live].any(1)]
    return ids, sims


class Side:
    """One shard of a cell: unit vectors in double precision, their names and copies, and the graph."""

    def __init__(self, x: np.ndarray, node: np.ndarray, copies: np.ndarray, graph: Graph) -> None:
        self.x, self.node, self.copies, self.graph = x, node, copies, graph

    def __len__(self) -> int:
        return len(self.x)


def _verified(q: np.ndarray, x: np.ndarray, r: np.ndarray, c: np.ndarray, sims: np.ndarray, threshold: float, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs with single-precision similarities over threshold - slack, those whose cosine in double precision is not below."""
    near = np.flatnonzero(sims < threshold + slack)
    ok = np.ones(len(r), bool)
    for i in range(0, near.size, 1 << 16):
        at = near[i : i + (1 << 16)]
        ok[at] = np.einsum("nd,nd->n", q[r[at]], x[c[at]]) >= threshold
    return r[ok], c[ok]


def slack_of(dims: int) -> float:
    """More than single precision can be off for unit vectors."""
    return max(1e-5, 2e-7 * dims)


def products(side: Side, of: Side, rows: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of `of`, row of side) of all links of the given rows of `of`, in blocks of bounded size."""
    slack, x = slack_of(side.x.shape[1]), side.graph.x
    step = max(1, BLOCK // max(1, len(x)))
    for i in range(0, len(rows), step):
        part = rows[i : i + step]
        p = of.graph.x[part] @ x.T
        at = np.flatnonzero(p >= threshold - slack)
        r, c = at // len(x), at % len(x)
        yield _verified(of.x, side.x, part[r], c, p.ravel()[at], threshold, slack)


def audited_beam(side: Side, of: Side, threshold: float, least: float = RECALL, seed: int = 0) -> int | None:
    """The beam, widened from BEAM, with which both a sample of the rows of `of` and probes at the threshold's
    distance from rows of side find the asked share of their links; None if only the whole shard would do.
    A link of a row with itself says nothing; a row whose beam is full counts as answered, since products answer it."""
    rng, x = np.random.default_rng(seed), side.graph.x
    rows = np.sort(rng.permutation(len(of))[:AUDIT])
    asked = of.graph.x[rows]
    true = [(r, c) for a, c in products(side, of, rows, threshold) for r, c in [(np.searchsorted(rows, a), c)]]
    r, c = (np.concatenate(z) for z in zip(*true, strict=True)) if true else (np.zeros(0, int),) * 2
    if side is of:
        r, c = r[rows[r] != c], c[rows[r] != c]
    known = rng.permutation(len(x))[:AUDIT]
    off = rng.standard_normal((len(known), x.shape[1])).astype(np.float32)
    off -= np.einsum("nd,nd->n", off, x[known])[:, None] * x[known]
    length = np.linalg.norm(off, axis=1, keepdims=True)
    to = min(threshold + 1e-3, 1.0)
    probes = to * x[known] + np.sqrt(1 - to * to) * off / np.where(length > 0, length, 1)
    beam = BEAM
    while 8 * beam <= len(x):
        ids, sims = side.graph.query(asked, beam)
        full = sims[:, -1] >= threshold
        found = (ids[r] == c[:, None]).any(1) | full[r]
        got, at = side.graph.query(probes, beam)
        hit = (got == known[:, None]).any(1) | (at[:, -1] >= threshold)
        if found.sum() >= least * len(r) and hit.sum() >= least * len(known):
            return beam
        beam *= 2
    return None


def searched(side: Side, of: Side, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Searches side with all rows of `of`: rows of `of` that products must answer, and links of the others (row of `of`, row of side)."""
    beam = audited_beam(side, of, threshold)
    if beam is None:
        return np.arange(len(of)), np.zeros(0, np.int64), np.zeros(0, np.int64)
    slack, dense, found = slack_of(side.x.shape[1]), [], []
    for i in range(0, len(of), 4 * LOCKSTEP):
        ids, sims = side.graph.query(of.graph.x[i : i + 4 * LOCKSTEP], beam)
        full = sims[:, -1] >= threshold - slack
        dense.append(np.flatnonzero(full) + i)
        r, c = np.nonzero((sims >= threshold - slack) & ~full[:, None])
        found.append(_verified(of.x, side.x, r + i, ids[r, c], sims[r, c], threshold, slack))
    r, c = (np.concatenate(z) for z in zip(*found, strict=True))
    return np.concatenate(dense), r, c


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows (node, least node joined to it) by the given pairs, for nodes that are not the least themselves."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], least)
        np.minimum.at(new, root[j], least)
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    low = root != np.arange(len(nodes))
    return np.stack([nodes[low], nodes[root[low]]], axis=1)


def cell_links(a: Side, b: Side, threshold: float = THRESHOLD) -> tuple[list[np.ndarray], np.ndarray]:
    """Links between the rows of two shards (or within one, if a is b): for each side how many rows, copies
    counted, each row links to, and a spanning forest of their names.

    Rows that products answer have all their links, and give them to their partners too; other links
    are the union of what both directions found. So a link counts at both its ends or at neither.
    """
    counts = {id(s): np.zeros(len(s), np.int64) for s in (a, b)}
    trees: list[np.ndarray] = []

    def add(of: Side, r: np.ndarray, side: Side, c: np.ndarray, back: np.ndarray | None = None) -> None:
        np.add.at(counts[id(of)], r, side.copies[c])
        at = slice(None) if back is None else back
        np.add.at(counts[id(side)], c[at], of.copies[r[at]])
        if r.size:
            trees.append(forest(of.node[r], side.node[c]))

    whole_b, rb, cb = searched(a, b, threshold)
    if a is b:
        whole_a, ra, ca = whole_b, np.zeros(0, np.int64), np.zeros(0, np.int64)
    elif len(whole_b) == len(b):
        whole_a, ra, ca = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    else:
        whole_a, ra, ca = searched(b, a, threshold)
    dense_a, dense_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    dense_a[whole_a], dense_b[whole_b] = True, True
    for of, whole, side, dense in ((b, whole_b, a, dense_a), (a, whole_a, b, dense_b)):
        for r, c in products(side, of, whole, threshold):
            if side is of:
                r, c = r[r != c], c[r != c]
            add(of, r, side, c, np.flatnonzero(~dense[c]))  # a dense partner counts this link itself
        if a is b:
            break
    r, c = np.concatenate([rb, ca]), np.concatenate([cb, ra])
    r, c = (z[~dense_b[r] & ~dense_a[c]] for z in (r, c))
    if a is b:
        r, c = np.minimum(r, c), np.maximum(r, c)
        r, c = r[r != c], c[r != c]
    code = np.unique(r * max(1, len(a)) + c)
    add(b, code // max(1, len(a)), a, code % max(1, len(a)))
    tree = np.concatenate(trees) if trees else np.zeros((0, 2), np.int64)
    return [counts[id(s)] for s in ((a,) if a is b else (a, b))], forest(*tree.T)


def _unit_vectors(column: pa.Array, n: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that the norm cannot overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Rows of consecutive batches by the values of their first columns, as slices."""
    at, held = None, []
    for batch in batches:
        cols = [batch.column(i).to_numpy() for i in range(keys)]
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        for lo, hi in zip([0, *new], [*new, batch.num_rows], strict=True):
            if lo == hi:
                continue
            key = tuple(int(c[lo]) for c in cols)
            if key != at and held:
                yield at, held
                held = []
            at = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield at, held


def _write_graphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, size, node, copies, v) of whole shards with their graph: near, up, entry."""
    for _, parts in _runs(batches, 2):
        x = np.concatenate([_unit_vectors(p.column(4), p.num_rows) for p in parts])
        near, up, entry = Graph(x.astype(np.float32)).rows()
        at = 0
        for p in parts:
            to = at + p.num_rows
            cols = [*p.columns, pa.array(near[at:to], pa.binary()), pa.array(up[at:to], pa.binary()), pa.array(entry[at:to])]
            yield pa.RecordBatch.from_arrays(cols, names=["shard", "size", "node", "copies", "v", "near", "up", "entry"])
            at = to


def _side(parts: list[pa.RecordBatch]) -> Side:
    """From rows (cell, size, shard, node, copies, v, near, up, entry) of one shard."""
    x = np.concatenate([_unit_vectors(p.column(5), p.num_rows) for p in parts])
    node, copies, entry = (np.concatenate([p.column(i).to_numpy(zero_copy_only=False) for p in parts]) for i in (3, 4, 8))
    near, up = ([b for p in parts for b in p.column(i).to_pylist()] for i in (6, 7))
    return Side(x, node, copies, Graph.of_rows(x.astype(np.float32), near, up, entry))


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per input row: vec_id, n_links (other rows linked directly), component_id (least vec_id
    reachable), kept (vec_id = component_id).

    Rows of equal vectors link with each other and share their links. Null or empty vectors, those of
    norm zero and those with null or non-finite components link with nothing and form components of
    their own, as does any vector of other length than its partners. Repeated vec_ids count as rows; a
    null vec_id takes part, names no component that has an id and is never kept. An empty table gives no
    rows. Every vector meets every shard, so what is shuffled and computed grows with vectors times shards.
    """
    given = vectors.schema[vector_col].dataType.elementType.simpleString()
    v = F.col(vector_col).cast("array<double>")
    good = F.coalesce((F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(good, v).alias("v"))
    rows = rows.withColumn("v", F.when(F.col("v").isNotNull(), F.transform("v", lambda c: c + F.lit(0.0))).cast(f"array<{'float' if given == 'float' else 'double'}>"))  # -0.0 as 0.0
    # Classes of equal vectors, named by their least vec_id (a class without any is named by its hash).
    rows = materialise(rows.withColumn("h", F.when(F.col("v").isNotNull(), F.struct(F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")))), "vectors")
    classes = rows.where("v is not null").groupBy("h").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.min("v").alias("v"))
    classes = materialise(classes.withColumns({"least": F.col("node"), "node": F.coalesce("node", "h.h1")}), "classes")
    n_bytes = classes.agg(F.sum(F.size("v") * 8)).first()[0] or 0
    shards = max(SHARDS, -(-n_bytes // SHARD_BYTES))

    shard = F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int").alias("shard")
    dealt = classes.select(shard, F.size("v").alias("size"), "node", "copies", "v").repartitionById(shards, "shard").sortWithinPartitions("shard", "size", "node")
    kind = dealt.schema["v"].dataType.simpleString()
    graphs = materialise(dealt.mapInArrow(_write_graphs, f"shard int, size int, node long, copies long, v {kind}, near binary, up binary, entry boolean"), "graphs")

    # Cell {i, j} is numbered max (max + 1) / 2 + min; each shard's rows go to all of its cells.
    low, high = (lambda s, f=f: f(F.col("shard"), s) for f in (F.least, F.greatest))
    cell = F.explode(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: (high(s) * (high(s) + 1) / 2 + low(s)).cast("int"))).alias("cell")
    cells = graphs.select(cell, "size", "shard", "node", "copies", "v", "near", "up", "entry").repartitionById(shards * (shards + 1) // 2, "cell").sortWithinPartitions("cell", "size", "shard", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(sides: list[Side]) -> pa.RecordBatch:
            counts, tree = cell_links(sides[0], sides[-1], threshold)
            names, n = np.concatenate([s.node for s in sides]), np.concatenate(counts)
            names, n = names[n > 0], n[n > 0]
            a, b = tree.T
            cols = (np.r_[names, a], np.r_[names, b], np.r_[n, np.zeros(len(a), np.int64)])
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["a", "b", "n"])

        at, sides = None, []
        for (cell_, size, shard_), parts in _runs(batches, 3):
            if (cell_, size) != at:
                sides = []
            at = cell_, size
            sides.append(_side(parts))
            high_ = int((np.sqrt(8 * cell_ + 1) - 1) / 2)
            if len(sides) == 2 or cell_ == high_ * (high_ + 3) // 2:
                yield out(sides)
                sides = []

    found = materialise(cells.mapInArrow(run, "a long, b long, n long"), "vector-links")
    counts = found.where("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    roots = connected_components(found.where("n = 0").select("a", "b"))
    named = classes.select("h", "node", "least", "copies").join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("least_id"))
    named = named.join(least, "root").select("h", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least_id", "root").alias("component_id"))
    out = rows.select("vec_id", "h").join(named, "h", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
