"""Trees of more different objects than a matrix holds, made by rounds over blocks of rows: quadratic time for each round, no quadratic memory.

A round finds each cluster's nearest one, in tasks over two blocks of rows each, and merges each two
that are strictly nearest to each other.  Reducible linkages never bring another cluster nearer to a
pair than its parts were, so that such merges are in the tree whatever comes before them.  When few
clusters are left their matrix is made and `kernels.linkage` ends the tree.  Single linkage takes each
cluster's nearest edge instead, as every one of them is in the spanning tree.
"""

from __future__ import annotations

import heapq

import numpy as np

from . import kernels as K

TILE = 128  # rows whose distances to a block are made at once
BLOCK = 6_000  # rows of a block
ADDED = ("average", "mcquitty", "weighted", "ward", "ward.D2", "ward.D", "flexible")
ROUNDS = ("single", "complete", *ADDED)


def reducible(linkage: str, alpha: float) -> bool:
    return linkage in ROUNDS and (linkage != "flexible" or alpha >= 0.5)


def pooled(pair, a: np.ndarray, b: np.ndarray, how):
    """(lo, hi, m): how (a ufunc) over the rows of each two clusters, lo to hi of one side with all of the other; a, b: where clusters' rows end."""
    start_a, start_b = np.append(0, a[:-1]), np.append(0, b[:-1])
    lo = 0
    while lo < len(a):
        hi = int(max(lo + 1, np.searchsorted(a, start_a[lo] + TILE, "right")))
        got = None
        for k in range(int(start_a[lo]), int(a[hi - 1]), TILE):
            d = pair(slice(k, int(min(k + TILE, a[hi - 1]))))
            if len(b) < d.shape[1]:
                d = how.reduceat(d, start_b, 1)
            if hi - lo == 1:
                d = how.reduce(d, 0, keepdims=True)
            elif hi - lo < len(d):
                d = how.reduceat(d, start_a[lo:hi] - start_a[lo], 0)
            got = d if got is None else how(got, d)
        yield lo, hi, got
        lo = hi


class State:
    """Clusters of a round, in order of their rows; what merges made them counts where the linkage needs it."""

    def __init__(self, x, count, linkage, alpha, distances):
        n = len(x)
        self.x, self.linkage, self.alpha, self.distances = x, linkage, alpha, distances
        self.square = linkage in ("ward", "ward.D2")
        self.of, self.size = np.arange(n), count.astype(float)
        self.weight = np.ones(n) if linkage in ("mcquitty", "weighted", "single", "complete") else count.astype(float)
        if linkage == "flexible":
            most = np.ones(int(count.max()) + 1)
            for k in range(2, len(most)):
                most[k] = alpha * (most[k - 1] + 1)
            self.weight = most[count]
        self.within, self.lift = np.zeros(n), np.zeros(n)
        # flexible: merges, each with its height, its share in its cluster now, and its cluster
        self.tall, self.share, self.at = np.zeros(0), np.zeros(0), np.zeros(0, int)
        self.order()

    def order(self):
        """Rows, weights and ends by cluster, for blocks to be cut from."""
        self.rows = np.argsort(self.of, kind="stable")
        n = len(self.size)
        self.ends = np.searchsorted(self.of[self.rows], np.arange(n), "right")
        if self.linkage == "flexible":  # a cluster without merges has one that does not count
            none = np.setdiff1d(np.arange(n), self.at)
            at = np.concatenate([self.at, none])
            o = np.argsort(at, kind="stable")
            self.merged = np.concatenate([self.tall, np.zeros(len(none))])[o], np.concatenate([self.share, np.zeros(len(none))])[o]
            self.merged_ends = np.searchsorted(at[o], np.arange(n), "right")

    def cuts(self):
        """Blocks as clusters lo to hi, of about BLOCK rows."""
        marks = np.arange(0, len(self.x), BLOCK)
        lo = np.unique(np.searchsorted(self.ends, marks, "right"))
        return list(zip(lo.tolist(), np.append(lo[1:], len(self.ends)).tolist(), strict=True))

    def side(self, lo, hi):
        first = int(self.ends[lo - 1]) if lo else 0
        rows = self.rows[first : self.ends[hi - 1]]
        return self.x[rows], self.weight[rows], self.ends[lo:hi] - first

    def merges_of(self, lo, hi):
        first = int(self.merged_ends[lo - 1]) if lo else 0
        cut = slice(first, self.merged_ends[hi - 1])
        return self.merged[0][cut], self.merged[1][cut], self.merged_ends[lo:hi] - first

    def between(self, a, b):
        """(lo, hi, dissimilarities, sums of rows) of the clusters of block a with all of block b."""
        (x, w, ea), (y, v, eb) = self.side(*a), self.side(*b)
        made = self.distances(y)
        added = self.linkage in ADDED
        plain = bool((w == 1).all() and (v == 1).all())

        def pair(cut):
            d = made(x[cut])
            if self.square:
                d *= d
            if added and not plain:
                d *= w[cut, None]
                d *= v
            return d

        how = np.add if added else np.minimum if self.linkage == "single" else np.maximum
        more = None
        if self.linkage == "flexible" and len(self.tall):
            (h, p, ha), (g, q, hb) = self.merges_of(*a), self.merges_of(*b)
            more = (h, p, ha, g, q, hb)
        sa, sb = self.size[slice(*a)], self.size[slice(*b)]
        wa, wb = self.within[slice(*a)] / sa**2 / 2, self.within[slice(*b)] / sb**2 / 2
        la, lb = self.lift[slice(*a)], self.lift[slice(*b)]
        for lo, hi, s in pooled(pair, ea, eb, how):
            cut = slice(lo, hi)
            if self.linkage == "average":
                d = s / (sa[cut, None] * sb)
            elif self.linkage in ("ward", "ward.D2", "ward.D"):
                n = sa[cut, None] * sb
                d = 2 * n / (sa[cut, None] + sb) * (s / n - wa[cut, None] - wb)
            elif self.linkage == "flexible":
                d = s + (1 - 2 * self.alpha) * (la[cut, None] + lb)
                if more:
                    d += (1 - 2 * self.alpha) * (2 * self.alpha - 1) * self.lower(more, lo, hi)
            else:
                d = s.copy()
            yield lo, hi, d, s

    @staticmethod
    def lower(more, lo, hi):
        """Sums over merges of two clusters of the lower height, times both shares."""
        h, p, ha, g, q, hb = more
        first = int(ha[lo - 1]) if lo else 0
        h, p = h[first : ha[hi - 1]], p[first : ha[hi - 1]]
        got = [m for _, _, m in pooled(lambda c: np.minimum(h[c, None], g) * p[c, None] * q, ha[lo:hi] - first, hb, np.add)]
        return np.concatenate(got)

    def nearest(self, a, b):
        """For the clusters of block a, and of b where it is another: number of the nearest in the other, its dissimilarity, the next one's, the sum of rows."""
        new = lambda n: [np.full(n, -1), np.full(n, np.inf), np.full(n, np.inf), np.zeros(n)]
        mine, theirs = new(a[1] - a[0]), new(b[1] - b[0])
        labels = self.labels if self.linkage == "single" else None
        for lo, hi, d, s in self.between(a, b):
            if labels is not None:
                d[labels[a[0] + lo : a[0] + hi, None] == labels[b[0] : b[1]]] = np.inf
            elif a == b:
                d[np.arange(hi - lo), np.arange(lo, hi)] = np.inf
            if a != b:
                c = np.arange(d.shape[1])
                k = d.argmin(0)
                best, sums = d[k, c], s[k, c]
                d[k, c] = np.inf
                closer(theirs, slice(None), a[0] + lo + k, best, d.min(0), sums)
                d[k, c] = best
            r = np.arange(hi - lo)
            k = d.argmin(1)
            best, sums = d[r, k], s[r, k]
            d[r, k] = np.inf
            closer(mine, slice(lo, hi), b[0] + k, best, d.min(1), sums)
        return a, mine, b, theirs

    def merge(self, a, b, h, sums):
        """Clusters a take in clusters b."""
        n = len(self.size)
        hit = np.zeros(n, bool)
        hit[a], hit[b] = True, True
        if self.linkage in ("mcquitty", "weighted", "flexible"):
            self.weight[hit[self.of]] *= self.alpha if self.linkage == "flexible" else 0.5
        if self.linkage == "flexible":
            self.share[hit[self.at]] *= self.alpha
            self.tall, self.share, self.at = np.append(self.tall, h), np.append(self.share, np.ones(len(h))), np.append(self.at, a)
            self.lift[a] = self.alpha * (self.lift[a] + self.lift[b]) + h
        self.within[a] += self.within[b] + 2 * sums
        self.size[a] += self.size[b]
        into, keep = np.arange(n), np.ones(n, bool)
        into[b], keep[b] = a, False
        new = np.cumsum(keep) - 1
        self.of, self.at = new[into[self.of]], new[into[self.at]]
        self.size, self.within, self.lift = self.size[keep], self.within[keep], self.lift[keep]
        self.order()
        return keep


def closer(got, cut, at, best, second, sums):
    """Nearest and next so far, with those of other clusters."""
    k, b, s, m = got
    nearer = best < b[cut]
    s[cut] = np.minimum(np.minimum(np.maximum(best, b[cut]), s[cut]), second)
    k[cut], m[cut] = np.where(nearer, at, k[cut]), np.where(nearer, sums, m[cut])
    b[cut] = np.minimum(best, b[cut])


def fanned(spark, state, run):
    """run(state, a, b) for each two blocks, a task each."""
    cuts = state.cuts()
    pairs = [(a, b) for k, a in enumerate(cuts) for b in cuts[k:]]
    if len(pairs) == 1:
        yield run(state, *pairs[0])
        return
    sent = spark.sparkContext.broadcast(state)
    try:
        yield from spark.sparkContext.parallelize(pairs, len(pairs)).map(lambda p: run(sent.value, *p)).collect()
    finally:
        sent.destroy()


def tree(spark, x: np.ndarray, of: np.ndarray, distances, linkage: str, alpha: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Merges and heights of all objects, where x has the different ones, `of` each object's, and distances(y)(x) gives all distances of rows x and y.

    Equal objects lie at zero.
    """
    first, count = np.unique(of, return_index=True)[1], np.bincount(of)
    state = State(x, count, linkage, alpha, distances)
    node, n = np.arange(len(x)), len(x)
    merges, heights = [], []
    while linkage != "single" and len(node) > most:
        near = [np.full(len(node), -1), np.full(len(node), np.inf), np.full(len(node), np.inf), np.zeros(len(node))]
        for a, mine, b, theirs in fanned(spark, state, State.nearest):
            closer(near, slice(*a), *mine)
            if a != b:
                closer(near, slice(*b), *theirs)
        at, best, second, sums = near
        at = np.where(second <= best * (1 + 1e-9), -1, at)
        a = np.flatnonzero((at >= 0) & (at[at] == np.arange(len(node))) & (np.arange(len(node)) < at))
        a = np.sort(a[np.argsort(best[a], kind="stable")][: len(node) - most])
        if not len(a):
            raise ValueError(f"{len(node)} clusters have ties for their nearest ones, too many for a matrix in one task: make nuggets of the source first")
        b = at[a]
        merges += list(zip(node[a].tolist(), node[b].tolist(), strict=True))
        heights += best[a].tolist()
        node[a] = n + len(merges) - len(a) + np.arange(len(a))
        node = node[state.merge(a, b, best[a], sums[a])]
    if linkage == "single":
        merges, heights = spanning(spark, state)
    else:
        d = np.full((len(node), len(node)), np.inf)
        for a, b, m in fanned(spark, state, whole):
            d[slice(*a), slice(*b)] = m
            d[slice(*b), slice(*a)] = m.T
        d = np.minimum(d, d.T)
        low = first.tolist()  # each node's smallest object
        for p, q in merges:
            low.append(min(low[p], low[q]))
        order = np.argsort([low[k] for k in node.tolist()])
        above = Above(state, np.argsort(order)) if linkage == "flexible" else None
        m, h = K.linkage(d[np.ix_(order, order)], linkage, alpha, state.size[order], copy=False, squared=True, above=above)
        if state.square:
            heights = np.sqrt(np.maximum(heights, 0)).tolist()
        at, base = node[order], n + len(merges)
        merges += [tuple(int(at[-v - 1]) if v < 0 else base + int(v) - 1 for v in pair) for pair in m]
        heights += h.tolist()
    return named(merges, heights, of, first)


class Above:
    """The height that a merge at h counts with for each other cluster, by those of its merges that are higher: what these added before, they add after it. Called in order of heights."""

    def __init__(self, state, place):
        o = np.argsort(state.tall)
        self.tall, self.share, self.at = state.tall[o], state.share[o], place[state.at][o]
        self.sums = [np.bincount(self.at, x, len(place)).astype(float) for x in (self.share, self.share * self.tall)]
        self.alpha, self.done = state.alpha, 0

    def __call__(self, h, i, j):
        end = int(np.searchsorted(self.tall, h, "right"))
        if end > self.done:
            cut = slice(self.done, end)
            self.sums[0] -= np.bincount(self.at[cut], self.share[cut], len(self.sums[0]))
            self.sums[1] -= np.bincount(self.at[cut], (self.share * self.tall)[cut], len(self.sums[1]))
            self.done = end
        if self.done == len(self.tall):
            return h
        got = h + (2 * self.alpha - 1) * (h * self.sums[0] - self.sums[1])
        at, share = self.at[self.done :], self.share[self.done :]
        share[(at == i) | (at == j)] *= self.alpha
        at[at == j] = i
        for x in self.sums:
            x[i], x[j] = self.alpha * (x[i] + x[j]), 0.0
        return got


def whole(state, a, b):
    return a, b, np.concatenate([d for _, _, d, _ in state.between(a, b)])


def spanning(spark, state) -> tuple[list, list]:
    """Single linkage: merges as nodes, with heights, from the edges of a spanning tree; each object is a cluster of its own, and `of` says what it is connected to."""
    n, edges = len(state.x), []
    state.labels = state.of
    while len(edges) < n - 1:
        near = [np.full(n, -1), np.full(n, np.inf), np.full(n, np.inf), np.zeros(n)]
        for a, mine, b, theirs in fanned(spark, state, State.nearest):
            closer(near, slice(*a), *mine)
            if a != b:
                closer(near, slice(*b), *theirs)
        o = np.argsort(near[1], kind="stable")
        o = o[np.unique(state.labels[o], return_index=True)[1]]  # each component's nearest
        root = state.labels.tolist()
        for k in o[np.argsort(near[1][o], kind="stable")].tolist():
            a, b = k, int(near[0][k])
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            if a != b:
                root[max(a, b)] = min(a, b)
                edges.append((k, int(near[0][k]), float(near[1][k])))
        up = np.array(root)
        while (up[up] != up).any():
            up = up[up]
        state.labels = up
    edges.sort(key=lambda e: e[2])
    root, name, merges = list(range(n)), list(range(n)), []

    def find(v):
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for a, b, _ in edges:
        a, b = sorted((find(a), find(b)))
        merges.append((name[a], name[b]))
        root[b], name[a] = a, n + len(merges) - 1
    return merges, [e[2] for e in edges]


def named(merges, heights, of, first) -> tuple[np.ndarray, np.ndarray]:
    """Merges as nodes (a kind of equal objects, or len(first) and a merge) -> merges and heights of all objects, in the order in which linkage makes them: by height, then by the smallest object."""
    n, size = len(first), np.bincount(of)
    out, tall, last, low = [], [], [-1 - k for k in first.tolist()], first.tolist()
    for k, rows in enumerate(np.split(np.argsort(of, kind="stable"), np.cumsum(size)[:-1])):
        for i in rows[1:].tolist():
            out.append((last[k], -1 - i) if last[k] < 0 else (-1 - i, last[k]))
            tall.append(0.0)
            last[k] = len(out)
    last, low = last + [0] * len(merges), low + [0] * len(merges)
    waits, user = [0] * len(merges), {}
    for k, (a, b) in enumerate(merges):
        low[n + k] = min(low[a], low[b])
        waits[k] = (a >= n) + (b >= n)
        user[a], user[b] = k, k
    ready = [(heights[k], low[n + k], k) for k in range(len(merges)) if not waits[k]]
    heapq.heapify(ready)
    while ready:
        h, _, k = heapq.heappop(ready)
        a, b = (last[v] for v in merges[k])
        out.append((a, b) if (a < 0) == (b < 0) and abs(a) < abs(b) or a < 0 < b else (b, a))
        tall.append(h)
        last[n + k] = len(out)
        up = user.get(n + k)
        if up is not None:
            waits[up] -= 1
            if not waits[up]:
                heapq.heappush(ready, (max(heights[up], h), low[n + up], up))
    return np.array(out, int).reshape(-1, 2), np.array(tall)
