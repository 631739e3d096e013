"""Numpy kernels that run inside one grouped task: trees, partitions, and matrix iterations.

All of them work on small dense matrices (objects of one task, or nugget centres); the operators
around them keep everything that grows with the data in DataFrames.
"""

from __future__ import annotations

import math

import numpy as np

#: Lance-Williams families; ward works on squared distances and reports roots (as ward.D2 does).
LINKAGES = ("single", "complete", "average", "mcquitty", "weighted", "ward", "ward.D2", "ward.D", "centroid", "median", "flexible")


def _joined(method: str, alpha: float, di, dj, h: float, si: float, sj: float, size):
    """Lance-Williams: what a merged cluster is from the others, which lie at di and dj from its parts."""
    if method == "single":
        return np.minimum(di, dj)
    if method == "complete":
        return np.maximum(di, dj)
    if method == "average":
        return (si * di + sj * dj) / (si + sj)
    if method in ("mcquitty", "weighted"):
        return 0.5 * (di + dj)
    if method in ("ward", "ward.D2", "ward.D"):
        return ((size + si) * di + (size + sj) * dj - size * h) / (size + si + sj)
    if method == "centroid":
        return (si * di + sj * dj) / (si + sj) - si * sj * h / (si + sj) ** 2
    if method == "median":
        return 0.5 * di + 0.5 * dj - 0.25 * h
    return alpha * (di + dj) + (1 - 2 * alpha) * h  # flexible: equal shares alpha, and 1 - 2 alpha of the merged distance


def alike(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, of): the first of each kind of equal rows, in their order, and each row's kind."""
    x = np.ascontiguousarray(x + 0)  # one zero
    _, first, of = np.unique(x.view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel() if x.size else np.zeros(len(x)), return_index=True, return_inverse=True)
    order = np.argsort(first)
    return first[order], np.argsort(order)[of]


def linkage_alike(d: np.ndarray, of: np.ndarray, method: str = "ward", alpha: float = 0.625) -> tuple[np.ndarray, np.ndarray] | None:
    """linkage of all objects, where d is of the kinds of equal ones (as `alike` gives them) and is overwritten; None where different kinds lie at zero too.

    Equal objects at distance zero merge first, in order of their indices; these merges are made here on
    the kinds' rows, number by number as linkage would, so that n objects take a matrix of their kinds only.
    """
    many = np.bincount(of, minlength=len(d))
    apart = (many > 1) & (np.diagonal(d) != 0)
    if apart.any():  # equal, but not at zero, as what has nothing in common with itself: each for itself
        first, kind = alike(np.where(apart[of], len(d) + np.arange(len(of)), of)[:, None])
        d, of = d[np.ix_(of[first], of[first])], kind
        many = np.bincount(of)
    np.fill_diagonal(d, np.inf)
    if any(not (row > 0).all() for row in d):
        return None
    if method in ("ward", "ward.D2", "centroid", "median"):
        np.multiply(d, d, out=d)
    size, name, merges = np.ones(len(d)), -1 - np.unique(of, return_index=True)[1], []
    rows = np.split(np.argsort(of, kind="stable"), np.cumsum(many)[:-1])
    for k in np.flatnonzero(many > 1):
        one = d[k].copy()
        for i in rows[k][1:].tolist():
            d[k] = _joined(method, alpha, d[k], one, 0.0, size[k], 1.0, size)
            d[k, k] = np.inf
            merges.append((name[k], -1 - i) if name[k] < 0 else (-1 - i, name[k]))
            size[k] += 1
            name[k] = len(merges)
        d[:, k] = d[k]
    m, h = linkage(d, method, alpha, size, copy=False, squared=True)
    first = len(merges)
    m = np.where(m < 0, name[-m - 1], m + first)
    # A pair's order is by its signs and sizes, and names have changed.
    swap = np.where((m[:, 0] < 0) == (m[:, 1] < 0), np.abs(m[:, 0]) > np.abs(m[:, 1]), m[:, 0] > 0)
    m[swap] = m[swap][:, ::-1]
    return np.concatenate([np.array(merges, int).reshape(-1, 2), m]), np.concatenate([np.zeros(first), h])


def ward_rounds(x: np.ndarray, count: np.ndarray, squares, most: int, tile: int = 1024):
    """Ward merges of rows x (that stand for `count` objects each) without their matrix, until `most` clusters are left: (merges as nodes, squared heights, each row's cluster, the clusters' nodes, sizes, squared distances), or None where ties leave too many.

    Node r is row r, node len(x) + k what merge k made.  squares(a, b) gives squared dissimilarities of rows.
    A round merges each two clusters that are strictly nearest to each other; Ward's update never brings
    another cluster nearer to a pair than its parts were, so that these merges come in every order.
    Distances of clusters are sums over their rows, made by tiles of rows, which are in the clusters' order.
    """
    node, of = np.arange(len(x)), np.arange(len(x))
    size, several = count.astype(float), bool((count > 1).any())
    within = np.array([float(squares(x[k : k + 1], x[k : k + 1])[0, 0]) for k in range(len(x))]) * size**2
    merges, heights = [], []

    def between(lo, hi, rows, starts):
        """Squared Ward distances of clusters lo to hi from all."""
        a = slice(starts[lo], starts[hi] if hi < len(starts) else len(x))
        sums = np.empty((hi - lo, len(starts)))
        mine, own = rows[a], starts[lo:hi] - starts[lo]
        for q in range(0, len(starts), tile):
            end = min(q + tile, len(starts))
            b = rows[starts[q] : starts[end] if end < len(starts) else len(x)]
            d = squares(x[mine], x[b])
            if several:
                d *= count[mine][:, None]
                d *= count[b][None]
            d = d if len(own) == len(mine) else np.add.reduceat(d, own, 0)
            sums[:, q:end] = d if len(b) == end - q else np.add.reduceat(d, starts[q:end] - starts[q], 1)
        n = size[lo:hi, None]
        v = sums / (n * size[None]) - (within / size**2 / 2)[lo:hi, None] - (within / size**2 / 2)[None]
        return 2 * n * size[None] / (n + size[None]) * v, sums

    while True:
        rows = np.argsort(of, kind="stable")
        starts = np.searchsorted(of[rows], np.arange(len(node)))
        done = len(node) <= most
        d = np.empty((len(node), len(node))) if done else None
        near, best, met = np.empty(len(node), int), np.empty(len(node)), np.empty(len(node))
        step = 64
        lo = 0
        while lo < len(node):
            hi = int(max(lo + 1, min(lo + step, np.searchsorted(starts, starts[lo] + 2 * step))))
            v, sums = between(lo, hi, rows, starts)
            at = np.arange(hi - lo)
            v[at, lo + at] = np.inf
            if done:
                d[lo:hi] = v
            else:
                near[lo:hi] = v.argmin(1)
                best[lo:hi], met[lo:hi] = v[at, near[lo:hi]], sums[at, near[lo:hi]]
                v[at, near[lo:hi]] = np.inf
                tied = v.min(1) <= best[lo:hi] * (1 + 1e-9)
                near[lo:hi][tied] = -1
            lo = hi
        if done:
            return merges, heights, of, node, size, np.minimum(d, d.T)
        a = np.flatnonzero((near >= 0) & (near[near] == np.arange(len(node))) & (np.arange(len(node)) < near))
        if len(a) * 50 < len(node) - most and len(a) * 200 < len(node):
            return None
        a = a[np.argsort(best[a], kind="stable")][: len(node) - most]
        b = near[a]
        first = len(x) + len(merges)
        merges += list(zip(node[a].tolist(), node[b].tolist(), strict=True))
        heights += best[a].tolist()
        within[a] += within[b] + 2 * met[a]
        size[a] += size[b]
        node[a] = first + np.arange(len(a))
        into = np.arange(len(node))
        into[b] = a
        keep = np.ones(len(node), bool)
        keep[b] = False
        of = (np.cumsum(keep) - 1)[into[of]]
        node, size, within = node[keep], size[keep], within[keep]


def linkage_rounds(x: np.ndarray, of: np.ndarray, squares, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """linkage by ward of all objects, where x has the different ones and `of` (as `alike` gives it) each object's: see ward_rounds."""
    first, count = np.unique(of, return_index=True)[1], np.bincount(of)
    got = ward_rounds(x, count, squares, most)
    if got is None:
        return None
    merges, heights, _, node, size, d = got
    low = first.copy().tolist()  # each node's smallest object
    for a, b in merges:
        low.append(min(low[a], low[b]))
    order = np.argsort([low[k] for k in node.tolist()])
    m, h = linkage(d[np.ix_(order, order)], "ward", weights=size[order], copy=False, squared=True)
    at, base = node[order], len(x) + len(merges)
    merges = merges + [tuple(int(at[-v - 1]) if v < 0 else base + int(v) - 1 for v in pair) for pair in m]
    heights = [math.sqrt(max(v, 0)) for v in heights] + h.tolist()
    for k, pair in enumerate(merges):  # a merge is not below its parts', but for rounding
        heights[k] = max(heights[k], *(heights[v - len(x)] if v >= len(x) else 0.0 for v in pair))
    out, tall, name = [], [], {}
    last = [-1 - k for k in first.tolist()]
    for k, rows in enumerate(np.split(np.argsort(of, kind="stable"), np.cumsum(count)[:-1])):
        for i in rows[1:].tolist():
            out.append((last[k], -1 - i) if last[k] < 0 else (-1 - i, last[k]))
            tall.append(0.0)
            last[k] = len(out)
    for k in np.argsort(heights, kind="stable").tolist():
        a, b = (last[v] if v < len(x) else name[v - len(x)] for v in merges[k])
        out.append((a, b) if (a < 0) == (b < 0) and abs(a) < abs(b) or a < 0 < b else (b, a))
        tall.append(heights[k])
        name[k] = len(out)
    return np.array(out, int).reshape(-1, 2), np.array(tall)


def linkage(d: np.ndarray, method: str = "ward", alpha: float = 0.625, weights: np.ndarray | None = None, copy: bool = True, squared: bool = False, above=None) -> tuple[np.ndarray, np.ndarray]:
    """Agglomeration of a dissimilarity matrix: merges (left, right) and heights. Without copy the matrix is overwritten.

    A negative entry -(i+1) is object i, a positive one the step that made the cluster.  Ties go to
    the smallest pair of indices; of a merged pair the smaller index stays.  squared: methods that work
    on squares get them.  above(h, i, j), for flexible, gives the height that a merge counts with for each other cluster.
    """
    if method not in LINKAGES:
        raise ValueError(f"unknown linkage {method!r}; one of {', '.join(LINKAGES)}")
    d = np.array(d, float, copy=copy or None)
    n = len(d)
    square = method in ("ward", "ward.D2", "centroid", "median")
    if square and not squared:
        np.multiply(d, d, out=d)
    np.fill_diagonal(d, np.inf)
    size = np.ones(n) if weights is None else np.asarray(weights, float).copy()
    name = -np.arange(1, n + 1)
    alive = np.ones(n, bool)
    near = d.argmin(1) if n > 1 else np.zeros(n, int)
    best = d[np.arange(n), near] if n else np.zeros(0)
    merges, heights = np.zeros((max(n - 1, 0), 2), int), np.zeros(max(n - 1, 0))
    for step in range(n - 1):
        i = int(np.argmin(np.where(alive, best, np.inf)))
        j = int(near[i])
        i, j = min(i, j), max(i, j)
        h = d[i, j]
        a, b = name[i], name[j]
        merges[step] = (a, b) if (a < 0) == (b < 0) and abs(a) < abs(b) or a < 0 < b else (b, a)
        heights[step] = np.sqrt(max(h, 0)) if square else h
        si, sj = size[i], size[j]
        di, dj = d[i], d[j]
        new = _joined(method, alpha, di, dj, h if above is None else above(h, i, j), si, sj, size)
        alive[j] = False
        new = np.where(alive, new, np.inf)
        new[i] = np.inf
        d[i], d[:, i] = new, new
        d[j], d[:, j] = np.inf, np.inf
        size[i] = si + sj
        name[i] = step + 1
        best[j] = np.inf
        lost = alive & ((near == i) | (near == j))
        nearer = lost & (new <= best)  # the merged cluster is nearest still: nothing before it was as near
        near[nearer], best[nearer] = i, new[nearer]
        for r in {*np.flatnonzero(lost & ~nearer).tolist(), i}:
            near[r] = int(np.argmin(d[r]))
            best[r] = d[r, near[r]]
        closer = alive & (new < best) | (alive & (new == best) & (i < near))
        closer[i] = False
        near[closer], best[closer] = i, new[closer]
    return merges, heights


def members(merges: np.ndarray) -> list[list[int]]:
    """Objects of the cluster that each step makes."""
    out: list[list[int]] = []
    for pair in merges:
        got: list[int] = []
        for x in pair:
            got += [-x - 1] if x < 0 else out[x - 1]
        out.append(got)
    return out


def leaf_order(merges: np.ndarray, n: int) -> list[int]:
    return members(merges)[-1] if len(merges) else list(range(n))


def by_appearance(labels) -> np.ndarray:
    """Labels numbered 1, 2, ... by first appearance."""
    seen: dict = {}
    return np.array([seen.setdefault(x, len(seen) + 1) for x in (labels.tolist() if hasattr(labels, "tolist") else labels)], int)


def cut(merges: np.ndarray, n: int, k: int) -> np.ndarray:
    """Partition in k classes after n - k merges, numbered by first appearance."""
    k = max(1, min(k, n))
    top = np.arange(n + n - k)  # an object, or n - 1 and a step: the last cluster that holds it
    for step in range(n - k - 1, -1, -1):
        for x in merges[step]:
            top[-x - 1 if x < 0 else n - 1 + x] = top[n + step]
    return by_appearance(top[:n])


def cophenetic(merges: np.ndarray, heights: np.ndarray, n: int) -> np.ndarray:
    """Height of the lowest merge that holds both objects."""
    out, groups = np.zeros((n, n)), members(merges)
    for (a, b), h in zip(merges, heights, strict=True):
        x = [-a - 1] if a < 0 else groups[a - 1]
        y = [-b - 1] if b < 0 else groups[b - 1]
        out[np.ix_(x, y)] = h
        out[np.ix_(y, x)] = h
    return out


def minimax_closure(d: np.ndarray) -> np.ndarray:
    """Largest ultrametric below d: the single-linkage cophenetic matrix."""
    return cophenetic(*linkage(d, "single"), len(d)) if len(d) > 1 else np.zeros_like(d)


def spanning_tree(cost: np.ndarray) -> list[tuple[int, int, float]]:
    """Minimum spanning tree (Prim), ties to the smallest index."""
    n = len(cost)
    if n < 2:
        return []
    done = np.zeros(n, bool)
    best, src = np.full(n, np.inf), np.zeros(n, int)
    out, at = [], 0
    done[0] = True
    for _ in range(n - 1):
        closer = ~done & (cost[at] < best)
        best[closer], src[closer] = cost[at][closer], at
        at = int(np.argmin(np.where(done, np.inf, best)))
        done[at] = True
        out.append((int(min(src[at], at)), int(max(src[at], at)), float(best[at])))
    return out


def connected(n: int, edges) -> np.ndarray:
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return by_appearance([find(i) for i in range(n)])


def silhouette(d: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Silhouette widths; 0 for singletons."""
    ks = np.unique(labels)
    if len(ks) < 2:
        return np.zeros(len(labels))
    ind = (labels[:, None] == ks[None]).astype(float)
    sums, count = d @ ind, ind.sum(0)
    own = ind.astype(bool)
    a = np.where(count[None] > 1, sums / np.maximum(count[None] - 1, 1), 0)[own]
    b = np.where(own, np.inf, sums / count[None]).min(1)
    wide = np.where(np.maximum(a, b) > 0, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)
    return np.where((ind @ count) > 1, wide, 0.0)


def pam(d: np.ndarray, k: int, most: int = 100) -> np.ndarray:
    """k-medoids by greedy build and best swaps; labels by first appearance."""
    n = len(d)
    k = max(1, min(k, n))
    med = [int(np.argmin(d.sum(1)))]
    while len(med) < k:
        near = d[:, med].min(1)
        gain = np.maximum(near[:, None] - d, 0).sum(0)
        gain[med] = -1
        med.append(int(np.argmax(gain)))
    for _ in range(most):
        base, best = d[:, med].min(1).sum(), None
        for pos in range(k):
            others = [m for i, m in enumerate(med) if i != pos]
            rest = d[:, others].min(1) if others else np.full(n, np.inf)
            cost = np.minimum(rest[:, None], d).sum(0)
            cost[med] = np.inf
            j = int(np.argmin(cost))
            if cost[j] < base - 1e-12 and (best is None or cost[j] < best[0]):
                best = (cost[j], pos, j)
        if best is None:
            break
        med[best[1]] = best[2]
    return by_appearance(np.argmin(d[:, med], 1))


def kmeans(x: np.ndarray, k: int, weights: np.ndarray | None = None, starts: int = 10, most: int = 100, seed: int = 1) -> tuple[np.ndarray, np.ndarray, float]:
    """Weighted Lloyd iterations from weight-proportional seeds; best of `starts`. Labels, centres, cost."""
    n = len(x)
    k = max(1, min(k, len(np.unique(x, axis=0)) if n else 1))
    w = np.ones(n) if weights is None else np.asarray(weights, float)
    rng, best = np.random.default_rng(seed), None
    for _ in range(starts):
        c = [x[rng.choice(n, p=w / w.sum())]]
        while len(c) < k:
            far = np.min([((x - m) ** 2).sum(1) for m in c], 0) * w
            c.append(x[rng.choice(n, p=far / far.sum())] if far.sum() > 0 else x[rng.integers(n)])
        c, y = np.array(c), None
        for _ in range(most):
            dist = (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None]
            new = dist.argmin(1)
            if y is not None and (new == y).all():
                break
            y = new
            for j in range(k):
                m = y == j
                if w[m].sum() > 0:
                    c[j] = (w[m, None] * x[m]).sum(0) / w[m].sum()
        cost = float((w * ((x - c[y]) ** 2).sum(1)).sum())
        if best is None or cost < best[2] - 1e-12:
            best = (y, c, cost)
    return best


def weighted_ward(x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ward merges of weighted points: cost wa*wb/(wa+wb) * squared distance; heights are running means of costs."""
    n = len(x)
    c, w = np.array(x, float), np.array(w, float)
    alive, name = np.ones(n, bool), -np.arange(1, n + 1)
    merges, costs = np.zeros((max(n - 1, 0), 2), int), []
    for step in range(n - 1):
        i = np.flatnonzero(alive)
        q = (c[i] ** 2).sum(1)
        cost = np.maximum(q[:, None] + q[None] - 2 * c[i] @ c[i].T, 0) * (w[i][:, None] * w[i][None] / (w[i][:, None] + w[i][None]))
        cost[np.tril_indices(len(i))] = np.inf
        a, b = np.unravel_index(int(np.argmin(cost)), cost.shape)
        costs.append(cost[a, b])
        a, b = i[a], i[b]
        merges[step] = name[a], name[b]
        c[a] = (w[a] * c[a] + w[b] * c[b]) / (w[a] + w[b])
        w[a] += w[b]
        alive[b] = False
        name[a] = step + 1
    costs = np.sort(costs)
    return merges, np.cumsum(costs) / np.arange(1, n) if n > 1 else np.zeros(0)


def spectral(aff: np.ndarray, k: int | None = None, max_k: int = 10, starts: int = 10, seed: int = 1) -> np.ndarray:
    """Normalised-Laplacian clustering; k by the largest eigengap after the first when not given."""
    s = (aff + aff.T) / 2
    np.fill_diagonal(s, 0)
    deg = s.sum(1)
    inv = np.where(deg > 0, 1 / np.sqrt(np.maximum(deg, 1e-300)), 0)
    lap = np.eye(len(s)) - inv[:, None] * s * inv[None]
    val, vec = np.linalg.eigh(lap)
    if k is None:
        gaps = np.diff(val[: min(max_k + 1, len(val))])
        k = int(np.argmax(gaps[1:]) + 2) if len(gaps) > 1 else 1
    u = vec[:, :k]
    u = u / np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-12)
    return by_appearance(kmeans(u, k, starts=starts, most=50, seed=seed)[0])


def affinity(d: np.ndarray, nn: int = 20, mu: float = 0.5) -> np.ndarray:
    """Scaled exponential kernel with local scales (mean distance to the nn nearest)."""
    d = (d + d.T) / 2
    np.fill_diagonal(d, 0)
    nn = min(nn, len(d) - 1)
    near = np.sort(d, 1)[:, 1 : nn + 1].mean(1) + 2.220446e-16
    sig = (near[:, None] + near[None] + d) / 3
    sig = np.maximum(sig, 2.220446e-16)
    w = np.exp(-((d / (mu * sig)) ** 2) / 2) / (mu * sig * np.sqrt(2 * np.pi))
    return (w + w.T) / 2


def fuse(sources: list[np.ndarray], nn: int = 20, rounds: int = 20) -> np.ndarray:
    """Similarity network fusion: cross-diffusion of the sources' full and nearest-neighbour kernels."""

    def full(w):
        rest = w.sum(1) - np.diag(w)
        out = w / (2 * np.where(rest == 0, 1, rest))[:, None]
        np.fill_diagonal(out, 0.5)
        return out

    def local(w):
        out = np.zeros_like(w)
        top = np.argsort(-w, 1, kind="stable")[:, : min(nn, len(w))]
        np.put_along_axis(out, top, np.take_along_axis(w, top, 1), 1)
        return out / np.maximum(out.sum(1, keepdims=True), 1e-300)

    p = [full(w) for w in sources]
    p = [(x + x.T) / 2 for x in p]
    s = [local(w) for w in sources]
    for _ in range(rounds if len(sources) > 1 else 0):
        total = sum(p)
        p = [full(a @ ((total - b) / (len(p) - 1)) @ a.T) for a, b in zip(s, p, strict=True)]
        p = [(x + x.T) / 2 for x in p]
    w = sum(p) / len(p)
    w = w / np.maximum(w.sum(1, keepdims=True), 1e-300)
    return (w + w.T + np.eye(len(w))) / 2


def joint_nmf(sources: list[np.ndarray], k: int, starts: int = 10, rounds: int = 200, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Shared-basis factorisation by multiplicative updates. Best labels, and co-occurrence over starts."""
    xs = [np.nan_to_num(np.asarray(x, float)) for x in sources]
    xs = [x - min(x.min(), 0) for x in xs]
    ms = [max(float(x.mean()), 1e-12) for x in xs]
    a = [max(ms) / m for m in ms]
    n, rng = len(xs[0]), np.random.default_rng(seed)
    co, best = np.zeros((n, n)), None
    for _ in range(starts):
        w, hs = rng.random((n, k)) + 1e-3, [rng.random((k, x.shape[1])) + 1e-3 for x in xs]
        for _ in range(rounds):
            hs = [h * (w.T @ x) / np.maximum(w.T @ w @ h, 1e-12) for x, h in zip(xs, hs, strict=True)]
            num = sum(s * x @ h.T for s, x, h in zip(a, xs, hs, strict=True))
            den = w @ sum(s * h @ h.T for s, h in zip(a, hs, strict=True))
            w = w * num / np.maximum(den, 1e-12)
        y = w.argmax(1)
        co += y[:, None] == y[None]
        loss = sum(s * ((x - w @ h) ** 2).sum() for s, x, h in zip(a, xs, hs, strict=True))
        if best is None or loss < best[0]:
            best = (loss, by_appearance(y))
    return best[1], co / starts


def autoencoder(x: np.ndarray, latent: int, hidden: int = 32, epochs: int = 80, rate: float = 1e-3, seed: int = 1):
    """m-h-latent-h-m autoencoder (ReLU inside, sigmoid out) by full-batch Adam; returns the encoder."""
    rng, m = np.random.default_rng(seed), x.shape[1]
    shape = [(m, hidden), (hidden, latent), (latent, hidden), (hidden, m)]
    par = [p for a, b in shape for p in (rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b))]
    mom, var = [np.zeros_like(p) for p in par], [np.zeros_like(p) for p in par]
    for step in range(1, epochs + 1):
        w1, b1, w2, b2, w3, b3, w4, b4 = par
        h1 = np.maximum(x @ w1 + b1, 0)
        z = h1 @ w2 + b2
        h2 = np.maximum(z @ w3 + b3, 0)
        y = 1 / (1 + np.exp(-(h2 @ w4 + b4)))
        g4 = 2 * (y - x) * y * (1 - y) / x.size
        g3 = (g4 @ w4.T) * (h2 > 0)
        g2 = g3 @ w3.T
        g1 = (g2 @ w2.T) * (h1 > 0)
        grads = [x.T @ g1, g1.sum(0), h1.T @ g2, g2.sum(0), z.T @ g3, g3.sum(0), h2.T @ g4, g4.sum(0)]
        for i, g in enumerate(grads):
            mom[i] = 0.9 * mom[i] + 0.1 * g
            var[i] = 0.999 * var[i] + 0.001 * g * g
            par[i] = par[i] - rate * (mom[i] / (1 - 0.9**step)) / (np.sqrt(var[i] / (1 - 0.999**step)) + 1e-8)
    w1, b1, w2, b2 = par[:4]
    return lambda v: np.maximum(v @ w1 + b1, 0) @ w2 + b2


def top_eigen(c: np.ndarray, dims: int, whole: int = 2500) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric matrix, falling, with their vectors: block Lanczos beyond `whole` rows, until nothing is left over."""
    if len(c) <= whole:
        val, vec = np.linalg.eigh(c)
        o = np.argsort(-val)[:dims]
        return val[o], vec[:, o]
    q = np.linalg.qr(np.random.default_rng(1).standard_normal((len(c), dims + 2)))[0]
    v, cv = np.empty((len(c), 0)), np.empty((len(c), 0))
    while True:
        v, cv = np.hstack([v, q]), np.hstack([cv, c @ q])
        t = v.T @ cv
        val, s = np.linalg.eigh((t + t.T) / 2)
        s = s[:, ::-1][:, :dims]
        val, vec = val[::-1][:dims], v @ s
        if np.abs(cv @ s - vec * val).max() <= 1e-11 * max(abs(val).max(), 1e-300) * np.sqrt(len(c)) or v.shape[1] + q.shape[1] > len(c):
            return val, vec
        q = cv[:, -q.shape[1] :]
        for _ in range(2):
            q = np.linalg.qr(q - v @ (v.T @ q))[0]


def classical_mds(d: np.ndarray, dims: int = 2, weights: np.ndarray | None = None) -> np.ndarray:
    """Coordinates of rows that stand for as many objects as their weights say."""
    w = np.ones(len(d)) if weights is None else np.asarray(weights, float)
    b = d * d
    mean = b @ w / w.sum()
    b -= mean[:, None]
    b -= mean[None]
    b += mean @ w / w.sum()
    b *= -0.5 * np.sqrt(w)[:, None]
    b *= np.sqrt(w)[None]
    val, vec = top_eigen(b, dims)
    return vec * np.sqrt(np.maximum(val, 0)) / np.sqrt(w)[:, None]
