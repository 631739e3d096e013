"""Numpy kernels against brute force and identities."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.functions import stats as S
from brindle.operators import kernels as K
from brindle.operators.distance import kernel


def points(n=24, groups=3, seed=0, spread=8.0):
    rng = np.random.default_rng(seed)
    y = np.arange(n) % groups
    return rng.normal(size=(n, 4)) + spread * np.eye(4)[y], y + 1


def l2(x):
    return kernel(x, x, "l2")


def same(a, b):
    return len({*zip(a, b, strict=True)}) == len(set(a)) == len(set(b))


@pytest.mark.parametrize("how", ["single", "complete", "average", "ward", "mcquitty", "flexible", "ward.D"])
def test_trees_find_planted_groups(how):
    x, y = points()
    m, h = K.linkage(l2(x), how)
    assert same(K.cut(m, len(x), 3), y)
    if how not in ("flexible",):
        assert (np.diff(h) >= -1e-9).all()


@pytest.mark.parametrize("how", ["single", "complete", "average"])
def test_linkage_against_brute_force(how):
    rng = np.random.default_rng(3)
    d = l2(rng.normal(size=(12, 3)))
    pick = {"single": np.min, "complete": np.max, "average": np.mean}[how]
    groups, heights = [[i] for i in range(12)], []
    while len(groups) > 1:
        best = min(((pick(d[np.ix_(a, b)]), i, j) for (i, a), (j, b) in itertools.combinations(enumerate(groups), 2)))
        heights.append(best[0])
        _, i, j = best
        groups[i] = groups[i] + groups.pop(j)
    assert np.allclose(K.linkage(d, how)[1], heights)


def test_ward_heights_are_those_of_merge_costs():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(10, 3))
    _, h = K.linkage(l2(x), "ward")
    m2, _ = K.weighted_ward(x, np.ones(10))
    assert same(K.cut(K.linkage(l2(x), "ward")[0], 10, 4), K.cut(m2, 10, 4))
    assert math.isclose((h**2).sum() / 2, ((x - x.mean(0)) ** 2).sum(), rel_tol=1e-9)


def test_cut_numbers_by_first_appearance_and_bounds():
    x, _ = points()
    m, _ = K.linkage(l2(x), "ward")
    y = K.cut(m, len(x), 3)
    assert y[0] == 1 and list(dict.fromkeys(y)) == [1, 2, 3]
    assert len(set(K.cut(m, len(x), 99))) == len(x) and set(K.cut(m, len(x), 1)) == {1}


def test_minimax_closure_is_the_floyd_warshall_one():
    rng = np.random.default_rng(5)
    d = l2(rng.normal(size=(14, 2)))
    np.fill_diagonal(d, 0)
    want = d.copy()
    for k in range(14):
        want = np.minimum(want, np.maximum(want[:, [k]], want[[k]]))
    got = K.minimax_closure(d)
    assert np.allclose(got, want)
    assert (got <= np.maximum(got[:, :, None], got.T[None]).min(1) + 1e-9).all()


def test_silhouette_brute_force():
    x, y = points(15)
    d, w = l2(x), []
    for i in range(15):
        own = [d[i, j] for j in range(15) if j != i and y[j] == y[i]]
        a = np.mean(own)
        b = min(np.mean(d[i][y == k]) for k in set(y) - {y[i]})
        w.append((b - a) / max(a, b))
    assert np.allclose(K.silhouette(d, y), w)
    assert K.silhouette(d, np.arange(15)).max() == 0


def test_partitions_recover_blobs():
    x, y = points(48)
    d = l2(x)
    assert same(K.pam(d, 3), y)
    assert same(K.kmeans(x, 3, np.arange(1, 49))[0], y)
    w = K.affinity(d, 10)
    assert same(K.spectral(w, 3), y)
    assert same(K.spectral(K.fuse([w, w], 10, 10), 3), y)
    assert same(K.joint_nmf([x - x.min(), x - x.min()], 3, 6, 150)[0], y)


def test_spanning_tree_weight():
    rng = np.random.default_rng(6)
    d = l2(rng.normal(size=(7, 2)))
    best = min(sum(d[a, b] for a, b in t) for t in itertools.combinations(itertools.combinations(range(7), 2), 6) if len(set(K.connected(7, t))) == 1)
    assert math.isclose(sum(e[2] for e in K.spanning_tree(d)), best)


def test_mds_keeps_distances():
    x = np.random.default_rng(7).normal(size=(9, 2))
    assert np.allclose(l2(K.classical_mds(l2(x))), l2(x))


@given(st.integers(0, 12), st.integers(0, 12), st.integers(0, 12), st.integers(0, 12))
@settings(max_examples=60, deadline=None)
def test_fisher_brute_force(a, b, c, d):
    if a + b + c + d == 0:
        return
    r, k, n = a + b, a + c, a + b + c + d
    p = {x: math.comb(r, x) * math.comb(n - r, k - x) / math.comb(n, k) for x in range(max(0, k - (n - r)), min(r, k) + 1)}
    assert math.isclose(S.fisher_two_sided(a, b, c, d), min(1, sum(v for v in p.values() if v <= p[a] * (1 + 1e-7))), rel_tol=1e-9)


def test_t_quantiles():
    # Published two-sided 5 % points of Student's t.
    for df, t in ((1, 12.7062), (5, 2.5706), (10, 2.2281), (30, 2.0423), (120, 1.9799)):
        assert abs(S.t_two_sided(t, df) - 0.05) < 1e-4


def test_rank_weights_carry_their_mass():
    for g in (50, 200, 5000):
        c = S.bisect_weight_c(g)
        w = 1 / (np.arange(1, g + 1) + c)
        n = max(1, round(0.01 * g))
        assert c <= 1e-5 or abs(w[:n].sum() / w.sum() - 0.2) < 1e-6
    assert S.bisect_weight_c(1) == 1e-6
