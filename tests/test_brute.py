"""Methods that SQL does not express, against second implementations in plain Python; scale helpers and options."""

import collections
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import bagging as B
from brindle.operators import coassociation as CO
from brindle.operators import evaluate as EV
from brindle.operators import integrate as IN
from brindle.operators import kernels as K
from brindle.operators import trees as TR
from brindle.operators.distance import distance, kernel
from brindle.sources import tables as ST

PAIRS = "src int, i string, j string, d double"


def points(n, seed, dims=3):
    x = np.random.default_rng(seed).random((n, dims))
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) / math.sqrt(dims)


def pairs_of(spark, *mats):
    rows = [(s + 1, f"o{i:02d}", f"o{j:02d}", float(m[i, j])) for s, m in enumerate(mats) for i in range(len(m)) for j in range(i + 1, len(m))]
    return spark.createDataFrame(rows, PAIRS)


def groups(labels):
    """A partition without its numbers."""
    out = collections.defaultdict(set)
    for o, c in labels:
        out[c].add(o)
    return {frozenset(v) for v in out.values()}


def plain_fusion(mats, nn, rounds, mu=0.5):
    n, eps = len(mats[0]), 2.220446e-16

    def kernel(d):
        near = [sum(sorted(d[i][j] for j in range(n) if j != i)[:nn]) / nn + eps for i in range(n)]
        w = [[0.0] * n for _ in range(n)]
        for i in range(n):
            for j in range(n):
                s = mu * max((near[i] + near[j] + d[i][j]) / 3, eps)
                w[i][j] = math.exp(-((d[i][j] / s) ** 2) / 2) / (s * math.sqrt(2 * math.pi))
        return [[(w[i][j] + w[j][i]) / 2 for j in range(n)] for i in range(n)]

    def full(w):
        out = [[0.5] * n for _ in range(n)]
        for i in range(n):
            rest = sum(w[i]) - w[i][i]
            for j in range(n):
                if j != i:
                    out[i][j] = w[i][j] / (2 * (rest or 1))
        return [[out[i][j] for j in range(n)] for i in range(n)]

    def even(w):
        return [[(w[i][j] + w[j][i]) / 2 for j in range(n)] for i in range(n)]

    def local(w):
        out = [[0.0] * n for _ in range(n)]
        for i in range(n):
            top = sorted(range(n), key=lambda j: (-w[i][j], j))[:nn]
            s = sum(w[i][j] for j in top)
            for j in top:
                out[i][j] = w[i][j] / s
        return out

    ks = [kernel(d) for d in mats]
    p, s = [even(full(k)) for k in ks], [local(k) for k in ks]
    for _ in range(rounds):
        new = []
        for a in range(len(p)):
            others = [[sum(p[b][i][j] for b in range(len(p)) if b != a) / (len(p) - 1) for j in range(n)] for i in range(n)]
            left = [[sum(s[a][i][k] * others[k][j] for k in range(n)) for j in range(n)] for i in range(n)]
            new.append(even(full([[sum(left[i][k] * s[a][j][k] for k in range(n)) for j in range(n)] for i in range(n)])))
        p = new
    w = [[sum(x[i][j] for x in p) / len(p) for j in range(n)] for i in range(n)]
    w = [[v / sum(row) for v in row] for row in w]
    return [[(w[i][j] + w[j][i] + (i == j)) / 2 for j in range(n)] for i in range(n)]


def test_fusion(spark):
    mats = [points(12, s) for s in (1, 2)]
    want = plain_fusion([m.tolist() for m in mats], 5, 4)
    got = K.fuse([K.affinity(m, 5) for m in mats], 5, 4)
    assert np.allclose(got, want, rtol=1e-9)
    fused = {(r.i, r.j): r.d for r in IN.snf(pairs_of(spark, *mats), "dist", nn=5, rounds=4)[0].collect()}
    assert len(fused) == 66 and all(math.isclose(v, 1 - want[int(i[1:])][int(j[1:])], rel_tol=1e-9) for (i, j), v in fused.items())


@pytest.mark.parametrize("seed", range(4))
def test_medoids_and_silhouettes(spark, seed):
    d = points(14, seed)
    for r_k in (2, 3, 4):
        y = K.pam(d, r_k)
        cost = lambda meds: sum(min(d[i][m] for m in meds) for i in range(14))
        own = [min((i for i in range(14) if y[i] == c), key=lambda m: sum(d[i][m] for i in range(14) if y[i] == c)) for c in set(y)]
        assert all(cost([*own[:p], o, *own[p + 1 :]]) >= cost(own) - 1e-9 for p in range(r_k) for o in range(14))  # no swap gains
        best = min(cost(m) for m in itertools.combinations(range(14), r_k))
        assert cost(own) <= 1.15 * best
    got = EV.select_number(pairs_of(spark, d), (2, 3, 4)).where("src = 1").collect()
    widths = {}
    for k in (2, 3, 4):
        y = K.pam(d, k)
        s = []
        for i in range(14):
            mean = {c: np.mean([d[i][j] for j in range(14) if y[j] == c and j != i]) if any(y[j] == c and j != i for j in range(14)) else None for c in set(y)}
            a, b = mean[y[i]], min(v for c, v in mean.items() if c != y[i])
            s.append(0.0 if a is None else (b - a) / max(a, b))
        widths[k] = float(np.mean(s))
    assert all(math.isclose(r.width, widths[r.k], abs_tol=1e-9) for r in got) and [r.k for r in got if r.best] == [max(widths, key=lambda k: (widths[k], -k))]


def cost_of(x, y):
    return sum(x[i][j] if y[i] == y[j] else 1 - x[i][j] for i in range(len(x)) for j in range(i + 1, len(x)))


@pytest.mark.parametrize("method", ["LocalSearch", "Furthest", "Balls", "Aggl"])
def test_aggregation_is_a_local_optimum(spark, method):
    rng = np.random.default_rng(6)
    truth = rng.integers(0, 3, 15)
    parts = np.stack([np.where(rng.random(15) < 0.15, rng.integers(0, 4, 15), truth) for _ in range(5)])
    df = spark.createDataFrame([(s + 1, f"o{i:02d}", int(c) + 1) for s, p in enumerate(parts) for i, c in enumerate(p)], TR.LABELS)
    x = [[1 - float((parts[:, i] == parts[:, j]).mean()) for j in range(15)] for i in range(15)]
    got = {r.obj: r.cluster for r in IN.clustering_aggregation(df, method).collect()}
    y = [got[f"o{i:02d}"] for i in range(15)]
    for i in range(15):
        for c in {*y, 99}:
            assert cost_of(x, [*y[:i], c, *y[i + 1 :]]) >= cost_of(x, y) - 1e-9
    single = [cost_of(x, p.tolist()) for p in parts]
    assert cost_of(x, y) <= min(single) + 1e-9


def test_furthest_by_definition():
    rng = np.random.default_rng(8)
    for _ in range(5):
        a = rng.random((9, 9))
        x = (a + a.T) / 2
        np.fill_diagonal(x, 0)
        i, j = divmod(int(np.argmax(x)), 9)
        centres, best = [i, j], [0] * 9
        while True:
            y = [centres.index(v) if v in centres else min(range(len(centres)), key=lambda c: (x[v][centres[c]], c)) for v in range(9)]
            if cost_of(x, y) >= cost_of(x, best):
                break
            best = y
            rest = [v for v in range(9) if v not in centres]
            if not rest:
                break
            centres.append(max(rest, key=lambda v: (np.mean([x[v][c] for c in centres]), -v)))
        assert groups(enumerate(IN._furthest(x))) == groups(enumerate(best))


def test_graph_methods_find_blocks(spark):
    truth = [i % 3 for i in range(18)]
    aff = spark.createDataFrame([(f"o{i:02d}", f"o{j:02d}", 1.0 if truth[i] == truth[j] else 0.001) for i in range(18) for j in range(i + 1, 18)], "i string, j string, s double")
    want = groups(enumerate(truth))
    for k in (3, None):
        got = IN.spectral_clustering(aff, k).collect()
        assert groups((int(r.obj[1:]), r.cluster) for r in got) == want
    parts = spark.createDataFrame([(s, f"o{i:02d}", (truth[i] + s) % 3 + 1) for s in (1, 2, 3) for i in range(18)], TR.LABELS)
    for how in ("CSPA", "HGPA", "MCLA", "Best"):
        assert groups((int(r.obj[1:]), r.cluster) for r in IN.ensemble_clustering(parts, 3, how).collect()) == want
    assert groups((int(r.obj[1:]), r.cluster) for r in IN.hbgf(parts, 3).collect()) == want


def test_weighted_ward_by_definition():
    rng = np.random.default_rng(2)
    x, w = rng.random((10, 2)), rng.integers(1, 5, 10).astype(float)
    merges, heights = K.weighted_ward(x, w)
    live = {-i - 1: (x[i], w[i]) for i in range(10)}
    costs = []
    for step, (a, b) in enumerate(merges):
        cost = {(p, q): live[p][1] * live[q][1] / (live[p][1] + live[q][1]) * ((live[p][0] - live[q][0]) ** 2).sum() for p, q in itertools.combinations(live, 2)}
        least = min(cost.values())
        got = cost.get((a, b), cost.get((b, a)))
        assert math.isclose(got, least, rel_tol=1e-9)
        costs.append(got)
        (ca, wa), (cb, wb) = live.pop(a), live.pop(b)
        live[step + 1] = ((wa * ca + wb * cb) / (wa + wb), wa + wb)
    assert np.allclose(heights, np.cumsum(np.sort(costs)) / np.arange(1, 10))


def test_factorisation_and_encoder():
    rng = np.random.default_rng(4)
    truth = np.repeat([0, 1, 2], 8)
    mats = [np.eye(3)[truth] @ rng.random((3, 12)) * 5 + rng.random((24, 12)) * 0.1 for _ in range(2)]
    _, co = K.joint_nmf(mats, 3, starts=5, rounds=150, seed=1)
    same = truth[:, None] == truth[None]
    assert co[same].mean() > 0.9 and co[~same].mean() < 0.2
    x = rng.random((40, 10))
    z = K.autoencoder(x, 2, 16, 200, 5e-3, 1)(x)
    assert z.shape == (40, 2) and z.std(0).min() > 1e-3


def test_pair_counts_over_blocks(spark, monkeypatch):
    from brindle.operators import distance as D

    rng = np.random.default_rng(2)
    m = rng.integers(0, 4, (2, 7, 11))  # sources, runs, objects; 0: not drawn
    rows = [(s + 1, r, f"o{j:02d}", int(m[s, r, j])) for s in range(2) for r in range(7) for j in range(11) if m[s, r, j]]
    df = spark.createDataFrame(rows, "src int, run int, obj string, cluster int")
    whole = D.meet_blocks
    monkeypatch.setattr(D, "meet_blocks", lambda o, k, v, block=3: whole(o, k, v, 3))
    got = {(r.src, r.i, r.j): (r.together, r.apart) for r in CO.pair_counts(df).collect()}
    assert len(got) == 2 * 55
    for s in range(2):
        for a in range(11):
            for b in range(a + 1, 11):
                both = (m[s, :, a] > 0) & (m[s, :, b] > 0)
                same = int((both & (m[s, :, a] == m[s, :, b])).sum())
                assert got[s + 1, f"o{a:02d}", f"o{b:02d}"] == (same, int(both.sum()) - same)


def test_components_are_distributed(spark):
    rng = np.random.default_rng(3)
    edges = [(f"o{a:03d}", f"o{b:03d}") for a, b in rng.integers(0, 120, (90, 2))] + [(f"o{i:03d}", f"o{i + 1:03d}") for i in range(20)] + [("o005", "o005")]
    objs = [f"o{i:03d}" for i in range(125)]
    got = TR.components(spark.createDataFrame(edges, "i string, j string"), spark.createDataFrame([(o,) for o in objs], "obj string")).collect()
    want = K.connected(125, [(int(a[1:]), int(b[1:])) for a, b in edges])
    assert {r.obj: r.cluster for r in got} == {o: int(c) for o, c in zip(objs, want, strict=True)}
    none = TR.components(spark.createDataFrame([], "i string, j string"), spark.createDataFrame([("x",), ("y",)], "obj string"))
    assert sorted((r.obj, r.cluster) for r in none.collect()) == [("x", 1), ("y", 2)]


def test_large_matrices_are_refused(spark, monkeypatch):
    monkeypatch.setattr(TR, "DENSE_MOST", 10)
    with pytest.raises(ValueError, match="nuggets"):
        TR.check_dense(11)


@pytest.fixture(scope="module")
def mixed(spark):
    """A numeric and a binary source of the same objects."""
    cells, truth = ST.simulate(spark, n=24, features=(20, 30), informative=(9, 12), effect=4.0, seed=3)
    cells = cells.withColumn("val", F.when(F.col("src") == 2, (F.col("val") > 0.5).cast("double")).otherwise(F.col("val")))
    return cells.persist(), truth.select("obj", F.col("g").alias("cluster")).persist()


def test_options_by_source(spark, mixed):
    """A dict of options gives each source what it gets alone."""
    cells, _ = mixed
    key = lambda df: sorted((r.src, r.iter, r.obj, r.cluster) for r in df.collect())
    ways = {1: dict(measure="euclidean", weighting="var", iters=4, classes=3, nfeat=6, linkage="ward.D2", bag=True), 2: dict(measure="tanimoto", weighting="equal", iters=3, classes=4, nfeat=0.5, linkage="average", bag=False)}
    both = B.abc_labels(cells, **{k: {s: w[k] for s, w in ways.items()} for k in ways[1]})
    assert key(both) == key(B.abc_labels(cells.where("src = 1"), **ways[1])) + key(B.abc_labels(cells.where("src = 2"), **ways[2]))
    d = B.abc_distance(cells, measure={1: "euclidean", 2: "tanimoto"}, iters={1: 5, 2: 2})
    alone = B.abc_distance(cells.where("src = 2"), measure="tanimoto", iters=2)
    assert sorted(map(tuple, d.where("src = 2").collect())) == sorted(map(tuple, alone.collect()))
    cuts = IN.sampled_cuts(cells, {1: [2, 3], 2: [4]}, 2, {1: 5, 2: 9}, {1: "gower", 2: "tanimoto"})
    assert {(r.src, r.k) for r in cuts.select("src", "k").distinct().collect()} == {(1, 2), (1, 3), (2, 4)}
    assert key(cuts.where("src = 2")) == key(IN.sampled_cuts(cells.where("src = 2"), [4], 2, 9, "tanimoto"))
    pairs = distance(cells, "gower").persist()
    own = IN.wonm(pairs, "dist", ks={1: [3], 2: [3]})[0]
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, IN.wonm(pairs, "dist", ks=[3])[0].collect()))
    assert IN.cec(cells, {1: [3], 2: [2, 4]}, 2, {1: 5, 2: 9}, {1: "gower", 2: "tanimoto"})[1].count() > 0


def test_samples_with_empty_objects_are_drawn_anew(spark):
    rng = np.random.default_rng(1)
    x = (rng.random((10, 12)) < 0.35).astype(float)
    x[:, 0] = 0
    x[0] = 0
    x[0, 3] = 1  # only samples with feature 3 have a value for object 0
    cells = ST.from_matrix(spark, x, [f"o{i}" for i in range(10)], [f"f{i:02d}" for i in range(12)])
    seen = []
    whole = IN.distance
    try:
        IN.distance = lambda c, m: (seen.append(c), whole(c, m))[1]
        IN.sampled_cuts(cells, [3], 4, 8, tries=40).count()
    finally:
        IN.distance = whole
    sums = seen[0].groupBy("src", "obj").agg(F.sum("val").alias("s"), F.count("*").alias("n"))
    assert sums.where("s = 0").count() == 0 and sums.where("n <> 8").count() == 0 and sums.count() == 40


def test_weight_by_silhouette_p(spark):
    mats = [points(12, s) for s in (1, 2)]
    got = EV.weight_by_silhouette(pairs_of(spark, *mats), {1: 2, 2: 3}, [0.0, 0.5, 1.0], 4).collect()
    assert len(got) == 3 and sum(r.best for r in got) == 1
    r2 = lambda a, b: float(np.corrcoef(a, b)[0, 1] ** 2) if a.std() > 0 and b.std() > 0 else 0.0
    for r in got:
        stats = []
        for boot in range(5):
            o = np.random.default_rng(boot).permutation(12) if boot else np.arange(12)
            now = [mats[0][np.ix_(o, o)], mats[1]]
            own = [K.pam(now[0], 2), K.pam(now[1], 3)]
            d = r.weight * now[0] + (1 - r.weight) * now[1]
            w = K.silhouette(d, y := K.pam(d, 3))
            stats.append(abs(2 * r2(w, y) - sum(r2(w, c) for c in own)))
        assert math.isclose(r.statistic, stats[0], abs_tol=1e-9) and math.isclose(r.p, (1 + sum(s <= stats[0] for s in stats[1:])) / 5)


def _no_pairs(*args, **kwargs):
    raise AssertionError("pairs of objects were made")


def test_asrs_makes_no_pairs(spark, monkeypatch):
    """class similarities from counts by class, objects missing from a partition included."""
    monkeypatch.setattr(CO, "pair_counts", _no_pairs)
    rows = [(s, f"o{n}", (n * (s + 1) + n // 3) % (2 + s) + 1) for s in (1, 2, 3) for n in range(14) if (n + s) % 5]
    got = {(r.p, r.q): r.s for r in CO.asrs_classes(spark.createDataFrame(rows, "src int, obj string, cluster int")).collect()}
    of = {(s, o): c for s, o, c in rows}
    cls = {}
    for s, o, c in rows:
        cls.setdefault(f"{s}:{c}", []).append(o)
    share = lambda i, j: 1.0 if i == j else sum((s, i) in of and of[s, i] == of.get((s, j)) for s in (1, 2, 3)) / 3
    mean = {(p, q): sum(share(i, j) for i in a for j in b) / (len(a) * len(b)) for p, a in cls.items() for q, b in cls.items()}
    top = max(v for (p, q), v in mean.items() if p != q)
    want = {k: 1.0 if k[0] == k[1] else v / top * 0.8 for k, v in mean.items() if v > 0}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_ipc_makes_no_pairs(spark, monkeypatch):
    """one step from counts by class; objects missing from a partition, and one that meets nobody, stay or move as by pairs."""
    monkeypatch.setattr(CO, "pair_counts", _no_pairs)
    rows = [(s, f"o{n:02d}", (n * (s + 1) + n // 3) % (2 + s) + 1) for s in (1, 2, 3) for n in range(16) if (n + s) % 5] + [(1, "zz", 9)]
    of = {(s, o): c for s, o, c in rows}
    now = {o: k % 4 + 1 for k, o in enumerate(sorted({o for _, o, _ in rows}))}
    got = {r.obj: r.cluster for r in CO.cooccurrence_assignment(spark.createDataFrame(rows, "src int, obj string, cluster int"), spark.createDataFrame(list(now.items()), "obj string, cluster int")).collect()}
    want = {}
    for i in now:
        best = (0.0, 0)
        for c in sorted(set(now.values())):
            others = [j for j in now if now[j] == c and j != i]
            mean = sum(of[s, i] == of.get((s, j)) for s in (1, 2, 3) if (s, i) in of for j in others) / 3 / max(len(others), 1)
            if round(mean, 9) > best[0]:
                best = (round(mean, 9), c)
        want[i] = best[1] or now[i]
    assert got == want


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_shared_features_meet_in_blocks(spark):
    """F8: shared counts come from blocks of packed leads, with no join on features; objects meet themselves."""
    from brindle.operators import characterize as CH

    x = np.random.default_rng(3).random((23, 9)) < 0.3
    cells = spark.createDataFrame([(1, f"o{i:02d}", f"f{j}", float(x[i, j])) for i in range(23) for j in range(9)], ST.CELLS)
    leads = spark.createDataFrame([(f"o{i:02d}",) for i in range(0, 23, 2)], "obj string")
    pairs = CH.features_of_cluster(cells, leads)[1]
    got = {(r.i, r.j): r.n for r in pairs.collect()}
    want = {(f"o{i:02d}", f"o{j:02d}"): int(n) for i in range(0, 23, 2) for j in range(i, 23, 2) if (n := (x[i] & x[j]).sum())}
    assert got == want
    assert "MapInArrow" in _plan(pairs)


def test_combined_distances(spark):
    """the weighted sum of two sources' distances without moving a pair, also where a source lacks objects."""
    from brindle.operators.distance import combined_distances, joint_distances, weighted_combination

    x = np.random.default_rng(4).random((17, 6))
    one = spark.createDataFrame([(1, f"o{i:02d}", f"f{j}", float(x[i, j])) for i in range(14) for j in range(6)], ST.CELLS)
    two = spark.createDataFrame([(2, f"o{i:02d}", f"f{j}", float(x[i, j] > 0.5)) for i in range(3, 17) for j in range(6)], ST.CELLS)
    per = [distance(one, "gower"), distance(two, "tanimoto")]
    got = {(r.i, r.j): r.d for r in combined_distances([(one, "gower"), (two, "tanimoto")], (1, 3)).collect()}
    want = {(r.i, r.j): r.d for r in weighted_combination(per[0].union(per[1]), {1: 1, 2: 3}).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    both = {(r.i, r.j): (r.d1, r.d2) for r in joint_distances([(one, "gower"), (two, "tanimoto")]).collect()}
    assert both == {(r.i, r.j): (r.d, r.d2) for r in per[0].join(per[1].select("i", "j", F.col("d").alias("d2")), ["i", "j"]).collect()}


def test_box_plot_counts_values(spark):
    """boxes from counted values, with no join of pairs."""
    from brindle.operators import plotdata as PL

    d1, d2 = np.random.default_rng(5).random(400), np.random.default_rng(6).integers(0, 30, 400) / 29
    x = spark.createDataFrame([(float(a), float(b)) for a, b in zip(d1, d2, strict=True)], "d1 double, d2 double")
    for r in PL.box_plot_joint(x, (0.3, 0.6)).collect():
        v = d2[(d1 > 0.6) * 1 + (d1 > 0.3) + 1 == r.bin]
        assert r.n == len(v) and np.allclose([r.low, r.q1, r.median, r.q3, r.high], np.quantile(v, [0, 0.25, 0.5, 0.75, 1]))


def test_link_similarity_meets_in_blocks(spark):
    """no join of objects on partitions; objects missing from a partition, and classes without a similarity, count as before."""
    rows = [(s, f"o{n:02d}", (n * (s + 1)) % (2 + s) + 1) for s in (1, 2, 3) for n in range(15) if (n + s) % 4]
    of = {(s, o): c for s, o, c in rows}
    sim = {(f"{s}:{c}", f"{s}:{d}"): 1.0 if c == d else 0.1 * c + 0.01 * d for s in (1, 2, 3) for c in range(1, 6) for d in range(1, 6) if (c + d) % 7}
    out = CO.link_similarity(spark.createDataFrame(rows, "src int, obj string, cluster int"), spark.createDataFrame([(*k, v) for k, v in sim.items()], "p string, q string, s double"))
    got = {(r.i, r.j): r.s for r in out.collect()}
    want = {}
    for i, j in itertools.combinations(sorted({o for _, o, _ in rows}), 2):
        v = [sim.get((f"{s}:{of[s, i]}", f"{s}:{of[s, j]}"), 0.0) for s in (1, 2, 3) if (s, i) in of and (s, j) in of]
        if v:
            want[i, j] = sum(v) / len(v)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert "MapInArrow" in _plan(out)


def _near_cells(spark, n=29):
    x = np.round(np.random.default_rng(7).random((n, 5)), 2)
    x[4], x[9] = x[3], x[3]
    return spark.createDataFrame([(1, f"o{i:02d}", f"f{j}", float(x[i, j])) for i in range(n) for j in range(5)], ST.CELLS)


def test_snf_affinity_of_cells(spark, monkeypatch):
    """the same rows as from pairs, made without windows over pairs, over several blocks."""
    from brindle.operators import distance as D

    cells = _near_cells(spark)
    want = {(r.i, r.j): r.s for r in IN.snf_affinity(distance(cells, "gower"), 4).collect()}
    monkeypatch.setattr(D, "BLOCK", 8)
    out = IN.snf_affinity_of(cells, "gower", 4)
    got = {(r.i, r.j): r.s for r in out.collect()}
    assert set(got) == set(want) and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)
    assert "Window" not in _plan(out)


def test_nemo_affinity_of_cells(spark, monkeypatch):
    """the same rows as from pairs, ties and copies included, over several blocks."""
    from brindle.operators import distance as D

    cells = _near_cells(spark)
    want = {(r.i, r.j): r.s for r in IN.nemo_affinity(distance(cells, "l2"), 4).collect()}
    monkeypatch.setattr(D, "BLOCK", 8)
    got = {(r.i, r.j): r.s for r in IN.nemo_affinity_of(cells, 4).collect()}
    assert set(got) == set(want) and all(math.isclose(got[k], want[k], abs_tol=1e-7) for k in want)
    one = IN.nemo_affinity_of(cells.where("obj < 'o03'"), 4).collect()
    assert len(one) == 6


def test_nemo_fused_by_pairs(spark, monkeypatch):
    """every pair that some source measured, affinities over all such sources, without a join of pairs."""
    from brindle.operators import distance as D

    cells = _near_cells(spark)
    cells = cells.where("obj < 'o24'").union(cells.where("obj > 'o05'").select(F.lit(2).alias("src"), "obj", "feat", (F.col("val") * F.col("val")).alias("val")))
    pairs = distance(cells, "l2")
    a = IN.nemo_affinity(pairs, 4).where("i < j")
    old = pairs.select("src", "i", "j").join(a, ["src", "i", "j"], "left").groupBy("i", "j").agg(F.avg(F.coalesce("s", F.lit(0.0))).alias("s"))
    want = {(r.i, r.j): r.s for r in old.collect()}
    monkeypatch.setattr(D, "BLOCK", 8)
    got = {(r.i, r.j): r.s for r in IN.nemo_fused(cells, 4).collect()}
    assert set(got) == set(want) and all(math.isclose(got[k], want[k], abs_tol=1e-7) for k in want)


@pytest.mark.parametrize("how", ["ward", "ward.D", "centroid", "median", "flexible", "single", "complete", "average", "mcquitty", "weighted"])
def test_tree_of_cells(spark, how):
    """The tree of cells is that of their rounded pairs, with ties; its cuts are those of its members."""
    cells = _near_cells(spark)
    pairs = distance(cells, "gower").withColumn("d", F.round("d", 9))
    (want,), (got,) = TR.cluster(pairs, "dist", linkage=how)[1].collect(), TR.cluster_cells(cells, "gower", linkage=how, places=9).collect()
    assert (want.objs, want.left, want.right) == (got.objs, got.left, got.right) and np.allclose(want.height, got.height, atol=1e-9)
    m = np.stack([got.left, got.right], 1)
    for k in (1, 3, 28, 29, 40):
        root = np.arange(29)
        for own in K.members(m)[: 29 - min(k, 29)]:
            root[own] = min(root[own])
        assert (K.cut(m, 29, k) == K.by_appearance(root)).all()


def test_dense_limit():
    """9,000 objects are no longer refused."""
    TR.check_dense(9000)


def test_adc_tree_moves_no_pairs(spark):
    """the tree of all features is that of its pairs, and is not made from them."""
    cells = _near_cells(spark)
    cells = cells.union(cells.select(F.lit(2).alias("src"), "obj", "feat", (F.col("val") * F.col("val")).alias("val")))
    pairs, tree = IN.adc(cells, "gower")
    (want,), (got,) = TR.agglomerate(pairs, "flexible").collect(), tree.collect()
    assert (want.objs, want.left, want.right) == (got.objs, got.left, got.right) and np.allclose(want.height, got.height)
    assert "MapInArrow" not in _plan(tree)


def test_label_distance(spark):
    """as the scaled mean over joined runs, without a row for a pair and run; pairs that never meet are the largest."""
    rows = [(1, f"r{k}", f"o{n:02d}", (n * (k + 2) + k) % (3 + k) + 1) for k in range(4) for n in range(17) if (n * 3 + k * 5) % 4 > 1]
    b = spark.createDataFrame(rows, "src int, run string, obj string, cluster int")
    one = b.select("src", "run", F.col("obj").alias("i"), F.col("cluster").alias("ci")).join(b.select("src", "run", F.col("obj").alias("j"), F.col("cluster").alias("cj")), ["src", "run"]).where("i < j")
    old = B.scaled_mean(one.select("src", "i", "j", F.abs(F.col("ci") - F.col("cj")).cast("double").alias("d")), b.select("src", "obj").distinct())
    want, out = {(r.i, r.j): r.d for r in old.collect()}, B.label_distance(b)
    got = {(r.i, r.j): r.d for r in out.collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert "MapInArrow" in _plan(out)


def test_equal_objects_share_a_row(monkeypatch):
    """the tree of objects with equal values is that of all of them, merge by merge, and only different ones are limited."""
    rng = np.random.default_rng(5)
    coded, rough = (rng.random((40, 4)) < 0.5).astype(float), rng.integers(0, 3, (40, 2)).astype(float)
    for v, matrix in ((coded, lambda x: kernel(x, x, "tanimoto")), (rough, lambda x: kernel(x, x, "gower", np.array([2.0, 2.0])))):
        for how in K.LINKAGES:
            (m, h), (wm, wh) = TR.link_rows(v, matrix, how), K.linkage(matrix(v), how)
            assert (m == wm).all() and (h == wh).all()
    monkeypatch.setattr(TR, "DENSE_MOST", 9)
    assert len(TR.link_rows(rough, lambda x: kernel(x, x, "gower", np.array([2.0, 2.0])))[0]) == 39


def test_adec_moves_no_pairs(spark, mixed):
    """both trees are those of their pairs, and neither is made from pairs."""
    cells = mixed[0].where("src = 2")
    pairs, tree = IN.adec(cells, [3, 5], 4, 9)
    (want,), (got,) = TR.agglomerate(pairs, "ward").collect(), tree.collect()
    assert (want.objs, want.left, want.right) == (got.objs, got.left, got.right) and np.allclose(want.height, got.height)
    assert "MapInArrow" not in _plan(tree)
    d = distance(cells, "tanimoto")
    assert "MapInArrow" not in _plan(TR.agglomerate(d, "flexible"))
    (want,), (got,) = TR.agglomerate(d.select("*"), "flexible").collect(), TR.agglomerate(d, "flexible").collect()
    assert (want.left, want.right) == (got.left, got.right)


def test_cec_moves_no_pairs(spark, mixed):
    """each weight's tree is that of its pairs, is not made from pairs, and is made only where it is asked for."""
    pairs, trees, grid, pick = IN.cec(mixed[0], [3, 5], 2, {1: 5, 2: 9}, "gower", weights=4)
    assert len(grid) == 5 and grid[pick][1] == (0.5, 0.5)
    want = {r.src: r for r in TR.agglomerate(pairs, "ward").collect()}
    got = {r.src: r for r in trees.collect()}
    assert set(got) == set(want) == set(range(5))
    for g in got:
        assert (want[g].objs, want[g].left, want[g].right) == (got[g].objs, got[g].left, got[g].right) and np.allclose(want[g].height, got[g].height)
    assert "MapInArrow" not in _plan(trees)
    assert [_plan(t).count("FlatMapGroupsInArrow") for t in (trees.select("*"), trees.where(F.col("src") == pick))] == [5, 1]


@pytest.mark.parametrize("how", ["mabc", "abc"])
def test_bag_coordinates(spark, how):
    """coordinates of bagged labels are those of all their pairs, objects with equal labels included, and no pair is moved."""
    rows = [(s, it, f"o{n:02d}", (n % 11) * (it + s) % (2 + it % 3) + 1) for s in (1, 2) for it in range(1, 6) for n in range(33) if (n % 11 * 3 + it * 5 + s) % 4 > 0]
    abc = spark.createDataFrame(rows, B.ABC)
    out = B.bag_coordinates(abc, how)
    assert "MapInArrow" not in _plan(out)
    want, got = ({r.obj: (abs(r.x), abs(r.y)) for r in df.collect()} for df in (B.coordinates(B.abc_consensus(abc, how)), out))
    assert set(got) == set(want) and len(got) == 33 and all(np.allclose(got[o], want[o], atol=1e-7) for o in want)


def test_top_eigen():
    """without all eigenvectors, and with equal eigenvalues."""
    q = np.linalg.qr(np.random.default_rng(2).standard_normal((300, 300)))[0]
    v = np.concatenate([[5.0, 5.0, 4.9], np.linspace(-6, 4.5, 297)])
    c = (q * v) @ q.T
    val, vec = K.top_eigen(c, 3, whole=50)
    assert np.allclose(val, v[:3]) and np.allclose(c @ vec, vec * val, atol=1e-6)


def test_bags_of_equal_objects():
    """a bag of 60,000 objects with few different values takes a matrix of these only, in the tree that all of them have."""
    v = np.random.default_rng(3).integers(0, 7, (60_000, 3)).astype(float)
    m, h = TR.link_rows(v, lambda x: B._distance(x, "euclidean"), "ward.D2")
    assert len(m) == 59_999 and (h[: 60_000 - 343] == 0).all() and (np.diff(h) > -1e-9).all()
    few = v[:400]
    (m, h), (wm, wh) = TR.link_rows(few, lambda x: B._distance(x, "euclidean"), "ward.D2"), K.linkage(B._distance(few, "euclidean"), "ward.D2")
    assert (m == wm).all() and (h == wh).all()


def test_bags_beyond_a_matrix(monkeypatch):
    """beyond the limit of different objects ward goes by rounds, with the cuts and heights of the whole matrix; ties that leave the rounds open are refused."""
    rng = np.random.default_rng(4)
    v = rng.random((150, 3))[rng.integers(0, 150, 260)]
    v[:, 2] *= 7
    want, tall = K.linkage(B._distance(v, "euclidean"), "ward.D2")
    monkeypatch.setattr(TR, "DENSE_MOST", 40)
    m, h = TR.link_rows(v, lambda x: B._distance(x, "euclidean"), "ward.D2", squares=B._squares(v, "euclidean"))
    assert np.allclose(h, tall) and all((K.cut(m, 260, k) == K.cut(want, 260, k)).all() for k in (1, 2, 4, 17, 90, 260))
    with pytest.raises(ValueError, match="too many"):
        TR.link_rows(v, lambda x: B._distance(x, "euclidean"), "average", squares=B._squares(v, "euclidean"))
    tied = np.stack(np.meshgrid(range(9), range(9), range(2)), -1).reshape(-1, 3).astype(float)
    with pytest.raises(ValueError, match="too many"):
        TR.link_rows(tied, lambda x: B._distance(x, "euclidean"), squares=B._squares(tied, "euclidean"))


def test_large_blocks_meet_less(spark, monkeypatch):
    """Objects of a large source travel to few blocks, whose kernels get parts of them, with the same distances."""
    from brindle.operators import distance as D

    rng = np.random.default_rng(5)
    one = ST.from_matrix(spark, rng.random((90, 3)), [f"o{i:02d}" for i in range(90)], ["a", "b", "c"])
    two = ST.from_matrix(spark, (rng.random((90, 4)) < 0.5).astype(float), [f"o{i:02d}" for i in range(90)], ["p", "q", "r", "s"], src=2)
    sources, weights = [(one, "gower"), (two, "tanimoto")], (0.3, 0.7)
    want = {(r.i, r.j): r.d for r in D.combined_distances(sources, weights).collect()}
    monkeypatch.setattr(D, "BLOCK", 2)
    monkeypatch.setattr(D, "WIDE", 16)
    monkeypatch.setattr(D, "ROWS", 256)
    assert D.met_blocks(D._several(sources)[0], large=True).count() == 6  # 3 blocks of 32, where 12 of 8 meet 78 times
    got = {(r.i, r.j): r.d for r in D.combined_distances(sources, weights).collect()}
    assert len(want) == 90 * 89 // 2 and got == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("linkage", ["average", "single", "complete", "ward", "weighted", "flexible", "ward.D", "mcquitty"])
@pytest.mark.parametrize("places", [9, None])
def test_trees_beyond_the_matrix(spark, monkeypatch, linkage, places):
    """More different objects than a matrix may hold give the tree that the matrix gives, in blocks that tasks share."""
    from brindle.operators import rounds as R

    x = np.random.default_rng(8).random((90, 3)) ** 2
    x[:, 2] = x[:, 2] > 0.3
    x[60:70] = x[3:13]
    cells = ST.from_matrix(spark, x, [f"o{i:02d}" for i in range(90)], ["a", "b", "c"])
    d = kernel(x, x, "gower", np.ptp(x, 0))
    m, h = K.linkage(d if places is None else np.round(d, places), linkage)
    monkeypatch.setattr(TR, "DENSE_MOST", 60)
    monkeypatch.setattr(R, "BLOCK", 40)
    monkeypatch.setattr(R, "TILE", 16)
    got = TR.cluster_cells(cells, "gower", linkage=linkage, places=places).collect()
    assert len(got) == 1 and got[0].objs == [f"o{i:02d}" for i in range(90)]
    assert list(zip(got[0].left, got[0].right, strict=True)) == [tuple(r) for r in m.tolist()]
    assert got[0].height == pytest.approx(h.tolist(), abs=1e-9)


def test_sampled_trees_beyond_the_matrix(spark, monkeypatch):
    """adec and adc with more different objects than a matrix may hold."""
    x = (np.random.default_rng(2).random((70, 9)) < 0.5).astype(float)
    x[:, 0] = np.random.default_rng(3).random(70)
    cells = ST.from_matrix(spark, x, [f"o{i:02d}" for i in range(70)], [f"f{i}" for i in range(9)])

    def labels():
        return [sorted(map(tuple, TR.labels(t, 4).collect())) for t in (IN.adc(cells, "gower")[1],)]

    def cuts():
        return sorted(map(tuple, IN.sampled_cuts(cells, [3, 5], 2, 6, "gower").collect()))

    want = labels(), cuts()
    monkeypatch.setattr(TR, "DENSE_MOST", 40)
    assert (labels(), cuts()) == want
