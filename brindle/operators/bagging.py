"""Aggregated bootstrap clustering: objects and features are sampled by hash, sampled sets are
clustered in fan-out groups (one task for each source and iteration), and pairs are counted.

labels of a run: abc(src, iter, obj, cluster); an object that was not drawn has no row.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import bisect_weight_c, uniform
from ..plans.checkpoints import cut_lineage
from ..sources.tables import pack
from . import kernels as K
from .coassociation import packed_runs, pair_counts, run_labels
from .distance import each_meeting, kernel, meet_blocks
from .integrate import weighted_clust
from .nuggets import create_nuggets, feature_weights
from .trees import TASKS, agglomerate, by_rows, check_dense, labels, link_rows

ABC = "src int, iter int, obj string, cluster int"


def feature_scores(cells: DataFrame, weighting: str = "var", nugget_type: str = "between", nuggets: int | None = None) -> DataFrame:
    """(src, feat, score): variance, coefficient of variation, nugget weight, or 1."""
    if weighting == "nugget":
        parts = None
        for src in sorted(r.src for r in cells.select("src").distinct().collect()):  # one row for each source
            one = feature_weights(*create_nuggets(cells.where(F.col("src") == src), nuggets), nugget_type)
            parts = one if parts is None else parts.union(one)
        return parts
    g = cells.groupBy("src", "feat").agg(F.var_samp("val").alias("v"), F.avg("val").alias("m"), F.stddev_samp("val").alias("s"))
    eps = 2.220446049250313e-16
    mean = F.when(F.abs("m") < eps, eps).otherwise(F.abs("m"))
    score = {"var": F.coalesce("v", F.lit(0.0)), "cv": F.coalesce(F.col("s") / mean, F.lit(0.0)), "equal": F.lit(1.0)}
    if weighting not in score:
        raise ValueError("weighting is var, cv, nugget or equal")
    return g.select("src", "feat", score[weighting].alias("score"))


def feature_weights_by_rank(scores: DataFrame, equal: bool = False) -> DataFrame:
    """(src, feat, rank, p): probabilities in proportion to 1 / (rank + c), ranks by falling score (to twelve places, ties by name); the top 1 % carry 20 %."""
    w = Window.partitionBy("src").orderBy(F.desc(F.round("score", 12)), "feat")
    r = scores.withColumn("rank", F.row_number().over(w))
    if equal:
        return r.select("src", "feat", "rank", (1 / F.count("*").over(Window.partitionBy("src"))).alias("p"))
    sizes = {x.src: x.g for x in scores.groupBy("src").agg(F.count("*").alias("g")).collect()}  # one row for each source
    c = F.create_map(*[F.lit(v) for s, g in sizes.items() for v in (s, float(bisect_weight_c(g)))])
    raw = 1 / (F.col("rank") + F.element_at(c, F.col("src")))
    return r.withColumn("raw", raw).select("src", "feat", "rank", (F.col("raw") / F.sum("raw").over(Window.partitionBy("src"))).alias("p"))


def sample_size(features: int, wanted: float | None) -> int:
    """None: root of the number of features, two at least; below 1: a share; else a count."""
    if wanted is None:
        return max(2, math.isqrt(features))
    return max(1, min(features, int(wanted * features) if 0 < wanted < 1 else int(wanted)))


def sampled_features(weights: DataFrame, iters: int, size: int | dict[int, int], seed: int = 1) -> DataFrame:
    """(src, iter, feat): `size` features without replacement, by the smallest -ln(u) / p (sequential weighted draws)."""
    x = weights.select("src", "feat", "p", F.explode(F.sequence(F.lit(1), F.lit(iters))).alias("iter"))
    key = -F.log(F.greatest(uniform(seed, F.col("src"), F.col("iter"), F.col("feat")), F.lit(1e-12))) / F.col("p")
    n = F.lit(size) if isinstance(size, int) else F.element_at(F.create_map(*[F.lit(v) for kv in size.items() for v in kv]), F.col("src"))
    w = Window.partitionBy("src", "iter").orderBy("key", "feat")
    return x.withColumn("key", key).withColumn("n", F.row_number().over(w)).where(F.col("n") <= n).select("src", "iter", "feat")


def bootstrap(objects: DataFrame, iters: int, seed: int = 1) -> DataFrame:
    """(src, iter, obj) from objects(src, obj): n draws with replacement, distinct."""
    o = objects.withColumn("at", F.row_number().over(Window.partitionBy("src").orderBy("obj"))).withColumn("n", F.count("*").over(Window.partitionBy("src")))
    draws = o.select("src", "n", F.col("at").alias("draw"), F.explode(F.sequence(F.lit(1), F.lit(iters))).alias("iter"))
    hit = draws.select("src", "iter", (F.floor(uniform(seed, "boot", F.col("src"), F.col("iter"), F.col("draw")) * F.col("n")) + 1).cast("int").alias("at")).distinct()
    return hit.join(o.select("src", "at", "obj"), ["src", "at"]).select("src", "iter", "obj")


def _matrix(pdf: pd.DataFrame) -> tuple[np.ndarray, list[str]]:
    m = pdf.pivot(index="obj", columns="feat", values="val").sort_index()
    return m.to_numpy(float), list(m.index)


def _distance(x: np.ndarray, measure: str) -> np.ndarray:
    """Within one sample; ranges are the sample's own, and what is undefined falls back to lengths."""
    if measure in ("euclidean", "gower"):
        r = np.ptp(x, axis=0)
        d = kernel(x, x, "gower", np.where(r > 0, r, np.nan))
    else:
        d = kernel(x, x, measure)
    return kernel(x, x, "l2") if np.isnan(d).any() else d


def _squares(x: np.ndarray, measure: str):
    """Squares of _distance for any rows of x, where it is gower without unknown values; else None."""
    r = np.ptp(x, axis=0)
    known = np.flatnonzero(r > 0)
    if measure not in ("euclidean", "gower") or not len(known) or np.isnan(x).any():
        return None

    def run(a, b):
        d = np.zeros((len(a), len(b)))
        for k in known:
            one = np.subtract.outer(a[:, k] / r[k], b[:, k] / r[k])
            d += np.abs(one, out=one)
        d /= len(known)
        d *= d
        return d

    return run


def _of(value, src: int):
    """A setting: one for all sources, or a dict with one for each."""
    return value[src] if isinstance(value, dict) else value


def _complete(cells: DataFrame) -> DataFrame:
    """Cells with a null for every feature that an object of the source lacks."""
    objs, feats = cells.select("src", "obj").distinct(), cells.select("src", "feat").distinct()
    return objs.join(feats, "src").join(cells, ["src", "obj", "feat"], "left").select("src", "obj", "feat", "val")


def _scores_by_source(cells: DataFrame, weighting, nugget_type, nuggets) -> tuple[DataFrame, list[int]]:
    """(scores of all sources, the sources whose features weigh alike)."""
    srcs = sorted(r.src for r in cells.select("src").distinct().collect())  # one row for each source
    ways = {s: (_of(weighting, s), _of(nugget_type, s), _of(nuggets, s)) for s in srcs}
    out = None
    for way in sorted(set(ways.values()), key=str):
        one = feature_scores(cells.where(F.col("src").isin([s for s in srcs if ways[s] == way])), *way)
        out = one if out is None else out.unionByName(one)
    return out, [s for s in srcs if ways[s][0] == "equal"]


def _drawn(objs: DataFrame, srcs, iters, bag, seed: int) -> DataFrame:
    """(src, iter, obj): the objects of each source's iterations, bootstrapped where `bag` says so."""
    most = max(_of(iters, s) for s in srcs)
    own = F.element_at(F.create_map(*[F.lit(v) for s in srcs for v in (s, int(_of(iters, s)))]), F.col("src"))
    bagged = [s for s in srcs if _of(bag, s)]
    drawn = bootstrap(objs.where(F.col("src").isin(bagged)), most, seed) if bagged else None
    if len(bagged) < len(srcs):
        every = objs.where(~F.col("src").isin(bagged)).select("src", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("iter"), "obj")
        drawn = every if drawn is None else drawn.unionByName(every)
    return drawn.where(F.col("iter") <= own)


def _samples(cells, weighting, iters, nfeat, bag, seed, nugget_type, nuggets, scores=None) -> DataFrame:
    """(src, iter, obj, x): drawn objects with their values of the sampled features, in order of the features' names.

    Objects travel packed and the sampled values are picked from the array, so that no row is made for a cell.
    """
    scores, equal = _scores_by_source(cells, weighting, nugget_type, nuggets) if scores is None else (scores, [])
    scores = cut_lineage(scores)
    w = feature_weights_by_rank(scores.where(~F.col("src").isin(equal)) if equal else scores)
    if equal:
        w = w.unionByName(feature_weights_by_rank(scores.where(F.col("src").isin(equal)), True))
    found = {r.src: r.g for r in scores.groupBy("src").agg(F.count("*").alias("g")).collect()}
    sizes = {s: sample_size(g, _of(nfeat, s)) for s, g in found.items()}
    most = max(_of(iters, s) for s in found)
    own = F.element_at(F.create_map(*[F.lit(v) for s in found for v in (s, int(_of(iters, s)))]), F.col("src"))
    place = scores.select("src", "feat", (F.row_number().over(Window.partitionBy("src").orderBy("feat")) - 1).alias("at"))
    picked = sampled_features(w, most, sizes, seed).where(F.col("iter") <= own).join(place, ["src", "feat"]).groupBy("src", "iter").agg(F.array_sort(F.collect_list("at")).alias("at"))
    drawn = _drawn(cells.select("src", "obj").distinct(), found, iters, bag, seed)
    full = cells.groupBy("src").agg((F.count("*") == F.countDistinct("obj") * F.countDistinct("feat")).alias("ok")).where("not ok").head(1)
    packed = cut_lineage(pack(_complete(cells) if full else cells))
    rows = drawn.join(packed, ["src", "obj"]).join(picked, ["src", "iter"])
    return rows.select("src", "iter", "obj", F.transform("at", lambda i: F.get("x", i)).alias("x"))


def _sampled_matrix(pdf: pd.DataFrame) -> tuple[np.ndarray, list[str]]:
    pdf = pdf.sort_values("obj")
    return np.array([np.asarray(v, float) for v in pdf["x"]]), list(pdf["obj"])


def abc_labels(cells: DataFrame, measure="euclidean", weighting="var", iters=1000, classes: int | dict[int, int] | None = None, nfeat=None, linkage="ward.D2", bag=True, seed: int = 1, nugget_type="between", nuggets=None) -> DataFrame:
    """One source or several: bagged clusterings, classes = root of the number of objects when not given.

    Every option but seed may be a dict with one value for each source.
    """
    n = cells.select("obj").distinct().count()
    k = classes or max(2, math.isqrt(n))

    def run(key, pdf):
        src = int(key[0])
        x, objs = _sampled_matrix(pdf)
        m, _ = link_rows(x, lambda v: _distance(v, _of(measure, src)), _of(linkage, src), squares=_squares(x, _of(measure, src)))
        return pd.DataFrame({"src": src, "iter": int(key[1]), "obj": objs, "cluster": K.cut(m, len(objs), _of(k, src)).astype("int32")})

    return _samples(cells, weighting, iters, nfeat, bag, seed, nugget_type, nuggets).groupBy("src", "iter").applyInPandas(run, ABC)


def _counts(abc: DataFrame) -> DataFrame:
    """(i, j, together, apart) over the iterations of all sources, for all pairs."""
    return pair_counts(abc.select(F.lit(0).alias("src"), F.concat_ws(":", F.col("src").cast("string"), F.col("iter").cast("string")).alias("run"), "obj", "cluster"))


def co_clustering(abc: DataFrame) -> DataFrame:
    """(i, j, co_sel, apart): iterations that drew both, and those that kept them apart."""
    return _counts(abc).where("together + apart > 0").select("i", "j", (F.col("together") + F.col("apart")).alias("co_sel"), "apart")


def abc_consensus(abc: DataFrame, dissimilarity: str = "mabc") -> DataFrame:
    """pairs(src = 0, i, j, d): s = share of joint draws together (0 for pairs never drawn together); abc: 1 - s, mabc: sqrt(1 - s^2)."""
    n = F.col("together") + F.col("apart")
    s = F.when(n > 0, F.col("together") / n).otherwise(0.0)
    d = 1 - s if dissimilarity == "abc" else F.sqrt(F.greatest(F.lit(0.0), 1 - s * s))
    return _counts(abc).select(F.lit(0).alias("src"), "i", "j", d.alias("d"))


def multi_source_consensus(abc: DataFrame, k: int | None = None, dissimilarity: str = "mabc", linkage: str = "ward", alpha: float = 0.625, mds: bool = False):
    """(pairs, tree, labels or None, coordinates or None) of stacked bagged labels."""
    d = abc_consensus(abc, dissimilarity)
    tree = agglomerate(d, linkage, alpha)
    return d, tree, labels(tree, k) if k else None, bag_coordinates(abc, dissimilarity) if mds else None


def coordinates(pairs: DataFrame, dims: int = 2) -> DataFrame:
    """(obj, x, y): classical scaling of one source's pairs."""
    from .trees import dense

    def run(key, pdf):
        d, objs = dense(pdf)
        z = K.classical_mds(d, dims)
        return pd.DataFrame({"obj": objs, "x": z[:, 0], "y": z[:, 1]})

    return pairs.groupBy("src").applyInPandas(run, "obj string, x double, y double")


def bag_coordinates(abc: DataFrame, dissimilarity: str = "mabc", dims: int = 2) -> DataFrame:
    """(obj, x, y): classical scaling of abc_consensus of bagged labels. The task makes its distances from the labels, and objects with equal labels, at distance zero, share a row."""

    def run(key, table):
        names = table.column("obj").to_pylist()
        v = run_labels(table.column("x").combine_chunks())[0]
        first, of = K.alike(v)
        check_dense(len(first))
        v = v[first]

        def made(rows):
            met, together = np.zeros((2, len(v[rows]), len(v)), np.int32)
            for run in np.ascontiguousarray(v.T):
                has = (run[rows] > 0)[:, None] & (run > 0)[None]
                met += has
                together += has & (run[rows, None] == run[None])
            s = together / np.maximum(met, 1)
            return 1 - s if dissimilarity == "abc" else np.sqrt(np.maximum(0, 1 - s * s))

        z = np.zeros((len(v), 2))
        got = K.classical_mds(by_rows(len(v), made), dims, np.bincount(of))
        z[:, : got.shape[1]] = got[:, :2]
        return pa.table({"obj": names, "x": z[of, 0], "y": z[of, 1]})

    runs = abc.select(F.lit(0).alias("src"), F.concat_ws(":", F.col("src").cast("string"), F.col("iter").cast("string")).alias("run"), "obj", "cluster")
    return packed_runs(runs).groupBy("src").applyInArrow(run, "obj string, x double, y double")


def m_abc(cells: DataFrame, k: int | None = None, dissimilarity: str = "mabc", final_linkage: str = "ward", **options):
    """Multi-source bagged clustering: labels of all sources stacked, consensus, tree, cut."""
    return multi_source_consensus(abc_labels(cells, **options), k, dissimilarity, final_linkage)


def abc_distance(cells: DataFrame, measure="euclidean", weighting="var", iters=1000, nfeat=None, bag=True, seed: int = 1, nugget_type="between", nuggets=None) -> DataFrame:
    """pairs(src, i, j, d): mean distance over the iterations that drew both, missing as the largest, scaled to 1.

    Every option but seed may be a dict with one value for each source.  A task sums its iterations'
    distances in one matrix, so that pairs move once for each of TASKS tasks of a source, not for each iteration.
    """

    def run(key, pdf):
        src = int(key[0])
        objs = sorted(set(pdf["obj"]))
        check_dense(len(objs))
        at = {o: i for i, o in enumerate(objs)}
        total, count = np.zeros((len(objs), len(objs))), np.zeros((len(objs), len(objs)), np.int32)
        for _, one in pdf.groupby("iter"):
            x, own = _sampled_matrix(one)
            ix = np.ix_([at[o] for o in own], [at[o] for o in own])
            total[ix] += _distance(x, _of(measure, src))
            count[ix] += 1
        i, j = np.nonzero(np.triu(count, 1))
        o = np.asarray(objs, object)
        return pd.DataFrame({"src": np.full(len(i), src, np.int32), "i": o[i], "j": o[j], "t": total[i, j], "n": count[i, j].astype("int64")})

    rows = _samples(cells, weighting, iters, nfeat, bag, seed, nugget_type, nuggets).withColumn("task", F.col("iter") % TASKS)
    sums = rows.groupBy("src", "task").applyInPandas(run, "src int, i string, j string, t double, n long")
    mean = sums.groupBy("src", "i", "j").agg((F.sum("t") / F.sum("n")).alias("d"))
    return scaled(mean, cells.select("src", "obj").distinct())


def scaled_mean(per: DataFrame, objects: DataFrame) -> DataFrame:
    """Distances of single iterations (src, i, j, d) to their mean, scaled."""
    return scaled(per.groupBy("src", "i", "j").agg(F.avg("d").alias("d")), objects)


def label_distance(runs: DataFrame) -> DataFrame:
    """pairs(src, i, j, d) of labels(src, run, obj, cluster): mean difference of two objects' labels over the runs that have both, scaled as `scaled`.

    Objects meet in blocks twice, for the largest mean and for the rows; no pair is moved.
    """
    packed = cut_lineage(packed_runs(runs))

    def mean(a, b) -> np.ndarray:
        x, y = run_labels(a, b)
        total, n = np.zeros((len(x), len(y))), np.zeros((len(x), len(y)))
        for r in range(x.shape[1]):
            both = (x[:, r] > 0)[:, None] & (y[:, r] > 0)[None]
            total += np.where(both, np.abs(x[:, r][:, None] - y[:, r][None]), 0)
            n += both
        return np.where(n > 0, total / np.maximum(n, 1), np.nan)

    def most(src, same, a, x, b, y):
        m = mean(x, y)
        if same:
            np.fill_diagonal(m, np.nan)
        m = m[~np.isnan(m)]
        if len(m):
            yield pa.RecordBatch.from_arrays([pa.array([src], pa.int32()), pa.array([float(m.max())])], names=["src", "m"])

    top = cut_lineage(each_meeting(packed, most, "src int, m double").groupBy("src").agg(F.max("m").alias("m")))
    pairs = meet_blocks(packed, lambda a, b: [mean(a, b)], "d double").join(F.broadcast(top), "src", "left")
    return pairs.select("src", "i", "j", (F.when(F.isnan("d"), F.col("m")).otherwise(F.col("d")) / F.when(F.col("m") > 0, F.col("m")).otherwise(1.0)).alias("d"))


def scaled(mean: DataFrame, objects: DataFrame) -> DataFrame:
    """Mean distances over their source's largest; pairs without one count as that."""
    a = objects.select("src", F.col("obj").alias("i"))
    every = a.join(objects.select("src", F.col("obj").alias("j")), "src").where("i < j")
    top = mean.groupBy("src").agg(F.max("d").alias("m"))
    return every.join(mean, ["src", "i", "j"], "left").join(F.broadcast(top), "src").select("src", "i", "j", (F.coalesce("d", "m") / F.when(F.col("m") > 0, F.col("m")).otherwise(1.0)).alias("d"))


def m_abc_distance(cells: DataFrame, weights: dict[int, float] | None = None, k: int | None = None, final_linkage: str = "ward", alpha: float = 0.625, **options):
    """Weighted sum of the sources' bagged distances, weights scaled to 1: (pairs, tree, labels or None)."""
    from .distance import weighted_combination

    per = abc_distance(cells, **options)
    srcs = weights or {r.src: 1.0 for r in per.select("src").distinct().collect()}
    d = weighted_combination(per, srcs)
    tree = agglomerate(d, final_linkage, alpha)
    return d, tree, labels(tree, k) if k else None


def m_abc_distance_grid(cells: DataFrame, weights=10, focus=0.5, k: int | None = None, linkage: str = "ward", **options):
    """Bagged distances through the grid of weighted_clust: (pairs by weight, trees, grid, focus number, labels or None)."""
    pairs, trees, grid, pick = weighted_clust(abc_distance(cells, **options), "dist", weights=weights, focus=focus, linkage=linkage)
    return pairs, trees, grid, pick, labels(trees.where(F.col("src") == pick), k) if k else None


def abc_deep_labels(cells: DataFrame, weighting="var", iters=500, classes: int | dict[int, int] | None = None, top_share=0.2, latent=None, hidden=32, epochs=80, rate=1e-3, method="ward", linkage="ward.D2", bag=True, seed: int = 1, nugget_type="between", nuggets=None) -> DataFrame:
    """Deep variant: for each source an autoencoder on its top features, once; bags are clustered in its latent space.

    Every option but seed may be a dict with one value for each source.
    """
    from .normalize import column_minmax

    n = cells.select("obj").distinct().count()
    k = classes or max(2, math.isqrt(n))
    scores = cut_lineage(_scores_by_source(cells, weighting, nugget_type, nuggets)[0])
    sizes = {r.src: max(1, min(r.g, 4000, max(round(_of(top_share, r.src) * r.g), 20))) for r in scores.groupBy("src").agg(F.count("*").alias("g")).collect()}
    keep = F.element_at(F.create_map(*[F.lit(v) for kv in sizes.items() for v in kv]), F.col("src"))
    top = feature_weights_by_rank(scores).where(F.col("rank") <= keep).select("src", "feat")
    x = column_minmax(cells.join(top, ["src", "feat"]))

    def encode(key, pdf):
        src = int(key[0])
        m, objs = _matrix(pdf)
        dim = _of(latent, src) or max(2, min(_of(k, src) + 2, 8, m.shape[1]))
        z = K.autoencoder(m, dim, _of(hidden, src), _of(epochs, src), _of(rate, src), seed)(m)
        return pd.DataFrame({"src": np.full(len(objs), src, np.int32), "obj": objs, "x": list(z)})

    z = cut_lineage(x.groupBy("src").applyInPandas(encode, "src int, obj string, x array<double>"))

    def run(key, pdf):
        src = int(key[0])
        m, names = _sampled_matrix(pdf)
        own = _of(k, src)
        if len(names) < max(4, own):
            return pd.DataFrame(columns=["src", "iter", "obj", "cluster"])
        if _of(method, src) == "kmeans":
            y = K.by_appearance(K.kmeans(m, own, starts=5, seed=int(key[1]))[0])
        else:
            y = K.cut(K.linkage(kernel(m, m, "l2"), _of(linkage, src))[0], len(names), own)
        return pd.DataFrame({"src": src, "iter": int(key[1]), "obj": names, "cluster": y.astype("int32")})

    return z.join(_drawn(cells.select("src", "obj").distinct(), sizes, iters, bag, seed), ["src", "obj"]).groupBy("src", "iter").applyInPandas(run, ABC)


def m_abc_deep(cells: DataFrame, k: int | None = None, dissimilarity: str = "mabc", final_linkage: str = "ward", **options):
    return multi_source_consensus(abc_deep_labels(cells, **options), k, dissimilarity, final_linkage)


def sample_ranks(spark, n: int, draws: int, size: int, replace: bool = False, weighted: bool = False, shift: float = 100.0, seed: int = 1) -> DataFrame:
    """(draw, item): draws of `size` items from 0..n-1 (fewer when n is smaller and replace is False), by equal weights or 1 / (rank + shift)."""
    items = spark.range(n).select(F.col("id").alias("item"), (1.0 / (F.col("id") + 1 + F.lit(shift)) if weighted else F.lit(1.0)).alias("w"))
    if replace:
        ends = items.withColumn("one", F.lit(1)).withColumn("hi", F.sum("w").over(Window.partitionBy("one").orderBy("item")))
        ends = ends.withColumn("lo", F.col("hi") - F.col("w")).withColumn("top", F.sum("w").over(Window.partitionBy("one")))
        grid = spark.range(draws).select(F.col("id").alias("draw")).select("draw", F.explode(F.sequence(F.lit(1), F.lit(size))).alias("at"))
        u = grid.select("draw", "at", uniform(seed, "draw", F.col("draw"), F.col("at")).alias("u"))
        return u.join(ends, (F.col("u") * F.col("top") >= F.col("lo")) & (F.col("u") * F.col("top") < F.col("hi"))).select("draw", "item")
    x = items.select("item", "w", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    key = -F.log(F.greatest(uniform(seed, F.col("draw"), F.col("item")), F.lit(1e-12))) / F.col("w")
    first = Window.partitionBy("draw").orderBy("key", "item")
    return x.withColumn("key", key).withColumn("n", F.row_number().over(first)).where(F.col("n") <= size).select("draw", "item")
