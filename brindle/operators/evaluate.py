"""Agreement of partitions, silhouettes, selection of the number of classes and of source weights."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.checkpoints import cut_lineage
from . import kernels as K
from .distance import mirrored
from .trees import TASKS, agglomerate, dense, labels, pam


def contingency(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b, n) of two label tables (obj, cluster)."""
    return a.select("obj", F.col("cluster").alias("a")).join(b.select("obj", F.col("cluster").alias("b")), "obj").groupBy("a", "b").agg(F.count("*").alias("n"))


def _pairs_in(x):
    return x * (x - 1) / 2


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: ari, nmi, jaccard, purity of two label tables."""
    c = contingency(a, b)
    rows, cols = c.groupBy("a").agg(F.sum("n").alias("n")), c.groupBy("b").agg(F.sum("n").alias("n"))
    n = F.col("n").cast("double")
    x = c.agg(F.sum(_pairs_in(n)).alias("s"), F.sum(n * F.log(n)).alias("h"), F.sum(n).alias("t"))
    r = rows.agg(F.sum(_pairs_in(n)).alias("sr"), F.sum(n * F.log(n)).alias("hr"))
    k = cols.agg(F.sum(_pairs_in(n)).alias("sc"), F.sum(n * F.log(n)).alias("hc"))
    top = c.groupBy("a").agg(F.max("n").alias("m")).agg(F.sum("m").alias("top"))
    one = x.crossJoin(r).crossJoin(k).crossJoin(top)  # single rows
    exp_ = F.col("sr") * F.col("sc") / _pairs_in(F.col("t"))
    mean = (F.col("sr") + F.col("sc")) / 2
    lt = F.log("t")
    mi = F.col("h") / F.col("t") - F.col("hr") / F.col("t") - F.col("hc") / F.col("t") + lt
    h1, h2 = lt - F.col("hr") / F.col("t"), lt - F.col("hc") / F.col("t")
    union = F.col("sr") + F.col("sc") - F.col("s")
    return one.select(
        F.when(F.abs(mean - exp_) < 1e-12, 0.0).otherwise((F.col("s") - exp_) / (mean - exp_)).alias("ari"),
        F.when(h1 + h2 < 1e-12, 0.0).otherwise(2 * mi / (h1 + h2)).alias("nmi"),
        F.when(union == 0, 1.0).otherwise(F.col("s") / union).alias("jaccard"),
        (F.col("top") / F.col("t")).alias("purity"),
    )


def compare_clusterings(d1: DataFrame, d2: DataFrame, k: int | None = None, linkage: str = "ward.D2") -> tuple[DataFrame, DataFrame]:
    """(agreement, contingency) of two distance tables, each cut in k classes (the root of n, two at least)."""
    if k is None:
        k = max(2, math.isqrt(d1.select("i").union(d1.select("j")).distinct().count()))
    a, b = labels(agglomerate(d1, linkage), k), labels(agglomerate(d2, linkage), k)
    return agreement(a, b), contingency(a, b)


def silhouette(pairs: DataFrame, part: DataFrame) -> DataFrame:
    """(obj, cluster, width) of pairs of one source and labels: relational, no matrix."""
    both = mirrored(pairs).select(F.col("i").alias("obj"), F.col("j").alias("other"), "d")
    to = part.select(F.col("obj").alias("other"), F.col("cluster").alias("oc"))
    mean = both.join(to, "other").groupBy("obj", "oc").agg(F.avg("d").alias("m"))
    own = part.select("obj", "cluster")
    x = own.join(mean, "obj", "left").groupBy("obj", "cluster").agg(
        F.max(F.when(F.col("oc") == F.col("cluster"), F.col("m"))).alias("a"), F.min(F.when(F.col("oc") != F.col("cluster"), F.col("m"))).alias("b")
    )
    top = F.greatest("a", "b")
    return x.select("obj", "cluster", F.when(F.col("a").isNull() | F.col("b").isNull() | (top == 0), 0.0).otherwise((F.col("b") - F.col("a")) / top).alias("width"))


def select_number(pairs: DataFrame, ks=range(5, 26)) -> DataFrame:
    """(src, k, width, best): mean silhouette of k-medoids for each source and, as src 0, over sources."""
    one = pam(pairs, ks).groupBy("src", "k").agg(F.avg("width").alias("width"))
    mean = one.groupBy("k").agg(F.avg("width").alias("width")).select(F.lit(0).alias("src"), "k", "width")
    every = one.select("src", "k", "width").union(mean)
    best = every.groupBy("src").agg(F.max_by("k", F.struct("width", -F.col("k"))).alias("kb"))
    return every.join(best, "src").select("src", "k", "width", (F.col("k") == F.col("kb")).alias("best"))


def similarity_measure(aligned: DataFrame) -> DataFrame:
    """(method, share): share of objects whose label equals the first method's."""
    first = aligned.groupBy().agg(F.min("method").alias("m0"))
    ref = aligned.join(F.broadcast(first), F.col("method") == F.col("m0")).select("obj", F.col("label").alias("ref"))
    return aligned.join(ref, "obj").groupBy("method").agg(F.avg((F.col("label") == F.col("ref")).cast("double")).alias("share"))


def silhouette_r2(widths: DataFrame, parts: DataFrame) -> DataFrame:
    """(src, by, r2): R squared of source src's widths on source by's class numbers, all ordered pairs."""
    w = widths.select(F.col("src").alias("src"), "obj", "width")
    p = parts.select(F.col("src").alias("by"), "obj", F.col("cluster").cast("double").alias("c"))
    return w.join(p, "obj").groupBy("src", "by").agg(F.expr("regr_r2(width, c)").alias("r2"))


def _in_tasks(pairs: DataFrame, settings: list) -> tuple[DataFrame, list[list]]:
    """pairs once for each of TASKS tasks at most, and the settings that each of them tries."""
    groups = [settings[n::TASKS] for n in range(min(TASKS, len(settings)))]
    return pairs.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(groups) - 1))).alias("task")), groups


def _shuffled(per: dict[int, np.ndarray], boot: int) -> dict[int, np.ndarray]:
    """The sources' matrices, the first one's objects permuted; boot 0 leaves them."""
    if not boot:
        return per
    first = min(per)
    o = np.random.default_rng(boot).permutation(len(per[first]))
    return {**per, first: per[first][np.ix_(o, o)]}


def _r2(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.corrcoef(a, b)[0, 1] ** 2) if a.std() > 0 and b.std() > 0 else 0.0


def _k_of(k: int | dict[int, int], src: int) -> int:
    return k[src] if isinstance(k, dict) else k


def compare_silhouettes(pairs: DataFrame, k: int | dict[int, int], boots: int = 100) -> DataFrame:
    """(statistic, p): how much better silhouettes follow the own source's classes, against permutations of the first source.

    p counts permutations whose statistic is not larger, plus one, as the definition has it.
    """
    tasks, groups = _in_tasks(pairs, list(range(boots + 1)))

    def run(key, pdf):
        per = {int(s): dense(g)[0] for s, g in pdf.groupby("src")}
        out = []
        for boot in groups[int(key[0])]:
            now = _shuffled(per, boot)
            y = {s: K.pam(d, _k_of(k, s)) for s, d in now.items()}
            w = {s: K.silhouette(d, y[s]) for s, d in now.items()}
            own = sum(_r2(w[s], y[s]) for s in now)
            off = sum(_r2(w[s], y[t]) for s in now for t in now if s != t)
            out.append((boot, abs(own - off)))
        return pd.DataFrame(out, columns=["boot", "statistic"])

    got = tasks.groupBy("task").applyInPandas(run, "boot int, statistic double")
    obs = got.where("boot = 0").select(F.col("statistic").alias("observed"))
    null = got.where("boot > 0")
    return null.crossJoin(F.broadcast(obs)).agg(F.first("observed").alias("statistic"), ((F.sum((F.col("statistic") <= F.col("observed")).cast("int")) + 1) / (F.count("*") + 1)).alias("p"))


def weight_by_silhouette(pairs: DataFrame, k: int | dict[int, int], weights=None, boots: int = 10) -> DataFrame:
    """(weight, statistic, p, best): |n R2(own) - sum R2(sources)| of each weighted combination; the smallest wins.

    weight is the first source's share, the others divide the rest.  Sources are cut at k (a number or
    one for each), combinations at the mean of them, rounded up.  p: the share of `boots` permutations
    of the first source (and the data themselves) whose statistic is not larger.
    """
    weights = [round(x * 0.01, 2) for x in range(101)] if weights is None else [float(w) for w in weights]
    tasks, groups = _in_tasks(pairs, weights)

    def run(key, pdf):
        per = {int(s): dense(g)[0] for s, g in pdf.groupby("src")}
        srcs, stats = sorted(per), {w: [] for w in groups[int(key[0])]}
        together = math.ceil(sum(_k_of(k, s) for s in srcs) / len(srcs))
        for boot in range(boots + 1):
            now = _shuffled(per, boot)
            own = [K.pam(now[s], _k_of(k, s)) for s in srcs]
            for w in stats:
                share = [w, *([(1 - w) / max(len(srcs) - 1, 1)] * (len(srcs) - 1))]
                d = sum(a * now[s] for a, s in zip(share, srcs, strict=True))
                y = K.pam(d, together)
                width = K.silhouette(d, y)
                stats[w].append(abs(len(srcs) * _r2(width, y) - sum(_r2(width, c) for c in own)))
        return pd.DataFrame([(w, v[0], (1 + sum(x <= v[0] for x in v[1:])) / (boots + 1)) for w, v in stats.items()], columns=["weight", "statistic", "p"])

    got = tasks.groupBy("task").applyInPandas(run, "weight double, statistic double, p double")
    best = got.agg(F.min_by("weight", F.struct("statistic", "weight")).alias("wb"))
    return got.crossJoin(F.broadcast(best)).select("weight", "statistic", "p", (F.col("weight") == F.col("wb")).alias("best"))


def pair_jaccard(parts: DataFrame, reference: DataFrame, by: str) -> DataFrame:
    """(by, src, jaccard): pair Jaccard of each partition in parts(by, obj, cluster) with each source of reference(src, obj, cluster)."""
    x = parts.select(by, "obj", F.col("cluster").alias("a")).join(reference.select("src", "obj", F.col("cluster").alias("b")), "obj")
    c = x.groupBy(by, "src", "a", "b").agg(F.count("*").cast("double").alias("cnt"))
    pr = lambda v: v * (v - 1) / 2
    s = c.groupBy(by, "src").agg(F.sum(pr(F.col("cnt"))).alias("s"))
    r = c.groupBy(by, "src", "a").agg(F.sum("cnt").alias("cnt")).groupBy(by, "src").agg(F.sum(pr(F.col("cnt"))).alias("r"))
    k = c.groupBy(by, "src", "b").agg(F.sum("cnt").alias("cnt")).groupBy(by, "src").agg(F.sum(pr(F.col("cnt"))).alias("k"))
    union = F.col("r") + F.col("k") - F.col("s")
    return s.join(r, [by, "src"]).join(k, [by, "src"]).select(by, "src", F.when(union == 0, 1.0).otherwise(F.col("s") / union).alias("jaccard"))


def weight_by_similarity(pairs: DataFrame, k: int, weights=None, linkage: str = "ward") -> DataFrame:
    """(weight, distance, best): Jaccard of the weighted tree's cut with each source's; the weight whose ratios are nearest to 1 wins."""
    weights = [round(x * 0.01, 2) for x in range(101)] if weights is None else list(weights)
    pairs = cut_lineage(pairs)
    srcs = sorted(r.src for r in pairs.select("src").distinct().collect())  # one row for each source
    own = labels(agglomerate(pairs, linkage), k)
    tasks, groups = _in_tasks(pairs, list(enumerate(weights)))

    def run(key, pdf):
        per = {int(s): dense(g) for s, g in pdf.groupby("src")}
        objs, out = per[srcs[0]][1], []
        for n, w in groups[int(key[0])]:
            d = sum((w if s == srcs[0] else (1 - w) / (len(srcs) - 1)) * per[s][0] for s in srcs)
            y = K.cut(K.linkage(d, linkage)[0], len(objs), k)
            out.append(pd.DataFrame({"n": n, "obj": objs, "cluster": y.astype("int32")}))
        return pd.concat(out)

    cut = tasks.groupBy("task").applyInPandas(run, "n int, obj string, cluster int")
    names = F.create_map(*[F.lit(x) for n, w in enumerate(weights) for x in (n, float(w))])
    j = pair_jaccard(cut, own, "n").withColumn("weight", F.element_at(names, F.col("n")))
    x = j.groupBy("weight").pivot("src", srcs).agg(F.first("jaccard"))
    dist = None
    for p in range(len(srcs)):
        for q in range(p + 1, len(srcs)):
            term = F.abs(F.col(f"`{srcs[p]}`") / F.col(f"`{srcs[q]}`") - 1)
            dist = term if dist is None else dist + term
    got = x.select("weight", dist.alias("distance"))
    best = got.agg(F.min_by("weight", F.struct("distance", "weight")).alias("wb"))
    return got.crossJoin(F.broadcast(best)).select("weight", "distance", (F.col("weight") == F.col("wb")).alias("best"))


def gap_statistic(cells: DataFrame, most: int = 15, boots: int = 20, linkage: str = "ward", measure: str = "l2", seed: int = 1) -> DataFrame:
    """(src, k, gap, se, best): within-dispersion against uniform references over the features' ranges, one task for each source and reference.

    best is the first k whose gap is within one standard error of the first local maximum.
    """
    from .distance import kernel

    tasks, groups = _in_tasks(cells, list(range(boots + 1)))

    def run(key, pdf):
        own = pdf.pivot(index="obj", columns="feat", values="val").sort_index().to_numpy(float)
        out = []
        for boot in groups[int(key[1])]:
            m = own
            if boot:
                m = own.min(0) + np.random.default_rng(seed * 1000 + boot).random(own.shape) * (own.max(0) - own.min(0))
            d = kernel(m, m, measure)
            tree, _ = K.linkage(d, linkage)
            for k in range(1, min(most, len(m)) + 1):
                y = K.cut(tree, len(m), k)
                w = sum(d[np.ix_(y == c, y == c)].sum() / (2 * (y == c).sum()) for c in np.unique(y))
                out.append((int(key[0]), boot, k, float(np.log(max(w, 1e-300)))))
        return pd.DataFrame(out, columns=["src", "boot", "k", "w"])

    w = tasks.groupBy("src", "task").applyInPandas(run, "src int, boot int, k int, w double")
    own = w.where("boot = 0").select("src", "k", F.col("w").alias("w0"))
    ref = w.where("boot > 0").groupBy("src", "k").agg(F.avg("w").alias("m"), (F.stddev_pop("w") * math.sqrt(1 + 1 / boots)).alias("se"))
    g = own.join(ref, ["src", "k"]).select("src", "k", (F.col("m") - F.col("w0")).alias("gap"), "se")

    def pick(key, pdf):
        pdf = pdf.sort_values("k").reset_index(drop=True)
        gap, se = pdf.gap.to_numpy(), pdf.se.to_numpy()
        top = next((i for i in range(len(gap) - 1) if gap[i + 1] <= gap[i]), len(gap) - 1)
        best = next(i for i in range(top + 1) if gap[i] >= gap[top] - se[top])
        return pdf.assign(best=[i == best for i in range(len(pdf))])

    return g.groupBy("src").applyInPandas(pick, "src int, k int, gap double, se double, best boolean")
