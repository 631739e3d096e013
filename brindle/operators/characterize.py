"""What marks clusters: exact tests on binary features, Welch tests on continuous ones, shared features; genes and pathways."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import fisher_two_sided, t_two_sided
from ..functions.stats import uniform
from .distance import meet_blocks


def _fisher(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    memo: dict = {}
    out = []
    for t in zip(a, b, c, d, strict=True):
        if t not in memo:
            memo[t] = fisher_two_sided(*map(int, t))
        out.append(memo[t])
    return pd.Series(out, dtype="float64")


def _tp(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(float(x), float(n)) if x == x and n == n else None for x, n in zip(t, df, strict=True)], dtype="float64")


def fisher_p(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.pandas_udf(_fisher, "double")(a, b, c, d)


def t_p(t: Column, df: Column) -> Column:
    return F.pandas_udf(_tp, "double")(t, df)


def bh(tests: DataFrame, *by: str, p: str = "p", out: str = "adj_p") -> DataFrame:
    """Benjamini-Hochberg: running minimum of p * m / rank from the largest p down, 1 at most; p ties to twelve places."""
    up = Window.partitionBy(*by).orderBy(F.round(p, 12).asc(), *[c for c in tests.columns if c not in (*by, p)])
    x = tests.withColumn("_r", F.row_number().over(up)).withColumn("_m", F.count(p).over(Window.partitionBy(*by)))
    down = Window.partitionBy(*by).orderBy(F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn(out, F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_r")).over(down))).drop("_r", "_m")


def binary_tables(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(grp, feat, n11, n10, n01, n00) for groups(grp, obj): inside and outside, with and without; constant features are left out."""
    n = cells.select("obj").distinct().agg(F.count("*").alias("n"))
    tot = cells.groupBy("feat").agg(F.sum("val").cast("long").alias("t"), F.countDistinct("val").alias("v")).where("v > 1")
    size = groups.groupBy("grp").agg(F.count("*").alias("g"))
    hit = cells.join(groups, "obj").groupBy("grp", "feat").agg(F.sum("val").cast("long").alias("n11"))
    x = hit.join(tot, "feat").join(size, "grp").crossJoin(F.broadcast(n))
    return x.select("grp", "feat", "n11", (F.col("g") - F.col("n11")).alias("n10"), (F.col("t") - F.col("n11")).alias("n01"), (F.col("n") - F.col("g") - F.col("t") + F.col("n11")).alias("n00"))


def welch(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(grp, feat, t, df, diff): members against all others, unequal variances, from sums alone."""
    all_ = cells.groupBy("feat").agg(F.count("*").alias("n"), F.sum("val").alias("s"), F.sum(F.col("val") * F.col("val")).alias("q"))
    own = cells.join(groups, "obj").groupBy("grp", "feat").agg(F.count("*").alias("n1"), F.sum("val").alias("s1"), F.sum(F.col("val") * F.col("val")).alias("q1"))
    x = own.join(all_, "feat").withColumn("n2", F.col("n") - F.col("n1"))
    m1, m2 = F.col("s1") / F.col("n1"), (F.col("s") - F.col("s1")) / F.col("n2")
    v1 = (F.col("q1") - F.col("n1") * m1 * m1) / (F.col("n1") - 1)
    v2 = (F.col("q") - F.col("q1") - F.col("n2") * m2 * m2) / (F.col("n2") - 1)
    x = x.where("n1 > 1 and n2 > 1").select("grp", "feat", "n1", "n2", m1.alias("m1"), m2.alias("m2"), (v1 / F.col("n1")).alias("e1"), (v2 / F.col("n2")).alias("e2"))
    se = F.col("e1") + F.col("e2")
    return x.where(se > 1e-12).select(
        "grp", "feat", ((F.col("m1") - F.col("m2")) / F.sqrt(se)).alias("t"),
        (se * se / (F.col("e1") ** 2 / (F.col("n1") - 1) + F.col("e2") ** 2 / (F.col("n2") - 1))).alias("df"), (F.col("m1") - F.col("m2")).alias("diff"),
    )


def characteristic_features(groups: DataFrame, binary: DataFrame | None = None, continuous: DataFrame | None = None, sign: float = 0.05, top: int | None = None) -> DataFrame:
    """(grp, kind, feat, p, adj_p), the `top` first or all with adj_p < sign, for each group and kind."""
    parts = []
    if binary is not None:
        t = binary_tables(binary, groups)
        parts.append(t.select("grp", F.lit("binary").alias("kind"), "feat", fisher_p(F.col("n11"), F.col("n10"), F.col("n01"), F.col("n00")).alias("p")))
    if continuous is not None:
        parts.append(welch(continuous, groups).select("grp", F.lit("continuous").alias("kind"), "feat", t_p(F.col("t"), F.col("df")).alias("p")))
    if not parts:
        raise ValueError("give binary or continuous cells")
    x = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    adj = bh(x, "grp", "kind")
    if top is None:
        return adj.where(F.col("adj_p") < sign)
    w = Window.partitionBy("grp", "kind").orderBy(F.round("p", 12), "feat")
    return adj.withColumn("n", F.row_number().over(w)).where(F.col("n") <= top).drop("n")


def feature_selection(selection: DataFrame, binary: DataFrame | None = None, continuous: DataFrame | None = None, sign: float = 0.05, top: int | None = None) -> DataFrame:
    """The same for one set of objects (obj); a single object gives its present features, most common first."""
    names = selection.select("obj").distinct()
    if len(names.head(2)) == 1 and binary is not None:
        has = binary.join(names, "obj").where("val > 0").select("feat")
        share = binary.groupBy("feat").agg(F.avg("val").alias("prevalence"))
        return has.join(share, "feat").orderBy(F.desc("prevalence"), "feat")
    return characteristic_features(names.select(F.lit(1).alias("grp"), "obj"), binary, continuous, sign, top)


def choose_cluster(part: DataFrame, cluster: int, binary=None, continuous=None, expression: DataFrame | None = None, top: int = 20, sign: float = 0.05) -> dict[str, DataFrame]:
    """Features and genes of one cluster of labels(obj, cluster), the choice given instead of clicked."""
    sel = part.where(F.col("cluster") == cluster).select("obj")
    out = {"objects": sel}
    if binary is not None or continuous is not None:
        out["features"] = feature_selection(sel, binary, continuous, sign, top)
    if expression is not None:
        out["genes"] = diff_genes(expression, sel.select(F.lit(1).alias("grp"), "obj"), top=top, sign=sign)
    return out


def features_of_cluster(cells: DataFrame, leads: DataFrame, threshold: int = 1) -> tuple[DataFrame, DataFrame]:
    """(features present in `threshold` leads or more with their counts, shared counts of lead pairs)."""
    n = leads.select("obj").distinct().count()
    if threshold > n:
        raise ValueError("the threshold exceeds the number of leads")
    has = cells.join(leads.select("obj").distinct(), "obj", "left_semi").where("val > 0").select("obj", "feat")
    present = has.groupBy("feat").agg(F.count("*").alias("n")).where(F.col("n") >= threshold)
    packed = has.groupBy("obj").agg(F.collect_list("feat").alias("x")).select(F.lit(1).alias("src"), "obj", "x")

    def shared(a, b):
        codes = pa.chunked_array([a.flatten(), b.flatten()]).dictionary_encode().unify_dictionaries()
        table = [np.zeros((len(s), len(codes.chunk(0).dictionary)), np.float32) for s in (a, b)]
        for m, s, c in zip(table, (a, b), codes.chunks, strict=True):
            np.add.at(m, (np.repeat(np.arange(len(s)), np.diff(np.asarray(s.offsets))), np.asarray(c.indices)), 1)
        n = table[0] @ table[1].T
        return [n.astype(np.int64), n > 0]

    pairs = meet_blocks(packed, shared, "n long", keep=True, own=True).select("i", "j", "n")
    return present, pairs


# Genes: expr(gene, obj, val).


def two_group(expr: DataFrame, groups: DataFrame) -> DataFrame:
    """(grp, gene, diff, s2, df, u): difference of means, pooled variance, its degrees of freedom and 1/n1 + 1/n2."""
    x = welch_sums(expr, groups)
    ss = F.col("q") - F.col("n1") * F.col("m1") ** 2 - F.col("n2") * F.col("m2") ** 2
    df = F.col("n1") + F.col("n2") - 2
    return x.select("grp", "gene", (F.col("m1") - F.col("m2")).alias("diff"), (F.greatest(ss, F.lit(0.0)) / df).alias("s2"), df.cast("double").alias("df"), (1 / F.col("n1") + 1 / F.col("n2")).alias("u"))


def welch_sums(expr: DataFrame, groups: DataFrame) -> DataFrame:
    all_ = expr.groupBy("gene").agg(F.count("*").alias("n"), F.sum("val").alias("s"), F.sum(F.col("val") * F.col("val")).alias("q"))
    own = expr.join(groups, "obj").groupBy("grp", "gene").agg(F.count("*").alias("n1"), F.sum("val").alias("s1"))
    x = own.join(all_, "gene").withColumn("n2", F.col("n") - F.col("n1")).where("n1 > 0 and n2 > 0 and n1 + n2 > 2")
    return x.select("grp", "gene", "n1", "n2", "q", (F.col("s1") / F.col("n1")).alias("m1"), ((F.col("s") - F.col("s1")) / F.col("n2")).alias("m2"))


def _prior(pdf: pd.DataFrame) -> tuple[float, float]:
    """Empirical-Bayes prior degrees of freedom and variance from the spread of log variances."""
    import numpy as np

    s2, d = pdf["s2"].to_numpy(float), pdf["df"].to_numpy(float) / 2
    s2, d = s2[s2 > 0], d[s2 > 0]
    if len(s2) < 2:
        return 0.0, float(s2.mean()) if len(s2) else 1.0

    def digamma(x):
        out = 0.0
        while x < 6:
            out -= 1 / x
            x += 1
        f = 1 / (x * x)
        return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f / 252))

    def trigamma(x):
        out = 0.0
        while x < 6:
            out += 1 / (x * x)
            x += 1
        f = 1 / (x * x)
        return out + 1 / x + f / 2 + f / x * (1 / 6 - f * (1 / 30 - f / 42))

    e = np.log(s2) - np.array([digamma(x) for x in d]) + np.log(d)
    spread = e.var(ddof=1) - float(np.mean([trigamma(x) for x in d]))
    if spread <= 0:
        return float("inf"), float(np.exp(e.mean()))
    lo, hi = 1e-6, 1e6
    for _ in range(200):
        mid = (lo * hi) ** 0.5
        lo, hi = (mid, hi) if trigamma(mid) > spread else (lo, mid)
    return 2 * lo, float(np.exp(e.mean() + digamma(lo) - np.log(lo)))


def diff_genes(expr: DataFrame, groups: DataFrame, top: int | None = None, sign: float = 0.05) -> DataFrame:
    """(grp, gene, diff, t, p, adj_p): moderated two-group t-tests with the variances shrunk to a common prior; top first or adj_p <= sign."""
    x = two_group(expr, groups)

    def run(key, pdf):
        d0, s0 = _prior(pdf)
        post = pdf["s2"] if d0 == 0 else (s0 + 0 * pdf["s2"] if d0 == float("inf") else (d0 * s0 + pdf["df"] * pdf["s2"]) / (d0 + pdf["df"]))
        t = pdf["diff"] / (post * pdf["u"]).clip(lower=1e-300) ** 0.5
        df = pdf["df"] + (1e9 if d0 == float("inf") else d0)
        p = [t_two_sided(float(a), float(b)) for a, b in zip(t, df, strict=True)]
        return pd.DataFrame({"grp": pdf["grp"], "gene": pdf["gene"], "diff": pdf["diff"], "t": t, "p": p})

    got = bh(x.groupBy("grp").applyInPandas(run, "grp int, gene string, diff double, t double, p double"), "grp")
    if top is None:
        return got.where(F.col("adj_p") <= sign)
    w = Window.partitionBy("grp").orderBy(F.round("p", 12), "gene")
    return got.withColumn("n", F.row_number().over(w)).where(F.col("n") <= top).drop("n")


def diff_genes_selection(expr: DataFrame, selection: DataFrame, **options) -> DataFrame:
    return diff_genes(expr, selection.select(F.lit(1).alias("grp"), "obj").distinct(), **options)


def find_genes(tests: DataFrame) -> DataFrame:
    """(gene, cluster, methods, again): tests(method, cluster, gene) by gene at its first cluster; later clusters give suffixes _m."""
    w = Window.partitionBy("gene")
    x = tests.select("method", "cluster", "gene").distinct().withColumn("first", F.min("cluster").over(w))
    name = F.when(F.col("cluster") == F.col("first"), F.col("method").cast("string")).otherwise(F.concat_ws("_", F.col("method").cast("string"), F.col("cluster").cast("string")))
    return x.groupBy("gene", F.col("first").alias("cluster")).agg(F.array_join(F.array_sort(F.collect_set(name)), ",").alias("methods"), F.countDistinct("cluster").alias("n_clusters"))


def prepare_pathway(tests: DataFrame) -> DataFrame:
    """(grp, gene, p) of differential tests."""
    return tests.select("grp", "gene", "p")


def pathways(scores: DataFrame, sets: DataFrame, iters: int = 1, permutations: int = 100, least: int = 5, most: int = 100, seed: int = 1) -> DataFrame:
    """(grp, iter, set, size, stat, p): mean of -log10 p over a gene set of bounded size, against permuted genes.

    Permutations are fan-out rows: gene scores are dealt anew by hash in each.
    """
    s = scores.select("grp", "gene", (-F.log10(F.greatest("p", F.lit(1e-300)))).alias("v"))
    use = sets.join(s.select("gene").distinct(), "gene", "left_semi")
    sized = use.groupBy("set").agg(F.countDistinct("gene").alias("size")).where((F.col("size") >= least) & (F.col("size") <= most))
    use = use.join(sized, "set").select("set", "gene", "size").distinct()
    obs = use.join(s, "gene").groupBy("grp", "set", "size").agg(F.avg("v").alias("stat"))
    runs = F.explode(F.sequence(F.lit(1), F.lit(iters * permutations)))
    w1 = Window.partitionBy("grp", "run").orderBy(uniform(seed, F.col("grp"), F.col("run"), F.col("gene")), "gene")
    dealt = s.select("grp", "gene", "v", runs.alias("run"))
    place = dealt.withColumn("n", F.row_number().over(w1)).select("grp", "run", "n", "v")
    own = s.withColumn("n", F.row_number().over(Window.partitionBy("grp").orderBy("gene"))).select("grp", "gene", "n")
    perm = own.join(place, ["grp", "n"]).select("grp", "run", "gene", "v")
    null = use.join(perm, "gene").groupBy("grp", "set", "run").agg(F.avg("v").alias("null"))
    x = null.join(obs, ["grp", "set"]).withColumn("iter", (F.floor((F.col("run") - 1) / permutations) + 1).cast("int"))
    return x.groupBy("grp", "iter", "set", "size", "stat").agg(((F.sum((F.round("null", 9) >= F.round("stat", 9)).cast("int")) + 1) / (F.count("*") + 1)).alias("p"))


def pathways_selection(expr: DataFrame, selection: DataFrame, sets: DataFrame, **options) -> DataFrame:
    return pathways(prepare_pathway(diff_genes_selection(expr, selection, sign=2.0)), sets, **options)


def pathways_iter(scores: DataFrame, sets: DataFrame, iters: int = 10, **options) -> DataFrame:
    return pathways(scores, sets, iters=iters, **options)


def geneset_intersect(found: DataFrame, sign: float = 0.05) -> DataFrame:
    """(grp, set, size, stat, p): sets with p <= sign in every iteration, with their means."""
    n = found.select("grp", "iter").distinct().groupBy("grp").agg(F.count("*").alias("iters"))
    hit = found.where(F.col("p") <= sign).groupBy("grp", "set", "size").agg(F.count("*").alias("k"), F.avg("stat").alias("stat"), F.avg("p").alias("p"))
    return hit.join(F.broadcast(n), "grp").where("k = iters").select("grp", "set", "size", "stat", "p")


def pathway_analysis(expr: DataFrame, groups: DataFrame, sets: DataFrame, iters: int = 10, sign: float = 0.05, **options) -> DataFrame:
    """Differential tests, repeated enrichment, and the sets that hold in all iterations."""
    return geneset_intersect(pathways_iter(prepare_pathway(diff_genes(expr, groups, sign=2.0)), sets, iters=iters, **options), sign)


def shared_items(tests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """tests(method, cluster, kind, item, p): (counts by method, items found by all methods with each method's p and their mean)."""
    counts = tests.groupBy("method", "cluster", "kind").agg(F.countDistinct("item").alias("n"))
    n = tests.select("method").distinct().count()
    both = tests.groupBy("cluster", "kind", "item").agg(
        F.countDistinct("method").alias("m"), F.avg("p").alias("mean_p"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("method", F.round("p", 6).alias("p")))), lambda x: F.concat_ws("=", x["method"].cast("string"), x["p"].cast("string"))), ",").alias("p_by_method")
    )
    return counts, both.where(F.col("m") == n).drop("m")


def shared_selection(tests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same for selections, which are one cluster."""
    return shared_items(tests.withColumn("cluster", F.lit(1)))


def shared_selection_genes(tests: DataFrame) -> tuple[DataFrame, DataFrame]:
    return shared_selection(tests.where("kind = 'gene'"))


def shared_selection_paths(tests: DataFrame) -> tuple[DataFrame, DataFrame]:
    return shared_selection(tests.where("kind in ('gene', 'path')"))
