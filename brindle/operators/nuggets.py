"""Data nuggets: a large source as a bounded number of weighted centres, by distributed k-means.

nuggets(nid, feat, center, scale, weight) in long form and membership(obj, nid).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import pack
from . import kernels as K
from .normalize import standardize


def default_nuggets(n: int) -> int:
    return max(2, n // 10) if n > 50 else n


def create_nuggets(cells: DataFrame, max_nuggets: int | None = None, min_size: int = 1, scale_features: bool = True, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(nuggets, membership) of one source; missing values take the feature's mean; few objects are their own nuggets."""
    mean = cells.groupBy("feat").agg(F.avg("val").alias("m"))
    cells = cells.join(mean, "feat").select("src", "obj", "feat", F.coalesce(F.when(~F.isnan("val"), F.col("val")), F.col("m"), F.lit(0.0)).alias("val"))
    n = cells.select("obj").distinct().count()
    m = max_nuggets or default_nuggets(n)
    if n <= m:
        member = cells.select("obj").distinct().select("obj", F.col("obj").alias("nid"))
    else:
        x = pack(standardize(cells).fillna(0.0, ["val"]) if scale_features else cells).select("obj", array_to_vector("x").alias("features"))
        model = KMeans(k=m, seed=seed, maxIter=20, initSteps=2).fit(x)
        member = model.transform(x).select("obj", F.col("prediction").cast("string").alias("nid"))
        if min_size > 1:
            member = absorb_small(cells, member, min_size)
    return summarise(cells, member), member


def summarise(cells: DataFrame, member: DataFrame) -> DataFrame:
    """Centre, variance (0 for single objects) and weight of each nugget, on the original scale."""
    return cells.join(member, "obj").groupBy("src", "nid", "feat").agg(F.avg("val").alias("center"), F.coalesce(F.var_samp("val"), F.lit(0.0)).alias("scale"), F.count("*").alias("weight"))


def absorb_small(cells: DataFrame, member: DataFrame, min_size: int) -> DataFrame:
    """Objects of nuggets below min_size move to the nearest surviving centre."""
    size = member.groupBy("nid").agg(F.count("*").alias("n"))
    big = size.where(F.col("n") >= min_size).select("nid")
    if not big.head(1):
        return member
    centre = summarise(cells, member).join(big, "nid").select("feat", F.col("nid").alias("to"), "center")
    small = member.join(big, "nid", "left_anti")
    d = cells.join(small, "obj").join(centre, "feat").groupBy("obj", "to").agg(F.sum((F.col("val") - F.col("center")) ** 2).alias("d"))
    near = d.groupBy("obj").agg(F.min_by("to", F.struct("d", "to")).alias("nid"))
    return member.join(big, "nid").select("obj", "nid").union(near.select("obj", "nid"))


def feature_weights(nuggets: DataFrame, membership: DataFrame | None = None, kind: str = "between") -> DataFrame:
    """(src, feat, score): weighted variance between nuggets, its share of all variance, or the inverse of the variance within."""
    if kind not in ("between", "ratio", "inv_scale"):
        raise ValueError("kind is between, ratio or inv_scale")
    eps = 2.220446049250313e-16
    w = F.col("weight").cast("double")
    mean = nuggets.groupBy("src", "feat").agg((F.sum(w * F.col("center")) / F.sum(w)).alias("c"))
    x = nuggets.join(mean, ["src", "feat"]).groupBy("src", "feat").agg((F.sum(w * (F.col("center") - F.col("c")) ** 2) / F.sum(w)).alias("b"), (F.sum(w * F.col("scale")) / F.sum(w)).alias("s"))
    score = {"between": F.col("b"), "ratio": F.col("b") / (F.col("b") + F.col("s") + eps), "inv_scale": 1 / (F.col("s") + eps)}[kind]
    return x.select("src", "feat", F.coalesce(F.when(~F.isnan(score), score), F.lit(0.0)).alias("score"))


def summary(nuggets: DataFrame) -> DataFrame:
    """One row: objects, nuggets, reduction in percent, smallest and largest weight."""
    w = nuggets.select("nid", "weight").distinct()
    return w.agg(F.sum("weight").alias("n_objects"), F.count("*").alias("n_nuggets"), (100 * (1 - F.count("*") / F.sum("weight"))).alias("reduction"), F.min("weight").alias("least"), F.max("weight").alias("most"))


def from_engine(centers: np.ndarray, weights: np.ndarray, scales: np.ndarray, features, spark, src: int = 1) -> DataFrame:
    """Nuggets made elsewhere, in this layout."""
    rows = [(src, str(i), str(f), float(centers[i, j]), float(scales[i] if np.ndim(scales) == 1 else scales[i, j]), int(weights[i])) for i in range(len(centers)) for j, f in enumerate(features)]
    return spark.createDataFrame(rows, "src int, nid string, feat string, center double, scale double, weight long")


def cluster_nuggets(nuggets: DataFrame, k: int, method: str = "kmeans", starts: int = 10, seed: int = 1) -> DataFrame:
    """(nid, cluster): weighted k-means or weighted ward on the centres, which are bounded in number."""

    def run(pdf):
        c = pdf.pivot(index="nid", columns="feat", values="center").sort_index()
        w = pdf.groupby("nid")["weight"].first().loc[c.index].to_numpy(float)
        x = c.to_numpy(float)
        y = K.kmeans(x, k, w, starts, seed=seed)[0] if method == "kmeans" else K.cut(K.weighted_ward(x, w)[0], len(x), k)
        return pd.DataFrame({"nid": list(c.index), "cluster": K.by_appearance(y).astype("int32")})

    return nuggets.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(run, "nid string, cluster int")


def weighted_kmeans(points: DataFrame, k: int, starts: int = 10, seed: int = 1) -> DataFrame:
    """points(obj, x array, w) -> (obj, cluster): one grouped task, exact weights."""

    def run(pdf):
        x = np.stack([np.asarray(v, float) for v in pdf.x])
        return pd.DataFrame({"obj": pdf.obj, "cluster": K.by_appearance(K.kmeans(x, k, pdf.w.to_numpy(float), starts, seed=seed)[0]).astype("int32")})

    return points.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(run, "obj string, cluster int")


def weighted_hclust(points: DataFrame) -> DataFrame:
    """points(obj, x array, w) -> tree of weighted ward merges."""
    from .trees import TREE

    def run(pdf):
        pdf = pdf.sort_values("obj")
        m, h = K.weighted_ward(np.stack([np.asarray(v, float) for v in pdf.x]), pdf.w.to_numpy(float))
        return pd.DataFrame([(0, list(pdf.obj), m[:, 0].astype("int32").tolist(), m[:, 1].astype("int32").tolist(), h.tolist())], columns=["src", "objs", "left", "right", "height"])

    return points.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(run, TREE)


def nugget_cluster(cells: DataFrame, k: int, method: str = "kmeans", max_nuggets: int | None = None, **options) -> DataFrame:
    """labels(src, obj, cluster) of one source: compress, cluster the centres, map back by membership."""
    nuggets, member = create_nuggets(cells, max_nuggets, **options)
    return member.join(cluster_nuggets(nuggets, k, method), "nid").select(F.lit(0).alias("src"), "obj", "cluster")
