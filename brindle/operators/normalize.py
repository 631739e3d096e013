"""Normalisation of cells, each source by itself; the first letter of the method selects it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import qnorm


def standardize(cells: DataFrame) -> DataFrame:
    """(x - mean) / sd of each feature, sd with n - 1; a constant feature gives null."""
    w = Window.partitionBy("src", "feat")
    sd = F.stddev_samp("val").over(w)
    return cells.withColumn("val", F.when(sd > 0, (F.col("val") - F.avg("val").over(w)) / sd))


def to_range(cells: DataFrame) -> DataFrame:
    """(x - min) / (max - min) over the whole source, not by feature."""
    ends = cells.groupBy("src").agg(F.min("val").alias("lo"), F.max("val").alias("hi"))  # one row for each source
    span = F.col("hi") - F.col("lo")
    return cells.join(F.broadcast(ends), "src").select("src", "obj", "feat", F.when(span > 0, (F.col("val") - F.col("lo")) / span).alias("val"))


def column_minmax(cells: DataFrame) -> DataFrame:
    """Each feature to [0, 1]; a constant feature keeps span 1, what is not finite becomes 0."""
    w = Window.partitionBy("src", "feat")
    lo, hi = F.min("val").over(w), F.max("val").over(w)
    v = (F.col("val") - lo) / F.when(hi > lo, hi - lo).otherwise(1.0)
    return cells.withColumn("val", F.when(v.isNull() | F.isnan(v), 0.0).otherwise(v))


def _ranked(cells: DataFrame) -> DataFrame:
    """Adds r (rank with ties by object), q (average rank) and n, by feature."""
    w = Window.partitionBy("src", "feat")
    ties = Window.partitionBy("src", "feat", "val")
    r = F.row_number().over(w.orderBy("val", "obj"))
    one = cells.withColumn("r", r).withColumn("n", F.count("*").over(w))
    return one.withColumn("q", F.avg("r").over(ties))


def _interpolated(ranked: DataFrame, target: DataFrame) -> DataFrame:
    """Value of target(src, r, t) at the average rank, linear between ranks."""
    lo = target.select("src", F.col("r").alias("rl"), F.col("t").alias("tl"))
    hi = target.select("src", F.col("r").alias("rh"), F.col("t").alias("th"))
    x = ranked.withColumn("rl", F.floor("q").cast("int")).withColumn("rh", F.ceil("q").cast("int"))
    x = x.join(lo, ["src", "rl"]).join(hi, ["src", "rh"])
    return x.select("src", "obj", "feat", (F.col("tl") + (F.col("q") - F.col("rl")) * (F.col("th") - F.col("tl"))).alias("val"))


def quantile(cells: DataFrame) -> DataFrame:
    """Features take the median of the sorted features, at the average rank of ties."""
    ranked = _ranked(cells)
    target = ranked.groupBy("src", "r").agg(F.expr("percentile(val, 0.5)").alias("t"))
    return _interpolated(ranked, target)


def fisher_yates(cells: DataFrame) -> DataFrame:
    """Features take normal scores qnorm(r / (n + 1)), at the average rank of ties."""
    ranked = _ranked(cells)
    target = ranked.select("src", "r", "n").distinct().withColumn("t", qnorm("(r / (n + 1.0D))")).select("src", "r", "t")
    return _interpolated(ranked, target)


METHODS = {"s": standardize, "r": to_range, "q": quantile, "f": fisher_yates}


def normalization(cells: DataFrame, method: str | bool | None) -> DataFrame:
    """method: Standardize, Range, Quantile or Fisher-Yates, by first letter; None and False leave cells as they are."""
    if method is None or method is False:
        return cells
    key = str(method)[:1].lower()
    if key not in METHODS:
        raise ValueError(f"unknown normalisation {method!r}")
    return METHODS[key](cells)


def range_guard(pairs: DataFrame, stop: bool = False) -> DataFrame:
    """Distances outside [0, 1] to the range of the whole matrix, whose diagonal counts as 0; stop leaves them."""
    if stop:
        return pairs
    ends = pairs.groupBy("src").agg(F.least(F.min("d"), F.lit(0.0)).alias("lo"), F.greatest(F.max("d"), F.lit(0.0)).alias("hi"))
    out = (F.col("lo") < 0) | (F.col("hi") > 1)
    scaled = (F.col("d") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    return pairs.join(F.broadcast(ends), "src").select("src", "i", "j", F.when(out, scaled).otherwise(F.col("d")).alias("d"))
