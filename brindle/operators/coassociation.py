"""Relations between partitions of the same objects: labels(src, obj, cluster), src numbering the partitions.

Counts over pairs come from blocks of packed objects (`pair_counts`); the rest are joins of labels on
(partition, class) and aggregations.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def packed_runs(labels: DataFrame) -> DataFrame:
    """labels(src, run, obj, cluster) -> (src, obj, x): an object's classes with the numbers of their runs."""
    runs = labels.select("src", "run").distinct()
    number = runs.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy("run")) - 1)
    return labels.join(F.broadcast(number), ["src", "run"]).groupBy("src", "obj").agg(F.collect_list(F.struct(F.col("r").cast("int").alias("r"), F.col("cluster").cast("int").alias("c"))).alias("x"))


def run_labels(*sides, runs: int | None = None) -> list[np.ndarray]:
    """Classes by object and run of packed blocks; 0 where a run lacks the object."""
    runs = runs or 1 + max(int(np.asarray(s.flatten().field("r")).max(initial=0)) for s in sides)
    out = []
    for side in sides:
        flat = side.flatten()
        m = np.zeros((len(side), runs), np.int32)
        m[np.repeat(np.arange(len(side)), np.diff(np.asarray(side.offsets))), np.asarray(flat.field("r"))] = np.asarray(flat.field("c"))
        out.append(m)
    return out


def apart(labels: np.ndarray, weights=None) -> np.ndarray:
    """How many runs keep two objects apart, among those that hold both, from classes by object and run (0: none).

    weights: [(a source's runs, its weight)], for the sum of the sources' numbers times their weights.
    """
    from .trees import by_rows

    x = labels.astype(np.int8 if labels.max(initial=0) < 128 else np.int32)
    parts = [(np.ascontiguousarray(x[:, own].T), w) for own, w in weights or [(slice(None), 1)]]

    def count(y: np.ndarray, rows) -> np.ndarray:
        n = np.zeros((len(x[rows]), len(x)), np.int16)
        for run in y:
            n += (run[rows, None] != run[None]) & (run[rows] > 0)[:, None] & (run > 0)[None]
        return n

    return by_rows(len(x), lambda rows: sum(w * count(y, rows) for y, w in parts))


def pair_counts(labels: DataFrame) -> DataFrame:
    """labels(src, run, obj, cluster) -> (src, i, j, together, apart), i < j, for all pairs of a source's objects.

    together and apart count the runs that have both objects, in one class or in two.  Objects travel
    packed, one row with all its labels, and blocks of them meet as in `distance`: no row is made for a
    pair and run.  Runs of a source number a few thousand; their numbers are broadcast.
    """
    from .distance import meet_blocks

    def kernel(a, b) -> list[np.ndarray]:
        x, y = run_labels(a, b)
        both = (x > 0).astype(np.float32) @ (y > 0).astype(np.float32).T
        same = np.zeros(both.shape, np.int64)
        for r in range(x.shape[1]):
            same += (x[:, r][:, None] == y[:, r][None]) & (x[:, r] > 0)[:, None]
        return [same, both.astype(np.int64) - same]

    return meet_blocks(packed_runs(labels), kernel, "together long, apart long")


def coassociation(parts: DataFrame) -> DataFrame:
    """pairs(i, j, s): share of all partitions that hold both in one class; pairs that never meet are left out."""
    n = parts.agg(F.countDistinct("src").alias("n"))
    met = pair_counts(parts.select(F.lit(0).alias("src"), F.col("src").alias("run"), "obj", "cluster")).where("together > 0")
    return met.crossJoin(F.broadcast(n)).select("i", "j", (F.col("together") / F.col("n")).alias("s"))


def all_pairs(parts: DataFrame) -> DataFrame:
    """(i, j) over the objects of all partitions."""
    o = parts.select("obj").distinct()
    return o.select(F.col("obj").alias("i")).join(o.select(F.col("obj").alias("j")), F.col("i") < F.col("j"))


def coassociation_distance(parts: DataFrame) -> DataFrame:
    """pairs(src = 0, i, j, d) with d = 1 - s, pairs that never meet included."""
    s = coassociation(parts)
    return all_pairs(parts).join(s, ["i", "j"], "left").select(F.lit(0).alias("src"), "i", "j", (1 - F.coalesce("s", F.lit(0.0))).alias("d"))


def incidence(parts: DataFrame, keys=("src",)) -> DataFrame:
    """(i, j, n): in how many partitions (by keys) a pair is kept apart, among those that hold both."""
    run = F.concat_ws(":", *[F.col(k).cast("string") for k in keys])
    n = pair_counts(parts.select(F.lit(0).alias("src"), run.alias("run"), "obj", "cluster"))
    return n.where("together + apart > 0").select("i", "j", F.col("apart").alias("n"))


def consensus_over_cuts(cuts: DataFrame) -> DataFrame:
    """pairs(src = 0, i, j, d) from cuts(src, k, obj, cluster): togetherness averaged over k, then over sources."""
    n = pair_counts(cuts.select("src", F.col("k").alias("run"), "obj", "cluster")).where("together + apart > 0")
    x = n.select("src", "i", "j", (F.col("together") / (F.col("together") + F.col("apart"))).alias("s"))
    return x.groupBy("i", "j").agg(F.avg("s").alias("s")).select(F.lit(0).alias("src"), "i", "j", (1 - F.col("s")).alias("d"))


def shared_counts(parts: DataFrame) -> DataFrame:
    """(p, q, w): objects that two classes of different partitions share; classes are named partition:class."""
    name = F.concat_ws(":", F.col("src").cast("string"), F.col("cluster").cast("string"))
    a = parts.select("obj", F.col("src").alias("sa"), name.alias("p"))
    b = parts.select("obj", F.col("src").alias("sb"), name.alias("q"))
    return a.join(b, "obj").where("sa <> sb").groupBy("p", "q").agg(F.count("*").alias("w"))


def cts_classes(parts: DataFrame, decay: float = 0.8) -> DataFrame:
    """(p, q, s): connected triples, sum over k of the smaller of W(p, k) and W(q, k), scaled to `decay` at most; 1 for a class itself."""
    w = shared_counts(parts)
    t = (
        w.select("p", F.col("q").alias("k"), F.col("w").alias("wp"))
        .join(w.select(F.col("p").alias("q"), F.col("q").alias("k"), F.col("w").alias("wq")), "k")
        .where("p <> q")
        .groupBy("p", "q")
        .agg(F.sum(F.least("wp", "wq")).alias("t"))
    )
    top = t.agg(F.max("t").alias("m"))
    scaled = t.crossJoin(F.broadcast(top)).select("p", "q", (F.col("t") / F.col("m") * decay).alias("s"))
    name = F.concat_ws(":", F.col("src").cast("string"), F.col("cluster").cast("string"))
    own = parts.select(name.alias("p")).distinct().select("p", F.col("p").alias("q"), F.lit(1.0).alias("s"))
    return scaled.union(own)


def srs_classes(parts: DataFrame, decay: float = 0.8, rounds: int = 5) -> DataFrame:
    """(p, q, s): SimRank on the graph of objects and classes, `rounds` times, scaled as cts.

    A round averages the classes' similarities over the pairs of classes of two objects, and those
    over the pairs of objects of two classes. In one grouped task: classes number a few dozen.
    """
    import numpy as np
    import pandas as pd

    name = F.concat_ws(":", F.col("src").cast("string"), F.col("cluster").cast("string"))

    def run(pdf):
        objs, cls = sorted(set(pdf.obj)), sorted(set(pdf.p))
        oi, ci = {o: k for k, o in enumerate(objs)}, {c: k for k, c in enumerate(cls)}
        a = np.zeros((len(objs), len(cls)))
        a[pdf.obj.map(oi), pdf.p.map(ci)] = 1
        to_o, to_c = a / a.sum(1, keepdims=True), (a / a.sum(0, keepdims=True)).T
        s = np.eye(len(cls))
        for _ in range(rounds):
            o = decay * to_o @ s @ to_o.T
            np.fill_diagonal(o, 1)
            s = decay * to_c @ o @ to_c.T
            np.fill_diagonal(s, 1)
        off = s - np.eye(len(cls))
        s = off / max(off.max(), 1e-300) * decay + np.eye(len(cls))
        return pd.DataFrame([(p, q, float(s[i, j])) for i, p in enumerate(cls) for j, q in enumerate(cls)], columns=["p", "q", "s"])

    return parts.select("obj", name.alias("p"), F.lit(1).alias("one")).groupBy("one").applyInPandas(run, "p string, q string, s double")


def asrs_classes(parts: DataFrame, decay: float = 0.8) -> DataFrame:
    """(p, q, s): one-step approximation of SimRank: mean over member pairs of the share of partitions that hold them together; 1 for an object with itself.

    Pairs are counted by class: those of p and q that class c holds are |c and p| times |c and q|, so no row is made for a pair of objects.
    """
    name = F.concat_ws(":", F.col("src").cast("string"), F.col("cluster").cast("string"))
    n = parts.agg(F.countDistinct("src").alias("n"))
    m = parts.select("obj", name.alias("p"))
    held = parts.where("cluster > 0").select("obj", name.alias("c"))
    w = held.join(m, "obj").groupBy("c", "p").agg(F.count("*").alias("w"))
    met = w.join(w.select("c", F.col("p").alias("q"), F.col("w").alias("wq")), "c").select("p", "q", (F.col("w") * F.col("wq")).alias("t"))
    times = held.groupBy("obj").agg(F.count("*").alias("times"))  # an object meets itself so often, and counts as all partitions
    own = m.join(m.select("obj", F.col("p").alias("q")), "obj").join(times, "obj", "left").crossJoin(F.broadcast(n)).select("p", "q", (F.col("n") - F.coalesce("times", F.lit(0))).alias("t"))
    size = m.groupBy("p").agg(F.count("*").alias("n"))
    x = met.union(own).groupBy("p", "q").agg(F.sum("t").alias("t")).crossJoin(F.broadcast(n)).select("p", "q", (F.col("t") / F.col("n")).alias("t"))
    x = x.join(size.withColumnRenamed("n", "np"), "p").join(size.select(F.col("p").alias("q"), F.col("n").alias("nq")), "q").select("p", "q", (F.col("t") / (F.col("np") * F.col("nq"))).alias("s"))
    top = x.where("p <> q").agg(F.max("s").alias("m"))
    return x.crossJoin(F.broadcast(top)).select("p", "q", F.when(F.col("p") == F.col("q"), 1.0).otherwise(F.col("s") / F.col("m") * decay).alias("s"))


def link_similarity(parts: DataFrame, classes: DataFrame) -> DataFrame:
    """pairs(i, j, s): mean over partitions of the similarity of the objects' classes there.

    Objects travel packed, with their classes, and meet in blocks; classes and their similarities number a few thousand at most.
    """
    from .distance import meet_blocks

    name = F.concat_ws(":", F.col("src").cast("string"), F.col("cluster").cast("string"))
    found = sorted((r.p, r.src) for r in parts.select(name.alias("p"), "src").distinct().collect())
    at = {p: k for k, (p, _) in enumerate(found)}
    owner = np.array([s for _, s in found])
    alike = np.zeros((len(found), len(found)))
    for r in classes.collect():
        if r.p in at and r.q in at and owner[at[r.p]] == owner[at[r.q]]:
            alike[at[r.p], at[r.q]] = r.s or 0.0
    srcs = (owner[:, None] == np.unique(owner)[None]).astype(float)
    number = pa.array([p for p, _ in found])
    packed = parts.groupBy("obj").agg(F.collect_list(name).alias("x")).select(F.lit(0).alias("src"), "obj", "x")

    def one_hot(side) -> np.ndarray:
        out = np.zeros((len(side), len(found)))
        out[np.repeat(np.arange(len(side)), np.diff(np.asarray(side.offsets))), np.asarray(pc.index_in(side.flatten(), value_set=number))] = 1
        return out

    def kernel(a, b):
        x, y = one_hot(a), one_hot(b)
        n = (x @ srcs) @ (y @ srcs).T
        return [x @ alike @ y.T / np.maximum(n, 1), n > 0]

    return meet_blocks(packed, kernel, "s double", keep=True).select("i", "j", "s")


def cc_cost(pairs: DataFrame, part: DataFrame) -> DataFrame:
    """One number: sum of d over pairs in one class and of 1 - d over the others."""
    a, b = part.select(F.col("obj").alias("i"), F.col("cluster").alias("ci")), part.select(F.col("obj").alias("j"), F.col("cluster").alias("cj"))
    return pairs.join(a, "i").join(b, "j").agg(F.sum(F.when(F.col("ci") == F.col("cj"), F.col("d")).otherwise(1 - F.col("d"))).alias("cost"))


def voting_step(u: DataFrame, part: DataFrame, step: int, scale: float = 1.0) -> DataFrame:
    """u(obj, ref, p) after one more partition: v is the mean of u over the object's class there; u <- ((step - 1) u + scale v) / step."""
    w = Window.partitionBy("cluster", "ref")
    x = u.join(part.select("obj", "cluster"), "obj")
    return x.select("obj", "ref", (((step - 1) * F.col("p") + scale * F.avg("p").over(w)) / step).alias("p"))


def one_hot(part: DataFrame) -> DataFrame:
    """(obj, ref, p): 1 for the object's class, 0 for the others."""
    k = part.select(F.col("cluster").alias("ref")).distinct()
    return part.crossJoin(F.broadcast(k)).select("obj", "ref", (F.col("cluster") == F.col("ref")).cast("double").alias("p"))


def winner(u: DataFrame) -> DataFrame:
    """labels(obj, cluster): the class with the most weight (to nine places), ties to the smallest."""
    return u.groupBy("obj").agg(F.max_by("ref", F.struct(F.round("p", 9), -F.col("ref"))).alias("cluster"))


def modal_assignment(parts: DataFrame, current: DataFrame) -> DataFrame:
    """One step of iterative voting: each class takes its modal label in each partition (ties to the smallest); objects go to the class with the fewest mismatches."""
    x = parts.join(current.select("obj", F.col("cluster").alias("c")), "obj").groupBy("c", "src", "cluster").agg(F.count("*").alias("n"))
    mode = x.groupBy("c", "src").agg(F.max_by("cluster", F.struct("n", -F.col("cluster"))).alias("mode"))
    miss = parts.join(mode, "src").groupBy("obj", "c").agg(F.sum((F.col("cluster") != F.col("mode")).cast("long")).alias("miss"))
    return miss.groupBy("obj").agg(F.min_by("c", F.struct("miss", "c")).alias("cluster"))


def probabilistic_assignment(parts: DataFrame, current: DataFrame) -> DataFrame:
    """One step: distance is the sum over partitions of the share of class members labelled otherwise than the object."""
    x = parts.join(current.select("obj", F.col("cluster").alias("c")), "obj")
    n = x.groupBy("c", "src").agg(F.count("*").alias("n"))
    per = x.groupBy("c", "src", "cluster").agg(F.count("*").alias("m")).join(n, ["c", "src"]).select("c", "src", "cluster", (F.col("m") / F.col("n")).alias("share"))
    cs = current.select(F.col("cluster").alias("c")).distinct()
    x = parts.crossJoin(F.broadcast(cs)).join(per, ["c", "src", "cluster"], "left").groupBy("obj", "c").agg(F.sum(1 - F.coalesce("share", F.lit(0.0))).alias("d"))
    return x.groupBy("obj").agg(F.min_by("c", F.struct(F.round("d", 9), "c")).alias("cluster"))


def cooccurrence_assignment(parts: DataFrame, current: DataFrame) -> DataFrame:
    """One step: objects go to the class with whose other members they meet most often on average.

    Members of c in the classes that hold an object are counted by class, so no row is made for a pair of objects.
    """
    n = parts.agg(F.countDistinct("src").alias("parts"))
    held = parts.where("cluster > 0").select("src", "obj", F.col("cluster").alias("held"))
    now = current.select("obj", F.col("cluster").alias("c"))
    members = held.join(now, "obj").groupBy("src", "held", "c").agg(F.count("*").alias("m"))
    size = current.groupBy("cluster").agg(F.count("*").alias("n"))
    got = held.join(members, ["src", "held"]).groupBy("obj", "c").agg(F.sum("m").alias("m"), F.count("*").alias("times"))
    x = got.join(current.select("obj", F.col("cluster").alias("own")), "obj").join(size.select(F.col("cluster").alias("c"), "n"), "c").crossJoin(F.broadcast(n))
    # An object meets itself wherever it is held, and is one of its own class each time.
    x = x.withColumn("t", F.when(F.col("c") == F.col("own"), F.col("m") - F.col("times")).otherwise(F.col("m"))).where("t > 0").withColumn("t", F.col("t") / F.col("parts"))
    mean = F.when(F.col("c") == F.col("own"), F.col("t") / F.greatest(F.col("n") - 1, F.lit(1))).otherwise(F.col("t") / F.col("n"))
    moved = x.groupBy("obj").agg(F.max_by("c", F.struct(F.round(mean, 9), -F.col("c"))).alias("cluster"))
    return current.select(F.col("obj"), F.col("cluster").alias("own")).join(moved, "obj", "left").select("obj", F.coalesce("cluster", "own").alias("cluster"))
