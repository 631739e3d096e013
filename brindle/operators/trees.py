"""Hierarchical clustering of pairs, cuts, and what trees give: one grouped task for each source.

tree(src, objs, left, right, height): one row for each dendrogram; negative entries are objects.
Dense work is n x n for each source. Trees of values with more than DENSE_MOST different objects go by
rounds over blocks (`rounds`), but for centroid and median; other sources beyond it are refused and go
through nuggets (`nuggets.nugget_cluster`) first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.checkpoints import cut_lineage
from . import kernels as K
from . import rounds
from .distance import Tiled, distance, kernel, prepared
from .normalize import range_guard

TREE = "src int, objs array<string>, left array<int>, right array<int>, height array<double>"
LABELS = "src int, obj string, cluster int"
DENSE_MOST = 10_000  # objects of a matrix in one task: 800 MB
STEP = 256  # rows of a matrix that are made at once
TASKS = 8  # copies of a source's pairs, at most, where settings are tried on them


def check_dense(n: int) -> None:
    if n > DENSE_MOST:
        raise ValueError(f"{n} objects are too many for a matrix in one task (at most {DENSE_MOST}): make nuggets of the source first")


def dense(pdf: pd.DataFrame, value: str = "d", diagonal: float = 0.0) -> tuple[np.ndarray, list[str]]:
    """Matrix and sorted object names of one source's pairs."""
    objs = sorted(set(pdf["i"]) | set(pdf["j"]))
    check_dense(len(objs))
    at = {o: k for k, o in enumerate(objs)}
    m = np.full((len(objs), len(objs)), diagonal)
    i, j = pdf["i"].map(at).to_numpy(), pdf["j"].map(at).to_numpy()
    m[i, j] = m[j, i] = pdf[value].to_numpy(float)
    return m, objs


def long(m: np.ndarray, objs, src: int = 0) -> pd.DataFrame:
    i, j = np.triu_indices(len(objs), 1)
    o = np.asarray(objs, object)
    return pd.DataFrame({"src": np.full(len(i), src, np.int32), "i": o[i], "j": o[j], "d": m[i, j]})


def agglomerate(pairs: DataFrame, linkage: str = "ward", alpha: float = 0.625) -> DataFrame:
    """pairs(src, i, j, d) -> tree. Pairs as `distance` gives them are not moved: the tree's task makes its matrix from their cells."""
    made = getattr(pairs, "made_of", None)
    if made is not None:
        return agglomerate_measured(*made, linkage, alpha).where(F.size("objs") > 1)

    def run(key, pdf):
        d, objs = dense(pdf)
        m, h = K.linkage(d, linkage, alpha)
        return pd.DataFrame([(int(key[0]), objs, m[:, 0].astype("int32").tolist(), m[:, 1].astype("int32").tolist(), h.tolist())], columns=["src", "objs", "left", "right", "height"])

    return pairs.groupBy("src").applyInPandas(run, TREE)


def link_rows(v: np.ndarray, matrix, linkage: str = "ward", alpha: float = 0.625, squares=None) -> tuple[np.ndarray, np.ndarray]:
    """Merges and heights of objects with the values v, where matrix(v) gives distances of rows: equal rows share one, so that only different ones are limited.

    squares(a, b), squared distances of any rows, lets ward go on beyond that limit, by rounds over all
    rows until a matrix of the clusters fits: quadratic time for each round, but no quadratic memory.
    """
    first, of = K.alike(v)
    got = None
    if len(first) > DENSE_MOST and squares is not None and linkage in ("ward", "ward.D2"):
        got = K.linkage_rounds(v[first], of, squares, DENSE_MOST // 2)
        if got is not None:
            return got
    if len(first) < len(v):
        check_dense(len(first))
        got = K.linkage_alike(matrix(v[first]), of, linkage, alpha)
    if got is None:
        check_dense(len(v))
        got = K.linkage(matrix(v), linkage, alpha, copy=False)
    return got


def packed_values(x) -> np.ndarray:
    return np.asarray(x.flatten(), float).reshape(len(x), -1)


def agglomerate_dense(objects: DataFrame, matrix, linkage: str = "ward", alpha: float = 0.625, values=packed_values) -> DataFrame:
    """objects(src, obj, x) -> tree, where matrix(source, v) gives the distances of all objects and v = values(x as an Arrow array) has a row for each.

    The matrix is made in the task that makes the tree, and is the only one there; no pair is moved.
    Objects with equal values share a row of it.
    """

    def run(key, table):
        src = key[0].as_py()
        names = table.column("obj").to_pylist()
        order = sorted(range(len(names)), key=names.__getitem__)
        v = values(table.column("x").combine_chunks().take(pa.array(order, pa.int64())))
        m, h = link_rows(v, lambda rows: matrix(src, rows), linkage, alpha)
        return pa.table({"src": pa.array([src], pa.int32()), "objs": [[names[k] for k in order]], "left": pa.array([m[:, 0]], pa.list_(pa.int32())), "right": pa.array([m[:, 1]], pa.list_(pa.int32())), "height": [h]})

    return objects.groupBy("src").applyInArrow(run, TREE)


def by_rows(n: int, made) -> np.ndarray:
    """The matrix of made(rows as a slice), STEP of them at once, both halves the same to the last bit."""
    out = np.empty((n, n))
    for k in range(0, n, STEP):
        out[k : k + STEP] = made(slice(k, k + STEP))
    for k in range(0, n, STEP):
        for q in range(k, n, STEP):
            a = out[k : k + STEP, q : q + STEP]
            out[q : q + STEP, k : k + STEP] = (np.triu(a) + np.triu(a, 1).T if k == q else a.T)
    return out


def measured(how: str, scales: dict, places: int | None = None):
    """matrix(source, v) of a measure that `prepared` gives, made by blocks of rows in one array."""

    def matrix(src, v):
        def made(rows):
            d = kernel(v[rows], v, how, scales.get(src))
            return d if places is None else np.round(d, places)

        return by_rows(len(v), made)

    return matrix


def cluster_cells(cells: DataFrame, measure: str = "euclidean", normalize=None, linkage: str = "ward", alpha: float = 0.625, places: int | None = None) -> DataFrame:
    """Tree of each source's cells, from distances (to `places` places) that are made in the tree's task."""
    return agglomerate_measured(*prepared(cells, measure, normalize), linkage, alpha, places)


def agglomerate_measured(objects: DataFrame, how: str, scales: dict, linkage: str = "ward", alpha: float = 0.625, places: int | None = None) -> DataFrame:
    """objects(src, obj, x), as `prepared` gives them -> tree. Sources of more different objects than a matrix holds go by rounds (`rounds`), at once."""
    counts = {r.src: r.n for r in objects.groupBy("src").agg(F.count("*").alias("n")).collect()} if rounds.reducible(linkage, alpha) else {}  # one row for each source
    out, gone = None, []
    for src in sorted(s for s, n in counts.items() if n > DENSE_MOST):
        one = agglomerate_rounds(objects, src, lambda v, s=src: Tiled(v, how, scales.get(s), places), linkage, alpha)
        if one is not None:
            gone.append(src)
            out = one if out is None else out.union(one)
    if out is not None and len(gone) == len(counts):
        return out
    rest = agglomerate_dense(objects.where(~F.col("src").isin(gone)) if gone else objects, measured(how, scales, places), linkage, alpha)
    return rest if out is None else out.union(rest)


def agglomerate_rounds(objects: DataFrame, src: int, distances, linkage: str, alpha: float, values=packed_values) -> DataFrame | None:
    """Tree of a source's objects by rounds, or None where a matrix holds its different ones. The objects' values, and what grows with their number, are held by the driver."""
    table = objects.where(F.col("src") == src).select("obj", "x").toArrow()
    names = table.column("obj").to_pylist()
    order = sorted(range(len(names)), key=names.__getitem__)
    x = table.column("x").combine_chunks()
    v = values((x.chunk(0) if isinstance(x, pa.ChunkedArray) else x).take(pa.array(order, pa.int64())))
    del table, x
    first, of = K.alike(v)
    made = distances(v)
    if len(first) < len(v):  # equal, but not at zero: each for itself
        many = np.bincount(of)
        apart = np.zeros(len(first), bool)
        for k in np.flatnonzero(many > 1).tolist():
            row = v[first[k]][None]
            apart[k] = made(row)(row)[0, 0] != 0
        if apart.any():
            first, of = K.alike(np.where(apart[of], len(first) + np.arange(len(of)), of)[:, None])
    if len(first) <= DENSE_MOST:
        return None
    m, h = rounds.tree(objects.sparkSession, v[first], of, made, linkage, alpha, DENSE_MOST // 3)
    row = pa.table({"src": pa.array([src], pa.int32()), "objs": [[names[k] for k in order]], "left": pa.array([m[:, 0]], pa.list_(pa.int32())), "right": pa.array([m[:, 1]], pa.list_(pa.int32())), "height": [h]})
    return objects.sparkSession.createDataFrame(row, TREE)


def cluster(data: DataFrame, kind: str = "data", measure: str = "euclidean", normalize=False, linkage: str = "ward", alpha: float = 0.625, stop_range: bool = True) -> tuple[DataFrame, DataFrame]:
    """Baseline clustering of cells (kind data) or pairs (kind dist): (pairs, tree)."""
    if kind not in ("data", "dist"):
        raise ValueError("kind is data or dist")
    pairs = data if kind == "dist" else distance(data, measure, normalize or None)
    pairs = range_guard(pairs, stop_range)
    return pairs, agglomerate(pairs, linkage, alpha)


def labels(tree: DataFrame, k: int | dict[int, int]) -> DataFrame:
    """Flat partition of each tree in k classes (a number, or one for each source), numbered by first appearance."""

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                n = len(r.objs)
                m = np.stack([np.asarray(r.left), np.asarray(r.right)], 1) if n > 1 else np.zeros((0, 2), int)
                y = K.cut(m.astype(int), n, k[r.src] if isinstance(k, dict) else k)
                yield pd.DataFrame({"src": r.src, "obj": list(r.objs), "cluster": y.astype("int32")})

    return tree.mapInPandas(run, LABELS)


def labels_of(thing: DataFrame, k: int, linkage: str = "ward") -> DataFrame:
    """Labels of a tree, or of pairs by way of a tree."""
    return labels(thing if "objs" in thing.columns else agglomerate(thing, linkage), k)


def cophenetic(tree: DataFrame) -> DataFrame:
    """pairs(src, i, j, d): height of the lowest merge that holds both."""

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                m = np.stack([np.asarray(r.left), np.asarray(r.right)], 1).astype(int)
                yield long(K.cophenetic(m, np.asarray(r.height), len(r.objs)), list(r.objs), r.src)

    return tree.mapInPandas(run, "src int, i string, j string, d double")


def leaf_order(tree: DataFrame) -> DataFrame:
    """(src, obj, pos): leaves from left to right."""

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                m = np.stack([np.asarray(r.left), np.asarray(r.right)], 1).astype(int)
                o = K.leaf_order(m, len(r.objs))
                yield pd.DataFrame({"src": r.src, "obj": [r.objs[i] for i in o], "pos": np.arange(1, len(o) + 1, dtype="int32")})

    return tree.mapInPandas(run, "src int, obj string, pos int")


def merge_members(tree: DataFrame) -> DataFrame:
    """(src, step, obj, height): objects of the cluster that each merge makes."""

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                m = np.stack([np.asarray(r.left), np.asarray(r.right)], 1).astype(int)
                rows = [(r.src, s + 1, r.objs[i], float(h)) for s, (got, h) in enumerate(zip(K.members(m), r.height, strict=True)) for i in got]
                yield pd.DataFrame(rows, columns=["src", "step", "obj", "height"])

    return tree.mapInPandas(run, "src int, step int, obj string, height double")


def components(edges: DataFrame, objects: DataFrame) -> DataFrame:
    """(obj, cluster) of objects(obj) under edges(i, j), numbered by the smallest object; distributed.

    Each round gives every node the least label (a hash) around it and contracts the edges: about
    log2(n) rounds, whatever the components' shapes.
    """
    name = F.xxhash64
    e = edges.where("i <> j").select(name("i").alias("a"), name("j").alias("b"))
    e = cut_lineage(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    node = cut_lineage(objects.select("obj", name("obj").alias("root")))
    while e.head(1):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hop = cut_lineage(both.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("m")))
        node = cut_lineage(node.join(hop, node.root == hop.v, "left").select("obj", F.coalesce("m", "root").alias("root")))
        e = e.join(hop.select(F.col("v").alias("a"), F.col("m").alias("ma")), "a").join(hop.select(F.col("v").alias("b"), F.col("m").alias("mb")), "b").where("ma <> mb")
        e = cut_lineage(e.select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).distinct())
    first = node.groupBy("root").agg(F.min("obj").alias("first"))
    number = first.select("root", F.row_number().over(Window.orderBy("first")).cast("int").alias("cluster"))  # one row for each component
    return node.join(number, "root").select("obj", "cluster")


def single_link_components(pairs: DataFrame, limit: float) -> DataFrame:
    """labels: connected components over pairs with d <= limit; singletons are their own."""
    out = None
    for src in sorted(r.src for r in pairs.select("src").distinct().collect()):  # one row for each source
        own = pairs.where(F.col("src") == src)
        objs = own.select(F.col("i").alias("obj")).union(own.select(F.col("j").alias("obj"))).distinct()
        one = components(own.where(F.col("d") <= limit).select("i", "j"), objs).select(F.lit(src).cast("int").alias("src"), "obj", "cluster")
        out = one if out is None else out.union(one)
    return out


def pam(pairs: DataFrame, ks) -> DataFrame:
    """(src, k, obj, cluster, width): k-medoids and silhouette widths for each k, in TASKS tasks for each source at most."""
    ks = sorted({int(k) for k in ks})
    groups = [ks[n::TASKS] for n in range(min(TASKS, len(ks)))]
    grid = pairs.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(groups) - 1))).alias("task"))

    def run(key, pdf):
        d, objs = dense(pdf)
        out = []
        for k in groups[int(key[1])]:
            y = K.pam(d, k)
            out.append(pd.DataFrame({"src": int(key[0]), "k": k, "obj": objs, "cluster": y.astype("int32"), "width": K.silhouette(d, y)}))
        return pd.concat(out)

    return grid.groupBy("src", "task").applyInPandas(run, "src int, k int, obj string, cluster int, width double")
