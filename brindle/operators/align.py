"""Labels of several methods on one numbering, and finding objects in them: aligned(method, obj, label)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def match(share: dict[tuple[int, int], float], ref: list[int], own: list[int]) -> dict[int, int]:
    """Own class -> reference class: exact shares first, then the largest shares, each reference class once; the rest get new numbers."""
    out: dict[int, int] = {}
    taken: set[int] = set()
    order = sorted(share.items(), key=lambda x: (-x[1], x[0]))
    for (r, o), s in order:
        if s > 0 and r not in taken and o not in out:
            out[o] = r
            taken.add(r)
    new = max(ref, default=0)
    for o in own:
        if o not in out:
            new += 1
            out[o] = new
    return out


def reorder_to_reference(parts: DataFrame, reference: int | None = None) -> DataFrame:
    """labels(method, obj, cluster) -> aligned(method, obj, label), numbered as the reference method (the first).

    Overlap is #(A and B) / #A over a reference class A; only the k x k tables reach one place.
    """
    ref_id = parts.agg(F.min("method").alias("m")).first().m if reference is None else reference
    ref = parts.where(F.col("method") == ref_id).select("obj", F.col("cluster").alias("r"))
    size = ref.groupBy("r").agg(F.count("*").alias("nr"))
    share = parts.join(ref, "obj").groupBy("method", "r", "cluster").agg(F.count("*").alias("n")).join(size, "r").select("method", "r", "cluster", (F.col("n") / F.col("nr")).alias("s"))

    def run(key, pdf):
        ms = match({(int(a), int(b)): float(s) for a, b, s in zip(pdf.r, pdf.cluster, pdf.s, strict=True)}, sorted(set(pdf.r.astype(int))), sorted(set(pdf.cluster.astype(int))))
        if key[0] == ref_id:
            ms = {int(c): int(c) for c in set(pdf.cluster)}
        return pd.DataFrame([(int(key[0]), o, r) for o, r in sorted(ms.items())], columns=["method", "cluster", "label"])

    names = share.groupBy("method").applyInPandas(run, "method int, cluster int, label int")
    return parts.join(F.broadcast(names), ["method", "cluster"]).select("method", "obj", "label")  # k rows for each method


def find_cluster(aligned: DataFrame, method: int, label: int) -> DataFrame:
    return aligned.where((F.col("method") == method) & (F.col("label") == label)).select("obj")


def find_element(what: str, thing, path: str = "") -> dict[str, object]:
    """All values under the name `what` in nested dicts and lists, as what_1, what_2, ..."""
    out: list[object] = []

    def walk(x):
        if isinstance(x, dict):
            for k, v in x.items():
                if k == what:
                    out.append(v)
                walk(v)
        elif isinstance(x, (list, tuple)):
            for v in x:
                walk(v)

    walk(thing)
    return {f"{what}_{i + 1}": v for i, v in enumerate(out)}


def shared_objects(aligned: DataFrame) -> DataFrame:
    """(label, obj): objects that carry a label under all methods."""
    n = aligned.select("method").distinct().count()
    return aligned.groupBy("label", "obj").agg(F.countDistinct("method").alias("m")).where(F.col("m") == n).select("label", "obj")


def track_cluster(aligned: DataFrame, selection: DataFrame, follow_most: bool = False) -> DataFrame:
    """How selected objects fare under each method.

    (method, n_clusters, most_together, least_together, share, label, complete, n_extra, n_gone): number of classes that hold them, largest
    and smallest part, the class of the largest part, whether it is whole, how many others it has, and
    how many of the selected are elsewhere.
    """
    sel = selection.select("obj").distinct()
    total = sel.agg(F.count("*").alias("t"))
    per = aligned.join(sel, "obj", "left_semi").groupBy("method", "label").agg(F.count("*").alias("n"))
    size = aligned.groupBy("method", "label").agg(F.count("*").alias("size"))
    x = per.groupBy("method").agg(F.count("*").alias("n_clusters"), F.max("n").alias("most_together"), F.min("n").alias("least_together"), F.max_by("label", F.struct("n", -F.col("label"))).alias("label"))
    x = x.join(size, ["method", "label"]).crossJoin(F.broadcast(total))
    return x.select(
        "method", "n_clusters", "most_together", "least_together", (F.col("most_together") / F.col("t")).alias("share"), "label", (F.col("most_together") == F.col("t")).alias("complete"),
        (F.col("size") - F.col("most_together")).alias("n_extra"), (F.col("t") - F.col("most_together")).alias("n_gone"),
    )


def moves(aligned: DataFrame, label: int) -> DataFrame:
    """(method, before, after, n): where objects of a class go to and come from, between one method and the next."""
    nxt = aligned.select((F.col("method") - 1).alias("method"), "obj", F.col("label").alias("after"))
    x = aligned.select("method", "obj", F.col("label").alias("before")).join(nxt, ["method", "obj"])
    return x.where((F.col("before") == label) | (F.col("after") == label)).groupBy("method", "before", "after").agg(F.count("*").alias("n"))


def compare_single_multi(single: DataFrame, multi: DataFrame) -> DataFrame:
    """(kind, method, label, obj, share): aligned labels of single- and multi-source results on one numbering, with their similarity."""
    from .evaluate import similarity_measure

    top = single.agg(F.max("method").alias("m")).first().m
    both = single.unionByName(multi.withColumn("method", F.col("method") + top))
    al = reorder_to_reference(both)
    sim = similarity_measure(al)
    return al.join(F.broadcast(sim), "method").select(F.when(F.col("method") <= top, "single").otherwise("multi").alias("kind"), "method", "label", "obj", "share")
