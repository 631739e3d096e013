"""The tables behind the plots; drawing is left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GREY, WHITE, ALONE = "#BEBEBE", "#FFFFFF", 5000
#: A qualitative palette.
COLOURS = ("#1F77B4", "#FF7F0E", "#2CA02C", "#D62728", "#9467BD", "#8C564B", "#E377C2", "#7F7F7F", "#BCBD22", "#17BECF")
#: Names of colours that palettes take.
NAMED = {"red": (255, 0, 0), "green": (0, 255, 0), "blue": (0, 0, 255), "white": (255, 255, 255), "black": (0, 0, 0), "yellow": (255, 255, 0), "orange": (255, 165, 0), "grey": (190, 190, 190)}


def color_palette(colors=("red", "green"), n: int = 5) -> list[str]:
    """n colours between the given ones, by linear interpolation of red, green and blue."""
    rgb = [NAMED[c] if c in NAMED else tuple(int(c.lstrip("#")[i : i + 2], 16) for i in (0, 2, 4)) for c in colors]
    out = []
    for i in range(n):
        x = i * (len(rgb) - 1) / max(n - 1, 1)
        a = min(int(x), len(rgb) - 2) if len(rgb) > 1 else 0
        f = x - a
        b = rgb[min(a + 1, len(rgb) - 1)]
        out.append("#" + "".join(f"{int(p + (q - p) * f + 0.5):02X}" for p, q in zip(rgb[a], b, strict=True)))
    return out


def color_of(label, colors=COLOURS):
    """Column: a label's colour; null grey, lone objects white."""
    table = F.array(*[F.lit(c) for c in colors])
    return F.when(label.isNull(), GREY).when(label == ALONE, WHITE).otherwise(F.get(table, ((label - 1) % len(colors)).cast("int")))


def colors_names(aligned: DataFrame, colors=COLOURS) -> DataFrame:
    """(method, obj, label, color); a method with one label only is grey."""
    n = aligned.groupBy("method").agg(F.countDistinct("label").alias("k"))
    return aligned.join(F.broadcast(n), "method").select("method", "obj", "label", F.when(F.col("k") == 1, GREY).otherwise(color_of(F.col("label"), colors)).alias("color"))


def compare_plot(aligned: DataFrame, order: DataFrame | None = None, colors=COLOURS) -> DataFrame:
    """(method, obj, pos, label, color): lone objects become one code; pos is the leaf order, or that of the first method's labels."""
    size = aligned.groupBy("method", "label").agg(F.count("*").alias("n"))
    x = aligned.join(size, ["method", "label"]).select("method", "obj", F.when(F.col("n") == 1, F.lit(ALONE)).otherwise(F.col("label")).alias("label"))
    if order is None:
        first = aligned.agg(F.min("method").alias("m0"))
        order = aligned.join(F.broadcast(first), F.col("method") == F.col("m0")).select("obj", "label").withColumn("grp", F.lit(1))
        order = order.select("obj", F.row_number().over(Window.partitionBy("grp").orderBy("label", "obj")).alias("pos"))
    return colors_names(x, colors).join(order.select("obj", "pos"), "obj").select("method", "obj", "pos", "label", "color")


def cyclogram(aligned: DataFrame, order: DataFrame | None = None, colors=COLOURS) -> DataFrame:
    """compare_plot with the angle of each object and the ring of each method."""
    x = compare_plot(aligned, order, colors)
    n = F.count("*").over(Window.partitionBy("method"))
    return x.withColumn("angle", 2 * 3.141592653589793 * (F.col("pos") - 1) / n).withColumn("ring", F.col("method"))


def cluster_cols(part: DataFrame, order: DataFrame, colors=COLOURS) -> DataFrame:
    """(obj, pos, cluster, color) of leaves."""
    return part.join(order.select("obj", "pos"), "obj").select("obj", "pos", "cluster", color_of(F.col("cluster"), colors).alias("color"))


def cluster_plot(merges: DataFrame, part: DataFrame, order: DataFrame, colors=COLOURS) -> tuple[DataFrame, DataFrame]:
    """(merges of the tree, coloured leaves)."""
    return merges, cluster_cols(part, order, colors)


def label_cols(objects: DataFrame, sel1: DataFrame, sel2: DataFrame | None = None, col1: str = COLOURS[0], col2: str = COLOURS[1], both: str = COLOURS[2]) -> DataFrame:
    """(obj, color) by membership in one or two selections."""
    x = objects.select("obj").join(sel1.select("obj", F.lit(True).alias("a")).distinct(), "obj", "left")
    x = x.join(sel2.select("obj", F.lit(True).alias("b")).distinct(), "obj", "left") if sel2 is not None else x.withColumn("b", F.lit(None).cast("boolean"))
    return x.select("obj", F.when(F.col("a") & F.col("b"), both).when(F.col("a"), col1).when(F.col("b"), col2).otherwise("#000000").alias("color"))


def label_plot(order: DataFrame, sel1: DataFrame, sel2: DataFrame | None = None, **cols) -> DataFrame:
    return label_cols(order, sel1, sel2, **cols).join(order.select("obj", "pos"), "obj")


def box_plot_distance(binned: DataFrame, shown: DataFrame, limits) -> DataFrame:
    """(bin, n, low, q1, median, q3, high): the second distances in boxes of the first."""
    return box_plot_joint(binned.select("i", "j", F.col("d").alias("d1")).join(shown.select("i", "j", F.col("d").alias("d2")), ["i", "j"]), limits)


def box_plot_joint(pairs: DataFrame, limits) -> DataFrame:
    """The same of rows with both distances (d1, d2), as joint_distances gives: equal values of a box are counted before they move."""
    bin_ = F.lit(1)
    for k, v in enumerate(sorted(limits)):
        bin_ = F.when(F.col("d1") > v, k + 2).otherwise(bin_)
    x = pairs.select(bin_.alias("bin"), "d2").groupBy("bin", "d2").agg(F.count("*").alias("m"))
    q = lambda p: F.expr(f"percentile(d2, {p}, m)")
    return x.groupBy("bin").agg(F.sum("m").alias("n"), F.min("d2").alias("low"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), F.max("d2").alias("high"))


def distance_heatmap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, label): a's class where both partitions keep a pair together, else 0."""
    x = a.select("obj", F.col("cluster").alias("ca")).join(b.select("obj", F.col("cluster").alias("cb")), "obj")
    l, r = x.select(F.col("obj").alias("i"), F.col("ca").alias("ai"), F.col("cb").alias("bi")), x.select(F.col("obj").alias("j"), F.col("ca").alias("aj"), F.col("cb").alias("bj"))
    return l.join(r, F.col("i") < F.col("j")).select("i", "j", F.when((F.col("ai") == F.col("aj")) & (F.col("bi") == F.col("bj")), F.col("ai")).otherwise(0).alias("label"))


def heatmap_plot(a: DataFrame, b: DataFrame, colors=COLOURS) -> DataFrame:
    return distance_heatmap(a, b).withColumn("color", F.when(F.col("label") == 0, WHITE).otherwise(color_of(F.col("label"), colors)))


def similarity_heatmap(pairs: DataFrame, cutoff: float | None = None, percentile: bool = False) -> DataFrame:
    """(i, j, s): 1 - d, values at or below the cutoff (or the cutoff's quantile) as 0."""
    s = pairs.select("i", "j", (1 - F.col("d")).alias("s"))
    if cutoff is None:
        return s
    if not percentile:
        return s.select("i", "j", F.when(F.col("s") <= cutoff, 0.0).otherwise(F.col("s")).alias("s"))
    q = s.agg(F.expr(f"percentile(s, {cutoff})").alias("q"))
    return s.crossJoin(F.broadcast(q)).select("i", "j", F.when(F.col("s") <= F.col("q"), 0.0).otherwise(F.col("s")).alias("s"))


def heatmap_selection(order: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """Objects whose leaf lies in a rectangle of the heatmap, the choice given instead of drawn."""
    return order.where(F.col("pos").between(*rows) | F.col("pos").between(*cols)).select("obj", "pos")


def binary_features_plot(cells: DataFrame, leads: DataFrame, features: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """(obj, rank, feat, val): presence of the chosen features, leads first."""
    x = cells.join(features.select("feat").distinct(), "feat", "left_semi").join(leads.select("obj", F.lit(0).alias("lead")).distinct(), "obj", "left")
    if order is not None:
        x = x.join(order.select("obj", "pos"), "obj", "left")
    else:
        x = x.withColumn("pos", F.lit(0))
    names = x.select("obj", F.coalesce("lead", F.lit(1)).alias("lead"), "pos").distinct().withColumn("one", F.lit(1))
    rank = names.select("obj", F.row_number().over(Window.partitionBy("one").orderBy("lead", "pos", "obj")).alias("rank"))
    return x.join(rank, "obj").select("obj", "rank", "feat", "val")


def binary_features_multiple(cells: DataFrame, leads: DataFrame) -> DataFrame:
    """(feat, sources): present features of leads, grouped by the sources that hold them."""
    has = cells.join(leads.select("obj").distinct(), "obj", "left_semi").where("val > 0")
    return has.groupBy("feat").agg(F.array_join(F.array_sort(F.collect_set(F.col("src").cast("string"))), "+").alias("sources"), F.countDistinct("obj").alias("n"))


def continuous_features_plot(cells: DataFrame, leads: DataFrame) -> DataFrame:
    """(obj, feat, val, lead): profiles, leads marked."""
    return cells.join(leads.select("obj", F.lit(True).alias("l")).distinct(), "obj", "left").select("obj", "feat", "val", F.coalesce("l", F.lit(False)).alias("lead"))


def profile_plot(expr: DataFrame, genes: DataFrame, selection: DataFrame, raw: bool = False) -> DataFrame:
    """(gene, obj, val, inside, group_mean): gene-centred profiles unless raw, with means inside and outside the selection."""
    x = expr.join(genes.select("gene").distinct(), "gene", "left_semi").join(selection.select("obj", F.lit(True).alias("s")).distinct(), "obj", "left")
    v = F.col("val") if raw else F.col("val") - F.avg("val").over(Window.partitionBy("gene"))
    x = x.select("gene", "obj", v.alias("val"), F.coalesce("s", F.lit(False)).alias("inside"))
    return x.withColumn("group_mean", F.avg("val").over(Window.partitionBy("gene", "inside")))


def pathway_edges(found: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, shared): significant gene sets that share genes, the table behind a pathway graph."""
    s = sets.join(found.select("set").distinct(), "set", "left_semi").select("set", "gene").distinct()
    return s.select("gene", F.col("set").alias("a")).join(s.select("gene", F.col("set").alias("b")), "gene").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


def compare_interactive(aligned_single: DataFrame, aligned_multi: DataFrame, chosen: tuple[int, int]) -> DataFrame:
    """Objects of a chosen (method, label) of one panel, with their labels in the other."""
    m, label = chosen
    sel = aligned_single.where((F.col("method") == m) & (F.col("label") == label)).select("obj")
    return aligned_multi.join(sel, "obj", "left_semi")
