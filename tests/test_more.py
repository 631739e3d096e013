"""Operators that the queries do not reach."""

import numpy as np
from pyspark.sql import functions as F

from brindle.operators import align as AL
from brindle.operators import bagging as B
from brindle.operators import characterize as CH
from brindle.operators import evaluate as EV
from brindle.operators import integrate as IN
from brindle.operators import nuggets as NU
from brindle.operators import plotdata as PL
from brindle.operators import trees as TR
from brindle.operators.distance import distance
from brindle.sources import tables as ST


def small(spark):
    cells, truth = ST.simulate(spark, n=24, features=(30, 30), informative=(9, 9), effect=4.0, seed=3)
    return cells.persist(), truth.select("obj", F.col("g").alias("cluster")).persist()


def test_plot_tables(spark):
    cells, truth = small(spark)
    tree = TR.cluster(cells.where("src = 1"))[1]
    order = TR.leaf_order(tree).select("obj", "pos").persist()
    lab = TR.labels(tree, 3).select("obj", "cluster")
    assert order.select("pos").distinct().count() == 24
    assert PL.cluster_plot(tree, lab, order)[1].count() == 24
    assert PL.label_plot(order, truth.where("cluster = 1"), truth.where("cluster = 2")).select("color").distinct().count() == 3
    assert PL.heatmap_plot(lab, truth).where("label > 0").count() > 0
    assert PL.heatmap_selection(order, (1, 3), (5, 5)).count() == 4
    binary = cells.where("src = 1").withColumn("val", (F.col("val") > 0).cast("double"))
    x = PL.binary_features_plot(binary, truth.where("cluster = 1"), binary.where("feat < 'src1_f004'").select("feat"), order)
    leads = {r.obj for r in truth.where("cluster = 1").collect()}
    assert {r.obj for r in x.where(f"rank <= {len(leads)}").select("obj").distinct().collect()} == leads
    al = AL.reorder_to_reference(lab.withColumn("method", F.lit(1)))
    assert PL.compare_interactive(al, al, (1, 1)).where("label <> 1").count() == 0
    assert AL.moves(al, 1).count() == 0


def test_selections_and_choice(spark):
    cells, truth = small(spark)
    one = cells.where("src = 1")
    binary = one.withColumn("val", (F.col("val") > 1).cast("double"))
    sel = truth.where("cluster = 1")
    got = CH.choose_cluster(truth, 1, binary, one, one.select(F.col("feat").alias("gene"), "obj", "val"), top=3)
    informative = {f"src1_f{j:03d}" for j in (1, 4, 7)}
    assert {r.feat for r in got["features"].where("kind = 'continuous'").collect()} == informative
    assert {r.gene for r in got["genes"].collect()} == informative
    single = CH.feature_selection(sel.limit(1), binary)
    p = [r.prevalence for r in single.collect()]
    assert p == sorted(p, reverse=True)
    genes = one.select(F.col("feat").alias("gene"), "obj", "val")
    sets = genes.select("gene").distinct().select(F.when(F.col("gene").isin(*informative, "src1_f002", "src1_f005"), "hit").otherwise("rest").alias("set"), "gene")
    found = {r.set: r.p for r in CH.pathways_selection(genes, sel, sets, permutations=60).collect()}
    assert found["hit"] < 0.1 < found["rest"]
    tests = CH.diff_genes(genes, sel.select(F.lit(1).alias("grp"), "obj"), top=4).select(F.lit(1).alias("method"), F.lit("gene").alias("kind"), F.col("gene").alias("item"), "p")
    two = tests.unionByName(tests.withColumn("method", F.lit(2)))
    assert CH.shared_selection(two)[1].count() == CH.shared_selection_genes(two)[1].count() == CH.shared_selection_paths(two)[1].count() == 4


def test_nugget_parts(spark):
    cells, truth = small(spark)
    one = cells.where("src = 1")
    member = truth.select("obj", F.when(F.col("obj") == "obj01", "lone").otherwise(F.col("cluster").cast("string")).alias("nid"))
    moved = NU.absorb_small(one, member, 2)
    assert moved.where("nid = 'lone'").count() == 0 and moved.where("obj = 'obj01'").first().nid == "1"
    n = NU.from_engine(np.eye(3), np.array([1, 2, 3]), np.ones(3), ["a", "b", "c"], spark)
    assert NU.summary(n).first().n_objects == 6
    assert NU.cluster_nuggets(n, 3, "ward").select("cluster").distinct().count() == 3


def test_sources_and_sampling(spark, tmp_path):
    cells, _ = small(spark)
    ST.write_csv(cells, str(tmp_path / "c"))
    assert ST.read_csv(spark, str(tmp_path / "c"), ST.CELLS).count() == cells.count()
    ST.write_parquet(cells, str(tmp_path / "p"), "src")
    assert spark.read.parquet(str(tmp_path / "p")).count() == cells.count()
    assert ST.align(cells).count() == cells.count()
    assert ST.unpack(ST.pack(cells)).count() == cells.count()
    d = B.sample_ranks(spark, 10, 200, 3, replace=True)
    assert d.count() == 600 and d.select("item").distinct().count() == 10
    w = B.sample_ranks(spark, 300, 200, 5, weighted=True)
    assert w.count() == 1000 and w.agg(F.avg("item").alias("m")).first().m < 140
    gap = EV.gap_statistic(cells.where("src = 1"), 5, 6)
    assert gap.where("best").count() == 1


def test_latent_classes(spark):
    cells, truth = small(spark)
    y = truth.select("obj", F.col("cluster").cast("double").alias("y"))
    for model in ("early", "parallel", "serial"):
        got = IN.lucid(cells.where("src = 2"), cells, y, 3, model=model)
        per = got.groupBy("src").count().count()
        assert per == (2 if model == "parallel" else 1)
        assert EV.agreement(got.where(F.col("src") == got.agg(F.min("src")).first()[0]).select("obj", "cluster"), truth).first().ari > 0.6


def test_remaining_methods(spark):
    cells, truth = small(spark)
    pairs = distance(cells, "gower").persist()
    theta, part = IN.ehc(pairs, 3, "dist", linkage="ward")
    assert theta.where("s < 0").count() == 0 and part.count() == 24
    assert IN.ehc(pairs, 3, "dist", linkage="ward", method="METIS")[1].count() == 24
    parts = TR.labels(TR.agglomerate(pairs, "ward"), 3).persist()
    for how in ("Balls", "Furthest", "LocalSearch", "Aggl"):
        assert IN.clustering_aggregation(parts, how).count() == 24
    assert TR.labels(IN.link_based(parts, "srs")[1], 3).count() == 24
    assert IN.cvaa(parts.where("src = 1").select("obj", "cluster"), parts, 2, "W-CVAA").select("cluster").distinct().count() <= 2
    best = EV.weight_by_similarity(pairs, 3, [0.0, 0.5, 1.0]).where("best")
    assert best.count() == 1
    end = IN.weighted_clust(pairs, "dist", weights=[(1.0, 0.0)], stop_range=True)[0].join(pairs.where("src = 1").select("i", "j", F.col("d").alias("one")), ["i", "j"])
    assert end.where("abs(d - one) > 1e-9").count() == 0
