"""Connected components over a distributed edge list; nothing is collected to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import drop, stage


def components(links: DataFrame) -> DataFrame:
    """links(a long, b long) -> (g long, comp long): every linked node with one label for its component.

    Each round maps a node to the smallest label in its closed neighbourhood and contracts the
    edges, which leaves connectivity as it is.  Labels are random 64-bit hashes, so that a round
    removes a constant share of the nodes of a component: about log2(n) rounds.  The node at the
    middle of a large star is only ever a key of a partial aggregation.
    An empty edge list gives an empty table; self links and repeated links are harmless.
    """
    edges = stage(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    mapping = None
    while edges.head(1):
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hop = stage(both.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("m")), "hop")
        if mapping is None:
            mapping, old = hop.select(F.col("v").alias("g"), F.col("m").alias("comp")), None
        else:
            old = mapping
            mapping = stage(old.join(hop, old.comp == hop.v, "left").select("g", F.coalesce("m", "comp").alias("comp")), "comp")
        last = edges
        edges = stage(
            last.join(hop.select(F.col("v").alias("a"), F.col("m").alias("ma")), "a")
            .join(hop.select(F.col("v").alias("b"), F.col("m").alias("mb")), "b")
            .where("ma <> mb")
            .select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b"))
            .distinct(),
            "edges",
        )
        drop(last)
        if old is not None:
            drop(old)
    if mapping is None:
        return edges.select(F.col("a").alias("g"), F.col("b").alias("comp"))
    return mapping
