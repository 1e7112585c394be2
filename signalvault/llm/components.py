"""Connected components of a table of links, by joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalvault.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``links`` (a, b), for every node that has a link.

    Every node points to the smallest neighbour of the node it points to, then to the target of its target,
    until nothing changes: few rounds also for long chains. A node with very many links is a sum with
    map-side combining, never a collected list. Each round is written below ``spark.checkpoint.dir``.
    """
    edges = cut_lineage(links.where("a <> b").selectExpr("a", "b").union(links.where("a <> b").selectExpr("b", "a")).distinct())
    label = edges.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("component"))
    label = cut_lineage(label)
    while True:
        seen = edges.join(label.select(F.col("node").alias("b"), "component"), "b").select(F.col("a").alias("node"), "component")
        # the target of a node learns what its source saw, so that trees join at their roots
        low = seen.groupBy("node").agg(F.min("component").alias("low")).join(label, "node")
        hook = low.select(F.col("component").alias("node"), "low").union(low.select("node", "low")) \
            .groupBy("node").agg(F.min("low").alias("low"))
        met = label.join(hook, "node", "left").select("node", "component", F.least("component", "low").alias("near"))
        met = cut_lineage(met)
        roots = met.select(F.col("node").alias("near"), F.col("near").alias("far"))
        after = cut_lineage(met.join(roots, "near", "left").select(
            "node", F.least("near", "far").alias("component"), (F.least("near", "far") < F.col("component")).alias("moved")))
        label = after.select("node", "component")
        if not after.where("moved").limit(1).count():
            return label
