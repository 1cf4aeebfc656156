"""Connected components of an edge list, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import common


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root (the smallest node reachable), for each node that has an edge. Nodes are longs.

    Each round takes the smallest label among neighbours and then the label of one's label, so that paths halve; it ends
    when a round changes nothing. Each round's labels are written to the shared folder. No edges: no rows.
    """
    x, y = F.col(a), F.col(b)
    edges = edges.where(x != y).select(x.alias("u"), y.alias("v"))
    edges = common.cut(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = common.cut(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")))
    while True:
        near = edges.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("m"))
        step = labels.join(near.select(F.col("u").alias("node"), "m"), "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        target = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = common.cut(step.join(target, "label", "left").select("node", "old", F.least("label", "further").alias("label")))
        changed = jumped.where("old != label").limit(1).count()
        labels = jumped.select("node", "label")
        if not changed:
            return labels.withColumnRenamed("label", "root")
