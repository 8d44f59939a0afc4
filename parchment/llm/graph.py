"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``u, v``: root is the smallest node of its component.

    Each round takes the least label of all neighbours and then that label's own label, so paths halve at least.
    Hubs cost no task more than others: minima are taken from partial minima.
    """
    u, v = F.col("u"), F.col("v")
    pairs = F.explode(F.array(*(F.struct(a.alias("u"), b.alias("v")) for a, b in ((u, v), (v, u), (u, u), (v, v)))))
    both = stage(edges.select(pairs.alias("_e")).select("_e.*").distinct(), "edges")
    labels = stage(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")), "labels")
    while True:
        near = both.join(labels, both["v"] == labels["node"]).groupBy(F.col("u").alias("node")).agg(F.min("root").alias("root"))
        own = labels.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
        back = labels.select(F.col("node").alias("_self"), F.col("root").alias("_before"))
        lower = near.join(own, near["root"] == own["_node"]).join(back, near["node"] == back["_self"])
        new = stage(lower.select("node", F.least("root", "_root").alias("root"), (F.least("root", "_root") != F.col("_before")).alias("changed")), "labels")
        labels = new.select("node", "root")
        if new.where("changed").isEmpty():
            return labels
