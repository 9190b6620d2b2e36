"""Connected components by iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import join_groups, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for each node of ``edges``; component is the least node reached.

    Each round every node takes the least label among its neighbours and itself,
    then labels jump to the label of their label, which halves the length of chains.
    The edges and labels stay distributed, each round's labels are a written table,
    and the driver sees one count a round. Hubs, whether nodes of many edges or labels of
    many nodes, are spread (``join_groups``). An empty input gives an empty result.
    """
    both = materialize(
        edges.select(F.col(a).alias("node"), F.col(b).alias("other")).unionByName(edges.select(F.col(b).alias("node"), F.col(a).alias("other"))).where("node <> other").distinct(),
        "cc-edges",
    )
    total = both.count()
    labels = both.groupBy("node").agg(F.min("other").alias("m"), F.count(F.lit(1)).alias("degree"))
    labels = materialize(labels.select("node", F.least("node", "m").alias("component"), "degree"), "cc-labels")
    while True:
        near = join_groups(both, labels.select(F.col("node").alias("other"), F.col("component").alias("c"), "degree"), ["other"], "degree", total)
        lower = labels.join(near.groupBy("node").agg(F.min("c").alias("c")), "node")
        lower = materialize(lower.select("node", F.least("component", "c").alias("low"), F.col("component").alias("was"), "degree"), "cc-lower")
        named = lower.groupBy("low").agg(F.count(F.lit(1)).alias("n")).join(labels.select(F.col("node").alias("low"), F.col("component").alias("j")), "low")
        jumped = join_groups(lower, materialize(named, "cc-named"), ["low"], "n", total)
        new = materialize(jumped.select("node", F.least("low", "j").alias("component"), "was", "degree"), "cc-labels")
        if not new.where("component <> was").limit(1).count():
            return new.select("node", "component")
        labels = new.select("node", "component", "degree")
