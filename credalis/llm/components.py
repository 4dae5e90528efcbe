"""Connected components by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credalis.llm.frames import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each node of ``edges`` (a, b).

    Each round gives every node the smallest component among its own and its neighbours',
    then follows that component's own label. Rounds are written to the shared folder.
    """
    edges = edges.where("a <> b")
    both = stored(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        seen = label.select(F.col("node").alias("b"), F.col("component").alias("other"))
        near = both.join(seen, "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("near"))
        best = label.join(near, "node").select("node", "component", F.least("component", "near").alias("low"))
        jump = label.select(F.col("node").alias("low"), F.col("component").alias("far"))
        step = stored(best.join(jump, "low", "left").select("node", F.col("component").alias("before"), F.coalesce("far", "low").alias("component")))
        label = step.select("node", "component")
        if step.where("before <> component").limit(1).count() == 0:
            return label
