"""Connected components of a large, sparse link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segloom.llm.tables import cut


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (smallest node reachable) for every node of ``links`` (columns ``a, b``).

    Labels fall to the smallest among neighbours and then to their label's own label, so that chains shorten by
    half or more per round. Each round is a written table; nothing passes through the driver.
    """
    both = cut(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"]).select(
            "node", F.col("component").alias("old"), F.least("component", "near").alias("mid")
        )
        own = labels.select(F.col("node").alias("__n"), F.col("component").alias("__c"))
        new = cut(lower.join(own, F.col("mid") == F.col("__n"), "left").select(
            "node", "old", F.least("mid", F.coalesce("__c", "mid")).alias("component")
        ))
        labels = new.select("node", "component")
        if new.filter("component <> old").isEmpty():
            return labels
