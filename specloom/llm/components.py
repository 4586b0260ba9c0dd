"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specloom.llm.common import cut, deal, hot_keys, repeat, split_hot


def connected_components(edges: DataFrame) -> DataFrame:
    """node and component (the least node reachable) of each end of `edges` (a, b), both of one type.

    Each round a node takes the least label of itself and its neighbours, then the label of that label, so labels travel
    ever longer ways; a round ends in a written table. Ends when no label changes: about the logarithm of the longest
    path in rounds. Hubs and large components are dealt to several tasks. Null ends, loops and repeated edges change nothing.
    """
    edges = edges.filter("a IS NOT NULL AND b IS NOT NULL")
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    hubs = hot_keys(both, ["b"])
    dealt = deal(both, hubs, ["b"], F.xxhash64("a"))
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        known = repeat(labels.withColumnRenamed("node", "b"), hubs, ["b"])
        near = dealt.join(known, ["b", "salt"]).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        hooked = cut(labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component")), "hooked")
        one, up = split_hot(hooked, labels.select(F.col("node").alias("component"), F.col("component").alias("top")), ["component"], F.xxhash64("node"))
        jumped = one.join(up, ["component", "salt"], "left").select("node", "old", F.least("component", "top").alias("component"))
        step = cut(jumped, "labels")
        labels = step.select("node", "component")
        if step.filter("old <> component").isEmpty():
            return labels
