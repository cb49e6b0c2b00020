"""Connected components of an edge table, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node it reaches) of each node in ``edges`` (a, b).

    Each round gives a node the smallest label among its neighbours, hooks that label on the
    node's own label as well, and then skips one step along the labels. Labels only fall, so an
    unchanged sum of labels ends it; hooking and skipping keep the number of rounds near the
    logarithm of the longest path. Minima are pre-aggregated before each shuffle, which keeps a
    node with very many edges harmless. Nothing but two numbers a round reaches the driver.
    """
    both = staged(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    before = None
    while True:
        total = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if total is None or total == before:
            return labels
        before = total
        far = labels.select(F.col("node").alias("b"), F.col("label").alias("there"))
        seen = both.join(far, "b").groupBy("a").agg(F.min("there").alias("low"))
        met = seen.join(labels, seen.a == labels.node).select("node", "label", F.least("label", "low").alias("low"))
        offers = met.select("node", "low").union(met.select(F.col("label").alias("node"), "low")).groupBy("node").agg(F.min("low").alias("low"))
        hooked = staged(labels.join(offers, "node", "left").select("node", F.least("label", F.coalesce("low", "label")).alias("label")), "labels")
        up = hooked.select(F.col("node").alias("label"), F.col("label").alias("top"))
        labels = staged(hooked.join(up, "label", "left").select("node", F.least("label", F.coalesce("top", "label")).alias("label")), "labels")
