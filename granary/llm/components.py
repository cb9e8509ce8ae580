"""Connected components of a table of links, by shrinking minimum labels over joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import discarded, stored


def components(links: DataFrame) -> DataFrame:
    """(id, label): for each id in links (a, b), the least id it is joined to.

    Each round takes the least label among a node and its neighbours and then
    the label of that label, so a chain of n links takes about log n rounds.
    Tables are written each round and deleted after the next; nothing but a count comes to the driver.
    """
    edges = stored(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = old = stored(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("label")))
    while True:
        near = edges.join(labels, edges.b == labels.id).groupBy("a").agg(F.min("label").alias("near"))
        least = labels.join(near, labels.id == near.a, "left").select(
            "id", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label")
        )
        root = labels.select(F.col("id").alias("root"), F.col("label").alias("root_label"))
        jumped = least.join(root, least.label == root.root, "left")
        new = stored(jumped.select("id", "old", F.least("label", F.coalesce("root_label", "label")).alias("label")))
        discarded(old)
        labels, old = new.select("id", "label"), new
        if new.filter("label <> old").limit(1).count() == 0:
            discarded(edges)
            return labels
