"""Connected components of a link table, without bringing links or labels to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnwork.llm.shared import drop_stored, stored


def components(links: DataFrame) -> DataFrame:
    """(node, label) for each node of ``links`` (a, b), longs: the smallest node reachable.

    Each round takes the smallest label among a node's neighbours and then its label's own label, so that rounds grow
    with the logarithm of a component's breadth. A round's labels are written to the shared folder, the last ones stay.
    """
    both = stored(links.select("a", "b").where("a <> b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("least"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("was"), F.least("label", "least").alias("via"))
        own = labels.select(F.col("node").alias("at"), F.col("label").alias("further"))
        after = stored(lower.join(own, lower["via"] == own["at"], "left").select("node", "was", F.least("via", F.coalesce("further", "via")).alias("label")), "labels")
        changed = after.where(F.col("was") != F.col("label")).limit(1).count()
        drop_stored(labels)
        path, labels = after.stored_at, after.select("node", "label")
        labels.stored_at = path
        if not changed:
            drop_stored(both)
            return labels
