"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmon.llm.common import materialise, parts_for


def connected_components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``links (a, b)``; the label is the least node of its component.

    Each round takes the least label among the neighbours and then jumps to the
    label's own label, so long chains fold up in about logarithmic time.  Only
    convergence counts reach the driver.  No links, no rows.
    """
    both = links.select("a", "b").where("a <> b")
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialise(both, "links")
    parts = parts_for(both.count(), 100_000)  # small graphs need few tasks, whatever the session's default
    both = both.coalesce(parts)
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label"))
    labels = materialise(labels.coalesce(parts), "labels-0")
    n = 0
    while True:
        n += 1
        of = labels.select(F.col("node").alias("b"), F.col("label").alias("near"))
        near = both.join(of, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("low"))
        hop = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        jumped = lower.join(hop, "low", "left").select("node", "was", F.least("low", F.coalesce("far", "low")).alias("label"))
        jumped = materialise(jumped.coalesce(parts), f"labels-{n}")
        labels = jumped.select("node", "label")
        if jumped.where("label <> was").isEmpty():
            return labels
