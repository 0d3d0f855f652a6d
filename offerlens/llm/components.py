"""Connected components of an edge table, without gathering a component anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.functions.durable import checkpointed


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row (node, label) per node of `edges`; nodes share a label, the smallest node, if and only if a path joins them.

    Each round, every node takes the smallest label among its neighbours and then its label's label, so paths shorten by
    more than half as labels jump. Only counts reach the driver; each round is written to the shared folder. Edges with a
    null end are ignored, repeated edges and loops change nothing, no edges give no rows.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
    both = checkpointed(pairs.union(pairs.select("v", "u")).distinct())
    labels = checkpointed(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low")).select("node", F.least("node", "low").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        lowered = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        lowered = checkpointed(lowered)
        jump = lowered.select(F.col("node").alias("label"), F.col("label").alias("next"))
        following = checkpointed(lowered.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label")))
        changed = following.filter("label <> old").limit(1).count()
        labels = following.select("node", "label")
        if not changed:
            return labels
