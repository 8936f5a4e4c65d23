"""Connected components of a graph given as edges of 64-bit nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def components(edges: DataFrame) -> DataFrame:
    """(u, v) to (node, component), the component being its least node; edges from a node to itself do not count.

    Labels fall to the least label among neighbours, then to their label's label; each round
    is checkpointed and the rounds end when no label falls. A node with very many edges is
    pre-aggregated on one side of the join and split by adaptive execution on the other.
    """
    both = edges.select("u", "v").filter("u != v")
    both = cut(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least")).select("node", F.least("node", "least").alias("label"))
    while True:
        own = labels.select(F.col("node").alias("v"), F.col("label").alias("theirs"))
        near = both.join(own, "v").groupBy(F.col("u").alias("node")).agg(F.min("theirs").alias("near"))
        fallen = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("next"))
        above = labels.select(F.col("node").alias("next"), F.col("label").alias("up"))
        new = cut(fallen.join(above, "next").select("node", "was", F.least("next", "up").alias("label")))
        if new.filter("was != label").isEmpty():
            return new.select("node", F.col("label").alias("component"))
        labels = new.select("node", "label")
