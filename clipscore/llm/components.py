"""Connected components by minimum labels and pointer jumping; every round is a few joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipscore.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """(node, label) for the nodes of ``links`` (a, b): the least node that each can reach.

    A round takes the least label among a node and its neighbours, then the label's own label, so stars
    take two rounds and chains a logarithmic number.  Only the number of changed labels comes
    to the driver.  Minima are formed in the map tasks first, which a node with many links needs; no
    neighbour list is ever gathered.
    """
    both = cut(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    while True:
        heard = both.join(labels.select(F.col("node").alias("a"), "label"), "a").groupBy(F.col("b").alias("node")).agg(F.min("label").alias("heard"))
        told = labels.join(heard, "node").select("node", "label", F.least("label", "heard").alias("least"))
        up = labels.select(F.col("node").alias("least"), F.col("label").alias("up"))
        stepped = cut(told.join(up, "least", "left").select("node", F.least("least", F.coalesce("up", "least")).alias("next"), "label"))
        moved = stepped.where("next <> label").count()
        labels = stepped.select("node", F.col("next").alias("label"))
        if not moved:
            return labels
