"""Connected components by minimum labels with pointer jumping; every round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges(a, b): label is the smallest node that can be reached. Empty edges: no rows.

    Rounds are logarithmic in the longest path; each is one join along the edges and one along the labels. Only counts reach
    the driver.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).filter("a <> b").distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "b", "label": "l"}), "b").groupBy("a").agg(F.min("l").alias("l"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("label", "l").alias("next"), "label")
        jump = step.select(F.col("node").alias("next"), F.col("next").alias("after"))
        new = step.join(jump, "next", "left").select("node", F.least(F.coalesce("after", "next"), "next").alias("label"), F.col("label").alias("old"))
        new = stored(new, "labels")
        if new.filter("label <> old").limit(1).count() == 0:
            return new.select("node", "label")
        labels = new.select("node", "label")
