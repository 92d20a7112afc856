"""Connected components of an edge table, without the driver seeing nodes or edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import discard, staged


def connected_components(edges: DataFrame) -> DataFrame:
    """node, label (the least node of its component) for every node of ``edges`` (src, dst, longs).

    Each round takes the least label around every node, then follows labels once (pointer jumping); rounds
    end when nothing changes. Minima are combined before the shuffle; labels are written between rounds.
    """
    both = staged(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "edges")
    labels = staged(both.groupBy(F.col("src").alias("node")).agg(F.least(F.col("node"), F.min("dst")).alias("label")), "labels")
    while True:
        around = both.join(labels, both["src"] == labels["node"]).select(F.col("dst").alias("node"), "label")
        least = labels.unionByName(around).groupBy("node").agg(F.min("label").alias("label"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("further"))
        jumped = least.join(jump, F.col("label") == F.col("via")).select("node", F.least("label", "further").alias("label"))
        was = labels.select("node", F.col("label").alias("was"))
        newer = staged(jumped.join(was, "node"), "labels")
        moved = newer.filter("label != was").limit(1).count()
        discard(labels)
        labels = newer.select("node", "label")
        labels._staged_path = newer._staged_path
        if not moved:
            discard(both)
            return labels
