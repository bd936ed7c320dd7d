"""Connected groups of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.session import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of one comparable type -> (node, root), root the smallest node of the group.

    Each round every node takes the smallest label among its neighbours and then the label of that
    label, so the number of rounds grows with the logarithm of the longest chain. Minima are
    combined map-side and no group is ever gathered. Null ends and loops are ignored; an empty
    table gives an empty result. Every round is written to the shared folder. Labels only ever get
    smaller, so rounds end by themselves: when none has changed.
    """
    both = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    pairs = materialise(both.union(both.select("b", "a")).distinct(), "edges")
    labels = pairs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root"))
    labels = materialise(labels, "labels")
    while True:
        near = pairs.join(labels.withColumnsRenamed({"node": "b", "root": "far"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("far").alias("far"))
        step = labels.join(near, "node", "left").select("node", F.col("root").alias("before"), F.least("root", F.coalesce("far", "root")).alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("further"))
        nxt = materialise(step.join(jump, "root", "left").select("node", "before", F.least("root", F.coalesce("further", "root")).alias("root")), "labels")
        labels = nxt.select("node", "root")
        if nxt.where("before <> root").limit(1).count() == 0:
            return labels
