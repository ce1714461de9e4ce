"""Connected components of an edge table by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import staged


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): for each node that has an edge, the smallest node id of its component.

    A round gives every node the least label among itself and its neighbours, then jumps to that label's label,
    so a chain of n nodes takes about log2(n) rounds. Each round is a staged table; nothing but a count of
    changes comes to the driver."""
    both = staged(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y").distinct())
    both = both.union(both.select(F.col("y").alias("x"), F.col("x").alias("y")))
    labels = staged(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        to = labels.select(F.col("node").alias("y"), F.col("label").alias("l"))
        near = both.join(to, "y").groupBy("x").agg(F.min("l").alias("m")).select(F.col("x").alias("node"), "m")
        hooked = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        # hooking: the old label's node also takes the least new label of those that point to it
        roots = hooked.where("label < old").groupBy(F.col("old").alias("node")).agg(F.min("label").alias("r"))
        hooked = staged(hooked.join(roots, "node", "left").select("node", "old", F.least("label", F.coalesce("r", "label")).alias("label")))
        jump = hooked.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = staged(hooked.join(jump, "label").select("node", "old", F.least("label", "up").alias("label")))
        if new.where("label <> old").limit(1).count() == 0:
            return new.select("node", "label")
        labels = new.select("node", "label")
