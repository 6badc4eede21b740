"""Connected components of an edge table by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import stage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Map each node of ``edges`` to the smallest node it reaches: columns ``node``, ``root``.

    Every round a node takes the smallest label among itself and its neighbours, then the label
    of its label. Tables are written to the shared folder between rounds; only a change count
    comes to the driver. Self-loops and repeated edges are harmless; rows with a null end are
    ignored; an empty table gives an empty result.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    both = stage(pairs.union(pairs.select("b", "a")).toDF("node", "near").distinct(), "edges")
    labels = stage(both.groupBy("node").agg(F.min("near").alias("m"))
                   .select("node", F.least("node", "m").alias("root")), "labels")
    while True:
        near = (both.join(labels.withColumnsRenamed({"node": "near", "root": "low"}), "near")
                .groupBy("node").agg(F.min("low").alias("low")))
        hooked = (labels.join(near, "node")
                  .select("node", F.col("root").alias("old"), F.least("root", "low").alias("up")))
        jump = labels.select(F.col("node").alias("up"), F.col("root").alias("top"))
        new = stage(hooked.join(jump, "up", "left")
                    .select("node", "old", F.coalesce("top", "up").alias("root")), "labels")
        changed = new.where("old <> root").limit(1).count()
        labels = new.select("node", "root")
        if not changed:
            return labels
