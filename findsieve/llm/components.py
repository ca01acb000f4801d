"""Connected components by least labels and pointer jumping, in Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """node, comp (the least node of the component) for every end of ``edges`` (a long, b long).

    Each round takes the least label among the neighbours and then the label of that label, so the rounds grow with
    the logarithm of a component's width.  Every round is written to the shared folder.
    """
    pairs = edges.where("a <> b").select("a", "b")
    both = cut(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")), "cc")
    while True:
        near = both.join(labels.toDF("b", "l"), "b").groupBy("a").agg(F.min("l").alias("m"))
        least = labels.join(near, labels["node"] == near["a"]).select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        target = labels.toDF("comp", "jump")
        new = cut(least.join(target, "comp", "left").select("node", "old", F.least("comp", F.coalesce("jump", "comp")).alias("comp")), "cc")
        labels = new.select("node", "comp")
        if new.where("old <> comp").isEmpty():
            return labels
