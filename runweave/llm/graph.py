"""Connected components by labels that move to neighbours and jump to the label of their label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runweave.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """`node` and `label`, the smallest node of its component, for every node of `edges` (`a`, `b`). Each round is one
    written table, so no lineage grows and no executor holds labels; rounds grow as the logarithm of a chain's length."""
    links = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label"))
                     .withColumn("moved", F.lit(True)), "labels")
    while not labels.filter("moved").isEmpty():
        near = links.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(
            F.min("label").alias("near"))
        best = labels.select("node", F.col("label").alias("old")).join(near, "node").select("node", "old", F.least("old", "near").alias("best"))
        jump = labels.select(F.col("node").alias("best"), F.col("label").alias("jump"))
        labels = written(best.join(jump, "best").select("node", F.least("best", "jump").alias("label"),
                                                        (F.least("best", "jump") < F.col("old")).alias("moved")), "labels")
    return labels.select("node", "label")
