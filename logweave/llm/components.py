"""Connected components of a link table by Spark joins (labels never reach the driver)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_table


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` (smallest node of the component) of all nodes with a link.

    Each round takes the smallest label among a node's neighbours and then the label of
    that label, so chains shorten by at least half a round; every round is written to the
    shared folder, which keeps the lineage short.
    """
    edges = shared_table(links.select(F.col(a).alias("u"), F.col(b).alias("v"))
                         .unionByName(links.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct(), "edges")
    labels = shared_table(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("component"))
                          .withColumnRenamed("u", "node"), "labels")
    while True:
        near = (edges.join(labels.select(F.col("node").alias("v"), "component"), "v")
                .groupBy("u").agg(F.min("component").alias("near")).withColumnRenamed("u", "node"))
        own = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("best"))
        jump = labels.select(F.col("node").alias("best"), F.col("component").alias("next"))
        step = shared_table(own.join(jump, "best").select("node", "was", F.least("best", "next").alias("component")), "labels")
        moved = step.where("was <> component").limit(1).count()
        labels = step.select("node", "component")
        if not moved:
            return labels
