"""Connected components of a table of links, by least label and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import drop, settled


def components(links: DataFrame, folder: str, rounds: int = 60) -> DataFrame:
    """node, component (the least node that the links a, b reach) for each node with a link.

    Each round takes the least label among the neighbours and then the label's own label,
    so chains halve. All steps are joins and partial minima, a round's labels are written
    to the shared folder, and the driver sees one count a round.
    """
    spark = links.sparkSession
    both = settled(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(),
        folder, "links",
    )
    labels = settled(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component"), F.col("a").alias("old")), folder, "labels0")
    for k in range(1, rounds + 1):
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("m"))
        lower = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("component", "m").alias("low"), F.col("component").alias("old"))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("lower"))
        after = lower.join(jump, "low").select("node", F.least("low", "lower").alias("component"), "old")
        labels = settled(after, folder, f"labels{k}")
        drop(spark, f"{folder}/labels{k - 1}")
        if labels.where("component <> old").isEmpty():
            break
    else:
        raise RuntimeError(f"labels still change after {rounds} rounds")
    return labels.select("node", "component")
