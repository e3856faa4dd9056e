"""Connected components of a graph given as a DataFrame of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, table


def connected(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of ``links`` (a, b); a written table.

    Labels shrink along links and then along themselves (pointer jumping), so chains take a logarithmic number of
    rounds. Each round is written; links and labels never come to the driver.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    both = table(both, "cc-links")
    labels = table(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("component")), "cc-labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        low = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("low"))
        over = labels.select(F.col("node").alias("low"), F.col("component").alias("next"))
        new = table(low.join(over, "low").select("node", "was", F.least("low", "next").alias("component")), "cc-labels")
        moved = new.where("component != was").limit(1).count()
        drop_table(labels)
        path, labels = new._sl_path, new.drop("was")
        labels._sl_path = path
        if not moved:
            drop_table(both)
            return labels
