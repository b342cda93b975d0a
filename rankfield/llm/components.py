"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links(a, b)``; a component is named by its smallest id.

    Each round takes the smallest label among neighbours, then follows labels one step, so long
    chains shorten by halves. Both joins are plain equi-joins whose large keys adaptive execution
    splits; sums are pre-aggregated. Every round is written to the shared folder.
    """
    both = stage(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "links",
    )
    labels = stage(
        both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "labels"
    )
    while True:
        near = (
            both.join(labels, both.a == labels.id)
            .groupBy(F.col("b").alias("id"))
            .agg(F.min("component").alias("near"))
        )
        lower = labels.join(near, "id").select(
            "id", F.least("component", "near").alias("component"), F.col("component").alias("old")
        )
        hop = lower.select(F.col("id").alias("component"), F.col("component").alias("hop"))
        new = stage(
            lower.join(hop, "component").select(
                "id", F.least("component", "hop").alias("component"), "old"
            ),
            "labels",
        )
        labels = new.select("id", "component")
        if new.filter("component <> old").isEmpty():
            return labels
