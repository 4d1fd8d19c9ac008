"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passages.session import checkpoint_dir


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every end of ``links(a, b)``; component is the smallest node that links reach.

    Rounds of "take the smallest label around you, then the label of your label"; a round aggregates before it
    shuffles, so a node with very many links is no single task's load. Links with a null end are ignored."""
    checkpoint_dir(links.sparkSession)
    ends = links.select("a", "b").dropna()
    edges = ends.union(ends.select("b", "a")).toDF("node", "other").distinct().checkpoint()
    labels = edges.groupBy("node").agg(F.least("node", F.min("other")).alias("label"))
    while True:
        labels = labels.checkpoint()
        near = edges.join(labels.toDF("other", "near"), "other").groupBy("node").agg(F.min("near").alias("near"))
        met = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.toDF("label", "further")
        step = met.join(jump, "label", "left").select("node", "old", F.least("label", "further").alias("label")).checkpoint()
        labels = step.select("node", "label")
        if step.filter("label < old").isEmpty():
            return labels.toDF("node", "component")
