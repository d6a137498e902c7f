"""Connected components of a table of links, as repeated joins; no group meets in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterlake.llm.storage import stored


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node that it reaches) for the nodes of links (a, b).

    Each round a node takes the smallest label around it and then that label's own label, so the
    distance a label travels doubles with the rounds.  Rounds end when no label changes.
    """
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("other"))
    both = stored(ends.union(ends.select("other", "node")).where("node != other").distinct(), "links")
    labels = stored(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("component")), "labels")
    while True:
        theirs = labels.select(F.col("node").alias("other"), F.col("component").alias("theirs"))
        around = both.join(theirs, "other").groupBy("node").agg(F.min("theirs").alias("theirs"))
        nearer = stored(
            labels.join(around, "node").select("node", "component", F.least("component", "theirs").alias("new")), "labels"
        )
        if nearer.where("new < component").isEmpty():
            return nearer.select("node", "component")
        jump = nearer.select(F.col("node").alias("new"), F.col("new").alias("further"))
        labels = stored(
            nearer.join(jump, "new", "left").select("node", F.coalesce("further", "new").alias("component")), "labels"
        )
