"""Groups of a graph whose edges are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.sources.scratch import stored


def groups(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """node, label: the smallest node that edges lead to, for every node of the edges.

    Labels are propagated: a round gives each node the smallest label around it, and then the label that this node's label has by
    itself, so a path of n nodes takes about log n rounds. Neighbours of a hub are minima before they are shuffled. Each round's
    labels are a stored table; the last round is the one that changes none.
    """
    both = stored(edges.where(F.col(a) != F.col(b)).select(F.explode(F.array(F.struct(F.col(a).alias("node"), F.col(b).alias("to")), F.struct(F.col(b).alias("node"), F.col(a).alias("to")))).alias("x")).select("x.*").distinct(), "edges")
    labels = stored(both.groupBy("node").agg(F.least(F.min("to"), F.col("node")).alias("label")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("node").alias("to"), "label"), "to").groupBy("node").agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        above = lower.select(F.col("node").alias("label"), F.col("label").alias("further"))
        rows = stored(lower.join(above, "label").select("node", "old", F.least("label", "further").alias("label")), "labels")
        labels = rows.select("node", "label")
        if rows.where("label <> old").isEmpty():
            return labels
    raise RuntimeError("labels haven't settled")
