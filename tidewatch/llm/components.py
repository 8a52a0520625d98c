"""Connected components of a link table, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.shared import dropped, written


def settled(links: DataFrame) -> bool:
    """Whether every component of links (a > b) is a star already: an id is linked to one smaller id or to larger ones only."""
    end = lambda x, up, down: F.struct(F.col(x).alias("id"), F.lit(up).alias("up"), F.lit(down).alias("down"))
    ends = links.select(F.inline(F.array(end("a", 1, 0), end("b", 0, 1))))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0").isEmpty()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """id, component (smallest id reachable) of every id in links (a, b), as a written table.

    Each round replaces the links by links to minima: first every id's larger neighbours are linked to the
    smallest of its neighbourhood, then its smaller ones. That halves the paths and keeps the
    components, and ends when every component is a star around its smallest id. Hubs are aggregated map-side.
    """
    links = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(most_rounds):
        if settled(links):
            labels = written(links.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()), "labels")
            dropped(links)
            return labels
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, "large")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a <> b").distinct()
        small = written(small, "small")
        dropped(links, large)
        links = small
    raise RuntimeError("the components haven't settled")
