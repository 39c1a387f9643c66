"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for every node of ``links``, the smallest node that it reaches.

    In each round every node points to its least neighbour (or itself), links are renamed to where their ends point,
    and those within one node go.  A star is done in one round, a path of n in about log n.  Each round's small tables are
    written to the shared folder.  Minima are pre-aggregated on the map side, and a hub's links are joined
    by a sort-merge join whose large partitions AQE splits.  No links give no rows.
    """
    links = written(links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a < b").distinct())
    labels = written(links.select(F.col("a").alias("node")).union(links.select("b")).distinct().select("node", F.col("node").alias("component")))
    while not links.isEmpty():
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        points = written(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("from"), F.least("a", "least").alias("to")))
        # one jump more: where it points, that points further
        further = points.select(F.col("from").alias("to"), F.col("to").alias("beyond"))
        points = written(points.join(further, "to").select("from", F.col("beyond").alias("to")))
        ends = links.join(points.select(F.col("from").alias("a"), F.col("to").alias("to_a")), "a").join(points.select(F.col("from").alias("b"), F.col("to").alias("to_b")), "b")
        links = written(ends.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).filter("a < b").distinct())
        moved = labels.join(points.select(F.col("from").alias("component"), "to"), "component", "left")
        labels = written(moved.select("node", F.coalesce("to", "component").alias("component")))
    return labels
