"""Connected components of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

#: Rows of links that one file holds: they are small, and rounds are many.
ROWS_A_FILE = 500_000


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (node, root), written: the smallest node that each linked node reaches.

    A round aggregates the least neighbour of every node and points neighbours there; it ends
    when no pointer moves. Sums over the links tell that, nothing is brought to the driver but
    two numbers a round. A node with very many links has one row on the joins' right side,
    which is a table of its own, so that the links' side can be split where it is skewed. A
    round's tables go with the next, and have as many files as their rows ask for.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    edges = written(edges, "edges")
    before, rows = None, edges.count()
    while True:
        slim = lambda df, name: written(df.coalesce(1 + rows // ROWS_A_FILE), name)  # noqa: B023, E731
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).union(edges.select(F.col("v"), F.col("u")))
        least = slim(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m")), "least")
        large = both.filter("y > x").join(least, "x").select(F.col("y").alias("v"), F.col("m").alias("u"))
        large = slim(large.distinct(), "large")
        low = slim(large.groupBy("v").agg(F.min("u").alias("m")), "low")
        small = large.join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).filter("v <> u")
        after = slim(small.union(low.select("v", F.col("m").alias("u"))).distinct(), "edges")
        for used in (edges, least, large, low):
            discard(used)
        edges = after
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
        before, rows = now, now[0]
