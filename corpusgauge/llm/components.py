"""Connected components of a link table by alternating stars.

Links stay a distributed table of (a, b). A large star hangs every greater
neighbour of a node on the least one, a small star does so with the lesser ones,
and both are one aggregation with partial minima and one join; a hub is met by a
skew-splittable join, never by a window. Rounds are cut by written tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("a", "b")
    if large:
        both = both.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # small star: edges point from the greater to the lesser node already
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    hung = both.join(least, "a")
    if large:
        out = hung.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select("a", F.col("m").alias("b"))
        )
    return out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``component``, the least id reachable, for every node that is linked
    to a lesser one. ``links`` has columns a and b; NULL ends and loops are ignored."""
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stored(edges, "links")
    seen = None
    while True:
        edges = stored(_star(_star(edges, True), False), "stars")
        # all edges point to a root once no lesser end is itself hung on a node
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
        seen = mark
