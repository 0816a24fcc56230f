"""Connected components by alternating large and small stars, with only grouped minima and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that an edge (a, b) of long columns touches; root is the component's least node.

    Loops and repeated edges do no harm; an edge with a null end counts for nothing.  Each round
    is written to the shared folder, so a lost executor costs at most one round.  A node with
    very many edges is a skewed join key, which adaptive execution splits.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(now)
    while state[0]:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("least"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "least").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        following = written(small.union(least).distinct(), "links")
        now, before, state = following, state, _state(following)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
