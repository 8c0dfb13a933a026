"""Connected components by alternating large and small stars, on tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, *, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``label`` (the smallest node of the component) for every node of a table of links between longs.

    Each step replaces the links by stars around smaller nodes: only minima are aggregated, never lists of neighbours,
    and steps end when nothing changes, after about the logarithm of the longest path.  Loops and repeated links do no
    harm; links with a null are no links.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    edges = written(links.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).where((x != y)).distinct(), "links")
    state = _sum(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = written(large.distinct(), "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        new = written(small.distinct(), "links")
        before, state = state, _sum(new)
        discard(edges)
        discard(large)
        edges = new
        if state == before:
            break
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stars.unionByName(stars.select(F.col("label").alias("node"), "label").distinct())
