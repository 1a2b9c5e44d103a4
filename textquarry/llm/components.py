"""Connected components of a set of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """One step: larger (large) or smaller (small) neighbours move to the smallest neighbour."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    if not large:
        both = both.filter("v < u")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = both.join(least, "u").select(F.col("v").alias("b"), F.col("m").alias("a"), "u")
    if large:
        out = moved.filter("b > u").select("a", "b")
    else:
        out = moved.select("a", "b").unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return out.filter("a < b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of links (a, b) but the roots, the smallest of each component.

    The links of every round are written out; the number of rounds grows with the
    logarithm of the longest chain."""
    links = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "links")
    state = None
    while True:
        links = materialize(_stars(_stars(links, True), False), "stars")
        # in a forest of stars every step changes nothing
        new = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == state:
            return links.select(F.col("b").alias("node"), F.col("a").alias("root"))
        state = new
