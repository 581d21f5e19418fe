"""Connected components of a table of links, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, salted_join


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """One star step: the neighbours of each node u (large: those above u; else u and those below) link to the least of them."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("low"), F.count(F.lit(1)).alias("n")).withColumn("low", F.least("low", "u"))
    moved = salted_join(both, least, "u", "n", F.col("v"))
    if large:
        out = moved.filter("v > u").select(F.col("v").alias("a"), F.col("low").alias("b"))
    else:
        own = least.select(F.col("u").alias("a"), F.col("low").alias("b"))
        out = moved.select(F.col("v").alias("a"), F.col("low").alias("b")).unionByName(own)
    return out.filter("a <> b").distinct()


def components(links: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(a, b): every node that has a link to another, but for the least of its component, with that least node b.

    links: (a, b) of one orderable type, without nulls; loops and repeats don't matter. Large and small stars alternate until the
    links stay as they are, which takes a logarithmic number of rounds; each round is written to the shared folder, and only a
    count and a hash sum come to the driver.
    """
    links, path = scratch.keep(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(rounds):
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark or not now[0]:
            return links
        mark = now
        links, new = scratch.keep(_stars(_stars(links, True), False))
        scratch.drop(path)
        path = new
    raise RuntimeError(f"components did not settle in {rounds} rounds")
