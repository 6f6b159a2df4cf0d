"""Connected components of links by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One round: each node's neighbours (the larger ones, or the smaller ones) are hung under its least neighbour."""
    pairs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = pairs.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable): one row for each node with a link to another. edges: u, v long.

    Neighbourhoods are only aggregated (combined before the shuffle) and joined, never gathered, and each round is written
    to the shared folder. The number of rounds grows with the logarithm of the links' longest path.
    """
    first = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = common.materialize(common.few(first, edges))
    while True:
        big = common.materialize(common.few(_stars(now.df, True), now.df))
        then = common.materialize(common.few(_stars(big.df, False), big.df))
        big.drop()
        now.drop()
        now = then
        # done when every node hangs under one root: no node has two parents, and no parent hangs itself
        e = now.df
        parents = e.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        open_ = parents.where("n > 1").select("u").unionByName(e.select(F.col("v").alias("u")).join(parents, "u", "left_semi"))
        if open_.isEmpty():
            break
    return now.df.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.df.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
