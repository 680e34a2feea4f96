"""Connected components by alternating large and small stars (Kiveris et al.), on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def oriented(edges: DataFrame) -> DataFrame:
    """Distinct edges (u, v) with u > v."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v): each node but the least of its component, and that least node. edges: u, v, in any order."""
    scratch, turn = Scratch(edges.sparkSession, "components"), 0
    e = scratch.keep(oriented(edges), "0")
    while not is_stars(e):
        turn += 1
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = oriented(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(down, "u")
        e = scratch.keep(oriented(hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))), str(turn))
        scratch.drop(str(turn - 1))
    return e


def is_stars(e: DataFrame) -> bool:
    """Whether each node hangs on one node at most, and none that hangs has others hanging on it."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    each = ends.groupBy("x").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return each.where("hangs > 1 or (hangs > 0 and holds > 0)").isEmpty()
