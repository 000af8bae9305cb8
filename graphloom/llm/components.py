"""Connected components by alternating star contractions, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: every neighbour of a node is linked to the least of them instead."""
    if large:
        sides = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        sides = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = sides.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = sides.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """links(a, b), any order, repeats allowed -> (id, component): the least id that each linked id
    reaches.  Ids without a link to another id, and links with a null side, have no row.  The rounds
    grow with the logarithm of the longest path; each is written to the shared folder.  A hub's
    neighbours meet its minimum in a join, which adaptive execution splits, never in one task's list."""
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seal = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seal or not now[0]:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        seal, old = now, edges
        edges = written(_stars(_stars(edges, True), False), "edges")
        dropped(old)
