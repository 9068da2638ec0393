"""Connected components of a table of links, by alternating large and small stars.

Each round is two group-bys and joins; minima are summed up before the shuffle, and nodes with very many
links meet their minimum by a broadcast of 4096 rows at most, so a star's centre is no hot key.  Every round is written to the
shared folder, in files by its number of links, which cuts the lineage; the driver keeps a count and a checksum alone.

Nulls and odd cases: a link needs two nodes (rows with a null are left out); links of a node with itself and repeated links change nothing; no links give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, stage


def _large_star(e: DataFrame, total: int) -> DataFrame:
    """Larger neighbours of a node move to the least of its neighbourhood."""
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("w_size")).select("u", F.least("u", "m").alias("m"), "w_size")
    return hot_join(both.where("v > u"), least, ["u"], "w_size", 2 * total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame, total: int) -> DataFrame:
    """A node and its smaller neighbours move to the least of these."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("w_size"))
    moved = hot_join(down, least, ["u"], "w_size", total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) of every node with links; links: columns u and v."""
    edges, seen = stage(links.where("u <> v").select("u", "v")), None
    while True:
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            break
        seen = state
        edges = stage(_small_star(stage(_large_star(edges, seen[0]), seen[0]), seen[0]), seen[0])
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
