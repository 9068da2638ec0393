"""Connected components by alternating large and small stars; rounds are written to the shared folder.

Nodes are of any type that has an order, also structs (a key and a cell), which spares text keys.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kept(df: DataFrame) -> DataFrame:
    """df, written as a table to the folder that spark.checkpoint.dir names (one that lasts as long as this process where that is unset, on one machine).

    That cuts the lineage, survives lost executors, and gives the plans that follow the table's true size.
    """
    spark = df.sparkSession
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame, rows: int, many: int = 1 << 18) -> DataFrame:
    """df, never broadcast if it may have `many` rows: Spark goes by a table's compressed bytes, and numbers that follow each other have hardly any."""
    return df.hint("merge") if rows >= many else df


def _least(edges: DataFrame) -> DataFrame:
    """u, m and n: each u's least neighbour, and how many it has; summed up before the shuffle."""
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))


def _met(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """edges with their u's m.  A u with a 4096th of all edges or more (so 4096 of them at most) meets them by a broadcast, as one task must not hold a large star."""
    if total < 4096:
        return edges.join(least.select("u", "m"), "u")
    bound = total / 4096
    hot = F.broadcast(least.where(F.col("n") >= bound).select("u", "m"))
    rest = edges.join(hot.select("u"), "u", "left_anti").join(shuffled(least.where(F.col("n") < bound).select("u", "m"), total), "u")
    return edges.join(hot, "u").unionByName(rest)


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node and root, the least node of its component, for every node; links have columns u and v.

    A large star hangs a node's larger neighbours on the least of its neighbourhood, a small star hangs it and its smaller ones on the least of these; both shorten
    every path, so few rounds do.  The driver sees a count and a checksum a round.
    """
    edges, seen, most = kept(links.where("u <> v").select("u", "v")), None, 0
    while True:
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            break
        seen, most = state, max(most, state[0])
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _met(both.where("v > u"), _least(both).withColumn("m", F.least("u", "m")), 2 * seen[0])
        edges = kept(large.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = kept(_least(down))
        small = _met(down, least, seen[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = kept(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.select("node").join(shuffled(roots, most), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
