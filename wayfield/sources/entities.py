"""The library's entities from the tables of a data set: trail points, regions, spawns and two sides of a zone.

Each function gives a DataFrame with explicit columns; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(ts: Column) -> Column:
    """Whole seconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return (F.datediff(ts, F.lit("1970-01-01").cast("date")) * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).cast("long")


def trail_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """zone, mob_id, seq (capture order), t (seconds), x, y, z and dir (0 to 255)."""
    e = table(spark, sf_dir, "events")
    return e.select(
        (F.col("user_id") % 5).alias("zone"),
        F.col("user_id").alias("mob_id"),
        F.col("event_id").alias("seq"),
        epoch(F.col("ts")).alias("t"),
        F.col("value").alias("x"),
        F.hour("ts").cast("double").alias("y"),
        F.get_json_object("props", "$.k").cast("double").alias("z"),
        (F.col("event_id") % 256).cast("int").alias("dir"),
    )


def _corner(x: Column, z: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), z.cast("double").alias("z"), y.cast("double").alias("y"))


def _square(x0: Column, z0: Column, x1: Column, z1: Column, y: Column) -> Column:
    return F.array(_corner(x0, z0, y), _corner(x1, z0, y), _corner(x1, z1, y), _corner(x0, z1, y))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """zone, name, nr, floor and rings (the outline, then holes; corners as x, z and y): a lattice of overlapping squares."""
    n = F.col("n_nationkey")
    x, z, floor = (n % 5) * 100, F.floor(n / 5) * 20, F.col("n_regionkey") * 5.0
    outline, hole = _square(x - 10, z - 2, x + 110, z + 22, floor), _square(x + 30, z + 5, x + 60, z + 15, floor)
    rings = F.when(n % 3 == 0, F.array(outline, hole)).otherwise(F.array(outline))
    return table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("zone"), F.col("n_name").alias("name"), n.alias("nr"), floor.alias("floor"), rings.alias("rings"))


def zone_regions(spark: SparkSession, sf_dir: str, version: int = 0) -> DataFrame:
    """Regions as people draw them: sloped (y grows by a tenth of x), some crossing themselves (nr % 7 = 3), some with two corners (nr % 11 = 5).

    Version 1 lacks nr % 6 = 4, has those with nr % 6 = 1 wider by 20, and gives those with nr % 6 = 2 a hole.
    """
    n, wide = F.col("n_nationkey"), F.when((F.col("n_nationkey") % 6 == 1) & F.lit(version == 1), 20).otherwise(0)
    x, z, floor = (n % 5) * 100, F.floor(n / 5) * 20, F.col("n_regionkey") * 5.0
    at = lambda cx, cz: _corner(cx, cz, floor + cx * 0.1)
    corners = [at(x - 10, z - 2), at(x + 110 + wide, z - 2), at(x + 110 + wide, z + 22), at(x - 10, z + 22)]
    outline = F.when(n % 11 == 5, F.array(*corners[:2])).when(n % 7 == 3, F.array(corners[0], corners[2], corners[1], corners[3])).otherwise(F.array(*corners))
    hole = F.array(at(x + 30, z + 5), at(x + 60, z + 5), at(x + 60, z + 15), at(x + 30, z + 15))
    holed = (n % 3 == 0) | ((n % 6 == 2) & F.lit(version == 1))
    rings = F.when(holed, F.array(outline, hole)).otherwise(F.array(outline))
    out = table(spark, sf_dir, "nation").where(~((n % 6 == 4) & F.lit(version == 1)))
    return out.select(F.col("n_regionkey").alias("zone"), F.col("n_name").alias("name"), n.alias("nr"), rings.alias("rings"))


def zone_spawns(spark: SparkSession, sf_dir: str, version: int = 0) -> DataFrame:
    """zone, id, name, at, regions, path and loop of placed mobs, in every state that a check knows.

    No point: id % 6 = 0.  No region: id % 4 = 0.  An undefined one besides: id % 17 = 0.  Two of the zone: id % 13 = 0.  A route: id % 9 = 0, of one leg
    where id % 27 = 0, else of three; it loops where id is odd.  Version 1 lacks id % 10 = 9, moves points of id % 7 = 1, routes of id % 18 = 0, and puts
    id % 11 = 2 into the zone's first region.
    """
    c = table(spark, sf_dir, "customer").where(~((F.col("c_custkey") % 10 == 9) & F.lit(version == 1)))
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("zone"), F.col("n_name").alias("own"))
    first = nation.groupBy("zone").agg(F.min("own").alias("first"))
    one = c.join(F.broadcast(nation), "c_nationkey").join(F.broadcast(first), "zone")  # 25 and 5 rows
    i = F.col("c_custkey")
    moved = lambda rule: F.when(rule & F.lit(version == 1), 3.0).otherwise(0.0)
    x, y, z = F.round(F.col("c_acctbal") / 25, 3), F.col("c_nationkey") * 1.0, (i % 100) * 1.0
    point = F.array(x + moved(i % 7 == 1), y, z)
    leg = lambda k: F.struct((x + 10 * k + moved(i % 18 == 0)).alias("x"), y.alias("y"), (z + 5 * k).alias("z"))
    path = F.when(i % 27 == 0, F.array(leg(0))).when(i % 9 == 0, F.array(leg(0), leg(1), leg(2)))
    own = F.when(F.lit(version == 1) & (i % 11 == 2), F.array("first")).when(i % 17 == 0, F.array(F.col("own"), F.lit("NOWHERE"))).when(i % 13 == 0, F.array("own", "first")).otherwise(F.array("own"))
    return one.select(
        "zone", i.alias("id"), F.col("c_mktsegment").alias("name"), F.when(i % 6 != 0, point).alias("at"), F.when((i % 4 != 0) | (F.lit(version == 1) & (i % 11 == 2)), own).alias("regions"),
        path.alias("path"), F.when(path.isNotNull() & (i % 2 == 0), F.lit(False)).alias("loop"),
    )


def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """zone, floor, nr, number, scale, offset_x, offset_y, image: map sheets; a zone may have several for one floor, of which the first (nr) counts."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        (k % 5).alias("zone"), (k % 4).cast("int").alias("floor"), k.alias("nr"), (k % 2).cast("int").alias("number"), (400 + 40 * (k % 7)).cast("int").alias("scale"),
        (-40 - k % 30).cast("int").alias("offset_x"), (-450 - k % 30).cast("int").alias("offset_y"), (k * 10).cast("string").alias("image"),
    )


def spawns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, template, x, y, z of its point, and regions (names; a second one for some)."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    second = nation.select(((F.col("k") + 24) % 25).alias("k2"), F.col("name").alias("name2"))
    c = table(spark, sf_dir, "customer")
    both = c.join(F.broadcast(nation), F.col("c_nationkey") == F.col("k")).join(F.broadcast(second), F.col("c_nationkey") == F.col("k2"))  # 25 rows each
    return both.select(
        F.col("c_custkey").alias("id"),
        F.col("c_mktsegment").alias("template"),
        (F.col("c_acctbal") / 20).alias("x"),
        F.col("c_nationkey").cast("double").alias("y"),
        (F.col("c_custkey") % 100).cast("double").alias("z"),
        F.when(F.col("c_custkey") % 13 == 0, F.array("name", "name2")).otherwise(F.array("name")).alias("regions"),
    )


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of a zone's spawns: id, template, region number."""
    c = table(spark, sf_dir, "customer")
    row = lambda shift: c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("template"), shift.cast("int").alias("region"))
    n, k = F.col("c_nationkey"), F.col("c_custkey")
    return row(n).where("id % 10 <> 0"), row(F.when(k % 11 == 0, (n + 1) % 25).otherwise(n)).where("id % 7 <> 0")
