"""Whole edits of a zone: regions built around chosen mobs and given to them, refits, what a region covers, routes in place of regions, floors of everything.

Spawns have zone, id, name, x, y, z (null without a point) and regions (names); points zone, mob_id, seq, x, y, z; regions zone, name, nr, floor and rings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfield.functions import geometry as G
from wayfield.operators import graph, raster, regions as R, routes, surfaces
from wayfield.operators.lists import floor_votes


def ring_rows(corners: DataFrame, *keys: str) -> DataFrame:
    """keys and rings, the outline first, of rows keys, ring, hole, at, x, y, z."""
    one = corners.groupBy(*keys, "ring", "hole").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.struct("x", "z", "y").alias("p")))), lambda r: r["p"]).alias("r"))
    return one.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("hole", "ring", "r"))), lambda r: r["r"]).alias("rings"))


def build_regions(spawns: DataFrame, points: DataFrame, taken: DataFrame, cell: float = 6.0, close: int = 2) -> tuple[DataFrame, DataFrame]:
    """The regions around chosen spawns' trails (zone, place, name, rings), the biggest first, and each spawn's region (zone, id, name; those in none are left out).

    A zone's regions are named after the name most of its chosen spawns have (the first by id on ties), numbered from the second on; a name in use (taken: zone,
    name) gets the next free number beyond the regions' count.  A spawn belongs to the first region that holds its trail's first point, or its own point if it has no trail.
    """
    mine = graph.kept(points.join(spawns.select(F.col("id").alias("mob_id")), "mob_id", "left_semi").select("zone", "mob_id", "seq", "x", "y", "z"))
    built = graph.kept(ring_rows(raster.regions_from_points(mine, "zone", cell, close), "zone", "place"))
    n = spawns.groupBy("zone", "name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    base = n.groupBy("zone").agg(F.max_by("name", F.struct("n", -F.col("first"))).alias("base")).select("zone", F.regexp_replace(F.lower("base"), "[^a-z0-9_]", "_").alias("base"))
    many = built.groupBy("zone").agg(F.count(F.lit(1)).cast("int").alias("many"))
    used = taken.groupBy("zone").agg(F.collect_set("name").alias("used"))  # a zone's names, as its file holds them
    named = built.join(base, "zone").join(many, "zone").join(used, "zone", "left").withColumn("used", F.coalesce("used", F.array().cast("array<string>")))
    plain = F.when(F.col("place") == 1, F.col("base")).otherwise(F.concat_ws("_", "base", "place"))
    clash = F.array_contains("used", plain)
    nth = F.sum(clash.cast("int")).over(Window.partitionBy("zone").orderBy("place"))
    free = F.filter(F.sequence(F.col("many") + 1, 2 * F.col("many") + F.size("used") + 1), lambda i: ~F.array_contains("used", F.concat_ws("_", "base", i)))
    named = named.withColumn("nth", nth).withColumn("name", F.when(clash, F.concat_ws("_", "base", F.get(free, F.col("nth") - 1))).otherwise(plain)).select("zone", "place", "name", "rings")
    start = mine.groupBy("mob_id").agg(F.min_by(F.struct("x", "z"), "seq").alias("p"))
    home = spawns.join(start.withColumnRenamed("mob_id", "id"), "id", "left").select("zone", "id", F.coalesce("p", F.when(F.col("x").isNotNull(), F.struct("x", "z"))).alias("p")).where("p is not null").select("zone", "id", "p.x", "p.z")
    held = R.points_in_regions(home, named.withColumn("nr", F.col("place")).withColumn("floor", F.lit(0.0)), keys=("zone",))
    return named, held.groupBy("zone", "id").agg(F.min_by("name", "nr").alias("name"))


def refitted(spawns: DataFrame, points: DataFrame, **options) -> DataFrame:
    """zone, name, rings and pieces: each region's shape around the trails of the mobs it is given to, the biggest piece, and how many there were; regions without trails are left out."""
    member = spawns.select("zone", F.col("id").alias("mob_id"), F.explode("regions").alias("name"))
    key = F.concat_ws("/", F.col("zone").cast("string"), "name").alias("key")
    mine = points.select("mob_id", "x", "y", "z").join(member, "mob_id").select(key, "x", "y", "z")
    corners = graph.kept(raster.regions_from_points(mine, "key", **options))
    pieces = corners.groupBy("key").agg(F.max("place").alias("pieces"))
    rings = ring_rows(corners.where("place = 1"), "key").join(pieces, "key")
    return rings.join(member.select(key, "zone", "name").distinct(), "key").select("zone", "name", "rings", "pieces")


def assigned_inside(spawns: DataFrame, regions: DataFrame, name: str, remove: bool = False) -> DataFrame:
    """spawns with regions changed: those whose own point the region covers, on its floor, belong to it alone, or to none (remove)."""
    at = R.region_at(spawns.where("x is not null").select("zone", "id", "x", "y", "z"), regions, "id", keys=("zone",)).withColumnRenamed("name", "w_name")
    met = spawns.join(at, ["zone", "id"], "left")
    to = F.array().cast("array<string>") if remove else F.array("w_name")
    return met.withColumn("regions", F.when(F.coalesce(F.col("w_name") == name, F.lit(False)), to).otherwise(F.col("regions"))).drop("w_name")


def covered_by(spawns: DataFrame, regions: DataFrame) -> DataFrame:
    """zone, id, now and name: for each spawn on a region's ground what it is given to and the region that covers it, as a list for one region is cut from it."""
    at = R.region_at(spawns.where("x is not null").select("zone", "id", "x", "y", "z"), regions, "id", keys=("zone",))
    return spawns.select("zone", "id", F.array_join("regions", ",").alias("now")).join(at, ["zone", "id"])


def patrols(spawns: DataFrame, points: DataFrame, least: int = 30, tries: int = 3, **options) -> DataFrame:
    """region, lead, coverage, legs, members: the route that takes a region's place, traced from the best explained of the `tries` members with most samples.

    A region none of whose members repeats a route has its first member as lead and no legs; one without members is left out.
    """
    member = spawns.select(F.col("id").alias("mob_id"), F.explode("regions").alias("region"))
    n = points.groupBy("mob_id").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("region").orderBy(F.desc("n"), "mob_id")
    asked = graph.kept(member.join(n, "mob_id").where(F.col("n") >= least).withColumn("k", F.row_number().over(order)).where(F.col("k") <= tries))
    found = routes.traced(points.join(asked.select("mob_id"), "mob_id", "left_semi"), **options).select("mob_id", "coverage", "legs")
    best = asked.join(found, "mob_id").groupBy("region").agg(F.max_by(F.struct(F.col("mob_id").alias("lead"), "coverage", "legs"), F.struct("coverage", -F.col("k"))).alias("b"))
    all_ = member.groupBy("region").agg(F.min("mob_id").alias("first"), F.array_sort(F.collect_set("mob_id")).alias("members"))
    return all_.join(best, "region", "left").select("region", F.coalesce("b.lead", "first").alias("lead"), "b.coverage", "b.legs", "members")


def floors(spawns: DataFrame, points: DataFrame, regions: DataFrame, triangles: DataFrame) -> DataFrame:
    """zone, kind, key and map: which map's ground trails (by their middle sample), regions (by most corners of the outline) and spawns stand on; null where it isn't known.

    A spawn stands where its first region does, else its route's first leg, else its own point, else its trail.  spawns have path (legs) besides; triangles map.
    """
    place = Window.partitionBy("mob_id").orderBy("seq")
    middle = points.withColumns({"k": F.row_number().over(place) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy("mob_id"))}).where("k = floor(n / 2)")
    asked = lambda rows, kind, key, x, y, z: rows.select("zone", F.struct(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), (F.col("at") if kind == "corner" else F.lit(0)).alias("at")).alias("id"), F.col(x).alias("x"), F.col(y).alias("y"), F.col(z).alias("z"))
    corners = regions.select("zone", "name", F.posexplode(F.element_at("rings", 1)).alias("at", "p"))
    routed = spawns.where(F.size("path") > 0).withColumn("leg", F.element_at("path", 1))
    points_ = asked(middle, "trail", "mob_id", "x", "y", "z").unionByName(asked(corners, "corner", "name", "p.x", "p.y", "p.z"))
    points_ = points_.unionByName(asked(routed, "leg", "id", "leg.x", "leg.y", "leg.z")).unionByName(asked(spawns.where("x is not null"), "point", "id", "x", "y", "z"))
    at = graph.kept(surfaces.maps_under(points_, triangles, "zone").select("zone", "id.kind", "id.key", "id.at", "map"))
    votes = floor_votes(at.where("kind = 'corner'").select("zone", F.col("key").alias("name"), "at", F.col("map").alias("floor")))
    by_region = regions.select("zone", "name").join(votes, ["zone", "name"], "left").select("zone", F.lit("region").alias("kind"), F.col("name").alias("key"), F.col("floor").alias("map"))
    trails_ = at.where("kind = 'trail'").select("zone", "kind", "key", "map")
    one = lambda kind: at.where(F.col("kind") == kind).select("zone", "key", F.col("map").alias(kind), F.lit(True).alias("has_" + kind))
    s = spawns.select("zone", F.col("id").cast("string").alias("key"), F.element_at(F.when(F.size("regions") > 0, F.col("regions")), 1).alias("name"))
    s = s.join(votes.withColumnRenamed("floor", "region"), ["zone", "name"], "left")
    for kind in ("leg", "point"):
        s = s.join(one(kind), ["zone", "key"], "left")
    s = s.join(trails_.select("key", F.col("map").alias("trail")), "key", "left")
    found = F.when(F.col("name").isNotNull(), F.col("region")).when(F.col("has_leg"), F.col("leg")).when(F.col("has_point"), F.col("point")).otherwise(F.col("trail"))
    return trails_.unionByName(by_region).unionByName(s.select("zone", F.lit("spawn").alias("kind"), "key", found.alias("map")))
