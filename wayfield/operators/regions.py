"""Operators on regions and spawns: containment joins by grid cells, coverage, validation, diff and merge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfield.functions import geometry as G


def region_cells(regions: DataFrame, cell: float) -> DataFrame:
    """Each region once for every grid cell its box touches: what a containment join meets points by."""
    b = regions.where(F.size(F.element_at("rings", 1)) >= 3).withColumn("b", G.box(F.element_at("rings", 1)))
    across = F.sequence(G.cell(F.col("b.x0"), cell), G.cell(F.col("b.x1"), cell))
    return b.withColumn("ix", F.explode(across)).withColumn("iz", F.explode(F.sequence(G.cell(F.col("b.z0"), cell), G.cell(F.col("b.z1"), cell))))


def in_box(x: Column, z: Column, b: Column) -> Column:
    """A cheap test that spares most points the walk along a ring's edges."""
    return (x >= b["x0"]) & (x <= b["x1"]) & (z >= b["z0"]) & (z <= b["z1"])


def points_in_regions(points: DataFrame, regions: DataFrame, cell: float = 50.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """points' columns with name, nr, rings and box of every region that contains them: an equi-join by cell (and keys), the box, then the exact test."""
    placed = points.withColumns({"ix": G.cell(F.col("x"), cell), "iz": G.cell(F.col("z"), cell)})
    met = placed.join(region_cells(regions.select(*keys, "name", "nr", "rings"), cell), [*keys, "ix", "iz"])
    x, z = F.col("x"), F.col("z")
    return met.where(in_box(x, z, F.col("b")) & G.contains(x, z, F.col("rings"))).select(*points.columns, "name", "nr", "rings", "b")


def ring_counts(points: DataFrame, regions: DataFrame, *keys: str, cell: float = 50.0) -> DataFrame:
    """keys, name, outline and hole: how many of a key's points each region's outline and its first hole hold; points meet rings by the cells of all rings' box.

    Regions of keys without points are left out.
    """
    box = G.box(F.flatten("rings"))
    spots = regions.select(*keys, "name", "rings", box.alias("b"))
    spots = spots.withColumn("ix", F.explode(F.sequence(G.cell(F.col("b.x0"), cell), G.cell(F.col("b.x1"), cell)))).withColumn("iz", F.explode(F.sequence(G.cell(F.col("b.z0"), cell), G.cell(F.col("b.z1"), cell))))
    placed = points.select(*keys, "x", "z", G.cell(F.col("x"), cell).alias("ix"), G.cell(F.col("z"), cell).alias("iz"))
    met = placed.join(spots, [*keys, "ix", "iz"]).where(in_box(F.col("x"), F.col("z"), F.col("b")))
    flags = met.select(*keys, "name", G.ring_flags(F.col("x"), F.col("z"), F.col("rings")).alias("f"))
    n = flags.groupBy(*keys, "name").agg(F.count_if(F.get("f", F.lit(0))).alias("outline"), F.count_if(F.coalesce(F.get("f", F.lit(1)), F.lit(False))).alias("hole"))
    there = regions.select(*keys, "name").join(points.select(*keys).distinct(), list(keys), "left_semi")
    return there.join(n, [*keys, "name"], "left").na.fill(0, ["outline", "hole"])


def region_at(points: DataFrame, regions: DataFrame, key: str, same_floor: float = 5.0, cell: float = 50.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, key and name: of the regions around a point those on the nearest floor (within `same_floor` of it), of these the one with the smallest box, the first (nr) on ties.

    A region's floor at a point is the height of its outline's nearest corner.
    """
    found = points_in_regions(points, regions, cell, keys)
    found = found.withColumn("dy", F.abs(F.col("y") - G.nearest_height(F.col("x"), F.col("z"), F.element_at("rings", 1))))
    span = (F.col("b.x1") - F.col("b.x0")) * (F.col("b.z1") - F.col("b.z0"))
    near = found.groupBy(*keys, key).agg(F.collect_list(F.struct(span.alias("span"), "nr", "name", "dy")).alias("r"))  # the few regions around one point
    best = F.array_min(F.transform("r", lambda r: r["dy"])) + same_floor
    return near.select(*keys, key, F.array_min(F.filter("r", lambda r: r["dy"] <= best))["name"].alias("name"))


def coverage(spawns: DataFrame, points: DataFrame, regions: DataFrame) -> DataFrame:
    """region, total, inside and level: how many points of a region's own mobs lie inside it."""
    members = spawns.select(F.col("id").alias("mob_id"), F.explode("regions").alias("name"))
    boxed = regions.select("name", "rings", G.box(F.element_at("rings", 1)).alias("b"))
    met = points.select("mob_id", "x", "z").join(members, "mob_id").join(boxed, "name")
    x, z = F.col("x"), F.col("z")
    held = in_box(x, z, F.col("b")) & G.contains(x, z, F.col("rings"))
    sums = met.groupBy(F.col("name").alias("region")).agg(F.count(F.lit(1)).alias("total"), F.count_if(held).alias("inside"))
    share = F.col("inside") / F.col("total")
    return sums.withColumn("level", F.when(share < 0.7, "warn").when(share < 0.9, "info").otherwise("ok"))


def member_coverage(spawns: DataFrame, points: DataFrame, regions: DataFrame) -> DataFrame:
    """region, mob_id, n and coverage: for each member of a region how many points it has and which share of them lies inside."""
    members = spawns.select(F.col("id").alias("mob_id"), F.explode("regions").alias("name"))
    boxed = regions.select("name", "rings", G.box(F.element_at("rings", 1)).alias("b"))
    met = points.select("mob_id", "x", "z").join(members, "mob_id").join(boxed, "name")
    x, z = F.col("x"), F.col("z")
    held = in_box(x, z, F.col("b")) & G.contains(x, z, F.col("rings"))
    return met.groupBy(F.col("name").alias("region"), "mob_id").agg(F.count(F.lit(1)).alias("n"), F.avg(held.cast("double")).alias("coverage"))


def status(regions: Column, path: Column, at: Column) -> Column:
    """How a spawn is placed: region, route, fixed or nowhere."""
    return F.when(F.size(regions) > 0, "region").when(F.size(path) > 0, "route").when(at.isNotNull(), "fixed").otherwise("nowhere")


def diff(base: DataFrame, head: DataFrame, key: str = "id") -> DataFrame:
    """key and kind (added, removed, changed, unchanged) with both sides' columns; nulls compare as equal."""
    others = [c for c in base.columns if c != key]
    b = base.select(key, F.lit(True).alias("in_base"), *(F.col(c).alias("base_" + c) for c in others))
    h = head.select(key, F.lit(True).alias("in_head"), *(F.col(c).alias("head_" + c) for c in others))
    same = reduce(lambda x, y: x & y, (F.col("base_" + c).eqNullSafe(F.col("head_" + c)) for c in others))
    kind = F.when(F.col("in_base").isNull(), "added").when(F.col("in_head").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    return b.join(h, key, "full_outer").withColumn("kind", kind).drop("in_base", "in_head")


def merge(base: DataFrame, theirs: DataFrame, ours: DataFrame, key: str, value: str) -> DataFrame:
    """key, value and conflict of a three-way merge: a change on one side wins, on both sides ours stays and is a conflict if they differ.

    Keys that are in the base alone, or that one side removed and the other left as it was, go.
    """
    side = lambda df, s: df.select(key, F.col(value).alias(s), F.lit(True).alias("in_" + s))
    all_ = side(theirs, "t").join(side(ours, "o"), key, "full_outer").join(side(base, "b"), key, "left")
    b, t, o = (F.struct(F.coalesce("in_" + s, F.lit(False)).alias("i"), F.col(s).alias("v")) for s in "bto")
    pick = F.when(o.eqNullSafe(b), t).when(t.eqNullSafe(b) | t.eqNullSafe(o), o).otherwise(o)
    conflict = ~o.eqNullSafe(b) & ~t.eqNullSafe(b) & ~t.eqNullSafe(o)
    return all_.select(key, pick.alias("p"), conflict.alias("conflict")).where("p.i").select(key, F.col("p.v").alias(value), "conflict")


def findings(spawns: DataFrame, regions: DataFrame) -> DataFrame:
    """level, code, subject: what a check of a zone says of its regions and spawns."""
    row = lambda df, level, code, subject: df.select(F.lit(level).alias("level"), F.lit(code).alias("code"), subject.cast("string").alias("subject"))
    names = spawns.select("id", "x", "z", F.explode("regions").alias("name"))
    small = regions.where(F.exists("rings", lambda r: F.size(r) < 3))
    unused = regions.join(names.select("name").distinct(), "name", "left_anti")
    undefined = names.join(regions.select("name"), "name", "left_anti")
    outside = names.join(regions, "name").groupBy("id").agg(F.bool_or(G.contains(F.col("x"), F.col("z"), F.col("rings"))).alias("inside")).where(~F.col("inside"))
    return reduce(
        DataFrame.unionByName,
        [
            row(small, "error", "ring", F.col("name")),
            row(unused, "warn", "no-spawns", F.col("name")),
            row(undefined, "error", "undefined-region", F.col("id")),
            row(outside, "info", "outside", F.col("id")),
            row(spawns.where(F.size("regions") == 0), "info", "unassigned", F.col("id")),
        ],
    )
