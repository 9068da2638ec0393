"""Whole zones: their text form, what differs between two versions, merging three, and what a check finds.

Regions have zone, name, nr (place in the file) and rings of corners (x, z, y); spawns have zone, id, name, at (x, y, z or null),
regions (names or null), path (legs or null) and loop.  Everything is an equi-join or a group-by by zone and name or id; the
arrays that are gathered are the corners of one region or the lines of one entry.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfield.functions import geometry as G
from wayfield.operators import regions as R


def corner_text(v: Column) -> Column:
    return F.format_string("[%.2f, %.2f, %.2f]", v["x"], v["y"], v["z"])


def region_text(name: Column, rings: Column) -> Column:
    """The canonical lines of one region: each ring turned to its smallest corner, two decimals."""
    outline = F.transform(G.canonical_ring(F.element_at(rings, 1)), lambda v: F.concat(F.lit("      - "), corner_text(v)))
    holes = F.transform(
        F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))),
        lambda h: F.transform(G.canonical_ring(h), lambda v, i: F.concat(F.when(i == 0, "      -   - ").otherwise("          - "), corner_text(v))),
    )
    head = F.array(F.concat(F.lit("  "), name, F.lit(":")), F.lit("    poly:"))
    return F.array_join(F.concat(head, outline, F.when(F.size(rings) > 1, F.array(F.lit("    holes:"))).otherwise(F.array().cast("array<string>")), F.flatten(holes)), "\n")


def regions_text(regions: DataFrame) -> DataFrame:
    """zone and text of its regions block: by name, with a blank line before each but after one with holes."""
    before = F.lag(F.size("rings") > 1).over(Window.partitionBy("zone").orderBy("name"))
    lines = regions.withColumn("t", F.concat(F.when(F.coalesce(before, F.lit(False)), "").otherwise("\n"), region_text(F.col("name"), F.col("rings")), F.lit("\n")))
    body = lines.groupBy("zone").agg(F.array_sort(F.collect_list(F.struct("name", "t"))).alias("all"))  # the regions of one zone, which are one file
    return body.select("zone", F.concat(F.lit("regions:\n"), F.array_join(F.transform("all", lambda r: r["t"]), "")).alias("text"))


def same_region(a: Column, b: Column) -> Column:
    """Whether two regions' texts agree (null: no region)."""
    return region_text(F.lit("r"), a).eqNullSafe(region_text(F.lit("r"), b))


def diff_regions(base: DataFrame, head: DataFrame) -> DataFrame:
    """zone, name, kind (added, removed, reshaped, unchanged) and, of reshaped ones, corners, holes and the ratio of areas (infinite from none)."""
    side = lambda df, s: df.select("zone", "name", F.col("rings").alias(s))
    both = side(base, "b").join(side(head, "h"), ["zone", "name"], "full_outer")
    kind = F.when(F.col("b").isNull(), "added").when(F.col("h").isNull(), "removed").when(same_region(F.col("b"), F.col("h")), "unchanged").otherwise("reshaped")
    reshaped = lambda c: F.when(F.col("kind") == "reshaped", c)
    was, now = G.region_area(F.col("b")), G.region_area(F.col("h"))
    return both.withColumn("kind", kind).select(
        "zone", "name", "kind",
        reshaped(F.size(F.element_at("b", 1))).alias("from_vertices"), reshaped(F.size(F.element_at("h", 1))).alias("to_vertices"),
        reshaped(F.when(was > 0, now / was).otherwise(F.lit(float("inf")))).alias("area_ratio"),
        reshaped(F.size("b") - 1).alias("from_holes"), reshaped(F.size("h") - 1).alias("to_holes"),
    )


def names_text(regions: Column) -> Column:
    return F.coalesce(F.array_join(regions, ", "), F.lit(""))


def _route(s: str) -> Column:
    path = F.col(s + "_path")
    return F.when(path.isNotNull(), F.to_json(F.struct(path.alias("legs"), F.coalesce(F.col(s + "_loop"), F.lit(False)).alias("loop")))).otherwise("")


def diff_spawns(base: DataFrame, head: DataFrame) -> DataFrame:
    """zone, id, name, kind and what goes with it: added, removed, moved (to other regions), rerouted, relocated (its point, the rest as it was).

    A spawn may be moved and rerouted at once, which is two rows.
    """
    side = lambda df, s: df.select("zone", "id", *(F.col(c).alias(f"{s}_{c}") for c in ("name", "at", "regions", "path", "loop")), F.lit(True).alias(s))
    both = side(base, "b").join(side(head, "h"), ["zone", "id"], "full_outer")
    was, now, rerouted = names_text(F.col("b_regions")), names_text(F.col("h_regions")), _route("b") != _route("h")
    still = (was == "") & (now == "") & F.col("h_path").isNull() & ~rerouted
    kinds = F.when(F.col("b").isNull(), F.array(F.lit("added"))).when(F.col("h").isNull(), F.array(F.lit("removed"))).otherwise(
        F.array_compact(F.array(F.when(was != now, "moved"), F.when(rerouted, "rerouted"), F.when(still & (F.col("b_at") != F.col("h_at")), "relocated")))
    )
    legs = lambda s: F.when(F.col("kind") == "rerouted", F.greatest(F.size(F.coalesce(s + "_path", F.array().cast("array<struct<x:double,y:double,z:double>>"))), F.lit(0)))
    moved = lambda c: F.when((F.col("kind") == "moved") & (c != ""), c)
    return both.withColumn("kind", F.explode(kinds)).select(
        "zone", "id", F.coalesce("h_name", "b_name").alias("name"), "kind", moved(was).alias("from"), moved(now).alias("to"), legs("b").alias("from_legs"), legs("h").alias("to_legs")
    )


def _counted(n: Column, thing: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" " + thing), F.when(n == 1, "").otherwise("s"))


def change_messages(base: tuple[DataFrame, DataFrame], head: tuple[DataFrame, DataFrame]) -> DataFrame:
    """zone and a message that says what was done to it: a title of counts, then the names.  Each side: (regions, spawns)."""
    r, s = diff_regions(base[0], head[0]).where("kind <> 'unchanged'"), diff_spawns(base[1], head[1])
    notes = F.array_compact(F.array(
        F.when(F.col("from_vertices") != F.col("to_vertices"), F.format_string("%d -> %d vertices", "from_vertices", "to_vertices")),
        F.when(F.abs(F.col("area_ratio") - 1) > 0.005, F.concat(F.lit("area "), F.when(F.col("area_ratio") >= 1, "+").otherwise(""), F.format_string("%.0f", (F.col("area_ratio") - 1) * 100), F.lit("%"))),
        F.when(F.col("from_holes") != F.col("to_holes"), F.format_string("%d -> %d holes", "from_holes", "to_holes")),
    ))
    one = lambda k, line: F.sort_array(F.collect_list(F.when(F.col("kind") == k, line)))
    reshaped = F.concat(F.lit("Reshaped "), F.col("name"), F.when(F.size(notes) > 0, F.concat(F.lit(" ("), F.array_join(notes, ", "), F.lit(")"))).otherwise(""))
    rows = r.groupBy("zone").agg(one("added", F.col("name")).alias("added"), one("removed", F.col("name")).alias("removed"), one("reshaped", reshaped).alias("reshaped"))
    who = F.concat_ws(" ", "name", F.col("id").cast("string"))
    order = F.struct("name", "id")
    placed = s.where("kind = 'moved'").groupBy("zone", F.coalesce("to", F.lit("no region")).alias("to")).agg(
        F.min(order).alias("first"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("name", "id", F.concat(who, F.when(F.col("from").isNotNull(), F.concat(F.lit(" (was "), F.col("from"), F.lit(")"))).otherwise("")).alias("t")))).alias("w")
    )  # the spawns placed in one region
    line = F.concat(F.lit("Placed in "), F.col("to"), F.lit(": "), F.array_join(F.transform("w", lambda x: x["t"]), ", "))
    placed = placed.groupBy("zone").agg(F.sum("n").alias("moved"), F.transform(F.array_sort(F.collect_list(F.struct("first", line.alias("t")))), lambda x: x["t"]).alias("into"))
    routes = s.where("kind = 'rerouted'").groupBy("zone").agg(F.count(F.lit(1)).alias("routed"), F.transform(F.array_sort(F.collect_list(F.struct("name", "id", who.alias("t")))), lambda x: x["t"]).alias("routes"))
    zones = reduce(lambda a, b: a.unionByName(b), (x.select("zone") for x in (*base, *head))).distinct()
    all_ = zones.join(rows, "zone", "left").join(placed, "zone", "left").join(routes, "zone", "left")
    none = F.array().cast("array<string>")
    list_ = lambda c: F.coalesce(F.col(c), none)
    count = lambda c: F.size(list_(c))
    mark = lambda c, m: F.when(count(c) > 0, F.concat(F.lit(m), count(c).cast("string")))
    touched = count("added") + count("removed") + count("reshaped")
    title = F.array_compact(F.array(
        F.when(touched > 0, F.concat(F.concat_ws(" ", mark("added", "+"), mark("removed", "-"), mark("reshaped", "~")), F.lit(" region"), F.when(touched == 1, "").otherwise("s"))),
        F.when(F.col("moved") > 0, F.concat(_counted(F.col("moved"), "spawn"), F.lit(" placed"))),
        F.when(F.col("routed") > 0, F.concat(_counted(F.col("routed"), "route"), F.lit(" changed"))),
    ))
    named = lambda c, word: F.when(count(c) > 0, F.array(F.concat(F.lit(word + ": "), F.array_join(list_(c), ", ")))).otherwise(none)
    body = F.concat(named("added", "Added"), named("removed", "Removed"), list_("reshaped"), list_("into"), named("routes", "Routes"))
    text = F.concat(F.col("zone").cast("string"), F.lit(": "), F.when(F.size(title) > 0, F.array_join(title, ", ")).otherwise("regions updated"), F.when(F.size(body) > 0, F.concat(F.lit("\n\n"), F.array_join(body, "\n"))).otherwise(""))
    return all_.select("zone", text.alias("message"))


def merge_placements(base: DataFrame, theirs: DataFrame, ours: DataFrame) -> DataFrame:
    """zone, id, placement and conflict of a three-way merge of placements (a text; null: none).

    Unlike regions, an entry that one side has stays: if the other side's version wins and has no placement, its placement is empty.
    """
    side = lambda df, s: df.select("zone", "id", F.coalesce("placement", F.lit("")).alias(s))
    rows = side(theirs, "t").join(side(ours, "o"), ["zone", "id"], "full_outer").join(side(base, "b"), ["zone", "id"], "left").na.fill("", ["t", "o", "b"])
    t, o, b = (F.col(c) for c in "tob")
    return rows.select("zone", "id", F.when((o != t) & (o == b), t).otherwise(o).alias("placement"), ((o != t) & (o != b) & (t != b)).alias("conflict"))


def placement(regions: Column, path: Column, loop: Column) -> Column:
    """How a spawn is placed, as a text that is equal for equal placements: its regions, else its route, else empty."""
    return F.when(F.size(regions) > 0, F.to_json(F.struct(regions.alias("regions")))).when(path.isNotNull(), F.to_json(F.struct(path.alias("legs"), loop.alias("loop")))).otherwise("")


def validate(regions: DataFrame, spawns: DataFrame, cell: float = 50.0) -> DataFrame:
    """zone, level, code, region, spawn_id and n: every rule's findings; the last two rules count instead of listing."""
    none = lambda kind: F.lit(None).cast(kind)
    ids = spawns.schema["id"].dataType.simpleString()

    def row(df: DataFrame, level: str, code: str, region: Column | None = None, spawn: Column | None = None, n: Column | None = None) -> DataFrame:
        return df.select("zone", F.lit(level).alias("level"), F.lit(code).alias("code"), (none("string") if region is None else region).alias("region"), (none(ids) if spawn is None else spawn).alias("spawn_id"), (F.lit(1) if n is None else n).cast("long").alias("n"))

    rings = regions.select("zone", "name", F.posexplode("rings").alias("at", "ring"))
    what = F.when(F.col("at") == 0, "outline").otherwise("hole")
    def ring_rule(bad: Column, code: str) -> DataFrame:
        return rings.where(bad).select("zone", F.lit("error").alias("level"), F.concat(what, F.lit(code)).alias("code"), F.col("name").alias("region"), none(ids).alias("spawn_id"), F.lit(1).cast("long").alias("n"))
    named = spawns.where(F.size("regions") > 0)
    each = named.select("zone", "id", "at", F.size("regions").alias("k"), F.posexplode("regions").alias("place", "name"))
    met = each.join(regions.select("zone", "name", "rings"), ["zone", "name"], "left")
    x, y, z = (F.get("at", F.lit(i)) for i in range(3))
    inside = F.coalesce(G.contains(x, z, F.col("rings")), F.lit(False))
    judged = met.groupBy("zone", "id").agg(F.first("at").alias("point"), F.first("k").alias("k"), F.bool_and(F.col("rings").isNotNull()).alias("defined"), F.bool_or(inside).alias("inside"), F.min(F.struct(~inside, "place", "name")).alias("one"))
    judged = judged.withColumnRenamed("point", "at").where(F.col("defined") & F.col("at").isNotNull()).withColumn("name", F.col("one.name"))
    points = judged.where(F.col("inside") & (F.col("k") == 1)).select("zone", "id", F.col("name").alias("own"), x.alias("x"), y.alias("y"), z.alias("z"))
    nearest = points.join(R.region_at(points, regions, "id", keys=("zone",), cell=cell).select("zone", "id", F.col("name").alias("nearest")), ["zone", "id"]).where("nearest <> own")
    loose = spawns.where(F.coalesce(F.size("regions"), F.lit(-1)) < 1)
    few = loose.groupBy("zone").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("at").isNull() & F.col("path").isNull()).alias("k"))
    legs = F.size("path")
    return reduce(DataFrame.unionByName, [
        ring_rule(F.size("ring") < 3, "-vertices"),
        ring_rule((F.size("ring") >= 3) & G.crosses_itself(F.col("ring")), "-crosses-itself"),
        row(regions.join(each.select("zone", "name").distinct(), ["zone", "name"], "left_anti"), "warn", "no-spawns", F.col("name")),
        row(spawns.where(F.col("path").isNotNull() & (legs < 2)), "error", "legs", spawn=F.col("id")),
        row(named.where(F.col("path").isNotNull()), "error", "region-and-route", spawn=F.col("id")),
        row(met.where(F.col("rings").isNull()), "error", "undefined-region", F.col("name"), F.col("id")),
        row(judged.where(~F.col("inside")), "info", "outside", F.col("name"), F.col("id")),
        row(nearest, "warn", "nearer-floor", F.col("own"), F.col("id")),
        row(few, "info", "fixed-points", n=F.col("n")),
        row(few.where("k > 0"), "warn", "nowhere", n=F.col("k")),
    ])


def coverage_findings(coverage: DataFrame) -> DataFrame:
    """region, share and level of the regions that hold less than 0.9 of their own mobs' points (below 0.7: warn), the least first."""
    share = F.col("inside") / F.col("total")
    return coverage.select("region", share.alias("share"), F.when(share < 0.7, "warn").otherwise("info").alias("level")).where("share < 0.9").orderBy("share", "region")


def spawns_per_region(spawns: DataFrame) -> DataFrame:
    """zone, region and n; a spawn of several regions counts in each."""
    return spawns.select("zone", F.explode("regions").alias("region")).groupBy("zone", "region").agg(F.count(F.lit(1)).alias("n"))


def status_counts(spawns: DataFrame) -> DataFrame:
    """zone, status (with one row for all) and n."""
    s = spawns.select("zone", R.status(F.coalesce("regions", F.array().cast("array<string>")), F.col("path"), F.col("at")).alias("status"))
    return s.select("zone", F.explode(F.array("status", F.lit("all"))).alias("status")).groupBy("zone", "status").agg(F.count(F.lit(1)).alias("n"))


def filtered_by_status(spawns: DataFrame, status: str | None = None, text: str = "") -> DataFrame:
    """Spawns of a status whose name or id holds a text, case aside."""
    s = R.status(F.coalesce("regions", F.array().cast("array<string>")), F.col("path"), F.col("at"))
    hit = F.lower("name").contains(text.lower()) | F.col("id").cast("string").contains(text.lower())
    return spawns.withColumn("status", s).where(hit & (F.col("status") == status if status else F.lit(True)))


def shared_routes(spawns: DataFrame) -> DataFrame:
    """zone, id and n: with how many spawns (itself included) a patrol shares its line, legs compared at one decimal.

    Halves go away from zero, by the number as it is written to 15 decimals: 1.8499999999999996 is 1.85 less the error of a sum, and goes where 1.85 goes.
    """
    sign = lambda v: F.when(v.cast("string").startswith("-"), "-").otherwise("")
    one = lambda v: F.coalesce(F.concat(sign(v), F.round(F.abs(v).cast("string").try_cast("decimal(30,15)"), 1).cast("string")), F.format_string("%.1f", v))
    key = F.array_join(F.transform("path", lambda v: F.concat_ws(" ", *(one(v[c]) for c in "xyz"))), ";")
    routes = spawns.where(F.size("path") > 0).select("zone", "id", F.md5(key).alias("line"))
    return routes.join(routes.groupBy("zone", "line").agg(F.count(F.lit(1)).alias("n")), ["zone", "line"]).select("zone", "id", "n")


def standing_places(spawns: DataFrame, regions: DataFrame) -> DataFrame:
    """zone, id, x, z: a spawn's own point, else the mean of its regions' outline centres."""
    ring = F.element_at("rings", 1)
    mean = lambda c: F.aggregate(F.transform(ring, lambda v: v[c]), F.lit(0.0), lambda a, b: a + b) / F.size(ring)
    centre = regions.where(F.size(ring) > 0).select("zone", "name", mean("x").alias("cx"), mean("z").alias("cz"))
    each = spawns.where(F.col("at").isNull()).select("zone", "id", F.explode("regions").alias("name")).join(centre, ["zone", "name"])
    by_region = each.groupBy("zone", "id").agg(F.avg("cx").alias("x"), F.avg("cz").alias("z"))
    own = spawns.where(F.col("at").isNotNull()).select("zone", "id", F.get("at", F.lit(0)).alias("x"), F.get("at", F.lit(2)).alias("z"))
    return own.unionByName(by_region)
