"""Areas as text: definitions with a polygon, holes and heights, and trigger calls as areas that can be edited.

A definition reads ``{ -- what it is``, then any of ``yMin = 1, yMax = 2, y = 3, yExtent = 4,``, ``polygon = { { x = 1, z = 2 }, ... },`` and, if it has holes,
``holes = { { { x = 1, z = 2 }, ... }, ... },`` and ``}``; comments (``--`` to the end of the line) may stand anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfield.functions import geometry as G
from wayfield.sources import texts

_TOKEN = r"([{}]|[A-Za-z]+|[-+]?\d+(?:\.\d+)?)"


def area_text(y: dict[str, Column], polygon: Column, holes: Column, description: Column | None = None) -> Column:
    """The definition of an area; heights (yMin, yMax, y, yExtent) that are null are left out."""
    number = lambda v: F.regexp_replace(F.format_string("%.3f", v), r"\.?0+$", "")
    ring = lambda r: F.concat(F.lit("{ "), F.array_join(F.transform(r, lambda v: F.concat(F.lit("{ x = "), number(v["x"]), F.lit(", z = "), number(v["z"]), F.lit(" }"))), ", "), F.lit(" }"))
    heights = F.array_join(F.filter(F.array(*[F.when(v.isNotNull(), F.concat(F.lit(f"{k} = "), number(v))) for k, v in y.items()]), lambda x: x.isNotNull()), ", ")
    note = F.lit("") if description is None else F.coalesce(F.concat(F.lit(" -- "), description), F.lit(""))
    inner = F.when(F.size(holes) > 0, F.concat(F.lit("  holes = {\n    "), F.array_join(F.transform(holes, ring), ",\n    "), F.lit("\n  },\n"))).otherwise("")
    return F.concat(F.lit("{"), note, F.lit("\n"), F.when(heights != "", F.concat(F.lit("  "), heights, F.lit(",\n"))).otherwise(""), F.lit("  polygon = "), ring(polygon), F.lit(",\n"), inner, F.lit("}"))


def read_areas(files: DataFrame, *keys: str) -> DataFrame:
    """keys, area (from 1), description, y_min, y_max, y_mid, y_extent, polygon and holes of each definition in a text (keys, text).

    Brackets are counted along the text: an area opens at depth 0, its polygon's points lie three deep, its holes' points four.  What has no polygon is no area.
    """
    note = F.nullif(F.trim(F.regexp_extract("part", r"^[ \t]*--([^\r\n]*)", 1)), F.lit(""))
    bare = F.regexp_replace("text", r"--[^\r\n]*", "")
    w = Window.partitionBy(*keys).orderBy("pos")
    t = files.select(*keys, F.posexplode(F.regexp_extract_all(bare, F.lit(_TOKEN))).alias("pos", "token"))
    depth = F.sum(F.when(F.col("token") == "{", 1).when(F.col("token") == "}", -1).otherwise(0)).over(w)
    t = t.withColumn("depth", depth).withColumn("opens", F.col("token") == "{")
    count = lambda on: F.sum(F.when(on, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    t = t.withColumn("area", count(F.col("opens") & (F.col("depth") == 1)))
    t = t.withColumn("part", F.last(F.when((F.col("depth") == 1) & F.col("token").isin("polygon", "holes"), F.col("token")), True).over(Window.partitionBy(*keys, "area").orderBy("pos")))
    t = t.withColumn("point", count(F.col("opens") & (F.col("depth") >= 3))).withColumn("name", F.lag("token").over(w)).where("area > 0")
    value = t.where(F.col("token").rlike(r"^[-+]?\d") & F.col("name").rlike("^[A-Za-z]+$")).withColumn("v", F.col("token").cast("double"))
    height = lambda name: F.max(F.when((F.col("depth") == 1) & (F.col("name") == name), F.col("v")))
    heights = value.groupBy(*keys, "area").agg(height("yMin").alias("y_min"), height("yMax").alias("y_max"), height("y").alias("y_mid"), height("yExtent").alias("y_extent"))
    points = value.where(((F.col("part") == "polygon") & (F.col("depth") == 3)) | ((F.col("part") == "holes") & (F.col("depth") == 4)))
    axis = lambda name: F.max(F.when(F.col("name") == name, F.col("v")))
    points = points.groupBy(*keys, "area", "part", "point").agg(axis("x").alias("x"), axis("z").alias("z")).where("x is not null and z is not null")
    hole = t.where((F.col("part") == "holes") & F.col("opens") & (F.col("depth") >= 3)).withColumn("hole", F.sum(F.when(F.col("depth") == 3, 1).otherwise(0)).over(Window.partitionBy(*keys, "area").orderBy("pos"))).select(*keys, "area", "point", "hole")
    ordered = lambda: F.transform(F.array_sort(F.collect_list(F.struct("point", F.struct("x", "z").alias("p")))), lambda r: r["p"])
    polygon = points.where("part = 'polygon'").groupBy(*keys, "area").agg(ordered().alias("polygon"))
    rings = points.where("part = 'holes'").join(hole, [*keys, "area", "point"]).groupBy(*keys, "area", "hole").agg(ordered().alias("ring"))
    holes = rings.groupBy(*keys, "area").agg(F.transform(F.array_sort(F.collect_list(F.struct("hole", "ring"))), lambda r: r["ring"]).alias("holes"))
    # Comments are gone from the tokens; an area's own stands right behind its bracket, so texts are cut at brackets for it.
    cut = files.select(*keys, F.posexplode(F.split(F.regexp_replace("text", r"--[^\r\n]*[{}][^\r\n]*", "--"), r"(?<=[{}])")).alias("at", "part"))
    cut = cut.withColumn("before", F.lag("part").over(Window.partitionBy(*keys).orderBy("at")))
    level = F.sum(F.when(F.endswith("before", F.lit("{")), 1).when(F.endswith("before", F.lit("}")), -1).otherwise(0)).over(Window.partitionBy(*keys).orderBy("at"))
    opened = cut.withColumn("level", level).where(F.endswith("before", F.lit("{")) & (F.col("level") == 1))
    notes = opened.select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy("at")).cast("long").alias("area"), note.alias("description"))
    on = [*keys, "area"]
    out = polygon.join(heights, on, "left").join(holes, on, "left").join(notes, on, "left")
    return out.select(*on, "description", "y_min", "y_max", "y_mid", "y_extent", "polygon", F.coalesce("holes", F.array().cast("array<array<struct<x: double, z: double>>>")).alias("holes"))


def area_heights(y_min: Column, y_max: Column, y_mid: Column, y_extent: Column) -> Column:
    """y_min, y_max and unlimited of an area: by its ends (a missing one is 1000 off), else by its middle and extent (10 by default), else all heights."""
    ends, middle, extent = y_min.isNotNull() | y_max.isNotNull(), y_mid.isNotNull(), F.coalesce(y_extent, F.lit(10.0))
    low = F.when(ends, F.coalesce(y_min, F.lit(-1000.0))).when(middle, y_mid - extent).otherwise(-1000.0)
    high = F.when(ends, F.coalesce(y_max, F.lit(1000.0))).when(middle, y_mid + extent).otherwise(1000.0)
    return F.struct(low.alias("y_min"), high.alias("y_max"), (~ends & ~middle).alias("unlimited"))


def editable_triggers(scripts: DataFrame, *keys: str, corners: int = 32) -> DataFrame:
    """keys, nr, id, shape, rotation, y_min, y_max and polygon of the cuboids and cylinders that scripts register: opposite corners in either order are one box, turned by its rotation."""
    t = texts.trigger_areas(scripts, *keys).where(F.col("kind").isin("cuboid", "cylinder"))
    n = lambda i: F.get("numbers", F.lit(i))
    box, turn = F.col("kind") == "cuboid", F.coalesce(n(7), F.lit(0.0))
    x, z = (F.struct(F.least(n(a), n(b)).alias("lo"), F.greatest(n(a), n(b)).alias("hi")) for a, b in ((1, 4), (3, 6)))
    t = t.withColumns({"x": F.when(box, x), "z": F.when(box, z), "turn": F.when(box, turn)})
    cx, cz = ((F.col(f"{c}.lo") + F.col(f"{c}.hi")) / 2 for c in "xz")

    def corner(px: Column, pz: Column) -> Column:
        tx, tz = G.turned(px - cx, pz - cz, F.col("turn"))
        return F.when(F.col("turn") == 0, F.struct(px.alias("x"), pz.alias("z"))).otherwise(F.struct((cx + tx).alias("x"), (cz + tz).alias("z")))

    lo, hi = (lambda c: F.col(f"{c}.lo")), (lambda c: F.col(f"{c}.hi"))
    square = F.array(corner(lo("x"), lo("z")), corner(hi("x"), lo("z")), corner(hi("x"), hi("z")), corner(lo("x"), hi("z")))
    round_ = F.transform(G.circle(n(1), F.lit(0.0), n(2), n(3), corners), lambda v: F.struct(v["x"].alias("x"), v["z"].alias("z")))
    return t.select(
        *keys, "nr", n(0).cast("long").alias("id"), F.col("kind").alias("shape"), F.when(F.col("turn") != 0, F.col("turn")).alias("rotation"),
        F.when(box, F.least(n(2), n(5))).alias("y_min"), F.when(box, F.greatest(n(2), n(5))).alias("y_max"), F.when(box, square).otherwise(round_).alias("polygon"),
    )
