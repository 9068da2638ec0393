"""Map sheets: the square of a point, and a sheet's grid and corners in zone coordinates.

Maps have zone, floor, nr (the first counts where a floor has several), number, scale, offset_x, offset_y and image.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfield.functions import geometry as G

_SHEET = ("scale", "offset_x", "offset_y")


def first_maps(maps: DataFrame) -> DataFrame:
    """One map for each zone and floor."""
    one = maps.groupBy("zone", "floor").agg(F.min_by(F.struct("number", *_SHEET, "image"), "nr").alias("m"))
    return one.select("zone", "floor", "m.*")


def squares_of(points: DataFrame, maps: DataFrame) -> DataFrame:
    """points with square, like J-8: null where the zone has no map of the floor or the floor is unknown."""
    m = first_maps(maps).select("zone", "floor", *_SHEET)
    return points.join(m, ["zone", "floor"], "left").withColumn("square", G.map_square(F.col("x"), F.col("z"), *map(F.col, _SHEET))).drop(*_SHEET)


def _place(px, py):
    return G.map_place(px, py, *map(F.col, _SHEET))


def grid_lines(maps: DataFrame) -> DataFrame:
    """zone, floor, way (column or row), k, x1, z1, x2, z2: the sixteen lines each way."""
    at = 16 + 32 * F.col("k")
    one = first_maps(maps).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(15))))
    (x, z), (near_x, near_z), (far_x, far_z) = _place(at, at), _place(F.lit(16), F.lit(16)), _place(F.lit(496), F.lit(496))
    column = F.struct(F.lit("column").alias("way"), x.alias("x1"), near_z.alias("z1"), x.alias("x2"), far_z.alias("z2"))
    row = F.struct(F.lit("row").alias("way"), near_x.alias("x1"), z.alias("z1"), far_x.alias("x2"), z.alias("z2"))
    return one.select("zone", "floor", "k", F.explode(F.array(column, row)).alias("l")).select("zone", "floor", "k", "l.*")


def grid_squares(maps: DataFrame) -> DataFrame:
    """zone, floor, name, x, z and size: the middle of each of the 225 squares, A-1 to O-15, and how wide one is."""
    each = F.sequence(F.lit(0), F.lit(14))
    one = first_maps(maps).withColumn("c", F.explode(each)).withColumn("r", F.explode(each))
    x, z = _place(32 + 32 * F.col("c"), 32 + 32 * F.col("r"))
    return one.select("zone", "floor", F.concat(F.chr(65 + F.col("c")), F.lit("-"), (F.col("r") + 1).cast("string")).alias("name"), x.alias("x"), z.alias("z"), (F.lit(32 * 1280) / F.col("scale")).alias("size"))


def sheets(maps: DataFrame) -> DataFrame:
    """zone, floor, file, x0, z0, x1, z1: the image of each sheet and its corners; map number 0 is filed by zone and floor."""
    (x0, z0), (x1, z1) = _place(F.lit(0), F.lit(0)), _place(F.lit(512), F.lit(512))
    file = F.when(F.col("number") == 0, F.concat(F.lit("z"), F.col("zone").cast("string"), F.lit("_"), F.col("floor").cast("string"))).otherwise(F.col("image"))
    return first_maps(maps).select("zone", "floor", file.alias("file"), x0.alias("x0"), z0.alias("z0"), x1.alias("x1"), z1.alias("z1"))
