"""Operators on grid cells: rasters as rows (ix, iz), grown and shrunk by joins with shifted copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfield.functions import geometry as G


def cells(points: DataFrame, size: float, *keys: str) -> DataFrame:
    """keys, ix, iz, n and mean height y of the points of each cell."""
    at = points.withColumns({"ix": G.cell(F.col("x"), size), "iz": G.cell(F.col("z"), size)})
    return at.groupBy(*keys, "ix", "iz").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("y"))


def _shifted(c: DataFrame, reach: int) -> DataFrame:
    steps = F.array(*[F.lit(k) for k in range(-reach, reach + 1)])
    around = c.withColumn("dx", F.explode(steps)).withColumn("dz", F.explode(steps))
    return around.withColumns({"ix": F.col("ix") + F.col("dx"), "iz": F.col("iz") + F.col("dz")}).drop("dx", "dz")


def dilate(c: DataFrame, *keys: str, reach: int = 1) -> DataFrame:
    """Cells within `reach` of a cell, diagonals counting as one step."""
    return _shifted(c.select(*keys, "ix", "iz"), reach).distinct()


def erode(c: DataFrame, *keys: str, reach: int = 1) -> DataFrame:
    """Cells all of whose neighbours within `reach` are there."""
    full = (2 * reach + 1) ** 2
    there = c.select(*keys, "ix", "iz").distinct()
    return _shifted(there, reach).groupBy(*keys, "ix", "iz").count().where(F.col("count") == full).drop("count")


def close(c: DataFrame, *keys: str, reach: int = 1) -> DataFrame:
    """Gaps of up to twice `reach` cells filled: grown, then shrunk."""
    return erode(dilate(c, *keys, reach=reach), *keys, reach=reach)


def neighbours(c: DataFrame, *keys: str, diagonal: bool = True) -> DataFrame:
    """Links u < v between touching cells; a cell's number packs keys aside ix and iz."""
    steps = [(1, 0), (0, 1), *([(1, 1), (1, -1)] if diagonal else [])]
    one = c.select(*keys, "ix", "iz").distinct()
    offers = one.withColumn("s", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps])))
    offers = offers.select(*keys, F.col("ix").alias("ux"), F.col("iz").alias("uz"), (F.col("ix") + F.col("s.a")).alias("ix"), (F.col("iz") + F.col("s.b")).alias("iz"))
    return offers.join(one, [*keys, "ix", "iz"])


def cell_key(ix, iz):
    """A cell as one number; it keeps the order by ix, then iz."""
    return ((F.lit(ix) if isinstance(ix, int) else ix) + 65536).cast("long") * 131072 + iz + 65536


def nearest_cell_gap(c: DataFrame, *keys: str) -> DataFrame:
    """Along each row of cells, the gap to the next one there (null for the last)."""
    w = Window.partitionBy(*keys, "iz").orderBy("ix")
    return c.withColumn("gap", F.lead("ix").over(w) - F.col("ix"))
