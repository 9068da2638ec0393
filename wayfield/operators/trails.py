"""Operators on trails: windows over the points of a mob, in capture order (seq), which is authoritative."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def trail() -> WindowSpec:
    """A mob's points in order."""
    return Window.partitionBy("mob_id").orderBy("seq")


def so_far() -> WindowSpec:
    return trail().rowsBetween(Window.unboundedPreceding, 0)


def upper_median(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """key and the middle value, of an even number the upper of the middle two; from counts of distinct values, so nothing is gathered."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(key)
    so_far = counts.withColumn("upto", F.sum("n").over(w.orderBy(value))).withColumn("all", F.sum("n").over(w))
    return so_far.where(F.col("upto") > F.floor(F.col("all") / 2)).groupBy(key).agg(F.min(value).alias(name))


def percentiles(rows: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """key and interpolated percentiles by name, from counts of distinct values."""
    counts = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(key).agg(*(F.percentile(value, share, F.col("n")).alias(name) for name, share in shares.items()))


def captures(points: DataFrame, least_gap: float = 20, times: float = 6, shortest: int = 8) -> DataFrame:
    """mob_id, capture, n, t0 and t1: the runs of with_captures that aren't short."""
    runs = with_captures(points, least_gap, times)
    return runs.groupBy("mob_id", "capture").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1")).where(F.col("n") >= shortest)


def with_captures(points: DataFrame, least_gap: float = 20, times: float = 6, leap: float = 50) -> DataFrame:
    """points with capture: runs between steps longer than both a least gap and some times the mob's upper median step; without a time, between leaps in the plane."""
    steps = points.withColumn("step", F.col("t") - F.lag("t").over(trail()))
    leapt = F.hypot(F.col("x") - F.lag("x").over(trail()), F.col("z") - F.lag("z").over(trail())) > leap
    steps = steps.withColumn("leapt", leapt)
    typical = upper_median(steps, "mob_id", "step", "mid")
    late = F.col("step") > F.greatest(F.lit(least_gap), F.col("mid") * times)
    broken = F.coalesce(F.when(F.col("t").isNull(), F.col("leapt")).otherwise(late), F.lit(False)).cast("int")
    return steps.join(typical, "mob_id", "left").withColumn("capture", F.sum(broken).over(so_far())).drop("step", "leapt", "mid")


def legs(points: DataFrame, gap: float = 20, heading: Column | None = None) -> DataFrame:
    """mob_id, leg, n, seq0 and seq1: runs of one heading with no gap longer than `gap` seconds."""
    h = F.col("dir") if heading is None else heading
    p = points.withColumn("h", h)
    new = F.coalesce((F.col("h") != F.lag("h").over(trail())) | (F.col("t") - F.lag("t").over(trail()) > gap), F.lit(True)).cast("int")
    return p.withColumn("leg", F.sum(new).over(so_far())).groupBy("mob_id", "leg").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("seq0"), F.max("seq").alias("seq1"))


def edge_counts(points: DataFrame, node: Column, gap: float) -> DataFrame:
    """a, b and count: how often trails go between two nodes, either way, with no longer gap than `gap` seconds."""
    p = points.withColumn("node", node)
    before = p.withColumn("from", F.when(F.col("t") - F.lag("t").over(trail()) <= gap, F.lag("node").over(trail())))
    return before.where("`from` <> node").groupBy(F.least("from", "node").alias("a"), F.greatest("from", "node").alias("b")).agg(F.count(F.lit(1)).alias("count"))


def boxes(points: DataFrame) -> DataFrame:
    """mob_id, n, the bounding box and its middle."""
    b = points.groupBy("mob_id").agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(c + k) for c in "xz" for f, k in ((F.min, "0"), (F.max, "1"))))
    return b.withColumns({"cx": (F.col("x0") + F.col("x1")) / 2, "cz": (F.col("z0") + F.col("z1")) / 2})


def longest(points: DataFrame, key: list[str], capture: Column) -> DataFrame:
    """key, capture and n of the longest capture of each key, the first on ties."""
    n = points.withColumn("capture", capture).groupBy(*key, "capture").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy(*key).agg(F.min(F.struct(-F.col("n"), F.col("capture"))).alias("b"))
    return best.select(*key, F.col("b.capture").alias("capture"), (-F.col("b.col1")).alias("n"))


def stop_radius(distances: DataFrame, value: str, key: str, width: float = 0.25, reach: float = 12.0) -> DataFrame:
    """key, mode, pile and r of distances: the middle of the fullest bin (with both neighbours, the first on ties), how many lie from 0.9 below to 0.4 above it, and their 95th percentile.

    Only distances between -1 and `reach` count.
    """
    bins = -int(-(reach + 1) // width)
    kept = distances.where((F.col(value) > -1) & (F.col(value) < reach)).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    place = F.least(F.lit(bins - 1), F.floor((F.col(value) + 1) / width).cast("int"))
    near = kept.groupBy(key, place.alias("bin")).agg(F.sum("n").alias("n")).withColumn("bin", F.explode(F.sequence(F.greatest(F.col("bin") - 1, F.lit(0)), F.least(F.col("bin") + 1, F.lit(bins - 1)))))
    best = near.groupBy(key, "bin").agg(F.sum("n").alias("score")).groupBy(key).agg(F.max(F.struct("score", -F.col("bin"))).alias("m"))
    mode = best.select(key, ((-F.col("m.col2") + 0.5) * width - 1).alias("mode"))
    pile = kept.join(mode, key).where((F.col(value) > F.col("mode") - 0.9) & (F.col(value) < F.col("mode") + 0.4))
    return pile.groupBy(key, "mode").agg(F.sum("n").alias("pile"), F.percentile(value, 0.95, F.col("n")).alias("r"))


def every_nth(points: DataFrame, n: int) -> DataFrame:
    return points.withColumn("at", F.row_number().over(trail()) - 1).where(F.col("at") % n == 0).drop("at")


def time_in_view(points: DataFrame, gap: float = 120) -> DataFrame:
    """Seconds since the mob came into view: since the last gap longer than `gap`."""
    new = F.coalesce((F.col("t") - F.lag("t").over(trail()) > gap), F.lit(True)).cast("int")
    p = points.withColumn("view", F.sum(new).over(so_far()))
    return p.withColumn("in_view", F.col("t") - F.first("t").over(Window.partitionBy("mob_id", "view").orderBy("seq")))
