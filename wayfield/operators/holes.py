"""Holes around what can't be walked: margin rings that keep clear of walked cells, ring thinning that never cuts over them, patches around a seed, groups of holes.

Growing, opening and flooding are joins over cells.  What is sequential within one piece (corridors out of its pockets, its ring, its thinning) is a grouped function over
that piece's cells alone.
"""

from __future__ import annotations

import heapq
import math
from collections import deque
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfield.functions import geometry as G
from wayfield.operators import graph, raster
from wayfield.operators.lines import hull

Cell = tuple[int, int]
SIDES = ((1, 0), (-1, 0), (0, 1), (0, -1))
AROUND = tuple((a, b) for a in (-1, 0, 1) for b in (-1, 0, 1))


def _touches(ax: float, az: float, bx: float, bz: float, cx: float, cz: float, cell: Cell) -> bool:
    """Whether a triangle and a cell's square have a point in common: no side of either has the two apart."""
    square = [(cell[0] + i, cell[1] + j) for i in (0, 1) for j in (0, 1)]
    triangle = [(ax, az), (bx, bz), (cx, cz)]
    ways = [(1, 0), (0, 1), *((q[1] - p[1], p[0] - q[0]) for p, q in zip(triangle, triangle[1:] + triangle[:1], strict=True))]
    for wx, wz in ways:
        s = [wx * x + wz * z for x, z in square]
        t = [wx * x + wz * z for x, z in triangle]
        if max(s) <= min(t) or max(t) <= min(s):
            return False
    return True


def thinned(x: np.ndarray, z: np.ndarray, least_area: float, avoid: set[Cell], keep: int = 4) -> np.ndarray:
    """Positions of the corners that stay of a ring (in cells): the corner with the smallest triangle goes first, the earlier one on ties, while that has less than `least_area`.

    A corner whose triangle touches a cell to avoid stays for as long as its neighbours do; when one of them goes, it is measured anew.
    """
    n = len(x)
    before, after = [(i - 1) % n for i in range(n)], [(i + 1) % n for i in range(n)]
    version, gone = [0] * n, [False] * n

    def size(i: int) -> float:
        p, q = before[i], after[i]
        return abs((x[i] - x[p]) * (z[q] - z[p]) - (x[q] - x[p]) * (z[i] - z[p])) / 2

    def blocked(i: int) -> bool:
        if size(i) < 1e-9 or not avoid:
            return False
        xs, zs = ([v[k] for k in (before[i], i, after[i])] for v in (x, z))
        box = ((a, b) for a in range(math.floor(min(xs)), math.ceil(max(xs))) for b in range(math.floor(min(zs)), math.ceil(max(zs))))
        return any(c in avoid and _touches(xs[0], zs[0], xs[1], zs[1], xs[2], zs[2], c) for c in box)

    heap = [(size(i), i, 0) for i in range(n)]
    heapq.heapify(heap)
    left = n
    while heap and left > keep:
        area, i, v = heapq.heappop(heap)
        if area >= least_area:
            break
        if gone[i] or v != version[i] or blocked(i):
            continue
        gone[i], left = True, left - 1
        p, q = before[i], after[i]
        after[p], before[q] = q, p
        for k in (p, q):
            version[k] += 1
            heapq.heappush(heap, (size(k), k, version[k]))
    return np.array([i for i in range(n) if not gone[i]], int)


def opened_pockets(cells: set[Cell], avoid: set[Cell]) -> set[Cell]:
    """The cells without a corridor, one cell wide and as short as can be, from each enclosed pocket with a cell to avoid to the outside.

    Pockets are taken in the order of their least avoided cell; a pocket with none stays enclosed.
    """
    if not cells:
        return cells
    xs, zs = [c[0] for c in cells], [c[1] for c in cells]
    x0, x1, z0, z1 = min(xs) - 1, max(xs) + 1, min(zs) - 1, max(zs) + 1
    within = lambda c: x0 <= c[0] <= x1 and z0 <= c[1] <= z1
    beside = lambda c: [(c[0] + a, c[1] + b) for a, b in SIDES]

    def flood(start: Cell, into: set[Cell]) -> None:
        todo = [start]
        into.add(start)
        while todo:
            for c in beside(todo.pop()):
                if within(c) and c not in into and c not in cells:
                    into.add(c)
                    todo.append(c)

    cells, outside = set(cells), set()
    flood((x0, z0), outside)
    for start in sorted(c for c in avoid if within(c)):
        if start in cells or start in outside:
            continue
        came, wave, end = {start: start}, deque([start]), None
        while wave and end is None:
            at = wave.popleft()
            for c in beside(at):
                if c not in came:
                    came[c] = at
                    if c in outside:
                        end = c
                        break
                    wave.append(c)
        while end is not None and end != start:
            cells.discard(end)
            outside.add(end)
            end = came[end]
        flood(start, outside)
    return cells


def grown(obstacles: DataFrame, avoid: DataFrame, key: str, margin: float, cell: float = 0.5) -> DataFrame:
    """key, ix, iz, foot: the cells within `margin` of obstacle cells (key, ix, iz, foot) that aren't to be avoided (key, ix, iz), freed of slots a cell wide.

    They are shrunk by a cell and grown back into what was there; of the pieces left those stay that hold an obstacle's own cell.  A cell's foot is the lowest (largest) near it.
    """
    reach = math.ceil(margin / cell)
    disc = [(a, b) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1) if math.hypot(a, b) * cell <= margin + cell / 2]
    at = lambda rows, steps: rows.withColumn("s", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps]))).withColumns({"ix": F.col("ix") + F.col("s.a"), "iz": F.col("iz") + F.col("s.b")}).drop("s")
    near = at(obstacles.select(key, "ix", "iz", "foot"), disc).groupBy(key, "ix", "iz").agg(F.max("foot").alias("foot"))
    near = graph.kept(near.join(avoid.select(key, "ix", "iz"), [key, "ix", "iz"], "left_anti"))
    solid = at(near.select(key, "ix", "iz"), AROUND).groupBy(key, "ix", "iz").count().where(F.col("count") == 9).drop("count")
    opened = near.join(at(solid, AROUND).distinct(), [key, "ix", "iz"], "left_semi")
    smooth = graph.kept(opened.unionByName(near.join(avoid.select(key).distinct(), key, "left_anti")).dropDuplicates([key, "ix", "iz"]))  # where nothing is to be avoided nothing is opened
    found = raster.pieces(smooth, key, diagonal=True)
    own = found.join(obstacles.select(key, "ix", "iz").distinct(), [key, "ix", "iz"], "left_semi").select(key, "piece").distinct()
    return smooth.join(found.join(own, [key, "piece"], "left_semi"), [key, "ix", "iz"])


def margin_rings(obstacles: DataFrame, avoid: DataFrame, key: str, margin: float, cell: float = 0.5) -> DataFrame:
    """key, piece, ring, foot, area (in square yalms) and corners (x, z): rings around obstacles at `margin`, which hold no cell to avoid.

    Obstacles whose margins meet share a ring; an enclosed pocket is filled, unless it holds cells to avoid, which get a corridor to the outside.
    """
    cells = grown(obstacles, avoid, key, margin, cell).withColumn("own", F.lit(True))
    # An avoided cell matters to the pieces whose box holds it: it may lie deep in a pocket, so boxes, not neighbours, decide.
    box = cells.groupBy(key, "piece").agg(*(f(c).alias(c + n) for c in ("ix", "iz") for f, n in ((F.min, "0"), (F.max, "1"))))
    block = 64
    spots = box.withColumn("bx", F.explode(F.sequence(F.floor(F.col("ix0") / block), F.floor(F.col("ix1") / block)))).withColumn("bz", F.explode(F.sequence(F.floor(F.col("iz0") / block), F.floor(F.col("iz1") / block))))
    near = avoid.select(key, "ix", "iz").distinct().withColumns({"bx": F.floor(F.col("ix") / block), "bz": F.floor(F.col("iz") / block)}).join(spots, [key, "bx", "bz"])
    near = near.where("ix between ix0 - 1 and ix1 + 1 and iz between iz0 - 1 and iz1 + 1").select(key, "ix", "iz", F.lit(None).cast("double").alias("foot"), "piece", F.lit(False).alias("own"))
    kind = cells.schema[key].dataType.simpleString()

    def ring(rows: pd.DataFrame) -> pd.DataFrame:
        spot = lambda part: set(zip(rows["ix"][part].tolist(), rows["iz"][part].tolist(), strict=True))
        mine, out = spot(rows["own"]), spot(~rows["own"])
        shape = opened_pockets(mine, out)
        edges = [(x + a, z + b, x + c, z + d) for x, z in shape for dx, dz, a, b, c, d in ((0, -1, 0, 0, 1, 0), (1, 0, 1, 0, 1, 1), (0, 1, 1, 1, 0, 1), (-1, 0, 0, 1, 0, 0)) if (x + dx, z + dz) not in shape]
        found = []
        for corners in raster.chained(*(np.array(v) for v in zip(*edges, strict=True))) if edges else []:
            x, z = (np.array(v, float) for v in zip(*corners, strict=True))
            if len(corners) < 4 or (x * np.roll(z, -1) - np.roll(x, -1) * z).sum() <= 0:
                continue  # a pocket's inner ring
            at = thinned(x, z, 1.0, out)
            x, z = x[at], z[at]
            area = (x * np.roll(z, -1) - np.roll(x, -1) * z).sum() / 2
            found.append((rows[key].iloc[0], rows["piece"].iloc[0], len(found), rows["foot"].max(), area * cell * cell, (x * cell).tolist(), (z * cell).tolist()))
        return pd.DataFrame(found, columns=[key, "piece", "ring", "foot", "area", "xs", "zs"])

    rows = cells.select(key, "ix", "iz", "foot", "piece", "own").unionByName(near)
    out = rows.groupBy(key, "piece").applyInPandas(ring, f"{key} {kind}, piece long, ring int, foot double, area double, xs array<double>, zs array<double>")
    corners = F.transform(F.arrays_zip("xs", "zs"), lambda v: F.struct(v["xs"].alias("x"), v["zs"].alias("z")))
    return out.select(key, "piece", "ring", "foot", "area", corners.alias("corners"))


def seed_patches(seeds: DataFrame, inside: DataFrame, blocked: DataFrame, key: str, budget: Column | str) -> DataFrame:
    """seeds (key, id, ix, iz and, if it is a column, the budget) with found, cells, touches_edge and over_budget: the patch of cells around each that are inside and not blocked.

    A patch spreads over edges.  A seed on blocked or outer ground has none (found is false).  All patches of a key are labelled at once, so seeds that share
    one cost no more than one; beyond the budget a patch reads as `budget` cells, and whether it touches the outline isn't told (null).
    """
    free = graph.kept(inside.select(key, "ix", "iz").join(blocked.select(key, "ix", "iz"), [key, "ix", "iz"], "left_anti").distinct())
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in SIDES])
    out = free.select(key, "ix", "iz", F.explode(steps).alias("s")).select(key, F.col("ix").alias("fx"), F.col("iz").alias("fz"), (F.col("ix") + F.col("s.a")).alias("ix"), (F.col("iz") + F.col("s.b")).alias("iz"))
    edge = out.join(inside.select(key, "ix", "iz"), [key, "ix", "iz"], "left_anti").select(key, F.col("fx").alias("ix"), F.col("fz").alias("iz")).distinct().withColumn("edge", F.lit(True))
    labels = graph.kept(raster.pieces(free, key))
    sizes = labels.join(edge, [key, "ix", "iz"], "left").groupBy(key, "piece").agg(F.count(F.lit(1)).alias("w_n"), F.bool_or(F.coalesce("edge", F.lit(False))).alias("w_edge"))
    met = seeds.join(labels, [key, "ix", "iz"], "left").join(sizes, [key, "piece"], "left")
    most = F.col(budget) if isinstance(budget, str) else budget
    over = F.col("w_n") > most
    return met.select(*seeds.columns, F.col("piece").isNotNull().alias("found"), F.when(over, F.floor(most)).otherwise(F.col("w_n")).alias("cells"), F.when(~over, F.col("w_edge")).alias("touches_edge"), over.alias("over_budget"), "piece")


def hole_groups(holes: DataFrame, key: str, reach: float = 2.0) -> DataFrame:
    """key, hole, members and corners: for each hole (key, hole, ring) itself and those with an edge within `reach` of it (not those near these), and the hull of all their corners.

    Holes meet by the cells of their boxes; the distance is then measured edge to edge.
    """
    size = max(reach, 1.0) * 4
    corners = F.transform("ring", lambda v: F.struct(v["x"].alias("x"), v["z"].alias("z")))
    boxed = graph.kept(holes.where(F.size("ring") >= 3).select(key, "hole", corners.alias("ring"), G.box(F.col("ring")).alias("b")))
    span = lambda a, b, margin: F.explode(F.sequence(G.cell(F.col(a) - margin, size), G.cell(F.col(b) + margin, size)))
    here = boxed.withColumn("cx", span("b.x0", "b.x1", 0.0)).withColumn("cz", span("b.z0", "b.z1", 0.0))
    there = here.select(key, "cx", "cz", F.col("hole").alias("other"), F.col("ring").alias("other_ring"), F.col("b").alias("ob"))
    asked = boxed.withColumn("cx", span("b.x0", "b.x1", reach)).withColumn("cz", span("b.z0", "b.z1", reach))
    close = (F.col("b.x0") <= F.col("ob.x1") + reach) & (F.col("ob.x0") <= F.col("b.x1") + reach) & (F.col("b.z0") <= F.col("ob.z1") + reach) & (F.col("ob.z0") <= F.col("b.z1") + reach)
    spark = holes.sparkSession
    asked = asked.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), key, "cx", "cz")  # few bytes, but much to measure: a number that stays
    first = (F.col("cx") == F.greatest(G.cell(F.col("b.x0") - reach, size), G.cell(F.col("ob.x0"), size))) & (F.col("cz") == F.greatest(G.cell(F.col("b.z0") - reach, size), G.cell(F.col("ob.z0"), size)))
    pairs = asked.join(there, [key, "cx", "cz"]).where((F.col("hole") != F.col("other")) & close & first)  # of the cells that two share only the first has them as a pair
    parts = lambda ring: [F.transform(ring, lambda v: v[c].cast("double")).alias(c + "s") for c in "xz"]
    pairs = pairs.where(G.ring_to_ring_distance(F.col("ring"), F.col("other_ring")) <= reach).select(key, "hole", "other", *parts("other_ring"))
    all_ = pairs.unionByName(boxed.select(key, "hole", F.col("hole").alias("other"), *parts("ring")))
    kinds = {n: boxed.schema[n].dataType.simpleString() for n in (key, "hole")}

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for those of a hole's rows that follow each other, so that no corner of a pair is shuffled or sorted."""
        for batch in batches:
            ids = np.stack([batch.column(i).dictionary_encode().indices.fill_null(-1).to_numpy() for i in (0, 1)])
            at = np.flatnonzero(np.append(True, (ids[:, 1:] != ids[:, :-1]).any(0))) if len(batch) else np.zeros(0, int)
            ends, upto = np.append(at[1:], len(batch)), batch.column(3).offsets.to_numpy()
            x, z = (batch.column(i).values.to_numpy() for i in (3, 4))
            hulls = [upto[a] + hull(x[upto[a] : upto[b]], z[upto[a] : upto[b]]) for a, b in zip(at, ends, strict=True)]
            members = pa.ListArray.from_arrays(pa.array(np.append(at, len(batch)), pa.int32()), batch.column(2))
            corners = [pa.array([v[i] for i in hulls], pa.list_(pa.float64())) for v in (x, z)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), members, *corners], [key, "hole", "members", "xs", "zs"])

    some = all_.mapInArrow(gathered, f"{key} {kinds[key]}, hole {kinds['hole']}, members array<{kinds['hole']}>, xs array<double>, zs array<double>")
    flat = lambda c: F.flatten(F.collect_list(c))
    grouped = some.groupBy(key, "hole").agg(F.array_sort(flat("members")).alias("members"), flat("xs").alias("xs"), flat("zs").alias("zs"))  # the few holes around one

    @F.pandas_udf("array<struct<x: double, z: double>>")
    def hulls(xs: pd.Series, zs: pd.Series) -> pd.Series:
        return pd.Series([[{"x": x[i], "z": z[i]} for i in hull(x, z)] for x, z in zip(xs, zs, strict=True)])

    return grouped.select(key, "hole", "members", hulls("xs", "zs").alias("corners"))


def visible(gaps: DataFrame, rings: DataFrame, key: str, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Gaps and obstacle rings (key, id, ring) to show: of two that cover the same ground, one mostly inside the other, only the bigger (a gap gives way on equal areas)."""
    area = F.abs(G.signed_area(F.col("ring")))
    one = lambda rows, p: rows.select(key, F.col("id").alias(p + "id"), F.col("ring").alias(p + "ring"), area.alias(p + "area"), G.box(F.col("ring")).alias(p + "box"))
    met = one(gaps, "g").join(one(rings, "o"), key).where("gbox.x0 <= obox.x1 and obox.x0 <= gbox.x1 and gbox.z0 <= obox.z1 and obox.z0 <= gbox.z1")
    gone = met.where((F.col("oarea") >= F.col("garea")) & G.mostly_inside(F.col("gring"), F.col("oring"), share)).select(key, F.col("gid").alias("id")).distinct()
    hidden = met.where((F.col("garea") > F.col("oarea")) & G.mostly_inside(F.col("oring"), F.col("gring"), share)).select(key, F.col("oid").alias("id")).distinct()
    return gaps.join(gone, [key, "id"], "left_anti"), rings.join(hidden, [key, "id"], "left_anti")


def first_fit(labels: DataFrame, key: str, order: str, reach: float = 12.0, height: float = 8.0) -> DataFrame:
    """labels (key, order, x, y, z and what else) with leader: in order, a label joins the first group whose founder is nearer than `reach` on the plane and `height` up or down, else founds one.

    leader is the founder's order.  Labels of one cell, which is less than `reach` across and `height` high, are all near each other, so a cell has one founder at most, and what is
    met does not grow with the labels in it: in rounds, the first label left in a cell is a founder if it comes before the first ones left of all cells around, and takes
    what is near it out.  A label without a place founds its own group.
    """
    side, tall = reach * 0.7, height * 0.99
    cells, axes = ("w_x", "w_y", "w_z"), ("x", "y", "z")
    around = F.explode(F.array(*[F.struct(*(F.lit(v).alias(c) for c, v in zip(cells, (a, b, c), strict=True))) for a in range(-2, 3) for b in range(-2, 3) for c in range(-2, 3)]))

    def spread(rows: DataFrame) -> DataFrame:
        near = rows.withColumn("s", around)
        return near.withColumns({c: F.col(c) + F.col(f"s.{c}") for c in cells}).drop("s")

    places = labels.where(" and ".join(f"{c} is not null" for c in axes)).groupBy(key, *axes).agg(F.min(order).alias("w_o"))  # those at one place have one leader
    places = graph.kept(places.withColumns({c: G.cell(F.col(v), tall if v == "y" else side) for c, v in zip(cells, axes, strict=True)}))
    todo, found = places, []
    close = (F.hypot(F.col("x") - F.col("f_x"), F.col("z") - F.col("f_z")) < reach) & (F.abs(F.col("y") - F.col("f_y")) < height)
    while True:
        first = graph.kept(todo.groupBy(key, *cells).agg(F.min(F.struct(F.col("w_o").alias("f_o"), *(F.col(c).alias("f_" + c) for c in axes))).alias("f")).select(key, *cells, "f.*"))
        if not first.limit(1).count():
            break
        least = spread(first.select(key, *cells, "f_o")).groupBy(key, *cells).agg(F.min("f_o").alias("f_o"))
        new = graph.kept(first.join(least, [key, *cells, "f_o"]))
        found.append(new)
        todo = graph.kept(_met(todo, spread(new), [key, *cells], close, "left_anti"))
    if not found:
        return labels.withColumn("leader", F.col(order))
    leaders = _met(places, spread(reduce(DataFrame.unionByName, found)), [key, *cells], close, "inner").groupBy(key, *axes).agg(F.min("f_o").alias("leader"))
    return labels.join(leaders, [key, *axes], "left").select(*labels.columns, F.coalesce("leader", order).alias("leader"))


def _met(rows: DataFrame, founders: DataFrame, keys: list[str], close: Column, how: str) -> DataFrame:
    f = founders.select(*(F.col(k).alias("k" + k) for k in keys), *(c for c in founders.columns if c not in keys))
    return rows.join(f, reduce(lambda a, b: a & b, [F.col(k) == F.col("k" + k) for k in keys]) & close, how)


def label_groups(labels: DataFrame, key: str, order: str, **options) -> DataFrame:
    """key, leader, x, y, z (the founder's) and texts, each once in order: labels that share a place."""
    led = first_fit(labels, key, order, **options)
    once = led.groupBy(key, "leader", "text").agg(F.min(order).alias("w_o"), F.max(F.when(F.col(order) == F.col("leader"), F.struct("x", "y", "z"))).alias("at"))
    rows = once.groupBy(key, "leader").agg(F.max("at").alias("at"), F.array_sort(F.collect_list(F.struct("w_o", "text"))).alias("t"))
    return rows.select(key, "leader", "at.x", "at.y", "at.z", F.col("t.text").alias("texts"))


def feature_labels(areas: DataFrame, lines: DataFrame, arrivals: DataFrame) -> DataFrame:
    """zone, at (their order), text, x, y, z: a label for each trigger area (zone, id, x, y, z), zone line (zone, id, to, x, y, z) and arrival (zone, id, origin, x, y, z)."""
    one = lambda rows, k, text: rows.select("zone", F.lit(k).alias("k"), "id", text.alias("text"), "x", "y", "z")
    all_ = one(areas, 0, F.concat(F.lit("trigger "), F.col("id").cast("string"))).unionByName(one(lines, 1, F.concat(F.lit("to "), F.col("to").cast("string")))).unionByName(one(arrivals, 2, F.concat(F.lit("from "), F.col("origin").cast("string"))))
    return all_.withColumn("at", F.row_number().over(Window.partitionBy("zone").orderBy("k", "id", "text"))).drop("k", "id")
