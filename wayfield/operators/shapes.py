"""What is sequential within one region: its triangles, by cutting ears off an outline with its holes bridged in, and ring thinning to a share of the corners.

A group is one region's rings, as people draw them; regions spread over the cluster.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfield.operators.lines import visvalingam

Point = tuple[float, float]


def _turn(a: Point, b: Point, c: Point) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _area(ring: list[Point]) -> float:
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def _crosses(a: Point, b: Point, c: Point, d: Point) -> bool:
    """Whether two edges cross or touch, other than in a shared end."""
    if {a, b} & {c, d}:
        return False
    one, two, three, four = _turn(a, b, c), _turn(a, b, d), _turn(c, d, a), _turn(c, d, b)
    return (one > 0) != (two > 0) and (three > 0) != (four > 0)


def bridged(outline: list[Point], holes: list[list[Point]]) -> list[Point]:
    """One ring: each hole, the rightmost first, is joined to the nearest corner it sees of what there is, by an edge there and back."""
    ring = outline if _area(outline) > 0 else outline[::-1]
    for hole in sorted(holes, key=lambda h: (-max(h)[0], -max(h)[1])):
        hole = hole if _area(hole) < 0 else hole[::-1]
        at = hole.index(max(hole))
        start = hole[at]
        walls = [(p, q) for r in [ring, *holes] for p, q in zip(r, r[1:] + r[:1], strict=True)]
        order = sorted(range(len(ring)), key=lambda i: (math.hypot(ring[i][0] - start[0], ring[i][1] - start[1]), i))
        see = next((i for i in order if not any(_crosses(start, ring[i], p, q) for p, q in walls) and _opens(ring, i, start)), order[0])
        ring = ring[: see + 1] + hole[at:] + hole[: at + 1] + ring[see:]
    return ring


def _opens(ring: list[Point], i: int, to: Point) -> bool:
    """Whether a point lies within the corner's inner angle."""
    a, b, c = ring[i - 1], ring[i], ring[(i + 1) % len(ring)]
    left, right = _turn(a, b, to) > 0, _turn(b, c, to) > 0
    return left and right if _turn(a, b, c) > 0 else left or right


def ears(ring: list[Point]) -> list[tuple[Point, Point, Point]]:
    """Triangles of a ring wound with positive area: the first corner with no other in its triangle is cut off, again and again."""
    left, out = list(range(len(ring))), []
    while len(left) > 3:
        for k in range(len(left)):
            i, j, m = left[k - 1], left[k], left[(k + 1) % len(left)]
            a, b, c = ring[i], ring[j], ring[m]
            if _turn(a, b, c) <= 0:
                continue
            rest = (ring[o] for o in left if ring[o] not in (a, b, c))
            if any(_turn(a, b, p) >= 0 and _turn(b, c, p) >= 0 and _turn(c, a, p) >= 0 for p in rest):
                continue
            break
        else:  # only flat corners or crossing edges are left: the flattest goes
            k = min(range(len(left)), key=lambda k: abs(_turn(ring[left[k - 1]], ring[left[k]], ring[left[(k + 1) % len(left)]])))
        i, j, m = left[k - 1], left[k], left[(k + 1) % len(left)]
        if _turn(ring[i], ring[j], ring[m]) > 0:
            out.append((ring[i], ring[j], ring[m]))
        left.pop(k)
    if len(left) == 3 and _turn(*(ring[o] for o in left)) > 0:
        out.append(tuple(ring[o] for o in left))
    return out


def triangles(regions: DataFrame, *keys: str) -> DataFrame:
    """keys, tri, ax, az, bx, bz, cx, cz, area and upto (the running area): regions' rings (the outline, then holes) cut into triangles, holes left out.

    An outline of under three corners has none; a hole of under three corners is no hole.
    """
    kinds = ", ".join(f"{n} {t}" for n, t in regions.select(*keys).dtypes)
    names = ["ax", "az", "bx", "bz", "cx", "cz"]

    def run(batches):
        for batch in batches:
            at, tri, corners = [], [], []
            for i, rings in enumerate(batch.column(len(keys)).to_pylist()):
                outline, *holes = ([(float(v["x"]), float(v["z"])) for v in r] for r in rings)
                found = ears(bridged(outline, [h for h in holes if len(h) >= 3])) if len(outline) >= 3 else []
                at += [i] * len(found)
                tri += range(len(found))
                corners += [[c for p in t for c in p] for t in found]
            kept = [batch.column(k).take(pa.array(at, pa.int32())) for k in range(len(keys))]
            columns = np.array(corners, float).reshape(-1, 6).T
            yield pa.RecordBatch.from_arrays([*kept, pa.array(tri, pa.int32()), *(pa.array(c) for c in columns)], [*keys, "tri", *names])

    found = regions.select(*keys, "rings").mapInArrow(run, f"{kinds}, tri int, " + ", ".join(f"{n} double" for n in names))
    c = F.col
    area = F.abs((c("bx") - c("ax")) * (c("cz") - c("az")) - (c("cx") - c("ax")) * (c("bz") - c("az"))) / 2
    w = Window.partitionBy(*keys).orderBy("tri").rowsBetween(Window.unboundedPreceding, 0)
    return found.withColumn("area", area).withColumn("upto", F.sum("area").over(w))


def simplified(rings: Column, share: float = 0.75) -> Column:
    """Rings without their least important corners: the share of each that is left, rounded up (three at least)."""

    @F.arrow_udf("array<array<struct<x: double, z: double, y: double>>>")
    def thin(all_: pa.Array) -> pa.Array:
        def one(ring) -> list:
            x, z = (np.array([v[c] for v in ring], float) for c in "xz")
            return [ring[i] for i in visvalingam(x, z, math.inf, math.ceil(len(ring) * share))]

        return pa.array([rings and [one(r) if len(r) > 3 else r for r in rings] for rings in all_.to_pylist()], all_.type)

    return thin(rings)
