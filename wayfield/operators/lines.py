"""Operators that are sequential within a line or ring: grouped Arrow functions, one group a line.

A group is one line's points (a trail of some thousand); lines spread over the cluster.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def douglas_peucker(x: np.ndarray, z: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points stay of an open line: none that goes is further than `tolerance` from the line that is left."""
    keep = np.zeros(len(x), bool)
    keep[[0, -1]] = True
    todo = [(0, len(x) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        px, pz, dx, dz = x[a + 1 : b] - x[a], z[a + 1 : b] - z[a], x[b] - x[a], z[b] - z[a]
        length = dx * dx + dz * dz
        t = np.clip((px * dx + pz * dz) / length, 0, 1) if length else np.zeros(len(px))
        far = np.hypot(px - t * dx, pz - t * dz)
        i = int(far.argmax())
        if far[i] > tolerance:
            keep[a + 1 + i] = True
            todo += [(a, a + 1 + i), (a + 1 + i, b)]
    return keep


def visvalingam(x: np.ndarray, z: np.ndarray, least_area: float, keep: int = 3) -> np.ndarray:
    """Positions of the corners that stay of a ring: the corner with the smallest triangle goes first, the earlier one on ties, while it is `least_area` at most."""
    n = len(x)
    before, after, turn = [(i - 1) % n for i in range(n)], [(i + 1) % n for i in range(n)], [0] * n
    def area(i: int) -> float:
        p, q = before[i], after[i]
        return abs((x[i] - x[p]) * (z[q] - z[p]) - (x[q] - x[p]) * (z[i] - z[p])) / 2
    heap = [(area(i), i, 0) for i in range(n)]
    heapq.heapify(heap)
    gone, left = set(), n
    while heap and left > max(3, keep):
        a, i, t = heapq.heappop(heap)
        if i in gone or t != turn[i]:  # the area was measured before a neighbour went
            continue
        if a > least_area:
            break
        gone.add(i)
        left -= 1
        p, q = before[i], after[i]
        after[p], before[q] = q, p
        for k in (p, q):
            turn[k] += 1
            heapq.heappush(heap, (area(k), k, turn[k]))
    return np.array([i for i in range(n) if i not in gone], int)


def hull(x: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Positions of the convex hull's corners, counter-clockwise from the least (monotone chain)."""
    order = np.lexsort((z, x))
    def half(seq) -> list[int]:
        out: list[int] = []
        for i in seq:
            while len(out) > 1 and (x[out[-1]] - x[out[-2]]) * (z[i] - z[out[-2]]) - (x[i] - x[out[-2]]) * (z[out[-1]] - z[out[-2]]) <= 0:
                out.pop()
            out.append(int(i))
        return out[:-1]
    return np.array(half(order) + half(order[::-1]), int) if len(x) > 2 else order


def _grouped(points: DataFrame, keys: list[str], order: str, pick) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, ignore_index=True)
        out = pdf.iloc[pick(pdf["x"].to_numpy(float), pdf["z"].to_numpy(float))].reset_index(drop=True)
        return out.assign(at=np.arange(len(out)))

    kinds = ", ".join(f"{n} {t}" for n, t in points.select(*keys, order, "x", "z").dtypes)
    return points.select(*keys, order, "x", "z").groupBy(*keys).applyInPandas(run, f"{kinds}, at long")


def simplify_lines(points: DataFrame, key: str, order: str, tolerance: float = 2.0, most: int = 64, loosen: float = 1.5) -> DataFrame:
    """Each line by Douglas-Peucker, with a wider tolerance until it has `most` points at most."""

    def pick(x: np.ndarray, z: np.ndarray) -> np.ndarray:
        width = tolerance
        while (keep := douglas_peucker(x, z, width)).sum() > most:
            width = width * loosen or 1e-6
        return np.flatnonzero(keep)

    return _grouped(points, [key], order, pick)


def simplify_rings(points: DataFrame, key: str, order: str, least_area: float = 4.0, keep: int = 3) -> DataFrame:
    return _grouped(points, [key], order, lambda x, z: visvalingam(x, z, least_area, keep))


def hulls(points: DataFrame, key: str, order: str, many: int = 100_000) -> DataFrame:
    """Corners of each key's convex hull.  Points of a key with more than `many` are dealt into parts of about as many; the corners of the parts' hulls make the key's."""
    rows = points.select(key, order, "x", "z")
    size = points.groupBy(key).agg(F.count(F.lit(1)).alias("w_n")).where(F.col("w_n") > many)
    if not size.limit(1).count():
        return _grouped(rows, [key], order, hull)
    big = rows.join(F.broadcast(size), key).withColumn("w_part", F.pmod(F.xxhash64(order), F.ceil(F.col("w_n") / many))).drop("w_n")  # at most one row of size for each `many` points
    corners = _grouped(big, [key, "w_part"], order, hull).drop("w_part", "at")
    return _grouped(rows.join(F.broadcast(size.select(key)), key, "left_anti").unionByName(corners), [key], order, hull)
