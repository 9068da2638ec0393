"""Every query of the library with SQL gives the SQL's rows; the others are held against brute force below."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wayfield import registry
from wayfield.functions import geometry as G
from wayfield.operators import graph, grid, lines, regions
from wayfield.streaming import sessions

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def rows(pdf):
    def value(x):
        if x is None or (not isinstance(x, (list, np.ndarray)) and pd.isna(x)):
            return ""
        return repr(float(x)) if isinstance(x, (int, float, np.number, np.bool_)) else str(x)

    return sorted(tuple(value(x) for x in r) for r in pdf[sorted(pdf.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, con, name):
    got, want = registry.queries()[name](spark, DATA).toPandas(), con.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def ring(*corners):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(z)).alias("z")) for x, z in corners])


def test_ring_functions(spark):
    r = ring((4, 0), (4, 3), (0, 3), (0, 0))
    one = spark.range(1).select(
        G.signed_area(r).alias("area"), G.in_ring(F.lit(1.0), F.lit(1.0), r).alias("inside"), G.in_ring(F.lit(5.0), F.lit(1.0), r).alias("outside"),
        G.ring_distance(F.lit(5.0), F.lit(1.0), r).alias("far"), G.within_ring(F.lit(4.5), F.lit(1.0), r, 0.5).alias("near"), G.canonical_ring(r).alias("turned"),
        G.contains(F.lit(1.0), F.lit(1.0), F.array(r, ring((0, 0), (2, 0), (2, 2), (0, 2)))).alias("in_hole"), G.contains(F.lit(1.0), F.lit(1.0), F.array(ring((0, 0), (2, 0)))).alias("thin"),
    ).first()
    assert (abs(one.area), one.inside, one.outside, one.far, one.near, one.in_hole, one.thin) == (12.0, True, False, 1.0, True, False, False)
    assert tuple(one.turned[0]) == (0.0, 0.0)


def test_douglas_peucker_keeps_within_tolerance():
    rng = np.random.default_rng(3)
    x, z = np.cumsum(rng.normal(size=200)), np.cumsum(rng.normal(size=200))
    keep = np.flatnonzero(lines.douglas_peucker(x, z, 1.5))
    for a, b in zip(keep, keep[1:]):
        for i in range(a, b + 1):
            dx, dz = x[b] - x[a], z[b] - z[a]
            t = min(1, max(0, ((x[i] - x[a]) * dx + (z[i] - z[a]) * dz) / (dx * dx + dz * dz)))
            assert math.hypot(x[i] - x[a] - t * dx, z[i] - z[a] - t * dz) <= 1.5 + 1e-9
    assert len(keep) < 200


def test_visvalingam_and_hull():
    x, z = np.array([0, 5, 10, 10, 0.0]), np.array([0, 0.1, 0, 10, 10.0])
    assert lines.visvalingam(x, z, 4).tolist() == [0, 2, 3, 4]
    rng = np.random.default_rng(1)
    x, z = rng.random(60), rng.random(60)
    h = lines.hull(x, z)
    for i in range(60):  # no point lies right of an edge
        for a, b in zip(h, np.roll(h, -1)):
            assert (x[b] - x[a]) * (z[i] - z[a]) - (x[i] - x[a]) * (z[b] - z[a]) >= -1e-12


def test_line_queries(spark):
    p = registry.queries()["simplified_trails"](spark, DATA).groupBy("mob_id").agg(F.max("at").alias("k")).toPandas()
    assert len(p) and (p.k < 64).all()
    assert registry.queries()["trail_hulls"](spark, DATA).count() > 0


def test_components_match_union_find(spark):
    rng = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))]
    place = list(range(120))
    def find(i):
        while place[i] != i:
            i = place[i]
        return i
    for a, b in links:
        a, b = find(a), find(b)
        place[max(a, b)] = min(a, b)
    nodes = spark.range(120).withColumnRenamed("id", "node")
    got = {r.node: r.root for r in graph.components(nodes, spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: find(i) for i in range(120)}


def test_zone_pieces_match_union_find(spark, con):
    pts = con.execute("select distinct user_id % 5, cast(floor(value / 10) as int), cast(floor(cast(json_extract_string(props, '$.k') as double) / 10) as int) from events").fetchall()
    place = {p: p for p in pts}
    def find(p):
        while place[p] != p:
            p = place[p]
        return p
    for zone, ix, iz in pts:
        for q in ((zone, ix + 1, iz), (zone, ix, iz + 1)):
            if q in place:
                a, b = find((zone, ix, iz)), find(q)
                place[max(a, b)] = min(a, b)
    want = {}
    for p in pts:
        want[find(p)] = want.get(find(p), 0) + 1
    got = {(r.zone, r.root): r.cells for r in registry.queries()["zone_pieces"](spark, DATA).collect()}
    assert got == {(zone, (ix + 65536) * 131072 + iz + 65536): n for (zone, ix, iz), n in want.items()} and len({z for z, _ in got}) == 5


def test_empty_tables(spark):
    points = spark.createDataFrame([], "zone long, mob_id long, seq long, t long, x double, y double, z double, dir int")
    assert grid.close(grid.cells(points, 10, "zone"), "zone").count() == 0
    assert lines.simplify_lines(points, "mob_id", "seq").count() == 0
    empty = spark.createDataFrame([], "id long, region int")
    assert regions.diff(empty, empty).count() == 0
    assert regions.merge(empty, empty, empty, "id", "region").count() == 0


def test_merge_takes_the_side_that_changed(spark):
    side = lambda rows: spark.createDataFrame(rows, "id long, v string")
    base, theirs, ours = side([(1, "a"), (2, "a"), (3, "a"), (4, "a"), (5, "a")]), side([(1, "b"), (2, "a"), (3, "b"), (5, "a"), (6, "n")]), side([(1, "a"), (2, "c"), (3, "c"), (4, "a")])
    got = {r.id: (r.v, r.conflict) for r in regions.merge(base, theirs, ours, "id", "v").collect()}
    assert got == {1: ("b", False), 2: ("c", False), 3: ("c", True), 6: ("n", False)}


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    events.repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))
    run = sessions.stream(spark, str(tmp_path / "in"), events.schema, late="400 days").writeStream.format("memory").queryName("sessions").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    want = sessions.sessions(events)
    assert rows(spark.table("sessions").select("mob_id", "start", "n").toPandas()) == rows(want.select("mob_id", "start", "n").toPandas())


def test_longer_wins(spark):
    a, b = spark.createDataFrame([(1, 5, "old"), (2, 9, "old")], "mob_id long, n long, p string"), spark.createDataFrame([(1, 6, "new"), (2, 9, "new"), (3, 1, "new")], "mob_id long, n long, p string")
    assert {r.mob_id: r.p for r in sessions.longer_wins(a, b).collect()} == {1: "new", 2: "old", 3: "new"}
