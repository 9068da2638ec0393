"""Readers, writers, checks, rasters and node recovery on small cases whose answers are known."""

import gzip
import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from wayfield import registry
from wayfield.functions import geometry as G
from wayfield.operators import graph, lines, maps, nodes, raster, routes, trails, zones
from wayfield.sources import texts

DATA = "/root/testdata/sf0.001"


def test_every_rule_of_the_check_fires(spark):
    codes = {r.code for r in registry.queries()["zone_check"](spark, "/root/testdata/sf0.01").select("code").distinct().collect()}
    assert codes >= {"outline-vertices", "outline-crosses-itself", "legs", "region-and-route", "undefined-region", "outside", "nearer-floor", "fixed-points", "nowhere"}
    region = [(1, "R", 0, [[(0.0, 0.0, 0.0), (4.0, 0.0, 0.0), (4.0, 4.0, 0.0)]])]
    regions = spark.createDataFrame(region, "zone long, name string, nr int, rings array<array<struct<x:double,z:double,y:double>>>")
    spawns = spark.createDataFrame([], "zone long, id long, name string, at array<double>, regions array<string>, path array<struct<x:double,y:double,z:double>>, loop boolean")
    assert [(r.code, r.region) for r in zones.validate(regions, spawns).collect()] == [("no-spawns", "R")]


def test_patching_keeps_the_rest_of_the_file(spark):
    text = "# head\nspawns:\n  7:\n    template: Bat\n    level: [1, 2]\n    at: [1.000, 2.000, 3.000]\n  8:\n    template: Rat\n    circuit:\n      - [0, 0, 0]\n      - [1, 0, 0]\n    script: x\n  9:\n    template: Cat\n    region: a\nslots:\n  - 1\n"
    files = spark.createDataFrame([("z", text)], "zone string, text string")
    point = "array<struct<x:double,y:double,z:double>>"
    new = [("z", 7, ["a", "b"], None, None, None), ("z", 8, None, [(1.0, 2.0, 3.0), (2.0, 2.0, 2.0)], False, None), ("z", 9, None, None, None, None)]
    placements = spark.createDataFrame(new, f"zone string, id long, regions array<string>, path {point}, loop boolean, at array<double>")
    want = "# head\nspawns:\n  7:\n    template: Bat\n    region:   [a, b]\n    level:    [1, 2]\n  8:\n    template: Rat\n    script:   x\n    path:\n      - [1.000, 2.000, 3.000]\n      - [2.000, 2.000, 2.000]\n  9:\n    template: Cat\n    at:       [0.000, 0.000, 0.100]\nslots:\n  - 1\n"
    assert texts.patch_spawns(files, placements, "zone").first().text == want


def test_pasted_texts(spark):
    both = "# --- regions.yaml ---\nregions:\n\n  r:\n    poly:\n      - [0, 1, 2]\n# --- mobs.yaml ---\nspawns:\n  1:\n    template: Bat\n"
    rows = [(1, both), (2, "spawns:\n  2:\n    template: Rat\n"), (3, "regions:\n  q:\n    poly:\n      - [1, 1, 1]\n      - [1, x, 1]\n"), (4, "# nothing\n")]
    sections = texts.pasted_sections(spark.createDataFrame(rows, "k long, text string"), "k")
    spawns = texts.parse_spawns(sections.where("kind = 'spawns'"), "k").collect()
    regions = texts.parse_regions(sections.where("kind = 'regions'"), "k").collect()
    assert sorted((r.k, r.id, r.name) for r in spawns) == [(1, 1, "Bat"), (2, 2, "Rat")] and sorted((r.k, r.name) for r in regions) == [(1, "r"), (3, "q")]
    assert [(r.k, r.line.strip()) for r in texts.malformed_regions(sections.where("kind = 'regions'"), "k").collect()] == [(3, "- [1, x, 1]")]


def test_files_of_roam_data_and_captures(spark, tmp_path):
    folder = tmp_path / "cap" / "West" / "Bat"
    folder.mkdir(parents=True)
    (folder / "17.csv").write_text("x,y,z,dir,timestamp\n1.5,2,3,7,100\n2.5,2,3,9,104\n")
    rows = texts.read_captures(spark, str(tmp_path / "cap")).orderBy("t").collect()
    assert [(r.zone, r.mob, r.mob_id, r.x, r.y, r.z, r.dir, r.t) for r in rows] == [("West", "Bat", "17", 1.5, 2.0, 3.0, 7, 100), ("West", "Bat", "17", 2.5, 2.0, 3.0, 9, 104)]
    assert texts.read_captures(spark, str(tmp_path / "cap"), swap=True).first().y == 3.0
    points = spark.createDataFrame([("w", 17, "Bat", k, float(k), 0.0, 1.0, k, 10 * k) for k in range(3)], "zone string, mob_id long, name string, seq long, x double, y double, z double, dir int, t long")
    texts.write_roam(points, str(tmp_path / "roam"))
    (file,) = (tmp_path / "roam").glob("zone=w/*.gz")
    text = gzip.decompress(file.read_bytes()).decode()
    back = texts.read_roam(spark.createDataFrame([("w", text)], "zone string, text string"), "zone").orderBy("seq").collect()
    assert [(r.mob_id, r.name, r.seq, r.x, r.dir, r.t) for r in back] == [("17", "Bat", k, float(k), k, 10 * k) for k in range(3)]


def test_captures_without_times(spark):
    rows = [(1, k, None, float(k if k < 10 else 1000 + k), 0.0, 0.0) for k in range(20)]
    p = spark.createDataFrame(rows, "mob_id long, seq long, t long, x double, y double, z double")
    assert [(r.capture, r.n) for r in trails.captures(p).orderBy("capture").collect()] == [(0, 10), (1, 10)]


def test_map_squares(spark):
    m = spark.createDataFrame([(1, 0, 5, 1, 1280, -304, -250, "a"), (1, 0, 9, 2, 100, 0, 0, "b")], "zone long, floor int, nr long, number int, scale int, offset_x int, offset_y int, image string")
    at = lambda x, z, floor: maps.squares_of(spark.createDataFrame([(1, floor, x, z)], "zone long, floor int, x double, z double"), m).first().square
    assert [at(0.0, 0.0, 0), at(32.0, 0.0, 0), at(0.0, 32.0, 0), at(-300.0, 0.0, 0), at(0.0, 0.0, 3)] == ["J-8", "K-8", "J-7", "A-8", None]
    grid = {r.name: r for r in maps.grid_squares(m).collect()}
    assert len(grid) == 225 and at(grid["C-4"].x, grid["C-4"].z, 0) == "C-4" and grid["C-4"].size == 32


def test_outlines_of_cells(spark):
    block = [(1, x, z) for x in range(6) for z in range(6) if not (x in (2, 3) and z in (2, 3))] + [(1, 6, 6), (2, 0, 0)]
    rings = raster.outlines(spark.createDataFrame(block, "k long, ix int, iz int"), "k").collect()
    assert sorted((r.k, r.hole, r.area, len(r.xs)) for r in rings) == [(1, False, 1.0, 4), (1, False, 36.0, 4), (1, True, 4.0, 4), (2, False, 1.0, 4)]


def test_regions_from_points(spark):
    rng = random.Random(2)
    blob = [(1, rng.uniform(0, 40), 5.0, rng.uniform(0, 40)) for _ in range(600)]
    around = [(2, 60 * math.cos(a) + rng.uniform(-6, 6), 1.0, 60 * math.sin(a) + rng.uniform(-6, 6)) for a in (rng.uniform(0, 7) for _ in range(2500))]
    camps = [(3, rng.uniform(0, 25) + 300 * (i % 2), 1.0, rng.uniform(0, 25)) for i in range(800)]
    points = spark.createDataFrame([(*p[:1], *p[1:]) for p in blob + around + camps], "k long, x double, y double, z double")
    p = raster.regions_from_points(points, "k").toPandas()
    rings = p.groupby(["k", "piece", "ring"]).agg(hole=("hole", "first"), n=("x", "size")).reset_index()
    assert rings.groupby("k").hole.agg(list).to_dict() == {1: [False], 2: [False, True], 3: [False, False]}
    assert (p[p.k == 1].y == 5.0).all() and (rings.n < 40).all()
    outline = [(r.x, r.z) for r in p[p.k == 1].sort_values("at").itertuples()]
    def inside(x, z):
        return sum((az > z) != (bz > z) and x < (bx - ax) * (z - az) / (bz - az) + ax for (ax, az), (bx, bz) in zip(outline, outline[1:] + outline[:1])) % 2
    assert np.mean([inside(x, z) for _, x, _, z in blob]) > 0.98


def test_offsets_are_solved(spark):
    mobs = spark.createDataFrame([(1, m) for m in (5, 6, 7)], "zone long, mob_id long")
    pairs = spark.createDataFrame([(1, 5, 6, 1.0, -2.0, 400)], "zone long, a long, b long, dx double, dz double, weight long")
    got = {r.mob_id: (r.ox, r.oz) for r in nodes.solve_offsets(mobs, pairs).collect()}
    assert np.allclose([got[6][0] - got[5][0], got[6][1] - got[5][1], *got[7]], [1, -2, 0, 0], atol=1e-3)


def walker(mob, places, offset, n, rng):
    """Samples of a mob that walks from place to place, stopping 0.6 short of each."""
    rows, at, t, seq, here = [], np.array(places[0]) + offset, 0, 0, 0
    for _ in range(n):
        to = rng.choice([i for i in range(len(places)) if i != here])
        goal = np.array(places[to]) + offset
        way = goal - at
        far = np.hypot(*way)
        way = way / far
        byte = int(math.floor(-math.atan2(way[1], way[0]) * 256 / (2 * math.pi))) % 256
        steps = np.append(np.arange(2.0, far - 0.6, 3.0), far - 0.6)
        for s in steps:
            p = at + way * s
            rows.append((1, mob, seq, t, float(p[0]), -3.0, float(p[1]), byte))
            seq, t = seq + 1, t + 4
        at, here = at + way * steps[-1], to
    return rows


def test_node_recovery(spark):
    rng = random.Random(6)
    places = [(0.0, 0.0), (40.0, 3.0), (20.0, 35.0), (60.0, 38.0), (-5.0, 55.0)]
    rows = [r for mob, off in ((1, (0.0, 0.0)), (2, (0.8, -0.5)), (3, (-0.4, 0.9))) for r in walker(mob, places, np.array(off), 60, rng)]
    points = spark.createDataFrame(rows, "zone long, mob_id long, seq long, t long, x double, y double, z double, dir int")
    names = spark.createDataFrame([(1, "Bat"), (2, "Big_Rat"), (3, "Pixie")], "mob_id long, name string")
    found, edges = nodes.extract(points, names)
    p = found.where("mobs >= 2").toPandas()
    mean = np.array([0.4, -0.25])  # of the two mobs' offsets; Pixie is left out
    for x, z in places:
        d = np.hypot(p.x - x - mean[0], p.z - z - mean[1])
        assert d.min() < 0.4
        assert p.loc[d.idxmin(), "y"] == -3.0 and list(p.loc[d.idxmin(), "species"]) == ["Bat", "Big Rat"]
    e = nodes.shown(found, edges, 2)[1].toPandas()
    assert len(e) >= 6 and set(e.a) | set(e.b) <= set(p.root)


def test_components_of_texts(spark):
    n = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "node string")
    got = {r.node: r.root for r in graph.components(n, spark.createDataFrame([("d", "c"), ("c", "b")], "u string, v string")).collect()}
    assert got == {"a": "a", "b": "b", "c": "b", "d": "b"}


def test_ring_with_zero_tolerance_ends():
    pts = pd.DataFrame({"x": np.cumsum(np.ones(200)), "z": np.random.default_rng(1).normal(size=200)})
    keep = lines.douglas_peucker(pts.x.to_numpy(), pts.z.to_numpy(), 0.0)
    assert keep.sum() == 200


def test_crossing_and_turning(spark):
    ring = lambda *c: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(z)).alias("z"), F.lit(0.0).alias("y")) for x, z in c])
    r = spark.range(1).select(G.crosses_itself(ring((0, 0), (4, 4), (4, 0), (0, 4))).alias("bow"), G.crosses_itself(ring((0, 0), (4, 0), (4, 4), (0, 4))).alias("square"), F.size(G.circle(F.lit(1.0), F.lit(0.0), F.lit(2.0), F.lit(3.0))).alias("n"), F.round(G.turned(F.lit(1.0), F.lit(0.0), F.lit(math.pi / 2))[1], 6).alias("z")).first()
    assert tuple(r) == (True, False, 16, 1.0)


def test_a_route_is_judged_within_its_trail(spark):
    """No join makes rows of legs and samples; what a route explains is known by hand."""
    rows = [(1, i, i, float(10 * (i % 12)), 0.0, float(i % 5)) for i in range(60)]
    found = routes.traced(spark.createDataFrame(rows, "mob_id long, seq long, t long, x double, y double, z double"))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    x, z = np.array([0.0, 100.0, 100.0, 0.0]), np.array([0.0, 0.0, 100.0, 100.0])
    side = np.arange(0.0, 100.0, 5.0)
    px, pz = np.concatenate([side, 0 * side + 100, 100 - side, 0 * side]), np.concatenate([0 * side, side, 0 * side + 100, 100 - side])
    assert routes.explained(x, z, px, pz, 8.0) == 1.0
    assert routes.explained(x, z, np.append(px, 50.0), np.append(pz, 50.0), 8.0) == 80 / 81
    assert routes.explained(x, z, px[:60], pz[:60], 8.0) == -1.0  # nobody was seen along the last leg


def test_routes_are_traced(spark):
    def around(corners, laps, step=3.0):
        out = []
        for _ in range(laps):
            for (ax, az), (bx, bz) in zip(corners, corners[1:] + corners[:1]):
                n = max(1, int(math.hypot(bx - ax, bz - az) / step))
                out += [(ax + (bx - ax) * k / n, az + (bz - az) * k / n) for k in range(n)]
        return out
    rng = random.Random(4)
    square, spur = around([(0, 0), (60, 0), (60, 60), (0, 60)], 3), around([(0, 0), (60, 0), (60, 30), (100, 30), (60, 30), (60, 60), (0, 60)], 6)
    blob = [(rng.uniform(0, 900), rng.uniform(0, 900)) for _ in range(400)]
    still = [(rng.uniform(0, 3), rng.uniform(0, 3)) for _ in range(200)]
    rows = [(mob, k, 4 * k, x, 0.0, z) for mob, line in enumerate((square, spur, blob, still)) for k, (x, z) in enumerate(line)]
    got = {r.mob_id: r for r in routes.traced(spark.createDataFrame(rows, "mob_id long, seq long, t long, x double, y double, z double")).collect()}
    assert set(got) == {0, 1} and got[0].coverage > 0.95 and got[1].coverage > 0.9 and 4 <= len(got[0].legs) <= 8
    assert any(math.hypot(v.x - 100, v.z - 30) < 4 for v in got[1].legs)
    lap = routes.laps(routes.placed(spark.createDataFrame(rows, "mob_id long, seq long, t long, x double, y double, z double")).where("mob_id = 0 and capture = -1")).collect()
    assert [(r.i0, r.i1) for r in lap][0][0] == 0 and len(lap) == 3
