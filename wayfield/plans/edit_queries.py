"""Queries over edits of a zone: holes, patches, areas, labels, triangles and regions built around mobs, with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfield.functions import geometry as G
from wayfield.operators import holes, raster, shapes, workflows
from wayfield.plans.node_queries import steep_triangles
from wayfield.plans.queries import _INSIDE, _REGIONS, _TRAIL, query
from wayfield.plans.surface_queries import mesh
from wayfield.plans.zone_queries import _zr, _zs
from wayfield.sources import areas
from wayfield.sources import entities as E


def spawn_points(spark: SparkSession, d: str, version: int = 0) -> DataFrame:
    """The zones' spawns with their points as x, y, z, and lists in place of nulls."""
    s = E.zone_spawns(spark, d, version)
    legs = s.schema["path"].dataType.simpleString()
    return s.select("zone", "id", "name", *(F.get("at", F.lit(i)).alias(c) for i, c in enumerate("xyz")), F.coalesce("regions", F.array().cast("array<string>")).alias("regions"), F.coalesce("path", F.array().cast(legs)).alias("path"))


def _cells(spark: SparkSession, d: str, size: float) -> DataFrame:
    return E.trail_points(spark, d).select("zone", G.cell(F.col("x"), size).alias("ix"), G.cell(F.col("z"), size).alias("iz")).distinct()


@query(f"""WITH RECURSIVE {_TRAIL}, {_zs(0)}, bl AS (SELECT DISTINCT zone, floor(x / 6)::INT AS ix, floor(z / 6)::INT AS iz FROM trail), ins AS (SELECT zone, ix, iz FROM (SELECT unnest(range(5)) AS zone), (SELECT unnest(range(-1, 84)) AS ix), (SELECT unnest(range(-1, 20)) AS iz) WHERE (ix + 0.5) * 6 > 0 AND (ix + 0.5) * 6 < 490 AND (iz + 0.5) * 6 > 0 AND (iz + 0.5) * 6 < 99),
k AS (SELECT zone, ix, iz, (ix + 65536)::BIGINT * 131072 + iz + 65536 AS id FROM ins WHERE (zone, ix, iz) NOT IN (SELECT (zone, ix, iz) FROM bl)), o4 AS (SELECT * FROM (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) AS o(a, b)), e AS (SELECT k.zone, k.id AS u, m.id AS v FROM k, o4 JOIN k m ON m.zone = k.zone AND m.ix = k.ix + a AND m.iz = k.iz + b),
l(zone, id, root) USING KEY (zone, id) AS (SELECT zone, id, id FROM k UNION SELECT e.zone, e.u, min(l.root) FROM l JOIN e ON e.zone = l.zone AND e.v = l.id JOIN recurring.l AS own ON own.zone = e.zone AND own.id = e.u WHERE l.root < own.root GROUP BY e.zone, e.u),
ed AS (SELECT DISTINCT k.zone, k.id FROM k, o4 WHERE (k.zone, k.ix + a, k.iz + b) NOT IN (SELECT (zone, ix, iz) FROM ins)), sz AS (SELECT l.zone, l.root, count(*) AS n, count(ed.id) > 0 AS edge FROM l LEFT JOIN ed ON ed.zone = l.zone AND ed.id = l.id GROUP BY ALL),
sd AS (SELECT zone, id, (floor(pt[1] / 6)::BIGINT + 65536) * 131072 + floor(pt[3] / 6)::BIGINT + 65536 AS cell FROM zs0 WHERE pt IS NOT NULL)
SELECT sd.zone, sd.id, CASE WHEN n IS NULL THEN 'blocked' WHEN n > 5 THEN 'over budget' WHEN edge THEN 'at the edge' ELSE 'enclosed' END AS patch, CASE WHEN n > 5 THEN 5 ELSE n END AS cells FROM sd LEFT JOIN l ON l.zone = sd.zone AND l.id = sd.cell LEFT JOIN sz ON sz.zone = l.zone AND sz.root = l.root""")
def seed_patches(spark: SparkSession, d: str) -> DataFrame:
    """The unvisited ground around each spawn's point, in a field that holds all points, up to five cells."""
    corner = lambda x, z: F.struct(F.lit(float(x)).alias("x"), F.lit(float(z)).alias("z"), F.lit(0.0).alias("y"))
    field = E.trail_points(spark, d).select("zone").distinct().withColumn("rings", F.array(F.array(corner(0, 0), corner(490, 0), corner(490, 99), corner(0, 99))))
    seeds = spawn_points(spark, d).where("x is not null").select("zone", "id", G.cell(F.col("x"), 6.0).alias("ix"), G.cell(F.col("z"), 6.0).alias("iz"))
    found = holes.seed_patches(seeds, raster.cells_inside(field, "zone", 6.0), _cells(spark, d, 6.0), "zone", F.lit(5))
    patch = F.when(~F.col("found"), "blocked").when(F.col("over_budget"), "over budget").when(F.col("touches_edge"), "at the edge").otherwise("enclosed")
    return found.select("zone", "id", patch.alias("patch"), "cells")


_HOLES = "hl AS (SELECT s_suppkey % 5 AS zone, s_suppkey AS hole, (s_suppkey * 37 % 1009) * 0.25::DOUBLE AS x0, (s_suppkey * 53 % 883) * 0.25::DOUBLE AS z0, 2 + s_suppkey % 3 AS side FROM supplier)"


@query(f"WITH {_HOLES}, p AS (SELECT a.zone, a.hole, b.hole AS other, b.x0, b.z0, b.side FROM hl a JOIN hl b ON a.zone = b.zone WHERE sqrt(greatest(0, b.x0 - a.x0 - a.side, a.x0 - b.x0 - b.side) ** 2 + greatest(0, b.z0 - a.z0 - a.side, a.z0 - b.z0 - b.side) ** 2) <= 5) SELECT zone, hole, string_agg(other::VARCHAR, ' ' ORDER BY other) AS members, min(x0) AS x0, max(x0 + side) AS x1, min(z0) AS z0, max(z0 + side) AS z1 FROM p GROUP BY ALL")
def hole_groups(spark: SparkSession, d: str) -> DataFrame:
    """Square holes with what lies within five yalms of each, and the box of their hull."""
    k = F.col("s_suppkey")
    x, z, side = (k * 37 % 1009) * 0.25, (k * 53 % 883) * 0.25, 2 + k % 3
    corner = lambda cx, cz: F.struct(cx.cast("double").alias("x"), cz.cast("double").alias("z"))
    rows = E.table(spark, d, "supplier").select((k % 5).alias("zone"), k.alias("hole"), F.array(corner(x, z), corner(x + side, z), corner(x + side, z + side), corner(x, z + side)).alias("ring"))
    g = holes.hole_groups(rows, "zone", 5.0).withColumn("b", G.box(F.col("corners")))
    return g.select("zone", "hole", F.array_join("members", " ").alias("members"), "b.x0", "b.x1", "b.z0", "b.z1")


def _steep_cells(spark: SparkSession, d: str) -> DataFrame:
    return raster.sampled(steep_triangles(spark, d).where(raster.steep()), 0.5, "zone").where("foot - top >= 0.5")


@query()
def margin_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells around steep faces that no mob was seen in, freed of slots."""
    return holes.grown(_steep_cells(spark, d), _cells(spark, d, 0.5), "zone", 1.5).select("zone", "ix", "iz", F.round("foot", 6).alias("foot"))


@query()
def margin_rings(spark: SparkSession, d: str) -> DataFrame:
    """Rings around steep faces that hold no cell that a mob was seen in."""
    return holes.margin_rings(_steep_cells(spark, d), _cells(spark, d, 0.5), "zone", 1.5)


@query()
def label_groups(spark: SparkSession, d: str) -> DataFrame:
    """Labels of trigger areas (suppliers), zone lines and arrivals (customers' points), those near each other under one."""
    k = F.col("s_suppkey")
    triggers = E.table(spark, d, "supplier").select((k % 5).alias("zone"), k.alias("id"), (k * 37 % 500 * 1.0).alias("x"), (k % 25 * 1.0).alias("y"), (k * 53 % 99 * 1.0).alias("z"))
    lines = spawn_points(spark, d).where("x is not null").select("zone", "id", ((F.col("zone") + F.col("id")) % 5).alias("to"), "x", "y", "z")
    arrivals = lines.where("zone <> `to`").select(F.col("to").alias("zone"), "id", F.col("zone").alias("origin"), "x", "y", "z")
    return holes.label_groups(holes.feature_labels(triggers, lines, arrivals), "zone", "at")


@query(f"WITH {_REGIONS} SELECT name, 120 * 24 - CASE WHEN holed THEN 300 ELSE 0 END::DOUBLE AS area, CASE WHEN holed THEN 8 ELSE 2 END AS triangles, round(120 * 24 - CASE WHEN holed THEN 300 ELSE 0 END::DOUBLE, 6) AS upto FROM reg")
def region_triangles(spark: SparkSession, d: str) -> DataFrame:
    """Regions cut into triangles: their areas' sum, their number, and the running area of the last."""
    t = shapes.triangles(E.regions(spark, d), "name")
    return t.groupBy("name").agg(F.round(F.sum("area"), 6).alias("area"), F.count(F.lit(1)).alias("triangles"), F.round(F.max_by("upto", "tri"), 6).alias("upto"))


@query(f"WITH {_zr(0)} SELECT zone, name, greatest(least(len(outline), 3), ceil(len(outline) * 0.75))::INT AS corners, CASE WHEN holed THEN 3 END AS hole FROM zr0")
def simplified_regions(spark: SparkSession, d: str) -> DataFrame:
    """A quarter of each ring's corners dropped."""
    r = E.zone_regions(spark, d).withColumn("rings", shapes.simplified(F.col("rings")))
    return r.select("zone", "name", F.size(F.get("rings", F.lit(0))).alias("corners"), F.when(F.size("rings") > 1, F.size(F.get("rings", F.lit(1)))).alias("hole"))


@query(f"""WITH {_zr(0)}, a AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY nr) AS area FROM zr0) SELECT zone, area, 'region ' || name AS description, CASE WHEN nr % 3 = 0 THEN nr - 5.5::DOUBLE END AS y_min, CASE WHEN nr % 3 = 0 THEN nr + 7.25::DOUBLE END AS y_max, CASE WHEN nr % 3 = 1 THEN nr * 1.0::DOUBLE END AS y_mid, CASE WHEN nr % 6 = 1 THEN 4.0::DOUBLE END AS y_extent,
array_to_string([p.x::INT || ' ' || p.z::INT FOR p IN outline], ', ') AS polygon, CASE WHEN holed THEN array_to_string([p.x::INT || ' ' || p.z::INT FOR p IN rings[2]], ', ') ELSE '' END AS hole FROM a""")
def areas_read_back(spark: SparkSession, d: str) -> DataFrame:
    """Area definitions as written, one file a zone, read again."""
    nr = F.col("nr").cast("double")
    y = {"yMin": F.when(F.col("nr") % 3 == 0, nr - 5.5), "yMax": F.when(F.col("nr") % 3 == 0, nr + 7.25), "y": F.when(F.col("nr") % 3 == 1, nr), "yExtent": F.when(F.col("nr") % 6 == 1, F.lit(4.0))}
    text = areas.area_text(y, F.element_at("rings", 1), F.slice("rings", 2, 9), F.concat(F.lit("region "), "name"))
    one = E.zone_regions(spark, d).select("zone", "nr", text.alias("text")).groupBy("zone").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nr", "text"))), lambda r: r["text"]), ",\n").alias("text"))
    ring = lambda r: F.array_join(F.transform(r, lambda v: F.concat_ws(" ", v["x"].cast("int"), v["z"].cast("int"))), ", ")
    back = areas.read_areas(one, "zone")
    return back.select("zone", "area", "description", "y_min", "y_max", "y_mid", "y_extent", ring(F.col("polygon")).alias("polygon"), F.coalesce(ring(F.get("holes", F.lit(0))), F.lit("")).alias("hole"))


@query("""WITH b AS (SELECT s_suppkey AS id, s_suppkey % 50 - 7.5::DOUBLE AS xa, s_suppkey % 30 + 2.25::DOUBLE AS xb, s_suppkey % 11 - 3.0::DOUBLE AS ya, s_suppkey % 13 - 1.0::DOUBLE AS yb, s_suppkey % 17 * 1.0::DOUBLE AS za, s_suppkey % 19 + 20.5::DOUBLE AS zb, CASE WHEN s_suppkey % 2 = 1 THEN 0.5::DOUBLE ELSE 0 END AS turn FROM supplier),
k AS (SELECT *, least(xa, xb) AS x0, greatest(xa, xb) AS x1, least(za, zb) AS z0, greatest(za, zb) AS z1, (xa + xb) / 2 AS cx, (za + zb) / 2 AS cz FROM b), c AS (SELECT *, unnest([x0, x1, x1, x0]) AS px, unnest([z0, z0, z1, z1]) AS pz, unnest(range(4)) AS i FROM k)
SELECT id, i::INT AS at, CASE WHEN turn <> 0 THEN turn END AS rotation, least(ya, yb) AS y_min, greatest(ya, yb) AS y_max, round(cx + (px - cx) * cos(turn) - (pz - cz) * sin(turn), 6) AS x, round(cz + (px - cx) * sin(turn) + (pz - cz) * cos(turn), 6) AS z FROM c""")
def trigger_polygons(spark: SparkSession, d: str) -> DataFrame:
    """Cuboid calls of a script as polygons to edit."""
    k = F.col("s_suppkey")
    numbers = [k % 50 - 7.5, k % 11 - 3.0, k % 17 * 1.0, k % 30 + 2.25, k % 13 - 1.0, k % 19 + 20.5]
    call = F.concat(F.lit("zone:registerCuboidTriggerArea("), k.cast("string"), *(F.format_string(", %.2f", v) for v in numbers), F.when(k % 2 == 1, ", 0.5").otherwise(""), F.lit(")"))
    found = areas.editable_triggers(E.table(spark, d, "supplier").select(k.alias("file"), call.alias("text")), "file")
    return found.select("id", F.posexplode("polygon").alias("at", "p"), "rotation", "y_min", "y_max").select("id", "at", "rotation", "y_min", "y_max", F.round("p.x", 6).alias("x"), F.round("p.z", 6).alias("z"))


@query("WITH a AS (SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN p_size * 1.0::DOUBLE END AS lo, CASE WHEN p_size % 3 = 0 THEN p_size + 9.0::DOUBLE END AS hi, CASE WHEN p_size % 2 = 1 THEN p_retailprice END AS mid, CASE WHEN p_size % 5 = 1 THEN 3.0::DOUBLE END AS ext FROM part) SELECT id, round(CASE WHEN lo IS NOT NULL OR hi IS NOT NULL THEN coalesce(lo, -1000) WHEN mid IS NOT NULL THEN mid - coalesce(ext, 10) ELSE -1000 END, 6) AS y_min, round(CASE WHEN lo IS NOT NULL OR hi IS NOT NULL THEN coalesce(hi, 1000) WHEN mid IS NOT NULL THEN mid + coalesce(ext, 10) ELSE 1000 END, 6) AS y_max, lo IS NULL AND hi IS NULL AND mid IS NULL AS unlimited FROM a")
def area_bands(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    band = areas.area_heights(F.when(s % 4 == 0, s * 1.0), F.when(s % 3 == 0, s + 9.0), F.when(s % 2 == 1, F.col("p_retailprice")), F.when(s % 5 == 1, F.lit(3.0)))
    return E.table(spark, d, "part").select(F.col("p_partkey").alias("id"), band.alias("b")).select("id", F.round("b.y_min", 6).alias("y_min"), F.round("b.y_max", 6).alias("y_max"), "b.unlimited")


@query(f"""WITH {_REGIONS}, {_zs(0)}, p AS (SELECT zone, id, pt[1] AS x, pt[2] AS y, pt[3] AS z, coalesce(array_to_string(regions, ','), '') AS now FROM zs0 WHERE pt IS NOT NULL), f AS (SELECT p.*, r.name, abs(p.y - r.floor) AS dy, (x1 - x0) * (z1 - z0) AS span, r.nr FROM p JOIN reg r ON r.floor = p.zone * 5 AND {_INSIDE}), m AS (SELECT *, min(dy) OVER (PARTITION BY zone, id) AS best FROM f)
SELECT zone, id, now, name FROM m WHERE dy <= best + 5 QUALIFY row_number() OVER (PARTITION BY zone, id ORDER BY span, nr) = 1""")
def covered_spawns(spark: SparkSession, d: str) -> DataFrame:
    """What each spawn is given to and the region of its zone that covers its point."""
    return workflows.covered_by(spawn_points(spark, d), E.regions(spark, d))


@query()
def built_for_spawns(spark: SparkSession, d: str) -> DataFrame:
    """Regions built around the zones' spawns, and the one each spawn is in."""
    named, homes = _built(spark, d)
    n = named.groupBy("zone").agg(F.count(F.lit(1)).alias("regions"))
    return homes.join(n, "zone")


def _built(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    zone_of = E.trail_points(spark, d).select(F.col("mob_id").alias("id"), "zone").distinct()
    spawns = spawn_points(spark, d).drop("zone").join(zone_of, "id")  # a spawn's trail says which zone it walks in
    return workflows.build_regions(spawns, E.trail_points(spark, d), E.regions(spark, d).select("zone", F.lower("name").alias("name")))


@query()
def region_patrols(spark: SparkSession, d: str) -> DataFrame:
    """Routes in place of regions."""
    found = workflows.patrols(E.spawns(spark, d), E.trail_points(spark, d), least=5, close=40.0, least_gap=86400)
    return found.select("region", "lead", F.round("coverage", 6).alias("coverage"), F.size("legs").alias("legs"), F.size("members").alias("members"))


@query()
def refitted_regions(spark: SparkSession, d: str) -> DataFrame:
    """Regions fitted anew to the trails of their mobs."""
    found = workflows.refitted(spawn_points(spark, d), E.trail_points(spark, d))
    return found.select("zone", "name", "pieces", F.size("rings").alias("rings"), F.round(G.region_area(F.col("rings")), 3).alias("area"))


@query()
def zone_floors(spark: SparkSession, d: str) -> DataFrame:
    """Which map's ground trails, regions and spawns stand on."""
    return workflows.floors(spawn_points(spark, d), E.trail_points(spark, d), E.zone_regions(spark, d), mesh(spark, d))


@query("SELECT n_name AS name, lower(replace(n_name, ' ', '_')) || '_a' || n_nationkey || '_b' AS folder FROM nation")
def bracketed_folders(spark: SparkSession, d: str) -> DataFrame:
    """Folders of zones whose names hold brackets and signs."""
    from wayfield.sources import texts

    name = F.concat("n_name", F.lit(" [#A'"), F.col("n_nationkey").cast("string"), F.lit("] - (B)"))
    return E.table(spark, d, "nation").select(F.col("n_name").alias("name"), texts.zone_folder(name).alias("folder"))
