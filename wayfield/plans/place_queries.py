"""Queries over places: nearest others, islands, floors and colours of ground, drawn boxes, replayed files, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfield.functions import geometry as G
from wayfield.operators import nodes, places
from wayfield.plans.edit_queries import spawn_points
from wayfield.plans.queries import _INSIDE, _REGIONS, _SPAWNS, _TRAIL, query
from wayfield.plans.surface_queries import _MESH, _TRI, _at, mesh
from wayfield.plans.zone_queries import _zs
from wayfield.sources import entities as E
from wayfield.sources import texts
from wayfield.streaming import sessions

_ISLANDS = """own AS (SELECT p_partkey AS poly, CASE WHEN p_partkey = 0 THEN 0 ELSE (p_partkey - 1) // 7 * 7 + 1 END AS island FROM part),
gl AS (SELECT a.island AS u, b.island AS v FROM own a JOIN own b ON b.poly = a.poly + 40 WHERE a.poly % 35 = 0), ge AS (SELECT u, v FROM gl UNION SELECT v, u FROM gl),
lk(island, root) USING KEY (island) AS (SELECT DISTINCT island, island FROM own UNION SELECT e.u, min(lk.root) FROM lk JOIN ge e ON e.v = lk.island JOIN recurring.lk AS o ON o.island = e.u WHERE lk.root < o.root GROUP BY e.u)"""


def _islands(spark: SparkSession, d: str) -> DataFrame:
    """Runs of seven parts are islands; every thirty-fifth has a link to the fortieth after it."""
    k = E.table(spark, d, "part").select(F.col("p_partkey").alias("poly"))
    last = k.select((F.col("poly") - 1).alias("u"))  # parts with one after them
    link = k.withColumnRenamed("poly", "u").join(last, "u", "left_semi").where("u % 7 <> 0").select("u", (F.col("u") + 1).alias("v"))
    extra = k.where("poly % 35 = 0").select(F.col("poly").alias("u"), (F.col("poly") + 40).alias("v")).join(k.withColumnRenamed("poly", "v"), "v", "left_semi")
    return places.islands(k, link, extra)


@query(f"WITH RECURSIVE {_ISLANDS} SELECT poly, own.island, root AS linked FROM own JOIN lk ON lk.island = own.island")
def mesh_islands(spark: SparkSession, d: str) -> DataFrame:
    return _islands(spark, d)


@query(f"""WITH {_TRI}, {_zs(0)}, own AS (SELECT p_partkey AS poly, CASE WHEN p_partkey = 0 THEN 0 ELSE (p_partkey - 1) // 7 * 7 + 1 END AS island FROM part), sz AS (SELECT island, count(*) AS size FROM own GROUP BY 1), md AS (SELECT zone, tri AS poly, (ax + bx + cx) / 3 AS x, (ay + by_ + cy) / 3 AS y, (az + bz + cz) / 3 AS z FROM {_MESH}),
n AS (SELECT s.zone, s.id, poly, sqrt((md.x - pt[1]) ** 2 + (md.y - pt[2]) ** 2 + (md.z - pt[3]) ** 2) AS d FROM zs0 s JOIN md ON md.zone = s.zone WHERE pt IS NOT NULL), b AS (SELECT zone, id, arg_min(poly, {{'d': d, 'p': poly}}) AS poly, min(d) AS d FROM n GROUP BY ALL) SELECT zone, id, island, size, round(d, 6) AS distance FROM b JOIN own USING (poly) JOIN sz USING (island)""")
def nearest_islands(spark: SparkSession, d: str) -> DataFrame:
    """The island nearest to each spawn's point."""
    third = lambda c: ((F.col("a" + c) + F.col("b" + c) + F.col("c" + c)) / 3).alias(c)
    polygons = mesh(spark, d).select("zone", F.col("tri").alias("poly"), *(third(c) for c in "xyz"))
    points = spawn_points(spark, d).where("x is not null").select("zone", "id", "x", "y", "z")
    return places.nearest_islands(points, polygons, _islands(spark, d), "zone").withColumn("distance", F.round("distance", 6))


@query(f"""WITH {_TRAIL}, {_zs(0)}, p AS (SELECT zone, id, pt[2] AS y, floor(pt[1] / 4) AS ix, floor(pt[3] / 4) AS iz FROM zs0 WHERE pt IS NOT NULL), m AS (SELECT p.zone, p.id, greatest(abs(floor(t.x / 4) - ix), abs(floor(t.z / 4) - iz)) AS w, sum(t.y) / count(*) AS mean FROM p JOIN trail t ON t.zone = p.zone AND abs(floor(t.x / 4) - ix) <= 3 AND abs(floor(t.z / 4) - iz) <= 3 GROUP BY ALL), b AS (SELECT zone, id, arg_min(mean, w) AS mean FROM m GROUP BY ALL)
SELECT p.zone, p.id, round(coalesce(mean, y), 6) AS floor FROM p LEFT JOIN b ON b.zone = p.zone AND b.id = p.id""")
def sample_floors(spark: SparkSession, d: str) -> DataFrame:
    points = spawn_points(spark, d).where("x is not null").select("zone", "id", "x", "y", "z")
    return places.sample_floors(points, E.trail_points(spark, d), "zone").withColumn("floor", F.round("floor", 6))


@query(f"""WITH {_TRAIL}, {_REGIONS}, s AS (SELECT floor(x / 4) AS ix, floor(z / 4) AS iz, sum(dir) AS r, sum(seq % 200) AS g, sum(t % 100) AS b, count(*) AS n FROM trail GROUP BY ALL), c AS (SELECT name, sum(r) / sum(n) / 255 AS r, sum(g) / sum(n) / 255 AS g, sum(b) / sum(n) / 255 AS b FROM reg JOIN s ON (ix + 0.5) * 4 >= x0 AND (ix + 0.5) * 4 < x1 AND (iz + 0.5) * 4 >= z0 AND (iz + 0.5) * 4 < z1 GROUP BY 1),
k AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM c) SELECT name, round(CASE WHEN hi = lo THEN 0 WHEN hi = r THEN ((g - b) / (hi - lo) + 6) % 6 WHEN hi = g THEN (b - r) / (hi - lo) + 2 ELSE (r - g) / (hi - lo) + 4 END / 6, 6) AS h, round(CASE WHEN hi = lo THEN 0 WHEN hi + lo <= 1 THEN (hi - lo) / (hi + lo) ELSE (hi - lo) / (2 - hi - lo) END, 6) AS s, round((hi + lo) / 2, 6) AS l FROM k""")
def region_colours(spark: SparkSession, d: str) -> DataFrame:
    """The ground's mean colour under each region."""
    samples = E.trail_points(spark, d).select("x", "z", F.col("dir").alias("r"), (F.col("seq") % 200).alias("g"), (F.col("t") % 100).alias("b"))
    return places.region_colours(E.regions(spark, d), samples, "name").select("name", *(F.round(f"colour.{c}", 6).alias(c) for c in "hsl"))


@query(f"""WITH {_TRI}, dr AS (SELECT s_suppkey % 5 AS zone, s_suppkey AS id, s_suppkey * 37 % 480 + 0.31::DOUBLE AS ax, s_suppkey * 53 % 97 + 0.17::DOUBLE AS az, s_suppkey * 37 % 480 + 0.31::DOUBLE + s_suppkey % 9 - 4 AS bx, s_suppkey * 53 % 97 + 0.17::DOUBLE + s_suppkey % 7 AS bz FROM supplier),
bx AS (SELECT zone, id, least(ax, bx) AS x0, least(az, bz) AS z0, greatest(ax, bx) AS x1, greatest(az, bz) AS z1 FROM dr WHERE abs(ax - bx) >= 1 AND abs(az - bz) >= 1), sp AS (SELECT zone, id, unnest([x0, x1, x1, x0, (x0 + x1) / 2]) AS x, unnest([z0, z0, z1, z1, (z0 + z1) / 2]) AS z FROM bx),
f AS (SELECT id, floor(min(y)) - 5 AS lo, ceil(max(y)) + 10 AS hi FROM (SELECT id, wa, wb, wa * ay + wb * by_ + (1 - wa - wb) * cy AS y FROM (SELECT t.*, sp.id, {_at('sp.x', 'sp.z')} FROM sp JOIN {_MESH} t ON t.zone = sp.zone)) WHERE wa >= -0.000001 AND wb >= -0.000001 AND 1 - wa - wb >= -0.000001 GROUP BY 1)
SELECT bx.zone, bx.id, x0, z0, x1, z1, lo AS y_min, hi AS y_max FROM bx LEFT JOIN f ON f.id = bx.id""")
def drawn_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes as drags would make them, with their heights from the ground."""
    k = F.col("s_suppkey")
    x, z = k * 37 % 480 + 0.31, k * 53 % 97 + 0.17
    drags = E.table(spark, d, "supplier").select((k % 5).alias("zone"), k.alias("id"), x.alias("ax"), z.alias("az"), (x + k % 9 - 4).alias("bx"), (z + k % 7).alias("bz"))
    return places.drawn_boxes(drags, mesh(spark, d), "zone")


@query(f"WITH {_TRAIL}, {_zs(0)}, a AS (SELECT x, y, z FROM trail UNION ALL SELECT pt[1], pt[2], pt[3] FROM zs0 WHERE pt IS NOT NULL) SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM a")
def view_frame(spark: SparkSession, d: str) -> DataFrame:
    return places.frame(E.trail_points(spark, d), spawn_points(spark, d).where("x is not null"))


@query("SELECT p_partkey AS id, (p_partkey * 31 & 15)::INT AS material, CASE WHEN p_partkey * 31 & 16 <> 0 THEN 1 ELSE 0 END + CASE WHEN p_size % 3 = 0 THEN 2 ELSE 0 END AS barrier, (p_partkey * 17 >> 2 & 1) = 1 AS roofed FROM part")
def triangle_kinds(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return E.table(spark, d, "part").select(k.alias("id"), places.triangle_kinds(k * 31, k * 17, F.col("p_size") % 3 == 0).alias("t")).select("id", "t.material", "t.barrier", "t.roofed")


@query("""WITH f AS (SELECT c_custkey AS k, c_custkey % 60 AS zone, 'f' || c_custkey AS path, c_name AS text FROM customer), h AS (SELECT *, CASE WHEN k % 331 = 5 THEN text || '!' ELSE text END AS later, CASE WHEN k % 2 = 0 THEN text || '?' ELSE text END AS edit FROM f),
e AS (SELECT zone, path, sha1('blob ' || octet_length(encode(edit)) || chr(0) || edit) AS sha, CASE WHEN k % 10 <> 9 THEN text END AS was, CASE WHEN k % 10 <> 9 THEN later END AS now, edit FROM h WHERE k % 3 <> 1)
SELECT zone, path, sha, CASE WHEN bool_or(was IS DISTINCT FROM now) OVER (PARTITION BY zone) THEN 'stale' WHEN now = edit THEN 'unchanged' ELSE 'written' END AS state FROM e""")
def replayed_files(spark: SparkSession, d: str) -> DataFrame:
    """Edited files put on a tree that has moved on in some zones."""
    k = F.col("c_custkey")
    f = E.table(spark, d, "customer").select(k, (k % 60).alias("zone"), F.concat(F.lit("f"), k.cast("string")).alias("path"), F.col("c_name").alias("text"))
    tree = lambda text: f.where("c_custkey % 10 <> 9").select("zone", "path", places.blob_sha(text).alias("sha"))
    now = F.when(k % 331 == 5, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    edits = f.where("c_custkey % 3 <> 1").select("zone", "path", F.when(k % 2 == 0, F.concat("text", F.lit("?"))).otherwise(F.col("text")).alias("text"))
    return places.replayed(edits, tree(F.col("text")), tree(now))


@query("SELECT c_custkey::VARCHAR || CASE WHEN c_custkey % 50 = 0 THEN 'x' ELSE '' END AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 50 = 0, CASE WHEN c_custkey % 50 <> 0 THEN c_custkey END, c_custkey::VARCHAR || 'x') AS place FROM customer")
def mobs_by_number(spark: SparkSession, d: str) -> DataFrame:
    """Mobs in the order of their ids' numbers; ids that are none come last."""
    k = F.col("c_custkey")
    named = E.table(spark, d, "customer").select("c_nationkey", F.concat(k.cast("string"), F.when(k % 50 == 0, "x").otherwise("")).alias("id"))
    return places.numbered(named, "c_nationkey", "id").select("id", "place")


@query(f"WITH {_REGIONS}, {_SPAWNS}, m AS (SELECT p.id, r.name, {_INSIDE} AS inside, CASE WHEN p.x BETWEEN x0 AND x1 AND p.z BETWEEN z0 AND z1 THEN least(p.x - x0, x1 - p.x, p.z - z0, z1 - p.z) ELSE sqrt(greatest(x0 - p.x, 0, p.x - x1) ** 2 + greatest(z0 - p.z, 0, p.z - z1) ** 2) END AS far, p.x >= r.x0 AND p.x < r.x1 AND p.z >= r.z0 AND p.z < r.z1 AS outline FROM member p JOIN reg r ON r.name = p.name) SELECT id, name, outline OR far <= 3.0007 AS near FROM m")
def near_outlines(spark: SparkSession, d: str) -> DataFrame:
    """Whether members stand in their region's outline or within three yalms of it."""
    m = E.spawns(spark, d).select("id", "x", "z", F.explode("regions").alias("name")).join(E.regions(spark, d), "name")
    return m.select("id", "name", G.within_ring(F.col("x"), F.col("z"), F.element_at("rings", 1), 3.0007).alias("near"))


@query("""SELECT s_suppkey AS id, unnest(['regions', 'spawns']) AS kind, unnest(['regions:' || chr(10) || '  r' || s_suppkey || ':' || chr(10), 'spawns:' || chr(10) || '  ' || s_suppkey || ':' || chr(10)]) AS text FROM supplier WHERE s_suppkey % 3 = 0
UNION ALL SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 1 THEN 'spawns' ELSE 'regions' END, CASE WHEN s_suppkey % 3 = 1 THEN 'spawns:' || chr(10) || '  ' || s_suppkey || ':' || chr(10) ELSE 'regions:' || chr(10) || '  r' || s_suppkey || ':' || chr(10) END FROM supplier WHERE s_suppkey % 3 <> 0""")
def pasted_sections(spark: SparkSession, d: str) -> DataFrame:
    """Pasted texts taken apart by their marks, or by what is in them."""
    k = F.col("s_suppkey").cast("string")
    r, s = F.concat(F.lit("regions:\n  r"), k, F.lit(":")), F.concat(F.lit("spawns:\n  "), k, F.lit(":"))
    both = F.concat(F.lit("# --- regions.yaml ---\n"), r, F.lit("\n# -- Mobs.YML (new)\n"), s)
    text = F.when(F.col("s_suppkey") % 3 == 0, both).when(F.col("s_suppkey") % 3 == 1, s).otherwise(r)
    found = texts.pasted_sections(E.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), text.alias("text")), "id")
    return found.select("id", "kind", F.concat(F.rtrim("text"), F.lit("\n")).alias("text"))


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("c_custkey")
    c = E.table(spark, d, "customer")
    nodes_ = c.select((k % 3).alias("zone"), k.alias("root"), (k % 7).alias("mobs"))
    return nodes_, c.select((k % 3).alias("zone"), k.alias("a"), (k + 3).alias("b"), (k % 5).alias("count"))


@query("WITH n AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 7 >= 2) SELECT c_custkey % 3 AS zone, c_custkey AS a, c_custkey + 3 AS b, c_custkey % 5 AS count FROM customer WHERE c_custkey % 5 >= 2 AND c_custkey IN (SELECT k FROM n) AND c_custkey + 3 IN (SELECT k FROM n)")
def shown_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges walked twice at least between nodes of two mobs at least."""
    return nodes.shown(*_graph(spark, d), 2)[1]


@query(f"WITH {_TRAIL}, n AS (SELECT mob_id, seq % 3 = 0 AS new, count(*) AS n, max(seq) AS last FROM trail GROUP BY ALL) SELECT mob_id, n, last FROM n QUALIFY row_number() OVER (PARTITION BY mob_id ORDER BY n DESC, new) = 1")
def longer_trails(spark: SparkSession, d: str) -> DataFrame:
    """Of what is stored of a mob and what a new capture holds (every third sample here) the longer."""
    one = lambda rows: rows.groupBy("mob_id").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last"))
    p = E.trail_points(spark, d)
    return sessions.longer_wins(one(p.where("seq % 3 <> 0")), one(p.where("seq % 3 = 0")))


@query("SELECT n_regionkey AS zone, c_custkey AS node FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)")
def collected_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Stored nodes by zone: a zone's collections (nations with a supplier), and the nodes of each."""
    s = E.table(spark, d, "supplier").select(F.col("s_nationkey").alias("c_nationkey")).distinct()
    zone = E.table(spark, d, "nation").select(F.col("n_regionkey").alias("zone"), F.col("n_nationkey").alias("c_nationkey"))
    return E.table(spark, d, "customer").join(F.broadcast(zone), "c_nationkey").join(s, "c_nationkey", "left_semi").select("zone", F.col("c_custkey").alias("node"))  # 25 nations
