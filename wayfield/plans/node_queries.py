"""Queries over rays, nodes, rasters and obstacles, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfield.operators import graph, grid, nodes, raster, routes
from wayfield.plans.queries import _TRAIL, query
from wayfield.sources import entities as E

_RAYS = """rays AS (SELECT c_nationkey AS mob_id, c_custkey AS leg, c_acctbal / 20 + 0.01337::DOUBLE AS x, c_custkey % 100 + 0.01717::DOUBLE AS z, CASE WHEN c_custkey % 2 = 0 THEN 0.6 ELSE -0.6 END::DOUBLE AS dx, CASE WHEN c_custkey % 3 = 0 THEN 0.8 ELSE -0.8 END::DOUBLE AS dz, c_custkey * 17 % 1000 AS t, c_custkey % 4 = 0 AS from_heading FROM customer)"""
_NODES = """nodes AS (SELECT n_regionkey AS zone, c_nationkey AS mob_id, c_custkey AS node, round((c_acctbal / 200)::VARCHAR::DECIMAL(30, 15), 2)::DOUBLE + (c_nationkey % 3) * 0.1 AS x, (c_custkey % 50) + (c_nationkey % 2) * 0.2 AS z FROM customer JOIN nation ON n_nationkey = c_nationkey),
pts AS (SELECT zone, lpad(mob_id::VARCHAR, 4, '0') || '/' || lpad(node::VARCHAR, 8, '0') AS key, x, z FROM nodes)"""
_VOTES = f"{_RAYS}, s AS (SELECT unnest(range(48)) AS s), vc AS (SELECT DISTINCT mob_id, leg, floor((x + s * 0.25 * dx) / 0.5)::INT AS ix, floor((z + s * 0.25 * dz) / 0.5)::INT AS iz FROM rays, s), votes AS (SELECT mob_id, ix, iz, count(*) AS n FROM vc GROUP BY ALL)"
_K = [math.exp(-(i * i) / 4.5) for i in range(-6, 7)]
_KERNEL = "ker AS (SELECT unnest(range(-6, 7)) AS d, unnest([" + ", ".join(f"{v / sum(_K)!r}" for v in _K) + "]) AS w)"


def rays(spark: SparkSession, d: str) -> DataFrame:
    """Rays of the customers: three-four-five directions, so that no engine's sine matters."""
    k = F.col("c_custkey")
    return E.table(spark, d, "customer").select(
        F.col("c_nationkey").alias("mob_id"), k.alias("leg"), (F.col("c_acctbal") / 20 + 0.01337).alias("x"), (k % 100 + 0.01717).alias("z"),
        F.when(k % 2 == 0, 0.6).otherwise(-0.6).alias("dx"), F.when(k % 3 == 0, 0.8).otherwise(-0.8).alias("dz"), (k * 17 % 1000).alias("t"), (k % 4 == 0).alias("from_heading"),
    )


def mob_nodes(spark: SparkSession, d: str) -> DataFrame:
    nation = E.table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("zone"))
    k, m = F.col("c_custkey"), F.col("c_nationkey")
    c = E.table(spark, d, "customer").join(F.broadcast(nation), "c_nationkey")  # 25 rows
    return c.select("zone", m.alias("mob_id"), k.alias("node"), (F.round(F.col("c_acctbal") / 200, 2) + m % 3 * 0.1).alias("x"), (k % 50 + m % 2 * 0.2).alias("z"))


def keyed_nodes(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat_ws("/", F.lpad(F.col("mob_id").cast("string"), 4, "0"), F.lpad(F.col("node").cast("string"), 8, "0"))
    return mob_nodes(spark, d).select("zone", key.alias("key"), "x", "z")


@query(f"""WITH {_TRAIL}, s AS (SELECT *, dir // 128 AS h FROM trail), g AS (SELECT *, CASE WHEN h <> lag(h) OVER w OR t - lag(t) OVER w > 50000 OR lag(t) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM s WINDOW w AS (PARTITION BY mob_id ORDER BY seq)),
r AS (SELECT *, sum(new) OVER (PARTITION BY mob_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS leg FROM g),
l AS (SELECT mob_id, leg, count(*) AS n, arg_min({{'x': x, 'z': z}}, seq) AS a, arg_max({{'x': x, 'z': z, 't': t, 'dir': dir}}, seq) AS b, arg_min(t, seq) AS t0, var_pop(x) AS sxx, covar_pop(x, z) AS sxz, var_pop(z) AS szz FROM r GROUP BY ALL),
n AS (SELECT *, lead(a) OVER (PARTITION BY mob_id ORDER BY leg) AS nx, lead(t0) OVER (PARTITION BY mob_id ORDER BY leg) AS nt, 0.5 * atan2(2 * sxz, sxx - szz) AS ang, -(b.dir + 0.5) * 2 * pi() / 256 AS byte FROM l),
k AS (SELECT *, b.x - a.x AS vx, b.z - a.z AS vz, nx.x - b.x AS tx, nx.z - b.z AS tz FROM n WHERE nx IS NOT NULL AND nt - b.t <= 50000),
w AS (SELECT *, CASE WHEN n >= 2 AND sqrt(vx * vx + vz * vz) >= 1 THEN 1 WHEN sqrt(tx * tx + tz * tz) >= 1 AND cos(byte) * tx + sin(byte) * tz >= -0.5 * sqrt(tx * tx + tz * tz) THEN 2 END AS kind FROM k)
SELECT mob_id, CAST(leg AS BIGINT) AS leg, b.x AS x, b.z AS z, round(CASE WHEN kind = 1 THEN cos(ang) * CASE WHEN cos(ang) * vx + sin(ang) * vz < 0 THEN -1 ELSE 1 END ELSE cos(byte) END, 6) + 0.0 AS dx, round(CASE WHEN kind = 1 THEN sin(ang) * CASE WHEN cos(ang) * vx + sin(ang) * vz < 0 THEN -1 ELSE 1 END ELSE sin(byte) END, 6) + 0.0 AS dz, b.t AS t, kind = 2 AS from_heading FROM w WHERE kind IS NOT NULL""")
def arrival_rays(spark: SparkSession, d: str) -> DataFrame:
    found = nodes.arrival_rays(E.trail_points(spark, d), 50000, F.floor(F.col("dir") / 128))
    return found.withColumns({"dx": F.round("dx", 6) + 0.0, "dz": F.round("dz", 6) + 0.0})


@query(f"WITH {_VOTES} SELECT mob_id, ix, iz, n FROM votes")
def ray_votes(spark: SparkSession, d: str) -> DataFrame:
    return nodes.votes(rays(spark, d))


@query(f"WITH {_VOTES}, {_KERNEL}, b AS (SELECT mob_id, ix + k.d AS ix, iz, sum(n * w) AS v FROM votes, ker k GROUP BY ALL), c AS (SELECT mob_id, ix, iz + k.d AS iz, sum(v * w) AS v FROM b, ker k GROUP BY ALL) SELECT mob_id, count(*) AS cells, round(sum(v), 6) AS total, round(max(v), 6) AS top FROM c GROUP BY 1")
def vote_heat(spark: SparkSession, d: str) -> DataFrame:
    return nodes.blurred(nodes.votes(rays(spark, d))).groupBy("mob_id").agg(F.count(F.lit(1)).alias("cells"), F.round(F.sum("v"), 6).alias("total"), F.round(F.max("v"), 6).alias("top"))


@query(f"WITH {_VOTES}, p AS (SELECT v.mob_id, v.ix, v.iz, v.n, max(o.n) AS m FROM votes v JOIN votes o ON o.mob_id = v.mob_id AND o.ix BETWEEN v.ix - 2 AND v.ix + 1 AND o.iz BETWEEN v.iz - 2 AND v.iz + 1 WHERE v.n > 1 GROUP BY ALL) SELECT mob_id, ix, iz, n FROM p WHERE n = m")
def vote_peaks(spark: SparkSession, d: str) -> DataFrame:
    v = nodes.votes(rays(spark, d)).withColumn("v", F.col("n"))
    return nodes.peaks(v, least=1).drop("v")


@query(f"WITH {_NODES} SELECT a.zone, a.key AS a, b.key AS b, round(sqrt((a.x - b.x) ** 2 + (a.z - b.z) ** 2), 6) AS distance FROM pts a JOIN pts b ON a.zone = b.zone AND a.key < b.key WHERE sqrt((a.x - b.x) ** 2 + (a.z - b.z) ** 2) < 4.005")
def near_nodes(spark: SparkSession, d: str) -> DataFrame:
    p = keyed_nodes(spark, d)
    return nodes.near_pairs(p, p, 4.005, ("zone",)).where("key < b_key").select("zone", F.col("key").alias("a"), F.col("b_key").alias("b"), F.round("distance", 6).alias("distance"))


@query(f"WITH {_NODES}, bx AS (SELECT zone, mob_id, min(x) - 3 AS x0, max(x) + 3 AS x1, min(z) - 3 AS z0, max(z) + 3 AS z1 FROM nodes GROUP BY ALL) SELECT a.zone, a.mob_id AS a, b.mob_id AS b FROM bx a JOIN bx b ON a.zone = b.zone AND a.mob_id < b.mob_id WHERE a.x0 < b.x1 AND b.x0 < a.x1 AND a.z0 < b.z1 AND b.z0 < a.z1")
def overlapping_mobs(spark: SparkSession, d: str) -> DataFrame:
    return nodes.box_pairs(mob_nodes(spark, d))


@query(f"WITH {_NODES}, m AS (SELECT a.zone, a.mob_id AS am, a.node AS an, b.mob_id AS bm, b.node AS bn, b.x - a.x AS dx, b.z - a.z AS dz, row_number() OVER (PARTITION BY a.mob_id, a.node, b.mob_id ORDER BY sqrt((a.x - b.x) ** 2 + (a.z - b.z) ** 2), b.node) AS k FROM nodes a JOIN nodes b ON a.zone = b.zone AND a.mob_id <> b.mob_id WHERE sqrt((a.x - b.x) ** 2 + (a.z - b.z) ** 2) < 3.005) SELECT f.zone, f.am AS a, f.bm AS b, f.an AS na, f.bn AS nb, round(f.dx, 6) AS dx, round(f.dz, 6) AS dz FROM m f JOIN m g ON f.am = g.bm AND f.an = g.bn AND f.bm = g.am AND f.bn = g.an WHERE f.k = 1 AND g.k = 1 AND f.am < f.bm")
def mutual_nodes(spark: SparkSession, d: str) -> DataFrame:
    n = mob_nodes(spark, d)
    still = n.select("mob_id").distinct().withColumns({"ox": F.lit(0.0), "oz": F.lit(0.0)})
    return nodes.mutual_pairs(n, still, 3.005).withColumns({"dx": F.round("dx", 6), "dz": F.round("dz", 6)})


@query(f"""WITH RECURSIVE {_NODES}, e AS (SELECT a.key AS u, b.key AS v FROM pts a JOIN pts b ON a.zone = b.zone AND a.key <> b.key WHERE sqrt((a.x - b.x) ** 2 + (a.z - b.z) ** 2) < 1.805),
l(key, root) USING KEY (key) AS (SELECT key, key FROM pts UNION SELECT e.u, min(l.root) FROM l JOIN e ON e.v = l.key JOIN recurring.l AS own ON own.key = e.u WHERE l.root < own.root GROUP BY e.u) SELECT key, root FROM l""")
def node_clusters(spark: SparkSession, d: str) -> DataFrame:
    return nodes.clusters(keyed_nodes(spark, d), 1.805)


def _match(w: int) -> str:
    return f"{_RAYS}, {_NODES}, j AS (SELECT r.mob_id, r.leg, n.node, (n.x - r.x) * dx + (n.z - r.z) * dz AS along, abs((n.x - r.x) * dz - (n.z - r.z) * dx) AS across FROM rays r JOIN nodes n ON n.mob_id = r.mob_id), hit AS (SELECT mob_id, leg, arg_min(node, {{'along': along, 'node': node}}) AS node FROM j WHERE across < {w} AND along > 0 AND along < 12 GROUP BY ALL)"


@query(f"WITH {_match(2)} SELECT r.mob_id, r.leg, r.t, node FROM rays r LEFT JOIN hit h ON h.mob_id = r.mob_id AND h.leg = r.leg")
def matched_rays(spark: SparkSession, d: str) -> DataFrame:
    return nodes.matched_rays(rays(spark, d), mob_nodes(spark, d), across=2.0)


@query(f"WITH {_match(20)}, m AS (SELECT n_regionkey AS zone, r.mob_id, r.leg, r.t, node % 7 AS root FROM rays r JOIN nation ON n_nationkey = r.mob_id LEFT JOIN hit h ON h.mob_id = r.mob_id AND h.leg = r.leg), s AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 400 THEN lag(root) OVER w END AS f FROM m WINDOW w AS (PARTITION BY mob_id ORDER BY leg)) SELECT zone, least(f, root) AS a, greatest(f, root) AS b, count(*) AS count FROM s WHERE f IS NOT NULL AND root IS NOT NULL AND f <> root GROUP BY ALL")
def walked_edges(spark: SparkSession, d: str) -> DataFrame:
    zone = E.table(spark, d, "nation").select(F.col("n_nationkey").alias("mob_id"), F.col("n_regionkey").alias("zone"))
    hits = nodes.matched_rays(rays(spark, d), mob_nodes(spark, d), across=20.0).withColumn("root", F.col("node") % 7).join(zone, "mob_id")
    return nodes.visited_edges(hits, 400)


@query(f"WITH {_NODES}, g AS (SELECT a.zone, a.key, min(sqrt((a.x - b.x) ** 2 + (a.z - b.z) ** 2)) AS gap FROM pts a JOIN pts b ON a.zone = b.zone AND a.key <> b.key GROUP BY ALL) SELECT p.zone, p.key, round(CASE WHEN gap < 3.005 THEN gap END, 6) AS gap FROM pts p LEFT JOIN g ON g.key = p.key")
def node_gaps(spark: SparkSession, d: str) -> DataFrame:
    return nodes.nearest_gap(keyed_nodes(spark, d), 3.005).withColumn("gap", F.round("gap", 6))


_TALL = _NODES.replace("SELECT zone, lpad", "SELECT zone, node % 7 * 1.0::DOUBLE AS y, lpad").replace("AS key, x, z FROM", "AS key, x + node % 1000 * 0.0001371::DOUBLE AS x, z FROM")


def tall_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes with heights, moved a little apart, so that no two distances are equal."""
    node = F.substring_index("key", "/", -1).cast("int")
    return keyed_nodes(spark, d).select("zone", "key", (F.col("x") + node % 1000 * 0.0001371).alias("x"), (node % 7 * 1.0).alias("y"), "z")


@query(f"""WITH {_TALL}, p AS (SELECT a.zone, a.key AS a, b.key AS b, (b.x - a.x) ** 2 + (b.y - a.y) ** 2 + (b.z - a.z) ** 2 AS d, atan2(b.x - a.x, b.z - a.z) + pi() AS way FROM pts a JOIN pts b ON a.zone = b.zone AND a.key <> b.key AND abs(a.x - b.x) <= 8 AND abs(a.z - b.z) <= 8 WHERE (b.x - a.x) ** 2 + (b.y - a.y) ** 2 + (b.z - a.z) ** 2 <= 64),
k AS (SELECT DISTINCT l.a, l.b FROM p l JOIN p o ON o.a = l.a AND o.d < l.d AND (abs(l.way - o.way) < pi() / 5 OR abs(l.way - o.way) > 2 * pi() - pi() / 5)) SELECT zone, a, b, round(sqrt(d), 6) AS distance FROM p WHERE (a, b) NOT IN (SELECT (a, b) FROM k)""")
def node_links(spark: SparkSession, d: str) -> DataFrame:
    return nodes.links(tall_nodes(spark, d), 8.0).withColumn("distance", F.round("distance", 6))


@query(f"WITH {_NODES}, g AS (SELECT a.zone, a.key, a.x, a.z, min(sqrt((a.x - b.x) ** 2 + (a.z - b.z) ** 2)) AS gap FROM pts a JOIN pts b ON a.zone = b.zone AND a.key <> b.key GROUP BY ALL HAVING gap < 3.005), m AS (SELECT p.zone, p.key, median(gap) AS spacing FROM pts p JOIN g ON g.zone = p.zone AND abs(g.x - p.x) <= 5.155 AND abs(g.z - p.z) <= 5.155 GROUP BY ALL HAVING count(*) >= 5) SELECT p.zone, p.key, round(spacing, 6) AS spacing FROM pts p LEFT JOIN m ON m.key = p.key")
def node_spacings(spark: SparkSession, d: str) -> DataFrame:
    """The usual gap between nodes around each node."""
    return nodes.local_gaps(keyed_nodes(spark, d), 3.005, 10.31).withColumn("spacing", F.round("spacing", 6))


@query(f"WITH {_NODES} SELECT zone, to_json(list([round(x, 2), round(z, 2)] ORDER BY key))::VARCHAR AS text FROM pts GROUP BY 1")
def node_positions(spark: SparkSession, d: str) -> DataFrame:
    """The nodes' positions as a JSON array a zone, as they are copied out."""
    p = keyed_nodes(spark, d).select("zone", "key", F.array(F.round("x", 2), F.round("z", 2)).alias("at"))
    return p.groupBy("zone").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("key", "at"))), lambda r: r["at"])).alias("text"))


@query(f"""WITH {_TRAIL}, {_NODES}, c AS (SELECT p.zone, p.key, t.y, sqrt((t.x - p.x) ** 2 + (t.z - p.z) ** 2) AS far, greatest(1, abs(floor(t.x / 4) - floor(p.x / 4)), abs(floor(t.z / 4) - floor(p.z / 4))) AS ring FROM pts p JOIN trail t ON t.zone = p.zone WHERE abs(floor(t.x / 4) - floor(p.x / 4)) <= 4 AND abs(floor(t.z / 4) - floor(p.z / 4)) <= 4),
n AS (SELECT zone, key, ring, sum(count(*)) OVER (PARTITION BY zone, key ORDER BY ring) AS n FROM c GROUP BY zone, key, ring), r AS (SELECT zone, key, coalesce(min(ring) FILTER (WHERE n >= 5), max(ring)) AS most FROM n GROUP BY ALL),
k AS (SELECT c.*, row_number() OVER (PARTITION BY c.zone, c.key ORDER BY far, y) AS k FROM c JOIN r ON r.zone = c.zone AND r.key = c.key WHERE ring <= most) SELECT zone, key, median(y) AS y FROM k WHERE k <= 5 GROUP BY ALL""")
def node_heights(spark: SparkSession, d: str) -> DataFrame:
    return nodes.node_heights(keyed_nodes(spark, d), E.trail_points(spark, d))


_CELLS = f"{_TRAIL}, low AS (SELECT zone, min(x) AS x0, min(z) AS z0 FROM trail GROUP BY 1), rc AS (SELECT t.zone, floor((x - x0) / 6)::INT AS ix, floor((z - z0) / 6)::INT AS iz, count(*) AS n, sum(y) AS y FROM trail t JOIN low ON low.zone = t.zone GROUP BY ALL)"
_GROWN = f"{_CELLS}, o7 AS (SELECT unnest(range(-3, 4)) AS s), o5 AS (SELECT unnest(range(-2, 3)) AS s), o3 AS (SELECT unnest(range(-1, 2)) AS s), d1 AS (SELECT DISTINCT zone, ix + a.s AS ix, iz + b.s AS iz FROM rc, o7 a, o7 b), e1 AS (SELECT zone, ix + a.s AS ix, iz + b.s AS iz FROM d1, o5 a, o5 b GROUP BY ALL HAVING count(*) = 25), gr AS (SELECT DISTINCT zone, ix + a.s AS ix, iz + b.s AS iz FROM e1, o3 a, o3 b)"


@query(f"WITH {_GROWN} SELECT zone, ix, iz FROM gr")
def covered_cells(spark: SparkSession, d: str) -> DataFrame:
    return raster.covered(raster.rasterised(E.trail_points(spark, d), "zone"), "zone")


@query(f"WITH {_GROWN} SELECT zone, count(*)::DOUBLE AS area FROM gr GROUP BY 1")
def outline_areas(spark: SparkSession, d: str) -> DataFrame:
    """What the rings around a zone's cells hold, holes taken off: one for each cell."""
    grown = raster.pieces(raster.covered(raster.rasterised(E.trail_points(spark, d), "zone"), "zone"), "zone")
    signed = F.when(F.col("hole"), -F.col("area")).otherwise(F.col("area"))
    return raster.outlines(grown, "zone", "piece").groupBy("zone").agg(F.sum(signed).alias("area"))


@query(f"WITH {_CELLS}, cs AS (SELECT DISTINCT zone, ix + 2 AS cx, iz + 1 AS cz FROM rc), w AS (SELECT unnest([1, 2, 3]) AS w), h AS (SELECT cs.zone, cx, cz, w.w, sum(y) / sum(n) AS y FROM cs, w, rc WHERE rc.zone = cs.zone AND ix >= cx - w.w AND ix < cx + w.w AND iz >= cz - w.w AND iz < cz + w.w GROUP BY ALL), al AS (SELECT zone, sum(y) / sum(n) AS mean FROM rc GROUP BY 1), f AS (SELECT zone, cx, cz, arg_min(y, w) AS y FROM h GROUP BY ALL) SELECT cs.zone, cs.cx, cs.cz, round(coalesce(f.y, mean), 6) AS y FROM cs JOIN al ON al.zone = cs.zone LEFT JOIN f ON f.zone = cs.zone AND f.cx = cs.cx AND f.cz = cs.cz")
def corner_heights(spark: SparkSession, d: str) -> DataFrame:
    cells = graph.kept(raster.rasterised(E.trail_points(spark, d), "zone"))
    corners = cells.select("zone", (F.col("ix") + 2).alias("cx"), (F.col("iz") + 1).alias("cz")).distinct()
    return raster.corner_heights(corners, cells, "zone").withColumn("y", F.round("y", 6))


@query()
def built_regions(spark: SparkSession, d: str) -> DataFrame:
    """Regions around each zone's points, corner by corner."""
    return raster.regions_from_points(E.trail_points(spark, d), "zone")


_NEAR = f"{_TRAIL}, wc AS (SELECT DISTINCT zone, floor(x / 4)::INT AS ix, floor(z / 4)::INT AS iz FROM trail), off AS (SELECT a, b FROM (SELECT unnest(range(-1, 2)) AS a), (SELECT unnest(range(-1, 2)) AS b) WHERE sqrt(a * a + b * b) * 4 <= 6), nc AS (SELECT DISTINCT zone, ix + a AS ix, iz + b AS iz FROM wc, off)"


@query(f"WITH {_NEAR} SELECT zone, ix, iz FROM nc")
def ground_near(spark: SparkSession, d: str) -> DataFrame:
    return raster.ground_near(grid.cells(E.trail_points(spark, d), 4, "zone"), 4.0, 4.0, "zone")


@query(f"""WITH RECURSIVE {_TRAIL}, wc AS (SELECT DISTINCT zone, floor(x / 8)::INT AS ix, floor(z / 8)::INT AS iz FROM trail WHERE abs(x - 200) > 40 OR abs(z - 50) > 20), ins AS (SELECT zone, ix, iz FROM (SELECT unnest(range(5)) AS zone), (SELECT unnest(range(-4, 70)) AS ix), (SELECT unnest(range(-4, 20)) AS iz) WHERE (ix + 0.5) * 8 BETWEEN 0 AND 490 AND (iz + 0.5) * 8 BETWEEN 0 AND 99),
fr AS (SELECT * FROM ins WHERE (zone, ix, iz) NOT IN (SELECT (zone, ix, iz) FROM wc)), k AS (SELECT zone, ix, iz, (ix + 65536)::BIGINT * 131072 + iz + 65536 AS id FROM fr), o4 AS (SELECT * FROM (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) AS o(a, b)), e AS (SELECT k.zone, k.id AS u, m.id AS v FROM k, o4 JOIN k m ON m.zone = k.zone AND m.ix = k.ix + a AND m.iz = k.iz + b),
l(zone, id, root) USING KEY (zone, id) AS (SELECT zone, id, id FROM k UNION SELECT e.zone, e.u, min(l.root) FROM l JOIN e ON e.zone = l.zone AND e.v = l.id JOIN recurring.l AS own ON own.zone = e.zone AND own.id = e.u WHERE l.root < own.root GROUP BY e.zone, e.u),
ed AS (SELECT DISTINCT k.zone, k.id FROM k, o4 WHERE (k.zone, k.ix + a, k.iz + b) NOT IN (SELECT (zone, ix, iz) FROM ins)) SELECT l.zone, l.root AS piece, count(*) AS cells FROM l LEFT JOIN ed ON ed.zone = l.zone AND ed.id = l.id GROUP BY ALL HAVING count(ed.id) = 0 AND count(*) BETWEEN 2 AND 200""")
def empty_patches(spark: SparkSession, d: str) -> DataFrame:
    """Patches in the middle of a field that no point came near (points of a hole in it are left out, so that there is one)."""
    points = E.trail_points(spark, d).where((F.abs(F.col("x") - 200) > 40) | (F.abs(F.col("z") - 50) > 20))
    corner = lambda x, z: F.struct(F.lit(float(x)).alias("x"), F.lit(float(z)).alias("z"), F.lit(0.0).alias("y"))
    field = E.trail_points(spark, d).select("zone").distinct().withColumn("rings", F.array(F.array(corner(0, 0), corner(490, 0), corner(490, 99), corner(0, 99))))
    return raster.empty_patches(raster.cells_inside(field, "zone", 8.0), grid.cells(points, 8, "zone"), "zone", 2, 200)


@query(f"WITH {_GROWN}, o8 AS (SELECT a, b, greatest(abs(a), abs(b)) + (sqrt(2) - 1) * least(abs(a), abs(b)) AS w FROM (SELECT unnest(range(-12, 13)) AS a), (SELECT unnest(range(-12, 13)) AS b)), f AS (SELECT g.zone, g.ix, g.iz, min(w) AS d FROM gr g, o8 WHERE (g.zone, g.ix + a, g.iz + b) NOT IN (SELECT (zone, ix, iz) FROM gr) GROUP BY ALL) SELECT zone, ix, iz, round(d, 6) AS d FROM f")
def cell_clearance(spark: SparkSession, d: str) -> DataFrame:
    """How far cells are from the edge."""
    c = raster.clearance(raster.covered(raster.rasterised(E.trail_points(spark, d), "zone"), "zone"), "zone")
    return c.select("zone", "ix", "iz", F.round("d", 6).alias("d"))


@query(f"WITH {_GROWN}, q AS (SELECT zone, vx, vz, count(*) AS k, count(*) FILTER (WHERE a = b) AS m FROM (SELECT zone, ix + a AS vx, iz + b AS vz, a, b FROM gr, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b)) GROUP BY ALL) SELECT zone, (SELECT count(*) FROM gr WHERE gr.zone = q.zone) - sum(CASE WHEN k = 1 THEN 1 WHEN k = 3 THEN -1 WHEN k = 2 AND m <> 1 THEN 2 ELSE 0 END) / 8 AS area FROM q GROUP BY zone")
def cut_outline_areas(spark: SparkSession, d: str) -> DataFrame:
    """What the rings hold whose corners are cut: an eighth of a cell less at each corner, more at each inner one."""
    grown = raster.pieces(raster.covered(raster.rasterised(E.trail_points(spark, d), "zone"), "zone"), "zone")
    signed = F.when(F.col("hole"), -F.col("area")).otherwise(F.col("area"))
    return raster.outlines(grown, "zone", "piece", cut=True).groupBy("zone").agg(F.sum(signed).alias("area"))


@query()
def walked_ground(spark: SparkSession, d: str) -> DataFrame:
    """Where mobs walk, on a grid of two yalms."""
    p = E.trail_points(spark, d)
    return raster.walked_ground(p.select("zone", grid.G.cell(F.col("x"), 2.0).alias("ix"), grid.G.cell(F.col("z"), 2.0).alias("iz")), "zone")


_TRIANGLES = """tri AS (SELECT p_size % 5 AS zone, p_partkey AS id, (p_partkey % 97) * 2.0::DOUBLE + 0.1::DOUBLE AS ax, 5.0::DOUBLE AS ay, (p_partkey % 89) * 2.0::DOUBLE + 0.1::DOUBLE AS az, CASE WHEN p_size % 3 = 0 THEN 1 ELSE 5 END AS rise FROM part),
tr AS (SELECT zone, ax, ay, az, ax + 1.3::DOUBLE AS bx, ay - rise AS by_, az + 0.2::DOUBLE AS bz, ax + 0.4::DOUBLE AS cx, ay AS cy, az + 1.1::DOUBLE AS cz FROM tri),
nv AS (SELECT *, (by_ - ay) * (cz - az) - (bz - az) * (cy - ay) AS nx, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) AS ny, (bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax) AS nz FROM tr),
st AS (SELECT *, greatest(1, ceil(greatest(sqrt((bx - ax) ** 2 + (bz - az) ** 2), sqrt((cx - ax) ** 2 + (cz - az) ** 2), sqrt((cx - bx) ** 2 + (cz - bz) ** 2)) / 0.25))::INT AS n FROM nv WHERE abs(ny) < 0.65 * sqrt(nx * nx + ny * ny + nz * nz)),
i1 AS (SELECT *, unnest(range(n + 1)) AS i FROM st), j1 AS (SELECT *, unnest(range(n - i + 1)) AS j FROM i1), sm AS (SELECT zone, floor((ax + (bx - ax) * i / n + (cx - ax) * j / n) / 0.5)::INT AS ix, floor((az + (bz - az) * i / n + (cz - az) * j / n) / 0.5)::INT AS iz, ay + (by_ - ay) * i / n + (cy - ay) * j / n AS y FROM j1),
oc AS (SELECT zone, ix, iz, max(y) AS foot, min(y) AS top FROM sm GROUP BY ALL HAVING max(y) - min(y) >= 0.5), ok AS (SELECT *, (ix + 65536)::BIGINT * 131072 + iz + 65536 AS id FROM oc),
o25 AS (SELECT * FROM (SELECT unnest(range(-2, 3)) AS da), (SELECT unnest(range(-2, 3)) AS db)), oe AS (SELECT a.zone, a.id AS u, b.id AS v FROM ok a, o25 JOIN ok b ON a.zone = b.zone AND b.ix = a.ix + da AND b.iz = a.iz + db AND a.id <> b.id),
ol(zone, id, root) USING KEY (zone, id) AS (SELECT zone, id, id FROM ok UNION SELECT e.zone, e.u, min(l.root) FROM ol l JOIN oe e ON e.zone = l.zone AND e.v = l.id JOIN recurring.ol AS own ON own.zone = e.zone AND own.id = e.u WHERE l.root < own.root GROUP BY e.zone, e.u),
ob AS (SELECT ok.zone, ol.root AS obstacle, ix, iz, foot, top FROM ok JOIN ol ON ol.zone = ok.zone AND ol.id = ok.id)"""


def steep_triangles(spark: SparkSession, d: str) -> DataFrame:
    k, rise = F.col("p_partkey"), F.when(F.col("p_size") % 3 == 0, 1).otherwise(5)
    x, z = (k % 97) * 2.0 + 0.1, (k % 89) * 2.0 + 0.1
    corners = {"ax": x, "ay": F.lit(5.0), "az": z, "bx": x + 1.3, "by": 5.0 - rise, "bz": z + 0.2, "cx": x + 0.4, "cy": F.lit(5.0), "cz": z + 1.1}
    return E.table(spark, d, "part").select((F.col("p_size") % 5).alias("zone"), *(v.alias(n) for n, v in corners.items()))


def _obstacle_cells(spark: SparkSession, d: str) -> DataFrame:
    return raster.obstacle_cells(steep_triangles(spark, d), "zone", least_span=0.5)


@query(f"WITH RECURSIVE {_TRIANGLES}, g AS (SELECT zone, obstacle, count(*) AS cells, avg((ix + 0.5) * 0.5) AS x, avg((iz + 0.5) * 0.5) AS z, max(foot) AS foot, min(top) AS top, greatest(max(ix) - min(ix), max(iz) - min(iz)) + 1 AS side FROM ob GROUP BY ALL) SELECT zone, obstacle, cells, round(x, 6) AS x, round(z, 6) AS z, round(foot, 6) AS foot, round(top, 6) AS top, cells * 0.25::DOUBLE AS area, round(side * 0.5 / sqrt(cells * 0.25), 6) AS elongation, row_number() OVER (PARTITION BY zone ORDER BY cells DESC, obstacle) AS place FROM g")
def obstacles(spark: SparkSession, d: str) -> DataFrame:
    return raster.obstacles(_obstacle_cells(spark, d), "zone").withColumns({c: F.round(c, 6) for c in ("x", "z", "foot", "top", "elongation")})


@query(f"WITH RECURSIVE {_TRIANGLES}, p AS (SELECT s_suppkey % 5 AS zone, s_suppkey AS id, (s_suppkey * 7 % 97) * 2.0::DOUBLE + 0.6::DOUBLE AS x, (s_suppkey * 7 % 89) * 2.0::DOUBLE + 0.7::DOUBLE AS z FROM supplier), k AS (SELECT zone, obstacle, count(*) AS k FROM ob GROUP BY ALL), m AS (SELECT DISTINCT p.zone, p.id, ob.obstacle FROM p JOIN ob ON ob.zone = p.zone WHERE sqrt(((ix + 0.5) * 0.5 - x) ** 2 + ((iz + 0.5) * 0.5 - z) ** 2) <= 3.5) SELECT m.zone, m.id, m.obstacle FROM m JOIN k ON k.zone = m.zone AND k.obstacle = m.obstacle QUALIFY row_number() OVER (PARTITION BY m.zone, m.id ORDER BY k, m.obstacle) = 1")
def obstacles_at(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    points = E.table(spark, d, "supplier").select((k % 5).alias("zone"), k.alias("id"), ((k * 7 % 97) * 2.0 + 0.6).alias("x"), ((k * 7 % 89) * 2.0 + 0.7).alias("z"))
    return raster.obstacle_at(points, _obstacle_cells(spark, d), "zone", 3.0)


@query(f"""WITH {_TRAIL}, r AS (SELECT mob_id, row_number() OVER (PARTITION BY mob_id ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY mob_id) AS n, x, z FROM trail), g AS (SELECT mob_id, n, unnest(range(10, least(800, n // 3) + 1)) AS lag FROM (SELECT DISTINCT mob_id, n FROM r WHERE n // 3 >= 10)), a AS (SELECT *, unnest(range(0, n - lag, greatest(1, (n - lag) // 120))) AS i FROM g),
d AS (SELECT a.mob_id, a.n, lag, sqrt((p.x - q.x) ** 2 + (p.z - q.z) ** 2) AS d FROM a JOIN r p ON p.mob_id = a.mob_id AND p.i = a.i JOIN r q ON q.mob_id = a.mob_id AND q.i = a.i + lag), m AS (SELECT mob_id, n, lag, list_sort(list(d))[count(*) // 2 + 1] AS med FROM d GROUP BY ALL) SELECT mob_id, n, CAST(lag AS INT) AS lag FROM m QUALIFY row_number() OVER (PARTITION BY mob_id ORDER BY med, lag) <= 4""")
def repeat_periods(spark: SparkSession, d: str) -> DataFrame:
    """The best repeat periods of whole trails."""
    return routes.periods(routes.placed(E.trail_points(spark, d)).where("capture = -1")).drop("capture")


@query()
def traced_routes(spark: SparkSession, d: str) -> DataFrame:
    """Routes of all trails; gaps between events are hours, so captures break at more than a day."""
    found = routes.traced(E.trail_points(spark, d), close=40.0, least_gap=86400)
    return found.select("mob_id", F.round("coverage", 6).alias("coverage"), F.posexplode("legs").alias("at", "v")).select("mob_id", "coverage", "at", "v.x", "v.y", "v.z")
