"""The library's queries over a data set's tables, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfield.functions import geometry as G
from wayfield.operators import grid, lines, raster, regions, trails
from wayfield.sources import entities as E
from wayfield.streaming import sessions

QUERIES: dict = {}
SQL: dict[str, str] = {}

_TRAIL = """trail AS (SELECT user_id % 5 AS zone, user_id AS mob_id, event_id AS seq, CAST(floor(epoch(ts)) AS BIGINT) AS t,
  value AS x, CAST(hour(ts) AS DOUBLE) AS y, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS z, event_id % 256 AS dir FROM events)"""
_REGIONS = """sq AS (SELECT n_name AS name, n_nationkey AS nr, n_regionkey * 5.0 AS floor, n_nationkey % 3 = 0 AS holed, (n_nationkey % 5) * 100 AS gx, (n_nationkey // 5) * 20 AS gz FROM nation),
reg AS (SELECT name, nr, floor, holed, gx - 10 AS x0, gx + 110 AS x1, gz - 2 AS z0, gz + 22 AS z1, gx + 30 AS hx0, gx + 60 AS hx1, gz + 5 AS hz0, gz + 15 AS hz1 FROM sq)"""
_INSIDE = "(p.x >= r.x0 AND p.x < r.x1 AND p.z >= r.z0 AND p.z < r.z1 AND NOT (r.holed AND p.x >= r.hx0 AND p.x < r.hx1 AND p.z >= r.hz0 AND p.z < r.hz1))"
_SPAWNS = """sp AS (SELECT c_custkey AS id, c_mktsegment AS template, c_acctbal / 20 AS x, CAST(c_nationkey AS DOUBLE) AS y, CAST(c_custkey % 100 AS DOUBLE) AS z, n_name AS name, c_nationkey AS k FROM customer JOIN nation ON n_nationkey = c_nationkey),
member AS (SELECT id, x, z, name FROM sp UNION ALL SELECT id, x, z, n_name FROM sp JOIN nation ON n_nationkey = (k + 1) % 25 WHERE id % 13 = 0)"""
_SIDES = """b AS (SELECT c_custkey AS id, c_mktsegment AS template, c_nationkey AS region FROM customer WHERE c_custkey % 10 <> 0),
h AS (SELECT c_custkey AS id, c_mktsegment AS template, CASE WHEN c_custkey % 11 = 0 THEN (c_nationkey + 1) % 25 ELSE c_nationkey END AS region FROM customer WHERE c_custkey % 7 <> 0)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {_TRAIL}, {_REGIONS}, {_SPAWNS}, c AS (SELECT m.name AS region, count(*) AS total, count(*) FILTER (WHERE {_INSIDE}) AS inside FROM member m JOIN trail p ON p.mob_id = m.id JOIN reg r ON r.name = m.name GROUP BY 1) SELECT *, CASE WHEN inside / total < 0.7 THEN 'warn' WHEN inside / total < 0.9 THEN 'info' ELSE 'ok' END AS level FROM c")
def region_coverage(spark: SparkSession, d: str) -> DataFrame:
    return regions.coverage(E.spawns(spark, d), E.trail_points(spark, d), E.regions(spark, d))


@query(f"WITH {_TRAIL}, {_REGIONS} SELECT r.name, count(*) AS n, count(DISTINCT p.mob_id) AS mobs FROM trail p JOIN reg r ON {_INSIDE} GROUP BY 1")
def region_points(spark: SparkSession, d: str) -> DataFrame:
    return regions.points_in_regions(E.trail_points(spark, d), E.regions(spark, d)).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("mob_id").alias("mobs"))


@query(f"WITH {_TRAIL}, {_REGIONS}, f AS (SELECT p.seq, r.name, abs(p.y - r.floor) AS dy, (x1 - x0) * (z1 - z0) AS span, r.nr FROM trail p JOIN reg r ON {_INSIDE}), m AS (SELECT *, min(dy) OVER (PARTITION BY seq) AS best FROM f), k AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY span, nr) AS rn FROM m WHERE dy <= best + 5) SELECT seq, name FROM k WHERE rn = 1")
def region_at_points(spark: SparkSession, d: str) -> DataFrame:
    return regions.region_at(E.trail_points(spark, d), E.regions(spark, d), "seq")


@query(f"WITH {_TRAIL}, s AS (SELECT *, t - lag(t) OVER (PARTITION BY mob_id ORDER BY seq) AS step FROM trail), q AS (SELECT mob_id, list_sort(list(step))[count(step) // 2 + 1] AS mid FROM s WHERE step IS NOT NULL GROUP BY 1), r AS (SELECT s.*, sum(CASE WHEN step > greatest(3600, mid * 1.5) THEN 1 ELSE 0 END) OVER (PARTITION BY s.mob_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS capture FROM s LEFT JOIN q USING (mob_id)) SELECT mob_id, CAST(capture AS BIGINT) AS capture, count(*) AS n, min(t) AS t0, max(t) AS t1 FROM r GROUP BY ALL HAVING count(*) >= 3")
def trail_captures(spark: SparkSession, d: str) -> DataFrame:
    return trails.captures(E.trail_points(spark, d), 3600, 1.5, 3)


@query(f"WITH {_TRAIL}, s AS (SELECT *, dir // 128 AS h FROM trail), g AS (SELECT *, CASE WHEN h <> lag(h) OVER w OR t - lag(t) OVER w > 50000 OR lag(t) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM s WINDOW w AS (PARTITION BY mob_id ORDER BY seq)), r AS (SELECT *, sum(new) OVER (PARTITION BY mob_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS leg FROM g) SELECT mob_id, CAST(leg AS BIGINT) AS leg, count(*) AS n, min(seq) AS seq0, max(seq) AS seq1 FROM r GROUP BY ALL")
def trail_legs(spark: SparkSession, d: str) -> DataFrame:
    return trails.legs(E.trail_points(spark, d), 50000, F.floor(F.col("dir") / 128))


@query(f"WITH {_TRAIL} SELECT mob_id, count(*) AS n, min(x) AS x0, max(x) AS x1, min(z) AS z0, max(z) AS z1, (min(x) + max(x)) / 2 AS cx, (min(z) + max(z)) / 2 AS cz FROM trail GROUP BY 1")
def trail_boxes(spark: SparkSession, d: str) -> DataFrame:
    return trails.boxes(E.trail_points(spark, d))


@query(f"WITH {_TRAIL}, s AS (SELECT *, CAST(floor(x / 50) AS INT) AS node FROM trail), g AS (SELECT node, CASE WHEN t - lag(t) OVER w <= 90000 THEN lag(node) OVER w END AS f FROM s WINDOW w AS (PARTITION BY mob_id ORDER BY seq)) SELECT least(f, node) AS a, greatest(f, node) AS b, count(*) AS count FROM g WHERE f <> node GROUP BY ALL")
def edge_counts(spark: SparkSession, d: str) -> DataFrame:
    return trails.edge_counts(E.trail_points(spark, d), G.cell(F.col("x"), 50), 90000)


@query(f"WITH {_TRAIL}, n AS (SELECT mob_id, seq // 1000 AS capture, count(*) AS n FROM trail GROUP BY ALL) SELECT mob_id, capture, n FROM n QUALIFY row_number() OVER (PARTITION BY mob_id ORDER BY n DESC, capture) = 1")
def longest_captures(spark: SparkSession, d: str) -> DataFrame:
    return trails.longest(E.trail_points(spark, d), ["mob_id"], F.floor(F.col("seq") / 1000))


@query(f"WITH {_TRAIL}, h AS (SELECT zone, round(abs(x - 245) / 20 - 0.9, 4) AS v FROM trail), kept AS (SELECT * FROM h WHERE v > -1 AND v < 12), b AS (SELECT zone, least(51, floor((v + 1) / 0.25)::BIGINT) AS bin, count(*) AS k FROM kept GROUP BY ALL), g AS (SELECT zone, unnest(range(52)) AS bin FROM (SELECT DISTINCT zone FROM kept)), s AS (SELECT g.zone, g.bin, coalesce(sum(b.k), 0) AS score FROM g LEFT JOIN b ON b.zone = g.zone AND abs(b.bin - g.bin) <= 1 GROUP BY ALL), m AS (SELECT zone, -1 + (bin + 0.5) * 0.25 AS mode FROM s QUALIFY row_number() OVER (PARTITION BY zone ORDER BY score DESC, bin) = 1) SELECT m.zone, mode, count(*) AS pile, round(quantile_cont(v, 0.95), 6) AS r FROM m JOIN kept ON kept.zone = m.zone AND v > mode - 0.9 AND v < mode + 0.4 GROUP BY ALL")
def stop_radius(spark: SparkSession, d: str) -> DataFrame:
    far = E.trail_points(spark, d).select("zone", F.round(F.abs(F.col("x") - 245) / 20 - 0.9, 4).alias("v"))
    return trails.stop_radius(far, "v", "zone").withColumn("r", F.round("r", 6))


@query(f"WITH {_TRAIL}, a AS (SELECT *, row_number() OVER (PARTITION BY mob_id ORDER BY seq) - 1 AS pos FROM trail) SELECT mob_id, seq FROM a WHERE pos % 3 = 0")
def every_third_point(spark: SparkSession, d: str) -> DataFrame:
    return trails.every_nth(E.trail_points(spark, d), 3).select("mob_id", "seq")


@query(f"WITH {_TRAIL}, g AS (SELECT *, CASE WHEN t - lag(t) OVER w > 40000 OR lag(t) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM trail WINDOW w AS (PARTITION BY mob_id ORDER BY seq)), v AS (SELECT *, sum(new) OVER (PARTITION BY mob_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS view FROM g) SELECT seq, t - first_value(t) OVER (PARTITION BY mob_id, view ORDER BY seq) AS in_view FROM v")
def time_in_view(spark: SparkSession, d: str) -> DataFrame:
    return trails.time_in_view(E.trail_points(spark, d), 40000).select("seq", "in_view")


@query(f"WITH {_TRAIL} SELECT zone, CAST(floor(x / 10) AS INT) AS ix, CAST(floor(z / 10) AS INT) AS iz, count(*) AS n, round(avg(y), 6) AS y FROM trail GROUP BY ALL")
def cell_heights(spark: SparkSession, d: str) -> DataFrame:
    return grid.cells(E.trail_points(spark, d), 10, "zone").withColumn("y", F.round("y", 6))


@query(f"WITH {_TRAIL}, c AS (SELECT DISTINCT zone, CAST(floor(x / 3) AS INT) AS ix, CAST(floor(z / 3) AS INT) AS iz FROM trail), o AS (SELECT unnest([-1, 0, 1]) AS s), dl AS (SELECT DISTINCT zone, ix + a.s AS ix, iz + b.s AS iz FROM c, o a, o b) SELECT zone, ix + a.s AS ix, iz + b.s AS iz FROM dl, o a, o b GROUP BY ALL HAVING count(*) = 9")
def closed_cells(spark: SparkSession, d: str) -> DataFrame:
    return grid.close(grid.cells(E.trail_points(spark, d), 3, "zone"), "zone")


@query(f"""WITH RECURSIVE {_TRAIL}, c AS (SELECT DISTINCT zone, CAST(floor(x / 10) AS BIGINT) AS ix, CAST(floor(z / 10) AS BIGINT) AS iz FROM trail), k AS (SELECT zone, ix, iz, (ix + 65536) * 131072 + iz + 65536 AS id FROM c),
o4 AS (SELECT * FROM (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) AS o(da, db)), e AS (SELECT a.zone, a.id AS u, b.id AS v FROM k a, o4 JOIN k b ON a.zone = b.zone AND b.ix = a.ix + da AND b.iz = a.iz + db),
l(zone, id, root) USING KEY (zone, id) AS (SELECT zone, id, id FROM k UNION SELECT e.zone, e.u, min(l.root) FROM l JOIN e ON e.zone = l.zone AND e.v = l.id JOIN recurring.l AS own ON own.zone = e.zone AND own.id = e.u WHERE l.root < own.root GROUP BY e.zone, e.u)
SELECT zone, root, count(*) AS cells FROM l GROUP BY ALL""")
def walked_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of touching cells over all points of all zones."""
    c = grid.cells(E.trail_points(spark, d), 10, "zone")
    return raster.pieces(c, "zone").groupBy("zone", F.col("piece").alias("root")).agg(F.count(F.lit(1)).alias("cells"))


QUERIES["zone_pieces"], SQL["zone_pieces"] = walked_pieces, SQL["walked_pieces"]  # an older name of the same


@query(f"WITH {_SIDES} SELECT id, b.template AS base_template, b.region AS base_region, h.template AS head_template, h.region AS head_region, CASE WHEN b.id IS NULL THEN 'added' WHEN h.id IS NULL THEN 'removed' WHEN b.template IS NOT DISTINCT FROM h.template AND b.region IS NOT DISTINCT FROM h.region THEN 'unchanged' ELSE 'changed' END AS kind FROM b FULL OUTER JOIN h USING (id)")
def spawn_diff(spark: SparkSession, d: str) -> DataFrame:
    return regions.diff(*E.sides(spark, d))


@query(f"WITH {_SIDES} SELECT kind, count(*) AS n FROM (SELECT CASE WHEN b.id IS NULL THEN 'added' WHEN h.id IS NULL THEN 'removed' WHEN b.region = h.region THEN 'unchanged' ELSE 'changed' END AS kind FROM b FULL OUTER JOIN h USING (id)) GROUP BY 1")
def diff_counts(spark: SparkSession, d: str) -> DataFrame:
    return regions.diff(*E.sides(spark, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("WITH b AS (SELECT c_custkey AS id, c_nationkey AS v FROM customer WHERE c_custkey % 10 <> 0), t AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 11 = 0 THEN (c_nationkey + 1) % 25 ELSE c_nationkey END AS v FROM customer WHERE c_custkey % 7 <> 0), o AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN (c_nationkey + 2) % 25 ELSE c_nationkey END AS v FROM customer WHERE c_custkey % 6 <> 0), a AS (SELECT coalesce(t.id, o.id) AS id, t.id IS NOT NULL AS ti, t.v AS tv, o.id IS NOT NULL AS oi, o.v AS ov, b.id IS NOT NULL AS bi, b.v AS bv FROM t FULL OUTER JOIN o ON t.id = o.id LEFT JOIN b ON b.id = coalesce(t.id, o.id)), e AS (SELECT *, oi = bi AND ov IS NOT DISTINCT FROM bv AS ob, ti = bi AND tv IS NOT DISTINCT FROM bv AS tb, ti = oi AND tv IS NOT DISTINCT FROM ov AS same FROM a) SELECT id, CASE WHEN ob THEN tv ELSE ov END AS region, NOT ob AND NOT tb AND NOT same AS conflict FROM e WHERE CASE WHEN ob THEN ti ELSE oi END")
def three_way_merge(spark: SparkSession, d: str) -> DataFrame:
    base, theirs = (s.select("id", "region") for s in E.sides(spark, d))
    c = E.table(spark, d, "customer")
    ours = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 5 == 0, (F.col("c_nationkey") + 2) % 25).otherwise(F.col("c_nationkey")).cast("int").alias("region")).where("id % 6 <> 0")
    return regions.merge(base, theirs, ours, "id", "region")


@query(f"WITH {_REGIONS}, {_SPAWNS}, j AS (SELECT p.id, bool_or({_INSIDE}) AS inside FROM member p JOIN reg r ON r.name = p.name GROUP BY 1) SELECT 'info' AS level, 'outside' AS code, CAST(id AS VARCHAR) AS subject FROM j WHERE NOT inside UNION ALL SELECT 'warn', 'no-spawns', name FROM reg WHERE name NOT IN (SELECT name FROM member)")
def zone_findings(spark: SparkSession, d: str) -> DataFrame:
    return regions.findings(E.spawns(spark, d), E.regions(spark, d))


@query(f"WITH {_REGIONS} SELECT name, CAST(120 * 24 - CASE WHEN holed THEN 300 ELSE 0 END AS DOUBLE) AS area, x0::DOUBLE AS x0, z0::DOUBLE AS z0 FROM reg")
def region_areas(spark: SparkSession, d: str) -> DataFrame:
    first = F.element_at(G.canonical_ring(F.element_at("rings", 1)), 1)
    return E.regions(spark, d).select("name", G.region_area(F.col("rings")).alias("area"), first["x"].alias("x0"), first["z"].alias("z0"))


@query(f"WITH {_REGIONS}, {_SPAWNS} SELECT p.id, p.name, round(CASE WHEN p.x BETWEEN x0 AND x1 AND p.z BETWEEN z0 AND z1 THEN least(p.x - x0, x1 - p.x, p.z - z0, z1 - p.z) ELSE sqrt(power(greatest(x0 - p.x, 0, p.x - x1), 2) + power(greatest(z0 - p.z, 0, p.z - z1), 2)) END, 6) AS distance FROM member p JOIN reg r ON r.name = p.name")
def outline_distance(spark: SparkSession, d: str) -> DataFrame:
    m = E.spawns(spark, d).select("id", "x", "z", F.explode("regions").alias("name")).join(E.regions(spark, d), "name")
    return m.select("id", "name", F.round(G.ring_distance(F.col("x"), F.col("z"), F.element_at("rings", 1)), 6).alias("distance"))


@query("SELECT c_mktsegment AS template, (list_reduce(list_prepend(0::BIGINT, [unicode(x)::BIGINT FOR x IN string_split(c_mktsegment, '')]), lambda h, c: (h * 31 + c) % 65536) / 65535 * 0.87 + 0.18) % 1.0 AS hue, count(*) AS n FROM customer GROUP BY ALL")
def template_hues(spark: SparkSession, d: str) -> DataFrame:
    return E.spawns(spark, d).groupBy("template").agg(F.count(F.lit(1)).alias("n")).select("template", G.string_hue(F.col("template")).alias("hue"), "n")


@query(f"WITH {_TRAIL} SELECT mob_id, median(x) AS median, round(quantile_cont(x, 0.9), 6) AS p90, list_sort(list(x))[count(x) // 2 + 1] AS upper FROM trail GROUP BY 1")
def trail_percentiles(spark: SparkSession, d: str) -> DataFrame:
    points = E.trail_points(spark, d)
    return trails.percentiles(points, "mob_id", "x", {"median": 0.5, "p90": 0.9}).withColumn("p90", F.round("p90", 6)).join(trails.upper_median(points, "mob_id", "x", "upper"), "mob_id")


@query("WITH p AS (SELECT page_id, regexp_extract(url, '://[^/]+/([^/?#]+)', 1) AS zone, length(url) AS additions, length(html) AS deletions FROM pages) SELECT zone, count(*) AS files, CAST(sum(additions) AS BIGINT) AS additions, CAST(sum(deletions) AS BIGINT) AS deletions FROM p WHERE zone <> '' GROUP BY 1")
def zone_changes(spark: SparkSession, d: str) -> DataFrame:
    p = E.table(spark, d, "pages").select(F.regexp_extract("url", "://[^/]+/([^/?#]+)", 1).alias("zone"), F.length("url").alias("a"), F.length("html").alias("b"))
    return p.where("zone <> ''").groupBy("zone").agg(F.count(F.lit(1)).alias("files"), F.sum("a").alias("additions"), F.sum("b").alias("deletions"))


@query("SELECT c_custkey AS id, lower(c_mktsegment) AS template FROM customer WHERE contains(lower(c_mktsegment), 'mach') OR contains(CAST(c_custkey AS VARCHAR), '42')")
def filtered_spawns(spark: SparkSession, d: str) -> DataFrame:
    return E.spawns(spark, d).where(F.lower("template").contains("mach") | F.col("id").cast("string").contains("42")).select("id", F.lower("template").alias("template"))


@query("WITH e AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events), g AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT user_id AS mob_id, min(ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM g GROUP BY user_id, s")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessions.sessions(E.table(spark, d, "events")).withColumn("total", F.round("total", 4))


@query("SELECT doc_id, sha1('blob ' || octet_length(encode(text)) || chr(0) || text) AS sha FROM documents")
def blob_hashes(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.lit("blob "), F.octet_length("text").cast("string"), F.chr(F.lit(0)), F.col("text"))
    return E.table(spark, d, "documents").select("doc_id", F.sha1(body).alias("sha"))


@query(f"WITH {_SPAWNS}, g AS (SELECT template, name, count(*) AS n FROM sp GROUP BY ALL) SELECT name, template, n FROM g QUALIFY row_number() OVER (PARTITION BY name ORDER BY n DESC, template) <= 3")
def common_templates(spark: SparkSession, d: str) -> DataFrame:
    n = E.spawns(spark, d).select(F.element_at("regions", 1).alias("name"), "template").groupBy("name", "template").agg(F.count(F.lit(1)).alias("n"))
    top = n.groupBy("name").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "template"))), 1, 3).alias("t"))  # the few templates of a region
    return top.select("name", F.explode("t").alias("t")).select("name", "t.template", (-F.col("t.k")).alias("n"))


@query()
def simplified_trails(spark: SparkSession, d: str) -> DataFrame:
    return lines.simplify_lines(E.trail_points(spark, d), "mob_id", "seq", 20.0)


@query()
def trail_hulls(spark: SparkSession, d: str) -> DataFrame:
    return lines.hulls(E.trail_points(spark, d), "mob_id", "seq")
