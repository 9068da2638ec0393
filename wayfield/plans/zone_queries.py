"""Queries over whole zones: text files, maps, versions, merging and checks, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfield.functions import geometry as G
from wayfield.operators import maps, regions, zones
from wayfield.plans.queries import _TRAIL, query
from wayfield.sources import entities as E
from wayfield.sources import texts


def _zr(v: int) -> str:
    """zr{v}: zone, name, nr, rings of one version, as E.zone_regions derives them."""
    wide = "CASE WHEN n % 6 = 1 THEN 20 ELSE 0 END" if v else "0"
    holed = "n % 3 = 0 OR n % 6 = 2" if v else "n % 3 = 0"
    c = lambda x, z: f"{{'x': ({x})::DOUBLE, 'z': ({z})::DOUBLE, 'y': floor + ({x}) * 0.1}}"
    return f"""q{v} AS (SELECT n_regionkey AS zone, n_name AS name, n_nationkey AS n, n_nationkey % 5 * 100 AS gx, n_nationkey // 5 * 20 AS gz, n_regionkey * 5.0::DOUBLE AS floor FROM nation{' WHERE n_nationkey % 6 <> 4' if v else ''}),
k{v} AS (SELECT *, {c('gx - 10', 'gz - 2')} AS a, {c(f'gx + 110 + {wide}', 'gz - 2')} AS b, {c(f'gx + 110 + {wide}', 'gz + 22')} AS c, {c('gx - 10', 'gz + 22')} AS d,
  [{c('gx + 30', 'gz + 5')}, {c('gx + 60', 'gz + 5')}, {c('gx + 60', 'gz + 15')}, {c('gx + 30', 'gz + 15')}] AS hole, {wide} AS wide, {holed} AS holed FROM q{v}),
o{v} AS (SELECT *, CASE WHEN n % 11 = 5 THEN [a, b] WHEN n % 7 = 3 THEN [a, c, b, d] ELSE [a, b, c, d] END AS outline FROM k{v}),
zr{v} AS (SELECT zone, name, n AS nr, wide, holed, outline, CASE WHEN holed THEN [outline, hole] ELSE [outline] END AS rings FROM o{v})"""


def _zs(v: int) -> str:
    """zs{v}: zone, id, name, at, regions, path and loop, as E.zone_spawns derives them."""
    first = "CASE WHEN i % 11 = 2 THEN [first] WHEN" if v else "CASE WHEN"
    leg = lambda k: f"{{'x': x + 10 * {k}{' + (CASE WHEN i % 18 = 0 THEN 3 ELSE 0 END)' if v else ''}, 'y': y, 'z': z + 5 * {k}}}"
    return f"""f{v} AS (SELECT n_regionkey AS zone, min(n_name) AS first FROM nation GROUP BY 1),
c{v} AS (SELECT n_regionkey AS zone, c_custkey AS i, c_mktsegment AS name, n_name AS own, first, round(c_acctbal / 25, 3) AS x, c_nationkey * 1.0::DOUBLE AS y, (c_custkey % 100) * 1.0::DOUBLE AS z FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN f{v} ON f{v}.zone = n_regionkey{' WHERE c_custkey % 10 <> 9' if v else ''}),
zs{v} AS (SELECT zone, i AS id, name, CASE WHEN i % 6 <> 0 THEN [x{' + (CASE WHEN i % 7 = 1 THEN 3 ELSE 0 END)' if v else ''}, y, z] END AS pt,
  CASE WHEN i % 4 <> 0{' OR i % 11 = 2' if v else ''} THEN {first} i % 17 = 0 THEN [own, 'NOWHERE'] WHEN i % 13 = 0 THEN [own, first] ELSE [own] END END AS regions,
  CASE WHEN i % 27 = 0 THEN [{leg(0)}] WHEN i % 9 = 0 THEN [{leg(0)}, {leg(1)}, {leg(2)}] END AS path, CASE WHEN i % 9 = 0 AND i % 2 = 0 THEN false END AS loop FROM c{v})"""


def _text(v: int) -> str:
    """rt{v}: zone, name, and each region's lines."""
    vertex = "printf('[%.2f, %.2f, %.2f]', p.x, p.y, p.z)"
    return f"""rt{v} AS (SELECT zone, name, holed, '  ' || name || ':\n    poly:\n' || array_to_string(list_transform(outline, lambda p: '      - ' || {vertex}), '\n')
  || CASE WHEN holed THEN '\n    holes:\n' || array_to_string(list_transform(rings[2], lambda p, i: CASE WHEN i = 1 THEN '      -   - ' ELSE '          - ' END || {vertex}), '\n') ELSE '' END AS t FROM zr{v})"""


_DIFF_R = f"""{_zr(0)}, {_zr(1)}, {_text(0)}, {_text(1)}, area AS (SELECT *, CASE WHEN len(outline) < 3 OR nr % 7 = 3 THEN 0 ELSE (120 + wide) * 24 END AS a FROM zr0),
jr AS (SELECT coalesce(b.zone, h.zone) AS zone, coalesce(b.name, h.name) AS name, b.t AS bt, h.t AS ht FROM rt0 b FULL OUTER JOIN rt1 h ON b.zone = h.zone AND b.name = h.name),
dr AS (SELECT zone, name, CASE WHEN bt IS NULL THEN 'added' WHEN ht IS NULL THEN 'removed' WHEN bt = ht THEN 'unchanged' ELSE 'reshaped' END AS kind FROM jr),
hull AS (SELECT zone, name, nr, wide, holed, outline, greatest(CASE WHEN len(outline) < 3 OR nr % 7 = 3 THEN 0 ELSE (120 + wide) * 24 END - CASE WHEN holed THEN 300 ELSE 0 END, 0) AS a, 0 AS v FROM zr0
  UNION ALL SELECT zone, name, nr, wide, holed, outline, greatest(CASE WHEN len(outline) < 3 OR nr % 7 = 3 THEN 0 ELSE (120 + wide) * 24 END - CASE WHEN holed THEN 300 ELSE 0 END, 0) AS a, 1 FROM zr1),
dd AS (SELECT d.zone, d.name, d.kind, CASE WHEN kind = 'reshaped' THEN len(b.outline) END AS from_vertices, CASE WHEN kind = 'reshaped' THEN len(h.outline) END AS to_vertices,
  CASE WHEN kind = 'reshaped' THEN CASE WHEN b.a > 0 THEN h.a / b.a ELSE 'inf'::DOUBLE END END AS area_ratio, CASE WHEN kind = 'reshaped' THEN b.holed::INT END AS from_holes, CASE WHEN kind = 'reshaped' THEN h.holed::INT END AS to_holes
  FROM dr d LEFT JOIN hull b ON b.v = 0 AND b.zone = d.zone AND b.name = d.name LEFT JOIN hull h ON h.v = 1 AND h.zone = d.zone AND h.name = d.name)"""
_DIFF_S = f"""{_zs(0)}, {_zs(1)}, js AS (SELECT coalesce(b.zone, h.zone) AS zone, coalesce(b.id, h.id) AS id, coalesce(h.name, b.name) AS name, b.id IS NULL AS nb, h.id IS NULL AS nh, coalesce(array_to_string(b.regions, ', '), '') AS was, coalesce(array_to_string(h.regions, ', '), '') AS now,
  b.path AS bp, h.path AS hp, b.path IS DISTINCT FROM h.path OR coalesce(b.loop, false) <> coalesce(h.loop, false) AS routed, b.pt AS ba, h.pt AS ha FROM zs0 b FULL OUTER JOIN zs1 h ON b.zone = h.zone AND b.id = h.id),
ks AS (SELECT *, CASE WHEN nb THEN ['added'] WHEN nh THEN ['removed'] ELSE list_filter([CASE WHEN was <> now THEN 'moved' END, CASE WHEN routed THEN 'rerouted' END, CASE WHEN NOT routed AND was = '' AND now = '' AND hp IS NULL AND ba <> ha THEN 'relocated' END], lambda x: x IS NOT NULL) END AS kinds FROM js),
es AS (SELECT *, unnest(kinds) AS kind FROM ks),
ds AS (SELECT zone, id, name, kind, CASE WHEN kind = 'moved' AND was <> '' THEN was END AS "from", CASE WHEN kind = 'moved' AND now <> '' THEN now END AS "to", CASE WHEN kind = 'rerouted' THEN coalesce(len(bp), 0) END AS from_legs, CASE WHEN kind = 'rerouted' THEN coalesce(len(hp), 0) END AS to_legs FROM es)"""


@query(f"WITH {_zr(0)}, {_text(0)}, l AS (SELECT *, lag(holed) OVER (PARTITION BY zone ORDER BY name) AS before FROM rt0) SELECT zone, 'regions:\n' || string_agg(CASE WHEN before THEN '' ELSE '\n' END || t || '\n', '' ORDER BY name) AS text FROM l GROUP BY 1")
def regions_files(spark: SparkSession, d: str) -> DataFrame:
    return zones.regions_text(E.zone_regions(spark, d))


@query(f"""WITH {_zr(0)}, r AS (SELECT zone, name, unnest(rings) AS ring, generate_subscripts(rings, 1) - 1 AS nr FROM zr0), v AS (SELECT zone, name, nr, unnest(ring) AS p, generate_subscripts(ring, 1) - 1 AS "at" FROM r) SELECT zone, name, nr AS ring, "at", round(p.x, 2) AS x, round(p.y, 2) AS y, round(p.z, 2) AS z FROM v""")
def regions_read_back(spark: SparkSession, d: str) -> DataFrame:
    """Regions files as written, with a comment and another section around, read again."""
    files = zones.regions_text(E.zone_regions(spark, d)).withColumn("text", F.concat(F.lit("# a comment\nother:\n  x: [1, 2, 3]\n"), "text", F.lit("\nlast: 1\n")))
    rings = texts.parse_regions(files, "zone").select("zone", "name", F.posexplode("rings").alias("ring", "r"))
    return rings.select("zone", "name", "ring", F.posexplode("r").alias("at", "v")).select("zone", "name", "ring", "at", "v.x", "v.y", "v.z")


@query(f"WITH {_zr(1)}, r AS (SELECT zone, name, unnest(rings) AS ring, generate_subscripts(rings, 1) - 1 AS nr FROM zr1), v AS (SELECT zone, name, nr, unnest(ring) AS p FROM r) SELECT zone, name, nr AS ring, count(*) AS n, round(sum(p.x), 2) AS x FROM v GROUP BY ALL")
def regions_patched(spark: SparkSession, d: str) -> DataFrame:
    """The first version's files with their section replaced by the second version's regions."""
    files = zones.regions_text(E.zone_regions(spark, d)).withColumn("text", F.concat(F.lit("# head\n"), "text", F.lit("\nlast: 1\n")))
    patched = texts.patch_regions(files, E.zone_regions(spark, d, 1))
    rings = texts.parse_regions(patched.where(F.col("text").startswith("# head\n") & F.col("text").endswith("\nlast: 1\n")), "zone").select("zone", "name", F.posexplode("rings").alias("ring", "r"))
    return rings.select("zone", "name", "ring", F.size("r").cast("long").alias("n"), F.round(F.aggregate("r", F.lit(0.0), lambda s, v: s + v["x"]), 2).alias("x"))


def _placed(at: str, regions: str, path: str, loop: str) -> str:
    return f"CASE WHEN {regions} IS NOT NULL THEN array_to_string({regions}, ', ') WHEN {path} IS NOT NULL THEN CASE WHEN {loop} IS NOT DISTINCT FROM false THEN 'path' ELSE 'circuit' END || array_to_string(list_transform({path}, lambda p: printf(' %.3f %.3f %.3f', p.x, p.y, p.z)), '') ELSE array_to_string(list_transform({at}, lambda v: printf('%.3f', v)), ' ') END"


def _placement_of(spawns: DataFrame) -> DataFrame:
    legs = F.array_join(F.transform("path", lambda v: F.format_string(" %.3f %.3f %.3f", v["x"], v["y"], v["z"])), "")
    way = F.when(F.col("loop").eqNullSafe(F.lit(False)), "path").otherwise("circuit")
    at = F.array_join(F.transform("at", lambda v: F.format_string("%.3f", v)), " ")
    return spawns.select("zone", "id", "name", F.when(F.size("regions") > 0, zones.names_text(F.col("regions"))).when(F.col("path").isNotNull(), F.concat(way, legs)).otherwise(at).alias("placed"))


@query(f"WITH {_zs(0)} SELECT zone, id, name, {_placed('pt', 'regions', 'path', 'loop')} AS placed FROM zs0")
def spawns_read_back(spark: SparkSession, d: str) -> DataFrame:
    return _placement_of(texts.parse_spawns(texts.spawns_text(E.zone_spawns(spark, d)), "zone"))


@query(f"WITH {_zs(0)}, {_zs(1)}, j AS (SELECT b.zone, b.id, b.name, b.regions IS NULL AND b.path IS NULL AND b.pt IS NOT NULL AS own, b.regions IS NOT NULL OR b.path IS NOT NULL AS had, b.pt AS bat, h.pt, h.regions, h.path, h.loop FROM zs0 b LEFT JOIN zs1 h ON b.zone = h.zone AND b.id = h.id), k AS (SELECT *, CASE WHEN own THEN bat WHEN pt IS NOT NULL THEN pt WHEN had THEN [0, 0, 0.1] END AS spot FROM j) SELECT zone, id, name, {_placed('spot', 'regions', 'path', 'loop')} AS placed FROM k")
def spawns_patched(spark: SparkSession, d: str) -> DataFrame:
    """The first version's mobs files with the second version's placements, read again."""
    files = texts.spawns_text(E.zone_spawns(spark, d)).withColumn("text", F.concat(F.lit("# head\n"), "text", F.lit("\nslots:\n  1: x\n")))
    return _placement_of(texts.parse_spawns(texts.patch_spawns(files, E.zone_spawns(spark, d, 1), "zone"), "zone"))


@query(f"WITH {_zs(0)} SELECT zone, count(*) AS entries, CAST(sum(CASE WHEN regions IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS placed FROM zs0 GROUP BY 1")
def spawn_files_aligned(spark: SparkSession, d: str) -> DataFrame:
    """Entries, and of these the ones whose region stands below the template's value in the written file."""
    rows = texts.lines(texts.spawns_text(E.zone_spawns(spark, d)), "zone")
    return rows.groupBy("zone").agg(F.count_if(F.col("line").rlike(r"^    template: \S")).alias("entries"), F.count_if(F.col("line").rlike(r"^    region:   \S")).alias("placed"))


@query(f"WITH {_DIFF_R} SELECT * FROM dd")
def region_changes(spark: SparkSession, d: str) -> DataFrame:
    return zones.diff_regions(E.zone_regions(spark, d), E.zone_regions(spark, d, 1))


@query(f"WITH {_DIFF_S} SELECT * FROM ds")
def spawn_changes(spark: SparkSession, d: str) -> DataFrame:
    return zones.diff_spawns(E.zone_spawns(spark, d), E.zone_spawns(spark, d, 1))


@query(f"""WITH {_DIFF_R}, {_DIFF_S}, z AS (SELECT DISTINCT zone FROM zr0 UNION SELECT zone FROM zs0),
a AS (SELECT zone, count(*) FILTER (WHERE kind = 'added') AS na, count(*) FILTER (WHERE kind = 'removed') AS nr, count(*) FILTER (WHERE kind = 'reshaped') AS nc, string_agg(name, ', ' ORDER BY name) FILTER (WHERE kind = 'added') AS added, string_agg(name, ', ' ORDER BY name) FILTER (WHERE kind = 'removed') AS removed,
  string_agg('Reshaped ' || name || coalesce(' (' || nullif(concat_ws(', ', CASE WHEN from_vertices <> to_vertices THEN from_vertices || ' -> ' || to_vertices || ' vertices' END, CASE WHEN abs(area_ratio - 1) > 0.005 THEN 'area ' || CASE WHEN area_ratio >= 1 THEN '+' ELSE '' END || printf('%.0f', (area_ratio - 1) * 100) || '%' END, CASE WHEN from_holes <> to_holes THEN from_holes || ' -> ' || to_holes || ' holes' END), '') || ')', ''), chr(10) ORDER BY name) FILTER (WHERE kind = 'reshaped') AS reshaped FROM dd GROUP BY 1),
p AS (SELECT zone, coalesce("to", 'no region') AS t, min(name || ' ' || lpad(id::VARCHAR, 12, '0')) AS first, count(*) AS n, string_agg(name || ' ' || id || coalesce(' (was ' || "from" || ')', ''), ', ' ORDER BY name, id) AS w FROM ds WHERE kind = 'moved' GROUP BY ALL),
m AS (SELECT zone, sum(n) AS moved, string_agg('Placed in ' || t || ': ' || w, chr(10) ORDER BY first) AS into_ FROM p GROUP BY 1),
r AS (SELECT zone, count(*) AS n, string_agg(name || ' ' || id, ', ' ORDER BY name, id) AS w FROM ds WHERE kind = 'rerouted' GROUP BY 1)
SELECT z.zone, z.zone || ': ' || coalesce(nullif(concat_ws(', ', CASE WHEN na + nr + nc > 0 THEN concat_ws(' ', CASE WHEN na > 0 THEN '+' || na END, CASE WHEN nr > 0 THEN '-' || nr END, CASE WHEN nc > 0 THEN '~' || nc END) || ' region' || CASE WHEN na + nr + nc = 1 THEN '' ELSE 's' END END, CASE WHEN moved > 0 THEN CAST(moved AS BIGINT) || ' spawn' || CASE WHEN moved = 1 THEN '' ELSE 's' END || ' placed' END, CASE WHEN r.n > 0 THEN r.n || ' route' || CASE WHEN r.n = 1 THEN '' ELSE 's' END || ' changed' END), ''), 'regions updated')
  || coalesce(chr(10) || chr(10) || nullif(concat_ws(chr(10), 'Added: ' || added, 'Removed: ' || removed, reshaped, into_, 'Routes: ' || r.w), ''), '') AS message FROM z LEFT JOIN a USING (zone) LEFT JOIN m USING (zone) LEFT JOIN r USING (zone)""")
def change_messages(spark: SparkSession, d: str) -> DataFrame:
    return zones.change_messages((E.zone_regions(spark, d), E.zone_spawns(spark, d)), (E.zone_regions(spark, d, 1), E.zone_spawns(spark, d, 1)))


_MERGE = f"""{_zs(0)}, {_zs(1)}, b AS (SELECT zone, id, coalesce(array_to_string(regions, ', '), '') AS p FROM zs0), t AS (SELECT zone, id, coalesce(array_to_string(regions, ', '), '') AS p FROM zs1), o AS (SELECT zone, id, CASE WHEN id % 5 = 1 THEN '' WHEN id % 22 = 2 THEN 'HOME' ELSE p END AS p FROM b WHERE id % 8 <> 3),
a AS (SELECT coalesce(t.zone, o.zone) AS zone, coalesce(t.id, o.id) AS id, coalesce(t.p, '') AS t, coalesce(o.p, '') AS o FROM t FULL OUTER JOIN o ON t.zone = o.zone AND t.id = o.id), e AS (SELECT a.*, coalesce(b.p, '') AS b FROM a LEFT JOIN b ON b.zone = a.zone AND b.id = a.id)"""


@query(f"WITH {_MERGE} SELECT zone, id, CASE WHEN o = t THEN o WHEN o = b THEN t ELSE o END AS placement, o <> t AND o <> b AND t <> b AS conflict FROM e")
def merged_placements(spark: SparkSession, d: str) -> DataFrame:
    side = lambda v: E.zone_spawns(spark, d, v).select("zone", "id", zones.names_text(F.col("regions")).alias("placement"))
    ours = side(0).where("id % 8 <> 3").withColumn("placement", F.when(F.col("id") % 5 == 1, "").when(F.col("id") % 22 == 2, "HOME").otherwise(F.col("placement")))
    return zones.merge_placements(side(0), side(1), ours)


_INSIDE = """CASE WHEN len(outline) < 3 THEN false WHEN nr % 7 = 3 THEN x >= outline[1].x AND x < outline[1].x + 120 AND z >= outline[1].z AND z < outline[1].z + 24 AND abs((x - outline[1].x) / 120 - 0.5) > abs((z - outline[1].z) / 24 - 0.5)
  ELSE x >= outline[1].x AND x < outline[1].x + 120 AND z >= outline[1].z AND z < outline[1].z + 24 END AND NOT (holed AND x >= outline[1].x + 40 AND x < outline[1].x + 70 AND z >= outline[1].z + 7 AND z < outline[1].z + 17)"""


@query(f"""WITH {_zr(0)}, {_zs(0)}, ring AS (SELECT zone, name, nr, outline AS r, true AS o FROM zr0 UNION ALL SELECT zone, name, nr, rings[2], false FROM zr0 WHERE holed),
each AS (SELECT s.zone, s.id, s.pt, len(s.regions) AS k, unnest(s.regions) AS name, generate_subscripts(s.regions, 1) AS place FROM zs0 s),
met AS (SELECT e.*, r.name IS NOT NULL AS known, pt[1] AS x, pt[3] AS z, r.outline, r.holed, r.nr FROM each e LEFT JOIN zr0 r ON r.zone = e.zone AND r.name = e.name),
mi AS (SELECT *, known AND coalesce({_INSIDE}, false) AS inside FROM met),
j AS (SELECT zone, id, any_value(pt) AS pt, any_value(k) AS k, bool_and(known) AS def, bool_or(inside) AS inside, arg_min(name, (NOT inside)::INT * 10 + place) AS name FROM mi GROUP BY ALL), ok AS (SELECT * FROM j WHERE def AND pt IS NOT NULL),
f AS (SELECT s.zone, s.id, s.name AS own, r.name, abs(s.pt[2] - list_reduce(list_transform(outline, lambda p: {{'d': (p.x - s.pt[1]) ** 2 + (p.z - s.pt[3]) ** 2, 'y': p.y}}), lambda u, w: CASE WHEN w.d < u.d THEN w ELSE u END).y) AS dy, 2880 + 0 * wide AS span, nr FROM ok s JOIN zr0 r ON r.zone = s.zone, LATERAL (SELECT s.pt[1] AS x, s.pt[3] AS z) q WHERE s.inside AND s.k = 1 AND {_INSIDE}),
g AS (SELECT *, min(dy) OVER (PARTITION BY zone, id) AS best FROM f), near AS (SELECT * FROM g WHERE dy <= best + 5 QUALIFY row_number() OVER (PARTITION BY zone, id ORDER BY span, nr) = 1),
loose AS (SELECT zone, count(*) AS n, count(*) FILTER (WHERE pt IS NULL AND path IS NULL) AS k FROM zs0 WHERE regions IS NULL GROUP BY 1)
SELECT zone, 'error' AS level, CASE WHEN o THEN 'outline' ELSE 'hole' END || '-vertices' AS code, name AS region, NULL::BIGINT AS spawn_id, 1::BIGINT AS n FROM ring WHERE len(r) < 3
UNION ALL SELECT zone, 'error', 'outline-crosses-itself', name, NULL, 1 FROM ring WHERE o AND nr % 7 = 3 AND len(r) = 4
UNION ALL SELECT zone, 'warn', 'no-spawns', name, NULL, 1 FROM zr0 WHERE (zone, name) NOT IN (SELECT (zone, name) FROM each)
UNION ALL SELECT zone, 'error', 'legs', NULL, id, 1 FROM zs0 WHERE len(path) < 2
UNION ALL SELECT zone, 'error', 'region-and-route', NULL, id, 1 FROM zs0 WHERE path IS NOT NULL AND regions IS NOT NULL
UNION ALL SELECT zone, 'error', 'undefined-region', name, id, 1 FROM met WHERE NOT known
UNION ALL SELECT zone, 'info', 'outside', name, id, 1 FROM ok WHERE NOT inside
UNION ALL SELECT zone, 'warn', 'nearer-floor', own, id, 1 FROM near WHERE name <> own
UNION ALL SELECT zone, 'info', 'fixed-points', NULL, NULL, n FROM loose
UNION ALL SELECT zone, 'warn', 'nowhere', NULL, NULL, k FROM loose WHERE k > 0""")
def zone_check(spark: SparkSession, d: str) -> DataFrame:
    return zones.validate(E.zone_regions(spark, d), E.zone_spawns(spark, d))


@query(f"WITH {_zs(0)}, e AS (SELECT zone, unnest(regions) AS region FROM zs0) SELECT zone, region, count(*) AS n FROM e GROUP BY ALL")
def spawns_per_region(spark: SparkSession, d: str) -> DataFrame:
    return zones.spawns_per_region(E.zone_spawns(spark, d))


_STATUS = "CASE WHEN regions IS NOT NULL THEN 'region' WHEN path IS NOT NULL THEN 'route' WHEN pt IS NOT NULL THEN 'fixed' ELSE 'nowhere' END"


@query(f"WITH {_zs(0)}, s AS (SELECT zone, unnest([{_STATUS}, 'all']) AS status FROM zs0) SELECT zone, status, count(*) AS n FROM s GROUP BY ALL")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return zones.status_counts(E.zone_spawns(spark, d))


@query(f"WITH {_zs(0)} SELECT zone, id FROM zs0 WHERE {_STATUS} = 'route' AND (contains(lower(name), 'mach') OR contains(id::VARCHAR, '36'))")
def spawns_by_status(spark: SparkSession, d: str) -> DataFrame:
    a, b = (zones.filtered_by_status(E.zone_spawns(spark, d), "route", t).select("zone", "id") for t in ("MACH", "36"))
    return a.unionByName(b).distinct()


@query(f"WITH {_zs(0)} SELECT zone, id FROM zs0 WHERE pt IS NOT NULL AND regions IS NULL AND path IS NULL")
def unplaced_labelled(spark: SparkSession, d: str) -> DataFrame:
    return zones.filtered_by_status(E.zone_spawns(spark, d), "fixed").select("zone", "id")


def _one(v: str) -> str:
    """A number's text at one decimal: halves of its written digits go up, as in the query; the sign stays."""
    return f"CASE WHEN starts_with(({v})::VARCHAR, '-') THEN '-' ELSE '' END || round(abs({v})::VARCHAR::DECIMAL(30, 15), 1)::VARCHAR"


@query(f"WITH {_zs(0)}, l AS (SELECT zone, id, array_to_string(list_transform(path, lambda p: concat_ws(' ', {_one('p.x % 8')}, {_one('p.y')}, {_one('p.z % 4')})), ';') AS line FROM zs0 WHERE path IS NOT NULL) SELECT zone, id, count(*) OVER (PARTITION BY zone, line) AS n FROM l")
def shared_routes(spark: SparkSession, d: str) -> DataFrame:
    """Patrols on a small lattice, so that some share a line."""
    small = F.transform("path", lambda v: F.struct((v["x"] % 8).alias("x"), v["y"].alias("y"), (v["z"] % 4).alias("z")))
    return zones.shared_routes(E.zone_spawns(spark, d).withColumn("path", small))


@query(f"WITH {_zr(0)}, {_zs(0)}, c AS (SELECT zone, name, list_avg(list_transform(outline, lambda p: p.x)) AS cx, list_avg(list_transform(outline, lambda p: p.z)) AS cz FROM zr0), e AS (SELECT zone, id, unnest(regions) AS name FROM zs0 WHERE pt IS NULL), a AS (SELECT e.zone, id, avg(cx) AS x, avg(cz) AS z FROM e JOIN c ON c.zone = e.zone AND c.name = e.name GROUP BY ALL UNION ALL SELECT zone, id, pt[1], pt[3] FROM zs0 WHERE pt IS NOT NULL) SELECT zone, id, round(x, 6) AS x, round(z, 6) AS z FROM a")
def standing_places(spark: SparkSession, d: str) -> DataFrame:
    return zones.standing_places(E.zone_spawns(spark, d), E.zone_regions(spark, d)).withColumns({c: F.round(c, 6) for c in "xz"})


_MAPS = """mp AS (SELECT s_suppkey % 5 AS zone, CAST(s_suppkey % 4 AS INT) AS floor, s_suppkey AS nr, s_suppkey % 2 AS number, 400 + 40 * (s_suppkey % 7) AS scale, -40 - s_suppkey % 30 AS ox, -450 - s_suppkey % 30 AS oy, (s_suppkey * 10)::VARCHAR AS image FROM supplier),
fm AS (SELECT * FROM mp QUALIFY row_number() OVER (PARTITION BY zone, floor ORDER BY nr) = 1)"""


@query(f"WITH {_TRAIL}, {_MAPS}, p AS (SELECT seq, t.zone, x * 4 - 900 AS x, z * 30 - 1500 AS z, CAST(y % 5 AS INT) AS floor FROM trail t), m AS (SELECT p.*, trunc(x * scale / 1280 + 0.5)::INT - ox AS px, -oy - trunc(z * scale / 1280 + 0.5)::INT AS py FROM p LEFT JOIN fm ON fm.zone = p.zone AND fm.floor = p.floor) SELECT seq, chr((65 + trunc((px - 16) / 32.0))::INT) || '-' || (trunc((py - 16) / 32.0)::INT + 1) AS square FROM m")
def map_squares(spark: SparkSession, d: str) -> DataFrame:
    """Trail points, stretched over the sheets, on floors 0 to 4 (there is no map of 4)."""
    p = E.trail_points(spark, d).select("zone", "seq", (F.col("x") * 4 - 900).alias("x"), (F.col("z") * 30 - 1500).alias("z"), (F.col("y") % 5).cast("int").alias("floor"))
    return maps.squares_of(p, E.maps(spark, d)).select("seq", "square")


@query(f"WITH {_MAPS}, k AS (SELECT unnest(range(16)) AS k), p AS (SELECT zone, floor, k, (16 + 32 * k + ox) * 1280.0::DOUBLE / scale AS x, -(16 + 32 * k + oy) * 1280.0::DOUBLE / scale AS z, (16 + ox) * 1280.0::DOUBLE / scale AS x0, (496 + ox) * 1280.0::DOUBLE / scale AS x9, -(16 + oy) * 1280.0::DOUBLE / scale AS z0, -(496 + oy) * 1280.0::DOUBLE / scale AS z9 FROM fm, k) SELECT zone, floor, k, 'column' AS way, round(x, 6) AS x1, round(z0, 6) AS z1, round(x, 6) AS x2, round(z9, 6) AS z2 FROM p UNION ALL SELECT zone, floor, k, 'row', round(x0, 6), round(z, 6), round(x9, 6), round(z, 6) FROM p")
def map_lines(spark: SparkSession, d: str) -> DataFrame:
    return maps.grid_lines(E.maps(spark, d)).withColumns({c: F.round(c, 6) for c in ("x1", "z1", "x2", "z2")})


@query(f"WITH {_MAPS}, c AS (SELECT unnest(range(15)) AS c), r AS (SELECT unnest(range(15)) AS r) SELECT zone, floor, chr((65 + c)::INT) || '-' || (r + 1) AS name, round((32 + 32 * c + ox) * 1280.0::DOUBLE / scale, 6) AS x, round(-(32 + 32 * r + oy) * 1280.0::DOUBLE / scale, 6) AS z, round(40960.0::DOUBLE / scale, 6) AS size FROM fm, c, r")
def map_grid(spark: SparkSession, d: str) -> DataFrame:
    return maps.grid_squares(E.maps(spark, d)).withColumns({c: F.round(c, 6) for c in ("x", "z", "size")})


@query(f"WITH {_MAPS} SELECT zone, floor, CASE WHEN number = 0 THEN 'z' || zone || '_' || floor ELSE image END AS file, round(ox * 1280.0::DOUBLE / scale, 6) AS x0, round(-oy * 1280.0::DOUBLE / scale, 6) AS z0, round((512 + ox) * 1280.0::DOUBLE / scale, 6) AS x1, round(-(512 + oy) * 1280.0::DOUBLE / scale, 6) AS z1 FROM fm")
def map_sheets(spark: SparkSession, d: str) -> DataFrame:
    return maps.sheets(E.maps(spark, d)).withColumns({c: F.round(c, 6) for c in ("x0", "z0", "x1", "z1")})


@query("SELECT s_suppkey AS id, 0 AS nr, CASE WHEN s_suppkey % 5 = 0 THEN 'computed' WHEN s_suppkey % 3 = 0 THEN 'cuboid' WHEN s_suppkey % 3 = 1 THEN 'cylinder' ELSE 'sphere' END AS kind, CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 3 = 0 THEN s_suppkey * 11 + 21.0 WHEN s_suppkey % 3 = 1 THEN s_suppkey * 5 + 9.5 ELSE s_suppkey * 4 + 3.0 END AS total FROM supplier UNION ALL SELECT s_suppkey, 1, 'computed', NULL FROM supplier")
def trigger_areas(spark: SparkSession, d: str) -> DataFrame:
    """Scripts that register one area each, some with a variable among the numbers, and one call of too few numbers."""
    k = F.col("s_suppkey").cast("string")
    call = lambda name, *a: F.concat(F.lit(f"zone:register{name}TriggerArea("), F.concat_ws(", ", *a), F.lit(")"))
    one = (
        F.when(F.col("s_suppkey") % 5 == 0, call("Cuboid", k, F.lit("x + 1"), *[k] * 5)).when(F.col("s_suppkey") % 3 == 0, call("Cuboid", k, *[F.concat(k, F.lit(f".{i}")) for i in range(1, 7)], *[]))
        .when(F.col("s_suppkey") % 3 == 1, call("Cylindrical", k, k, k, F.concat(k, F.lit(".5")))).otherwise(call("Spherical", k, k, F.lit("-3"), k, F.lit("1e0")))
    )
    files = E.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("local a = 1\n"), one, F.lit("\nzone:registerSphericalTriggerArea(1, 2)\n")).alias("text"))
    out = texts.trigger_areas(files, "id")
    s = F.aggregate("numbers", F.lit(0.0), lambda a, b: a + b)
    k = F.col("id")
    whole = F.when(F.col("kind") == "cuboid", F.round(s - k * 7 - 2.1, 6) + k * 11 + 21).when(F.col("kind") == "cylinder", F.round(s - k * 4 - 0.5, 6) + k * 5 + 9.5).when(F.col("kind") == "sphere", F.round(s - k * 3 + 2, 6) + k * 4 + 3)
    return out.select("id", "nr", "kind", whole.alias("total"))


@query("SELECT s_suppkey AS zone, CAST(s_nationkey AS VARCHAR) AS id, s_acctbal AS x, 'zone_' || s_nationkey AS \"to\", CASE WHEN s_suppkey % 2 = 0 THEN 1.5::DOUBLE END AS facing, CASE WHEN s_suppkey % 3 = 0 THEN 4.0 ELSE 1.0 END::DOUBLE AS wide FROM supplier WHERE s_suppkey % 7 <> 0")
def zone_lines(spark: SparkSession, d: str) -> DataFrame:
    """Zone files of one line each; every seventh lacks its arrival point and is left out."""
    k = F.col("s_suppkey")
    at = F.when(k % 7 == 0, "[1.0, 2.0]").when(k % 2 == 0, "[1.0, 2.0, 3.0, 1.5]").otherwise("[1.0, 2.0, 3.0]")
    body = F.concat(F.lit("zonelines:\n  "), F.col("s_nationkey").cast("string"), F.lit(":\n    from: ["), F.col("s_acctbal").cast("string"), F.lit(", -1.5, 2]\n    to: zone_"), F.col("s_nationkey").cast("string"), F.lit("\n    at: "), at, F.when(k % 3 == 0, "\n    scale: [4.0, 2.0]").otherwise(""), F.lit("\nother: 1\n"))
    rows = texts.zone_lines(E.table(spark, d, "supplier").select(k.alias("zone"), body.alias("text")), "zone")
    return rows.select("zone", "id", F.get("from", F.lit(0)).alias("x"), "to", "facing", F.get("scale", F.lit(0)).alias("wide"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 5 <> 4 THEN round(c_acctbal, 2) END AS x, CASE WHEN c_custkey % 5 <> 4 THEN c_custkey::DOUBLE END AS y, CASE WHEN c_custkey % 5 <> 4 THEN -2.5::DOUBLE END AS z FROM customer")
def typed_coordinates(spark: SparkSession, d: str) -> DataFrame:
    k, v = F.col("c_custkey"), F.format_string("%.2f", "c_acctbal")
    text = (
        F.when(k % 5 == 0, F.concat(F.lit("x: "), v, F.lit(", y: "), k.cast("string"), F.lit(", z: -2.5"))).when(k % 5 == 1, F.concat_ws(" ", v, k.cast("string"), F.lit("-2.5")))
        .when(k % 5 == 2, F.concat(F.lit("at ("), F.concat_ws(", ", v, k.cast("string"), F.lit("-2,5")), F.lit(")"))).when(k % 5 == 3, F.concat(F.lit("X : "), v, F.lit(",Y:"), k.cast("string"), F.lit(",Z:-2.5"))).otherwise(v)
    )
    return E.table(spark, d, "customer").select(k.alias("id"), texts.coordinates(text).alias("p")).select("id", "p.x", "p.y", "p.z")


@query("SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'a/b' WHEN 1 THEN 'c-d/e.f' WHEN 2 THEN 'up/stream' WHEN 3 THEN 'up/stream' END AS repo, CASE WHEN page_id % 5 <> 4 THEN page_id END AS number FROM pages")
def pull_requests(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id").cast("string")
    text = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("see https://github.com/a/b/pull/"), k, F.lit("/files"))).when(F.col("page_id") % 5 == 1, F.concat(F.lit(" c-d/e.f#"), k)).when(F.col("page_id") % 5 == 2, F.concat(F.lit("#"), k)).when(F.col("page_id") % 5 == 3, k).otherwise(F.concat(F.lit("no. "), k))
    return E.table(spark, d, "pages").select("page_id", texts.pull_request(text, "up/stream").alias("p")).select("page_id", "p.repo", "p.number")


@query("SELECT n_name AS name, replace(n_name, ' ', '_') || '_-_Site_#A' || n_nationkey || '_s' AS file, regexp_replace(lower(n_name), '[^a-z0-9]+', '_', 'g') || '_site_a' || n_nationkey || 's' AS folder FROM nation")
def zone_files(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat("n_name", F.lit(" - Site #A"), F.col("n_nationkey").cast("string"), F.lit("'s"))
    return E.table(spark, d, "nation").select(F.col("n_name").alias("name"), texts.roam_file(name).alias("file"), texts.zone_folder(name).alias("folder"))


@query(f"WITH {_TRAIL} SELECT zone, CAST(mob_id AS VARCHAR) AS mob_id, 'mob ' || mob_id AS name, CAST(row_number() OVER (PARTITION BY mob_id ORDER BY seq) - 1 AS INT) AS seq, x, y, z, CAST(dir AS INT) AS dir, t FROM trail")
def roam_read_back(spark: SparkSession, d: str) -> DataFrame:
    """Roam files as written, read again."""
    points = E.trail_points(spark, d).withColumn("name", F.concat(F.lit("mob "), F.col("mob_id").cast("string")))
    return texts.read_roam(texts.roam_text(points), "zone")


@query("SELECT n_name AS name, (list_reduce(list_prepend(0::BIGINT, [unicode(x)::BIGINT FOR x IN string_split(n_name, '')]), lambda h, c: (h * 31 + c) % 65536) / 65535 * 0.87 + 0.18) % 1.0 AS hue FROM nation")
def region_hues(spark: SparkSession, d: str) -> DataFrame:
    return E.zone_regions(spark, d).select("name", G.string_hue(F.col("name")).alias("hue"))


@query("WITH h AS (SELECT c_custkey AS id, (c_custkey % 97) / 97 AS h, (c_custkey % 89) / 89 AS g, (c_custkey % 4) / 4 AS s FROM customer) SELECT id, round(CASE WHEN s >= 0.25 AND abs((h - g + 1.5) % 1 - 0.5) < 0.125 THEN (g + CASE WHEN (h - g + 1) % 1 < 0.5 THEN 0.25 ELSE -0.25 END + 1) % 1 ELSE h END, 9) AS hue FROM h")
def contrast_hues(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return E.table(spark, d, "customer").select(k.alias("id"), F.round(G.contrast_hue(k % 97 / 97, k % 89 / 89, k % 4 / 4), 9).alias("hue"))


@query(f"WITH {_zr(0)}, b AS (SELECT zone, name, nr, outline[1].x AS x, outline[1].z AS z FROM zr0 WHERE nr % 7 <> 3 AND nr % 11 <> 5) SELECT a.zone, a.name AS a, c.name AS b, round(sqrt(power(greatest(abs(a.x - c.x) - 120, 0), 2) + power(greatest(abs(a.z - c.z) - 24, 0), 2)), 6) AS distance FROM b a JOIN b c ON a.zone = c.zone AND a.nr < c.nr WHERE abs(a.x - c.x) > 120 OR abs(a.z - c.z) > 24")
def region_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Distances between the outlines of a zone's sound regions that don't overlap."""
    r = E.zone_regions(spark, d).where("nr % 7 <> 3 and nr % 11 <> 5").select("zone", "name", "nr", F.element_at("rings", 1).alias("ring"))
    both = r.select("zone", F.col("name").alias("a"), F.col("nr").alias("na"), F.col("ring").alias("ra")).join(r.select("zone", F.col("name").alias("b"), F.col("nr").alias("nb"), F.col("ring").alias("rb")), "zone").where("na < nb")
    corner = lambda c: F.get(c, F.lit(0))
    apart = (F.abs(corner("ra")["x"] - corner("rb")["x"]) > 120) | (F.abs(corner("ra")["z"] - corner("rb")["z"]) > 24)
    return both.where(apart).select("zone", "a", "b", F.round(G.ring_to_ring_distance(F.col("ra"), F.col("rb")), 6).alias("distance"))


@query(f"WITH {_zr(0)}, w AS (SELECT zone, name AS other, nr AS n2, outline[1].x + 45 AS x, outline[1].z AS z FROM zr0 WHERE nr % 7 <> 3 AND nr % 11 <> 5), b AS (SELECT zone, name, nr, outline[1].x AS x, outline[1].z AS z FROM zr0 WHERE nr % 7 <> 3 AND nr % 11 <> 5), c AS (SELECT b.zone, b.name, w.other, list_sum([(p.px >= b.x AND p.px < b.x + 120 AND p.pz >= b.z AND p.pz < b.z + 24)::INT FOR p IN [{{'px': w.x, 'pz': w.z}}, {{'px': w.x + 60, 'pz': w.z}}, {{'px': w.x + 60, 'pz': w.z + 12}}, {{'px': w.x, 'pz': w.z + 12}}, {{'px': w.x, 'pz': w.z + 6}}]]) AS k FROM w JOIN b USING (zone)) SELECT zone, other, name, k >= 0.8 * 5 AS inside FROM c")
def rings_mostly_inside(spark: SparkSession, d: str) -> DataFrame:
    """Smaller rings, moved to the side, against all outlines of their zone."""
    r = E.zone_regions(spark, d).where("nr % 7 <> 3 and nr % 11 <> 5").select("zone", "name", F.element_at("rings", 1).alias("ring"))
    x, z = F.get("ring", F.lit(0))["x"] + 45, F.get("ring", F.lit(0))["z"]
    c = lambda a, b: F.struct((x + a).alias("x"), (z + b).alias("z"))
    small = r.select("zone", F.col("name").alias("other"), F.array(c(0, 0), c(60, 0), c(60, 12), c(0, 12), c(0, 6)).alias("small"))
    return small.join(r, "zone").select("zone", "other", "name", G.mostly_inside(F.col("small"), F.col("ring")).alias("inside"))


@query(f"WITH {_TRAIL}, {_zr(0)}, p AS (SELECT seq, t.zone, t.x, t.z, name, nr, holed, outline FROM trail t JOIN zr0 r ON r.zone = t.zone WHERE nr % 7 <> 3) SELECT zone, name, count(*) FILTER (WHERE len(outline) >= 3 AND x >= outline[1].x AND x < outline[1].x + 120 AND z >= outline[1].z AND z < outline[1].z + 24) AS outline, count(*) FILTER (WHERE holed AND x >= outline[1].x + 40 AND x < outline[1].x + 70 AND z >= outline[1].z + 7 AND z < outline[1].z + 17) AS hole FROM p GROUP BY ALL")
def ring_hits(spark: SparkSession, d: str) -> DataFrame:
    """For each sound region of a zone, how many of the zone's points its outline and its hole hold."""
    return regions.ring_counts(E.trail_points(spark, d), E.zone_regions(spark, d).where("nr % 7 <> 3"), "zone")


@query(f"WITH {_zr(0)}, {_zs(0)}, e AS (SELECT zone, id, pt, unnest(regions) AS name FROM zs0 WHERE pt IS NOT NULL) SELECT e.zone, id, e.name, round(list_reduce(list_transform(outline, lambda p: {{'d': (p.x - pt[1]) ** 2 + (p.z - pt[3]) ** 2, 'y': p.y}}), lambda u, w: CASE WHEN w.d < u.d THEN w ELSE u END).y, 6) AS height FROM e JOIN zr0 r ON r.zone = e.zone AND r.name = e.name")
def nearest_heights(spark: SparkSession, d: str) -> DataFrame:
    """The height of the nearest corner of each spawn's own regions."""
    e = E.zone_spawns(spark, d).where("at is not null").select("zone", "id", "at", F.explode("regions").alias("name")).join(E.zone_regions(spark, d), ["zone", "name"])
    return e.select("zone", "id", "name", F.round(G.nearest_height(F.get("at", F.lit(0)), F.get("at", F.lit(2)), F.element_at("rings", 1)), 6).alias("height"))
