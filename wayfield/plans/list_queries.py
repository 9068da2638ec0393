"""Queries over lists, labels and small lookups, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfield.operators import lists as L
from wayfield.operators import regions, zones
from wayfield.plans.queries import _INSIDE, _REGIONS, _SPAWNS, _TRAIL, query
from wayfield.plans.zone_queries import _zr
from wayfield.sources import entities as E


@query("SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer")
def sorted_rows(spark: SparkSession, d: str) -> DataFrame:
    return L.ranked(E.table(spark, d, "customer"), "c_acctbal", "c_custkey", True, ("c_mktsegment",)).select("c_custkey", "place")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN replace(p_type, ' ', '') ELSE regexp_replace(replace(p_type, ' ', '_'), '_', '') END AS label FROM part")
def option_labels(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("p_partkey") % 3 == 0, F.replace("p_type", F.lit(" "), F.lit(""))).otherwise(F.replace("p_type", F.lit(" "), F.lit("_")))
    return E.table(spark, d, "part").select(F.col("p_partkey").alias("id"), L.option_label(name).alias("label"))


@query(f"WITH {_TRAIL}, {_REGIONS}, {_SPAWNS}, c AS (SELECT m.name AS region, m.id AS mob_id, count(*) AS n, avg(CASE WHEN {_INSIDE} THEN 1.0 ELSE 0.0 END) AS coverage FROM member m JOIN trail p ON p.mob_id = m.id JOIN reg r ON r.name = m.name GROUP BY ALL HAVING count(*) >= 5), t AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY region ORDER BY n DESC, mob_id) <= 3) SELECT region, mob_id, n, round(coverage, 6) AS coverage, row_number() OVER (PARTITION BY region ORDER BY coverage DESC, n DESC, mob_id) AS place FROM t")
def conversion_candidates(spark: SparkSession, d: str) -> DataFrame:
    """For each region the three of its mobs with most samples (five at least), the one that keeps to the region best first."""
    c = regions.member_coverage(E.spawns(spark, d), E.trail_points(spark, d), E.regions(spark, d)).where("n >= 5")
    top = L.ranked(c, "n", "mob_id", True, ("region",)).where("place <= 3").drop("place")
    order = Window.partitionBy("region").orderBy(F.desc("coverage"), F.desc("n"), "mob_id")
    return top.withColumn("place", F.row_number().over(order)).withColumn("coverage", F.round("coverage", 6))


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 10")
def last_steps(spark: SparkSession, d: str) -> DataFrame:
    return L.last_steps(E.table(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id", 10)


@query("SELECT o_custkey, least(count(*), 8) AS n, count(*) >= 8 AS partial FROM orders GROUP BY 1")
def partial_listings(spark: SparkSession, d: str) -> DataFrame:
    return L.listing_sizes(E.table(spark, d, "orders"), "o_custkey", 8)


@query(f"WITH {_zr(0)}, w AS (SELECT zone, name, lag(name) OVER v AS b, lead(name) OVER v AS a, first_value(name) OVER (PARTITION BY zone ORDER BY name) AS f, max(name) OVER (PARTITION BY zone) AS l FROM zr0 WINDOW v AS (PARTITION BY zone ORDER BY name)) SELECT zone, name, coalesce(b, l) AS before, coalesce(a, f) AS after FROM w")
def region_cycle(spark: SparkSession, d: str) -> DataFrame:
    return L.neighbours(E.zone_regions(spark, d).select("zone", "name"), "zone", "name")


@query("WITH s AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer) SELECT c_custkey FROM customer, s WHERE c_acctbal BETWEEN round((lo + (hi - lo) * 0.25) / 50) * 50 AND round((lo + (hi - lo) * 0.75) / 50) * 50")
def middle_half(spark: SparkSession, d: str) -> DataFrame:
    return L.middle_half(E.table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 50.0).select("c_custkey")


@query("SELECT s_nationkey AS nation FROM supplier INTERSECT SELECT c_nationkey FROM customer")
def zones_on_both_sides(spark: SparkSession, d: str) -> DataFrame:
    return E.table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation")).intersect(E.table(spark, d, "customer").select("c_nationkey"))


@query(f"WITH {_zr(0)}, z AS (SELECT DISTINCT zone FROM zr0), s AS (SELECT DISTINCT zone FROM zr0 WHERE nr > 20) SELECT z.zone, s.zone IS NOT NULL AS started FROM z LEFT JOIN s USING (zone)")
def zone_listing(spark: SparkSession, d: str) -> DataFrame:
    """Zones, and whether one has a region of its own (numbers over 20 here)."""
    r = E.zone_regions(spark, d)
    return r.select("zone").distinct().join(r.where("nr > 20").select("zone").distinct().withColumn("started", F.lit(True)), "zone", "left").select("zone", F.coalesce("started", F.lit(False)).alias("started"))


@query("""WITH c AS (SELECT c_custkey AS id, c_nationkey AS k, c_mktsegment || CASE WHEN c_custkey % 10 = 3 THEN '_' || (2 + c_custkey % 4) ELSE '' END AS name FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY k, name ORDER BY id) AS u FROM c),
f AS (SELECT k, name, i, row_number() OVER (PARTITION BY k, name ORDER BY i) + 1 AS u FROM (SELECT k, name, unnest(range(2, count(*) + 8)) AS i FROM c GROUP BY k, name) WHERE (k, name || '_' || i) NOT IN (SELECT (k, name) FROM c))
SELECT id, CASE WHEN r.u = 1 THEN r.name ELSE r.name || '_' || i END AS "unique" FROM r LEFT JOIN f ON f.k = r.k AND f.name = r.name AND f.u = r.u""")
def unique_names(spark: SparkSession, d: str) -> DataFrame:
    """Segments as names within a nation; some bear a number already."""
    k = F.col("c_custkey")
    named = E.table(spark, d, "customer").select(k.alias("id"), "c_nationkey", F.concat("c_mktsegment", F.when(k % 10 == 3, F.concat(F.lit("_"), (2 + k % 4).cast("string"))).otherwise("")).alias("name"))
    return L.unique_names(named, ("c_nationkey",), "name", "id").select("id", "unique")


_SPELL = "CASE WHEN {0} > 86400 THEN floor({0} / 86400 + 0.5)::BIGINT || ' days' WHEN {0} > 3600 THEN floor({0} / 3600 + 0.5)::BIGINT || ' hours' ELSE floor({0} / 60 + 0.5)::BIGINT || ' minutes' END"


@query(f"SELECT o_orderkey AS id, CASE WHEN gap > 120 THEN 'jumped, ' || {_SPELL.format('gap')} || ' unwatched' WHEN walked < 60 THEN walked || ' seconds in' ELSE {_SPELL.format('walked')} || ' in' END AS words, strftime(o_orderdate, 'regions-%Y-%m-%d') AS branch FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey * 7919 % 400009 ELSE o_orderkey % 121 END AS gap, o_orderkey * 104729 % (o_orderkey % 7 * 50021 + 59) AS walked FROM orders)")
def durations_and_branches(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    words = L.watched_words(F.when(k % 3 == 0, k * 7919 % 400009).otherwise(k % 121), k * 104729 % (k % 7 * 50021 + 59))
    return E.table(spark, d, "orders").select(k.alias("id"), words.alias("words"), F.concat(F.lit("regions-"), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("branch"))


@query("""WITH h AS (SELECT page_id, list_reduce(list_prepend(2166136261::HUGEINT, [unicode(x)::HUGEINT FOR x IN string_split('Zön日 ' || url, '')]), lambda h, c: xor(h, c) * 16777619 % 4294967296)::BIGINT AS f FROM pages),
t AS (SELECT page_id, array_to_string(list_transform(range(6, -1, -1), lambda i: substr('0123456789abcdefghijklmnopqrstuvwxyz', (f // (36 ** i)::BIGINT % 36 + 1)::BIGINT, 1)), '') AS s FROM h) SELECT page_id, ltrim(s, '0') AS fingerprint FROM t""")
def draft_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return E.table(spark, d, "pages").select("page_id", L.fingerprint(F.concat(F.lit("Zön日 "), "url")).alias("fingerprint"))


@query("SELECT o_custkey AS folder, arg_max(o_orderkey, {'t': o_orderdate, 'k': o_orderkey}) AS draft FROM orders GROUP BY 1")
def newest_drafts(spark: SparkSession, d: str) -> DataFrame:
    drafts = E.table(spark, d, "orders").select(F.col("o_custkey").alias("folder"), F.col("o_orderkey").alias("draft"), F.struct("o_orderdate", "o_orderkey").alias("saved"))
    return L.newest_drafts(drafts, "folder", "saved").select("folder", "draft")


@query("SELECT n_name AS name FROM nation WHERE contains(lower(n_name), 'an') OR levenshtein(lower(n_name), 'an') <= 0.2")
def fuzzy_names(spark: SparkSession, d: str) -> DataFrame:
    return L.fuzzy(E.table(spark, d, "nation").select(F.col("n_name").alias("name")), "name", "an")


@query("WITH z AS (SELECT n_nationkey % 7 AS id, count(*) AS n, list_sort(list(n_name)) AS names FROM nation GROUP BY 1) SELECT id, 'T: Roam regions: ' || CASE WHEN n <= 3 THEN array_to_string(names, ', ') ELSE n || ' zones' END || ' (' || id || ', {{ other }})' AS text FROM z")
def change_titles(spark: SparkSession, d: str) -> DataFrame:
    z = E.table(spark, d, "nation").groupBy((F.col("n_nationkey") % 7).alias("id")).agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    return z.select("id", L.filled(F.lit("T: {{title}} ({{  id }}, {{ other }})"), {"title": L.title(F.col("names")), "id": F.col("id")}).alias("text"))


@query(f"WITH {_zr(0)} SELECT zone, name, 'zone:registerCuboidTriggerArea(' || nr || printf(', %.3f', list_min(list_transform(outline, lambda p: p.x))) || printf(', %.3f', outline[1].y) || printf(', %.3f', list_min(list_transform(outline, lambda p: p.z))) || printf(', %.3f', list_max(list_transform(outline, lambda p: p.x))) || printf(', %.3f', outline[1].y + 10) || printf(', %.3f', list_max(list_transform(outline, lambda p: p.z))) || ')' AS text FROM zr0")
def area_calls(spark: SparkSession, d: str) -> DataFrame:
    ring = F.element_at("rings", 1)
    of = lambda f, c: f(F.transform(ring, lambda v: v[c]))
    y = F.element_at(ring, 1)["y"]
    call = L.trigger_call(F.col("nr"), (of(F.array_min, "x"), y, of(F.array_min, "z")), (of(F.array_max, "x"), y + 10, of(F.array_max, "z")))
    return E.zone_regions(spark, d).select("zone", "name", call.alias("text"))


@query("SELECT c_custkey * 7 % 25 AS zone, c_custkey AS id, c_nationkey AS origin FROM customer WHERE c_custkey * 7 % 25 <> c_nationkey")
def cross_zone_arrivals(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return L.arrivals(E.table(spark, d, "customer").select(F.col("c_nationkey").alias("zone"), (k * 7 % 25).alias("to"), k.alias("id")))


@query("""WITH l AS (SELECT s_suppkey AS id, s_nationkey AS zone, round(s_acctbal / 1000, 2) AS x, s_suppkey % 9 + 0.5 AS z FROM supplier), b AS (SELECT c_custkey AS box, c_nationkey AS zone, c_custkey % 100 + 1 AS id, round(c_acctbal / 1000, 2) AS x, c_custkey % 7 + 0.5 AS z FROM customer),
m AS (SELECT l.zone, l.id, box, printf('%.1f', l.x) = printf('%.1f', b.x) AND printf('%.1f', l.z) = printf('%.1f', b.z) AS e, sqrt((l.x - b.x) ** 2 + (l.z - b.z) ** 2) AS far FROM l JOIN b ON b.zone = l.zone AND b.id = l.id), k AS (SELECT zone, id, box FROM m WHERE e OR far < 5 QUALIFY row_number() OVER (PARTITION BY zone, id ORDER BY NOT e, far, box) = 1) SELECT l.zone, l.id, k.box FROM l LEFT JOIN k ON k.zone = l.zone AND k.id = l.id""")
def zone_line_boxes(spark: SparkSession, d: str) -> DataFrame:
    s = E.table(spark, d, "supplier")
    lines = s.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("zone"), F.round(F.col("s_acctbal") / 1000, 2).alias("x"), (F.col("s_suppkey") % 9 + 0.5).alias("z"))
    k = F.col("c_custkey")
    boxes = E.table(spark, d, "customer").select(k.alias("box"), F.col("c_nationkey").alias("zone"), (k % 100 + 1).alias("id"), F.round(F.col("c_acctbal") / 1000, 2).alias("x"), (k % 7 + 0.5).alias("z"))
    return L.line_boxes(lines, boxes).select("zone", "id", "box")


@query(f"WITH {_zr(0)}, c AS (SELECT zone, name, unnest(outline) AS p, generate_subscripts(outline, 1) AS i FROM zr0), f AS (SELECT zone, name, i, CASE WHEN p.x::INT % 3 = 0 THEN NULL ELSE p.x::INT % 2 END AS floor FROM c), v AS (SELECT zone, name, floor, count(*) AS n, min(i) AS i FROM f WHERE floor IS NOT NULL GROUP BY ALL) SELECT zone, name, floor FROM v QUALIFY row_number() OVER (PARTITION BY zone, name ORDER BY n DESC, i) = 1")
def region_floors(spark: SparkSession, d: str) -> DataFrame:
    c = E.zone_regions(spark, d).select("zone", "name", F.posexplode(F.element_at("rings", 1)).alias("at", "p"))
    x = F.col("p.x").cast("int")
    return L.floor_votes(c.select("zone", "name", "at", F.when(x % 3 != 0, x % 2).alias("floor")))


@query("WITH s AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % 3 END AS floor FROM customer) SELECT id FROM s WHERE coalesce(floor = 1, true)")
def shown_on_floor(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return L.on_floor(E.table(spark, d, "customer").select(k.alias("id"), F.when(k % 5 != 0, k % 3).alias("floor")), 1).select("id")


@query("WITH s AS (SELECT c_nationkey % 5 AS zone, c_mktsegment AS island, count(*) AS n FROM customer GROUP BY ALL HAVING count(*) >= 3) SELECT zone, island, n, row_number() OVER (PARTITION BY zone ORDER BY n DESC, island) AS place, round(n / sum(n) OVER (PARTITION BY zone), 9) AS share FROM s")
def island_ranks(spark: SparkSession, d: str) -> DataFrame:
    s = E.table(spark, d, "customer").groupBy((F.col("c_nationkey") % 5).alias("zone"), F.col("c_mktsegment").alias("island")).agg(F.count(F.lit(1)).alias("n"))
    return L.island_ranks(s).withColumn("share", F.round("share", 9))


@query("SELECT p_partkey AS id, (((p_partkey * 7919 * 65537) >> 26 & 3) << 3) | ((p_partkey * 7919 * 65537) >> 3 & 7) AS map, (p_partkey * 7919) & 15 = 9 AS water FROM part")
def mesh_bits(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") * 7919
    return E.table(spark, d, "part").select(F.col("p_partkey").alias("id"), L.map_id(k * 65537).alias("map"), L.deep_water(k).alias("water"))


@query(f"WITH {_TRAIL} SELECT zone, floor(x / 4)::INT AS ix, floor(z / 4)::INT AS iz, avg(dir)::DOUBLE AS r, avg(seq % 256)::DOUBLE AS g, avg(t % 256)::DOUBLE AS b FROM trail GROUP BY ALL")
def ground_colours(spark: SparkSession, d: str) -> DataFrame:
    p = E.trail_points(spark, d).select("zone", "x", "z", F.col("dir").alias("r"), (F.col("seq") % 256).alias("g"), (F.col("t") % 256).alias("b"))
    return L.mean_colours(p)


@query(f"WITH {_zr(0)} SELECT zone, count(*) AS regions, CAST(sum(len(outline)) AS BIGINT) AS vertices, CAST(sum(holed::INT) AS BIGINT) AS holes FROM zr0 GROUP BY 1")
def region_sizes(spark: SparkSession, d: str) -> DataFrame:
    return E.zone_regions(spark, d).groupBy("zone").agg(F.count(F.lit(1)).alias("regions"), F.sum(F.size(F.element_at("rings", 1))).alias("vertices"), F.sum(F.size("rings") - 1).alias("holes"))


@query(f"WITH {_TRAIL}, {_REGIONS}, {_SPAWNS}, c AS (SELECT m.name AS region, count(*) AS total, count(*) FILTER (WHERE {_INSIDE}) AS inside FROM member m JOIN trail p ON p.mob_id = m.id JOIN reg r ON r.name = m.name GROUP BY 1) SELECT region, round(inside / total, 6) AS share, CASE WHEN inside / total < 0.7 THEN 'warn' ELSE 'info' END AS level FROM c WHERE inside / total < 0.9")
def coverage_findings(spark: SparkSession, d: str) -> DataFrame:
    c = regions.coverage(E.spawns(spark, d), E.trail_points(spark, d), E.regions(spark, d)).select("region", "inside", "total")
    return zones.coverage_findings(c).withColumn("share", F.round("share", 6))
