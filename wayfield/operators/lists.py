"""Lists and small texts: orders, neighbours in a list, unique names, thresholds, fingerprints and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(rows: DataFrame, by: str, key: str, descending: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """rows with place (from 1) in the order of a column, then of the key, within each of `keys`."""
    order = F.col(by).desc() if descending else F.col(by).asc()
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(order, key)))


def option_label(name: Column) -> Column:
    """A name without its first underscore."""
    at = F.instr(name, "_")
    return F.when(at > 0, F.concat(F.substring_index(name, "_", 1), F.substr(name, at + 1))).otherwise(name)


def last_steps(rows: DataFrame, key: str, order: str, most: int = 100) -> DataFrame:
    """The last `most` rows of each key."""
    return rows.withColumn("w_back", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).where(F.col("w_back") <= most).drop("w_back")


def listing_sizes(rows: DataFrame, key: str, most: int) -> DataFrame:
    """key, n (`most` at most) and partial: whether a listing is cut off at `most`."""
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return n.select(key, F.least("n", F.lit(most)).alias("n"), (F.col("n") >= most).alias("partial"))


def neighbours(rows: DataFrame, key: str, name: str) -> DataFrame:
    """key, name, before and after in the order of names, the last being before the first."""
    w = Window.partitionBy(key).orderBy(name)
    all_ = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.select(key, name, F.coalesce(F.lag(name).over(w), F.last(name).over(all_)).alias("before"), F.coalesce(F.lead(name).over(w), F.first(name).over(all_)).alias("after"))


def middle_half(rows: DataFrame, value: str, step: float) -> DataFrame:
    """Rows between a quarter and three quarters of the values' range, both rounded to steps."""
    span = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    at = lambda q: F.round((F.col("lo") + (F.col("hi") - F.col("lo")) * q) / step) * step
    return rows.join(F.broadcast(span.select(at(0.25).alias("w_lo"), at(0.75).alias("w_hi"))), F.col(value).between(F.col("w_lo"), F.col("w_hi"))).drop("w_lo", "w_hi")  # one row


def unique_names(rows: DataFrame, keys: tuple[str, ...], name: str, order: str) -> DataFrame:
    """rows with unique: the name at its first use within keys, then with the least number from _2 on that no name in use has.

    A name's own numbers that are taken (`a_3` for `a`) are few; the k-th free one is counted past them.
    """
    k = F.row_number().over(Window.partitionBy(*keys, name).orderBy(order))
    used = rows.select(*keys, F.col(name).alias("w_used")).distinct()
    tail = F.regexp_extract("w_used", r"_([1-9]\d{0,8})$", 1)
    taken = used.where(tail != "").select(*keys, F.substr("w_used", F.lit(1), F.length("w_used") - F.length(tail) - 1).alias(name), tail.cast("int").alias("w_n")).where("w_n > 1")
    taken = taken.groupBy(*keys, name).agg(F.array_sort(F.collect_list("w_n")).alias("w_taken"))
    free = F.aggregate(F.coalesce("w_taken", F.array().cast("array<int>")), F.col("w_k"), lambda n, t: n + F.when(t <= n, 1).otherwise(0))
    numbered = rows.withColumn("w_k", k).join(taken, [*keys, name], "left")
    return numbered.withColumn("unique", F.when(F.col("w_k") == 1, F.col(name)).otherwise(F.concat_ws("_", name, free))).select(*rows.columns, "unique")


def _rounded(v: Column) -> Column:
    return F.floor(v + 0.5).cast("long").cast("string")


def duration_words(seconds: Column) -> Column:
    """Days beyond one, hours beyond one, else minutes; halves go up."""
    n = lambda v, unit: F.concat(_rounded(v), F.lit(f" {unit}"))
    return F.when(seconds > 86400, n(seconds / 86400, "days")).when(seconds > 3600, n(seconds / 3600, "hours")).otherwise(n(seconds / 60, "minutes"))


def watched_words(gap: Column, walked: Column, most: float = 120.0) -> Column:
    """How long a mob had been in view at a sample: walked seconds, unless the gap before the sample is beyond `most`."""
    inside = F.when(walked < 60, F.concat(_rounded(walked), F.lit(" seconds"))).otherwise(duration_words(walked))
    return F.when(gap > most, F.concat(F.lit("jumped, "), duration_words(gap), F.lit(" unwatched"))).otherwise(F.concat(inside, F.lit(" in")))


def fingerprint(text: Column) -> Column:
    """FNV-1a over UTF-16 units in 32 bits, in base 36."""
    digits = F.hex(F.encode(text, "UTF-16BE"))
    units = F.when(F.length(digits) > 0, F.transform(F.sequence(F.lit(0), (F.length(digits) / 4).cast("int") - 1), lambda i: F.conv(F.substr(digits, i * 4 + 1, F.lit(4)), 16, 10).cast("long"))).otherwise(F.array().cast("array<long>"))
    # 32 bits times 16777619 fits 64 bits without a sign.
    return F.lower(F.conv(F.aggregate(units, F.lit(2166136261).cast("long"), lambda h, c: F.pmod(h.bitwiseXOR(c) * 16777619, F.lit(1 << 32))).cast("string"), 10, 36))


def newest_drafts(drafts: DataFrame, key: str, when: str) -> DataFrame:
    """The draft of each key saved last, with its columns."""
    rest = [c for c in drafts.columns if c != key]
    return drafts.groupBy(key).agg(F.max_by(F.struct(*rest), when).alias("d")).select(key, *(F.col(f"d.{c}").alias(c) for c in rest))


def fuzzy(rows: DataFrame, name: str, asked: str, most: float = 0.1) -> DataFrame:
    """Rows whose name holds the text, case aside, or differs from it in at most a share of its letters; in the order of names."""
    low = F.lower(name)
    return rows.where(low.contains(asked.lower()) | (F.levenshtein(low, F.lit(asked.lower())) <= most * len(asked))).orderBy(name)


def title(zones: Column) -> Column:
    """A pull request's title: up to three zones by name, more by their number."""
    n = F.size(zones)
    return F.concat(F.lit("Roam regions: "), F.when(n == 0, "several zones").when(n <= 3, F.array_join(zones, ", ")).otherwise(F.concat(n.cast("string"), F.lit(" zones"))))


def filled(template: Column, values: dict[str, Column]) -> Column:
    """A template with each {{ name }} replaced, blanks inside or not; a name without a value stays as it is written."""
    mark = r"\{\{\s*\w+\s*\}\}"
    marks = F.regexp_extract_all(template, F.lit(f"({mark})"))
    by_name = F.create_map(*[x for name, v in values.items() for x in (F.lit(name), v.cast("string"))])
    put = F.transform(marks, lambda m: F.coalesce(F.try_element_at(by_name, F.trim(F.translate(m, "{}", ""))), m))
    return F.array_join(F.flatten(F.transform(F.arrays_zip(F.split(template, mark).alias("t"), put.alias("p")), lambda r: F.array(r["t"], F.coalesce(r["p"], F.lit(""))))), "")


def trigger_call(id_: Column, low: tuple[Column, Column, Column], high: tuple[Column, Column, Column]) -> Column:
    """The script call that registers a cuboid area."""
    return F.concat(F.lit("zone:registerCuboidTriggerArea("), id_.cast("string"), *(F.format_string(", %.3f", c) for c in (*low, *high)), F.lit(")"))


def arrivals(lines: DataFrame) -> DataFrame:
    """zone, id, origin: the lines of other zones that lead into a zone."""
    return lines.where("zone <> `to`").select(F.col("to").alias("zone"), "id", F.col("zone").alias("origin"))


def line_boxes(lines: DataFrame, boxes: DataFrame, reach: float = 5.0) -> DataFrame:
    """lines (zone, id, x, z) with box: of the boxes (box, zone, id, x, z) of the same id the one at the same place at one decimal, else the nearest within `reach`."""
    met = lines.join(boxes.select("box", "zone", "id", F.col("x").alias("bx"), F.col("z").alias("bz")), ["zone", "id"])
    one = lambda c: F.format_string("%.1f", c)
    exact = (one(F.col("x")) == one(F.col("bx"))) & (one(F.col("z")) == one(F.col("bz")))
    far = F.hypot(F.col("bx") - F.col("x"), F.col("bz") - F.col("z"))
    best = met.withColumn("w_exact", exact).withColumn("w_far", far).where(F.col("w_exact") | (F.col("w_far") < reach)).groupBy("zone", "id").agg(F.min_by("box", F.struct(~F.col("w_exact"), "w_far", "box")).alias("box"))
    return lines.join(best, ["zone", "id"], "left")


def floor_votes(corners: DataFrame) -> DataFrame:
    """zone, name, floor: the floor most corners of a region stand on, the one seen first on ties."""
    n = corners.where("floor is not null").groupBy("zone", "name", "floor").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
    return n.groupBy("zone", "name").agg(F.min_by("floor", F.struct(-F.col("n"), "at")).alias("floor"))


def on_floor(rows: DataFrame, floor: int) -> DataFrame:
    """Rows on a floor, and those whose floor isn't known."""
    return rows.where(F.coalesce(F.col("floor") == floor, F.lit(True)))


def island_ranks(sizes: DataFrame, least: int = 3) -> DataFrame:
    """zone, island, n, place and share of islands with at least so many cells, the largest first."""
    kept = ranked(sizes.where(F.col("n") >= least), "n", "island", True, ("zone",))
    return kept.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("zone")))


def map_id(bits: Column) -> Column:
    """The map number in a mesh entry's bits: five bits, two from bit 26 and three from bit 3."""
    return F.shiftleft(F.shiftright(bits, 26).bitwiseAND(3), 3).bitwiseOR(F.shiftright(bits, 3).bitwiseAND(7))


def deep_water(meta: Column) -> Column:
    """Whether a triangle is deep water: the low four bits of its meta are 9."""
    return meta.bitwiseAND(15) == 9


def mean_colours(samples: DataFrame, cell: float = 4.0) -> DataFrame:
    """zone, ix, iz, r, g, b: the mean ground colour of each cell."""
    at = samples.withColumns({"ix": F.floor(F.col("x") / cell).cast("int"), "iz": F.floor(F.col("z") / cell).cast("int")})
    return at.groupBy("zone", "ix", "iz").agg(*(F.avg(c).alias(c) for c in "rgb"))
