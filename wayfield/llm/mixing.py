"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Each row gets an exponential key E / w, where E comes from a hash of the row (so reruns agree) and w
is the row's quality weight.  In each source, rows in key order are taken until the source's budget
of words is met; the sizes are prefix sums in that order.  A budget above the source's size first
takes the whole source (complete epochs), and only the rest is selected.

How it scales.  What a source takes in key order is a prefix, so a source's answer is one cut: its last key taken.  Keys fall into
buckets of equal width in log(key), of some 65,536 rows at most whatever the source's size (0.14 % of a small one); sums of buckets
are ordered within their source, and rows only within the one bucket that holds the cut.  Every row then meets its source's cut,
sources with 2**-12 of all rows or more by a broadcast, so no source, however large, is sorted or held by a task, and whole
documents pass no window and no sort.  Targets come from
repeated sums over the table of sources, which itself stays distributed.  Repeated rows are numbered, and a copy's number enters its key; numbers are given
within salted parts of a group and moved up by the sizes of the parts before, so no group of copies is one task.

Nulls and odd cases: a null text has size 0; null is a source of its own, last in order; sources of
size 0 have target 0; rows of size 0 are never taken; very long texts are taken whole or not at all; ties of keys go to the smaller doc_id, a
null one first; repeated rows (equal in source, doc_id and text) have keys of their own, by their number, so some of them may be taken once more than others; columns are named apart from docs', so no name can
clash; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, hot_join, stage, values

#: Share of these characters in a text lowers its quality weight.
JUNK = "#$%&*!|<>{}[]\\^~=+_@"


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: str = "text") -> Column:
    """From 0.1 to 1: less for texts with many symbols (a word or two in a hundred characters cost little)."""
    t = F.coalesce(F.col(text), F.lit(""))
    junk = F.length(t) - F.length(F.translate(t, JUNK, ""))
    return F.greatest(F.lit(0.1), 1.0 - 5.0 * junk / F.greatest(F.length(t), F.lit(1)))


def source_key() -> Column:
    """A source's key, which is never null."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))


def row_hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))


def exponential_key(weight: Column, seed: int, h: Column | None = None, copy: Column | None = None) -> Column:
    """The key of a row, or of one of its copies (the first has the row's own)."""
    h = row_hash(seed) if h is None else h
    h = h if copy is None else F.when(copy > 1, F.xxhash64(h, copy)).otherwise(h)
    bits = F.shiftrightunsigned(h, 11)  # 53 of them
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53))) / weight


def repeated(rows: DataFrame) -> DataFrame | None:
    """m_sk, m_h and w_size of the rows that occur more than once; None if there are none."""
    groups = stage(rows.groupBy("m_sk", "m_h").agg(F.count(F.lit(1)).alias("w_size")).where("w_size > 1"))
    return groups if groups.limit(1).count() else None


def numbered(rows: DataFrame, groups: DataFrame | None, n: int) -> DataFrame:
    """rows (m_sk, m_h and others) with m_copy: equal rows are numbered from 1, in any order."""
    if groups is None:
        return rows.withColumn("m_copy", F.lit(1).cast("long"))
    met = hot_join(rows, groups.withColumn("m_many", F.col("w_size")), ["m_sk", "m_h"], "w_size", n, "left")
    alone = met.where("m_many is null").drop("m_many").withColumn("m_copy", F.lit(1).cast("long"))
    uid = F.monotonically_increasing_id()
    many = stage(met.where("m_many is not null").drop("m_many").withColumn("m_uid", uid).withColumn("m_salt", F.pmod(F.xxhash64("m_uid"), F.lit(max(256, n >> 16)))))
    part = ["m_sk", "m_h", "m_salt"]
    sizes = many.groupBy(*part).agg(F.count(F.lit(1)).alias("m_part"))
    before = F.sum("m_part").over(Window.partitionBy("m_sk", "m_h").orderBy("m_salt")) - F.col("m_part")
    placed = many.withColumn("m_place", F.row_number().over(Window.partitionBy(*part).orderBy("m_uid"))).join(sizes.withColumn("m_before", before).drop("m_part"), part)
    return alone.unionByName(placed.withColumn("m_copy", F.col("m_before") + F.col("m_place")).select(*rows.columns, "m_copy"))


def bucket(key: Column, scale: float) -> Column:
    """e**-1 / scale of a source's rows at most, as keys are exponential."""
    return F.floor(F.log(key) * scale).cast("long")


def targets(buckets: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """source key, size and target of each source: `share` of all sizes dealt by weight, none above `most` of its size."""
    spark = buckets.sparkSession
    order = [F.col("m_sk") == "n", F.col("m_sk")]
    sources = stage(
        buckets.groupBy("m_sk").agg(F.sum("m_sum").cast("long").alias("source_size")).repartitionByRange(*order).withColumn("pid", F.spark_partition_id())
    )
    counts = sorted((r.pid, r["count"]) for r in sources.groupBy("pid").count().collect())  # one row a partition
    offsets = [(p, at) for (p, _), at in zip(counts, accumulate([0, *(n for _, n in counts)]), strict=False)]
    rank = F.col("at") + F.row_number().over(Window.partitionBy("pid").orderBy(*order)) - 1
    dealt = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    sources = stage(sources.join(F.broadcast(values(spark, "pid int, at bigint", offsets)), "pid").select("m_sk", "source_size", dealt.alias("w"), (F.col("source_size") * most).alias("cap")))
    budget = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:  # a source once at its cap stays there, so this ends after as many rounds as sources at most, in practice a few
        c, full, n, w = sources.agg(
            F.sum(F.when(F.col("cap") <= level * F.col("w"), F.col("cap")).otherwise(0.0)),
            F.count_if(F.col("cap") <= level * F.col("w")),
            F.count(F.lit(1)),
            F.sum(F.when(F.col("cap") <= level * F.col("w"), 0.0).otherwise(F.col("w"))),
        ).first()
        if full == capped or not n or full == n:
            break
        level, capped = (budget - c) / w, full
    return sources.select("m_sk", "source_size", F.least("cap", F.lit(level) * F.col("w")).alias("target"))


def cuts(rows: DataFrame, n: int, weights: tuple[int, ...], share: float, most: float, bucket_rows: int) -> tuple[DataFrame, float]:
    """For each source key its size, target, complete epochs, and the place up to which it takes rows (bucket, then key and doc_id); and the buckets' scale.

    rows: n rows of m_sk, m_size, m_key, m_doc.
    """
    scale = max(256.0, n * 0.37 / bucket_rows)
    placed = rows.withColumn("m_bucket", bucket(F.col("m_key"), scale))
    buckets = stage(placed.groupBy("m_sk", "m_bucket").agg(F.sum("m_size").alias("m_sum"), F.count(F.lit(1)).alias("m_n")))
    sources = targets(buckets, weights, share, most).join(buckets.groupBy("m_sk").agg(F.sum("m_n").alias("w_size")), "m_sk")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = stage(sources.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))
    before = F.sum("m_sum").over(Window.partitionBy("m_sk").orderBy("m_bucket")) - F.col("m_sum")
    edge = buckets.withColumn("before", before).join(sources.select("m_sk", "rest"), "m_sk").where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("m_sum")))
    edge = stage(edge.select("m_sk", "m_bucket", "before", "rest", F.col("m_n").alias("w_size")))  # one bucket of each source
    inside = hot_join(placed, edge, ["m_sk", "m_bucket"], "w_size", n)
    order = Window.partitionBy("m_sk", "m_bucket").orderBy("m_key", "m_doc")
    middle = F.col("before") + F.sum("m_size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("m_size") / 2
    last = inside.withColumn("middle", middle).where("middle <= rest").groupBy("m_sk").agg(F.max(F.struct("m_key", "m_doc")).alias("last"))
    return stage(sources.drop("rest").join(edge.select("m_sk", F.col("m_bucket").alias("edge")), "m_sk", "left").join(last, "m_sk", "left")), scale


def times_taken(size: Column, key: Column, doc: Column, cut: str, scale: float) -> Column:
    """How often a row is taken, from its source's cut."""
    place, last = bucket(key, scale), f"{cut}.last"
    within = (key < F.col(f"{last}.m_key")) | ((key == F.col(f"{last}.m_key")) & (doc <= F.col(f"{last}.m_doc")))
    more = (place < F.col(f"{cut}.edge")) | ((place == F.col(f"{cut}.edge")) & F.coalesce(within, F.lit(False)))
    return F.when(size > 0, F.col(f"{cut}.epochs") + F.when(F.coalesce(more, F.lit(False)), 1).otherwise(0)).otherwise(0).cast("int")


def mix(
    docs: DataFrame,
    keep: list[str],
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 17,
    size: Column | None = None,
    weight: Column | None = None,
    bucket_rows: int = 1 << 16,
    rows_of_mix: bool = False,
) -> DataFrame:
    """keep's columns of docs, with m_size, m_source_size, m_target and m_taken: the words the mix takes of a row.

    rows_of_mix: the mix itself instead, keep's columns of each row as often as it is taken.
    """
    size, weight = n_words() if size is None else size, quality_weight() if weight is None else weight
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    kept = [] if rows_of_mix else [F.col(c).alias(f"k_{c}") for c in keep]
    narrow = stage(docs.select(source_key().alias("m_sk"), size.alias("m_size"), weight.alias("m_weight"), row_hash(seed).alias("m_h"), doc.alias("m_doc"), *kept))
    n = narrow.count()
    groups = repeated(narrow)
    narrow = numbered(narrow, groups, n).withColumn("m_key", exponential_key(F.col("m_weight"), seed, F.col("m_h"), F.col("m_copy")))
    narrow = stage(narrow) if groups is not None else narrow
    found, scale = cuts(narrow.select("m_sk", "m_size", "m_key", "m_doc"), n, weights, share, most, bucket_rows)
    if rows_of_mix:
        names = {c: fresh(docs, c) for c in ("m_sk", "m_h", "m_size", "m_weight", "m_doc")}
        whole = docs.withColumns({names["m_sk"]: source_key(), names["m_h"]: row_hash(seed), names["m_size"]: size, names["m_weight"]: weight, names["m_doc"]: doc})
        packed = whole.select(*(F.col(v).alias(k) for k, v in names.items()), F.struct(*keep).alias("m_row"))
        one = found.select("m_sk", F.struct("epochs", "edge", "last").alias("m_cut"), "w_size")
        met = hot_join(numbered(packed, groups, n), one, ["m_sk"], "w_size", n)
        key = exponential_key(F.col("m_weight"), seed, F.col("m_h"), F.col("m_copy"))
        times = times_taken(F.col("m_size"), key, F.col("m_doc"), "m_cut", scale)
        return met.withColumn("m_copy", F.explode(F.array_repeat(F.lit(1), times))).select(*(F.col("m_row")[c].alias(c) for c in keep))
    met = hot_join(narrow, found.select("m_sk", F.struct("epochs", "edge", "last", "source_size", "target").alias("m_cut"), "w_size"), ["m_sk"], "w_size", n)
    times = times_taken(F.col("m_size"), F.col("m_key"), F.col("m_doc"), "m_cut", scale)
    return met.select(*(F.col(f"k_{c}").alias(c) for c in keep), "m_size", F.col("m_cut.source_size").alias("m_source_size"), F.col("m_cut.target").alias("m_target"), (F.col("m_size") * times).cast("long").alias("m_taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: docs' rows, each as often as it is taken."""
    return mix(docs, docs.columns, rows_of_mix=True, **options)
