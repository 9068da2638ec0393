"""Small helpers that several training-data operators share."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid
from collections.abc import Callable
from itertools import accumulate
from typing import Any

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run of characters other than space and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset (tests, one machine) a folder that lasts as long as this process is made
    and set, so that ``checkpoint()`` uses it too.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def text_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """Has Spark hand texts to Python `rows` at a time, and about `size` bytes, at most, which bounds what a task holds.

    Spark reads these settings when a plan runs, so they stay set; a session that sets either itself keeps its own.
    """
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        name = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, str(most))


def stage(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again.

    That cuts the lineage: what was written survives lost executors, and passes that follow
    don't repeat what made it.  rows: about how many narrow rows it has, if known; it is written in files of some 250,000.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(rows // 250_000 + 1)
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hot_join(rows: DataFrame, one: DataFrame, keys: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with `one`, which has one row for each key and, in column `size`, how many of the `total` rows have it.

    Keys with 2**-12 of all rows or more, 4096 of them at most, meet their rows by a broadcast, so no task of the shuffle holds a hot key.
    """
    if total < 4096:
        return rows.join(one.drop(size), keys, how)
    least = total * 2.0**-12
    hot, cold = one.where(F.col(size) >= least).drop(size), one.where(F.col(size) < least).drop(size)
    if how == "left_semi":
        return rows.join(F.broadcast(hot), keys, how).unionByName(rows.join(F.broadcast(hot), keys, "left_anti").join(cold, keys, how))
    met = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how)
    return met.unionByName(rest)


def kept(shared: Broadcast, make: Callable[[Any], Any]) -> Any:
    """What is made of a broadcast value, once for each Python worker; it goes when the worker drops the broadcast."""
    if not hasattr(shared, "w_made"):
        shared.w_made = make(shared.value)
    return shared.w_made


def held_out(doc_id: str | Column, mod: int) -> Column:
    """Whether crc32 of doc_id as text leaves the remainder 2; a null doc_id is in the training part."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % mod == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, sample: int, most_bytes: int, value: Callable[[Column], Column] | None = None) -> tuple[list[Row], float]:
    """x (the text, or value of it) and y of up to `sample` labelled texts of each class outside the held-out part, the first by a hash of the doc_id.

    Of these, texts beyond the first `most_bytes` of a class are left out (one at least stays).  Labels of documents that docs lacks don't count.
    Also what the logarithm of the odds in this sample lacks to that of all such labels.
    """
    learn = labels.select("doc_id", F.col(label).alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id", mod)).dropDuplicates()
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    known = stage(texts.select("doc_id", "h", F.octet_length("text").cast("long").alias("size")).distinct().join(learn, "doc_id"))
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("h")]
    total = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    chosen, found = [], {}
    for y in (0, 1):
        rows = known.where(F.col("y") == y).orderBy(*order).limit(sample).collect()  # four numbers each
        upto = list(accumulate(r.size for r in rows))
        rows = [r for r, n in zip(rows, upto, strict=True) if n <= most_bytes] or rows[:1]
        chosen += rows
        found[y] = len(rows)
    if not chosen:
        return [], 0.0
    shift = math.log(total[1] * found[0] / total[0] / found[1]) if len(total) == 2 else 0.0
    few = values(docs.sparkSession, "doc_id bigint, h bigint, y int", [(r.doc_id, r.h, r.y) for r in chosen])
    one = texts.join(F.broadcast(few), ["doc_id", "h"]).dropDuplicates(["doc_id", "h", "y"])  # 2 * sample rows of numbers
    rows = one.select(*(c.alias(f"o{i}") for i, c in enumerate(order)), "y", (F.col("text") if value is None else value(F.col("text"))).alias("x")).collect()
    return sorted(rows, key=lambda r: (r.o0, r.o1, r.o2, r.y)), shift


def fresh(df: DataFrame, name: str) -> str:
    """The name, or with as many underscores behind it as it takes to clash with no column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def values(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A few rows that the driver holds, as a relation of literals (numbers only)."""
    names = [x.strip().split(" ") for x in schema.split(",")]
    if not rows:
        return spark.sql("SELECT " + ", ".join(f"CAST(NULL AS {k}) AS {n}" for n, k in names) + " WHERE false")
    body = ", ".join("(" + ", ".join(str(x) for x in r) + ")" for r in rows)
    cast = ", ".join(f"CAST({n} AS {k}) AS {n}" for n, k in names)
    return spark.sql(f"SELECT {cast} FROM VALUES {body} AS t({', '.join(n for n, _ in names)})")


def finite_vectors(vectors: DataFrame, column: str, most: float, *keep: str) -> DataFrame:
    """keep's columns and v (doubles) of the rows whose vector is there and holds neither nulls nor non-finite components.

    Vectors of another length than most (the shorter on ties) and empty ones are left out, and a component beyond `most` stops the query, as it fits no exact integer.
    """
    v = F.col(column).cast("array<double>")
    rows = vectors.select(*keep, v.alias("v")).where((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    wide = F.exists("v", lambda x: F.abs(x) > most)
    fits = F.when(wide, F.raise_error(F.lit(f"a component is beyond {most}")).cast("array<double>")).otherwise(F.col("v"))
    return rows.where(F.size("v") == (size.n if size else 0)).withColumn("v", fits)
