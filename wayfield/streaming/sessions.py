"""Segmentation of an event feed by gaps with Structured Streaming: session windows under a watermark.

The same function serves batch and stream; state is one open window a mob.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap: str = "6 hours", late: str | None = None) -> DataFrame:
    """mob_id, start, n and total of runs of events less than `gap` apart; late: how long a stream waits for late ones."""
    e = events.withWatermark("ts", late) if late else events
    out = e.groupBy(F.col("user_id").alias("mob_id"), F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select("mob_id", F.col("w.start").alias("start"), "n", "total")


def stream(spark: SparkSession, folder: str, schema, gap: str = "6 hours", late: str = "1 day", files: int = 1) -> DataFrame:
    """The sessions of a folder of Parquet files that come in over time, some files a trigger."""
    return sessions(spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder), gap, late)


def longer_wins(stored: DataFrame, batch: DataFrame, key: str = "mob_id", n: str = "n") -> DataFrame:
    """What a foreachBatch upsert keeps: of two trails with one key the longer, the stored one on ties."""
    both = stored.withColumn("w_new", F.lit(0)).unionByName(batch.withColumn("w_new", F.lit(1)))
    best = both.groupBy(key).agg(F.max_by(F.struct(*stored.columns), F.struct(F.col(n), -F.col("w_new"))).alias("r"))
    return best.select("r.*")
