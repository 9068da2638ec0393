"""The numbered queries and, where SQL can express them, their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import additive_ann, ctw, mixing, ogg_media, part_codes, quality, sentencepiece_fst, set_join, sharding, token_files, toxicity, url_filter, whitening
from .common import documents, shared_dir


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_fst.round_trip(documents(spark, sf_dir))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir)).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg_media.stored_texts(documents(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score_held_out(documents(spark, sf_dir))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive_ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(documents(spark, sf_dir), ["doc_id", "source"])
    return out.select("doc_id", F.col("m_size").alias("size"), F.col("m_source_size").alias("source_size"), F.col("m_target").alias("target"), F.col("m_taken").alias("taken"), "source")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.join(documents(spark, sf_dir)).drop("root", "digest")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token_files/{uuid.uuid4().hex}"
    token_files.write(documents(spark, sf_dir), path)
    return token_files.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_codes.encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def _part_codes_sql(scale: int = 4096, parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The codes by plain distances to every entry, a common table for each round."""
    near = "(SELECT vec_id, p.part, q, min({'d': d, 'entry': entry}) AS b FROM (SELECT p.*, entry, list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p JOIN c%d USING (part)) p GROUP BY ALL)"
    steps = [
        f"v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda e: floor({scale} * e::DOUBLE)::BIGINT) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)",
        f"p AS MATERIALIZED (SELECT vec_id, t.part, x[t.part * (len(x) // {parts}) + 1 : (t.part + 1) * (len(x) // {parts})] AS q FROM v, (SELECT unnest(range({parts})) AS part) t)",
        f"c0 AS MATERIALIZED (SELECT part, entry, q AS c FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry FROM p) WHERE entry < {entries})",
    ]
    for k in range(rounds):
        steps.append(f"a{k} AS MATERIALIZED {near % k}")
        steps.append(f"u{k} AS (SELECT part, b.entry AS entry, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT part, b, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM a{k}) GROUP BY ALL)")
        steps.append(f"m{k} AS (SELECT part, entry, list((s - (s % n + n) % n) // n ORDER BY i) AS m FROM u{k} GROUP BY ALL)")
        steps.append(f"c{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m, c) AS c FROM c{k} LEFT JOIN m{k} USING (part, entry))")
    steps.append(f"f AS MATERIALIZED {near % rounds}")
    steps.append("r AS (SELECT vec_id, string_agg(printf('%02x', b.entry), '' ORDER BY part) AS code, sum(b.d)::BIGINT AS error FROM f GROUP BY vec_id)")
    steps.append(f"h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds})")
    return "WITH " + ", ".join(steps) + " SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM r JOIN v USING (vec_id), h"


def oracle_sql() -> dict[str, str]:
    return {"op12_vector_codes": _part_codes_sql()}
