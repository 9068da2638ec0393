"""Cleaning a corpus: the stages, in order, and their run.

Every stage works on all rows that its predecessor kept and returns the columns of its input (the last one adds ids), whatever their names.  Nulls
and odd cases, for all stages: a null text counts as empty, an empty text is scored like any other; very long texts are read whole; a null doc_id is kept;
repeated rows are judged each on their own, but for the third stage, which keeps one of them; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfield.llm import common, mixing, quality, sentencepiece_fst, set_join, toxicity

TOXIC, GOOD = 0.3, 0.7  # scores from which a text is rejected as toxic, and kept as good


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents scored as toxic go; texts without words, which say nothing toxic, stay if their score is low."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = common.fresh(docs, "score")
    return toxicity.with_score(docs, labels, score).where(F.col(score) < TOXIC).select(*docs.columns)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents of poor quality go.  It learns from the labels of documents that are still there."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = common.fresh(docs, "score")
    return quality.with_score(docs, labels, score).where(F.col(score) >= GOOD).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of each group that links join, the document with the smallest doc_id stays; documents without words are in no group and stay."""
    return set_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents as often as the mix takes them (twice at most); documents without words count nothing and are not taken."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: the ids of each text besides (none for empty texts); a column ids of the input is replaced."""
    return sentencepiece_fst.encode(docs, "ids")


STAGES = [("toxicity", drop_toxic), ("quality classifier", keep_good), ("n-gram Jaccard join", one_of_each_group), ("mixing sources", mix_sources), ("SentencePiece", encode)]
#: SQL can't express the first stage; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = common.stage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
