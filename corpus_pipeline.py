"""From raw documents to a tokenised training mix: the stages in order, each on what the last one kept.

A stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read again
as the next one's documents.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.llm import jaccard_join, mixing, quality_rules, sentencepiece_scan, suffix_dedup
from gaugework.llm.staging import keep

#: A passage of some fifty words; a string of so many bytes that starts twice goes.
PASSAGE_BYTES = 200
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the trees reject go."""
    trees = quality_rules.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.judge(docs, trees).filter("kept").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays."""
    return jaccard_join.one_of_each(docs).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of PASSAGE_BYTES that start twice in what is left go; so do documents left without text."""
    cut = suffix_dedup.remove_repeats(docs, text_out=True, length=PASSAGE_BYTES)
    cut = cut.filter((F.col("n_removed") == 0) | (F.length("text") > 0))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs).select(*COLUMNS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix."""
    return sentencepiece_scan.encode(docs).select("doc_id", "lang", "source", "n_tokens", "ids")


STAGES = [
    ("quality rules", drop_low_quality),
    ("near duplicates", drop_near_copies),
    ("repeated strings", cut_repeats),
    ("source mix", mix_sources),
    ("tokens", tokenise),
]
#: Trees, Newton steps and best segmentations have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
