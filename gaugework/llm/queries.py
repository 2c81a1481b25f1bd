"""Registered queries of the pipeline operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.llm import (
    jaccard_join, licence_scan, mixing, passage_quality, periodic, quality_rules, secret_scan, sentencepiece_scan, spelling,
    suffix_dedup, topk_search, toxicity, warc,
)
from gaugework.llm.labelled import held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op10_quality_rules")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    trees = quality_rules.train(docs, labels)
    return quality_rules.judge(docs.select("doc_id", "text"), trees).drop("text")


@query("op8_ngram_jaccard_join")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.link(table(spark, folder, "documents"))


@query("op3_suffix_array_dedup")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))


@query("op1_mixing")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.copies(table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies"
    )


TOPK_SQL = """
WITH usable AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)]) AS BIGINT) AS score
  FROM (SELECT * FROM usable WHERE vec_id % 100 = 0) q JOIN usable c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 10
"""


@query("op4_exact_topk_search", TOPK_SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    vectors = topk_search.whole_vectors(table(spark, folder, "embeddings"))
    return topk_search.top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


WARC_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages
), q AS (
  SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
    array_to_string([
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
             CAST((CAST('0x' || substr(hex, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER) + 1, 1)
      FOR i IN range(0, 32)], '') AS payload_digest,
    min(page_id) OVER (PARTITION BY body) AS first
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM q
"""


@query("op2_warc", WARC_SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    archives, index = warc.write(table(spark, folder, "pages"))
    return warc.read(archives, index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op9_sentencepiece")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    back = sentencepiece_scan.decode(sentencepiece_scan.encode(docs))
    blanks = F.replace(F.coalesce("text", F.lit("")), F.lit(sentencepiece_scan.MARK), F.lit(" "))
    return back.select("doc_id", "n_tokens", (F.col("decoded") == blanks).alias("round_trip"), "ids")


@query("op5_toxicity")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    network = toxicity.train(docs, labels)
    marked = docs.select("doc_id", "lang", "text", held_out(toxicity.MODULUS, toxicity.REST).alias("held_out"))
    return toxicity.score(marked, network).select("doc_id", "held_out", "score", "predicted", "toxic")


@query("op7_quality_classifier")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = passage_quality.train(docs, labels)
    marked = docs.select("doc_id", "text", held_out(passage_quality.MODULUS, passage_quality.REST).alias("held_out"))
    return passage_quality.score(marked, model).select("doc_id", "held_out", "score", "predicted", "passage")


@query("op6_licence_scan", licence_scan.scan_sql())
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return licence_scan.scan(table(spark, folder, "documents"))


@query("op12_spelling_variants", spelling.variants_sql())
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))


@query("op13_periodic_runs", periodic.periodic_runs_sql())
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return periodic.periodic_runs(table(spark, folder, "documents"), planted=True)


@query("op11_secret_scan", secret_scan.scan_sql())
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.scan(table(spark, folder, "documents"))
