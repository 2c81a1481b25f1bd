"""Work on texts is dealt to all cores, and a text expression is worked out once."""

from pyspark.sql import functions as F

from gaugework.functions import text as T
from gaugework.operators import chunking as C
from gaugework.operators.groups import settled
from gaugework.queries.views import frame
from gaugework.session import spread

FOLDER = "/root/testdata/sf0.001"


def test_blocks_of_one_split_are_dealt_to_all_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    assert spark.read.parquet(f"{FOLDER}/lineitem.parquet").rdd.getNumPartitions() < cores
    blocks = frame(spark, FOLDER, "blocks")
    assert blocks.rdd.getNumPartitions() >= cores
    assert blocks.count() == spark.read.parquet(f"{FOLDER}/lineitem.parquet").count()


def test_table_of_many_splits_stays(spark):
    cores = spark.sparkContext.defaultParallelism
    many = spark.range(0, 100, 1, 2 * cores).toDF("x")
    assert spread(many).rdd.getNumPartitions() == 2 * cores
    assert sorted(r.x for r in spread(many.coalesce(1)).collect()) == list(range(100))


def test_text_expression_is_worked_out_once(spark):
    blocks = spark.range(3).select(
        F.col("id").alias("doc_id"), F.lit("text").alias("chunk_type"), F.lit(1.0).alias("block_top"), F.lit(800.0).alias("page_height"),
        F.repeat(F.format_string("total energy %d GJ in the year. ", "id"), 3).alias("content"),
    )
    plan = C.classify_blocks(blocks)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("format_string") == 1


def test_settled_keeps_rows_columns_and_nulls(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, 3), (3, None, None)], "id int, t string, n int")
    out = settled(df, "t", "n")
    assert out.columns == df.columns
    assert sorted(map(repr, out.collect())) == sorted(map(repr, df.collect()))


def test_whether_a_text_looks_like_a_table_is_worked_out_once(spark):
    blocks = spark.range(3).select(
        F.col("id").alias("doc_id"), F.lit(1).alias("page_number"), F.lit(0).alias("block_key"), F.lit("text").alias("chunk_type"),
        F.format_string("total energy %d GJ in the year", "id").alias("content"),
    )
    plan = C.split_blocks(blocks, ["block_key"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(T.R.ADJACENT_NUMBERS) == 1


def test_texts_around_the_length_that_needs_no_count(spark):
    texts = ["a " * 374 + "a", "a " * 375 + "a", "a. B " * 400, "x" * 2000]
    blocks = spark.createDataFrame([(i, 1, 0, "text", t) for i, t in enumerate(texts)], "doc_id long, page_number int, block_key int, chunk_type string, content string")
    assert len(texts[0]) == C.SURELY_SHORT
    got = {r["doc_id"]: r["n"] for r in C.split_blocks(blocks, ["block_key"]).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    want = [len(r[0]) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(
        F.when(T.token_estimate(F.col("t")) <= 500, F.array("t")).otherwise(T.segments(F.col("t")))).collect()]
    assert [got[i] for i in range(len(texts))] == want
