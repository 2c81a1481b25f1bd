"""Blocks of a document are brought together once; nothing of them is moved or stored after that."""

import random

import pytest
from pyspark.sql import functions as F

from gaugework.operators import chunking as C
from gaugework.operators import groups as G
from gaugework.queries import all_queries
from gaugework.queries.views import frame

FOLDER = "/root/testdata/sf0.001"
BLOCKS = "doc_id long, page_number int, chunk_type string, content string, block_key long"


def moves(df):
    """Shuffles of the plan, and the stored tables that it reads."""
    plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
    return [line for line in plan if "Exchange" in line], [f for f in df.inputFiles() if "/gaugework-tables/" in f]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def blocks(spark):
    rng = random.Random(6)
    long = " ".join(f"Sentence number {i} tells of energy and of water in the year." for i in range(120))
    texts = ["Total scope 1 emissions", "1,234   5,678   tonnes", "Water consumption", "a | b | 3", "zzz", long, "12,345 KL in all", " "]
    made = [
        (rng.choice([1, 2, 3, 4, 5, None]), rng.choice([None, 1, 2]), rng.choice(["text", "table", "footnote"]), rng.choice(texts), i // 2)
        for i in range(400)
    ]
    return spark.createDataFrame(made, BLOCKS)


def test_long_documents_are_chunked_as_short_ones(blocks, monkeypatch):
    whole = blocks.filter("page_number = 1").withColumn("block_key", F.monotonically_increasing_id())  # no ties
    for make in (C.chunk_documents, C.index_chunks):
        short = rows(make(whole, ["block_key"], None))
        sizes = sorted(r["count"] for r in whole.groupBy("doc_id").count().collect())
        for most in (0, sizes[2]):
            monkeypatch.setattr(C, "MOST_TOGETHER", most)
            assert rows(make(whole, ["block_key"])) == short != []


def test_blocks_that_tie_are_numbered_the_same_each_time(blocks):
    want = rows(C.chunk_documents(blocks, ["block_key"], None))
    assert rows(C.chunk_documents(blocks.repartition(7, "content"), ["block_key"], None)) == want


def test_long_groups(spark):
    df = spark.createDataFrame([(i % 50,) for i in range(500)] + [(7,)] * 30 + [(None,)] * 90, "doc_id long")
    assert G.long_groups(df, "doc_id", 90) is None
    assert [r["doc_id"] for r in G.long_groups(df, "doc_id", 39).collect()] == [7]


@pytest.mark.parametrize("name", ["merge_label_value", "chunk_index", "chunk_counts", "relevance_gate", "score_breakdown"])
def test_chunks_move_once_and_before_their_texts_are_made(spark, name):
    dealt, stored = moves(all_queries()[name](spark, FOLDER))
    assert len(dealt) == 1 and "l_orderkey" in dealt[0] and not stored


def test_given_tables_are_dealt_by_document(spark):
    blocks = frame(spark, FOLDER, "blocks", by_document=True)
    at = blocks.select("doc_id", F.spark_partition_id().alias("at")).distinct()
    assert at.count() == blocks.select("doc_id").distinct().count()
    assert sorted(blocks.collect()) == sorted(frame(spark, FOLDER, "blocks").collect())


def test_batches_end_where_documents_end():
    import pyarrow as pa

    from gaugework.functions.ranking import whole_documents

    sizes = [3, 1, 5, 2, 1, 7]
    doc = [d for d, n in enumerate(sizes) for _ in range(n)]
    table = pa.table({"doc_id": doc, "_rows": [sizes[d] for d in doc], "at": list(range(len(doc)))})
    for step in (1, 2, 3, 4, 6, 50):
        made = list(whole_documents(table.to_batches(max_chunksize=step)))
        assert [x for b in made for x in b.column("at").to_pylist()] == list(range(len(doc)))
        for b in made:
            assert all(b.column("doc_id").to_pylist().count(d) == sizes[d] for d in b.column("doc_id").to_pylist())
    with pytest.raises(ValueError):
        list(whole_documents(table.slice(0, 2).to_batches()))


def test_rounding_is_that_of_spark(spark):
    import numpy as np

    from gaugework.functions.ranking import rounded

    rng = random.Random(2)
    xs = [0.0, 1.0000005, 1.0000015, 2.5e-6, 0.1234565, 7.1234575, *[rng.uniform(0, 30) for _ in range(200)], *[rng.randrange(10**8) / 1e7 for _ in range(300)]]
    want = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").orderBy("i").select(F.bround("x", 6).alias("r")).collect()
    assert (rounded(np.array(xs)) / 1e6).tolist() == [r["r"] for r in want]


@pytest.mark.parametrize("name", ["keyword_retrieval", "wider_chunks", "block_patterns", "context_packing", "second_pass", "retrieval_funnel", "adhoc_search", "adhoc_search_tables"])
def test_documents_are_ranked_where_their_chunks_lie(spark, name):
    dealt, stored = moves(all_queries()[name](spark, FOLDER))
    assert len(dealt) == 1 and "l_orderkey" in dealt[0] and not stored


def test_long_documents_have_the_contexts_of_short_ones(spark, monkeypatch):
    from gaugework.operators import extraction as X
    from gaugework.operators import retrieval as V
    from gaugework.plans import jobs as J
    from gaugework.queries import text as Q

    chunks = Q.chunks(spark, FOLDER, None).filter("doc_id < 60").union(  # one without a page
        Q.chunks(spark, FOLDER, None).filter("doc_id = 1").withColumn("doc_id", F.lit(-1).cast("long")).withColumn("page_number", F.lit(None).cast("int"))
    ).localCheckpoint()
    found = V.retrieve(chunks, long=None)
    ways = {
        "wider": (lambda: V.retrieve_wider(chunks).drop("chunk_type"), lambda: V.wider(chunks, found).drop("chunk_type")),
        "contexts": (lambda: J.contexts(chunks), lambda: X.context_blocks(V.attach_text(found, chunks))),
        "open": (lambda: J.open_contexts(chunks), lambda: J.second_pass(chunks, found, J.pattern_values(chunks, found))),
    }
    for most in (10**6, 36):
        monkeypatch.setattr(V, "MOST_TOGETHER", most)
        for name, (new, plain) in ways.items():
            made, want = new(), plain()
            assert rows(made.select(*want.columns)) == rows(want) != [], name


def test_long_documents_are_searched_and_counted_as_short_ones(spark, monkeypatch):
    from gaugework.operators import retrieval as V
    from gaugework.queries import text as Q
    from gaugework.queries.retrieval import SEARCH_WORDS

    chunks = Q.chunks(spark, FOLDER, None).filter("doc_id < 60").localCheckpoint()
    ways = (lambda: V.search(chunks, SEARCH_WORDS), lambda: V.funnel(chunks).select(
        "doc_id", "kpi", "candidates", "passed", "dropped", "scored", "final", "answerable", "lowest", "highest"
    ))
    for make in ways:
        made = []
        for most in (10**6, 24, 0):
            monkeypatch.setattr(V, "MOST_TOGETHER", most)
            made.append(rows(make()))
        assert made[0] == made[1] == made[2] != []


def test_cache_writes_move_no_texts_and_leave_nothing_aside(spark, tmp_path):
    from gaugework.sources import store

    schema = "doc_id long, content string"
    rows_ = spark.createDataFrame([(i % 40, str(i)) for i in range(400)], schema).repartition(3)
    root = f"file://{tmp_path}/cache"
    for new in (rows_, rows_.filter("doc_id < 5")):
        store.replace_in_cache(new, root, "v1", schema, buckets=2)
    assert sorted(tuple(r) for r in store.read_cache(spark, root, "v1", schema).select("doc_id", "content").collect()) == sorted(map(tuple, rows_.collect()))
    # a file for each task and bucket: rows were not brought together by bucket
    store.replace_in_cache(rows_, f"{root}-2", "v1", schema, buckets=2)
    assert len(store.read_cache(spark, f"{root}-2", "v1", schema).inputFiles()) == 6
    aside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store.new_folder(spark, 'x')}").getParent()
    files = aside.getFileSystem(spark._jsc.hadoopConfiguration())
    assert not files.exists(aside) or not [f for f in files.listStatus(aside) if "aside" in f.getPath().getName()]
