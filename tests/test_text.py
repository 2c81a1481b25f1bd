from pyspark.sql import functions as F

from gaugework.functions import text as T
from gaugework.operators import chunking as C


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_clean_text(spark):
    assert one(spark, " a\x00b  c\n\n\n\nd ", T.clean_text) == "ab c\n\nd"


def test_keywords_keep_short_terms_and_mark_numbers(spark):
    assert one(spark, "The GHG of 12 kl, and we", T.keywords) == ["ghg", "has_numbers", "kl"]
    assert one(spark, "nothing here", T.keywords) == ["here", "nothing"]


def test_table_rules(spark):
    assert one(spark, "a | b | c and more", T.looks_like_table)
    assert one(spark, "value 1 2 3 4 here", T.looks_like_table)
    assert not one(spark, "1 | 2 | 3", T.looks_like_table)
    assert not one(spark, "plain words without any figures at all", T.looks_like_table)


def test_segments_respect_the_budget_and_overlap(spark):
    sentences = [f"S{i} " + "word " * 98 + "end." for i in range(12)]
    runs = one(spark, " ".join(sentences), T.segments)
    assert len(runs) > 1
    for run in runs:
        assert len(run.split()) <= 375
    # Each run begins with the last sentence of the one before.
    for before, after in zip(runs, runs[1:]):
        assert after.split()[0] in before.split()


def test_segments_match_a_plain_loop(spark):
    words = [30, 120, 80, 200, 10, 360, 500, 20, 90, 90, 90, 90]
    sentences = [f"A{i} " + "w " * (n - 2) + "e." for i, n in enumerate(words)]
    out, current, total = [], [], 0
    for s in sentences:
        n = len(s.split())
        if total + n > 375 and total >= 150:
            out.append(" ".join(current))
            current = current[-1:]
            total = len(current[0].split())
        current.append(s)
        total += n
    out.append(" ".join(current))
    assert one(spark, " ".join(sentences), T.segments) == [o.strip() for o in out]


def test_numbers_and_names(spark):
    assert one(spark, "1,80,737", T.parse_number) == 180737.0
    assert one(spark, "n/a", T.parse_number) is None
    row = spark.sql("SELECT 2025 y, 'BRSR' t, 'L&T Finance Holdings' c, 'a3f19c2b-11' i")
    name = row.select(T.file_name(*[F.col(c) for c in "ytci"]).alias("n")).first()["n"]
    assert name == "2025_BRSR_l_t_finance_holdings_a3f19c2b.pdf"


def test_table_cells(spark):
    cells = spark.createDataFrame([([["a ", None], ["b\nc", "d"]],)], "cells array<array<string>>")
    row = cells.select(T.table_text(F.col("cells")).alias("t"), T.filled_cells(F.col("cells")).alias("n")).first()
    assert (row["t"], row["n"]) == ("a | \nb c | d", 3)


BLOCKS = "doc_id long, page_number int, chunk_type string, content string, block_key int"


def test_chunk_index_is_dense_in_page_order(spark):
    rows = [(1, p, "table" if k == 1 else "text", f"page {p} block {k} without figures beyond", k) for p in range(1, 40) for k in range(3)]
    rows += [(2, None, "text", "a block on no page at all", 0)]
    found = C.index_chunks(spark.createDataFrame(rows, BLOCKS), ["block_key"]).collect()
    first = sorted((r for r in found if r["doc_id"] == 1), key=lambda r: r["chunk_index"])
    assert [r["chunk_index"] for r in first] == list(range(117))
    assert [r["page_number"] for r in first] == [p for p in range(1, 40) for _ in range(3)]
    assert all(r["chunk_type"] == "table" for r in first[::3])
    assert [r["page_number"] for r in found if r["doc_id"] == 2] == [None]


def test_label_takes_its_value_even_across_runs(spark):
    rows = []
    for i in range(600):
        text = "plain filler text"
        if i in (10, 255, 511):
            text = "Total Scope 1 emissions (Metric tonnes CO2e)"
        if i in (11, 256, 512):
            text = "21,949   20,972"
        rows.append((1, i, "text", 1, text, 5, ["x"]))
    chunks = spark.createDataFrame(
        rows, "doc_id long, chunk_index long, chunk_type string, page_number int, content string, token_count int, keywords array<string>"
    )
    merged = {r["chunk_index"]: r for r in C.merge_labels(chunks).collect()}
    assert len(merged) == 597
    for i in (10, 255, 511):
        assert merged[i]["content"].endswith("CO2e)\n21,949   20,972")
        assert merged[i]["merged_from"] == i + 1
        assert i + 1 not in merged


def test_one_page_document_of_a_million_blocks(spark):
    n = 1_000_000
    order = (F.col("id") * 7919) % n
    blocks = spark.range(n, numPartitions=8).select(
        F.lit(1).cast("long").alias("doc_id"), F.lit(None).cast("int").alias("page_number"), F.lit("text").alias("chunk_type"),
        F.concat(F.lit("block "), order.cast("string")).alias("content"), order.alias("block_key"),
    )
    found = C.index_chunks(blocks, ["block_key"])
    right = F.count_if(F.col("content") == F.concat(F.lit("block "), F.col("chunk_index").cast("string")))
    assert found.agg(F.count("*"), right, F.count_distinct("chunk_index")).first()[:] == (n, n, n)


def test_tied_and_equal_blocks_keep_all_their_pieces_together(spark):
    long = " ".join(f"Sentence {i} of copy X " + "word " * 90 + "end." for i in range(12))
    rows = [(1, 1, "text", long.replace("X", c), 5) for c in "aabc"] + [(1, 1, "text", "", 5), (1, None, "text", "plain words", 0)]
    found = sorted(C.index_chunks(spark.createDataFrame(rows, BLOCKS), ["block_key"]).collect(), key=lambda r: r["chunk_index"])
    assert [r["chunk_index"] for r in found] == list(range(len(found)))
    assert found[0]["content"] == "plain words"
    copies = [r["content"].split("copy ")[1][0] for r in found[1:]]
    each = len(copies) // 4
    assert each > 1 and sorted(copies[i * each : (i + 1) * each] for i in range(4)) == [[c] * each for c in "aabc"]


def test_documents_with_labels_against_a_plain_loop(spark):
    kinds = ["Total Scope 1 emissions (Metric tonnes CO2e)", "21,949   20,972", "plain filler text", "Total Scope 1 emissions 1,234"]
    rows, expected = [], []
    for doc in range(6):
        texts = [kinds[(doc * 31 + i * i * 7 + i // 3) % 4] for i in range(300)]
        pages = [None if doc == 5 else i // 40 for i in range(300)]
        rows += [(doc, p, "text", t, i) for i, (p, t) in enumerate(zip(pages, texts))]
        taken = set()
        for i, t in enumerate(texts):
            if i in taken:
                continue
            if t == kinds[0] and i + 1 < 300 and texts[i + 1] in (kinds[1], kinds[3]) and pages[i] == pages[i + 1]:
                taken.add(i + 1)
                expected.append((doc, i, pages[i], t + "\n" + texts[i + 1], i + 1))
            else:
                expected.append((doc, i, pages[i], t, None))
    made = C.chunk_documents(spark.createDataFrame(rows, BLOCKS), ["block_key"])
    got = [tuple(r) for r in made.select("doc_id", "chunk_index", "page_number", "content", "merged_from").collect()]
    assert sorted(got, key=lambda r: r[:2]) == expected
    assert any(r[4] for r in expected)


def test_numbering_moves_no_text(spark):
    blocks = spark.createDataFrame([(1, 1, "text", "some words", 0)], BLOCKS)
    numbered = C.number_pieces(C.split_blocks(blocks, ["block_key"]), ["block_key"])
    assert "content" not in numbered.columns
    assert C.chunk_documents(blocks.limit(0), ["block_key"]).count() == 0
