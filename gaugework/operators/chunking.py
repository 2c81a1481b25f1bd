"""From text blocks of a page to indexed chunks of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugework.functions import text as T
from gaugework.operators.groups import long_groups, settled, unnest, with_position
from gaugework.rules import text as R
from gaugework.session import keep_table

NO_PAGE = -1
#: Blocks of a document that one task may number together.
MOST_TOGETHER = 40_000
#: Long documents are not known yet and are looked for.
UNKNOWN = object()
#: A text of n characters has (n + 1) / 2 words at most, so this many make no more than ``MAX_TOKENS`` tokens.
SURELY_SHORT = 2 * int(R.MAX_TOKENS * R.WORDS_PER_TOKEN) - 1


def classify_blocks(blocks: DataFrame, min_chars: int = R.MIN_BLOCK_CHARS) -> DataFrame:
    """Clean raw text blocks, drop short ones and mark footnotes.

    Tables pass through: their size rule counts cells, not characters.
    """
    raw = T.strip(F.col("content"))
    kind = (
        F.when(F.col("chunk_type") != "text", F.col("chunk_type"))
        .when(T.is_footnote(raw, F.col("block_top"), F.col("page_height")), F.lit("footnote"))
        .otherwise(F.col("chunk_type"))
    )
    return (
        settled(blocks, "content", "chunk_type")
        .filter((F.col("chunk_type") == "table") | (F.length(raw) >= min_chars))
        .withColumn("chunk_type", kind)
        .withColumn("content", T.clean_text(F.col("content")))
    )


def table_blocks(tables: DataFrame) -> DataFrame:
    """Tables with enough filled cells, as blocks of ``|``-separated lines."""
    return (
        tables.filter(T.filled_cells(F.col("cells")) >= R.MIN_TABLE_CELLS)
        .withColumn("content", T.table_text(F.col("cells")))
        .filter(F.col("content") != "")
        .withColumn("chunk_type", F.lit("table"))
        .drop("cells")
    )


def _typed(kind: Column, content: Column) -> Column:
    return F.when((kind == "table") | T.looks_like_table(content), F.lit("table")).otherwise(kind)


def _parts(typed: Column, content: Column) -> Column:
    """Segments of a block of this type; a text of few enough characters need not be counted."""
    short = (F.length(content) <= SURELY_SHORT) | (T.token_estimate(content) <= R.MAX_TOKENS)
    parts = F.when((typed == "table") | short, F.array(content)).otherwise(T.segments(content))
    return F.filter(parts, lambda p: T.strip(p) != "")


def split_blocks(blocks: DataFrame, order: list[str]) -> DataFrame:
    """Pieces of every block with a number ``_row`` that rises along the pieces of a block."""
    settled_blocks = settled(blocks, "content", "chunk_type").withColumn("_typed", _typed(F.col("chunk_type"), F.col("content")))
    # the type decides on splitting too: whether a text looks like a table is worked out once
    split = settled(settled_blocks, "_typed").select(
        "doc_id", F.coalesce("page_number", F.lit(NO_PAGE)).alias("_page"), *order,
        F.when(F.col("chunk_type") == "table", 0).otherwise(1).alias("_late"),
        F.xxhash64("chunk_type", "content").alias("_block"),
        F.col("_typed").alias("chunk_type"), _parts(F.col("_typed"), F.col("content")).alias("_parts"),
    )
    pieces = unnest(split, F.col("_parts"), "content", "doc_id", "_page", *order, "_late", "_block", "chunk_type")
    return pieces.withColumn("_row", F.monotonically_increasing_id())


def number_pieces(pieces: DataFrame, order: list[str], *carried: str) -> DataFrame:
    """Chunk index of every piece: page order, tables first.  No text is moved or read.

    Pieces of blocks that tie in ``order`` stay together.
    """
    narrow = pieces.select("doc_id", "_page", "_late", *order, "_row", *carried)
    placed = with_position(narrow, ["doc_id"], ["_page", "_late", *order, "_row"], "chunk_index")
    page = F.nullif(F.col("_page"), F.lit(NO_PAGE)).alias("page_number")
    return placed.select("_row", "doc_id", "chunk_index", page, *carried)


def long_documents(places: DataFrame) -> DataFrame | None:
    """Documents of more than ``MOST_TOGETHER`` rows, or None where there are none."""
    return long_groups(places, "doc_id", MOST_TOGETHER)


def _by_length(blocks: DataFrame, long: DataFrame | None | object, short_way, long_way) -> DataFrame:
    """One way for the documents whose rows a task may take together, another for longer ones."""
    long = long_documents(blocks) if long is UNKNOWN else long
    if long is None:
        return short_way(blocks)
    return short_way(blocks.join(long, "doc_id", "left_anti")).unionByName(long_way(blocks.join(long, "doc_id", "left_semi")))


def _in_document(order: list[str]):
    """The pieces of a document in their order; blocks that tie in it are told apart by what they hold."""
    return W.partitionBy("doc_id").orderBy("_page", "_late", *order, "_block", "_row")


def index_chunks(blocks: DataFrame, order: list[str], long: DataFrame | None | object = UNKNOWN) -> DataFrame:
    """Split blocks and number the pieces of each document from 0 in page order.

    The pieces of a document are numbered where they are brought together, which costs
    nothing where its blocks lie together already.  ``long``: see :func:`chunk_documents`.
    A block without a document is left out.
    """
    def together(some: DataFrame) -> DataFrame:
        pieces = split_blocks(some, order).filter(F.col("doc_id").isNotNull())
        return pieces.select(
            "doc_id", (F.row_number().over(_in_document(order)) - 1).cast("long").alias("chunk_index"), "chunk_type",
            F.nullif(F.col("_page"), F.lit(NO_PAGE)).alias("page_number"), "content",
        )

    return _by_length(blocks, long, together, lambda some: _index_long(some, order))


def _index_long(blocks: DataFrame, order: list[str]) -> DataFrame:
    """The same for documents of any length.

    Pieces are written once and numbered on their keys alone, also in a document
    that is one page of any length; texts are joined to the numbers at the end.
    """
    pieces = keep_table(split_blocks(blocks, order), "pieces")
    texts = pieces.select("_row", "chunk_type", "content")
    return number_pieces(pieces, order).join(texts, "_row").select(
        "doc_id", "chunk_index", "chunk_type", "page_number", "content"
    )


def with_index_terms(chunks: DataFrame) -> DataFrame:
    return settled(chunks, "content").withColumn("token_count", T.token_estimate(F.col("content"))).withColumn(
        "keywords", T.keywords(F.col("content"))
    )


def label_pairs(flags: DataFrame, most_tokens: int | None = None) -> DataFrame:
    """Label chunks and the value chunk right after each, on the same page.

    ``flags`` has ``_row``, place, tokens and what a chunk holds, but no text.  A label
    has no data number and its value has one, so no chunk is in two pairs and a join
    on neighbouring indexes decides them all, however long the document.
    """
    most = int(R.MAX_TOKENS * R.MERGED_FACTOR) if most_tokens is None else most_tokens
    labels = flags.filter(F.col("_label") & ~F.col("_number"))
    values = flags.filter("_number").select(
        "doc_id", (F.col("chunk_index") - 1).alias("chunk_index"), F.col("page_number").alias("_page"),
        F.coalesce("token_count", F.lit(0)).alias("_tokens"), F.col("_row").alias("_value_row"),
    )
    page, next_page = F.col("page_number"), F.col("_page")
    return (
        labels.join(values, ["doc_id", "chunk_index"])
        .filter(page.isNull() | next_page.isNull() | (page == next_page))
        .filter(F.coalesce("token_count", F.lit(0)) + F.col("_tokens") <= most)
        .select("_row", "_value_row", (F.col("chunk_index") + 1).alias("merged_from"))
    )


def _take_values(chunks: DataFrame, texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Value texts appended to their labels; every join is on ``_row``.

    Only the texts of values move beside those of the chunks themselves.
    """
    values = texts.select(F.col("_row").alias("_value_row"), F.col("content").alias("_value"))
    found = values.join(pairs, "_value_row").select("_row", "merged_from", "_value")
    joined = F.concat(
        F.regexp_replace("content", f"{T.SPACE}+$", ""), F.lit("\n"),
        F.regexp_replace("_value", f"^{T.SPACE}+", ""),
    )
    merged = F.col("merged_from").isNotNull()
    whole = (
        chunks.join(pairs.select(F.col("_value_row").alias("_row")), "_row", "left_anti")
        .join(found, "_row", "left")
        .withColumn("content", F.when(merged, joined).otherwise(F.col("content")))
    )
    return settled(whole, "content").withColumn(
        "token_count", F.when(merged, T.token_estimate(F.col("content"))).otherwise(F.col("token_count"))
    )


def merge_labels(chunks: DataFrame, most_tokens: int | None = None) -> DataFrame:
    """Append a value chunk to the label chunk before it on the same page.

    ``chunks`` is a stored table with one row per document and index: it is read for
    the flags, for the texts of values, and for the result.
    """
    keyed = chunks.withColumn("_row", F.struct("doc_id", "chunk_index"))
    flags = keyed.select(
        "_row", "doc_id", "chunk_index", "page_number", "token_count",
        T.has_label(F.col("content")).alias("_label"), T.has_data_number(F.col("content")).alias("_number"),
    )
    kept = _take_values(keyed, keyed, label_pairs(flags, most_tokens))
    merged = F.col("merged_from").isNotNull()
    words = F.when(merged, T.keywords(F.col("content"))).otherwise(F.col("keywords"))
    return kept.withColumn("keywords", words).select(*chunks.columns, "merged_from")


def _flagged(blocks: DataFrame, order: list[str]) -> DataFrame:
    return (
        split_blocks(blocks, order)
        .withColumn("token_count", T.token_estimate(F.col("content")))
        .withColumn("_label", T.has_label(F.col("content")))
        .withColumn("_number", T.has_data_number(F.col("content")))
    )


def chunk_documents(blocks: DataFrame, order: list[str], long: DataFrame | None | object = UNKNOWN) -> DataFrame:
    """Blocks (doc_id, page_number, chunk_type, content, order columns) to chunks.

    The pieces of a document are brought together once, where its blocks do not lie
    together already; numbers, label pairs and merged texts are worked out there and
    nothing is stored.  ``long`` holds the documents (doc_id) that are too long for that,
    or is None if there are none; left out, they are looked for, which reads ``blocks`` once more.
    """
    return _by_length(blocks, long, lambda some: _chunk_together(some, order), lambda some: _chunk_long(some, order))


def _chunk_together(blocks: DataFrame, order: list[str]) -> DataFrame:
    here, most = _in_document(order), int(R.MAX_TOKENS * R.MERGED_FACTOR)
    near = {"page": "_page", "tokens": "token_count", "label": "_label", "number": "_number"}
    seen = _flagged(blocks, order).filter(F.col("doc_id").isNotNull()).withColumns({
        "chunk_index": (F.row_number().over(here) - 1).cast("long"),
        "_next_content": F.lead("content").over(here),
        **{f"_next_{n}": F.lead(c).over(here) for n, c in near.items()},
        **{f"_last_{n}": F.lag(c).over(here) for n, c in near.items()},
    })

    def takes(at: str, value: str) -> Column:
        """Is the row before (``at``) a label without a number, and the one after it (``value``) its value?"""
        own = lambda side, n: F.col(f"{side}{n}" if side else near[n])
        page, next_page = own(at, "page"), own(value, "page")
        pair = own(at, "label") & ~own(at, "number") & own(value, "number")
        on_page = (page == NO_PAGE) | (next_page == NO_PAGE) | (page == next_page)
        short = F.coalesce(own(at, "tokens"), F.lit(0)) + F.coalesce(own(value, "tokens"), F.lit(0)) <= most
        return F.coalesce(pair & on_page & short, F.lit(False))

    merged = F.col("merged_from").isNotNull()
    joined = F.concat(
        F.regexp_replace("content", f"{T.SPACE}+$", ""), F.lit("\n"), F.regexp_replace("_next_content", f"^{T.SPACE}+", ""),
    )
    whole = settled(
        seen.filter(~takes("_last_", "")).select(
            "doc_id", "chunk_index", "chunk_type", F.nullif(F.col("_page"), F.lit(NO_PAGE)).alias("page_number"), "content", "token_count",
            F.when(takes("", "_next_"), F.col("chunk_index") + 1).alias("merged_from"), "_next_content",
        ).withColumn("content", F.when(merged, joined).otherwise(F.col("content"))), "content",
    )
    return whole.select(
        "doc_id", "chunk_index", "chunk_type", "page_number", "content",
        F.when(merged, T.token_estimate(F.col("content"))).otherwise(F.col("token_count")).alias("token_count"),
        T.keywords(F.col("content")).alias("keywords"), "merged_from",
    )


def _chunk_long(blocks: DataFrame, order: list[str]) -> DataFrame:
    """The same for documents of any length.

    Pieces and what they hold are worked out and written once.  Numbers and label pairs
    come from narrow rows; the texts are joined once, to the chunks that stay.
    """
    pieces = keep_table(_flagged(blocks, order), "pieces")
    texts = pieces.select("_row", "chunk_type", "content")
    numbered = number_pieces(pieces, order, "token_count", "_label", "_number")
    chunks = _take_values(numbered.join(texts, "_row"), texts, label_pairs(numbered))
    return chunks.select(
        "doc_id", "chunk_index", "chunk_type", "page_number", "content", "token_count",
        T.keywords(F.col("content")).alias("keywords"), "merged_from",
    )


def parse_summary(chunks: DataFrame, page_counts: DataFrame) -> DataFrame:
    """Pages, words, chunks by type and pages without text, per document."""
    text = chunks.groupBy("doc_id").agg(
        F.sum(T.word_count(F.col("content"))).alias("word_count"),
        F.count_if(F.col("chunk_type") != "table").alias("text_chunk_count"),
        F.count_if(F.col("chunk_type") == "table").alias("table_count"),
        F.count(F.lit(1)).alias("chunk_count"),
    )
    with_text = (
        chunks.filter(F.col("chunk_type") != "table")
        .groupBy("doc_id", "page_number").agg(F.lit(1).alias("_one"))
        .groupBy("doc_id").agg(F.count(F.lit(1)).alias("_text_pages"))
    )
    zero = F.lit(0).cast("long")
    return (
        page_counts.join(text, "doc_id", "left")
        .join(with_text, "doc_id", "left")
        .select(
            "doc_id", "page_count",
            *[
                F.coalesce(F.col(c), zero).alias(c)
                for c in ("word_count", "text_chunk_count", "table_count", "chunk_count")
            ],
            (F.col("page_count") - F.coalesce("_text_pages", zero)).alias("ocr_page_count"),
        )
    )


def pages_without_text(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Pages that yielded no text chunk: the work list for optical recognition."""
    text = chunks.filter(F.col("chunk_type") != "table")
    return pages.join(text, ["doc_id", "page_number"], "left_anti")


def unparsed(reports: DataFrame, parsed: DataFrame, version: str) -> DataFrame:
    """Reports with no parse result at this parser version."""
    done = parsed.filter(F.col("parser_version") == version)
    return reports.join(done, "report_id", "left_anti")
