"""Cleaning, tokenising and chunking of text."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugework.functions import text as T
from gaugework.operators import chunking as C
from gaugework.operators.groups import unnest
from gaugework.queries.registry import literals, query, text
from gaugework.queries.views import frame, sql_with
from gaugework.rules import text as R
from gaugework.session import keep_table
from gaugework.sources import landing
from gaugework.sources import tables as S

WS = r"[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]"
# Word boundary before and after a digit for any script
LEFT, RIGHT = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def words_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')"


def clean_sql(x: str) -> str:
    return strip_sql(
        f"regexp_replace(regexp_replace(regexp_replace({x}, '{R.CONTROL}', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' {{2,}}', ' ', 'g')"
    )


def tokens_sql(x: str) -> str:
    return f"greatest(1, CAST(floor(len({words_sql(x)}) / 0.75::DOUBLE) AS INT))"


def number_sql(x: str) -> str:
    return f"regexp_matches({x}, {text(LEFT + R.NUMBER[2:-2] + '[0-9]?' + RIGHT)})"


def keywords_sql(x: str) -> str:
    return f"""list_sort(list_concat(list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-zA-Z0-9]+'),
        lambda t: (length(t) > 2 AND NOT list_contains([{literals(R.STOP_WORDS)}], t)) OR list_contains([{literals(R.SHORT_TERMS)}], t))),
        CASE WHEN {number_sql(x)} THEN ['has_numbers'] ELSE [] END))"""


def table_sql(x: str) -> str:
    number_count = f"len(regexp_extract_all({x}, {text(R.NUMBER)}))"
    return f"""coalesce(length({strip_sql(x)}) >= 10 AND (length({x}) - length(replace({x}, '|', '')) >= 2
        OR (len({words_sql(x)}) >= 4 AND len(list_filter({words_sql(x)}, lambda t: regexp_matches(t, '^[(),.]*\\d([\\d,.]*\\d)?[(),.]*$')))
            > len({words_sql(x)}) * 0.30::DOUBLE)
        OR regexp_matches({x}, {text(R.ADJACENT_NUMBERS)})
        OR (regexp_matches({x}, {text('(?i)' + R.UNIT_WORD)}) AND {number_count} >= 2)), FALSE)"""


def sentences_sql(x: str) -> str:
    split = f"regexp_replace(regexp_replace({x}, '\\r\\n?', chr(10), 'g'), '([.!?]){WS}+([A-Z\\d])', '\\1' || chr(1) || '\\2', 'g')"
    return (
        f"list_filter(list_transform(flatten(list_transform(string_split({split}, chr(1)), lambda p: string_split(p, chr(10)))),"
        f" lambda s: {strip_sql('s')}), lambda s: s <> '')"
    )


# Blocks of the derived reports are short, so the SQL side needs no splitting.
LABELS = " OR ".join(f"contains(lower(content), {text(t)})" for t in R.LABEL_WORDING)
CHUNK_CTES = [
    ("classified", f"""SELECT doc_id, page_number, block_key, {clean_sql('content')} AS content,
        CASE WHEN chunk_type <> 'text' THEN chunk_type
             WHEN block_top > page_height * 0.85::DOUBLE AND length({strip_sql('content')}) < 200
               AND regexp_matches({strip_sql('content')}, {text(R.FOOTNOTE_START)}) THEN 'footnote' ELSE chunk_type END AS chunk_type
        FROM blocks WHERE chunk_type = 'table' OR length({strip_sql('content')}) >= 30"""),
    ("typed", f"""SELECT *, CASE WHEN chunk_type = 'table' OR {table_sql('content')} THEN 'table' ELSE chunk_type END AS kind,
        CASE WHEN chunk_type = 'table' THEN 0 ELSE 1 END AS late FROM classified"""),
    ("indexed", """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, late, block_key) - 1 AS chunk_index,
        kind AS chunk_type, page_number, content FROM typed"""),
    ("termed", f"SELECT *, {tokens_sql('content')} AS token_count, {keywords_sql('content')} AS keywords FROM indexed"),
    ("looked", f"""SELECT *, ({LABELS}) AS label, regexp_matches(content, {text(R.DATA_NUMBER)}) AS number FROM termed"""),
    ("paired", """SELECT *, label AND NOT number AND coalesce(lead(number) OVER d, FALSE) AND lead(page_number) OVER d = page_number
          AND token_count + lead(token_count) OVER d <= 750 AS takes, lead(content) OVER d AS next_content, lead(chunk_index) OVER d AS next_index
        FROM looked WINDOW d AS (PARTITION BY doc_id ORDER BY chunk_index)"""),
    ("merging", """SELECT *, coalesce(lag(takes) OVER (PARTITION BY doc_id ORDER BY chunk_index), FALSE) AS taken FROM paired"""),
    ("joined", f"""SELECT doc_id, chunk_index, chunk_type, page_number, coalesce(takes, FALSE) AS takes, token_count, keywords,
        CASE WHEN takes THEN rtrim(content) || chr(10) || ltrim(next_content) ELSE content END AS content,
        CASE WHEN takes THEN next_index END AS merged_from FROM merging WHERE NOT taken"""),
    ("chunks", f"""SELECT doc_id, chunk_index, chunk_type, page_number, content,
        CASE WHEN takes THEN {tokens_sql('content')} ELSE token_count END AS token_count,
        CASE WHEN takes THEN {keywords_sql('content')} ELSE keywords END AS keywords, merged_from FROM joined"""),
]


def chunk_sql(body: str, extra: list[tuple[str, str]] = (), views=("blocks",)) -> str:
    return sql_with(list(views), body, CHUNK_CTES + list(extra))


def long_documents(spark, folder):
    """Reports with too many blocks for one task, told by their keys alone; None if there are none."""
    return C.long_documents(frame(spark, folder, "blocks").select("doc_id"))


def classified(spark, folder, long):
    """Blocks, those of a report together unless some report is too long for that."""
    return C.classify_blocks(frame(spark, folder, "blocks", by_document=long is None))


def chunks(spark, folder, long=C.UNKNOWN):
    """Chunks of the derived reports, those of a report together."""
    long = long_documents(spark, folder) if long is C.UNKNOWN else long
    return C.chunk_documents(classified(spark, folder, long), ["block_key"], long)


def indexed(spark, folder):
    long = long_documents(spark, folder)
    return C.index_chunks(classified(spark, folder, long), ["block_key"], long)


def stored_chunks(spark, folder):
    """The same chunks written out once, as the chunk table is before retrieval."""
    return keep_table(chunks(spark, folder), "chunks")


def documents(spark, folder):
    return frame(spark, folder, "documents").select("doc_id", "text")


# --------------------------------------------------------------------------
@query("clean_text", f"SELECT doc_id, md5({clean_sql('text')}) AS cleaned, length({clean_sql('text')}) AS chars FROM documents")
def _(spark, folder):
    return documents(spark, folder).select("doc_id", T.clean_text(F.col("text")).alias("c")).select(
        "doc_id", F.md5("c").alias("cleaned"), F.length("c").cast("long").alias("chars")
    )


@query("token_estimate", f"SELECT doc_id, {tokens_sql('text')} AS tokens FROM documents")
def _(spark, folder):
    return documents(spark, folder).select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("keyword_index", f"SELECT doc_id, unnest({keywords_sql('text')}) AS keyword FROM documents")
def _(spark, folder):
    return documents(spark, folder).select("doc_id", F.explode(T.keywords(F.col("text"))).alias("keyword"))


@query("table_detect", f"SELECT doc_id, {table_sql('text')} AS is_table FROM documents")
def _(spark, folder):
    return documents(spark, folder).select("doc_id", T.looks_like_table(F.col("text")).alias("is_table"))


@query("sentence_split", f"SELECT doc_id, unnest({sentences_sql('text')}) AS sentence FROM documents")
def _(spark, folder):
    return documents(spark, folder).select("doc_id", F.explode(T.sentences(F.col("text"))).alias("sentence"))


# Runs of sentences: the SQL side walks the sentence list with a recursive query.
SEGMENTS = f"""
    WITH RECURSIVE parts AS (
      SELECT doc_id, {sentences_sql('text')} AS s FROM documents
    ), sized AS (SELECT doc_id, s, list_transform(s, lambda x: len({words_sql('x')})) AS w FROM parts WHERE len(s) > 0),
    walk AS (
      SELECT doc_id, 1 AS i, CAST(w[1] AS BIGINT) AS n, 1 AS first, CAST(NULL AS INT) AS cut_from FROM sized
      UNION ALL
      SELECT k.doc_id, k.i + 1,
             CASE WHEN k.n + z.w[k.i + 1] > 375 AND k.n >= 150 THEN z.w[k.i] + z.w[k.i + 1] ELSE k.n + z.w[k.i + 1] END,
             CASE WHEN k.n + z.w[k.i + 1] > 375 AND k.n >= 150 THEN k.i ELSE k.first END,
             CASE WHEN k.n + z.w[k.i + 1] > 375 AND k.n >= 150 THEN k.first END
      FROM walk k JOIN sized z USING (doc_id) WHERE k.i < len(z.s)
    ), runs AS (
      SELECT doc_id, cut_from AS a, i - 1 AS b FROM walk WHERE cut_from IS NOT NULL
      UNION ALL SELECT doc_id, first, i FROM walk JOIN sized USING (doc_id) WHERE i = len(s)
    )
    SELECT doc_id, md5(array_to_string(s[a:b], ' ')) AS segment FROM runs JOIN sized USING (doc_id)"""


@query("sentence_segments", SEGMENTS)
def _(spark, folder):
    runs = unnest(documents(spark, folder), T.segments(F.col("text")), "run", "doc_id")
    return runs.select("doc_id", F.md5("run").alias("segment"))


@query(
    "serialised_tables",
    f"""SELECT doc_id, md5(array_to_string(list_transform(rows, lambda r: array_to_string(list_transform(r, lambda c: {strip_sql('c')}), ' | ')), chr(10))) AS content
       FROM (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda l: string_split(l, '|')) AS rows FROM documents)
       WHERE len(list_filter(flatten(rows), lambda c: {strip_sql('c')} <> '')) >= 4""",
)
def _(spark, folder):
    cells = F.transform(F.split("text", "\n"), lambda line: F.split(line, r"\|"))
    tables = documents(spark, folder).select("doc_id", cells.alias("cells"))
    return C.table_blocks(tables).select("doc_id", F.md5("content").alias("content"))


@query(
    "parsed_numbers",
    sql_with(["numbers"], """SELECT record_id, TRY_CAST(replace(lakhs, ',', '') AS DOUBLE) AS lakhs, TRY_CAST(replace(num, ',', '') AS DOUBLE) AS num,
        TRY_CAST(replace(replace(concat(qty, ' x'), ',', ''), ' ', '') AS DOUBLE) AS broken FROM numbers"""),
)
def _(spark, folder):
    return frame(spark, folder, "numbers").select(
        "record_id", T.parse_number(F.col("lakhs")).alias("lakhs"), T.parse_number(F.col("num")).alias("num"),
        T.parse_number(F.concat("qty", F.lit(" x"))).alias("broken"),
    )


@query("block_classify", chunk_sql("SELECT doc_id, page_number, block_key, chunk_type, content FROM classified"))
def _(spark, folder):
    return C.classify_blocks(frame(spark, folder, "blocks")).select(
        "doc_id", "page_number", "block_key", "chunk_type", "content"
    )


@query("chunk_index", chunk_sql("SELECT * FROM indexed"))
def _(spark, folder):
    return indexed(spark, folder)


@query(
    "merge_label_value",
    chunk_sql("""SELECT doc_id, chunk_index, chunk_type, page_number, content, token_count, array_to_string(keywords, ' ') AS keywords,
        merged_from FROM chunks"""),
)
def _(spark, folder):
    return chunks(spark, folder).withColumn("keywords", F.array_join("keywords", " "))


@query(
    "chunk_listing",
    chunk_sql("""SELECT doc_id, chunk_index, chunk_type, page_number, token_count, replace(left(content, 80), chr(10), ' ') AS preview
        FROM chunks WHERE chunk_type = 'table' ORDER BY doc_id, chunk_index"""),
)
def _(spark, folder):
    return S.list_chunks(chunks(spark, folder), kind="table").orderBy("doc_id", "chunk_index")


@query(
    "chunk_counts",
    chunk_sql("""SELECT doc_id, count(*) AS total, count(*) FILTER (chunk_type = 'table') AS tables,
        count(*) FILTER (chunk_type = 'text') AS texts, count(*) FILTER (chunk_type = 'footnote') AS footnotes FROM chunks GROUP BY 1"""),
)
def _(spark, folder):
    kind = F.col("chunk_type")
    return chunks(spark, folder).groupBy("doc_id").agg(
        F.count("*").alias("total"), F.count_if(kind == "table").alias("tables"),
        F.count_if(kind == "text").alias("texts"), F.count_if(kind == "footnote").alias("footnotes"),
    )


PAGES = "SELECT doc_id, count(DISTINCT page_number) AS page_count FROM blocks GROUP BY 1"


@query(
    "parse_meta",
    chunk_sql(f"""SELECT doc_id, page_count, coalesce(word_count, 0)::BIGINT AS word_count, coalesce(text_chunk_count, 0) AS text_chunk_count,
          coalesce(table_count, 0) AS table_count, coalesce(chunk_count, 0) AS chunk_count, page_count - coalesce(text_pages, 0) AS ocr_page_count
        FROM ({PAGES}) LEFT JOIN (SELECT doc_id, sum(len({words_sql('content')})) AS word_count, count(*) FILTER (chunk_type <> 'table') AS text_chunk_count,
          count(*) FILTER (chunk_type = 'table') AS table_count, count(*) AS chunk_count,
          count(DISTINCT page_number) FILTER (chunk_type <> 'table') AS text_pages FROM indexed GROUP BY 1) USING (doc_id)"""),
)
def _(spark, folder):
    blocks = frame(spark, folder, "blocks")
    pages = blocks.groupBy("doc_id").agg(F.count_distinct("page_number").alias("page_count"))
    return C.parse_summary(indexed(spark, folder), pages)


@query(
    "ocr_worklist",
    chunk_sql("""SELECT DISTINCT doc_id, page_number FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM indexed i
        WHERE i.doc_id = b.doc_id AND i.page_number = b.page_number AND i.chunk_type <> 'table')"""),
)
def _(spark, folder):
    blocks = frame(spark, folder, "blocks")
    pages = blocks.select("doc_id", "page_number").distinct()
    return C.pages_without_text(pages, indexed(spark, folder))


@query(
    "document_chunks",
    f"""SELECT doc_id, kind AS chunk_type, md5(content) AS content FROM (
          SELECT doc_id, CASE WHEN tbl THEN 'table' ELSE 'text' END AS kind, text AS content FROM (
            SELECT doc_id, text, {table_sql('text')} AS tbl, {tokens_sql('text')} AS tokens FROM documents)
          WHERE (tbl OR tokens <= 500) AND {strip_sql('text')} <> '')
        UNION ALL
        SELECT doc_id, 'text', segment FROM ({SEGMENTS}) JOIN (
          SELECT doc_id FROM documents WHERE NOT {table_sql('text')} AND {tokens_sql('text')} > 500) USING (doc_id)""",
)
def _(spark, folder):
    blocks = documents(spark, folder).select(
        "doc_id", F.lit(1).alias("page_number"), F.lit("text").alias("chunk_type"), F.col("text").alias("content"), F.lit(0).alias("block_key")
    )
    return C.index_chunks(blocks, ["block_key"]).select("doc_id", "chunk_type", F.md5("content").alias("content"))


@query(
    "unparsed_reports",
    sql_with(["parsed_documents", "reports"], """SELECT report_id, report_type FROM reports r WHERE NOT EXISTS (
        SELECT 1 FROM parsed_documents p WHERE p.report_id = r.report_id AND p.parser_version = 'v2')"""),
)
def _(spark, folder):
    reports = frame(spark, folder, "reports").select("report_id", "report_type")
    return C.unparsed(reports, frame(spark, folder, "parsed_documents"), "v2")


@query(
    "binary_landing",
    """SELECT company_id, file_hash, file_size_bytes, report_year, file_name, 'downloaded' AS status FROM (
         SELECT *, row_number() OVER (PARTITION BY company_id, file_hash ORDER BY report_year, path) AS rn,
           concat(report_year, '_BRSR_l_t_finance_', company_id, '_', left(file_hash, 8), '.pdf') AS file_name
         FROM (SELECT page_id % 7 AS company_id, CAST(2020 + page_id % 5 AS INT) AS report_year, url AS path,
                 sha256(CASE WHEN page_id % 3 = 0 THEN html ELSE '%PDF-' || html END) AS file_hash, page_id,
                 CAST(octet_length(encode('%PDF-' || html)) AS BIGINT) AS file_size_bytes FROM pages)
         WHERE page_id % 3 <> 0) WHERE rn = 1""",
)
def _(spark, folder):
    content = F.when(F.col("page_id") % 3 == 0, F.col("html")).otherwise(
        F.concat(F.lit("%PDF-"), F.col("html"))
    )
    files = frame(spark, folder, "pages").select(
        (F.col("page_id") % 7).alias("company_id"),
        F.concat(F.lit("L&T Finance "), (F.col("page_id") % 7).cast("string")).alias("company_name"),
        (2020 + F.col("page_id") % 5).cast("int").alias("report_year"), F.lit("BRSR").alias("report_type"),
        F.col("url").alias("path"), content.cast("binary").alias("content"),
    )
    none = files.select("company_id", F.lit("").alias("file_hash"))
    return landing.land(files, none).select(
        "company_id", "file_hash", "file_size_bytes", "report_year", "file_name", "status"
    )
