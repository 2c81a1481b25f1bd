"""Declared schemas, readers, writers and listings of the stored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from gaugework.functions import text as T
from gaugework.operators.groups import first_per_group, top_per_group
from gaugework.rules.catalogue import METRICS, Metric
from gaugework.session import small_rows

SCHEMAS: dict[str, str] = {
    "companies": (
        "id string, name string, ticker string, sector string, industry string, country string, "
        "is_active boolean, created_at timestamp, updated_at timestamp"
    ),
    "reports": (
        "id string, company_id string, report_year int, report_type string, source_url string, "
        "file_path string, file_hash string, file_size_bytes bigint, status string, "
        "error_message string, discovered_at timestamp, downloaded_at timestamp, "
        "created_at timestamp, updated_at timestamp, revenue_cr double, revenue_unit string, "
        "revenue_source string"
    ),
    "parsed_documents": (
        "id string, report_id string, parser_version string, page_count int, parsed_at timestamp, "
        "meta struct<page_count:int,word_count:int,text_chunk_count:int,table_count:int,"
        "ocr_page_count:int,chunk_count:int,mode:string>"
    ),
    "document_chunks": (
        "id string, parsed_document_id string, chunk_index int, chunk_type string, page_number int, "
        "content string, token_count int, embedding array<float>, keywords array<string>, "
        "is_embedded boolean"
    ),
    "kpi_definitions": (
        "id string, name string, display_name string, category string, subcategory string, "
        "expected_unit string, regex_patterns array<string>, retrieval_keywords array<string>, "
        "valid_min double, valid_max double, is_active boolean, created_at timestamp"
    ),
    "kpi_records": (
        "id string, company_id string, report_id string, kpi_definition_id string, report_year int, "
        "raw_value string, normalized_value double, unit string, extraction_method string, "
        "confidence double, source_chunk_id string, is_validated boolean, validation_notes string, "
        "extracted_at timestamp"
    ),
}


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Stored table with its declared schema; nothing is inferred."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}")


def conform(df: DataFrame, name: str) -> DataFrame:
    """Select and cast to the declared schema; absent columns become null."""
    schema = Ty.StructType.fromDDL(SCHEMAS[name])
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def replace_parse(stored: DataFrame, new: DataFrame, keys: Sequence[str] = ("report_id", "parser_version")) -> DataFrame:
    """Stored rows with the (report, version) entries of ``new`` replaced."""
    return stored.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def catalogue_frame(spark: SparkSession, metrics: Sequence[Metric] = METRICS) -> DataFrame:
    """The metric catalogue as a table."""
    rows = [
        (m.name, m.display_name, m.category, m.subcategory, m.expected_unit,
         list(m.patterns), list(m.keywords), m.valid_min, m.valid_max, m.is_active)
        for m in metrics
    ]
    return spark.createDataFrame(
        rows,
        "name string, display_name string, category string, subcategory string, expected_unit string, "
        "regex_patterns array<string>, retrieval_keywords array<string>, valid_min double, "
        "valid_max double, is_active boolean",
    )


def metrics_from(definitions: DataFrame, aliases: dict[str, Sequence[str]] | None = None) -> tuple[Metric, ...]:
    """Metrics from a stored catalogue, which must be of rule-table size."""
    aliases = aliases or {m.name: m.aliases for m in METRICS}
    rows = small_rows(definitions, 10_000, "metric catalogue")
    return tuple(
        Metric(
            r["name"], r["display_name"], r["category"], r["subcategory"], r["expected_unit"] or "",
            r["valid_min"], r["valid_max"], tuple(r["retrieval_keywords"] or ()),
            tuple(r["regex_patterns"] or ()), tuple(aliases.get(r["name"], ())), bool(r["is_active"]),
        )
        for r in rows
    )


def upsert_catalogue(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Insert new metrics; for known names renew patterns, keywords and bounds only."""
    renewed = ("regex_patterns", "retrieval_keywords", "valid_min", "valid_max")
    s, n = stored.alias("s"), new.alias("n")
    known, fresh = F.col("s.name").isNotNull(), F.col("n.name").isNotNull()
    columns = []
    for c in stored.columns:
        old = F.col(f"s.{c}")
        if c not in new.columns:
            columns.append(old.alias(c))
        elif c in renewed:
            columns.append(F.when(fresh, F.col(f"n.{c}")).otherwise(old).alias(c))
        else:
            columns.append(F.when(known, old).otherwise(F.col(f"n.{c}")).alias(c))
    return s.join(n, F.col("s.name") == F.col("n.name"), "full_outer").select(*columns)


def companies_to_add(wanted: DataFrame, companies: DataFrame) -> DataFrame:
    """Companies whose name is not stored yet, letter case aside, each once."""
    fold = F.lower("company_name")
    fresh = wanted.withColumn("_n", fold).join(companies.select(fold.alias("_n")).distinct(), "_n", "left_anti")
    order = [F.col(c).asc_nulls_last() for c in wanted.columns]
    return first_per_group(fresh, ["_n"], order).drop("_n")


def reports_to_add(found: DataFrame, reports: DataFrame) -> DataFrame:
    """Reports to register: (company, address) not stored yet, best score first."""
    keys = ["company_id", "source_url"]
    fresh = found.join(reports.select(*keys), keys, "left_anti")
    return first_per_group(
        fresh, keys, [F.col("score").desc(), F.col("report_type"), F.col("report_year")]
    ).withColumn("status", F.lit("discovered"))


def current_status(events: DataFrame) -> DataFrame:
    """Latest status per report from a log of status events.

    Equal times are settled by how far the status is.
    """
    stage = F.array_position(
        F.array(*[F.lit(s) for s in ("discovered", "downloading", "failed", "downloaded", "parsed")]),
        F.col("status"),
    )
    return events.groupBy("report_id").agg(
        F.max_by("status", F.struct(F.col("ts"), stage)).alias("status"),
        F.max("ts").alias("changed_at"),
        F.count(F.lit(1)).alias("changes"),
    )


def list_companies(companies: DataFrame, active_only: bool = False) -> DataFrame:
    kept = companies.filter("is_active") if active_only else companies
    return kept.orderBy("company_name", "company_id")


def company_by_part(companies: DataFrame, part: str) -> DataFrame:
    """First company, by name, whose name contains ``part`` in any letter case."""
    return companies.filter(F.contains(F.lower("company_name"), F.lit(part.lower()))).orderBy(
        "company_name", "company_id"
    ).limit(1)


def list_reports(reports: DataFrame, companies: DataFrame) -> DataFrame:
    return reports.join(companies.select("company_id", "company_name"), "company_id").select(
        "company_name", "report_year", "report_type", "status", "report_id"
    )


def list_parses(parsed: DataFrame, reports: DataFrame, companies: DataFrame) -> DataFrame:
    return (
        parsed.join(reports.select("report_id", "company_id", "report_year"), "report_id")
        .join(companies.select("company_id", "company_name"), "company_id")
        .select(
            "company_name", "report_year", "parser_version", "page_count", "chunk_count", "parsed_id"
        )
    )


def list_chunks(chunks: DataFrame, kind: str | None = None, chars: int = 80, limit: int | None = None) -> DataFrame:
    """Chunk listing with a short preview on one line, the first ``limit`` of each document if given."""
    kept = chunks.filter(F.col("chunk_type") == kind) if kind else chunks
    if limit is not None:
        kept = top_per_group(kept, ["doc_id"], [F.col("chunk_index")], limit)
    return kept.select(
        "doc_id", "chunk_index", "chunk_type", "page_number", "token_count",
        T.preview(F.col("content"), chars).alias("preview"),
    )


def records_of_report(records: DataFrame, report_id: object | None = None, limit: int | None = None) -> DataFrame:
    """Records newest first: of one report, or of every report one after the other."""
    kept = records if report_id is None else records.filter(F.col("report_id") == report_id)
    ordered = kept.orderBy("report_id", F.col("extracted_at").desc(), "record_id")
    return ordered if limit is None else ordered.limit(limit)


def listed(rows: DataFrame, order: Sequence[Column | str], limit: int | None = None) -> DataFrame:
    """A listing in its order, cut to a display limit if one is given; every task then sends at most that many rows."""
    ordered = rows.orderBy(*order)
    return ordered if limit is None else ordered.limit(limit)


def list_records(records: DataFrame, definitions: DataFrame, companies: DataFrame) -> DataFrame:
    """Records with metric and company names; the unit falls back to the expected one."""
    defs = definitions.select(
        F.col("name").alias("kpi"), "category", "expected_unit"
    )
    return (
        records.join(defs, "kpi")
        .join(companies.select("company_id", "company_name"), "company_id")
        .select(
            "report_id", "company_name", "report_year", "category", "kpi", "value",
            F.coalesce("unit", "expected_unit").alias("unit"),
            F.col("extraction_method").alias("method"), "confidence", "is_validated", "extracted_at",
        )
    )


def active_metrics(definitions: DataFrame) -> DataFrame:
    return definitions.filter("is_active").orderBy("category", "name")


def metrics_named(definitions: DataFrame, names: Sequence[str]) -> DataFrame:
    return definitions.filter(F.col("name").isin(*names))


def embeddable(chunks: DataFrame, force: bool = False) -> DataFrame:
    """Chunks whose vector is to be worked out."""
    return chunks if force else chunks.filter(~F.col("is_embedded"))


def apply_vectors(chunks: DataFrame, vectors: DataFrame, dimension: int, force: bool = False) -> DataFrame:
    """Store new vectors on chunks; vectors of a wrong shape are refused."""
    from gaugework.operators.vectors import valid_vector

    good = vectors.filter(valid_vector(F.col("new_vector"), dimension))
    may = F.col("new_vector").isNotNull() & (F.lit(force) | ~F.col("is_embedded"))
    return (
        chunks.join(good, ["doc_id", "chunk_index"], "left")
        .withColumn("embedding", F.when(may, F.col("new_vector")).otherwise(F.col("embedding")))
        .withColumn("is_embedded", F.col("is_embedded") | may)
        .drop("new_vector")
    )
