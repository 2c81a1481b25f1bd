"""Report tables derived from the given tables, once, in SQL that Spark and DuckDB share.

Every view covers all rows of its inputs.  ``{name}`` refers to a given table or to
an earlier view.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from gaugework.rules.catalogue import METRIC_NAMES
from gaugework.session import gathered, spread

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def _case(expr: str, values, start: int = 0) -> str:
    branches = " ".join(f"WHEN {i + start} THEN {v}" for i, v in enumerate(values))
    return f"CASE {expr} {branches} END"


def _commas(n: str) -> str:
    low = f"lpad(CAST({n} % 1000 AS STRING), 3, '0')"
    return (
        f"CASE WHEN {n} < 1000 THEN CAST({n} AS STRING) "
        f"ELSE concat(CAST(CAST(floor({n} / 1000) AS BIGINT) AS STRING), ',', {low}) END"
    )


_NL = "chr(10)"
_KPI = _case("l_partkey % 12", [f"'{n}'" for n in METRIC_NAMES])
_VALUE = _case(
    "l_partkey % 12",
    [
        "l_extendedprice", "l_extendedprice * 2", "l_extendedprice * 3", "l_extendedprice * 10",
        "l_quantity * 2.125E0", "l_extendedprice * 5", "l_quantity * 10", "l_extendedprice",
        "l_quantity", "l_extendedprice * 20", "l_quantity * 3", "l_quantity",
    ],
)
_GHG = _case("l_suppkey % 5", ["'tCO2e'", "'Metric Tonnes CO2e'", "'kt-CO2e'", "'total tCO2e'", "'furlong'"])
_UNITS = {
    3: _case("l_suppkey % 5", ["'GJ'", "'MWh'", "NULL", "'gigajoules.'", "'kWh'"]),
    5: _case("l_suppkey % 5", ["'KL'", "'kilolitres'", "'m3'", "'ML'", "NULL"]),
    6: _case("l_suppkey % 5", ["'MT'", "'Metric Tonnes'", "'kg'", "'tonnes equivalent'", "'furlong'"]),
    7: _case("l_suppkey % 5", ["'headcount'", "'nos'", "NULL", "'employees'", "'count'"]),
}
_UNITS[10] = _UNITS[11] = _UNITS[7]
_UNITS[4] = _UNITS[8] = _case("l_suppkey % 5", ["'%'", "'percent'", "NULL", "'per cent'", "'%'"])
_UNIT = _case("l_partkey % 12", [_UNITS.get(i, _GHG) for i in range(12)])
_ID = (
    "concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), "
    "lpad(CAST(l_partkey AS STRING), 9, '0'), lpad(CAST(l_suppkey AS STRING), 9, '0'), "
    "CAST(CAST(l_quantity AS BIGINT) AS STRING), CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING))"
)

_TEXT = _case(
    "l_partkey % 20",
    [
        "'Total Scope 1 emissions (Metric tonnes CO2e)'",
        "concat(num, '   ', num2, '   reported values for the year')",
        "concat('Total Scope 1 emissions (Break-up of the GHG into CO2) in Metric tonnes of ', num, ' as assured')",
        "concat('Scope 2 emissions were ', num, ' tCO2e from purchased electricity across our campuses.')",
        f"concat('Total Scope 2 emissions market-based, CO2 equivalent', {_NL}, num, '(2) under the location-based method')",
        f"concat('Total Scope 3 emissions (Break-up of the GHG into CO2, Metric tonnes of CO2', {_NL}, "
        f"'                 ', lakhs, '   ', lakhs2, ' (2)', {_NL}, 'CH4, N2O, HFCs, if available)(1) equivalent')",
        f"concat('Total energy consumed (A+B+C+D+E+F)', {_NL}, num, ' GJ in the reporting year')",
        "concat('Total energy consumption ', num, ' GJ | ', num2, ' GJ | previous year')",
        f"concat('Total water consumption | ', num, ' KL | ', num2, ' KL', {_NL}, 'water intake | ', num2, ' KL')",
        f"concat('Total volume of water consumption (in kilolitres)', {_NL}, num)",
        "concat('Total waste generated ', num, ' metric tonnes including hazardous waste and non-hazardous waste.')",
        f"concat('We get ', pct, '% of electricity for', {_NL}, '     our India operations from renewable sources of power.')",
        "concat('Employees and workers HEAR@example.com, GRB@example.com ', num3, ' ', qty)",
        "concat('Complaints pending resolution at close of the year: ', qty, ' of all stakeholder complaints')",
        "concat('Total number of employees stood at ', num, ' headcount. Women employees are ', pct, '% of the workforce.')",
        f"concat('Consolidated and Standalone results', {_NL}, 'Revenue from operations ', lakhs, ' ', lakhs2, ' ', lakhs3, ' ', lakhs)",
        f"concat('Statement of profit and loss', {_NL}, 'Total revenue', {_NL}, num, {_NL}, 'in crore')",
        f"concat('Total energy consumption (A+B+C) ', lakhs, {_NL}, 'Energy intensity per rupee of turnover', {_NL}, "
        "CASE l_suppkey % 3 WHEN 0 THEN '5.11' WHEN 1 THEN '0.000000076' ELSE '0.0000012' END, ' as reported')",
        "concat('We reduced scope 1 emissions by ', num, ' tCO2e compared to FY2019, with a target of net zero.')",
        "'Business Responsibility and Sustainability overview. CSR details and revenue notes follow for all material topics.'",
    ],
)

VIEWS: dict[str, str] = {
    "companies": """
        SELECT CAST(floor(c_custkey / 10) AS BIGINT) AS company_id, min(c_name) AS company_name,
               min(c_mktsegment) AS sector, min(n_name) AS country,
               bool_or(c_acctbal > 0) AS is_active
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey GROUP BY 1""",
    "reports": """
        SELECT o_orderkey AS report_id, CAST(floor(o_custkey / 10) AS BIGINT) AS company_id,
               CAST(year(o_orderdate) AS INT) AS report_year,
               CASE o_orderkey % 4 WHEN 0 THEN 'Integrated' WHEN 1 THEN 'BRSR' WHEN 2 THEN 'ESG'
                    ELSE 'Other' END AS report_type,
               CASE WHEN o_orderstatus = 'F' THEN 'downloaded' WHEN o_orderstatus = 'O' THEN 'parsed'
                    WHEN o_orderpriority LIKE '1%' THEN 'failed' ELSE 'discovered' END AS status,
               CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice / 10 END AS revenue_cr,
               CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 3 = 0 THEN NULL ELSE 'INR_Crore' END AS revenue_unit,
               CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 3 = 1 THEN NULL ELSE 'regex' END AS revenue_source,
               CASE WHEN o_orderstatus = 'P' OR o_orderkey % 7 = 0 THEN NULL
                    ELSE concat('/reports/', CAST(o_orderkey AS STRING), '.pdf') END AS file_path,
               concat('https://example.com/', CAST(CAST(floor(o_orderkey / 2) AS BIGINT) AS STRING)) AS source_url,
               o_totalprice / 1000000 AS score,
               o_orderdate AS created_at, o_orderdate AS discovered_at
        FROM {orders}""",
    "lines": f"""
        SELECT l.*, {_ID} AS record_id,
               CAST(floor(l_extendedprice) AS BIGINT) AS n,
               CAST(l_quantity AS BIGINT) AS q
        FROM {{lineitem}} l""",
    "kpi_records": f"""
        SELECT record_id, company_id, report_id, report_year, {_KPI} AS kpi,
               CASE WHEN l_suppkey % 50 = 7 THEN NULL ELSE {_VALUE} END AS value, {_UNIT} AS unit,
               CASE WHEN l_returnflag = 'A' THEN 'llm' ELSE 'regex' END AS extraction_method,
               CASE WHEN l_suppkey % 40 = 3 THEN NULL ELSE round(0.35E0 + l_discount * 6, 2) END AS confidence,
               COALESCE(round(0.35E0 + l_discount * 6, 2) >= 0.85E0, FALSE) AS is_validated,
               l_shipdate AS extracted_at
        FROM {{lines}} JOIN {{reports}} ON l_orderkey = report_id""",
    "numbers": f"""
        SELECT record_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
               {_commas('n')} AS num, {_commas('(n * 2)')} AS num2,
               CAST(n % 900 + 10 AS STRING) AS num3, CAST(q AS STRING) AS qty,
               concat(CAST(q + 30 AS STRING), '.', CAST(n % 9 + 1 AS STRING)) AS pct,
               concat(CAST(n % 9 + 1 AS STRING), ',', lpad(CAST(n % 97 AS STRING), 2, '0'), ',',
                      lpad(CAST(n % 1000 AS STRING), 3, '0')) AS lakhs,
               concat(CAST(n % 7 + 1 AS STRING), ',', lpad(CAST(n % 89 AS STRING), 2, '0'), ',',
                      lpad(CAST(n % 991 AS STRING), 3, '0')) AS lakhs2,
               concat(CAST(n % 8 + 2 AS STRING), ',', lpad(CAST(n % 83 AS STRING), 2, '0'), ',',
                      lpad(CAST(n % 983 AS STRING), 3, '0')) AS lakhs3
        FROM {{lines}}""",
    "blocks": f"""
        SELECT l_orderkey AS doc_id, l_linenumber AS page_number, record_id AS block_key,
               CASE WHEN l_partkey % 20 = 8 THEN 'table' ELSE 'text' END AS chunk_type,
               {_TEXT} AS content,
               l_partkey AS part_no, l_suppkey AS supp_no, l_quantity * 16 AS block_top, 8E2 AS page_height
        FROM {{numbers}}""",
    "report_pages": """
        SELECT doc_id AS report_id,
               CAST(page_number AS BIGINT) * 1000000000000 + part_no * 1000000 + supp_no AS page_number,
               content AS text
        FROM {blocks}""",
    "parsed_documents": """
        SELECT concat(CAST(report_id AS STRING), '-v1') AS parsed_id, report_id, 'v1' AS parser_version,
               CAST(report_id % 90 + 1 AS INT) AS page_count, CAST(report_id % 400 AS INT) AS chunk_count,
               created_at AS parsed_at
        FROM {reports} WHERE status IN ('parsed', 'downloaded')
        UNION ALL
        SELECT concat(CAST(report_id AS STRING), '-v2'), report_id, 'v2',
               CAST(report_id % 90 + 1 AS INT), CAST(report_id % 300 AS INT), created_at
        FROM {reports} WHERE status = 'parsed'""",
    "search_results": """
        SELECT page_id AS seq, CAST(page_id % 50 AS BIGINT) AS company_id, CAST(2024 + page_id % 2 AS INT) AS report_year,
               regexp_replace(regexp_replace(url, '^https?://', ''), '[./].*$', '') AS company_name,
               CASE page_id % 5 WHEN 0 THEN 'Annual Report' WHEN 1 THEN 'Sustainability Report' WHEN 2 THEN 'ESG index fund'
                    WHEN 3 THEN 'BRSR filing' ELSE 'Integrated annual review' END AS title,
               CASE page_id % 7 WHEN 0 THEN 'FY 2024-25' WHEN 1 THEN 'fy2025 results' WHEN 2 THEN 'for 2025-26'
                    WHEN 3 THEN 'dated 2025-10-31' WHEN 4 THEN 'year 2024' WHEN 5 THEN 'FY24 and more' ELSE 'year 2025' END AS snippet,
               CAST(page_id % 6 + 1 AS INT) AS position,
               CASE page_id % 3 WHEN 0 THEN 'ESG' WHEN 1 THEN 'Integrated' ELSE 'BRSR' END AS query_type,
               CASE WHEN page_id % 4 = 0 THEN concat(url, '/annual-report') ELSE url END AS url
        FROM {pages}""",
    "responses": """
        SELECT conv_id, turn,
               CASE turn % 3 WHEN 0 THEN 'scope_1_emissions' WHEN 1 THEN 'energy_consumption' ELSE 'total_ghg_emissions' END AS kpi,
               CASE conv_id % 5
                 WHEN 0 THEN concat('```json', chr(10), '{{"value": ', CAST(length(text) AS STRING), ', "unit": "Million tonnes CO2e", "confidence": 0.9, "notes": None,}}', chr(10), '```')
                 WHEN 1 THEN concat('Here it is: {{"value": ', CAST(length(text) AS STRING), ', "unit": "gj", "confidence": 0.6,}} as asked.')
                 WHEN 2 THEN concat('{{"value": None, "unit": None, "confidence": 0.1}}')
                 WHEN 3 THEN text
                 ELSE concat('```', chr(10), '{{"value": ', CAST(length(text) * 100 AS STRING), ', "confidence": 0.75, "unit": "MT CO2e"}}', chr(10), '```') END AS text
        FROM {conversations}""",
}


#: The same rows as Spark works them out: a record's long id is made after the join, so it is not moved.
_MOVED = {
    "kpi_records": VIEWS["kpi_records"].replace("SELECT record_id,", f"SELECT {_ID} AS record_id,").replace("{lines}", "{lineitem}"),
}

#: Views of texts: their rows cost far more to make and to read than to move.
TEXT_VIEWS = ("numbers",)
#: Column that tells the document of a row.
DOCUMENT = {"lineitem": "l_orderkey"}


@cache
def _parts(sql: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", sql)))


def needs(name: str) -> tuple[str, ...]:
    return _parts(VIEWS[name])


def frame(spark: SparkSession, folder: str, name: str, dealt: bool = False, by_document: bool = False) -> DataFrame:
    """Given table or derived view as a DataFrame; below a text view, tables are dealt to all cores.

    They are dealt by document if asked for: the numbers that a text is made of take less room
    than the text, and what follows finds the rows of a document together.
    """
    if name in TABLES:
        table = spark.read.parquet(f"{folder}/{name}.parquet")
        if dealt and by_document and name in DOCUMENT:
            return gathered(table, DOCUMENT[name])
        return spread(table) if dealt else table
    sql = _MOVED.get(name, VIEWS[name])
    parts = {n: frame(spark, folder, n, dealt or name in TEXT_VIEWS, by_document) for n in _parts(sql)}
    return spark.sql(sql, **parts)


def sql_with(names, body: str, extra: list[tuple[str, str]] = ()) -> str:
    """``body`` for DuckDB, with the views it needs as common table expressions."""
    ordered: list[str] = []

    def visit(n: str) -> None:
        if n in TABLES or n in ordered:
            return
        for m in needs(n):
            visit(m)
        ordered.append(n)

    for n in names:
        visit(n)
    ctes = [f"{n} AS ({VIEWS[n].format(**{m: m for m in needs(n)})})" for n in ordered]
    ctes += [f"{n} AS MATERIALIZED ({q})" for n, q in extra]
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body
