"""Listings, stored records, units, ratios and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugework.functions import text as T
from gaugework.functions import units as U
from gaugework.operators import benchmark as B
from gaugework.operators import discovery as D
from gaugework.operators import records as R
from gaugework.operators import vectors as X
from gaugework.queries.registry import literals, query, table
from gaugework.queries.views import frame, sql_with
from gaugework.rules import limits as L
from gaugework.rules import units as UR
from gaugework.rules.catalogue import METRICS
from gaugework.sources import tables as S

# --------------------------------------------------------------------------
# SQL parts
# --------------------------------------------------------------------------
PRIORITY = "CASE report_type WHEN 'Integrated' THEN 0 WHEN 'BRSR' THEN 1 WHEN 'ESG' THEN 2 ELSE 99 END"
CATALOGUE = (
    "catalogue",
    table(
        [(m.name, m.display_name, m.category, m.subcategory, m.expected_unit, m.valid_min, m.valid_max,
          len(m.patterns), len(m.keywords)) for m in METRICS],
        "name, display_name, category, subcategory, expected_unit, valid_min, valid_max, n_patterns, n_keywords",
    ),
)


def ranges(profile: str, name: str = "ranges") -> tuple[str, str]:
    return name, table([(k, lo, hi) for k, (lo, hi) in L.PLAUSIBLE[profile].items()], "kpi, lo, hi")


def ceilings(profile: str, name: str = "ceilings") -> tuple[str, str]:
    return name, table(list(L.CEILINGS[profile].items()), "kpi, ceiling")


COMPARED = (
    "compared",
    table(
        L.COMPARED,
        "kpi, display_name, label, grp, unit, ratio_unit, divides, lower_better",
    ),
)
FACTORS = ("factors", table([(c, u, f) for c, t in UR.FACTORS.items() for u, f in t.items()], "category, unit, factor"))
CANON = ("canon", table(list(UR.CANONICAL.items()), "category, unit"))


def category_sql(name: str) -> str:
    exact = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in UR.CATEGORY_EXACT.items())
    parts = " ".join(f"WHEN contains(lower({name}), '{p}') THEN '{c}'" for p, c in UR.CATEGORY_PARTS)
    return f"coalesce(CASE lower({name}) {exact} END, CASE {parts} END)"


CLEAN_UNIT = (
    "regexp_replace(regexp_replace(regexp_replace(trim(lower(coalesce({u}, ''))), '[/\\-_]', ' ', 'g'),"
    " '\\s+', ' ', 'g'), '^\\.+|\\.+$', '', 'g')"
)


def normalised_sql(source: str, kpi: str = "kpi", value: str = "value", unit: str = "unit") -> str:
    """SELECT * with n_category, n_factor, n_value, n_unit, n_error."""
    cleaned = CLEAN_UNIT.format(u=unit)
    keys = ["c.u"]
    for p in UR.UNIT_PREFIXES:
        keys.append(f"CASE WHEN starts_with(c.u, '{p}') THEN substr(c.u, {len(p) + 1}) END")
    for p in UR.UNIT_SUFFIXES:
        keys.append(f"CASE WHEN ends_with(c.u, '{p}') THEN trim(left(c.u, length(c.u) - {len(p)})) END")
    joins = " ".join(
        f"LEFT JOIN factors f{i} ON f{i}.category = c.n_category AND f{i}.unit = {k}" for i, k in enumerate(keys)
    )
    factor = "coalesce(" + ", ".join(f"f{i}.factor" for i in range(len(keys))) + ")"
    return f"""
        SELECT * EXCLUDE (raw_factor, u), CASE WHEN n_error IS NULL AND {value} IS NOT NULL THEN raw_factor END AS n_factor,
               CASE WHEN n_error IS NULL THEN {value} * raw_factor END AS n_value,
               CASE WHEN n_error IS NULL AND {value} IS NOT NULL THEN (SELECT unit FROM canon WHERE category = n_category) END AS n_unit
        FROM (
          SELECT *, CASE WHEN {value} IS NULL THEN NULL WHEN n_category IS NULL THEN 'unknown category'
                         WHEN n_category = 'percentage' AND NOT ({value} BETWEEN 0 AND 100) THEN 'percentage out of range'
                         WHEN raw_factor IS NULL THEN 'unknown unit' END AS n_error
          FROM (
            SELECT c.*, CASE WHEN c.n_category IN ('count', 'percentage') THEN 1.0::DOUBLE ELSE {factor} END AS raw_factor
            FROM (SELECT *, {category_sql(kpi)} AS n_category, {cleaned} AS u FROM {source}) c {joins}))"""


def best_sql(profile: str, gate_first: bool = False) -> str:
    gate = (
        "coalesce(confidence, 0) >= 0.4 AND (lo IS NULL OR value BETWEEN lo AND hi)"
    )
    inner, outer = (f"AND {gate}", "") if gate_first else ("", f"AND {gate}")
    return f"""
        SELECT company_id, report_year, kpi, value, coalesce(unit, expected_unit) AS unit, extraction_method AS method,
               coalesce(confidence, 0) AS confidence, report_type, report_id
        FROM (SELECT k.*, r.report_type, c.expected_unit, lo, hi,
                     row_number() OVER (PARTITION BY k.company_id, k.report_year, k.kpi
                       ORDER BY {PRIORITY}, extracted_at DESC, record_id) AS rn
              FROM kpi_records k JOIN reports r USING (report_id) JOIN catalogue c ON c.name = k.kpi
              LEFT JOIN ranges USING (kpi)
              WHERE value IS NOT NULL {inner})
        WHERE rn = 1 {outer}"""


BEST_REVENUE = f"""
    SELECT company_id, report_year, report_id, revenue_cr AS value_cr, coalesce(revenue_unit, 'INR_Crore') AS raw_unit,
           coalesce(revenue_source, 'db') AS source, 0.99::DOUBLE AS confidence, 'cached' AS pattern_name
    FROM (SELECT *, row_number() OVER (PARTITION BY company_id, report_year
            ORDER BY {PRIORITY}, created_at DESC, report_id) AS rn FROM reports WHERE revenue_cr IS NOT NULL)
    WHERE rn = 1"""

RATIOS = """
    SELECT company_id, report_year, kpi, display_name, grp, n_value AS normalized_value,
           cu AS normalized_unit, revenue_cr, ratio, ratio_unit, ratio_source
    FROM (SELECT n.*, d.display_name, d.grp, d.unit AS cu, d.ratio_unit,
                 CASE WHEN NOT divides THEN n_value WHEN revenue_cr > 0 THEN n_value / revenue_cr END AS ratio,
                 CASE WHEN NOT divides THEN 'absolute' ELSE 'computed' END AS ratio_source, ceiling
          FROM norm n JOIN compared d USING (kpi) LEFT JOIN ceilings USING (kpi)
          WHERE n_error IS NULL)
    WHERE ratio IS NOT NULL AND ratio <= ceiling"""


def ratio_ctes() -> list[tuple[str, str]]:
    return [
        CATALOGUE, ranges("store"), ceilings("compare"), COMPARED, FACTORS, CANON,
        ("best", best_sql("store")),
        ("revenue", BEST_REVENUE),
        ("valued", """SELECT b.company_id, b.report_year, b.kpi, b.value,
                             coalesce(nullif(b.unit, ''), d.unit) AS unit, r.value_cr AS revenue_cr
                      FROM best b JOIN compared d USING (kpi) LEFT JOIN revenue r USING (company_id, report_year)"""),
        ("norm", normalised_sql("valued")),
        ("ratios", RATIOS),
        ("entries", """SELECT concat(c.sector, ' ', CAST(r.report_year AS VARCHAR)) AS comparison_id, r.kpi,
                              concat(c.company_name, ' FY', CAST(r.report_year AS VARCHAR)) AS label, r.ratio, r.ratio_source
                       FROM ratios r JOIN companies c USING (company_id)"""),
        ("stats", """SELECT comparison_id, kpi, count(*) AS entries, min(ratio) AS lowest, max(ratio) AS highest,
                            min(CASE WHEN ratio = lo THEN label END) AS low_label,
                            min(CASE WHEN ratio = hi THEN label END) AS high_label
                     FROM (SELECT *, min(ratio) OVER g AS lo, max(ratio) OVER g AS hi FROM entries
                           WINDOW g AS (PARTITION BY comparison_id, kpi)) GROUP BY 1, 2"""),
        ("comparisons", """SELECT comparison_id, kpi, display_name, grp, ratio_unit AS unit, entries, lower_better,
                                  CASE WHEN lower_better THEN low_label ELSE high_label END AS winner,
                                  CASE WHEN lower_better THEN high_label ELSE low_label END AS loser,
                                  CASE WHEN lower_better THEN lowest ELSE highest END AS best,
                                  CASE WHEN lower_better THEN highest ELSE lowest END AS worst
                           FROM stats JOIN compared USING (kpi) WHERE entries >= 2"""),
        ("wins", """SELECT l.comparison_id, l.label, count(w.winner) AS wins
                    FROM (SELECT DISTINCT comparison_id, label FROM entries) l
                    LEFT JOIN comparisons w ON w.comparison_id = l.comparison_id AND w.winner = l.label GROUP BY 1, 2"""),
    ]


def ratio_sql(body: str) -> str:
    return sql_with(["kpi_records", "companies"], body, ratio_ctes())


# --------------------------------------------------------------------------
# Spark parts
# --------------------------------------------------------------------------
def ordered_records(spark, folder):
    """Stored records with ``record_order``, which sorts as their ids do and takes half the bytes."""
    return frame(spark, folder, "kpi_records").withColumn("record_order", T.packed_digits(F.col("record_id")))


def best_records(spark, folder, **options):
    return R.best_per_key(
        ordered_records(spark, folder), frame(spark, folder, "reports"), tie=("record_order",), **options
    )


def ratios(spark, folder):
    return B.profile_ratios(best_records(spark, folder), R.best_revenue(frame(spark, folder, "reports")))


def entries(spark, folder):
    """Ratios of all companies, compared within their sector and year."""
    companies = frame(spark, folder, "companies").select("company_id", "company_name", "sector")
    year = F.col("report_year").cast("string")
    return ratios(spark, folder).join(companies, "company_id").select(
        F.concat("sector", F.lit(" "), year).alias("comparison_id"), "kpi",
        F.concat("company_name", F.lit(" FY"), year).alias("label"), "ratio", "ratio_source",
    )


# --------------------------------------------------------------------------
# Listings
# --------------------------------------------------------------------------
@query("list_companies", sql_with(["companies"], "SELECT * FROM companies WHERE is_active ORDER BY company_name, company_id"))
def _(spark, folder):
    return S.list_companies(frame(spark, folder, "companies"), active_only=True)


@query(
    "company_by_part",
    sql_with(["companies"], "SELECT * FROM companies WHERE contains(lower(company_name), lower('R#00000004')) ORDER BY company_name, company_id LIMIT 1"),
)
def _(spark, folder):
    return S.company_by_part(frame(spark, folder, "companies"), "R#00000004")


@query(
    "list_reports",
    sql_with(["reports", "companies"], """SELECT company_name, report_year, report_type, status, report_id
        FROM reports JOIN companies USING (company_id) ORDER BY company_name, report_year DESC, report_id"""),
)
def _(spark, folder):
    listed = S.list_reports(frame(spark, folder, "reports"), frame(spark, folder, "companies"))
    return listed.orderBy("company_name", F.col("report_year").desc(), "report_id")


@query(
    "parse_status",
    sql_with(["parsed_documents", "reports", "companies"], """
        SELECT company_name, report_year, parser_version, p.page_count, p.chunk_count, parsed_id
        FROM parsed_documents p JOIN reports USING (report_id) JOIN companies USING (company_id)"""),
)
def _(spark, folder):
    return S.list_parses(
        frame(spark, folder, "parsed_documents"), frame(spark, folder, "reports"), frame(spark, folder, "companies")
    )


@query(
    "kpi_records_listing",
    sql_with(["kpi_records", "companies"], """
        SELECT report_id, company_name, report_year, category, kpi, value, coalesce(unit, expected_unit) AS unit,
               extraction_method AS method, confidence, is_validated, extracted_at
        FROM kpi_records JOIN catalogue ON name = kpi JOIN companies USING (company_id)""", [CATALOGUE]),
)
def _(spark, folder):
    return S.list_records(
        frame(spark, folder, "kpi_records"), S.catalogue_frame(spark), frame(spark, folder, "companies")
    )


@query(
    "newest_record_per_report",
    sql_with(["kpi_records"], """SELECT report_id, record_id, kpi, extracted_at FROM (
        SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY extracted_at DESC, record_id) AS rn FROM kpi_records) WHERE rn = 1"""),
)
def _(spark, folder):
    newest = R.first_per_group(
        frame(spark, folder, "kpi_records"), ["report_id"], [F.col("extracted_at").desc(), F.col("record_id")]
    )
    return newest.select("report_id", "record_id", "kpi", "extracted_at")


@query(
    "active_metrics",
    sql_with(["kpi_records"], """SELECT c.category, c.name, c.expected_unit, c.valid_min, c.valid_max, c.n_patterns::INT AS patterns,
        c.n_keywords::INT AS keywords, count(k.record_id) AS records
        FROM catalogue c LEFT JOIN kpi_records k ON k.kpi = c.name GROUP BY ALL""", [CATALOGUE]),
)
def _(spark, folder):
    used = frame(spark, folder, "kpi_records").groupBy(F.col("kpi").alias("name")).agg(F.count("*").alias("records"))
    return S.active_metrics(S.catalogue_frame(spark)).join(used, "name", "left").select(
        "category", "name", "expected_unit", "valid_min", "valid_max",
        F.size("regex_patterns").alias("patterns"), F.size("retrieval_keywords").alias("keywords"),
        F.coalesce("records", F.lit(0).cast("long")).alias("records"),
    )


@query(
    "retry_worklist",
    sql_with(["reports", "companies"], """SELECT DISTINCT company_id, report_year, company_name
        FROM reports JOIN companies USING (company_id) WHERE status = 'failed'"""),
)
def _(spark, folder):
    return D.retry_worklist(frame(spark, folder, "reports"), frame(spark, folder, "companies"))


# --------------------------------------------------------------------------
# Best rows per key
# --------------------------------------------------------------------------
@query("best_record_per_kpi", sql_with(["kpi_records"], best_sql("store"), [CATALOGUE, ranges("store")]))
def _(spark, folder):
    return best_records(spark, folder)


@query("best_record_gate_first", sql_with(["kpi_records"], best_sql("store", True), [CATALOGUE, ranges("store")]))
def _(spark, folder):
    return best_records(spark, folder, gate_first=True)


@query("best_revenue", sql_with(["reports"], BEST_REVENUE))
def _(spark, folder):
    return R.best_revenue(frame(spark, folder, "reports"))


@query(
    "best_report",
    sql_with(["reports"], f"""SELECT company_id, report_year, report_id, report_type, status FROM (
        SELECT *, row_number() OVER (PARTITION BY company_id, report_year ORDER BY {PRIORITY}, created_at DESC, report_id) AS rn
        FROM reports WHERE status IN ('downloaded', 'parsed', 'extracted') AND file_path IS NOT NULL) WHERE rn = 1"""),
)
def _(spark, folder):
    best = R.best_report(frame(spark, folder, "reports"), need_file=True)
    return best.select("company_id", "report_year", "report_id", "report_type", "status")


@query(
    "usable_reports",
    sql_with(["reports"], """SELECT company_id, report_year, report_id, status FROM reports
        WHERE status IN ('downloaded', 'parsed', 'extracted')"""),
)
def _(spark, folder):
    return R.usable_reports(frame(spark, folder, "reports")).select("company_id", "report_year", "report_id", "status")


@query(
    "latest_parse",
    sql_with(["parsed_documents"], """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
        PARTITION BY report_id ORDER BY parsed_at DESC, parsed_id) AS rn FROM parsed_documents) WHERE rn = 1"""),
)
def _(spark, folder):
    return R.latest_parse(frame(spark, folder, "parsed_documents"))


@query(
    "latest_validated",
    sql_with(["kpi_records"], """SELECT company_id, report_year, kpi, record_id, value, confidence FROM (
        SELECT *, row_number() OVER (PARTITION BY company_id, report_year, kpi ORDER BY extracted_at DESC, record_id) AS rn
        FROM kpi_records WHERE is_validated) WHERE rn = 1"""),
)
def _(spark, folder):
    return R.latest_validated(frame(spark, folder, "kpi_records")).select(
        "company_id", "report_year", "kpi", "record_id", "value", "confidence"
    )


@query(
    "missing_kpis",
    sql_with(["kpi_records"], """SELECT g.company_id, g.report_year, g.kpi FROM (
        SELECT DISTINCT company_id, report_year, t.kpi FROM reports, targets t
        WHERE status IN ('downloaded', 'parsed', 'extracted')) g
        LEFT JOIN best b USING (company_id, report_year, kpi) WHERE b.value IS NULL""",
             [CATALOGUE, ranges("store"), ("best", best_sql("store")),
              ("targets", table([(k,) for k in L.RUN_EXTRACTED], "kpi"))]),
)
def _(spark, folder):
    grid = R.wanted(R.usable_reports(frame(spark, folder, "reports")), L.RUN_EXTRACTED)
    return R.missing(grid, best_records(spark, folder))


FALLBACK = f"""
    SELECT company_id, report_year, kpi, report_id, record_id, value, unit FROM (
      SELECT n.*, r.report_type, row_number() OVER (PARTITION BY n.company_id, n.report_year, kpi
               ORDER BY {PRIORITY}, r.created_at DESC, report_id, record_id) AS rn
      FROM norm n JOIN reports r USING (report_id) LEFT JOIN run_ranges g USING (kpi)
      WHERE value IS NOT NULL AND r.status IN ('downloaded', 'parsed', 'extracted')
        AND (g.lo IS NULL OR (n_error IS NULL AND n_value BETWEEN g.lo AND g.hi))) WHERE rn = 1"""


@query(
    "report_fallback",
    sql_with(["kpi_records"], FALLBACK, [FACTORS, CANON, ranges("run", "run_ranges"), ("norm", normalised_sql("kpi_records"))]),
)
def _(spark, folder):
    found = R.first_report_with_value(
        ordered_records(spark, folder), frame(spark, folder, "reports"), tie=("record_order",)
    )
    return found.select("company_id", "report_year", "kpi", "report_id", "record_id", "value", "unit")


@query(
    "merged_values",
    sql_with(["kpi_records"], """SELECT company_id, report_year, kpi, coalesce(f.value, b.value) AS value
        FROM best b FULL JOIN fall f USING (company_id, report_year, kpi)""",
             [CATALOGUE, ranges("store"), FACTORS, CANON, ranges("run", "run_ranges"), ("norm", normalised_sql("kpi_records")),
              ("best", best_sql("store")), ("fall", FALLBACK)]),
)
def _(spark, folder):
    both = R.stored_and_fresh(
        ordered_records(spark, folder), frame(spark, folder, "reports"), tie=("record_order",), fields=("value",)
    )
    return both.select(*R.KEY, F.coalesce("fresh.value", "stored.value").alias("value"))


# --------------------------------------------------------------------------
# Units and derived totals
# --------------------------------------------------------------------------
@query(
    "normalize_units",
    sql_with(["kpi_records"], """SELECT record_id, kpi, value, unit, n_category AS category, n_factor AS factor,
        CASE WHEN n_value < 1e6 THEN round(n_value, 5) ELSE round(n_value, 2) END AS normalized_value, n_unit AS normalized_unit FROM norm WHERE n_error IS NULL AND value IS NOT NULL""",
             [FACTORS, CANON, ("norm", normalised_sql("kpi_records"))]),
)
def _(spark, folder):
    n = U.normalised(F.col("kpi"), F.col("value"), F.col("unit"))
    return (
        frame(spark, folder, "kpi_records").withColumn("n", n)
        .filter(F.col("value").isNotNull() & F.col("n.error").isNull())
        .select(
            "record_id", "kpi", "value", "unit", F.col("n.category").alias("category"), F.col("n.factor").alias("factor"),
            F.when(F.col("n.value") < 1e6, F.round("n.value", 5)).otherwise(F.round("n.value", 2)).alias("normalized_value"), F.col("n.unit").alias("normalized_unit"),
        )
    )


@query(
    "unit_errors",
    sql_with(["kpi_records"], """SELECT kpi, unit, n_error AS error, count(*) AS records FROM norm
        WHERE n_error IS NOT NULL GROUP BY ALL""", [FACTORS, CANON, ("norm", normalised_sql("kpi_records"))]),
)
def _(spark, folder):
    n = U.normalised(F.col("kpi"), F.col("value"), F.col("unit"))
    return (
        frame(spark, folder, "kpi_records").withColumn("error", n["error"]).filter(F.col("error").isNotNull())
        .groupBy("kpi", "unit", "error").agg(F.count("*").alias("records"))
    )


@query(
    "unit_synonyms",
    sql_with(["kpi_records"], f"""SELECT unit, coalesce(s.canonical, trim(unit)) AS extracted_unit, count(*) AS records
        FROM kpi_records LEFT JOIN syn s ON s.raw = trim(lower(unit)) WHERE unit IS NOT NULL GROUP BY 1, 2""",
             [("syn", table(list(UR.SYNONYMS.items()), "raw, canonical"))]),
)
def _(spark, folder):
    return (
        frame(spark, folder, "kpi_records").filter(F.col("unit").isNotNull())
        .groupBy("unit", U.unit_synonym(F.col("unit")).alias("extracted_unit")).agg(F.count("*").alias("records"))
    )


DERIVED = """
    SELECT company_id, report_year, 'total_ghg_emissions' AS kpi, round_even(s1 + s2, 2) AS value, 'tCO2e' AS unit,
           round_even(least(c1, c2) * 0.99::DOUBLE, 3) AS confidence, 'derived' AS extraction_method
    FROM (SELECT company_id, report_year, max(CASE WHEN kpi = 'scope_1_emissions' THEN n_value END) AS s1,
                 max(CASE WHEN kpi = 'scope_2_emissions' THEN n_value END) AS s2,
                 max(CASE WHEN kpi = 'total_ghg_emissions' THEN value END) AS t,
                 coalesce(max(CASE WHEN kpi = 'scope_1_emissions' THEN confidence END), 0.5) AS c1,
                 coalesce(max(CASE WHEN kpi = 'scope_2_emissions' THEN confidence END), 0.5) AS c2
          FROM bnorm GROUP BY 1, 2)
    WHERE t IS NULL AND s1 IS NOT NULL AND s2 IS NOT NULL"""


@query(
    "derive_total",
    sql_with(["kpi_records"], DERIVED, [CATALOGUE, ranges("store"), FACTORS, CANON, ("best", best_sql("store")),
                                        ("bnorm", normalised_sql("best"))]),
)
def _(spark, folder):
    return R.derive_missing_total(best_records(spark, folder))


# --------------------------------------------------------------------------
# Ratios and comparisons
# --------------------------------------------------------------------------
@query(
    "company_profile",
    ratio_sql("""SELECT company_id, report_year, kpi, display_name, grp AS "group", round(normalized_value, 7) AS normalized_value,
        normalized_unit, revenue_cr, round(ratio, 6) AS ratio, ratio_unit, ratio_source FROM ratios"""),
)
def _(spark, folder):
    return ratios(spark, folder).select(
        "company_id", "report_year", "kpi", "display_name", "group", F.round("normalized_value", 7).alias("normalized_value"),
        "normalized_unit", "revenue_cr", F.round("ratio", 6).alias("ratio"), "ratio_unit", "ratio_source",
    )


@query(
    "ratio_run_ceiling",
    sql_with(["kpi_records", "companies"], """SELECT company_id, report_year, kpi, round(ratio, 6) AS ratio
        FROM ratios LEFT JOIN run_ceilings c USING (kpi) WHERE c.ceiling IS NULL OR (ratio > 0 AND ratio <= c.ceiling)""",
             ratio_ctes() + [ceilings("run", "run_ceilings")]),
)
def _(spark, folder):
    return ratios(spark, folder).filter(B.under_ceiling(F.col("kpi"), F.col("ratio"), "run")).select(
        "company_id", "report_year", "kpi", F.round("ratio", 6).alias("ratio")
    )


@query(
    "plain_ratio",
    sql_with(["kpi_records", "companies"], """SELECT record_id, kpi, round(CASE WHEN coalesce(divides, TRUE) AND revenue_cr > 0
          THEN value / revenue_cr ELSE value END, 6) AS ratio
        FROM kpi_records JOIN reports USING (report_id) LEFT JOIN compared USING (kpi) WHERE value IS NOT NULL""",
             [("compared", COMPARED[1].replace("SELECT *", "SELECT kpi, divides"))]).replace("coalesce(divides, TRUE)", "coalesce(divides, TRUE)"),
)
def _(spark, folder):
    revenue = frame(spark, folder, "reports").select("report_id", "revenue_cr")
    return (
        frame(spark, folder, "kpi_records").filter(F.col("value").isNotNull()).join(revenue, "report_id")
        .select("record_id", "kpi", F.round(B.plain_ratio(F.col("kpi"), F.col("value"), F.col("revenue_cr")), 6).alias("ratio"))
    )


GAP = "round(CASE WHEN worst > 0 THEN abs(best - worst) / worst * 100 ELSE 0 END, 3) AS pct_gap"


@query(
    "compare_companies",
    ratio_sql(f"""SELECT comparison_id, kpi, display_name, grp AS "group", unit, entries, winner, loser,
        round(best, 6) AS best, round(worst, 6) AS worst, {GAP} FROM comparisons"""),
)
def _(spark, folder):
    return B.compare(entries(spark, folder)).select(
        "comparison_id", "kpi", "display_name", "group", "unit", "entries", "winner", "loser",
        F.round("best", 6).alias("best"), F.round("worst", 6).alias("worst"), F.round("pct_gap", 3).alias("pct_gap"),
    )


@query("win_counts", ratio_sql("SELECT * FROM wins"))
def _(spark, folder):
    rows = entries(spark, folder)
    return B.win_counts(rows, B.compare(rows))


@query(
    "overall_winner",
    ratio_sql("""SELECT comparison_id, label, wins FROM (SELECT *, row_number() OVER (PARTITION BY comparison_id
        ORDER BY wins DESC, label) AS rn FROM wins) WHERE rn = 1"""),
)
def _(spark, folder):
    rows = entries(spark, folder)
    return B.overall_winner(B.win_counts(rows, B.compare(rows)))


@query(
    "rank_percentile",
    ratio_sql("""SELECT company_id, report_year, kpi, round(ratio, 6) AS ratio,
          rank() OVER (PARTITION BY kpi, report_year ORDER BY key) AS rank,
          round(percent_rank() OVER (PARTITION BY kpi, report_year ORDER BY key), 6) AS percentile,
          round(ratio - CASE WHEN lower_better THEN min(ratio) OVER (PARTITION BY kpi, report_year)
                             ELSE max(ratio) OVER (PARTITION BY kpi, report_year) END, 6) AS gap_to_leader
        FROM (SELECT r.*, c.lower_better, CASE WHEN c.lower_better THEN ratio ELSE -ratio END AS key
              FROM ratios r JOIN compared c USING (kpi))"""),
)
def _(spark, folder):
    return B.rank_entries(ratios(spark, folder).select("company_id", "report_year", "kpi", "ratio")).select(
        "company_id", "report_year", "kpi", F.round("ratio", 6).alias("ratio"), "rank",
        F.round("percentile", 6).alias("percentile"), F.round("gap_to_leader", 6).alias("gap_to_leader"),
    )


@query(
    "share_score",
    ratio_sql("""SELECT comparison_id, kpi, label, CASE WHEN total = 0 THEN 50 ELSE round_even(CASE WHEN lower_better
          THEN 100 * (1 - ratio / total) ELSE 100 * (ratio / total) END, 1) END AS score
        FROM (SELECT e.*, c.lower_better, sum(ratio) OVER (PARTITION BY comparison_id, kpi) AS total
              FROM entries e JOIN compared c USING (kpi))"""),
)
def _(spark, folder):
    return B.share_scores(entries(spark, folder)).select("comparison_id", "kpi", "label", "score")


@query(
    "comparable_filter",
    sql_with(["kpi_records", "companies"], """SELECT comparison_id, kpi, label, round(ratio, 6) AS ratio FROM entries
        WHERE (comparison_id, kpi) IN (SELECT (comparison_id, kpi) FROM entries LEFT JOIN dash USING (kpi) GROUP BY comparison_id, kpi
          HAVING bool_and(ratio >= 0 AND (ceiling IS NULL OR ratio <= ceiling)))""", ratio_ctes() + [ceilings("dashboard", "dash")]),
)
def _(spark, folder):
    return B.comparable(entries(spark, folder)).select("comparison_id", "kpi", "label", F.round("ratio", 6).alias("ratio"))


SCI = "replace(printf('%.4e', CAST({x} AS DOUBLE)), 'E', 'e')"


@query(
    "summary_lines",
    ratio_sql(f"""SELECT comparison_id, kpi, concat(split_part(winner, ' FY', 1), ' leads with ', {SCI.format(x='best')}, ' ', unit, ' (',
        printf('%.1f', CASE WHEN worst > 0 THEN abs(best - worst) / worst * 100 ELSE 0 END), '% better than ',
        split_part(loser, ' FY', 1), ').') AS line FROM comparisons"""),
)
def _(spark, folder):
    return B.comparison_lines(B.compare(entries(spark, folder))).select("comparison_id", "kpi", "line")


@query(
    "overall_lines",
    ratio_sql("""SELECT comparison_id, concat('Overall: ', split_part(label, ' FY', 1), ' has lower ESG intensity on ', wins, ' of ', m,
        ' metrics benchmarked.') AS line
        FROM (SELECT *, row_number() OVER (PARTITION BY comparison_id ORDER BY wins DESC, label) AS rn FROM wins)
        JOIN (SELECT comparison_id, count(*) AS m FROM comparisons GROUP BY 1) USING (comparison_id) WHERE rn = 1"""),
)
def _(spark, folder):
    rows = entries(spark, folder)
    compared = B.compare(rows)
    return B.overall_lines(B.win_counts(rows, compared), compared).select("comparison_id", "line")


@query(
    "fact_lines",
    ratio_sql(f"""SELECT company_id, report_year, kpi, concat(display_name, ': absolute=', format('{{:,.2f}}', normalized_value), ' ', normalized_unit,
        ' | intensity=', CASE WHEN ratio < 0.001 THEN {SCI.format(x='ratio')} ELSE printf('%.4f', ratio) END, ' ', ratio_unit, ' [computed]') AS line
        FROM ratios"""),
)
def _(spark, folder):
    return B.fact_lines(ratios(spark, folder)).select("company_id", "report_year", "kpi", "line")


@query(
    "ratio_format",
    ratio_sql(f"""SELECT company_id, report_year, kpi, CASE WHEN ratio = 0 THEN '0' WHEN abs(ratio) < 0.001 THEN {SCI.format(x='ratio')}
        WHEN abs(ratio) < 1 THEN printf('%.4f', ratio) ELSE format('{{:,.2f}}', ratio) END AS shown FROM ratios"""),
)
def _(spark, folder):
    return ratios(spark, folder).select("company_id", "report_year", "kpi", T.figure(F.col("ratio")).alias("shown"))


@query(
    "metric_table",
    sql_with(["kpi_records"], """SELECT company_id, report_year, kpi, coalesce(grp, '') AS "group", coalesce(label, kpi) AS metric,
        format('{:,.2f}', value) AS value, unit, method, concat(CAST(round_even(confidence * 100, 0) AS INT), '%') AS confidence
        FROM best LEFT JOIN groups USING (kpi)""",
             [CATALOGUE, ranges("store"), ("best", best_sql("store")), ("groups", table(L.DASHBOARD_GROUPS, "kpi, label, grp"))]),
)
def _(spark, folder):
    from gaugework.plans.jobs import metric_table

    return metric_table(best_records(spark, folder))


# --------------------------------------------------------------------------
# Guarded writes
# --------------------------------------------------------------------------
@query(
    "catalogue_upsert",
    sql_with(["kpi_records"], """SELECT coalesce(s.name, n.name) AS name, CASE WHEN s.name IS NOT NULL THEN 'kept ' || s.name ELSE n.display_name END AS display_name,
          CASE WHEN n.name IS NOT NULL THEN n.valid_max ELSE s.valid_max END AS valid_max,
          CASE WHEN n.name IS NOT NULL THEN n.n_patterns::INT ELSE 1 END AS patterns
        FROM (SELECT kpi AS name, max(value) AS valid_max FROM kpi_records WHERE value > 1000 GROUP BY 1
              UNION ALL SELECT concat('custom ', unit), max(value) FROM kpi_records WHERE unit IS NOT NULL AND value IS NOT NULL GROUP BY 1) s
        FULL JOIN catalogue n ON n.name = s.name""", [CATALOGUE]),
)
def _(spark, folder):
    records = frame(spark, folder, "kpi_records").filter(F.col("value").isNotNull())
    by_kpi = records.filter("value > 1000").groupBy(F.col("kpi").alias("name")).agg(F.max("value").alias("valid_max"))
    by_unit = (
        records.filter(F.col("unit").isNotNull())
        .groupBy(F.concat(F.lit("custom "), F.col("unit")).alias("name")).agg(F.max("value").alias("valid_max"))
    )
    stored = by_kpi.unionByName(by_unit).select(
        "name", F.concat(F.lit("kept "), F.col("name")).alias("display_name"), "valid_max",
        F.array(F.lit("x")).alias("regex_patterns"),
    )
    # A custom metric is unknown to the catalogue, so its display name stays its own.
    merged = S.upsert_catalogue(stored, S.catalogue_frame(spark))
    return merged.select("name", "display_name", "valid_max", F.size("regex_patterns").alias("patterns"))


@query(
    "company_upsert",
    sql_with(["companies"], """SELECT company_name FROM (SELECT upper(c_name) AS company_name FROM customer) w
        WHERE NOT EXISTS (SELECT 1 FROM companies c WHERE lower(c.company_name) = lower(w.company_name))"""),
)
def _(spark, folder):
    wanted = frame(spark, folder, "customer").select(F.upper("c_name").alias("company_name"))
    return S.companies_to_add(wanted, frame(spark, folder, "companies"))


REGISTER = """SELECT company_id, source_url, report_id, report_type, report_year, 'discovered' AS status FROM (
    SELECT *, row_number() OVER (PARTITION BY company_id, source_url ORDER BY score DESC, report_type, report_year) AS rn FROM (
      SELECT * FROM reports n WHERE status <> 'downloaded' AND NOT EXISTS (SELECT 1 FROM reports s WHERE s.status = 'downloaded'
        AND s.company_id = n.company_id AND s.source_url = n.source_url))) WHERE rn = 1"""


@query("register_reports", sql_with(["reports"], REGISTER))
def _(spark, folder):
    reports = frame(spark, folder, "reports")
    return S.reports_to_add(
        reports.filter("status <> 'downloaded'"), reports.filter("status = 'downloaded'")
    ).select("company_id", "source_url", "report_id", "report_type", "report_year", "status")


@query(
    "dedup_store",
    sql_with(["kpi_records"], """SELECT DISTINCT company_id, report_id, kpi, report_year, value FROM kpi_records k
        LEFT JOIN ranges USING (kpi)
        WHERE value IS NOT NULL AND (lo IS NULL OR value BETWEEN lo AND hi) AND extraction_method = 'llm'
          AND NOT EXISTS (SELECT 1 FROM kpi_records s WHERE s.extraction_method = 'regex' AND s.company_id = k.company_id
            AND s.report_id = k.report_id AND s.kpi = k.kpi AND s.report_year = k.report_year AND s.value = k.value)""",
             [ranges("store")]),
)
def _(spark, folder):
    records = frame(spark, folder, "kpi_records")
    kept = R.storable(
        records.filter("extraction_method = 'llm'"), records.filter("extraction_method = 'regex'")
    )
    return kept.select("company_id", "report_id", "kpi", "report_year", "value")


@query(
    "revenue_fill",
    sql_with(["reports"], """SELECT report_id, coalesce(revenue_cr, o_totalprice) AS revenue_cr,
          CASE WHEN revenue_cr IS NULL THEN 'INR_Crore' ELSE revenue_unit END AS revenue_unit,
          CASE WHEN revenue_cr IS NULL THEN 'block' ELSE revenue_source END AS revenue_source
        FROM reports JOIN orders ON o_orderkey = report_id"""),
)
def _(spark, folder):
    found = frame(spark, folder, "orders").select(
        F.col("o_orderkey").alias("report_id"), F.col("o_totalprice").alias("value_cr"),
        F.lit("INR_Crore").alias("raw_unit"), F.lit("block").alias("source"),
    )
    return R.fill_revenue(frame(spark, folder, "reports"), found).select(
        "report_id", "revenue_cr", "revenue_unit", "revenue_source"
    )


@query(
    "parse_replace",
    sql_with(["parsed_documents"], """SELECT * FROM parsed_documents WHERE parser_version <> 'v1'
        UNION ALL SELECT * REPLACE (page_count + 1 AS page_count) FROM parsed_documents WHERE parser_version = 'v1'"""),
)
def _(spark, folder):
    stored = frame(spark, folder, "parsed_documents")
    new = stored.filter("parser_version = 'v1'").withColumn("page_count", F.col("page_count") + 1)
    return S.replace_parse(stored, new)


@query(
    "status_current",
    """SELECT l_orderkey AS report_id, arg_max(status, (ts, stage)) AS status, max(ts) AS changed_at, count(*) AS changes
       FROM (SELECT l_orderkey, l_shipdate AS ts, CASE l_linenumber % 5 WHEN 0 THEN 'discovered' WHEN 1 THEN 'downloading' WHEN 2 THEN 'failed'
               WHEN 3 THEN 'downloaded' ELSE 'parsed' END AS status, l_linenumber % 5 + 1 AS stage FROM lineitem) GROUP BY 1""",
)
def _(spark, folder):
    names = ("discovered", "downloading", "failed", "downloaded", "parsed")
    status = F.get(F.array(*[F.lit(n) for n in names]), F.col("l_linenumber") % 5)
    events = frame(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("report_id"), F.col("l_shipdate").alias("ts"), status.alias("status")
    )
    return S.current_status(events)


@query(
    "typed_records",
    sql_with(["kpi_records"], """SELECT record_id AS id, CAST(company_id AS VARCHAR) AS company_id, CAST(report_id AS VARCHAR) AS report_id,
        kpi AS kpi_definition_id, report_year, CAST(NULL AS VARCHAR) AS raw_value, value AS normalized_value, unit, extraction_method, confidence,
        CAST(NULL AS VARCHAR) AS source_chunk_id, is_validated, CAST(NULL AS VARCHAR) AS validation_notes, extracted_at FROM kpi_records"""),
)
def _(spark, folder):
    renamed = frame(spark, folder, "kpi_records").withColumnsRenamed(
        {"record_id": "id", "value": "normalized_value", "kpi": "kpi_definition_id"}
    )
    return S.conform(renamed, "kpi_records")


@query(
    "embedding_coverage",
    sql_with(["reports", "companies"], """SELECT company_name, report_year, count(*) AS total, count(*) FILTER (l_discount > 0.05) AS embedded,
          round_even(100.0::DOUBLE * count(*) FILTER (l_discount > 0.05) / count(*), 1) AS percent,
          CASE WHEN count(*) FILTER (l_discount > 0.05) = count(*) THEN 'ready' WHEN count(*) FILTER (l_discount > 0.05) > 0 THEN 'partial'
               ELSE 'not embedded' END AS state
        FROM lineitem JOIN reports ON report_id = l_orderkey JOIN companies USING (company_id) GROUP BY 1, 2"""),
)
def _(spark, folder):
    chunks = frame(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("report_id"), (F.col("l_discount") > 0.05).alias("is_embedded")
    )
    joined = chunks.join(frame(spark, folder, "reports").select("report_id", "company_id", "report_year"), "report_id").join(
        frame(spark, folder, "companies").select("company_id", "company_name"), "company_id"
    )
    return X.coverage(joined, ["company_name", "report_year"])


@query(
    "embedding_coverage_doc",
    """SELECT l_orderkey AS doc_id, count(*) AS total, count(*) FILTER (l_discount > 0.05) AS embedded,
          round_even(100.0::DOUBLE * count(*) FILTER (l_discount > 0.05) / count(*), 1) AS percent,
          CASE WHEN count(*) FILTER (l_discount > 0.05) = count(*) THEN 'ready' WHEN count(*) FILTER (l_discount > 0.05) > 0 THEN 'partial'
               ELSE 'not embedded' END AS state
        FROM lineitem GROUP BY 1""",
)
def _(spark, folder):
    chunks = frame(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_discount") > 0.05).alias("is_embedded")
    )
    return X.coverage(chunks, ["doc_id"])


@query(
    "embedding_sink",
    """SELECT vec_id AS chunk_index, (label % 2 = 0) OR (vec_id % 7 <> 0) AS is_embedded,
          CASE WHEN label % 2 = 0 THEN 1 WHEN vec_id % 7 <> 0 THEN len(embedding) END AS dimension,
          CASE WHEN label % 2 = 0 THEN 0 WHEN vec_id % 7 <> 0 THEN CAST(list_sum(
            [i * CAST(round(CAST(embedding[i] AS DOUBLE) * 1000000) AS BIGINT) FOR i IN range(1, len(embedding) + 1)]) AS BIGINT) END AS weighted
        FROM embeddings""",
)
def _(spark, folder):
    vectors = frame(spark, folder, "embeddings").select(
        F.col("label").alias("doc_id"), F.col("vec_id").alias("chunk_index"),
        F.when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 10)).otherwise(F.col("embedding")).alias("new_vector"),
    )
    chunks = frame(spark, folder, "embeddings").select(
        F.col("label").alias("doc_id"), F.col("vec_id").alias("chunk_index"),
        (F.col("label") % 2 == 0).alias("is_embedded"),
        F.when(F.col("label") % 2 == 0, F.array(F.lit(0.0).cast("float"))).alias("embedding"),
    )
    stored = S.apply_vectors(chunks, vectors, 64)
    whole = F.transform("embedding", lambda x, i: (i + 1) * F.round(x.cast("double") * 1000000).cast("long"))
    return stored.select(
        "chunk_index", "is_embedded", F.when(F.col("embedding").isNotNull(), F.size("embedding").cast("long")).alias("dimension"),
        F.aggregate(whole, F.lit(0).cast("long"), lambda total, x: total + x).alias("weighted"),
    )
