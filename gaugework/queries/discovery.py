"""Search results, registration and download choices."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugework.functions import text as T
from gaugework.operators import discovery as D
from gaugework.operators import ingestion as I
from gaugework.plans import jobs as J
from gaugework.queries.registry import literals, query, table, text
from gaugework.queries.views import frame, sql_with
from gaugework.rules import discovery as R
from gaugework.rules import limits as L

_TEMPLATES = ("templates", table(R.TEMPLATES, "query_type, template"))


def results(spark, folder):
    return frame(spark, folder, "search_results").withColumn("score", D.position_score(F.col("position")))


@query(
    "query_expansion",
    sql_with(["reports", "companies"], """SELECT company_id, report_year, company_name, query_type, replace(replace(replace(template, '{company}', company_name),
          '{past_year}', CAST(report_year - 1 AS VARCHAR)), '{year_short}', right(CAST(report_year AS VARCHAR), 2)) AS query_source
        FROM (SELECT DISTINCT company_id, report_year FROM reports) JOIN companies USING (company_id), templates""", [_TEMPLATES]),
)
def _(spark, folder):
    years = frame(spark, folder, "reports").select("company_id", "report_year").distinct()
    named = years.join(frame(spark, folder, "companies").select("company_id", "company_name"), "company_id")
    return D.expand_queries(named)


SCORED = "SELECT *, round_even(1.0::DOUBLE / greatest(position, 1), 4) AS score FROM search_results"
UNIQUE = """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY company_id, report_year, url ORDER BY score DESC, seq) AS rn
    FROM scored) WHERE rn = 1"""
_STOP = f"[{literals(R.NAME_STOP_WORDS)}]"
_ALIASES = ("aliases", table([(k, list(v)) for k, v in R.NAME_ALIASES.items()], "slug, other"))
TOKENS = f"""SELECT *, list_distinct(list_concat([trim(lower(company_name))], coalesce(other, CAST([] AS VARCHAR[])),
      list_filter(ws, lambda w: length(w) >= 5), list_filter(list_transform(range(1, len(ws)), lambda i: concat(ws[i], ' ', ws[i + 1])), lambda p: length(p) >= 6))) AS tokens,
    lower(title) AS titled, regexp_replace(replace(regexp_replace(regexp_replace(lower(url), '^[a-z][a-z0-9+.\\-]*://', ''), '[?#].*$', ''), 'www.', ''), '[^a-z0-9]', '', 'g') AS bare,
    lower(concat_ws(' ', title, snippet, url)) AS words
  FROM (SELECT *, list_filter(list_transform(regexp_split_to_array(lower(company_name), '[\\s&.,/()\\-]+'), lambda w: regexp_replace(w, '^[.,()&\\-]+|[.,()&\\-]+$', '', 'g')),
          lambda w: w <> '' AND NOT list_contains({_STOP}, w)) AS ws FROM uniq)
  LEFT JOIN aliases ON slug = regexp_replace(lower(company_name), '[^a-z0-9]', '', 'g')"""
_KIND = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(words, {text(w)})" for w in wording) + f" THEN '{kind}'" for kind, wording in R.TYPE_WORDING
) + " END"
JUDGED = f"""SELECT *, coalesce(company_ok AND year_ok AND detected_type = query_type, FALSE) AS passed FROM (
  SELECT *, len(list_filter(tokens, lambda t: (t <> '' AND contains(titled, t)) OR (length(t) >= 5 AND regexp_replace(t, '[^a-z0-9]', '', 'g') <> ''
        AND contains(bare, regexp_replace(t, '[^a-z0-9]', '', 'g'))))) > 0 AS company_ok,
    NOT (contains(words, concat(y, '-', right(a, 2))) OR contains(words, concat(y, '-', a)) OR contains(words, concat('fy', a))
         OR contains(words, concat('fy', right(a, 2))) OR contains(words, a))
    AND (contains(words, concat(p, '-', right(y, 2))) OR contains(words, concat(p, '_', y)) OR contains(words, concat(p, '–', right(y, 2)))
         OR contains(words, concat('fy', y)) OR contains(words, concat('fy', right(y, 2)))
         OR contains(regexp_replace(words, concat(y, '-(0[1-9]|1[0-2])-([0-2][0-9]|3[01])'), '', 'g'), y)) AS year_ok,
    {_KIND} AS detected_type
  FROM (SELECT *, CAST(report_year AS VARCHAR) AS y, CAST(report_year - 1 AS VARCHAR) AS p, CAST(report_year + 1 AS VARCHAR) AS a FROM tokenised))"""
DISCOVERY = [_ALIASES, ("scored", SCORED), ("uniq", UNIQUE), ("tokenised", TOKENS), ("judged", JUDGED)]


def discovery_sql(body: str, extra=()) -> str:
    return sql_with(["search_results"], body, [*DISCOVERY, *extra])


@query("url_dedup", discovery_sql("SELECT company_id, report_year, url, score, seq FROM uniq"))
def _(spark, folder):
    return D.best_per_url(results(spark, folder)).select("company_id", "report_year", "url", "score", "seq")


@query("discovery_filter", discovery_sql("SELECT seq, url, company_ok, year_ok, detected_type, query_type, passed FROM judged"))
def _(spark, folder):
    judged = D.judge_results(D.best_per_url(results(spark, folder)))
    return judged.select("seq", "url", "company_ok", "year_ok", "detected_type", "query_type", "passed")


@query(
    "discovery_summary",
    discovery_sql("""SELECT company_id, report_year, count(*) AS unique_results, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS dropped,
        count(*) FILTER (passed AND query_type = 'Integrated') AS integrated_count, count(*) FILTER (passed AND query_type = 'ESG') AS esg_count
        FROM judged GROUP BY 1, 2"""),
)
def _(spark, folder):
    return D.discovery_summary(D.judge_results(D.best_per_url(results(spark, folder))))


@query("discovered_reports", discovery_sql("SELECT company_id, report_year, query_type, url, score FROM judged WHERE passed AND query_type IN ('Integrated', 'ESG')"))
def _(spark, folder):
    return D.discovered(results(spark, folder)).select("company_id", "report_year", "query_type", "url", "score")


_ORDER = "ORDER BY score DESC, report_id"
NEXT = f"""SELECT company_id, report_year, report_type, report_id FROM (
    SELECT *, row_number() OVER (PARTITION BY company_id, report_year, report_type {_ORDER}) AS rn FROM reports r
    WHERE status NOT IN ('downloaded', 'failed') AND NOT EXISTS (SELECT 1 FROM reports d WHERE d.status = 'downloaded'
      AND d.company_id = r.company_id AND d.report_year = r.report_year AND d.report_type = r.report_type)) WHERE rn = 1"""


@query(
    "download_choice",
    sql_with(["reports"], f"""SELECT company_id, report_year, report_type, report_id FROM (SELECT *, row_number() OVER (
        PARTITION BY company_id, report_year, report_type {_ORDER}) AS rn FROM reports WHERE status = 'downloaded') WHERE rn = 1"""),
)
def _(spark, folder):
    return D.chosen_downloads(frame(spark, folder, "reports")).select("company_id", "report_year", "report_type", "report_id")


@query("download_candidates", sql_with(["reports"], NEXT))
def _(spark, folder):
    return D.next_downloads(frame(spark, folder, "reports")).select("company_id", "report_year", "report_type", "report_id")


@query(
    "retry_next",
    sql_with(["reports"], """SELECT company_id, report_year, report_id, status FROM (SELECT *, row_number() OVER (
        PARTITION BY company_id, report_year ORDER BY discovered_at, report_id) AS rn FROM reports WHERE status IN ('discovered', 'failed')) WHERE rn = 1"""),
)
def _(spark, folder):
    return D.retry_candidates(frame(spark, folder, "reports")).select("company_id", "report_year", "report_id", "status")


@query(
    "first_registered",
    sql_with(["reports"], f"""SELECT company_id, report_year, report_type, report_id FROM (SELECT *, row_number() OVER (
        PARTITION BY company_id, report_year, report_type {_ORDER}) AS rn FROM reports) WHERE rn <= 2"""),
)
def _(spark, folder):
    return D.first_registered(frame(spark, folder, "reports"), 2).select("company_id", "report_year", "report_type", "report_id")


@query(
    "file_names",
    sql_with(["reports", "companies"], """SELECT report_id, concat(report_year, '_', upper(report_type), '_',
        left(regexp_replace(regexp_replace(lower(concat(company_name, ' & Sons Ltd.')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 40), '_',
        left(CAST(report_id AS VARCHAR), 8), '.pdf') AS file_name FROM reports JOIN companies USING (company_id)"""),
)
def _(spark, folder):
    named = frame(spark, folder, "reports").join(frame(spark, folder, "companies"), "company_id")
    return named.select(
        "report_id",
        T.file_name(F.col("report_year"), F.col("report_type"), F.concat("company_name", F.lit(" & Sons Ltd.")), F.col("report_id")).alias("file_name"),
    )


@query(
    "ingest_registration",
    discovery_sql("""SELECT company_id, source_url, report_type, report_year, status FROM (
        SELECT company_id, url AS source_url, query_type AS report_type, report_year, 'discovered' AS status,
          row_number() OVER (PARTITION BY company_id, url ORDER BY score DESC, query_type, report_year) AS rn
        FROM judged WHERE passed AND query_type IN ('Integrated', 'ESG')) WHERE rn = 1"""),
)
def _(spark, folder):
    plan = J.ingest_plan(results(spark, folder), frame(spark, folder, "companies"), frame(spark, folder, "reports"))
    return plan["reports"].select("company_id", "source_url", "report_type", "report_year", "status")


# --------------------------------------------------------------------------
# The status log and what came of each type
# --------------------------------------------------------------------------
_EVENTS = """SELECT l_orderkey AS report_id, l_shipdate AS ts, CASE l_linenumber % 5 WHEN 0 THEN 'discovered' WHEN 1 THEN 'downloading'
    WHEN 2 THEN 'failed' WHEN 3 THEN 'downloaded' ELSE 'parsed' END AS status, l_linenumber % 5 AS stage FROM lineitem"""
_ALLOWED = ("allowed_", table([(f"{a}>{b}",) for a, nexts in L.STATUS_CHANGES.items() for b in nexts], "change"))
_CHANGES = [
    ("events_", _EVENTS), _ALLOWED,
    ("placed", """SELECT *, row_number() OVER w - 1 AS change_no, lag(status) OVER w AS before FROM events_
        WINDOW w AS (PARTITION BY report_id ORDER BY ts, stage)"""),
    ("changes_", "SELECT *, concat(coalesce(before, 'none'), '>', status) AS what, concat(coalesce(before, 'none'), '>', status) IN (SELECT change FROM allowed_) AS allowed FROM placed"),
]


def events(spark, folder):
    """A status log made of the order lines: their number says which status, their date when."""
    status = F.get(F.array(*[F.lit(n) for n in L.STATUS_ORDER]), F.col("l_linenumber") % 5)
    return frame(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("report_id"), F.col("l_shipdate").alias("ts"), status.alias("status")
    )


@query("status_changes", sql_with([], "SELECT report_id, change_no, ts, before, status, allowed FROM changes_", _CHANGES))
def _(spark, folder):
    return I.judged_changes(events(spark, folder))


@query(
    "status_fold",
    sql_with([], """SELECT report_id, arg_max(status, change_no) AS status, count(*) AS changes, count(*) FILTER (NOT allowed) AS refused,
        arg_min(what, change_no) FILTER (NOT allowed) AS first_refused FROM changes_ GROUP BY 1""", _CHANGES),
)
def _(spark, folder):
    return I.folded(events(spark, folder))


@query(
    "ingest_outcomes",
    sql_with(["reports"], f"""SELECT company_id, report_year, report_type, coalesce(candidates, 0) AS candidates, coalesce(failed, 0) AS failed, report_id,
          CASE WHEN candidates IS NULL THEN 'not_found' WHEN report_id IS NOT NULL THEN 'downloaded' WHEN candidates = failed THEN 'failed' ELSE 'open' END AS outcome
        FROM (SELECT *, unnest([{literals(L.REPORT_KINDS)}]) AS report_type FROM (SELECT DISTINCT company_id, report_year FROM reports))
        LEFT JOIN (SELECT company_id, report_year, report_type, count(*) AS candidates, count(*) FILTER (status = 'failed') AS failed FROM reports GROUP BY 1, 2, 3)
          USING (company_id, report_year, report_type)
        LEFT JOIN (SELECT company_id, report_year, report_type, report_id FROM (SELECT *, row_number() OVER (PARTITION BY company_id, report_year, report_type
            ORDER BY score DESC, report_id) AS rn FROM reports WHERE status IN ('downloaded', 'parsed', 'extracted')) WHERE rn = 1)
          USING (company_id, report_year, report_type)"""),
)
def _(spark, folder):
    reports = frame(spark, folder, "reports")
    return I.type_outcomes(reports, reports)


@query(
    "ingest_companies",
    sql_with(["search_results", "companies"], """SELECT arg_min(company_name, company_name) AS company_name FROM search_results s
        WHERE company_name IS NOT NULL AND NOT EXISTS (SELECT 1 FROM companies c WHERE lower(c.company_name) = lower(s.company_name)) GROUP BY lower(company_name)"""),
)
def _(spark, folder):
    plan = J.ingest_plan(results(spark, folder), frame(spark, folder, "companies"), frame(spark, folder, "reports"))
    return plan["companies"]
