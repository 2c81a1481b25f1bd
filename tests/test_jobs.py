"""Whole jobs on a few made-up reports."""

import datetime

from gaugework.operators import ingestion as I
from gaugework.plans import jobs as J
from gaugework.sources import store

DAY = datetime.date(2024, 5, 1)
REPORTS = (
    "report_id long, company_id long, report_year int, report_type string, status string, revenue_cr double, revenue_unit string, "
    "revenue_source string, file_path string, created_at date"
)
RECORDS = (
    "record_id string, company_id long, report_id long, report_year int, kpi string, value double, unit string, "
    "extraction_method string, confidence double, extracted_at date"
)
PAGES = "report_id long, page_number long, text string"
STATED = "Energy intensity per rupee of turnover\n0.000000076 as reported"


def report(number, company, revenue=5000.0, kind="BRSR", path="/r.pdf"):
    return (number, company, 2024, kind, "parsed", revenue, None, None, path, DAY)


def record(name, company, report_id, kpi, value, unit):
    return (name, company, report_id, 2024, kpi, value, unit, "regex", 0.9, DAY)


def years(spark, reports, records, extracted, pages, targets):
    made = J.process_company_years(
        spark.createDataFrame(records, RECORDS), spark.createDataFrame(reports, REPORTS),
        spark.createDataFrame(extracted, RECORDS), spark.createDataFrame(pages, PAGES), targets,
    )
    return {(r["company_id"], r["kpi"]): (round(r["ratio"], 9), r["ratio_source"]) for r in made.collect()}


def test_a_stated_ratio_is_judged_on_the_canonical_value(spark):
    reports = [report(k, k) for k in (1, 2, 3)] + [report(4, 4, revenue=None), report(5, 5, path=None)]
    # 20 million kWh are 72 000 GJ: only the canonical value implies a believable revenue
    records = [
        record("a", 1, 1, "energy_consumption", 2e7, "kWh"), record("b", 2, 2, "energy_consumption", 2e7, "GJ"),
        record("c", 3, 3, "energy_consumption", 9e4, ""), record("d", 4, 4, "energy_consumption", 9e4, "GJ"),
        record("e", 5, 5, "energy_consumption", 9e4, "GJ"), record("f", 3, 3, "scope_1_emissions", 100.0, "tCO2e"),
    ]
    pages = [(k, 1, STATED) for k in (1, 2, 3, 4, 5)]
    found = years(spark, reports, records, [], pages, ("energy_consumption", "scope_1_emissions"))
    assert found[(1, "energy_consumption")] == (0.76, "reported_ratio")
    assert (2, "energy_consumption") not in found
    assert found[(3, "energy_consumption")] == (0.76, "reported_ratio")
    assert found[(4, "energy_consumption")] == (0.76, "reported_ratio")
    assert found[(5, "energy_consumption")] == (18.0, "computed")
    assert found[(3, "scope_1_emissions")] == (0.02, "computed")


def test_from_chunks_to_company_years_and_again(spark):
    reports = spark.createDataFrame([report(1, 1), report(2, 1, kind="ESG"), report(3, 2)], REPORTS)
    stored = spark.createDataFrame([record("a", 2, 3, "scope_1_emissions", 700.0, "tCO2e")], RECORDS)
    texts = [
        (1, "Total Scope 1 emissions (Break-up of the GHG into CO2) in Metric tonnes of 21,949 as assured"),
        (2, "Total Scope 1 emissions (Break-up of the GHG into CO2) in Metric tonnes of 31,949 as assured"),
        (3, "Total Scope 1 emissions (Break-up of the GHG into CO2) in Metric tonnes of 41,949 as assured"),
    ]
    blocks = spark.createDataFrame(
        [(d, 1, "text", t, 0) for d, t in texts], "doc_id long, page_number int, chunk_type string, content string, block_key int"
    )
    chunks = J.C.chunk_documents(blocks, ["block_key"])
    pages = spark.createDataFrame([(1, 1, "no ratio here")], PAGES)
    root = store.new_folder(spark, "jobs")
    first, second = (
        sorted(
            (r["company_id"], r["kpi"], r["normalized_value"])
            for r in J.company_years_from_reports(chunks, pages, stored, reports, root, "run-1").collect()
        )
        for _ in range(2)
    )
    # a stored value stays; a gap is filled from the report that comes first by type
    assert (2, "scope_1_emissions", 700.0) in first
    assert (1, "scope_1_emissions", 21949.0) in first
    assert first == second
    log = store.read_log(spark, root, J.LOGGED)
    assert log.filter("kpi = 'scope_1_emissions'").count() == 3


def test_status_log_against_a_plain_loop(spark):
    names = ("discovered", "downloading", "failed", "downloaded", "parsed", "lost")
    rows = [(k % 7, k * k % 50, names[(k * k + k // 3) % 6]) for k in range(400)]
    # one report with most of the events, in the allowed order over and over
    rows += [(99, k, ("downloading", "failed")[k % 2]) for k in range(2000)]
    order = {s: i for i, s in enumerate(names[:5])}
    log, expected = {}, {}
    for report_id, ts, status in rows:
        log.setdefault(report_id, []).append((ts, order.get(status, -1), status))
    for report_id, changes in log.items():
        before, refused = "none", []
        for _, _, status in sorted(changes):
            if status not in I.L.STATUS_CHANGES.get(before, ()):
                refused.append(f"{before}>{status}")
            before = status
        expected[report_id] = (before, len(changes), len(refused), refused[0] if refused else None)
    found = I.folded(spark.createDataFrame(rows, "report_id long, ts long, status string"))
    assert {r["report_id"]: (r["status"], r["changes"], r["refused"], r["first_refused"]) for r in found.collect()} == expected
    assert expected[99][2:] == (1, "none>downloading")


def test_outcomes_of_report_types(spark):
    rows = [
        (1, 1, 2024, "ESG", "failed", 0.9), (2, 1, 2024, "ESG", "downloaded", 0.5), (3, 1, 2024, "ESG", "parsed", 0.7),
        (4, 1, 2024, "BRSR", "failed", 0.9), (5, 2, 2024, "BRSR", "discovered", None), (6, 2, 2024, "Other", "parsed", 0.1),
    ]
    reports = spark.createDataFrame(rows, "report_id long, company_id long, report_year int, report_type string, status string, score double")
    found = {(r["company_id"], r["report_type"]): (r["outcome"], r["report_id"], r["failed"]) for r in I.type_outcomes(reports, reports).collect()}
    assert found == {
        (1, "ESG"): ("downloaded", 3, 1), (1, "BRSR"): ("failed", None, 1), (1, "Integrated"): ("not_found", None, 0),
        (2, "BRSR"): ("open", None, 0), (2, "ESG"): ("not_found", None, 0), (2, "Integrated"): ("not_found", None, 0),
    }
    assert I.type_outcomes(reports.limit(0), reports).count() == 0
