import pytest
from pyspark.sql import functions as F

from gaugework.functions import text as T
from gaugework.functions import units as U
from gaugework.operators import benchmark as B
from gaugework.operators import discovery as D
from gaugework.operators import extraction as X
from gaugework.operators import records as R
from gaugework.operators import revenue as N
from gaugework.operators.groups import with_offsets, with_rank

FOUND = "doc_id long, kpi string, chunk_index long, position int, chunk_type string, content string"


@pytest.mark.parametrize(
    "kpi, value, unit, expected",
    [
        ("energy_consumption", 10.0, "GWh", (36000.0, "GJ", None)),
        ("scope_1_emissions", 5.0, "mt co2e", (5e6, "tCO2e", None)),
        ("waste_generated", 3.0, "Metric Tonnes", (3.0, "MT", None)),
        ("women_in_workforce_percentage", 120.0, "%", (None, None, "percentage out of range")),
        ("water_consumption", 1.0, "furlong", (None, None, "unknown unit")),
        ("mystery", 1.0, "x", (None, None, "unknown category")),
    ],
)
def test_units(spark, kpi, value, unit, expected):
    df = spark.createDataFrame([(kpi, value, unit)], "k string, v double, u string")
    n = df.select(U.normalised(F.col("k"), F.col("v"), F.col("u")).alias("n")).first()["n"]
    assert (n["value"], n["unit"], n["error"]) == expected


@pytest.mark.parametrize(
    "kpi, kind, content, value, confidence",
    [
        ("complaints_filed", "text", "Employees and workers HEAR@example.com, GRB@example.com 180 19", 180.0, 0.85),
        ("complaints_pending", "table", "Employees and workers HEAR@example.com, GRB@example.com 180 19", 19.0, 0.88),
        (
            "scope_3_emissions", "text",
            "Total Scope 3 emissions (Break-up of the GHG into CO2, Metric tonnes of CO2\n     1,80,737   1,83,976 (2)\nCH4, N2O) equivalent",
            180737.0, 0.88,
        ),
        ("renewable_energy_percentage", "text", "We get 67.52% of electricity for\n     our India operations from renewable", 67.52, 0.88),
    ],
)
def test_block_patterns(spark, kpi, kind, content, value, confidence):
    found = spark.createDataFrame([(1, kpi, 0, 1, kind, content)], FOUND)
    hit = X.block_hits(found).first()["hit"]
    assert (hit["value"], hit["confidence"]) == (value, confidence)
    if kpi == "scope_3_emissions":
        assert hit["pos"] == 2


def test_a_target_is_not_a_total(spark):
    found = spark.createDataFrame(
        [(1, "scope_1_emissions", 0, 1, "text", "We reduced scope 1 emissions by 16,187 tCO2e compared to FY2019.")], FOUND
    )
    assert X.cascade(found).count() == 0


def test_the_first_sure_hit_wins_over_a_later_better_one(spark):
    block = "Total Scope 1 emissions in Metric tonnes of {} as assured"
    found = spark.createDataFrame(
        [
            (1, "scope_1_emissions", 5, 1, "text", "Scope 1 emissions were 11,111 tCO2e"),
            (1, "scope_1_emissions", 6, 2, "text", block.format("22,222")),
            (1, "scope_1_emissions", 7, 3, "text", block.format("33,333")),
        ],
        FOUND,
    )
    assert X.cascade(found).first()["value"] == 22222.0


def test_model_answers(spark):
    rows = [
        ("scope_1_emissions", '```json\n{"value": 5, "unit": "Million tonnes CO2e", "confidence": 0.9, "notes": None,}\n```'),
        ("scope_1_emissions", 'Sure: {"value": 20000, "unit": "million tonnes CO2e", "confidence": 0.9}'),
        ("scope_1_emissions", '{"value": None, "confidence": 0.9}'),
        ("scope_1_emissions", "no idea"),
    ]
    df = spark.createDataFrame(rows, "kpi string, text string")
    assert sorted(r["value"] for r in X.response_values(df).collect()) == [20000.0, 5e6]


def pages(spark, *texts):
    return spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(texts)], "report_id long, page_number long, text string")


def test_revenue_stated_in_four_columns(spark):
    page = "Consolidated and Standalone\nRevenue from operations 2,14,853 2,02,359 2,55,324 2,40,893"
    rows = N.stated_revenue(N.revenue_pages(pages(spark, page))).collect()
    hit = next(r for r in rows if r["pattern_name"] == "consolidated_col3")
    assert hit["value_cr"] == 255324.0 and round(hit["confidence"], 2) == 0.93


@pytest.mark.parametrize(
    "page, value",
    [
        ("Total energy consumption (A+B+C)\n7,50,986\nEnergy intensity per rupee of turnover\n5.11", 146964.0),
        ("Total energy consumed (A+B)\n1,94,09,26,732\nEnergy intensity per rupee of turnover\n0.000760", 255385.0),
    ],
)
def test_revenue_worked_back(spark, page, value):
    row = N.backed_revenue(N.revenue_pages(pages(spark, page))).first()
    assert (row["value_cr"], row["confidence"]) == (value, 0.91)


def test_all_intensities_of_a_page_are_used(spark):
    page = "x" * 50 + "\nTotal energy consumed\n7,50,986\nintensity per rupee of turnover\n5.11\nand intensity per rupee of turnover\n6.00 end"
    assert N.backed_revenue(N.revenue_pages(pages(spark, page))).count() == 2


def test_revenue_consensus(spark):
    schema = "report_id long, page_number long, value_cr double, raw_value string, source string, pattern_name string, confidence double, seq long"
    back = [(1, 1, v, "", "back_calc", "b", c, i) for i, (v, c) in enumerate([(100000.0, 0.91), (102000.0, 0.85), (150000.0, 0.78)])]
    row = N.pick_revenue(spark.createDataFrame(back, schema)).first()
    assert (row["value_cr"], round(row["confidence"], 2), row["pattern_name"]) == (101000.0, 0.94, "consensus_2")


RECORDS = "record_id string, company_id long, report_id long, report_year int, kpi string, value double, unit string, extraction_method string, confidence double, extracted_at timestamp"


def test_the_gate_follows_the_pick(spark):
    records = spark.sql(
        "SELECT 'a' record_id, 1L company_id, 1L report_id, 2025 report_year, 'scope_1_emissions' kpi, 10D value, 'tCO2e' unit, "
        "'regex' extraction_method, 0.30D confidence, timestamp'2025-01-02' extracted_at UNION ALL "
        "SELECT 'b', 1L, 2L, 2025, 'scope_1_emissions', 20D, 'tCO2e', 'regex', 0.90D, timestamp'2025-01-01'"
    )
    reports = spark.createDataFrame([(1, "Integrated"), (2, "BRSR")], "report_id long, report_type string")
    assert R.best_per_key(records, reports).count() == 0
    assert R.best_per_key(records, reports, gate_first=True).first()["value"] == 20.0


def test_winner_and_gap(spark):
    entries = spark.createDataFrame(
        [("x", "scope_1_emissions", "A FY2025", 2.0), ("x", "scope_1_emissions", "B FY2025", 4.0)],
        "comparison_id string, kpi string, label string, ratio double",
    )
    row = B.compare(entries).first()
    assert (row["winner"], row["loser"], row["pct_gap"]) == ("A FY2025", "B FY2025", 50.0)
    assert {r["label"]: r["score"] for r in B.share_scores(entries).collect()} == {"A FY2025": 66.7, "B FY2025": 33.3}


@pytest.mark.parametrize(
    "text, ok",
    [
        ("annual report 2024-25", True), ("fy25", True), ("2025-26", False),
        ("http://x/RR/2025-10-31", False), ("report 2025", True), ("2024", False),
    ],
)
def test_fiscal_year(spark, text, ok):
    df = spark.createDataFrame([(text, 2025)], "t string, y int")
    assert df.select(D.year_matches(F.col("t"), F.col("y")).alias("x")).first()["x"] is ok


@pytest.mark.parametrize(
    "text, kind", [("Sustainability report 2025", "ESG"), ("annual-report", "Integrated"), ("esg index fund", None), ("BRSR filing", None)]
)
def test_report_type(spark, text, kind):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(D.report_type(F.col("t")).alias("x")).first()["x"] == kind


def test_company_tokens(spark):
    df = spark.createDataFrame([("L&T Finance Holdings",), ("TCS",)], "n string")
    tokens = [r["t"] for r in df.select(D.name_tokens(F.col("n")).alias("t")).collect()]
    assert tokens[0] == ["l&t finance holdings", "finance", "t finance"]
    assert tokens[1] == ["tcs", "tata consultancy", "tcs.com"]


def test_rank_equals_the_window_function(spark):
    rows = [("k", i % 3, float((i * 37) % 50)) for i in range(300)]
    df = spark.createDataFrame(rows, "kpi string, y int, v double")
    got = sorted((r["y"], r["v"], r["rank"], r["p"]) for r in with_rank(df, ["kpi", "y"], "v", "rank", "p").collect())
    df.createOrReplaceTempView("ranked_input")
    want = spark.sql("SELECT y, v, rank() OVER (PARTITION BY kpi, y ORDER BY v) r, percent_rank() OVER (PARTITION BY kpi, y ORDER BY v) p FROM ranked_input")
    assert got == sorted((r["y"], r["v"], r["r"], r["p"]) for r in want.collect())


def test_offsets_over_many_blocks(spark):
    df = spark.range(5000).selectExpr("1 AS d", "cast(id AS int) AS page", "id % 3 AS n")
    got = {r["page"]: r["o"] for r in with_offsets(df, ["d"], "page", "n", "o", block=64).collect()}
    total = 0
    for i in range(5000):
        assert got[i] == total
        total += i % 3


def test_short_figures(spark):
    df = spark.createDataFrame([(0.0,), (0.0001234,), (0.5,), (1234.5,)], "v double")
    assert [r["x"] for r in df.select(T.figure(F.col("v")).alias("x")).collect()] == ["0", "1.2340e-04", "0.5000", "1,234.50"]
