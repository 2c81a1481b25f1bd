"""What is moved between tasks: long ids, rows that several picks read, staged entries."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gaugework.functions import text as T
from gaugework.operators import benchmark as B
from gaugework.operators import records as R
from gaugework.plans import jobs as J
from gaugework.queries.views import frame

FOLDER = "/root/testdata/sf0.001"


def test_record_ids_are_made_after_the_join(spark):
    plan = frame(spark, FOLDER, "kpi_records")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = [i for i, line in enumerate(plan) if "concat_ws" in line]
    assert at and max(at) < min(i for i, line in enumerate(plan) if "Join" in line)


def test_packed_ids_sort_as_ids(spark):
    ids = ["1-2-000000007-3-5-9", "1-2-000000007-3-5-90", "10-1", "1-10", "1", "", "-", "9-9-9", "09", "1-2", "1-2-"]
    rng = random.Random(1)
    ids += ["-".join(str(rng.randrange(10 ** rng.randint(1, 6))) for _ in range(4)) for _ in range(300)]
    rows = spark.createDataFrame([(x,) for x in dict.fromkeys(ids)], "x string")
    packed = [r["x"] for r in rows.orderBy(T.packed_digits(F.col("x"))).collect()]
    assert packed == sorted(dict.fromkeys(ids))
    assert spark.range(1).select(T.packed_digits(F.lit("12a")).alias("p")).first()["p"] is None


def test_entries_are_worked_out_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    schema = "comparison_id string, kpi string, label string, ratio double"
    rows = spark.createDataFrame([("c", "scope_1_emissions", "a", 1.0), ("c", "scope_1_emissions", "b", 3.0)], schema)
    scored = B.share_scores(rows.mapInArrow(count, schema)).collect()
    assert {r["label"]: r["score"] for r in scored} == {"a": 75.0, "b": 25.0} and made.value == 2


@pytest.fixture(scope="module")
def stored(spark):
    rng = random.Random(4)
    kinds = ["Integrated", "BRSR", "ESG", "Other", None]
    reports = [
        (r, rng.choice(kinds), rng.choice(["parsed", "downloaded", "failed"]), rng.choice([None, dt.date(2024, 1, rng.randint(1, 3))]))
        for r in range(40)
    ]
    records = []
    for i in range(1500):
        records.append((
            f"{i:05d}", rng.randrange(3), 2020 + rng.randrange(3), rng.randrange(44),
            rng.choice(["scope_1_emissions", "energy_consumption", "women_employees_percentage", "other"]),
            rng.choice([None, -5.0, 1.0, 50.0, 5e12, float(i)]), rng.choice([None, "tCO2e", "GJ", "%", "furlong"]),
            rng.choice(["llm", "regex"]), rng.choice([None, 0.2, 0.5, 0.9]), rng.choice([True, False]),
            rng.choice([None, dt.date(2024, 2, rng.randint(1, 4))]),
        ))
    # a key whose only record passes no gate but is validated
    records.append(("x", 9, 2020, 1, "scope_1_emissions", 5.0, None, "llm", 0.1, True, dt.date(2024, 1, 1)))
    return (
        spark.createDataFrame(records, "record_id string, company_id long, report_year int, report_id long, kpi string, value double, "
                              "unit string, extraction_method string, confidence double, is_validated boolean, extracted_at date"),
        spark.createDataFrame(reports, "report_id long, report_type string, status string, created_at date"),
    )


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_upload_in_one_pass(stored):
    records, reports = stored
    new = R.latest_validated(records.filter("value IS NOT NULL")).withColumn("method", F.col("extraction_method"))
    want = J.upload_metrics(R.best_per_key(records, reports), new)
    got = J.upload_from_records(records, reports)
    assert _rows(got.select(*want.columns)) == _rows(want) and got.filter("company_id = 9").count() == 1


def test_stored_and_fresh_in_one_pass(stored):
    records, reports = stored
    keys = list(R.KEY)
    fresh = R.first_report_with_value(records, reports).select(*keys, "value")
    want = R.merge_by_precedence(fresh, R.best_per_key(records, reports).select(*keys, "value")).select(*keys, "value")
    got = R.stored_and_fresh(records, reports, fields=("value",))
    assert _rows(got.select(*keys, F.coalesce("fresh.value", "stored.value"))) == _rows(want)


def test_company_years_from_stored_records(stored):
    records, reports = stored
    reports = reports.join(records.groupBy("report_id").agg(F.min("company_id").alias("company_id"), F.min("report_year").alias("report_year")), "report_id").select(
        "*", F.lit(None).cast("string").alias("file_path"), F.lit(100.0).alias("revenue_cr"), F.lit("INR_Crore").alias("revenue_unit"), F.lit("db").alias("revenue_source")
    )
    targets = ("scope_1_emissions", "energy_consumption", "women_employees_percentage")
    got = J.process_company_years(records, reports, targets=targets)
    want = J.process_company_years(records, reports, records, targets=targets)
    assert _rows(got) == _rows(want) and len(_rows(got)) > 1


def test_files_are_read_once(spark):
    from gaugework.sources import landing

    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    schema = "company_id long, report_year int, path string, content binary, length long, status string"
    rows = [(1, 2024, "a", b"%PDF-1", 6, "read"), (1, 2025, "b", b"%PDF-1", 6, "read"), (1, 2025, "c", b"x", 1, "read")]
    files = spark.createDataFrame(rows, schema).mapInArrow(count, schema)
    none = spark.createDataFrame([], "company_id long, file_hash string")
    got = {r["path"]: r["status"] for r in landing.outcomes(files, none).collect()}
    assert got == {"a": "downloaded", "b": "duplicate", "c": "not a report file"} and made.value == 3


def test_runs_read_staged_records(spark, monkeypatch):
    from gaugework.queries import stores
    from gaugework.queries.registry import QUERIES

    read, run = [], stores.store.store_run
    monkeypatch.setattr(stores.store, "store_run", lambda rows, *a: (read.append(rows.inputFiles()), run(rows, *a)))
    QUERIES["record_log"](spark, FOLDER)
    assert len(read) == 3 and all("/gaugework-tables/" in f for files in read for f in files)
