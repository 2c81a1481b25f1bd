"""The keyword index and its SQL on texts whose digits begin a longer word."""

import duckdb
from pyspark.sql import functions as F

from gaugework.functions import text as T
from gaugework.queries.text import keywords_sql

TEXTS = [
    'token = "6b526d9e98196c4dff5"', "password=9855ae4fa4", "3abc", "5,000abc", "5.", "7.a", "x9", "9_x", "_9", "12", "a 12", "(3)", "1,2.3", ",5", "é5", "5é", "",
]


def test_a_number_ends_at_a_word_boundary(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    got = {r["i"]: r["k"] for r in df.select("i", T.keywords(F.col("t")).alias("k")).collect()}
    con = duckdb.connect()
    want = {i: con.execute(f"SELECT {keywords_sql('t')} FROM (SELECT ?::VARCHAR AS t)", [t]).fetchone()[0] for i, t in enumerate(TEXTS)}
    assert got == want
    assert "has_numbers" not in got[0] and "has_numbers" in got[3]
