"""Term masks against looking for every term in every text."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugework.functions.masks import BITS, Terms, _pattern, _trie
from gaugework.operators import retrieval as V
from gaugework.rules.catalogue import METRICS


def test_rule_terms(spark):
    book = V.RuleBook(V._rules(METRICS))
    terms, rng = book.terms.terms, random.Random(1)
    assert len(terms) > 3 * BITS
    texts = ["".join(rng.choice([*rng.sample(terms, 3), " ", "x", "."]) for _ in range(rng.randint(0, 9))) for _ in range(300)] + ["", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", book.terms.found_in(F.col("t")).alias("m"))
    for r in df.select("t", book.terms.listed(F.col("m")).alias("found"), "m").collect():
        want = [t for t in terms if t in (r["t"] or "")]
        assert r["found"] == want and tuple(r["m"]) == book.terms.mask(want)


def test_words(spark):
    terms = Terms(["water", "waste water", "ater", "wat", "a.b*c", "x"])
    rows = [(["wat", "er"],), (["ate", "a.b*c", "zzz"],), ([],), (["water"] * 3,)]
    df = spark.createDataFrame(rows, "w array<string>").select(
        "w", terms.listed(terms.equal_to(F.col("w"))).alias("equal"), terms.listed(terms.containing(F.col("w"))).alias("hosts"),
        terms.parts_of_terms(F.col("w")).alias("parts"),
        terms.shared(terms.equal_to(F.col("w")), terms.containing(F.col("w"))).alias("both"),
    )
    for r in df.collect():
        assert r["equal"] == [t for t in terms.terms if t in r["w"]]
        assert r["hosts"] == [t for t in terms.terms if any(w in t for w in r["w"])]
        assert set(r["parts"]) == {w for w in r["w"] if any(w in t for t in terms.terms)}
        assert r["both"] == len(r["equal"])


def test_no_terms(spark):
    none = Terms([])
    row = spark.range(1).select(none.found_in(F.lit("abc")).alias("m")).select(none.any(F.col("m")).alias("any")).first()
    assert row["any"] is False


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab c.(", min_size=1, max_size=4), min_size=1, max_size=8), st.text("ab c.(", max_size=12))
def test_longest_terms_imply_the_others(terms, text):
    import re

    book = Terms(terms)
    longest = {m[1] for m in re.finditer(f"(?=({_pattern(_trie(book.terms))}))", text)}
    found = {t for t in book.terms for long in longest if long.startswith(t)}
    assert found == {t for t in book.terms if t in text}
