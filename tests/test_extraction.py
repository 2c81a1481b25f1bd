"""A chunk that many metrics ask for is searched once, and only by patterns whose words it holds."""

import re

from gaugework.functions import text as T
from gaugework.operators import extraction as X
from gaugework.operators import retrieval as V
from gaugework.rules import patterns as P
from gaugework.rules.catalogue import METRIC_NAMES, METRICS

TEXTS = [
    "Total Scope 1 emissions (Break-up of the GHG into CO2) in Metric tonnes of 22,222 as assured",
    "Scope 2 emissions were 4,000 tCO2e from purchased electricity.",
    "We get 67.5% of electricity for\n     our India operations from renewable sources of power.",
    "Employees and workers 180 19\nComplaints pending resolution at close of the year: 12 of all",
    "TOTAL ſCOPE 1 EMİSSIONS in metrıc tonnes of 33,333",
    "", None,
]


def test_needed_words_are_in_every_match():
    assert T.needed(r"total\s+water\s+(?:intake|used)[^\n]{0,80}\n([\d,]+)") == ("total", "water")
    assert T.needed(r"complaints?\s+filed(\d+)x*y{0,3}z+") == ("complaint", "filed", "z")
    assert T.needed(r"scope[\s\-]*1.{0,5}|other") == ()
    patterns = [p for ps in P.BLOCK.values() for p in ps] + [p for m in METRICS for p in m.patterns] + [*P.GHG_ROW, *P.BROAD]
    for pattern in patterns:
        for text in filter(None, TEXTS):
            if re.search(pattern, text, re.I | re.S | re.M):
                folded = text.translate(str.maketrans("ſıİK", "siik")).lower()
                assert all(w in folded for w in T.needed(pattern))


def test_one_row_per_chunk_gives_the_hits_of_one_row_per_metric(spark):
    chunks = spark.createDataFrame(
        [(d, i, "table" if i % 2 else "text", t) for d in (1, 2) for i, t in enumerate(TEXTS)],
        "doc_id long, chunk_index long, chunk_type string, content string",
    )
    rows = [(d, k, i, p) for d in (1, 2) for p, k in enumerate(METRIC_NAMES) for i in range(len(TEXTS)) if (i + p + d) % 4]
    asked = spark.createDataFrame(rows, "doc_id long, kpi string, chunk_index long, position int")
    once, many = X.by_chunk(asked, chunks), V.attach_text(asked, chunks)
    assert once.count() == 2 * len(TEXTS) and many.count() == len(rows)
    some = [m for m in METRICS if m.name in ("scope_1_emissions", "scope_2_emissions", "complaints_pending")]
    got, want = X.candidates(once, some), X.candidates(many, some)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) != []


def test_letters_that_only_match_in_either_case_are_found(spark):
    columns = "doc_id long, kpi string, chunk_index long, position int, chunk_type string, content string"
    chunk = spark.createDataFrame([(1, "scope_1_emissions", 0, 1, "text", TEXTS[4])], columns)
    assert X.block_hits(chunk, METRICS[:1]).first()["hit"]["value"] == 33333.0


def test_patterns_run_only_on_texts_that_they_may_match(spark):
    """The test in front of the patterns rules out most texts, and none in which Spark finds a match."""
    from pyspark.sql import functions as F

    odd = ["Total water consumption\x0b5,000 KL", "total energy consumed\u00a0(A+B)\n5", "Total waste 1,23,456 kg", "Total value chain emissions\n", *TEXTS]
    texts = odd + ["Plain prose about nothing at all"] * 5 + [f"Scope {i} emissions were {i},{i}00 tCO2e" for i in (1, 2, 3)]
    chunks = spark.createDataFrame([(1, i, "text", t) for i, t in enumerate(texts)], "doc_id long, chunk_index long, chunk_type string, content string")
    asked = chunks.withColumn("asked", F.array(*[F.struct(F.lit(m.name).alias("kpi"), F.lit(1).alias("position")) for m in METRICS]))
    may = X._prefilter(METRICS)
    marked = X._marked(asked, METRICS)
    found = marked.select("*", *[T.found(F.col("content"), p, f).alias(f"_p{i}") for (p, f), i in may.at.items()]).collect()
    ruled_out = 0
    for r in found:
        for i in may.at.values():
            held = bool(r[may.columns[i // X.BITS]] >> i % X.BITS & 1)
            assert held or not r[f"_p{i}"]
            ruled_out += not held
    assert ruled_out > len(texts) * len(may.at) // 2 and X._searched(asked, METRICS, X._stages).count() > 3
    assert all(pattern for pattern, _, _ in may.tests)  # all can be read
