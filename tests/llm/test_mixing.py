"""The mix against targets worked out by hand and the duals' conditions."""

import math
from collections import defaultdict

import pytest

from gaugework.llm import mixing

from .conftest import WORDS


def targets(sizes):
    names = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in stopped)
        open_weight = sum(weight[s] for s in names if s not in stopped)
        share = {s: rest * weight[s] / open_weight for s in names if s not in stopped}
        over = {s for s in share if share[s] > 3 * sizes[s]}
        if not over:
            return {**{s: 3.0 * sizes[s] for s in stopped}, **share}
        stopped |= over


def test_every_kind_of_row(docs, corpus):
    rows = mixing.copies(docs).collect()
    sizes = defaultdict(int)
    for _, t, s in corpus:
        sizes[s] += len(WORDS.findall(t or ""))
    want = targets(sizes)
    assert len(rows) == len(corpus)
    assert all(r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]]) for r in rows)
    assert all(0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"] for r in rows)


def test_targets_are_met_and_reruns_agree(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 60)), f"s{i % 4}") for i in range(2000)] + [(5000 + i, "a b c", "tiny") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = mixing.copies(df).collect()
    taken, target = defaultdict(int), {}
    for r in first:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 2 for s in taken)
    assert target["tiny"] == 27.0
    assert sorted(map(tuple, first)) == sorted(map(tuple, mixing.copies(df.repartition(5)).collect()))


def test_rates_are_exponentials_of_size(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 30)), "ab"[i % 2]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = df.select("source", mixing.words(df.text).alias("size")).groupBy("source", "size").count().withColumnRenamed("count", "n")
    sources = sizes.groupBy("source").agg({"n": "sum"}).collect()
    assert len(sources) == 2
    per = {s: [(r["size"], r["n"]) for r in sizes.collect() if r["source"] == s] for s in "ab"}
    totals = {s: sum(a * n for a, n in per[s]) for s in "ab"}
    goal = {"a": 1.5 * totals["a"], "b": 0.4 * totals["b"]}
    plan = spark.createDataFrame([(s, 200, totals[s], goal[s]) for s in "ab"], "source string, docs long, source_size long, target double")
    for r in mixing._tilts(sizes, plan, 3).collect():
        mean = totals[r["source"]] / 200
        got = sum(n * a * min(3, math.exp(r["tilt"] * a / mean)) for a, n in per[r["source"]])
        assert got == pytest.approx(goal[r["source"]], rel=1e-6)


def test_repeated_rows_share_and_mix_keeps_columns(spark, docs):
    df = spark.createDataFrame([(1, "a b", "x")] * 7 + [(2, "a b c", "x"), (3, "d", "y")], "doc_id long, text string, source string")
    rows = [r["copies"] for r in mixing.copies(df).collect() if r["doc_id"] == 1]
    assert len(rows) == 7 and max(rows) - min(rows) <= 1
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.filter("doc_id is null").count() == 1


def test_no_rows(no_docs):
    assert mixing.copies(no_docs).collect() == [] and mixing.mix(no_docs).collect() == []
