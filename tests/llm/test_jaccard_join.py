"""The similarity join against comparing all pairs."""

import numpy as np
import pytest

from gaugework.llm import jaccard_join
from gaugework.llm.components import components

from .conftest import WORDS, edited, lower, make_text


def shingles(text):
    words = WORDS.findall(lower(text))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def expected(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            linked = sets[i] and sets[j] and 100 * shared >= 80 * len(sets[i] | sets[j])
            if linked and rows[i][0] is not None and rows[j][0] is not None:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    out = []
    for k, (i, _) in enumerate(rows):
        out.append((i, len(sets[k]), None if i is None else min(rows[m][0] for m in range(len(rows)) if group[m] == group[k] and rows[m][0] is not None)))
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, jaccard_join.link(df).select("doc_id", "n_shingles", "component_id").collect()), key=repr)


def test_every_kind_of_row(docs, corpus):
    assert found(docs) == expected([(i, t) for i, t, _ in corpus])


@pytest.mark.parametrize("room", [300_000, 600])
def test_near_copies_of_frequent_text(spark, monkeypatch, room):
    monkeypatch.setattr(jaccard_join, "ROOM", room)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 2)
    rows = []
    for group in range(3):
        base = make_text(50 + group, 120)
        rows += [(1000 * group + s, edited(base, 7 * group + s, s % 5)) for s in range(25)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df) == expected(rows)


def test_no_rows(no_docs):
    assert found(no_docs) == []


def test_one_of_each_keeps_rows_without_id(docs, corpus):
    kept = jaccard_join.one_of_each(docs)
    want = {i for i, _, c in expected([(i, t) for i, t, _ in corpus]) if i is not None and i == c}
    ids = [r[0] for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == 1
    assert kept.columns == docs.columns


def test_keys_meet_for_all_linked_sets():
    rng = np.random.default_rng(0)
    for frequent in (0, 30, 400):
        pool = rng.integers(0, 1 << 62, 400).astype(np.uint64)
        signatures = jaccard_join.Signatures(pool[:frequent])
        for _ in range(150):
            a = rng.choice(pool, rng.integers(4, 120), replace=False)
            b = np.concatenate([a[: rng.integers(len(a) * 7 // 10, len(a) + 1)], rng.choice(pool, rng.integers(0, 1 + len(a) // 5), replace=False)])
            a, b = np.unique(a), np.unique(b)
            shared = len(np.intersect1d(a, b))
            if len(a) != len(b) and 100 * shared >= 80 * (len(a) + len(b) - shared):
                assert len(np.intersect1d(signatures.keys(a), signatures.keys(b)))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, k) for k in range(101, 140)] + [(200, 199), (199, 201), (300, 300)]
    df = spark.createDataFrame(edges, "a long, b long")
    roots = {r["node"]: r["root"] for r in components(df).collect()}
    assert roots == {**{i: 1 for i in range(1, 31)}, **{k: 100 for k in range(100, 140)}, 199: 199, 200: 199, 201: 199, 300: 300}
