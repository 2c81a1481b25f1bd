"""Top-k search against all products."""

import math
import random

import numpy as np
import pytest

from gaugework.llm import topk_search


def expected(rows, k=10):
    usable = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in usable:
        if i % 100 == 0:
            asked[i] = min(v, asked.get(i, v))
    out = []
    for q, v in asked.items():
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in usable if i != q and len(w) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, width string")
    vectors = topk_search.whole_vectors(df)
    return sorted(map(tuple, topk_search.top_k(vectors, vectors.filter("vec_id % 100 = 0")).collect()))


@pytest.mark.parametrize("block", [4096, 16])
def test_against_all_products(spark, monkeypatch, block):
    for name in ("BLOCK", "QUERY_BLOCK", "FIRST"):
        monkeypatch.setattr(topk_search, name, block)
    rng = random.Random(4)
    rows = []
    for i in range(400):
        scale = rng.choice([0, 0.01, 1, 1, 30])
        rows.append((i, [scale * rng.gauss(0, 1) for _ in range(6)], "x"))
    rows += [(500, [1.0, 2.0, 3.0], "x"), (501, [1.0, 2.0, 3.5], "x"), (502, [], "x"), (600, [], "x"), (None, [1.0] * 6, "x"), (503, None, "x")]
    rows += [(504, [1.0, None, 1.0], "x"), (700, [math.inf, 1.0, 1.0], "x"), (800, [math.nan] * 6, "x"), (7, rows[7][1], "x"), (100, rows[3][1], "x")]
    assert run(spark, rows) == expected([r[:2] for r in rows])


def test_large_components_stay_exact(spark):
    rows = [(i, [2.0**18 * (i + 1), 3.0 + i, 2.0**17], "x") for i in range(5)]
    assert run(spark, rows) == expected([r[:2] for r in rows])


def test_no_vectors(spark):
    assert run(spark, []) == []


def test_pruning_loses_nothing():
    rng = np.random.default_rng(2)
    rows = (rng.standard_normal((300, 8)) * rng.choice([5, 50, 900], (300, 1))).astype(np.int64)
    block = topk_search.Block(np.arange(300), rows)
    for q in rows[:60]:
        scores = block.rows @ q
        least = int(np.sort(scores)[-5])
        at = block.candidates(q, float(np.sqrt((q.astype(float) ** 2).sum())), least)
        wanted = set(np.flatnonzero(scores >= least))
        assert at is None or wanted <= set(at.tolist())
