"""Exact counts against regular expressions; trees keep to their constraints."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa

from gaugework.llm import quality_rules

from .conftest import WORDS, make_text


def counts(text):
    text = text or ""
    words, seen, again = WORDS.findall(text), set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            again += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered |= set(range(i, i + 5))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


def test_counts(corpus):
    texts = [t for _, t, _ in corpus] + ["a b " * 50, "x # $ <y>|\n" * 4, "é ü　z \x1f"]
    base, features = quality_rules.statistics(pa.array(texts, pa.string()))
    assert [tuple(r) for r in base.tolist()] == [counts(t) for t in texts]
    assert np.isfinite(features).all()


def test_trees_are_monotone_and_separate():
    rng = np.random.default_rng(1)
    x = rng.random((800, 3))
    y = ((x[:, 0] < 0.6) & (x[:, 1] > 0.1)).astype(float)
    trees = quality_rules.fit_trees(x, y, np.array([-1, 0, 0]), rounds=30)
    assert ((trees.score(x) > 0.5) == y).mean() > 0.97
    grid = np.repeat(rng.random((40, 3)), 50, 0)
    grid[:, 0] = np.tile(np.linspace(0, 1, 50), 40)
    steps = np.diff(trees.score(grid).reshape(40, 50))
    assert (steps <= 1e-12).all()


def test_judge(spark, docs, corpus, no_docs):
    good = [(i, make_text(i, 60), "en") for i in range(40)]
    bad = [(100 + i, " ".join(f"{w}###" for w in make_text(i, 60).split()), "en") for i in range(40)]
    sample = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _, _ in good + bad] + [(None, 1), (5, None)], "doc_id long, quality int")
    trees = quality_rules.train(sample, labels)
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(sample, trees).collect()}
    assert all(kept[i] == (i < 100) for i in kept)
    judged = quality_rules.judge(docs, trees)
    assert judged.count() == len(corpus) and judged.columns.count("score") == 1
    empty = judged.filter("text is null").first()
    assert empty["n_words"] == 0 and empty["base_failed"] and not empty["kept"]
    assert quality_rules.judge(no_docs, trees).count() == 0


def test_without_labels_only_the_base_rule_counts(spark, docs):
    trees = quality_rules.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert all(r["kept"] != r["base_failed"] for r in quality_rules.judge(docs, trees).collect())
