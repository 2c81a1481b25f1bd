"""Removal of repeated strings against looking at every string."""

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from gaugework.llm import suffix_dedup

from .conftest import make_text


def expected(rows, length=400):
    texts = [(t or "").encode() for _, t, _ in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc, _, _), text in zip(rows, texts):
        gone = bytearray(len(text))
        for i in range(len(text) - length + 1):
            if seen[text[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        left = bytes(x for x, g in zip(text, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(text), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sample", [1000, 0])
def test_every_kind_of_row(docs, corpus, monkeypatch, sample):
    monkeypatch.setattr(suffix_dedup, "SAMPLE_DOCS", sample)
    got = suffix_dedup.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(tuple, got.collect()), key=repr) == expected(corpus)


def test_hot_surroundings_have_hot_runs(spark, monkeypatch):
    # two copies and two parts of one text: more repeated runs and surroundings than may be hot
    long = make_text(1, 1200)
    rows = [(0, long), (1, long)]
    rows += [(20 + k, f"{make_text(70 + k, 30)} {long[800 * k + 10 : 800 * k + 560]} {make_text(180 + k, 30)}") for k in range(2)]
    want = expected([(i, t, None) for i, t in rows])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(suffix_dedup, "SAMPLE_KEYS", 85)
    got = suffix_dedup.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_truncation_never_separates_run_and_surroundings(monkeypatch):
    around, key = np.repeat(np.arange(1, 9), 2), np.repeat(np.arange(80, 0, -10), 2)
    seen = pd.DataFrame({"around": around.astype(np.int64), "key": key.astype(np.int64)})
    monkeypatch.setattr(suffix_dedup, "SAMPLE_KEYS", 3)
    runs, keys = suffix_dedup._hot(seen)
    assert keys == {1, 2, 3} and runs == {80, 70, 60}


def test_text_and_columns(docs, corpus):
    got = suffix_dedup.remove_repeats(docs, text_out=True)
    assert set(docs.columns) <= set(got.columns)
    assert {r["score"] for r in got.collect()} == {"clash"}
    left = {r["doc_id"]: r["text"] for r in got.collect()}
    assert left[1] == "" and left[13] == "one two"


def test_no_rows(no_docs):
    assert suffix_dedup.remove_repeats(no_docs).collect() == []


def test_periodic_text_and_merge():
    for text in (b"abc" * 400, b"\0" * 900, bytes(range(256)) * 5):
        start, stop, first, last = suffix_dedup.intervals(text)
        assert start[0] == 0 and stop[-1] == len(text) - 399 and (start[1:] == stop[:-1]).all()
        assert (first >= start).all() and (last <= start + 400).all()
        assert ((first >= stop - 1) & (last <= start + 400)).all()
