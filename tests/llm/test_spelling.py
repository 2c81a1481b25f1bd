"""Spelling groups against comparing every word with every other."""

import re
import zlib

import pytest
from pyspark.errors import PySparkException

from gaugework.llm import spelling

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def counts(rows, shortest, fewest, noise):
    n = {}
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % noise == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] = n.get(run, 0) + 1
    return {w: k for w, k in n.items() if len(w) >= shortest and k >= fewest}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(n, ratio):
    form, out = {}, []
    for w, k in n.items():
        others = [v for v in n if near(w, v)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = (best if best is not None and n[best] >= ratio * k else None, len(others))
    for w, (f, many) in form.items():
        root = w
        while form[root][0] is not None:
            root = form[root][0]
        out.append((w, f, root, n[w], many, None if f is None else n[f]))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_given_counts(spark):
    n = {
        "aab": 1, "ab": 30, "aaab": 5, "abb": 6, "b": 200, "a": 200, "": 3, "xaab": 5, "aabx": 5, "éab": 6, "eab": 2, "baa": 7,
        "banana": 3, "bananana": 99, "banaana": 15, "bannana": 15, "canana": 75, "panana": 75, "mississippi": 50, "misissippi": 10,
        "mississipi": 2, "misisipi": 1, "😀ab": 6, "zab": 6, "ab$": 9, "$ab": 9,
    }
    words = spark.createDataFrame([*n.items(), (None, 5), ("none", None)], "word string, n int").repartition(3)
    assert rows_of(spelling.group(words)) == expected(n, 5)
    assert rows_of(spelling.group(words, ratio=1000)) == expected(n, 1000)
    roots = {r["word"]: r["root"] for r in spelling.group(words).collect()}
    assert roots["misisipi"] == "misisipi" and roots["mississipi"] == "mississippi" and roots["aab"] == "a"


def test_terminator_is_refused(spark):
    with pytest.raises(PySparkException, match="terminator"):
        spelling.group(spark.createDataFrame([("a\u0001b", 1)], "word string, n int")).collect()


@pytest.mark.parametrize("noise", [2, 199])
def test_every_kind_of_row(docs, corpus, no_docs, noise):
    rows = [r[:2] for r in corpus]
    args = {"shortest": 3, "fewest": 2, "noise": noise}
    want = expected(counts(rows, 3, 2, noise), 3)
    assert rows_of(spelling.variants(docs, **args, ratio=3)) == want and any(r[1] for r in want)
    assert spelling.variants(no_docs).collect() == []


def test_long_text_with_one_word_often(spark):
    text = "Straße " * 60000 + "strase " * 9 + "x" * 200000 + " Strasse" * 7
    df = spark.createDataFrame([(1, text), (1, text), (2, "STRASSE " * 30)], "doc_id long, text string")
    want = expected(counts([(1, text), (1, text), (2, "STRASSE " * 30)], 6, 5, 199), 5)
    assert rows_of(spelling.variants(df)) == want


def test_a_prefix_never_holds_more_than_the_alphabet(spark):
    letters = "abcdefgh"
    words = [(f"{a}{b}{c}", 5) for a in letters for b in letters for c in letters] + [("abcd", 9), ("ab", 9)]
    most = spelling.rotations(spark.createDataFrame(words, "word string, n int")).groupBy("prefix").count().agg({"count": "max"})
    assert most.first()[0] <= len(letters) + 1
