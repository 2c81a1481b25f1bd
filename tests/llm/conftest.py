"""Helpers of the operator tests: small tables with nulls, empties, ties, repeats and clashing columns."""

import random
import re

import pytest

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def make_text(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 7))) for _ in range(n))


def edited(text, seed, changes):
    rng, words = random.Random(seed), text.split(" ")
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"new{rng.randrange(99999)}"
    return " ".join(words)


@pytest.fixture(scope="session")
def corpus():
    """Rows (doc_id, text, source) of every kind that an operator must take."""
    base, passage = make_text(1, 150), make_text(2, 90)
    texts = [None, "", "   \n\t", "one", "one two", "ONE two", "one two three four", base, base, base.upper()]
    texts += [edited(base, s, 2) for s in range(6)]
    texts += [f"{make_text(100 + s, 40)} {passage} {make_text(200 + s, 40)}" for s in range(5)]
    texts += ["x" * 3000, "ab" * 900, make_text(3, 4000), "line a\nline b\nline a\n\n\n line a"]
    rows = [(i * 3 + 1, t, [None, "", "s1", "s2", "é"][i % 5]) for i, t in enumerate(texts)]
    return rows + [(None, base, "s1"), (1000, make_text(9, 30), "s1"), (1000, make_text(9, 30), "s1"), (1001, base, None)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    rows = [(i, t, s, "en", "clash", 7) for i, t, s in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, score string, n_words int").repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
