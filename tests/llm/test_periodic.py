"""Periodic runs against trying every period at every place."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from gaugework.llm import periodic
from gaugework.llm.words import mix


def all_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                found.setdefault((i, j - i + q), q)  # smaller periods come first
            i = j + 1
    return sorted((s, m, q) for (s, m), q in found.items())


def expected(doc_id, text, planted):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if planted and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = sorted(all_runs(words), key=lambda r: (r[0], r[2]))
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    milli = None if not runs else 1000 * best[1] // best[2]
    return (doc_id, len(runs), *best, milli, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(kept))


def as_ids(words):
    return mix(np.array(words, np.uint64))


def made(rng, letters, n):
    """A text of stretches: noise, repeats of a block, repeats that contain repeats, cut anywhere."""
    out = []
    while len(out) < n:
        block = [rng.randrange(letters) for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 12, 13, 19, 30, 57]))]
        if rng.random() < 0.3:
            block = block * rng.randint(2, 4) + [rng.randrange(letters)]
        reps = block * rng.randint(2, 6)
        out += reps[: rng.randint(1, len(reps))] if rng.random() < 0.5 else reps
        out += [rng.randrange(letters) for _ in range(rng.randrange(6))]
    return out[:n]


@pytest.mark.parametrize("block", [1 << 18, 37])
@pytest.mark.parametrize("letters", [1, 2, 3, 1000])
def test_every_run_is_found(monkeypatch, letters, block):
    monkeypatch.setattr(periodic, "_BLOCK", block)
    rng = random.Random(letters)
    for _ in range(40):
        texts = [made(rng, letters, rng.choice([0, 1, 23, 24, 25, 90, 300])) for _ in range(rng.randint(1, 4))]
        ids, rows, want = [], [0], []
        for k, words in enumerate(texts):
            want += [(s + len(ids), m, q) for s, m, q in sorted(all_runs(words), key=lambda r: (r[0], r[2]))]
            ids += words + [10**6 + k]
            rows.append(len(ids))
        assert [tuple(r) for r in periodic.find_runs(as_ids(ids), np.array(rows)).tolist()] == want


def test_words_of_repeating_patterns():
    """Fibonacci, Thue-Morse and their multiples: repeats in repeats on every scale."""
    a, b = [0], [0, 1]
    while len(b) < 700:
        a, b = b, b + a
    thue = [bin(i).count("1") % 2 for i in range(700)]
    for words in (b[:700], thue, (thue[:100] + [2]) * 7, b[:89] * 3 + b[:55] * 4, ([0] * 40 + [1]) * 9):
        ids = words + [99]
        found = periodic.find_runs(as_ids(ids), np.array([0, len(ids)]))
        assert [tuple(r) for r in found.tolist()] == sorted(all_runs(words), key=lambda r: (r[0], r[2]))


def test_scales_cover_every_period():
    covered = [q for s in periodic.scales(3000) for q in range(s.least, s.most + 1)]
    assert covered[: 1000 - periodic.SHORT] == list(range(periodic.SHORT + 1, 1001))
    assert all(s.window >= 2 for s in periodic.scales(10**7))


@pytest.mark.parametrize("planted", [False, True])
def test_every_kind_of_row(spark, docs, corpus, no_docs, planted):
    got = sorted(map(tuple, periodic.periodic_runs(docs, planted).collect()), key=repr)
    assert got == sorted((expected(*r[:2], planted) for r in corpus), key=repr)
    assert periodic.periodic_runs(no_docs, planted).collect() == []


def test_planted_and_long_texts(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(500)}é" for _ in range(3000)]
    rows = [(i, " ".join(words[: 10 + 37 * i]) + "\n\n") for i in range(60)]
    rows += [(100, " \t".join(words[:400] * 4)), (101, "x" * 300000 + " y" * 50), (102, "a b\n" * 900 + "c " + "a  b " * 40), (-7, "z " * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: tuple(r) for r in periodic.periodic_runs(df, True).collect()}
    want = {i: expected(i, t, True) for i, t in rows}
    assert got == want and sum(r[1] > 0 for r in want.values()) > 5


def test_giant_text(spark):
    """A book of a million words: two blocks repeated far apart in length."""
    text = " ".join(f"w{i * i % 1000003}" for i in range(200000)) * 3 + " " + "one two " * 200000
    row = periodic.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    # the copies stand without a blank between them, so one word at each seam differs
    assert (row["n_runs"], row["period"], row["length"]) == (1, 2, 400000)
    text = " ".join([f"w{i * i % 1000003}" for i in range(200000)] * 3)
    row = periodic.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row["n_runs"], row["start"], row["period"], row["length"]) == (1, 0, 200000, 600000)
