"""The pipeline's stages on the smallest tables, and its place in the contract."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from gaugework.llm import queries, sentencepiece_scan
from gaugework.llm.staging import keep

from .conftest import WORDS, edited, make_text
from .test_jaccard_join import expected as components_of
from .test_quality_rules import counts

FOLDER = "/root/testdata/sf0.001"


def test_stages_chain(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    ids = {r[0] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs.count(), keep(stage(spark, docs, FOLDER), "test")
        if name != "tokens":
            assert docs.columns == corpus_pipeline.COLUMNS
        if name in ("quality rules", "near duplicates"):
            assert 0.5 * before < docs.count() < before
    assert {r[0] for r in docs.select("doc_id").collect()} <= ids and docs.filter("n_tokens <> size(ids)").count() == 0


def left_after_repeats(texts, length):
    """Each text without the bytes of strings of ``length`` that start twice; a cut character goes whole."""
    data = [t.encode() for t in texts]
    seen = Counter(t[i : i + length] for t in data for i in range(len(t) - length + 1))
    out = []
    for t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((any(gone), bytes(x for x, g in zip(t, gone) if not g).decode("utf-8", "ignore")))
    return out


def planted():
    """Clean texts, bad ones, copies, near copies, and passages of some fifty words in texts that are else different."""
    base, passages = make_text(1, 220), [make_text(50 + k, 55) for k in range(3)]
    texts = [make_text(100 + i, 150) for i in range(25)]
    texts += [base, base, *(edited(base, s, 3) for s in range(4))]
    texts += [f"{make_text(200 + 2 * i, 70)} {passages[i % 3]} {make_text(201 + 2 * i, 70)}" for i in range(9)]
    texts += [passages[0] + "\n" + make_text(300, 120), None, "", "one two three", "spam " * 80, "same five words come again " * 30]
    rows = [(7 * i + 3, t, ("en", "de", None)[i % 3], ("s1", "s2", None, "s1")[i % 4], len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[0], (None, make_text(400, 90), "en", "s1", 1), (None, None, None, None, None)]


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_every_stage_against_brute_force(spark, tmp_path):
    form = "doc_id long, text string, lang string, source string, n_chars long"
    rows = planted()
    labels = [(r[0], int(sum(counts(r[1])[3:]) == 0 and counts(r[1])[0] >= 10), 0) for r in rows if r[0] is not None]
    spark.createDataFrame(sorted(set(labels)), "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows, form).repartition(3)
    stages, folder = dict(corpus_pipeline.STAGES), str(tmp_path)

    good = keep(stages["quality rules"](spark, docs, folder), "test")
    n = {r[:2]: counts(r[1]) for r in rows}
    fails = {k for k, c in n.items() if c[0] < 10 or 100 * c[4] > 20 * c[0]}
    got = rows_of(good, "doc_id", "text")
    assert not fails & set(got) and set(got) <= set(n)
    lost = Counter(r[:2] for r in rows if r[:2] not in fails) - Counter(got)
    assert sum(lost.values()) <= 1, lost  # the trees' cut leaves out the least likely of the good ones at most

    once = keep(stages["near duplicates"](spark, good, folder), "test")
    pairs = [(i, t) for i, t in got]
    lowest = {(i, c) for i, _, c in components_of(pairs)}
    want = [(i, t) for i, t in pairs if i is None] + sorted({(i, t) for i, t in pairs if i is not None and (i, i) in lowest}, key=repr)
    assert rows_of(once, "doc_id", "text") == sorted(want, key=repr)
    assert len(got) - len(want) == 6  # a repeated row and five copies of one text

    cut = keep(stages["repeated strings"](spark, once, folder), "test")
    inputs = rows_of(once, "doc_id", "text")
    left = left_after_repeats([t for _, t in inputs], corpus_pipeline.PASSAGE_BYTES)
    want = [(i, t, len(t)) for (i, _), (hit, t) in zip(inputs, left) if t or not hit]
    assert rows_of(cut, "doc_id", "text", "n_chars") == sorted(want, key=repr)
    hit = [i for (i, _), (h, _) in zip(inputs, left) if h]
    assert len(hit) == 10  # all that hold a passage, and no other

    mixed = keep(stages["source mix"](spark, cut, folder), "test")
    times, known = Counter(rows_of(mixed, "doc_id", "text", "source")), set(rows_of(cut, "doc_id", "text", "source"))
    assert set(times) <= known and max(times.values()) <= 3
    size = lambda pairs: {s: sum(k * len(WORDS.findall(t)) for (_, t, x), k in pairs if x == s) for s in {p[2] for p, _ in pairs}}
    before, after = size([(p, 1) for p in known]), size(list(times.items()))
    total, weight = sum(before.values()), {"s1": 5, "s2": 2, None: 1}
    for s in before:  # no source reaches three times its size here
        assert abs(after[s] - total * weight[s] / 8) <= 0.1 * total

    tokens = stages["tokens"](spark, mixed, folder)
    back = sentencepiece_scan.decode(tokens)
    assert Counter(rows_of(back, "doc_id", "decoded")) == Counter(rows_of(mixed, "doc_id", "text"))


def test_stages_of_no_rows(spark, tmp_path):
    form = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame([], form)
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs = keep(stage(spark, docs, str(tmp_path)), "test")
        assert docs.count() == 0, name


def test_every_operator_is_registered():
    names = entry.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 14)}


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = queries.QUERIES[name](spark, FOLDER)
    got = sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)
    result = con.execute(queries.ORACLE[name])
    names = [d[0] for d in result.description]
    assert got == sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in result.fetchall()), key=repr)
