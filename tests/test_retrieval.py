"""Retrieval against a plain-Python brute force on a small fixture."""

import math
import random

from pyspark.sql import functions as F

from gaugework.operators import retrieval as V
from gaugework.operators import vectors as X
from gaugework.rules.catalogue import METRICS

CHUNKS = "doc_id long, chunk_index long, chunk_type string, page_number int, content string, token_count int, keywords array<string>"
TEXTS = [
    ("text", "Scope 1 emissions were 5,000 tCO2e", ["scope", "emissions", "tco2e", "has_numbers"]),
    ("table", "Total energy consumed | 9,000 GJ | 8,000 GJ", ["total", "energy", "consumed", "has_numbers"]),
    ("text", "Women are 40 % of the workforce", ["women", "workforce", "has_numbers"]),
    ("text", "Water consumption 300 kl of freshwater", ["water", "consumption", "freshwater", "has_numbers"]),
    ("footnote", "1 see scope 3 and value chain emissions", ["scope", "value", "chain", "emissions", "has_numbers"]),
    ("text", "Plain prose about the salary of an employee", ["plain", "prose", "salary", "employee"]),
    ("text", "zzz qqq", ["zzz", "qqq"]),
]


def fixture(spark, docs=6, size=25):
    rng = random.Random(3)
    rows = []
    for d in range(docs):
        for i in range(size):
            kind, text, words = TEXTS[rng.randrange(len(TEXTS))] if d else TEXTS[-1]
            rows.append((d, i, kind, None if i == 7 else i // 4 + 1, text, 5 + rng.randrange(40), words))
    return spark.createDataFrame(rows, CHUNKS)


def brute(judged, chunks, k=5):
    """The ranking loop, written out one step after another."""
    by_doc = {}
    for c in chunks:
        by_doc.setdefault(c["doc_id"], {})[c["chunk_index"]] = c["page_number"]
    groups = {}
    for r in judged:
        groups.setdefault((r["doc_id"], r["kpi"]), []).append(r)
    out = set()
    for doc, pages in by_doc.items():
        for m in METRICS:
            rows = groups.get((doc, m.name), [])
            if not rows:
                out |= {(doc, m.name, i, 0.0, False) for i in sorted(pages)[:k]}
                continue
            strict = [r for r in rows if r["tier"] == 0]
            use = strict
            if len(strict) < 2:
                extra = [r for r in rows if r["tier"] == 1]
                use = strict + extra if extra or strict else rows
            ranked = sorted(([r["score"], r["chunk_index"], r["page_number"]] for r in use if r["score"] > 0), key=lambda r: (-round(r[0], 6), r[1]))
            top_pages = {r[2] for r in ranked[:3] if r[2]}
            for r in ranked[3:]:
                if r[2] in top_pages:
                    r[0] += 0.15
            ranked.sort(key=lambda r: -round(r[0], 6))
            seen, result = set(), []
            for score, i, page in ranked[:k]:
                if i not in seen:
                    seen.add(i)
                    result.append((i, score, False))
                for n in (i - 1, i + 1):
                    if n in seen or n not in pages:
                        continue
                    if page is not None and pages[n] is not None and pages[n] != page:
                        continue
                    seen.add(n)
                    result.append((n, 0.5, True))
            result.sort(key=lambda r: (r[2], -round(r[1], 6)))
            out |= {(doc, m.name, i, round(s, 5), nb) for i, s, nb in result[: 2 * k]}
    return out


def test_keyword_retrieval_equals_brute_force(spark):
    chunks = fixture(spark)
    judged = V.judge_chunks(chunks).select("doc_id", "kpi", "tier", "score", "chunk_index", "page_number").collect()
    got = {
        (r["doc_id"], r["kpi"], r["chunk_index"], round(r["score"], 5), r["is_neighbor"]) for r in V.retrieve(chunks).collect()
    }
    assert got == brute(judged, chunks.collect())


def test_hybrid_equals_brute_force(spark):
    rng = random.Random(5)
    base = fixture(spark)
    vectors = {(r["doc_id"], r["chunk_index"]): [round(rng.uniform(-1, 1), 3) for _ in range(4)] for r in base.select("doc_id", "chunk_index").collect()}
    table = spark.createDataFrame([(d, i, v) for (d, i), v in vectors.items()], "doc_id long, chunk_index long, embedding array<float>")
    chunks = base.join(table, ["doc_id", "chunk_index"]).withColumn("is_embedded", F.col("doc_id") != 2)
    asked = [(m.name, q, [round(rng.uniform(-1, 1), 3) for _ in range(4)]) for m in METRICS for q in range(2)]
    queries = spark.createDataFrame(asked, "kpi string, query_id int, query_vector array<double>")
    got = {(r["doc_id"], r["kpi"], r["chunk_index"], round(r["score"], 3), r["is_neighbor"]) for r in X.hybrid(chunks, queries).collect()}

    def cos(a, b):
        return round(sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(y * y for y in b)), 4)

    kw = {}
    for r in V.retrieve(chunks).collect():
        kw.setdefault((r["doc_id"], r["kpi"]), []).append(r)
    fits = {(r["doc_id"], r["kpi"], r["chunk_index"]) for r in V.relevance(chunks).collect() if r["relevant"] or r["fallback"]}
    pages = {(r["doc_id"], r["chunk_index"]): r["page_number"] for r in base.collect()}
    want = set()
    for doc in range(6):
        for m in METRICS:
            words = kw.get((doc, m.name), [])
            if doc == 2:
                want |= {(doc, m.name, r["chunk_index"], round(r["score"], 3), r["is_neighbor"]) for r in words}
                continue
            best = {}
            for name, _, q in asked:
                if name != m.name:
                    continue
                near = sorted(((cos(v, q), -i) for (d, i), v in vectors.items() if d == doc), reverse=True)[:5]
                for s, i in near:
                    best[-i] = max(best.get(-i, -9), s)
            top = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5]
            sem = {i: s * 10 for i, s in top if (doc, m.name, i) in fits}
            key = {r["chunk_index"]: r["score"] for r in words}
            top_kw, top_sem = max(key.values(), default=1.0) or 1.0, max(sem.values(), default=1.0) or 1.0
            merged = {}
            for i in set(key) | set(sem):
                a, b = key.get(i), sem.get(i)
                if a is not None and b is not None:
                    merged[i] = b / top_sem * 0.5 + a / top_kw * 0.5 + 0.3
                else:
                    merged[i] = a / top_kw if b is None else b / top_sem
            ranked = sorted(merged.items(), key=lambda x: (-round(x[1], 6), x[0]))[:5]
            seen, result = set(), []
            for i, s in ranked:
                if i not in seen:
                    seen.add(i)
                    result.append((i, s, False))
                for n in (i - 1, i + 1):
                    if n in seen or (doc, n) not in pages:
                        continue
                    a, b = pages[(doc, i)], pages[(doc, n)]
                    if a is not None and b is not None and a != b:
                        continue
                    seen.add(n)
                    result.append((n, 0.5, True))
            result.sort(key=lambda r: (r[2], -round(r[1], 6)))
            want |= {(doc, m.name, i, round(s, 3), nb) for i, s, nb in result[:10]}
    assert got == want


def test_long_documents_are_ranked_as_short_ones(spark, monkeypatch):
    chunks = fixture(spark, docs=7)
    judged = V.judge_chunks(chunks).select("doc_id", "kpi", "tier", "score", "chunk_index", "page_number").collect()
    sizes = sorted(sum(r["doc_id"] == d for r in judged) for d in range(7))
    monkeypatch.setattr(V, "MOST_TOGETHER", sizes[4])  # some documents go either way
    got = {
        (r["doc_id"], r["kpi"], r["chunk_index"], round(r["score"], 5), r["is_neighbor"]) for r in V.retrieve(chunks).collect()
    }
    assert got == brute(judged, chunks.collect())


def test_rows_of_a_document_are_moved_once(spark):
    plan = V.retrieve(fixture(spark))._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert dealt and not any("kpi" in line for line in dealt)


def test_search_reads_no_keywords_of_other_texts(spark):
    rows = [(1, 0, "text", 1, "No ENERGY used", 5, ["energy", "used"]), (1, 1, "text", 1, "awater consumptions", 4, ["awater", "consumptions"]),
            (1, 2, "text", 1, "water | other", 4, ["other", "water"]), (2, 0, "text", 1, "5", 1, ["has_numbers"])]
    chunks = spark.createDataFrame(rows, CHUNKS)
    words = ("energy", "water consumption", "Numbers")
    may = {(r["doc_id"], r["chunk_index"]) for r in chunks.filter(V._may_hold(words)).collect()}
    index = [(r[0], r[1]) for r in rows if any(w.lower() in " ".join(r[6]) for w in words)]
    assert may >= set(index) == {(1, 0), (1, 1), (2, 0)}
