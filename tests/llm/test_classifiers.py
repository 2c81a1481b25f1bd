"""Classifiers: held-out accuracy, whole texts, every kind of row."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gaugework.llm import passage_quality, toxicity
from gaugework.llm.labelled import held_out, labelled, labelled_sample

from .conftest import make_text

BAD = ["vilelo", "grimbo", "nastra", "zokkel"]


@pytest.fixture(scope="module")
def insults(spark):
    rng, rows = random.Random(3), []
    for i in range(900):
        words = make_text(i, rng.randint(8, 150)).split()
        toxic = i % 4 == 0
        for _ in range(4 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words), ["en", "de", None][i % 3], int(toxic)))
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    return docs, spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")


def test_toxicity(insults, docs, corpus, no_docs, spark):
    texts, labels = insults
    network = toxicity.train(texts, labels)
    scored = toxicity.score(texts.withColumn("out", held_out(3, 1)), network).join(labels.withColumnRenamed("toxic", "t"), "doc_id")
    rows = scored.filter("out").collect()
    assert len(rows) > 200 and np.mean([r["predicted"] == r["t"] for r in rows]) > 0.97
    assert set(network.by_language) == {"en", "de", ""}
    every = toxicity.score(docs, network).collect()
    assert len(every) == len(corpus) and all(0 <= r["score"] <= 1 for r in every)
    assert len({r["score"] for r in every if r["doc_id"] in (1, 4, 7)}) == 1
    assert toxicity.score(no_docs, network).collect() == []
    last = spark.createDataFrame([(1, make_text(1, 300_000) + " vilelo grimbo nastra zokkel")], "doc_id long, text string")
    assert toxicity.score(last, network).first()["score"] > 0.5


def test_toxicity_without_labels(docs, spark):
    network = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score(docs, network).select(F.round("score", 6).alias("score")).collect()} == {0.7}


def test_blocks_do_not_change_the_response():
    net = toxicity.fit([np.arange(50, dtype=np.int32)] * 6, np.array([0, 1, 0, 1, 0, 1.0]), epochs=1)
    ids = np.random.default_rng(0).integers(0, 60, 5000).astype(np.int32)
    whole = net.responses(net.places(ids)).max(0)
    assert np.allclose(net.pooled(ids, np.array([0, 0, 5000]))[1], whole)
    old, toxicity._BLOCK = toxicity._BLOCK, 700
    try:
        assert np.allclose(net.pooled(ids, np.array([0, 5000]))[0], whole)
    finally:
        toxicity._BLOCK = old


def test_quality(spark, docs, corpus, no_docs):
    rows = []
    for i in range(700):
        text = make_text(i, 40 + i % 300)
        if i % 5 == 0:
            text = text.upper() + " !! " * 30 if i % 2 else " ".join(w for w in text.split() for _ in range(6))
        rows.append((i, text, int(i % 5 != 0)))
    texts = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    model = passage_quality.train(texts, labels)
    scored = passage_quality.score(texts.withColumn("out", held_out(4, 2)), model).join(labels, "doc_id").filter("out").collect()
    assert len(scored) > 100 and np.mean([r["predicted"] == r["quality"] for r in scored]) > 0.97
    every = {r["doc_id"]: r for r in passage_quality.score(docs, model).collect()}
    assert all(0 <= r["score"] <= 1 for r in every.values())
    assert every[1]["passage"] is None and every[1]["score"] == every[4]["score"] == every[7]["score"]
    assert passage_quality.score(no_docs, model).collect() == []


def test_gradients():
    rng = np.random.default_rng(1)
    x, y, bags = [rng.standard_normal((k, passage_quality.FEATURES)) for k in (1, 3, 5, 2)], np.array([0, 1, 1, 0.0]), np.array([0, 1, 4, 9, 11])
    model = passage_quality.fit(x, y, epochs=1)
    every = np.concatenate(x)

    def loss():
        p = 1 / (1 + np.exp(-model.forward(every, bags)["logit"]))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for name, g in passage_quality._gradients(model, every, bags, y).items():
        w = model.weights[name].reshape(-1)
        for k in range(min(5, len(w))):
            old = w[k]
            w[k] = old + 1e-6
            up = loss()
            w[k] = old - 1e-6
            down = loss()
            w[k] = old
            assert abs((up - down) / 2e-6 - g.reshape(-1)[k]) < 1e-5


def test_attention_weighs_to_one(corpus):
    x, bags = next(passage_quality.passages(pa.array([t for _, t, _ in corpus], pa.string())))
    model = passage_quality.fit([x[a:b] for a, b in zip(bags, bags[1:])], np.arange(len(bags) - 1) % 2.0, epochs=1)
    a = model.forward(x, bags)["a"]
    assert np.allclose(np.add.reduceat(a, bags[:-1][np.diff(bags) > 0]), 1)


def test_passages_are_a_documents_own(corpus, monkeypatch):
    column = pa.array([t for _, t, _ in corpus] + [make_text(5, 200)] * 40, pa.string())
    alone = [next(passage_quality.passages(column[k : k + 1]))[0] for k in range(len(column))]
    model = passage_quality.fit(alone, np.arange(len(alone)) % 2.0, epochs=1)
    scores = np.array([model.score(x, np.array([0, len(x)]))[0] for x in alone])
    for size, most in ((len(column), 4 << 20), (7, 4 << 20), (len(column), 3000)):
        monkeypatch.setattr(passage_quality, "_SLICE", most)
        together, found = [], []
        for i in range(0, len(column), size):
            for x, bags in passage_quality.passages(column[i : i + size]):
                together += [x[a:b] for a, b in zip(bags, bags[1:])]
                found.append(model.score(x, bags))
        assert all(np.array_equal(a, b) for a, b in zip(alone, together, strict=True))
        assert np.allclose(np.concatenate(found), scores, rtol=0, atol=1e-12)


def test_repeated_pairs_are_counted_in_each_row():
    texts = ["a b c a b", "a b", "b c", "x x x", "", "a b c d"]
    x = np.concatenate([x for x, _ in passage_quality.passages(pa.array(texts))])
    assert np.allclose(x[:, 12], [2 / 5, 0, 0, 2 / 3, 0])


def test_sample_is_bounded_and_skips_held_out(spark, insults):
    texts, labels = insults
    rows = labelled_sample(texts, labels, "toxic", 20, ~held_out(3, 1)).join(texts.select("doc_id", held_out(3, 1).alias("out")), "doc_id").collect()
    assert len(rows) == 40 and not any(r["out"] for r in rows)


def test_toxicity_learns_from_every_labelled_document(spark, insults, monkeypatch):
    """Several shards, and a bucket that only a few of all documents have is known."""
    texts, labels = insults
    monkeypatch.setattr(toxicity, "SHARD", 150)
    rows = toxicity._words(labelled(texts, labels, "toxic", ~held_out(3, 1), also=("lang",)), 4).toPandas()
    want = {r["doc_id"] for r in texts.filter(~held_out(3, 1)).collect()}
    assert set(rows["doc_id"]) == want and len(rows) == len(want) and len(set(rows["shard"])) == 4
    network = toxicity.train(texts, labels)
    again = toxicity.train(texts.repartition(7), labels)
    times = {}
    for words in rows["words"][~rows["back"]]:
        for w in set(words.tolist()):
            times[w] = times.get(w, 0) + 1
    assert network.known.tolist() == sorted(w for w, n in times.items() if n >= toxicity.LEAST_TEXTS)
    assert np.array_equal(network.vectors, again.vectors) and network.shift == again.shift
    scored = toxicity.score(texts.withColumn("out", held_out(3, 1)), network).join(labels.withColumnRenamed("toxic", "t"), "doc_id").filter("out").collect()
    assert np.mean([r["predicted"] == r["t"] for r in scored]) > 0.97


def test_packed_weights_come_back():
    net = toxicity.fit([np.arange(50, dtype=np.int32)] * 6, np.array([0, 1, 0, 1, 0, 1.0]), epochs=1)
    back, adagrad = toxicity._unpacked(net.known, toxicity._packed(net, toxicity._Adagrad(0.03)))
    for name in ("vectors", "filters", "bias", "out"):
        assert np.array_equal(getattr(net, name), getattr(back, name))
        assert np.allclose(adagrad.sums[name], 1e-6)
    assert np.isclose(net.out_bias, back.out_bias)
