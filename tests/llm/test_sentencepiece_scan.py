"""The scan against one pass over the whole text, and the round trip with the public library."""

import random

import pytest
import sentencepiece

from gaugework.llm import sentencepiece_scan as scan

PIECES = ["the ", "a", "b", " ", "  ", "ing", "tion", "日", "本", "\n", "é", "xyzq", "▁", "-----"]


@pytest.fixture(scope="module")
def vocabulary():
    return scan.Vocabulary.load()


def best_score(vocabulary, text):
    best = [0] + [scan._NONE] * len(text)
    for at in range(len(text)):
        for end, score in vocabulary.edges(text, at):
            best[end] = max(best[end], best[at] + score)
    return best[-1]


def path_score(vocabulary, text):
    return sum(vocabulary.word(w)[0] for w in scan._WORDS.findall(text))


def test_chunked_scan_is_as_good_as_one_pass(vocabulary):
    rng, back = random.Random(8), vocabulary.longest - 1
    for _ in range(80):
        pieces = PIECES if rng.random() < 0.7 else ["x", "y", "ab", "日", "=="]
        text = scan.marked("".join(rng.choice(pieces) for _ in range(rng.randrange(1, 120))))
        parts = scan.chunks(text, 20)
        matrices = [scan.transfer(vocabulary, text[max(0, a - back) : a], text[a:b]) for a, b in parts]
        whole = matrices[0]
        for m in matrices[1:]:
            whole = scan.product(whole, m)
        assert whole[0, 0] == best_score(vocabulary, text)
        states = scan.trace(matrices, 0, 0)
        cut = [text[a - s : b - e] for (a, b), s, e in zip(parts, states, states[1:])]
        assert "".join(cut) == text and sum(path_score(vocabulary, c) for c in cut) == whole[0, 0]


def test_products_are_associative(vocabulary):
    text = scan.marked("thethingtion日本xyz" * 20)
    a, b, c = (scan.transfer(vocabulary, text[max(0, i - 15) : i], text[i : i + 40]) for i in (40, 80, 120))
    assert (scan.product(scan.product(a, b), c) == scan.product(a, scan.product(b, c))).all()


@pytest.mark.parametrize("chunk", [1 << 15, 64])
def test_round_trip(docs, corpus, chunk):
    back = scan.decode(scan.encode(docs, chunk=chunk)).collect()
    model = sentencepiece.SentencePieceProcessor(model_file=scan.MODEL)
    assert len(back) == len(corpus)
    for r in back:
        text = (r["text"] or "").replace(scan.MARK, " ")
        assert r["decoded"] == text and len(r["ids"]) == r["n_tokens"]
        assert model.decode(list(r["ids"])) == text


def test_levels_of_the_scan(spark, monkeypatch, vocabulary):
    monkeypatch.setattr(scan, "FAN", 2)
    text = "日本語tokens" * 60
    df = spark.createDataFrame([(1, text), (2, text), (2, text), (None, text + "x")], "doc_id long, text string")
    for r in scan.encode(df, chunk=40).collect():
        pieces = scan.marked(r["text"])
        assert vocabulary.decode(list(r["ids"])) == r["text"]
        assert path_score(vocabulary, pieces) == best_score(vocabulary, pieces)


def test_no_rows(no_docs):
    assert scan.decode(scan.encode(no_docs)).collect() == []


def test_words_learned_together_are_words_learned_alone():
    together, alone = scan.Vocabulary.load(), scan.Vocabulary.load()
    rng = random.Random(2)
    words = ["".join(rng.choice(PIECES[:-2]).strip() or "e" for _ in range(rng.randint(1, 9))) for _ in range(1500)]
    text = scan.marked(" ".join(words))
    got = together.encode(text)
    assert len(together.cache) > 200
    assert together.decode(got) == " ".join(words)
    for word in scan._WORDS.findall(text):
        assert together.cache[word] == alone.word(word)[1]
