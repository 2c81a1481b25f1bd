"""Word and shingle hashes against Python's own words."""

import numpy as np
import pyarrow as pa

from gaugework.llm import words

from .conftest import WORDS, lower, make_text


def test_words_and_shingles(monkeypatch):
    for piece in (1 << 19, 64):
        monkeypatch.setattr(words, "_PIECE", piece)
        texts = [None, "", "a", "A b", " \x0b tab\tx\x1cy", "é ü ñ z", "w" * 500, make_text(4, 400), "a", "b a"]
        data, bounds = words.text_bytes(pa.array(texts, pa.string()).slice(0))
        hashes, starts, ends, rows = words.word_hashes(data, bounds, words.LOWER)
        names, shingles = {}, {}
        values, runs = words.shingle_hashes(hashes, rows)
        for k, text in enumerate(texts):
            own = WORDS.findall(lower(text))
            assert [data[a:b].tobytes().decode().lower() for a, b in zip(starts[rows[k] : rows[k + 1]], ends[rows[k] : rows[k + 1]])] == own
            for w, h in zip(own, hashes[rows[k] : rows[k + 1]].tolist()):
                assert names.setdefault(w, h) == h
            want = [tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))] if own else []
            got = values[runs[k] : runs[k + 1]].tolist()
            assert len(got) == len(want)
            for s, h in zip(want, got):
                assert shingles.setdefault(s, h) == h
        assert len(set(names.values())) == len(names) and len(set(shingles.values())) == len(shingles)


def test_slices_cover_all_rows():
    bounds = np.array([0, 5, 5, 30, 31, 90])
    assert list(words.row_slices(bounds, 20)) == [(0, 2), (2, 3), (3, 4), (4, 5)]
