"""Quality rules: exact document statistics, a base rule, and gradient-boosted trees.

The trees are fitted on a bounded sample of labelled documents, with monotonic
constraints on the statistics where more can only be worse, and flattened into node
arrays, so that a batch is scored by a few array look-ups per level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gaugework.llm.labelled import labelled_sample
from gaugework.llm.words import SPACE, row_slices, shingle_hashes, text_bytes, word_hashes

WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
SYMBOLS = b"#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics the trees see, with the sign of their effect: -1 can only lower the score.
FEATURES = {
    "words": 0, "word_length": 0, "symbols": -1, "dup_lines": -1, "repeated": -1, "upper": -1,
    "digits": 0, "marks": -1, "distinct": 0, "same_as_last": -1, "beyond_ascii": 0, "longest_word": 0,
}
_SLICE = 2 << 20


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_CLASSES = {
    "space": SPACE, "symbols": _table(SYMBOLS), "upper": _table(bytes(range(0x41, 0x5B))),
    "digits": _table(bytes(range(0x30, 0x3A))), "marks": _table(b"!?;:\"'()[]{}_=+~^`@/\\"),
    "tail": _table(bytes(range(0x80, 0xC0))), "lead": _table(bytes(range(0xC0, 0x100))),
}


def _duplicate_lines(text: bytes) -> int:
    seen: set[bytes] = set()
    found = 0
    for line in text.split(b"\n"):
        if line.strip(b" \t\n\x0b\x0c\r"):
            if line in seen:
                found += 1
            seen.add(line)
    return found


def _repeated_words(shingles: np.ndarray, n: int) -> int:
    """Words inside a window of five that occurs more than once in the text."""
    if n < WINDOW + 1:
        return 0
    _, where, times = np.unique(shingles, return_inverse=True, return_counts=True)
    at = np.flatnonzero(times[where] > 1)
    if not len(at):
        return 0
    return int(WINDOW + np.minimum(np.diff(at), WINDOW).sum())


def statistics(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Base counts (rows x 5, exact) and features (rows x 12) of a column of texts."""
    data, bounds = text_bytes(column)
    n = len(bounds) - 1
    base, features = np.zeros((n, len(BASE)), np.int64), np.zeros((n, len(FEATURES)))
    for i, j in row_slices(bounds, _SLICE):
        part, cuts = data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
        hashes, starts, ends, rows = word_hashes(part, cuts)
        shingles, runs = shingle_hashes(hashes, rows, WINDOW)
        count = {}
        for name, table in _CLASSES.items():
            at = np.flatnonzero(table[part])
            count[name] = np.diff(np.searchsorted(at, cuts))
        words = np.diff(rows)
        chars = np.diff(cuts) - count["space"] - count["tail"]
        same = np.zeros(len(hashes) + 1, np.int64)
        same[2:] = np.cumsum(hashes[1:] == hashes[:-1])[: len(hashes) - 1] if len(hashes) > 1 else 0
        for r in range(j - i):
            a, b = rows[r], rows[r + 1]
            own = hashes[a:b]
            base[i + r] = (
                words[r], chars[r], count["symbols"][r], _duplicate_lines(part[cuts[r] : cuts[r + 1]].tobytes()),
                _repeated_words(shingles[runs[r] : runs[r + 1]], len(own)),
            )
            features[i + r, 8] = len(np.unique(own)) / max(1, len(own))
            features[i + r, 9] = (same[b] - same[min(a + 1, b)]) / max(1, len(own))
            features[i + r, 11] = np.log1p((ends[a:b] - starts[a:b]).max()) if b > a else 0
        w, c = np.maximum(words, 1), np.maximum(chars, 1)
        f = features[i:j]
        f[:, 0], f[:, 1] = np.log1p(words), chars / w
        f[:, 2], f[:, 3], f[:, 4] = count["symbols"] / c, base[i:j, 3] / w, base[i:j, 4] / w
        f[:, 5], f[:, 6], f[:, 7], f[:, 10] = (count[k] / c for k in ("upper", "digits", "marks", "lead"))
    return base, features


def base_failed(base: np.ndarray) -> np.ndarray:
    return (base[:, 0] < LEAST_WORDS) | (100 * base[:, 4] > MOST_REPEATED_PERCENT * base[:, 0])


@dataclass
class Trees:
    """Boosted trees as node arrays (tree x node); node i has children 2i+1 and 2i+2."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    start: float
    cut: float = 0.5

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        row = np.arange(len(x))
        depth = int(np.log2(self.value.shape[1] + 1)) - 1
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[row, feature[node]] > threshold[node])
            total += value[node]
        return 1 / (1 + np.exp(-total))


def fit_trees(
    x: np.ndarray, y: np.ndarray, signs: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.15,
    bins: int = 32, ridge: float = 1.0, least: int = 10, keep_rate: float = 0.995,
) -> Trees:
    """Boost on the logistic loss over quantile bins.

    A split on a constrained feature is refused when it would order its two values the
    wrong way, and both sides keep to their side of the middle from there on.  The cut
    below which a document is rejected lies under ``keep_rate`` of the good ones.
    """
    nodes = 2 ** (depth + 1) - 1
    feature = np.zeros((rounds, nodes), np.int64)
    threshold, value = np.full((rounds, nodes), np.inf), np.zeros((rounds, nodes))
    start = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    if not 0 < y.sum() < len(y):
        return Trees(feature[:0], threshold[:0], value[:0], start, 0.0)
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], 1)
    total = np.full(len(y), start)
    for t in range(rounds):
        p = 1 / (1 + np.exp(-total))
        gradient, weight = y - p, p * (1 - p)
        node, low, high = np.zeros(len(y), np.int64), {0: -np.inf}, {0: np.inf}
        value[t, 0] = gradient.sum() / (weight.sum() + ridge)
        for k in range(2**depth - 1):
            rows = np.flatnonzero(node == k)
            best = None
            g, h = gradient[rows].sum(), weight[rows].sum()
            for f, e in enumerate(edges) if len(rows) >= 2 * least else ():
                gs = np.cumsum(np.bincount(binned[rows, f], gradient[rows], len(e) + 1))[:-1]
                hs = np.cumsum(np.bincount(binned[rows, f], weight[rows], len(e) + 1))[:-1]
                ns = np.cumsum(np.bincount(binned[rows, f], minlength=len(e) + 1))[:-1]
                left = np.clip(gs / (hs + ridge), low[k], high[k])
                right = np.clip((g - gs) / (h - hs + ridge), low[k], high[k])
                gain = gs**2 / (hs + ridge) + (g - gs) ** 2 / (h - hs + ridge) - g**2 / (h + ridge)
                ok = (ns >= least) & (len(rows) - ns >= least) & (signs[f] * (right - left) >= 0)
                if ok.any() and (best is None or gain[ok].max() > best[0]):
                    s = int(np.flatnonzero(ok)[gain[ok].argmax()])
                    best = (gain[s], f, s, left[s], right[s])
            a, b = 2 * k + 1, 2 * k + 2
            low[a], high[a], low[b], high[b] = low[k], high[k], low[k], high[k]
            if best is None or best[0] <= 1e-9:
                node[rows] = a
                value[t, a] = value[t, b] = value[t, k]
                continue
            _, f, s, left, right = best
            feature[t, k], threshold[t, k], value[t, a], value[t, b] = f, edges[f][s], left, right
            node[rows] = a + (binned[rows, f] > s)
            if signs[f]:
                middle = (left + right) / 2
                if signs[f] > 0:
                    high[a], low[b] = min(high[k], middle), max(low[k], middle)
                else:
                    low[a], high[b] = max(low[k], middle), min(high[k], middle)
        value[t] *= rate
        total += value[t][node]
    trees = Trees(feature, threshold, value, start)
    good = trees.score(x)[y == 1]
    trees.cut = float(min(0.5, np.quantile(good, 1 - keep_rate)))
    return trees


def train(docs: DataFrame, labels: DataFrame, most_per_class: int = 3000) -> Trees:
    """Fit on the statistics of at most ``most_per_class`` labelled documents of each class."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = statistics(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.string()), batch.column("label").cast(pa.int32()),
                 pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "label", "x"],
            )

    rows = (
        labelled_sample(docs, labels, "quality", most_per_class)
        .mapInArrow(measure, "doc_id string, label int, x array<double>").toPandas().sort_values("doc_id")
    )
    signs = np.array(list(FEATURES.values()))
    if rows.empty:
        return fit_trees(np.zeros((0, len(signs))), np.zeros(0), signs)
    return fit_trees(np.stack(rows["x"].tolist()), rows["label"].to_numpy(float), signs)


def judge(docs: DataFrame, trees: Trees) -> DataFrame:
    """Every document with its base counts, ``base_failed``, ``score`` and ``kept``.

    All columns of ``docs`` stay, a clashing one gives way to the new column; a null text
    counts as empty, fails the base rule and is not kept.  Whole texts are read.
    """
    model = docs.sparkSession.sparkContext.broadcast(trees)
    added = [*BASE, "base_failed", "score", "kept"]
    own = [c for c in docs.columns if c not in added]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*own).schema)
    schema = f"{fields}, {', '.join(f'{c} long' for c in BASE)}, base_failed boolean, score double, kept boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, x = statistics(batch.column("text"))
            failed, score = base_failed(base), model.value.score(x)
            new = [*base.T, failed, score, ~failed & (score >= model.value.cut)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in own), *map(pa.array, new)], [*own, *added]
            )

    return docs.select(*own).mapInArrow(run, schema)
