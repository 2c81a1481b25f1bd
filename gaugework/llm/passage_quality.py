"""Quality by attention-based multiple-instance learning over passages.

A document is a bag of passages of some words each.  Every passage is encoded from its
own statistics and a hashed sketch of its words; gated attention weighs the passages,
and the weighted sum of their encodings is scored.  Only document labels are learned
from; the weights say which passages decided.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gaugework.llm.labelled import held_out, labelled_sample
from gaugework.llm.words import row_slices, text_bytes, word_hashes

PASSAGE = 64
MODULUS, REST, CUT = 4, 2, 0.7
HIDDEN, GATE = 16, 8
_SKETCH = 8
_SLICE = 4 << 20
_CLASSES = [b"#*$%&|<>", bytes(range(0x41, 0x5B)), bytes(range(0x30, 0x3A)), b"!?", b".,;:", b"\n", bytes(range(0x80, 0x100))]
FEATURES = len(_CLASSES) + 6 + _SKETCH


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_TABLES = [_table(c) for c in _CLASSES]


def passages(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features of the passages of runs of rows, and where each row's begin; no words, no passage."""
    data, bounds = text_bytes(column)
    for i, j in row_slices(bounds, _SLICE):
        part = data[bounds[i] : bounds[j]]
        hashes, starts, ends, rows = word_hashes(part, bounds[i : j + 1] - bounds[i])
        words = np.diff(rows)
        count = -(-words // PASSAGE)
        bags = np.concatenate([[0], np.cumsum(count)])
        row = np.repeat(np.arange(j - i), count)
        first = rows[row] + PASSAGE * (np.arange(bags[-1]) - bags[row])
        last = np.minimum(first + PASSAGE, rows[row + 1])
        yield _features(part, hashes, starts, ends, first, last, rows), bags


def _repeated_pairs(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Per word, whether it and the word before it in its row are a pair that the row holds again."""
    out = np.zeros(len(hashes), bool)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    at = np.flatnonzero(row[1:] == row[:-1]) + 1
    pairs = hashes[at] * np.uint64(3) + hashes[at - 1]
    order = np.lexsort((pairs, row[at]))
    pairs, at, row = pairs[order], at[order], row[at][order]
    equal = (pairs[1:] == pairs[:-1]) & (row[1:] == row[:-1])
    out[at[1:][equal]] = True
    out[at[:-1][equal]] = True
    return out


def _features(part, hashes, starts, ends, first, last, rows) -> np.ndarray:
    n = (last - first).astype(float)
    out = np.zeros((len(first), FEATURES))
    if not len(first):
        return out
    begin, end = starts[first], ends[last - 1]
    for k, table in enumerate(_TABLES):
        at = np.flatnonzero(table[part])
        out[:, k] = (np.searchsorted(at, end) - np.searchsorted(at, begin)) / np.maximum(1, end - begin)
    at = len(_TABLES)
    length = np.concatenate([[0], np.cumsum(ends - starts)])
    out[:, at] = np.log1p((length[last] - length[first]) / n)
    bag = np.repeat(np.arange(len(first)), last - first)
    order = np.lexsort((hashes, bag))
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[order][1:] == hashes[order][:-1]) & (bag[order][1:] == bag[order][:-1])
    out[:, at + 1] = np.bincount(bag[order][again], minlength=len(first)) / n
    same = np.zeros(len(hashes) + 1)
    same[2:] = np.cumsum(hashes[1:] == hashes[:-1])
    out[:, at + 2] = (same[last] - same[np.minimum(first + 1, last)]) / n
    out[:, at + 3] = np.log1p(n)
    out[:, at + 4] = np.log1p(np.maximum.reduceat(ends - starts, first))
    twice = np.concatenate([[0], np.cumsum(_repeated_pairs(hashes, rows))])
    out[:, at + 5] = (twice[last] - twice[np.minimum(first + 1, last)]) / n
    for k in range(_SKETCH):
        signs = np.concatenate([[0.0], np.cumsum(((hashes >> np.uint64(7 * k)) & np.uint64(1)).astype(float) - 0.5)])
        out[:, at + 6 + k] = (signs[last] - signs[first]) / n
    return out


@dataclass
class Attention:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    shift: float = 0.0

    def forward(self, x: np.ndarray, bags: np.ndarray) -> dict[str, np.ndarray]:
        """Attention and logits of bags of passages; an empty bag is the zero vector."""
        w = self.weights
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ w["encode"] + w["encode_bias"])
        tanh, gate = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-(h @ w["u"])))
        s = (tanh * gate) @ w["attend"]
        bag = np.repeat(np.arange(len(bags) - 1), np.diff(bags))
        top = np.full(len(bags) - 1, -np.inf)
        np.maximum.at(top, bag, s)
        e = np.exp(s - top[bag])
        a = e / np.bincount(bag, e, minlength=len(bags) - 1)[bag]
        z = np.zeros((len(bags) - 1, h.shape[1]))
        np.add.at(z, bag, a[:, None] * h)
        return {"x": x, "h": h, "tanh": tanh, "gate": gate, "a": a, "bag": bag, "z": z, "logit": z @ w["out"] + w["out_bias"][0]}

    def score(self, x: np.ndarray, bags: np.ndarray) -> np.ndarray:
        logit = self.forward(x, bags)["logit"] - self.shift + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


def _gradients(model: Attention, x: np.ndarray, bags: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    w, f = model.weights, model.forward(x, bags)
    wrong = (1 / (1 + np.exp(-f["logit"])) - y) / len(y)
    dz = wrong[:, None] * w["out"]
    bag, a, h = f["bag"], f["a"], f["h"]
    da = (dz[bag] * h).sum(1)
    ds = a * (da - np.bincount(bag, a * da, minlength=len(y))[bag])
    dboth = ds[:, None] * w["attend"]
    dv, du = dboth * f["gate"] * (1 - f["tanh"] ** 2), dboth * f["tanh"] * f["gate"] * (1 - f["gate"])
    dh = (a[:, None] * dz[bag] + dv @ w["v"].T + du @ w["u"].T) * (1 - h**2)
    return {
        "out": f["z"].T @ wrong, "out_bias": np.array([wrong.sum()]), "attend": (f["tanh"] * f["gate"]).T @ ds,
        "v": h.T @ dv, "u": h.T @ du, "encode": f["x"].T @ dh, "encode_bias": dh.sum(0),
    }


def fit(x: list[np.ndarray], y: np.ndarray, epochs: int = 25, batch: int = 64, rate: float = 0.01, seed: int = 3) -> Attention:
    """Adam on the logistic loss of whole documents."""
    random = np.random.default_rng(seed)
    every = np.concatenate(x) if x and sum(map(len, x)) else np.zeros((1, FEATURES))
    start = lambda *shape: random.standard_normal(shape) / np.sqrt(shape[0])
    weights = {
        "encode": start(FEATURES, HIDDEN), "encode_bias": np.zeros(HIDDEN), "v": start(HIDDEN, GATE), "u": start(HIDDEN, GATE),
        "attend": start(GATE), "out": start(HIDDEN), "out_bias": np.zeros(1),
    }
    model = Attention(every.mean(0), every.std(0) + 1e-3, weights)
    if not 0 < y.sum() < len(y):
        weights["out"][:], weights["out_bias"][:] = 0, np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        return model
    first, second, step = {k: np.zeros_like(v) for k, v in weights.items()}, {k: np.zeros_like(v) for k, v in weights.items()}, 0
    order = np.arange(len(y))
    for _ in range(epochs):
        random.shuffle(order)
        for at in range(0, len(order), batch):
            taken, step = order[at : at + batch], step + 1
            bags = np.concatenate([[0], np.cumsum([len(x[k]) for k in taken])])
            for k, g in _gradients(model, np.concatenate([x[k] for k in taken]), bags, y[taken]).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g**2
                weights[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    bags = np.concatenate([[0], np.cumsum([len(p) for p in x])])
    logit = model.forward(np.concatenate(x), bags)["logit"]
    model.shift = between(logit, y)
    return model


def between(logit: np.ndarray, y: np.ndarray) -> float:
    """Where to put the cut: the middle of the places with the least error, each class weighing the same."""
    order = np.argsort(logit)
    x, t = logit[order], y[order]
    missed = np.concatenate([[0], np.cumsum(t)]) / t.sum()
    alarms = np.concatenate([np.cumsum((1 - t)[::-1])[::-1], [0]]) / (1 - t).sum()
    edges = np.concatenate([[x[0] - 1], (x[1:] + x[:-1]) / 2, [x[-1] + 1]])
    cost = missed + alarms
    best = np.flatnonzero(cost <= cost.min() + 1e-9)
    return float(edges[best[len(best) // 2]])


def train(docs: DataFrame, labels: DataFrame, most_per_class: int = 3000, usable=None) -> Attention:
    """Fit on at most ``most_per_class`` labelled documents of each class; labels of held-out rows are not read."""
    sample = labelled_sample(docs, labels, "quality", most_per_class, ~held_out(MODULUS, REST) if usable is None else usable)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [x[b[r] : b[r + 1]] for x, b in passages(batch.column("text")) for r in range(len(b) - 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.string()), batch.column("label").cast(pa.int32()),
                 pa.array([b.astype(np.float32).ravel() for b in bags], pa.list_(pa.float32()))], ["doc_id", "label", "x"],
            )

    rows = sample.select("doc_id", "label", "text").mapInArrow(gather, "doc_id string, label int, x array<float>").toPandas()
    rows = rows.sort_values("doc_id", ignore_index=True)
    return fit([np.asarray(x, float).reshape(-1, FEATURES) for x in rows["x"]], rows["label"].to_numpy(float))


def score(docs: DataFrame, model: Attention) -> DataFrame:
    """All rows of ``docs`` with ``score`` (0 to 1), ``predicted`` and ``passage``, the number of the heaviest passage.

    The score reads only the text.  A null text is empty; a text without words has no
    passages, a null ``passage`` and one same score.  ``predicted`` is 1 from a score of
    0.7.  The text goes, other columns stay, clashing ones give way.
    """
    made = ["score", "predicted", "passage"]
    own = [c for c in docs.columns if c not in (*made, "text")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*own).schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, heaviest = [np.zeros(0)], []
            for x, bags in passages(batch.column("text")):
                found = shared.value.forward(x, bags)
                scores.append(shared.value.score(x, bags))
                heaviest += [int(found["a"][a:b].argmax()) if b > a else None for a, b in zip(bags[:-1], bags[1:])]
            s = np.concatenate(scores)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in own), pa.array(s), pa.array((s >= CUT).astype(np.int32)), pa.array(heaviest, pa.int64())], [*own, *made]
            )

    return docs.select(*own, "text").mapInArrow(run, f"{fields + ', ' if own else ''}score double, predicted int, passage long")
