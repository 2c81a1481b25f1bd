"""Toxicity: a convolutional text classifier in numpy over hashed word embeddings.

Words are hashed to buckets; the buckets that several training documents use have
vectors, all others share one.  Filters of several widths slide over the words of the
whole text, each filter's greatest value is kept, and a logistic layer scores them.
All usable labelled documents are learned from: they are dealt to shards, every shard
takes its steps from the same weights, and the weights of the shards are averaged after
each pass.  A fifth of the documents is held back to place the decision threshold, for
all texts and by language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.llm.labelled import held_out, labelled
from gaugework.llm.staging import keep
from gaugework.llm.words import PUNCTUATION, row_slices, text_bytes, word_hashes

BUCKETS = 1 << 22
WIDTHS, FILTERS, DIMENSIONS = (1, 2, 3), 8, 8
MODULUS, REST, CUT = 3, 1, 0.7
EPOCHS, BATCH, RATE, LEAST_TEXTS, SEED = 8, 64, 0.03, 5, 5
#: Labelled documents of a shard, and one part in so many held back for the threshold.
SHARD, BACK = 4000, 5
#: Steps of a logit that are told apart for the threshold, and of a weight in an average.
_STEPS, _FIXED = 1024, 1 << 40
_SLICE, _BLOCK = 1 << 20, 1 << 17


def buckets(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word buckets of runs of rows, and where each row's begin; texts are in lower case already."""
    data, bounds = text_bytes(column)
    for i, j in row_slices(bounds, _SLICE):
        hashes, _, _, rows = word_hashes(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], gap=PUNCTUATION)
        yield (hashes & np.uint64(BUCKETS - 1)).astype(np.int32), rows


@dataclass
class Network:
    known: np.ndarray
    vectors: np.ndarray  # of rare words, then of the known buckets, then of padding
    filters: np.ndarray  # dimensions x (tap, filter) of all widths
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    shift: float = 0.0
    by_language: dict[str, float] | None = None

    def places(self, ids: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.known, ids)
        at[at == len(self.known)] = 0
        return np.where(self.known[at] == ids, at + 1, 0) if len(self.known) else np.zeros(len(ids), np.int64)

    def responses(self, places: np.ndarray) -> np.ndarray:
        """Every filter at every word; the places past the end are padding."""
        taps = self.vectors[np.concatenate([places, np.full(max(WIDTHS) - 1, len(self.known) + 1)])] @ self.filters
        n, parts, at = len(places), [], 0
        for width in WIDTHS:
            parts.append(sum(taps[k : k + n, at + k * FILTERS : at + (k + 1) * FILTERS] for k in range(width)))
            at += width * FILTERS
        return np.concatenate(parts, 1)

    def pooled(self, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Greatest response of each filter per row, in blocks of words; rows without words have zeros."""
        out = np.zeros((len(rows) - 1, len(self.bias)), np.float32)
        some = np.flatnonzero(np.diff(rows))
        i = 0
        while i < len(some):
            j = max(i + 1, int(np.searchsorted(rows[some + 1], rows[some[i]] + _BLOCK, "right")))
            first, last = rows[some[i]], rows[some[j - 1] + 1]
            if j == i + 1 and last - first > _BLOCK:
                overlap = max(WIDTHS) - 1
                best = [self.responses(self.places(ids[a : min(last, a + _BLOCK + overlap)])).max(0) for a in range(first, last, _BLOCK)]
                out[some[i]] = np.max(best, 0)
            else:
                padded, starts, ends = _padded(ids[first:last], rows[some[i:j]] - first, rows[some[i:j] + 1] - first)
                places = np.where(padded >= 0, self.places(padded), len(self.known) + 1)
                cuts = np.stack([starts, ends], 1).ravel()[:-1]
                out[some[i:j]] = np.maximum.reduceat(self.responses(places), cuts)[::2]
            i = j
        return out

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias

    def score(self, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
        x = self.logits(self.pooled(ids, rows)).astype(np.float64) - self.shift + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _padded(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with padding (-1) between them, so that no filter sees two rows."""
    gap = max(WIDTHS) - 1
    moved = starts + gap * np.arange(len(starts))
    out = np.full(len(ids) + gap * len(starts), -1, np.int64)
    out[np.arange(len(ids)) + gap * np.repeat(np.arange(len(starts)), ends - starts)] = ids
    return out, moved, moved + (ends - starts)


class _Adagrad:
    def __init__(self, rate: float):
        self.rate, self.sums = rate, {}

    def step(self, name: str, value: np.ndarray, gradient: np.ndarray) -> None:
        total = self.sums.setdefault(name, np.full(value.shape, 1e-6, value.dtype))
        total += gradient**2
        value -= self.rate * gradient / np.sqrt(total)

    def sums_of(self, name: str, value: np.ndarray) -> np.ndarray:
        return self.sums.setdefault(name, np.full(value.shape, 1e-6, value.dtype))

    def step_rows(self, name: str, value: np.ndarray, rows: np.ndarray, gradient: np.ndarray) -> None:
        total = self.sums.setdefault(name, np.full(value.shape, 1e-6, value.dtype))
        total[rows] += gradient**2
        value[rows] -= self.rate * gradient / np.sqrt(total[rows])


def start(known: np.ndarray, seed: int = SEED) -> Network:
    """Weights before the first step, for the sorted buckets ``known``."""
    random = np.random.default_rng(seed)
    net = Network(
        known, (0.02 * random.standard_normal((len(known) + 2, DIMENSIONS))).astype(np.float32),
        (0.5 * random.standard_normal((DIMENSIONS, sum(WIDTHS) * FILTERS))).astype(np.float32), np.full(FILTERS * len(WIDTHS), -0.1, np.float32),
        (0.3 * random.standard_normal(FILTERS * len(WIDTHS))).astype(np.float32), 0.0,
    )
    net.vectors[-1] = 0
    return net


def constant_network(known: np.ndarray, ones: int, n: int) -> Network:
    """What can be said where one class is missing."""
    net = start(known)
    net.out[:], net.out_bias = 0, float(np.log((ones + 1) / (n - ones + 1)))
    return net


def steps(net: Network, adagrad: _Adagrad, places: list[np.ndarray], y: np.ndarray, order: np.ndarray, weight: np.ndarray, batch: int = BATCH) -> None:
    """One pass over some texts; ``weight`` is that of an error of class 0 and of class 1."""
    known, bias = net.known, np.array([net.out_bias], np.float32)
    for at in range(0, len(order), batch):
        taken = [k for k in order[at : at + batch] if len(places[k])]
        if not taken:
            continue
        responses = [net.responses(places[k]) for k in taken]
        where = np.stack([r.argmax(0) for r in responses])
        pooled = np.stack([r[w, np.arange(len(w))] for r, w in zip(responses, where)])
        hidden = np.maximum(pooled + net.bias, 0)
        wrong = ((1 / (1 + np.exp(-(hidden @ net.out + bias[0]))) - y[taken]) * weight[y[taken].astype(int)]).astype(np.float32) / len(taken)
        back = wrong[:, None] * net.out * (hidden > 0)
        filters = np.zeros_like(net.filters)
        rows, parts, column = [], [], 0
        for i, width in enumerate(WIDTHS):
            own = back[:, i * FILTERS : (i + 1) * FILTERS]
            for tap in range(width):
                words = np.stack([
                    np.append(places[k], [len(known) + 1] * width)[w[i * FILTERS : (i + 1) * FILTERS] + tap] for k, w in zip(taken, where)
                ])
                span = slice(column + tap * FILTERS, column + (tap + 1) * FILTERS)
                filters[:, span] = np.einsum("nfd,nf->df", net.vectors[words], own)
                rows.append(words.ravel())
                parts.append((own[:, :, None] * net.filters[:, span].T[None]).reshape(-1, DIMENSIONS))
            column += width * FILTERS
        touched, inverse = np.unique(np.concatenate(rows), return_inverse=True)
        vectors = np.zeros((len(touched), DIMENSIONS), np.float32)
        np.add.at(vectors, inverse, np.concatenate(parts))
        adagrad.step("out", net.out, hidden.T @ wrong + 1e-4 * net.out)
        adagrad.step("out_bias", bias, wrong.sum(keepdims=True))
        adagrad.step("bias", net.bias, back.sum(0))
        adagrad.step("filters", net.filters, filters + 1e-4 * net.filters)
        adagrad.step_rows("vectors", net.vectors, touched, vectors)
        net.vectors[-1] = 0
    net.out_bias = float(bias[0])


def fit(
    texts: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, least_texts: int = LEAST_TEXTS, seed: int = SEED
) -> Network:
    """Train on bucket arrays in one place; ``y`` is 0 or 1."""
    seen = np.concatenate([np.unique(t) for t in texts]) if texts else np.zeros(0, np.int32)
    known, times = np.unique(seen, return_counts=True)
    known = known[times >= least_texts]
    if not 0 < y.sum() < len(y):
        return constant_network(known, y.sum(), len(y))
    net = start(known, seed)
    random, adagrad = np.random.default_rng(seed), _Adagrad(rate)
    places, order = [net.places(t) for t in texts], np.arange(len(y))
    for _ in range(epochs):
        random.shuffle(order)
        steps(net, adagrad, places, y, order, np.ones(2), batch)
    return net


def _packed(net: Network, adagrad: _Adagrad) -> np.ndarray:
    """All weights, and the sums of their squared gradients beside them, in rows of ``DIMENSIONS``."""
    dense = [("filters", net.filters), ("bias", net.bias), ("out", net.out), ("out_bias", np.array([net.out_bias], np.float32))]
    halves = []
    for vectors, rest in (
        (net.vectors, [v.ravel() for _, v in dense]),
        (adagrad.sums_of("vectors", net.vectors), [adagrad.sums_of(n, v).ravel() for n, v in dense]),
    ):
        flat = np.concatenate(rest).astype(np.float32)
        halves.append(np.concatenate([vectors, np.pad(flat, (0, -len(flat) % DIMENSIONS)).reshape(-1, DIMENSIONS)]))
    return np.concatenate(halves, 1)


def _unpacked(known: np.ndarray, rows: np.ndarray) -> tuple[Network, _Adagrad]:
    net, adagrad, n = start(known), _Adagrad(RATE), len(known) + 2
    for half, put in ((rows[:, :DIMENSIONS], True), (rows[:, DIMENSIONS:], False)):
        flat, at = half[n:].ravel().astype(np.float32), 0
        values = {"vectors": half[:n].astype(np.float32)}
        for name, shape in (("filters", net.filters.shape), ("bias", net.bias.shape), ("out", net.out.shape), ("out_bias", (1,))):
            size = int(np.prod(shape))
            values[name], at = flat[at : at + size].reshape(shape).copy(), at + size
        if put:
            net.vectors, net.filters, net.bias, net.out, net.out_bias = (
                values["vectors"], values["filters"], values["bias"], values["out"], float(values["out_bias"][0])
            )
        else:
            adagrad.sums = values
    return net, adagrad


def _pass(rows: DataFrame, known: np.ndarray, packed: np.ndarray, weight: np.ndarray, epoch: int) -> np.ndarray:
    """One pass of all shards from the same weights; a weight becomes the mean over the shards that moved it.

    A shard tells only the rows of weights that it moved; they are added up as whole
    numbers, so that the order of the shards changes nothing.
    """
    shared = rows.sparkSession.sparkContext.broadcast((known, packed))
    columns = [f"w{i}" for i in range(2 * DIMENSIONS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, before = shared.value
        shard = net = adagrad = None

        def moved() -> pa.RecordBatch:
            change = _packed(net, adagrad).astype(np.float64) - before
            at = np.flatnonzero((change != 0).any(1))
            parts = np.rint(change[at] * _FIXED).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), *(pa.array(parts[:, i]) for i in range(2 * DIMENSIONS))], ["row", *columns])

        for batch in batches:
            shards, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "label"))
            for own in np.unique(shards).tolist():
                if own != shard:
                    if net is not None:
                        yield moved()
                    shard, (net, adagrad) = own, _unpacked(words, before)
                taken = np.flatnonzero(shards == own)
                texts = [net.places(batch.column("words")[int(k)].values.to_numpy()) for k in taken]
                order = np.random.default_rng([SEED, epoch, own]).permutation(len(taken))
                steps(net, adagrad, texts, labels[taken].astype(float), order, weight)
        if net is not None:
            yield moved()

    told = rows.select("shard", "label", "words").mapInArrow(run, "row long, " + ", ".join(f"{c} long" for c in columns))
    means = told.groupBy("row").agg(*[(F.sum(c) / F.count(F.lit(1)) / F.lit(_FIXED)).cast("float").alias(c) for c in columns]).toArrow()
    at = means.column("row").to_numpy()
    for i, c in enumerate(columns):
        packed[at, i] += means.column(c).to_numpy()
    shared.destroy()
    return packed


def threshold(logits: np.ndarray, y: np.ndarray, weight: np.ndarray, around: float | None = None, pull: float = 0.0) -> float:
    """Logit with the least weighted error, in the middle of its gap; ``pull`` draws it to ``around``."""
    order = np.argsort(logits)
    x, w, t = logits[order], weight[order], y[order]
    missed = np.concatenate([[0], np.cumsum(w * t)])
    alarms = np.concatenate([np.cumsum((w * (1 - t))[::-1])[::-1], [0]])
    edges = np.concatenate([[x[0] - 1], (x[1:] + x[:-1]) / 2, [x[-1] + 1]])
    cost = missed + alarms
    if around is not None:
        cost = cost + pull * np.abs(edges - around)
    best = np.flatnonzero(cost <= cost.min() + 1e-9)
    return float(edges[best[len(best) // 2]])


def _words(docs: DataFrame, shards: int) -> DataFrame:
    """Word buckets of labelled documents by shard; ``back`` marks those held back."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [ids[rows[r] : rows[r + 1]] for ids, rows in buckets(batch.column("text")) for r in range(len(rows) - 1)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "shard", "back", "lang", "label")), pa.array(words, pa.list_(pa.int32()))],
                ["doc_id", "shard", "back", "lang", "label", "words"],
            )

    dealt = docs.select(
        "doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"),
        (F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(BACK)) == 0).alias("back"), F.coalesce("lang", F.lit("")).alias("lang"), "label", F.lower("text").alias("text"),
    ).repartition(shards, "shard").sortWithinPartitions("shard", F.xxhash64("doc_id"), "doc_id")
    return dealt.mapInArrow(gather, f"doc_id {kind}, shard int, back boolean, lang string, label int, words array<int>")


def _known(rows: DataFrame) -> np.ndarray:
    """Buckets that at least ``LEAST_TEXTS`` of all rows have."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.unique(w.values.to_numpy()) for w in batch.column("words") if len(w)]
            found, times = np.unique(np.concatenate([np.zeros(0, np.int32), *own]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(times.astype(np.int64))], ["bucket", "n"])

    counts = rows.select("words").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = counts.filter(F.col("n") >= LEAST_TEXTS).select("bucket").toPandas()["bucket"].to_numpy(np.int32)
    return np.sort(found)


def train(docs: DataFrame, labels: DataFrame, usable=None) -> Network:
    """Fit on every labelled document, a fifth of them to calibrate; errors of both classes count alike.

    Labels of held-out rows are never read unless ``usable`` says otherwise.  The driver
    holds the weights, the counts of labels and those of logits in steps, never documents.
    """
    usable = ~held_out(MODULUS, REST) if usable is None else usable
    total = labels.filter(usable).count()
    rows = keep(_words(labelled(docs, labels, "toxic", usable, also=("lang",)), max(1, -(-total // SHARD))), "toxic-words")
    counts = {(r["back"], r["label"]): r["count"] for r in rows.groupBy("back", "label").count().collect()}
    zeros, ones = counts.get((False, 0), 0), counts.get((False, 1), 0)
    fitted = rows.filter("not back")
    known = _known(fitted)
    if not zeros or not ones:
        return constant_network(known, ones, zeros + ones)
    weight = (zeros + ones) / 2 / np.array([zeros, ones])
    packed = _packed(start(known), _Adagrad(RATE))
    for epoch in range(EPOCHS):
        packed = _pass(fitted, known, packed, weight, epoch)
    net = _unpacked(known, packed)[0]
    if not counts.get((True, 0)) or not counts.get((True, 1)):
        return net

    model = docs.sparkSession.sparkContext.broadcast(net)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [w.values.to_numpy() for w in batch.column("words")]
            bounds = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
            logits = model.value.logits(model.value.pooled(np.concatenate([np.zeros(0, np.int32), *words]), bounds))
            step = np.clip(np.rint(logits.astype(np.float64) * _STEPS), -64 * _STEPS, 64 * _STEPS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("label"), pa.array(step)], ["lang", "label", "step"])

    held = rows.filter("back").select("lang", "label", "words").mapInArrow(judge, "lang string, label int, step int")
    seen = held.groupBy("lang", "label", "step").count().toPandas().sort_values(["step", "label", "lang"])
    logits, truth, n = seen["step"].to_numpy(float) / _STEPS, seen["label"].to_numpy(float), seen["count"].to_numpy(float)
    net.shift = threshold(logits, truth, n)
    for lang in sorted(set(seen["lang"])):
        own = seen["lang"].to_numpy() == lang
        if 0 < truth[own].sum() < own.sum():
            net.by_language = (net.by_language or {}) | {lang: threshold(logits[own], truth[own], n[own], net.shift, 0.5)}
    return net


def score(docs: DataFrame, network: Network) -> DataFrame:
    """All rows of ``docs`` with ``score`` (0 to 1), ``predicted``, and ``toxic``, by the language's own threshold.

    The score reads only the text; a null text is empty, and texts without words get the
    score of empty ones.  ``predicted`` is 1 from a score of 0.7.  A language that the
    sample lacked uses that threshold.  The text goes, other columns stay, clashing ones
    give way.
    """
    made = ["score", "predicted", "toxic"]
    own = [c for c in docs.columns if c not in (*made, "text")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*own).schema)
    model = docs.sparkSession.sparkContext.broadcast(network)
    has_lang = "lang" in own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        level = {k: CUT / (CUT + (1 - CUT) * np.exp(net.shift - v)) for k, v in (net.by_language or {}).items()}
        for batch in batches:
            parts = [net.score(ids, rows) for ids, rows in buckets(batch.column("_lower"))]
            s = np.concatenate(parts) if parts else np.zeros(0)
            langs = batch.column("lang").to_pylist() if has_lang else [None] * len(s)
            cuts = np.array([level.get(x or "", CUT) for x in langs])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in own), pa.array(s), pa.array((s >= CUT).astype(np.int32)), pa.array((s >= cuts).astype(np.int32))], [*own, *made]
            )

    return docs.select(*own, F.lower("text").alias("_lower")).mapInArrow(run, f"{fields + ', ' if own else ''}score double, predicted int, toxic int")
