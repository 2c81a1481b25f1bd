"""SentencePiece encoding and decoding by a max-plus parallel scan.

A text's encoding is its segmentation into vocabulary pieces with the greatest sum of
piece scores.  Giant documents are split into chunks of characters.  At a chunk border
the state is how many characters of the piece that crosses it lie before it.  A chunk's
transfer matrix holds the best score from each entry state to each exit state; matrices
combine associatively (max-plus products), group by group, up to one per document.  The
best states then go back down, and every chunk is traced back by itself.

A piece holds the word mark only at its front, so a mark after another character is
always a border: matrices are worked out fully only up to the first such place, and
words are looked up once each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.llm.staging import keep
from gaugework.llm.words import mix, row_slices

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK, FAN = 1 << 15, 64
_NONE = -(1 << 60)
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_UNKNOWN_PENALTY = 10
_NO_PREFIX = object()
_SPREAD, _SLOTS = np.uint64(0x9E3779B97F4A7C15), 20
_CACHE = 400_000


def _packed(ids: tuple[int, ...]) -> bytes:
    return np.array(ids, np.int32).tobytes()


class _Words(dict):
    """Ids of words met so far, as bytes of 32-bit numbers; a long word is worked out each time."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> bytes:
        ids = _packed(self.vocabulary.word(word)[1])
        if len(word) <= 64:
            self[word] = ids
        return ids


class _Index:
    """Pieces and beginnings of pieces by hash."""

    def __init__(self, vocabulary: Vocabulary):
        names = list(vocabulary.table)
        values = []
        for name in names:
            value = 0
            for c in name:
                value = (value * int(_SPREAD) + ord(c) + 1) % (1 << 64)
            values.append(value)
        values = mix(np.array(values, np.uint64))
        order = np.argsort(values)
        self.values = values[order]
        if (self.values[1:] == self.values[:-1]).any():
            raise ValueError("two pieces have one hash")
        self.pieces = np.array([vocabulary.ids.get(names[k], -1) for k in order], np.int32)
        self.scores = np.array([vocabulary.scores.get(names[k], 0) for k in order], np.int64)
        self.slots = np.searchsorted(self.values, np.arange(1 << _SLOTS, dtype=np.uint64) << np.uint64(64 - _SLOTS))
        self.reach = int(np.diff(np.append(self.slots, len(self.values))).max())

    def find(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each value begins a piece, and the score and id of the piece it is (-1: none)."""
        value = mix(value)
        at = self.slots[(value >> np.uint64(64 - _SLOTS)).astype(np.int64)]
        found = np.full(len(value), -1, np.int64)
        for step in range(self.reach):
            k = np.minimum(at + step, len(self.values) - 1)
            found = np.where(self.values[k] == value, k, found)
        hit = found >= 0
        return hit, self.scores[found], np.where(hit, self.pieces[found], -1)


@dataclass
class Vocabulary:
    """Pieces with whole-number scores; characters without a piece become their bytes."""

    scores: dict[str, int]
    ids: dict[str, int]
    bytes_of: list[bytes]
    byte_ids: list[int]
    unknown: int
    longest: int
    #: Scores of pieces, and None for what only begins a piece.
    table: dict[str, int | None]
    packed: _Words | None = None
    index: _Index | None = None
    #: Bytes of all pieces, where each begins, and its length.
    pool: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        scores, ids, byte_ids, bytes_of = {}, {}, [0] * 256, []
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                bytes_of.append(b"")
            else:
                # scores may be fractions; thousandths keep their order and add up exactly
                scores[piece], ids[piece] = round(model.get_score(i) * 1000), i
                bytes_of.append(piece.replace(MARK, " ").encode())
                if MARK in piece.lstrip(MARK):
                    raise ValueError(f"piece {piece!r} has a word mark inside")
        longest = max(map(len, scores))
        table = {piece[:n]: None for piece in scores for n in range(1, len(piece))} | scores
        return cls(scores, ids, bytes_of, byte_ids, min(scores.values()) - 1000 * _UNKNOWN_PENALTY, longest, table)

    def edges(self, text: str, at: int) -> Iterator[tuple[int, int]]:
        """Ends and scores of the pieces that start at ``at``."""
        single = False
        for end in range(at + 1, min(len(text), at + self.longest) + 1):
            score = self.scores.get(text[at:end])
            if score is not None:
                single |= end == at + 1
                yield end, score
        if not single:
            yield at + 1, self.unknown

    def word(self, word: str) -> tuple[int, tuple[int, ...]]:
        """Score and ids of the best segmentation of one word; of equal ones, the first found."""
        n, table, unknown = len(word), self.table, self.unknown
        best, back = [0] + [_NONE] * n, [0] * (n + 1)
        for at in range(n):
            base, end, score = best[at], at + 1, table.get(word[at], _NO_PREFIX)
            if score is None or score is _NO_PREFIX:
                if base + unknown > best[end]:
                    best[end], back[end] = base + unknown, at
            while score is not _NO_PREFIX:
                if score is not None and base + score > best[end]:
                    best[end], back[end] = base + score, at
                end += 1
                if end > n:
                    break
                score = table.get(word[at:end], _NO_PREFIX)
        cuts, at = [], n
        while at:
            cuts.append(word[back[at] : at])
            at = back[at]
        out: list[int] = []
        for piece in reversed(cuts):
            known = self.ids.get(piece)
            out += [known] if known is not None else [self.byte_ids[x] for x in piece.encode()]
        return best[n], tuple(out)

    def learn(self, words: list[str]) -> None:
        """Work out the ids of many words at once and keep them.

        The same recursion as ``word``, a position of all words at a time: substrings are
        looked up by hash among pieces and beginnings of pieces, and words whose substring
        begins no piece drop out.
        """
        if self.index is None:
            self.index = _Index(self)
        index, size = self.index, np.array([len(w) for w in words])
        n, longest = len(words), int(size.max())
        codes = np.zeros((longest, n), np.uint64)
        rows = np.repeat(np.arange(n), size)
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        codes[place, rows] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        best = np.full((longest + 1, n), _NONE, np.int64)
        best[0] = 0
        back, via = np.zeros((longest + 1, n), np.int32), np.full((longest + 1, n), -1, np.int32)
        for at in range(longest):
            active, value = np.flatnonzero(size > at), None
            for end in range(at + 1, min(longest, at + self.longest) + 1):
                active_codes = codes[end - 1, active]
                value = active_codes + np.uint64(1) if value is None else value * _SPREAD + active_codes + np.uint64(1)
                begins, score, piece = index.find(value)
                if end == at + 1:
                    lone = active[piece < 0]
                    worse = best[at, lone] + self.unknown > best[end, lone]
                    best[end, lone[worse]] = best[at, lone[worse]] + self.unknown
                    back[end, lone[worse]], via[end, lone[worse]] = at, -1
                held = piece >= 0
                target, total = active[held], best[at, active[held]] + score[held]
                better = total > best[end, target]
                best[end, target[better]] = total[better]
                back[end, target[better]], via[end, target[better]] = at, piece[held][better]
                keep_on = begins & (size[active] > end)
                active, value = active[keep_on], value[keep_on]
                if not len(active):
                    break
        at, parts, owners = size.copy(), [], []
        rows = np.arange(n)
        while len(rows):
            parts.append(via[at[rows], rows])
            owners.append(rows)
            at[rows] = back[at[rows], rows]
            rows = rows[at[rows] > 0]
        owner, ids = np.concatenate(owners[::-1]), np.concatenate(parts[::-1])
        order = np.argsort(owner, kind="stable")
        ids, bounds = ids[order], (4 * np.searchsorted(owner[order], np.arange(n + 1))).tolist()
        unknown, data = set(owner[order][ids < 0].tolist()), ids.astype(np.int32).tobytes()
        for k, word in enumerate(words):
            self.packed[word] = _packed(self.word(word)[1]) if k in unknown else data[bounds[k] : bounds[k + 1]]

    @property
    def cache(self) -> dict[str, tuple[int, ...]]:
        """Words met so far and their ids."""
        return {w: tuple(np.frombuffer(b, np.int32).tolist()) for w, b in (self.packed or {}).items()}

    def encode(self, marked: str) -> list[int]:
        return self.encode_all([marked])[0].tolist()

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; words are looked up, ids are never numbers of Python."""
        if self.packed is None:
            self.packed = _Words(self)
        elif len(self.packed) > _CACHE:
            self.packed.clear()
        split = [_WORDS.findall(t) for t in texts]
        fresh = {w for words in split for w in words if w not in self.packed and len(w) <= 64}
        if len(fresh) > 200:
            fresh = sorted(fresh, key=len)
            for i in range(0, len(fresh), 20_000):
                self.learn(fresh[i : i + 20_000])
        return [np.frombuffer(b"".join(map(self.packed.__getitem__, words)), np.int32) for words in split]

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``, without the space that marks the first word; bytes that are no text become U+FFFD."""
        return self.decode_all(np.array(ids, np.int64), np.array([0, len(ids)]))[0]

    def decode_all(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """Texts of several lists of ids that stand in one array; their bytes are gathered at once."""
        if self.pool is None:
            sizes = np.array([len(b) for b in self.bytes_of], np.int64)
            self.pool = np.frombuffer(b"".join(self.bytes_of), np.uint8), np.cumsum(sizes) - sizes, sizes
        pool, starts, sizes = self.pool
        size = sizes[ids]
        to = np.concatenate([[0], np.cumsum(size)])
        data = pool[np.arange(to[-1]) + np.repeat(starts[ids] - to[:-1], size)].tobytes()
        cuts = to[bounds].tolist()
        texts = [data[a:b] for a, b in zip(cuts, cuts[1:])]
        return [(t[1:] if t[:1] == b" " else t).decode("utf-8", "replace") for t in texts]


def marked(text: str | None) -> str:
    """The form that is segmented: blanks as word marks, one before the first word."""
    return MARK + text.replace(" ", MARK) if text else ""


def chunks(text: str, size: int) -> list[tuple[int, int]]:
    """Bounds of chunks of ``size`` characters; the rest goes to the last."""
    n = max(1, len(text) // size)
    return [(i * size, len(text) if i == n - 1 else (i + 1) * size) for i in range(n)]


def transfer(vocabulary: Vocabulary, before: str, chunk: str) -> np.ndarray:
    """Matrix of best scores from each entry state (row) to each exit state (column)."""
    text, start, states = before + chunk, len(before), vocabulary.longest
    borders = [m.start() for m in re.finditer(f"(?<=[^{MARK}]){MARK}", text) if m.start() >= start]
    if not before and text[:1] == MARK:
        borders = [0, *[b for b in borders if b]]
    stop = borders[0] if borders else len(text)
    best = np.full((stop - start + 1, states), _NONE, np.int64)
    best[0, 0] = 0
    for s in range(1, min(states, start + 1)):
        for end, score in vocabulary.edges(text, start - s):
            if start < end <= stop:
                best[end - start, s] = max(best[end - start, s], score)
    for at in range(start, stop):
        for end, score in vocabulary.edges(text, at):
            if end <= stop:
                np.maximum(best[end - start], best[at - start] + score, out=best[end - start])
    out = np.full((states, states), _NONE, np.int64)
    if not borders:
        for s in range(min(states, len(best))):
            out[:, s] = best[len(best) - 1 - s]
    else:
        middle = sum(vocabulary.word(w)[0] for w in _WORDS.findall(text[stop : borders[-1]]))
        tail = text[borders[-1] :]
        ends = [0] + [_NONE] * len(tail)
        for at in range(len(tail)):
            for end, score in vocabulary.edges(tail, at):
                ends[end] = max(ends[end], ends[at] + score)
        for s in range(min(states, len(ends))):
            out[:, s] = best[-1] + middle + ends[len(tail) - s]
    return np.where(out < _NONE // 2, _NONE, out)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    out = (a[:, :, None] + b[None, :, :]).max(1)
    return np.where(out < _NONE // 2, _NONE, out)


def trace(matrices: list[np.ndarray], enter: int, leave: int) -> list[int]:
    """States at all borders of a row of chunks whose outer states are given."""
    scores = [np.where(np.arange(len(matrices[0])) == enter, 0, _NONE)]
    for m in matrices:
        scores.append(np.maximum((scores[-1][:, None] + m).max(0), _NONE))
    states = [leave]
    for m, score in zip(reversed(matrices), reversed(scores[:-1])):
        states.append(int((score + m[:, states[-1]]).argmax()))
    return states[::-1]


def _group_products(group: pd.DataFrame, fan: int) -> pd.DataFrame:
    group = group.sort_values("no")
    out = None
    for m in _matrices(group):
        out = m if out is None else product(out, m)
    return pd.DataFrame({"doc": group["doc"].iloc[:1], "no": group["no"].iloc[:1] // fan, "m": [out.tobytes()]})


def _matrices(group: pd.DataFrame) -> list[np.ndarray]:
    flat = [np.frombuffer(m, np.int64) for m in group["m"]]
    return [m.reshape(int(round(len(m) ** 0.5)), -1) for m in flat]


def _group_states(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("no")
    states = trace(_matrices(group), int(group["enter"].iloc[0]), int(group["leave"].iloc[0]))
    return pd.DataFrame({"doc": group["doc"], "no": group["no"], "enter": states[:-1], "leave": states[1:]})


def _border_states(matrices: DataFrame) -> DataFrame:
    """``doc, no, enter, leave``: up to one matrix per document and down again, FAN at a time."""
    levels, fan = [keep(matrices, "scan")], FAN
    while (levels[-1].agg(F.max("no")).first()[0] or 0) > 0:
        parents = levels[-1].groupBy("doc", F.floor(F.col("no") / fan).alias("parent")).applyInPandas(
            lambda g: _group_products(g, fan), "doc long, no long, m binary"
        )
        levels.append(keep(parents, "scan"))
    states = levels[-1].select("doc", "no", F.lit(0).alias("enter"), F.lit(0).alias("leave"))
    for children in reversed(levels[:-1]):
        joined = children.withColumn("parent", F.floor(F.col("no") / fan)).join(states.withColumnRenamed("no", "parent"), ["doc", "parent"])
        states = joined.groupBy("doc", "parent").applyInPandas(_group_states, "doc long, no long, enter int, leave int")
    return states


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    return (b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows))


def encode(docs: DataFrame, path: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """All rows and columns of ``docs`` with ``ids`` (array<int>) and ``n_tokens``; clashing columns give way.

    A null or empty text has no ids.  Texts of up to ``2 * chunk - 1`` characters are one
    chunk; longer ones take the scan.  Equal rows are encoded alike.
    """
    docs = docs.drop("ids", "n_tokens")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Vocabulary.load(path))
    own = docs.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    giant = F.coalesce(F.char_length("text") + 1 >= 2 * chunk, F.lit(False))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            ids = shared.value.encode_all([marked(t) for t in batch.column("text").to_pylist()])
            sizes = np.array([len(x) for x in ids], np.int64)
            bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(sizes)], [*own, "ids", "n_tokens"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = shared.value.longest - 1
        for batch in _slices(batches, 4):
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist()):
                text = marked(text)
                parts = [(doc, i, text[max(0, a - back) : a], text[a:b]) for i, (a, b) in enumerate(chunks(text, chunk))]
                for i in range(0, len(parts), 64):
                    columns = list(zip(*parts[i : i + 64]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()))], ["doc", "no", "before", "chunk"]
                    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 64):
            m = [transfer(shared.value, b, c).tobytes() for b, c in zip(batch.column("before").to_pylist(), batch.column("chunk").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("no"), pa.array(m, pa.binary())], ["doc", "no", "m"])

    def backtrace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 64):
            ids = []
            for b, c, enter, leave in zip(*(batch.column(x).to_pylist() for x in ("before", "chunk", "enter", "leave"))):
                ids.append(shared.value.encode(b[len(b) - enter :] + c[: len(c) - leave]))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("no"), pa.array(ids, pa.list_(pa.int32()))], ["doc", "no", "ids"])

    small = docs.filter(~giant).mapInArrow(whole, f"{fields}, ids array<int>, n_tokens long")
    large = docs.filter(giant).withColumn("_doc", F.xxhash64("text"))
    parts = large.select(F.col("_doc").alias("doc"), "text").mapInArrow(cut, "doc long, no long, before string, chunk string")
    parts = keep(parts.dropDuplicates(["doc", "no"]), "chunks")
    states = _border_states(parts.mapInArrow(score, "doc long, no long, m binary"))
    pieces = parts.join(states, ["doc", "no"]).mapInArrow(backtrace, "doc long, no long, ids array<int>")
    lists = pieces.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("no", "ids"))).alias("p")).select(
        F.col("doc").alias("_doc"), F.flatten("p.ids").alias("ids")
    )
    large = large.join(lists, "_doc").drop("_doc").withColumn("n_tokens", F.size("ids").cast("long"))
    return small.unionByName(large)


def decode(rows: DataFrame, path: str = MODEL) -> DataFrame:
    """All rows and columns of ``rows`` with ``decoded``, the text of ``ids``; null ids give an empty text."""
    rows = rows.drop("decoded")
    shared = rows.sparkSession.sparkContext.broadcast(Vocabulary.load(path))
    own = rows.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            lists = batch.column("ids")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            texts = []
            for i, j in row_slices(bounds, 1 << 18):
                ids = lists.slice(i, j - i).flatten().to_numpy(zero_copy_only=False)
                texts += shared.value.decode_all(ids, bounds[i : j + 1] - bounds[i])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*own, "decoded"])

    return rows.mapInArrow(run, f"{fields}, decoded string")
