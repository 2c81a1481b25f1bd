"""Removal of every byte that lies in a long string which also starts anywhere else.

Prefix-free parsing of every text: the 8-byte windows whose rolling hash is least among
their neighbours are the triggers, and the phrases between triggers are the parse.  A
400-byte string owns the triggers that its own bytes decide; the parse between its first
and its last trigger (its run) is the same wherever the string occurs.  The strings at
neighbouring starts that own the same run form one interval.

Corpus order then brings equal strings together, coarse before fine: intervals are
sorted by run and surroundings, so equal ones are neighbours.  An interval whose run
stands alone holds no repeat; one whose whole surroundings have an equal neighbour is
all repeats.  Only for the rest (ends of repeats, and one interval for each kind of
surroundings that they may repeat) the suffixes themselves are ordered, by the hash of
their first 400 bytes, which is as far as the question goes.  Thus the
suffix array is never written out for text that occurs once.

Keys that a bounded sample of documents shows several times are known to repeat; they
need no neighbour and are not sent, so no hot key meets in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugework.llm.staging import keep

LENGTH = 400
#: Bytes of a trigger, and windows among which it is the least: two fifths of a string, so
#: that a string of any length owns a few triggers and its run is long enough to be rare.
GRAM, SPAN = 8, LENGTH * 2 // 5
SAMPLE_DOCS, SAMPLE_KEYS = 1000, 500_000
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)
#: Rows put together to a batch, and bytes of text left that a batch may hold before it is sent.
_FLUSH, _HELD = 50_000, 4 << 20


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """Least value of every ``span`` neighbours, by doubling."""
    out, done = values, 1
    while done < span:
        step = min(done, span - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def span_of(length: int) -> int:
    """Windows among which a trigger is the least, for strings of ``length``."""
    return max(1, length * 2 // 5)


def intervals(text: bytes, length: int = LENGTH, span: int = SPAN) -> tuple[np.ndarray, ...]:
    """Intervals ``[start, stop)`` of string starts with one run, and each run's bounds."""
    strings = len(text) - length + 1
    if strings < 1:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    grams = np.ndarray((len(text) - GRAM + 1,), "<u8", text, 0, (1,))
    # high half: rolling hash; low half: place, so that of equal hashes the first counts
    keys = ((grams * _MULTIPLY) & _HIGH) | np.arange(len(grams), dtype=np.uint64)
    least = (_least(keys, span) & _LOW).astype(np.int64)
    first, last = least[:strings], least[length - GRAM + 1 - span :][:strings]
    new = np.flatnonzero((first[1:] != first[:-1]) | (last[1:] != last[:-1])) + 1
    start = np.concatenate([[0], new])
    return start, np.concatenate([new, [strings]]), first[start], last[start] + GRAM


def merge(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans that touch or overlap."""
    if not len(start):
        return start, stop
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    fresh = np.concatenate([[True], start[1:] > stop[:-1]])
    return start[fresh], stop[np.concatenate([np.flatnonzero(fresh)[1:] - 1, [len(stop) - 1]])]


def _sorted(keys: set[int]) -> np.ndarray:
    """Keys as they travel to the tasks: eight bytes each."""
    return np.sort(np.fromiter(keys, np.uint64, len(keys)))


def _among(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which ``values`` are in the sorted ``keys``."""
    if not len(keys):
        return np.zeros(len(values), bool)
    return keys[np.minimum(np.searchsorted(keys, values), len(keys) - 1)] == values


def _lone(doc: int, places: np.ndarray) -> np.ndarray:
    """Keys that no other row has, so that rows already known to repeat meet nobody."""
    return np.array([xxhash.xxh3_64_intdigest(b"%d %d" % (doc, at)) for at in places.tolist()], np.uint64)


def _batches(parts: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Parts (document, one array per further column) put together to batches of some size."""
    held, rows = [], 0

    def batch() -> pa.RecordBatch:
        doc = np.repeat(np.array([p[0] for p in held], np.int64), [len(p[1]) for p in held])
        columns = [doc, *(np.concatenate(c) for c in list(zip(*held))[1:])]
        columns = [c.view(np.int64) if c.dtype == np.uint64 else c for c in columns]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    for part in parts:
        held.append(part)
        rows += len(part[1])
        if rows > _FLUSH:
            yield batch()
            held, rows = [], 0
    if rows:
        yield batch()


_INTERVALS = pa.schema([
    ("doc", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("key", pa.int64()), ("around", pa.int64()), ("kind", pa.int8()),
])
_SUFFIXES = pa.schema([("doc", pa.int64()), ("start", pa.int32()), ("key", pa.int64()), ("known", pa.bool_())])


def _parse(docs: Iterator[tuple[int, bytes]], hot_runs: np.ndarray, hot_keys: np.ndarray, length: int) -> Iterator[pa.RecordBatch]:
    """Per document: intervals to sort, and spans of strings already known to repeat.

    ``kind`` 0: the run may stand alone; 1: the run is known to repeat; 2: repeats.
    """
    digest = xxhash.xxh3_64_intdigest

    def parts() -> Iterator[tuple]:
        for name, text in docs:
            a, b, x, y = intervals(text, length, span_of(length))
            runs = [digest(text[i:j]) for i, j in zip(x.tolist(), y.tolist())]
            seeds, ends = zip((x - a).tolist(), runs), (b + length - 1).tolist()
            around = np.array([digest(text[i:j], at ^ run) for i, j, (at, run) in zip(a.tolist(), ends, seeds)], np.uint64)
            runs = np.array(runs, np.uint64)
            known = _among(around, hot_keys)
            start, stop = merge(a[known], b[known])
            lone = _lone(name, start)
            a, b, runs, around = (c[~known] for c in (a, b, runs, around))
            hot = _among(runs, hot_runs)
            key = np.where(hot, runs ^ around, runs)
            kind = np.concatenate([hot.astype(np.int8), np.full(len(start), 2, np.int8)])
            yield (
                name, np.concatenate([a, start]), np.concatenate([b, stop]), np.concatenate([key, lone]),
                np.concatenate([around, lone]), kind,
            )

    return _batches(parts(), _INTERVALS)


def _named(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[int, bytes]]:
    for batch in batches:
        for name, text in zip(batch.column("doc").to_pylist(), batch.column(column)):
            yield name, text.as_py() or b""


def _repeated(values) -> set[int]:
    found, times = np.unique(np.asarray(values, np.int64), return_counts=True)
    return set(found[times > 1][:SAMPLE_KEYS].astype(np.uint64).tolist())


def _hot(seen) -> tuple[set[int], set[int]]:
    """Runs and surroundings that sampled intervals repeat, ``SAMPLE_KEYS`` of each at most.

    The runs of all hot surroundings come first: an interval that goes for its hot
    surroundings must not leave another one of its run to stand alone.
    """
    keys = _repeated(seen["around"])
    runs = set(seen["key"][seen["around"].astype("uint64").isin(keys)].astype("uint64").tolist())
    others = sorted(_repeated(seen["key"]) - runs)
    return runs | set(others[: max(0, SAMPLE_KEYS - len(runs))]), keys


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc, spans`` for documents with repeats: where in the text ``length`` bytes repeat.

    ``docs`` has ``doc`` (a number per different row) and ``text`` (binary).
    """
    context = docs.sparkSession.sparkContext
    form = "doc long, start int, stop int, key long, around long, kind byte"

    def parsed(rows: DataFrame, hot) -> DataFrame:
        def run(batches):
            runs, keys = hot.value
            yield from _parse(_named(batches), runs, keys, length)

        return rows.select("doc", "text").mapInArrow(run, form)

    sample = F.broadcast(docs.select("doc").distinct().orderBy("doc").limit(SAMPLE_DOCS))
    seen = parsed(docs.join(sample, "doc"), context.broadcast((_sorted(set()), _sorted(set()))))
    seen = seen.orderBy("around", "doc", "start").limit(4 * SAMPLE_KEYS).toPandas()
    runs, keys = _hot(seen)
    hot = context.broadcast((_sorted(runs), _sorted(keys)))
    known = seen[seen["around"].astype("uint64").isin(keys)].drop_duplicates("around")
    known = docs.sparkSession.createDataFrame(known[["doc", "start", "stop"]], "doc long, start int, stop int")

    order = W.partitionBy("key").orderBy("around")
    before, after = F.lag("around").over(order), F.lead("around").over(order)
    last = F.max("around").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    sorted_rows = parsed(docs, hot).select("*", before.alias("before"), after.alias("after"), last.alias("last"))
    same = (F.col("kind") == 2) | F.coalesce(F.col("before") == F.col("around"), F.lit(False)) | F.coalesce(
        F.col("after") == F.col("around"), F.lit(False)
    )
    met = sorted_rows.filter((F.col("kind") > 0) | F.col("before").isNotNull() | F.col("after").isNotNull())
    # the first of equal surroundings stands for them when its run has other surroundings too
    fresh = F.coalesce(F.col("before") != F.col("around"), F.lit(True))
    stands = fresh & ((F.col("kind") == 1) | F.col("before").isNotNull() | (F.col("last") != F.col("around")))
    met = keep(met.select("doc", "start", "stop", same.alias("same"), (~same | (stands & (F.col("kind") < 2))).alias("ask")), "intervals")

    open_rows = met.filter("ask").select("doc", "start", "stop").union(known).distinct().groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("open"))
    packed = docs.select("doc", "text").mapInArrow(_pack, "doc long, packed binary")
    asked = packed.join(open_rows, "doc")

    def suffixes(rows: DataFrame, hot) -> DataFrame:
        def run(batches):
            yield from _suffixes(batches, hot.value, length)

        return rows.mapInArrow(run, "doc long, start int, key long, known boolean")

    asked = keep(asked, "open")
    some = suffixes(asked.join(sample, "doc"), context.broadcast(_sorted(set()))).select("key")
    some = some.orderBy("key").limit(4 * SAMPLE_KEYS).toPandas()
    hot = context.broadcast(_sorted(_repeated(some["key"])))
    order = W.partitionBy("key").orderBy("doc")
    ordered = suffixes(asked, hot).select("*", F.lag("doc").over(order).alias("before"), F.lead("doc").over(order).alias("after"))
    ends = ordered.filter(F.col("known") | F.col("before").isNotNull() | F.col("after").isNotNull())
    spans = met.filter("same").select("doc", "start", (F.col("stop") + (length - 1)).alias("stop")).union(
        ends.select("doc", "start", (F.col("start") + length).alias("stop"))
    )
    return spans.distinct().groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts travel compressed."""
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        packed = [press.compress(t.as_buffer() if t.is_valid else b"") for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(packed, pa.binary())], ["doc", "packed"])


def _spans(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Starts and stops of each row of a column of span lists; a null list is empty."""
    cuts = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
    start, stop = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in column.flatten().flatten())
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield start[a:b], stop[a:b]


def _unpacked(column: pa.Array) -> Iterator[bytes]:
    unpack = zstandard.ZstdDecompressor()
    for packed in column:
        packed = packed.as_buffer() if packed.is_valid else None
        yield unpack.decompress(packed, max_output_size=1 << 31) if packed is not None and packed.size else b""


def _suffixes(batches: Iterator[pa.RecordBatch], hot: np.ndarray, length: int) -> Iterator[pa.RecordBatch]:
    """The first ``length`` bytes, hashed, of every suffix that starts in an open interval."""
    digest = xxhash.xxh3_64_intdigest

    def parts() -> Iterator[tuple]:
        for batch in batches:
            rows = zip(batch.column("doc").to_pylist(), _unpacked(batch.column("packed")), _spans(batch.column("open")))
            for name, text, (start, stop) in rows:
                for i, j in zip(start.tolist(), stop.tolist()):
                    key = np.array([digest(text[at : at + length]) for at in range(i, j)], np.uint64)
                    places, known = np.arange(i, j), _among(key, hot)
                    key[known] = _lone(name, places[known])
                    yield name, places, key, known

    return _batches(parts(), _SUFFIXES)


def cut(batches: Iterator[pa.RecordBatch], extra: list[str], text_out: bool) -> Iterator[pa.RecordBatch]:
    def made(part: pa.RecordBatch, out: list[tuple]) -> pa.RecordBatch:
        *numbers, last = zip(*out)
        arrays = [*(part.column(c) for c in extra), *(pa.array(c, pa.int64()) for c in numbers), pa.array(last, pa.string())]
        return pa.RecordBatch.from_arrays(arrays, [*extra, "n_bytes", "n_removed", "n_spans", "text" if text_out else "kept_sha256"])

    for batch in batches:
        out, first, held = [], 0, 0
        for row, (text, (start, stop)) in enumerate(zip(_unpacked(batch.column("packed")), _spans(batch.column("spans")))):
            start, stop = merge(start, stop)
            edges = [0, *np.stack([start, stop], 1).ravel().tolist(), len(text)]
            left = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
            shown = left.decode("utf-8", "ignore") if text_out else hashlib.sha256(left).hexdigest()
            out.append((len(text), len(text) - len(left), len(start), shown))
            held += len(left)
            if held > _HELD:
                yield made(batch.slice(first, len(out)), out)
                out, first, held = [], row + 1, 0
        if out:
            yield made(batch.slice(first, len(out)), out)


def remove_repeats(docs: DataFrame, text_out: bool = False, length: int = LENGTH) -> DataFrame:
    """Every row of ``docs`` with ``n_bytes, n_removed, n_spans`` and what is left of its text.

    What is left comes as ``kept_sha256``, or with ``text_out`` as ``text`` (a character
    that lost some of its bytes goes whole).  A null text is empty.  Repeated rows repeat
    each other's strings.  All other columns stay; clashing ones give way.  Strings never
    cross rows.  Strings are compared by 64-bit hashes of their bytes.
    """
    made = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    extra = [c for c in docs.columns if c not in (*made, "text")]
    text = F.coalesce(F.col("text"), F.lit(""))
    # rows that agree in id and text have the same repeats, so they may share a number
    rows = docs.withColumn("_doc", F.xxhash64("doc_id", text)).withColumn("_text", text.cast("binary"))
    plain = rows.select(F.col("_doc").alias("doc"), F.col("_text").alias("text"))
    spans = repeated_spans(plain, length).withColumnRenamed("doc", "_doc")
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    kept = ", ".join(f"`{c}` {types[c]}" for c in extra)

    def pack(batches):
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            packed = [press.compress(t.as_buffer()) for t in batch.column("_text")]
            columns = [batch.column(c) for c in [*extra, "_doc"]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(packed, pa.binary())], [*extra, "_doc", "packed"])

    head = f"{kept}, " if extra else ""
    packed = rows.select(*extra, "_doc", "_text").mapInArrow(pack, f"{head}_doc long, packed binary")
    joined = packed.join(spans, "_doc", "left").select(*extra, "packed", "spans")
    last = "text string" if text_out else "kept_sha256 string"
    return joined.mapInArrow(
        lambda batches: cut(batches, extra, text_out), f"{head}n_bytes long, n_removed long, n_spans long, {last}"
    )
