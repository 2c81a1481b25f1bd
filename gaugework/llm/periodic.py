"""Periodic runs of words by multi-scale minimizers.

A run is a stretch of words that repeats with a period.  The scale for the periods
``least..most`` looks at grams of ``most`` words, at least as long as any of its periods.
Inside a run such a gram comes again after exactly one period and never sooner: two
copies closer together would overlap so far that the run had a smaller period.  Of each
window of grams the one with the smallest hash is kept.  Equal windows keep the same
gram, so in a run that is long enough some kept gram is kept again one period later, and
the next kept gram equal to it lies exactly there.  Pairs of neighbouring equal minimizers
are therefore all the seeds a scale needs; each seed is extended word by word in both
directions.  Periods too short for a scale are found by comparing all words with those a
fixed lag behind.

A document is one row, so nothing is shuffled.  Texts are worked on in batches of bounded
size; a single long document takes about 40 bytes for each of its words.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.llm.checksum_sql import crc32_sql, crc_table_sql
from gaugework.llm.words import mix, row_slices, text_bytes, word_hashes

#: Shortest run, in words and in periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Periods up to this are looked for by comparing with a fixed lag; no scale could sample them.
SHORT = LEAST_WORDS // LEAST_PERIODS
#: Grams of a scale are at most so many times as long as its smallest period.
SPREAD = 1.5

_SLICE, _BLOCK = 1 << 20, 1 << 18
_STEP = 0x9E3779B97F4A7C15 | 5
_RESULT = (
    "doc_id {id}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
)


@dataclass(frozen=True)
class Scale:
    """Periods ``least..most``, found by grams of ``most`` words in windows of ``window`` grams."""

    least: int
    most: int

    @property
    def window(self) -> int:
        # a run of three periods holds a window and the same window one period later
        return (LEAST_PERIODS - 1) * self.least - self.most + 1


def scales(words: int) -> Iterator[Scale]:
    """Scales for all periods that a run in so many words can have beyond the short ones."""
    least = SHORT + 1
    while LEAST_PERIODS * least <= words:
        most = int(least * SPREAD)
        yield Scale(least, most)
        least = most + 1


@lru_cache(4)
def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_STEP, pow(_STEP, -1, 1 << 64)):
        table = np.full(n, base, np.uint64)
        table[0] = 1
        out.append(np.multiply.accumulate(table))
    return out[0], out[1]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of the gram hash's factor, and of its inverse."""
    return _power_table(max(1 << 19, 1 << (n - 1).bit_length()))


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every stretch of ``width`` neighbours."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = pick(x[:-step], x[step:])
        done += step
    return x


def _minimizers(ids: np.ndarray, scale: Scale) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams that are the smallest of some window, in order of place.

    Blocks overlap by all windows that hold a gram, so they keep what the whole would.
    """
    grams, side = len(ids) - scale.most + 1, scale.window - 1
    places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    size = max(_BLOCK, 4 * scale.most)
    up, down = _powers(min(size, grams) + 2 * side + scale.most)
    for a in range(0, grams, size):
        b = min(grams, a + size)
        low, high = max(0, a - side), min(grams, b + side)
        part = ids[low : high + scale.most - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        value = mix((sums[scale.most :] - sums[: high - low]) * down[: high - low])
        if len(value) < scale.window:
            continue
        least = _sliding(value, scale.window, np.minimum)
        edge = np.zeros(side, np.uint64)
        best = _sliding(np.concatenate([edge, least, edge]), scale.window, np.maximum)
        at = np.flatnonzero(best[a - low : b - low] == value[a - low : b - low]) + (a - low)
        places.append(at + low)
        hashes.append(value[at])
    return np.concatenate(places), np.concatenate(hashes)


def seeds(ids: np.ndarray, scale: Scale) -> np.ndarray:
    """Pairs (place, period) of neighbouring equal minimizers whose distance is a period of the scale."""
    place, value = _minimizers(ids, scale)
    order = np.argsort(value, kind="stable")
    place, value = place[order], value[order]
    period = np.diff(place)
    ok = (value[1:] == value[:-1]) & (period >= scale.least) & (period <= scale.most)
    return np.stack([place[:-1][ok], period[ok]], 1)


def _reach(ids: np.ndarray, a: int, b: int, step: int) -> int:
    """Words from places ``a < b`` on (``step`` 1) or before them (-1) that are equal pair by pair."""
    done, size = 0, 64
    while True:
        if step > 0:
            x, y = ids[a + done : a + done + size], ids[b + done : b + done + size]
            x = x[: len(y)]
        else:
            x = ids[max(0, a - done - size) : a - done][::-1]
            y = ids[b - done - len(x) : b - done][::-1]
        differ = np.flatnonzero(x != y)
        if len(differ) or not len(x):
            return done + int(differ[0] if len(differ) else 0)
        done += len(x)
        size = min(2 * size, _BLOCK)


def _lag_runs(ids: np.ndarray, lag: int) -> np.ndarray:
    """Rows (start, length, period) of all runs with one short period, in blocks."""
    out, n = [np.zeros((0, 3), np.int64)], len(ids) - lag
    opened = -1  # where an equal stretch began that the last block did not close
    for a in range(0, n, _BLOCK):
        b = min(n, a + _BLOCK)
        equal = np.zeros(b - a + 2, bool)
        equal[1:-1] = ids[a:b] == ids[a + lag : b + lag]
        flips = np.flatnonzero(equal[1:] != equal[:-1])
        first, last = flips[::2] + a, flips[1::2] + a
        if opened >= 0:
            if len(first) and first[0] == a:
                first[0] = opened
            else:
                first, last = np.concatenate([[opened], first]), np.concatenate([[a], last])
        opened = int(first[-1]) if len(last) and last[-1] == b and b < n else -1
        if opened >= 0:
            first, last = first[:-1], last[:-1]
        length = last - first + lag
        ok = length >= max(LEAST_WORDS, LEAST_PERIODS * lag)
        out.append(np.stack([first[ok], length[ok], np.full(ok.sum(), lag)], 1))
    return np.concatenate(out)


def find_runs(ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start and period.

    ``ids`` are the words of several documents as 64-bit values, ``rows`` where each
    document begins (and ends).  Places count through all documents; between two
    documents stands one value that occurs nowhere else.
    """
    found = [np.zeros((0, 3), np.int64)]
    for lag in range(1, SHORT + 1):
        found.append(_lag_runs(ids, lag))
    size = np.diff(rows)
    for scale in scales(int(size.max(initial=0))):
        # documents too short for the scale are left out of it
        long = np.flatnonzero(size > LEAST_PERIODS * scale.least)
        if 2 * size[long].sum() > len(ids):
            pairs = seeds(ids, scale)
        else:
            parts = [seeds(ids[rows[r] : rows[r + 1]], scale) + [rows[r], 0] for r in long]
            pairs = np.concatenate([np.zeros((0, 2), np.int64), *parts])
        covered: dict[int, int] = {}
        for place, period in pairs[np.argsort(pairs[:, 0], kind="stable")].tolist():
            if place < covered.get(period, -1):
                continue  # inside the stretch of an earlier seed
            start = place - _reach(ids, place, place + period, -1)
            stop = place + _reach(ids, place, place + period, 1)
            covered[period] = stop
            length = stop + period - start
            if length >= max(LEAST_WORDS, LEAST_PERIODS * period):
                found.append(np.array([[start, length, period]]))
    runs = np.concatenate(found)
    # a stretch is also found with multiples of its smallest period
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    runs = runs[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def planted_order(doc_id: int, n: int) -> np.ndarray | None:
    """Which original word stands at each place, where the document's tail is made periodic; else None."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def _joined_sha(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> str:
    """Digest of words joined by one space, made in pieces."""
    digest = hashlib.sha256()
    for i in range(0, len(starts), _BLOCK):
        s, e = starts[i : i + _BLOCK], ends[i : i + _BLOCK]
        size = e - s + 1
        to = np.cumsum(size)
        if to[-1] > _SLICE * 16:  # giant words
            for x, y, k in zip(s.tolist(), e.tolist(), range(i, len(starts))):
                digest.update((b" " if k else b"") + data[x:y].tobytes())
            continue
        piece = np.full(int(to[-1]), 0x20, np.uint8)
        inside = np.ones(len(piece), bool)
        inside[to - size] = False
        piece[inside] = data[(np.arange(len(piece)) + np.repeat(s - (to - size) - 1, size))[inside]]
        digest.update(piece[0 if i else 1 :].tobytes())
    return digest.hexdigest()


def _judge(ids: list, column: pa.Array, planted: bool) -> dict[str, list]:
    """Columns of the result for a few documents."""
    data, bounds = text_bytes(column)
    hashes, starts, ends, rows = word_hashes(data, bounds)
    n = len(ids)
    gaps = np.arange(n)
    words = np.zeros(len(hashes) + n, np.uint64)
    room = rows + np.arange(n + 1)  # a separator behind each document
    order: list[np.ndarray | None] = [None] * n
    for r in range(n):
        value = hashes[rows[r] : rows[r + 1]]
        if planted and ids[r] is not None:
            order[r] = planted_order(ids[r], len(value))
        words[room[r] : room[r + 1] - 1] = value if order[r] is None else value[order[r]]
    words[room[1:] - 1] = mix(gaps.astype(np.uint64) + np.uint64(0x5EED << 40))
    runs = find_runs(words, room)
    del words, hashes
    owner = np.searchsorted(room, runs[:, 0], "right") - 1
    at = np.searchsorted(owner, np.arange(n + 1))
    out: dict[str, list] = {k: [] for k in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")}
    for r in range(n):
        own = (runs[at[r] : at[r + 1]] - [room[r], 0, 0]).tolist()
        best = max(own, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        out["n_runs"].append(len(own))
        for k, name in enumerate(("start", "length", "period")):
            out[name].append(best and best[k])
        out["exponent_milli"].append(best and 1000 * best[1] // best[2])
        out["runs_sha256"].append(hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in own).encode()).hexdigest())
        s, e = starts[rows[r] : rows[r + 1]], ends[rows[r] : rows[r + 1]]
        if order[r] is not None:
            s, e = s[order[r]], e[order[r]]
        if own:
            change = np.zeros(len(s) + 1, np.int64)
            for a, m, p in own:
                change[a + p] += 1
                change[a + m] -= 1
            kept = np.cumsum(change[:-1]) == 0
            s, e = s[kept], e[kept]
        out["collapsed_sha256"].append(_joined_sha(data, s, e))
    return out


def periodic_runs(docs: DataFrame, planted: bool = False) -> DataFrame:
    """Runs of every whole text: how many, the one with the greatest exponent, and digests.

    Words are those of :mod:`words`, numbered from 0, and compared by 64-bit hashes.  Returns
    ``doc_id, n_runs``, ``start, length, period, exponent_milli`` of the run with the
    greatest length over period (then smallest start, then period; nulls without a run),
    ``runs_sha256`` over ``start,length,period`` lines, and ``collapsed_sha256`` over the
    words outside the later periods of all runs, joined by one space.

    ``planted`` first makes the tails of one document in ten periodic, by the crc32 of
    ``doc_id``; a document with a null id stays as it is.  Null and empty texts have no
    words; repeated rows are judged alike; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds = np.cumsum([0, *(batch.column(2).fill_null(0).to_numpy(zero_copy_only=False))])
            for i, j in row_slices(bounds, _SLICE):
                part = batch.slice(i, j - i)
                ids = part.column(0)
                columns = _judge(ids.to_pylist(), part.column(1), planted)
                yield pa.RecordBatch.from_arrays(
                    [ids, *(pa.array(v, pa.string() if k.endswith("sha256") else pa.int64()) for k, v in columns.items())],
                    names=["doc_id", *columns],
                )

    narrow = docs.select("doc_id", "text", F.octet_length("text").alias("size"))
    return narrow.mapInArrow(run, _RESULT.format(id=docs.schema["doc_id"].dataType.simpleString()))


def periodic_runs_sql() -> str:
    """The same with planted tails, in the SQL of a single-node engine: all pairs of equal words by their distance."""
    return f"""
    WITH crc(t) AS ({crc_table_sql()}),
    texts AS (
      SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
    ), hashed AS (
      SELECT r, doc_id, w, len(w) AS n, CASE WHEN doc_id IS NOT NULL THEN {crc32_sql("CAST(doc_id AS VARCHAR)", "t")} END AS h FROM texts, crc
    ), placed AS (
      SELECT *, h // 10 % n AS a, 1 + (n - h // 10 % n) // (3 + h // 10 % 8) AS p FROM hashed
    ), made AS (
      SELECT r, doc_id, n, CASE WHEN n > 0 AND h % 10 = 0 THEN
        [w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END] FOR i IN range(0, n)] ELSE w END AS w FROM placed
    ), words AS (
      SELECT r, n, unnest(w) AS word, unnest(range(0, n)) AS i FROM made
    ), pairs AS (
      SELECT x.r, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.r = y.r AND x.word = y.word AND y.i > x.i
      WHERE x.n >= {LEAST_WORDS} AND {LEAST_PERIODS} * (y.i - x.i) <= x.n
    ), stretches AS (
      SELECT r, q, min(i) AS start, count(*) + q AS length
      FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs) GROUP BY r, q, island
    ), runs AS (
      SELECT r, start, length, min(q) AS period FROM stretches
      WHERE length >= greatest({LEAST_WORDS}, {LEAST_PERIODS} * q) GROUP BY r, start, length
    ), told AS (
      SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
        arg_min({{'s': start, 'l': length, 'p': period}}, (-(length::HUGEINT * 1000000000000000000 // period), start, period)) AS best
      FROM runs GROUP BY r
    ), kept AS (
      SELECT r, string_agg(word, ' ' ORDER BY i) AS collapsed FROM words w
      WHERE NOT EXISTS (SELECT 1 FROM runs u WHERE u.r = w.r AND w.i >= u.start + u.period AND w.i < u.start + u.length) GROUP BY r
    )
    SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.p AS period,
      1000 * best.l // best.p AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
    FROM made LEFT JOIN told USING (r) LEFT JOIN kept USING (r)
    """
