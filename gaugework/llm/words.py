"""Words of whole Arrow columns of text as 64-bit hashes, without a Python object per word.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09``-``\\x0D``.  In UTF-8 no
other character holds those bytes, so bytes and code points give the same words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Letters, digits and everything beyond ASCII; the rest separates.
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
SAME = np.arange(256)
LOWER = np.where((SAME >= 0x41) & (SAME <= 0x5A), SAME + 32, SAME)

_random = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x9E3779B97F4A7C15 | 5
_BACK = pow(_STEP, -1, 1 << 64)
_PIECE = 1 << 19


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_STEP, _PIECE + 1), _powers(_BACK, _PIECE + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values; different values stay different."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and where each row starts, and ends; null is empty."""
    column = column.cast(pa.binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def row_slices(bounds: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most ``most`` bytes together, or one row that has more."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, "right")) - 1)
        yield i, j
        i = j


def _hash_piece(data: np.ndarray, cuts: np.ndarray, values: np.ndarray, gap: np.ndarray):
    """Hashes, starts and ends of the words of one piece; a word also ends at each cut."""
    n = len(data)
    inside = ~gap[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if n > _PIECE:
        up, down = _powers(_STEP, n + 1), _powers(_BACK, n + 1)
    else:
        up, down = _UP, _DOWN
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values[data] * up[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts, ends


def word_hashes(
    data: np.ndarray, bounds: np.ndarray, fold: np.ndarray = SAME, gap: np.ndarray = SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of all words, and where each row's words start (and end).

    Bytes are worked on in pieces of half a MB, cut at row ends or at gaps, so that
    the arrays beside the words stay small for a text of any length.
    """
    values = _BYTE[fold]
    hashes, starts, ends = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    i, n = 0, len(data)
    while i < n:
        j = min(n, i + _PIECE)
        if j < n:
            row = int(np.searchsorted(bounds, j, "right")) - 1
            if bounds[row] > i:
                j = int(bounds[row])
            else:
                gaps = np.flatnonzero(gap[data[i:j]])
                while not len(gaps) and j < bounds[row + 1]:
                    j = min(int(bounds[row + 1]), j + _PIECE)
                    gaps = np.flatnonzero(gap[data[i:j]])
                j = i + int(gaps[-1]) + 1 if len(gaps) else j
        cuts = bounds[np.searchsorted(bounds, i) : np.searchsorted(bounds, j)] - i
        h, s, e = _hash_piece(data[i:j], cuts, values, gap)
        hashes.append(h)
        starts.append(s + i)
        ends.append(e + i)
        i = j
    start = np.concatenate(starts)
    return np.concatenate(hashes), start, np.concatenate(ends), np.searchsorted(start, bounds)


def shingle_hashes(hashes: np.ndarray, rows: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``size`` words within a row, and where each row's runs start.

    A row with fewer words has its whole sequence as its one run; without words, none.
    """
    n = np.diff(rows)
    out, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for k in range(1, size + 1):
        if k == size:
            at = np.arange(max(0, len(hashes) - size + 1))
            row = np.searchsorted(rows, at, "right") - 1
            ok = at + size <= rows[row + 1] if len(at) else np.zeros(0, bool)
            at, row = at[ok], row[ok]
        else:
            row = np.flatnonzero(n == k)
            at = rows[row]
        value = np.full(len(at), k, np.uint64)
        for w in range(k):
            value = mix(value * np.uint64(_STEP) + hashes[at + w])
        out.append(value)
        owner.append(row)
    value, row = np.concatenate(out), np.concatenate(owner)
    if len(out) > 1 and (n < size).any():
        order = np.argsort(row, kind="stable")
        value, row = value[order], row[order]
    return value, np.searchsorted(row, np.arange(len(rows)))
