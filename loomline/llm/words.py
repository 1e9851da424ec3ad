"""Word and shingle hashes of whole Arrow string columns, computed with numpy.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D``. In UTF-8
those white-space bytes never occur inside a longer character, so splitting the
raw buffer is the same as splitting the decoded text. No per-word Python object
is made: texts of any length are walked in pieces of about ``PIECE`` bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """The same function of batches; when its task ends the worker, which Spark reuses, gives back the memory it no longer needs."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return whole


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash; wraps around on purpose."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _byte_values(lower: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(MULTIPLIER))
    if lower:
        values[0x41:0x5B] = values[0x61:0x7B]
    return values


_VALUES = {lower: _byte_values(lower) for lower in (False, True)}
_POW: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if len(_POW.get(base, ())) < n:
        _POW[base] = _powers(base, max(n, PIECE + 4096))
    return _POW[base]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    size = len(column)
    if not size:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + size + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _piece_words(raw: np.ndarray, cuts: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of one piece; cuts: row starts inside it."""
    solid = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[cuts] = True
    edge[-1] = True
    before = np.empty(len(raw), bool)
    before[0] = True
    before[1:] = ~solid[:-1]
    starts = np.flatnonzero(solid & (before | edge[:-1]))
    after = np.empty(len(raw), bool)
    after[-1] = True
    after[:-1] = ~solid[1:]
    ends = np.flatnonzero(solid & (after | edge[1:])) + 1
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUES[lower][raw] * _power(MULTIPLIER, len(raw))[: len(raw)], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _power(INVERSE, len(raw))[starts]
    return starts, ends, mix(hashes + (ends - starts).astype(np.uint64))


def word_hashes(raw: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes, first) of all words of the rows; row i has the words first[i]:first[i+1]."""
    parts, at, n = [], 0, len(raw)
    while at < n:
        to = min(n, at + PIECE)
        if to < n:  # end a piece at a space or a row's start
            stop = to
            while stop < n:
                step = raw[stop : stop + 65536]
                space = np.flatnonzero(_SPACE[step])
                row = offsets[np.searchsorted(offsets, stop)]
                found = min(stop + (space[0] if len(space) else len(step)), row if row >= stop else n)
                stop = found
                if len(space) or found == row:
                    break
            to = max(stop, at + 1)
        lo, hi = np.searchsorted(offsets, [at, to])
        starts, ends, hashes = _piece_words(raw[at:to], offsets[lo:hi] - at, lower)
        parts.append((starts + at, ends + at, hashes))
        at = to
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    starts, ends, hashes = (np.concatenate([p[i] for p in parts]) for i in range(3))
    return starts, ends, hashes, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of a row, and their ranges by row; a row with fewer words has its whole sequence as one."""
    total, rows = len(hashes), len(first) - 1
    counts = np.diff(first)
    rolled = np.zeros(max(total - k + 1, 0), np.uint64)
    for i in range(k):
        rolled = rolled * np.uint64(MULTIPLIER) + hashes[i : i + len(rolled)]
    many = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    to = np.concatenate([[0], np.cumsum(many)])
    out = np.empty(to[-1], np.uint64)
    long = counts >= k
    source = np.repeat(first[:-1] - to[:-1], many) + np.arange(to[-1])
    whole = np.repeat(long, many)
    out[whole] = mix(rolled[source[whole]] + np.uint64(k))
    for r in np.flatnonzero(~long & (counts > 0)):
        value = 0
        for h in hashes[first[r] : first[r + 1]].tolist():
            value = (value * MULTIPLIER + h) & ((1 << 64) - 1)
        out[to[r]] = mix(np.array([(value + int(counts[r])) & ((1 << 64) - 1)], np.uint64))[0]
    assert len(to) == rows + 1
    return out, to


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about limit bytes (one longer row alone): from, to, bytes, offsets."""
    raw, offsets = text_buffer(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, to, raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
