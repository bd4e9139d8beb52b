"""Vectorised words of Arrow text columns: numpy works on the bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at once, unless a single text is longer.
SLICE_BYTES = 1 << 22

_ALL = np.arange(256)
#: Bytes of words `[^\x20\x09-\x0D]+`.
SPACE_WORD = ~np.isin(_ALL, [0x20, *range(0x09, 0x0E)])
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of a lower-cased text.
ALNUM_WORD = np.isin(_ALL, [*range(0x30, 0x3A), *range(0x61, 0x7B)]) | (_ALL >= 0x80)
#: A-Z become a-z, all other bytes stay.
LOWER = np.where((_ALL >= 0x41) & (_ALL <= 0x5A), _ALL + 32, _ALL).astype(np.uint8)

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in the bytes) without copies; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + max_bytes, "right")) - 1)
        yield row, stop, whole[ends[row] : ends[stop]], ends[row : stop + 1] - ends[row]
        row = stop


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in the bytes, and where each text's words begin among them."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = is_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:]
    starts = np.flatnonzero(start)
    last = inside[:-1] & (~inside[1:] | edge[1:])
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        both = []
        for base in (_BASE, _INVERSE):
            p = np.full(n, np.uint64(base & (1 << 64) - 1))
            p[0] = 1
            both.append(np.cumprod(p))
        _powers = (both[0], both[1])
    return _powers


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, chunk: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each word: differences of a running polynomial sum, a chunk of bytes at a time."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + chunk, "right")))
        lo, hi = starts[i], ends[j - 1]
        power, inverse = _powers_to(int(hi - lo) + 1)
        total = np.zeros(int(hi - lo) + 1, np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * power[: hi - lo], out=total[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        i = j
    return mixed(out)


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the values of each text; `first` as words() gives it."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]
