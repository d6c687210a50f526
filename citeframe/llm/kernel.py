"""Vectorised byte kernels shared by the text operators.

All functions work on one packed UTF-8 buffer that holds many documents, so a batch costs a few
numpy passes instead of a Python loop per word.  Hashes are 64 bits wide and the same everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that one numpy pass handles; a longer document makes a pass of its own.
SLICE_BYTES = 1 << 20
SLICE_ROWS = 4096

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_GRAM = np.uint64(0xD1B54A32D192ED03)

FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32

#: Words are everything but space and the control characters from tab to carriage return.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: Words are ASCII letters and digits and everything above ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_powers: dict[str, np.ndarray] = {}


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        full = np.full(max(n, SLICE_BYTES + 1), base, dtype=np.uint64)
        full[0] = 1
        np.multiply.accumulate(full, out=full)
        if n > 8 * SLICE_BYTES:  # one giant document must not stay in memory
            return full
        have = _powers[kind] = full
    return have[:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser; the salt picks one of many."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 bounds; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, width)[column.offset : column.offset + n + 1].astype(np.int64)
    if data is None or bounds[0] == bounds[-1]:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds few bytes of text, or a single row."""
    n = batch.num_rows
    if n == 0:
        return
    _, bounds = buffers(batch.column(text))
    at = 0
    while at < n:
        end = int(np.searchsorted(bounds, bounds[at] + most, side="right")) - 1
        end = min(max(end, at + 1), at + SLICE_ROWS, n)
        yield batch.slice(at, end - at)
        at = end


@dataclass
class Words:
    """The words of a packed buffer, in order."""

    start: np.ndarray  # byte positions
    end: np.ndarray
    hash: np.ndarray  # uint64
    ptr: np.ndarray  # words of document d: ptr[d] to ptr[d + 1]

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1, dtype=np.int64), np.diff(self.ptr))


def words(data: np.ndarray, bounds: np.ndarray, is_word: np.ndarray, fold: bool = True) -> Words:
    """Maximal runs of word bytes within each document, hashed after A-Z became a-z."""
    n = len(data)
    if n == 0:
        e = np.empty(0, np.int64)
        return Words(e, e, np.empty(0, np.uint64), np.zeros(len(bounds), np.int64))
    inside = is_word[data]
    first = np.zeros(n + 1, dtype=bool)
    first[bounds] = True  # document starts, and the end
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:n]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | first[1:n]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    total = np.empty(n + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum((_BYTE[FOLD[data]] if fold else _BYTE[data]) * _power("up", _BASE, n), out=total[1:])
    h = (total[end] - total[start]) * _power("down", _BASE_INV, n)[start]
    return Words(start, end, mix(h), np.searchsorted(start, bounds).astype(np.int64))


def count_words(data: np.ndarray, bounds: np.ndarray, is_word: np.ndarray) -> np.ndarray:
    """How many words each document has."""
    if len(data) == 0:
        return np.zeros(len(bounds) - 1, np.int64)
    inside = is_word[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    start = bounds[:-1][bounds[:-1] < bounds[1:]]
    begin[start] = inside[start]
    return np.diff(np.searchsorted(np.flatnonzero(begin), bounds))


def grams(h: np.ndarray, ptr: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k consecutive words (at the first word's index), and which of them lie in one document."""
    n = len(h)
    if n < k:
        return np.empty(0, np.uint64), np.empty(0, bool)
    m = n - k + 1
    out = np.zeros(m, dtype=np.uint64)
    for j in range(k):
        out *= _GRAM
        out += h[j : j + m]
    doc = np.repeat(np.arange(len(ptr) - 1, dtype=np.int64), np.diff(ptr))
    return mix(out, k), doc[:m] == doc[k - 1 :]


def sequence(h: np.ndarray) -> int:
    """The hash of one whole word sequence; equals that of grams() for as many words."""
    return int(grams(h, np.array([0, len(h)]), len(h))[0][0])


def by_doc(values: np.ndarray, ptr: np.ndarray, how: np.ufunc = np.add, empty=0, dtype=None) -> np.ndarray:
    """Reduce the values of each document; documents without values get `empty`."""
    n = len(ptr) - 1
    out = np.full((n, *values.shape[1:]), empty, dtype=dtype or values.dtype)
    full = np.flatnonzero(ptr[1:] > ptr[:-1])
    if len(full):
        out[full] = how.reduceat(values, ptr[full], axis=0, dtype=dtype)
    return out
