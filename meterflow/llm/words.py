"""Vectorised word views over Arrow string columns, shared by the operators of this subpackage.

A *word* is a maximal run of bytes outside 0x20 and 0x09-0x0D (`[^\\x20\\x09-\\x0D]+`); since these six
are ASCII, splitting UTF-8 bytes equals splitting code points.  Words are identified by 64-bit hashes that
mix every byte with its position (two independent families, so a pair of them makes a 128-bit key).  Nulls
and empty texts have no words.  Nothing here keeps state between batches; memory is a small multiple of
``max_bytes`` plus the longest single text.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

WORD = r"[^\x20\x09-\x0D]+"
_U = np.uint64
_PERIOD = 1 << 14


def lean(run: Callable) -> Callable:
    """A task's generator that gives freed memory back to the system at its end, so that idle Python workers stay small."""

    @functools.wraps(run)
    def runs(*args):
        try:
            yield from run(*args)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return runs


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (murmur-style shifts and multiplications)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def pair(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """An ordered combination of two hash columns."""
    return mix(a * _U(0x9E3779B97F4A7C15) + mix(b + _U(salt)))


def distinct(x: np.ndarray) -> np.ndarray:
    """Distinct values in their order; ``x`` is sorted where it is (``np.unique`` hashes, which takes longer)."""
    x.sort()
    new = np.ones(len(x), dtype=bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def _stream(seed: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))


_BYTE = [_stream(11, 256), _stream(12, 256)]
#: Odd bases of the two families: a word's value is the sum of base^place * _BYTE over its bytes.
_BASE = [0x9E3779B97F4A7C15, 0xD1342543DE82EF95]


def _powers(base: int) -> np.ndarray:
    out = np.full(_PERIOD, base, dtype=_U)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=_U)


_POWER = [_powers(b) for b in _BASE]
_INVERSE = [_powers(pow(b, -1, 1 << 64)) for b in _BASE]


def _steps(base: int, n: int) -> np.ndarray:
    """base^(_PERIOD * i) for i below n."""
    out = np.full(n, pow(base, _PERIOD, 1 << 64), dtype=_U)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=_U)


_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Words:
    """Words of consecutive texts: ``data`` bytes, byte ``start``/``end`` of each word, word range ``at[d]:at[d+1]`` of text d."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    at: np.ndarray
    offsets: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    def doc(self) -> np.ndarray:
        """The text number of each word."""
        return np.repeat(np.arange(len(self.at) - 1), self.counts)

    def hash(self, family: int = 0) -> np.ndarray:
        """One uint64 per word."""
        if not len(self.start):
            return np.zeros(0, dtype=_U)
        first = int(self.start[0])
        piece = self.data[first : int(self.end[-1])]
        begin, size = self.start - first, self.end - self.start
        n = -(-len(piece) // _PERIOD)
        base = _BASE[family]
        value = np.zeros(n * _PERIOD, dtype=_U)
        np.take(_BYTE[family], piece, out=value[: len(piece)])
        with np.errstate(over="ignore"):
            blocks = value.reshape(n, _PERIOD)
            blocks *= _POWER[family]
            if n > 1:
                blocks *= _steps(base, n)[:, None]
            np.cumsum(value, out=value)
            total = value[begin + size - 1] - np.where(begin > 0, value[begin - 1], _U(0))
            back = _INVERSE[family][begin % _PERIOD] * _steps(pow(base, -1, 1 << 64), n)[begin // _PERIOD]
            return mix(total * back + size.astype(_U))

    def text(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Words of the texts ``data[offsets[d]:offsets[d+1]]``; ``lower`` folds A-Z only."""
    base = int(offsets[0])
    data = data[base : int(offsets[-1])]
    offsets = offsets.astype(np.int64) - base
    if lower:
        data = _LOWER[data]
    inside = ~_SEP[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] |= inside[edges]
    ends[edges - 1] |= inside[edges - 1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    return Words(data, start, end, np.searchsorted(start, offsets), offsets)


def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column, nulls as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type in (pa.large_string(), pa.large_binary()):
        kind = np.int64
    else:
        kind = np.int32
        if column.type not in (pa.string(), pa.binary()):
            column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, place, content = column.buffers()
    offsets = np.frombuffer(place, dtype=kind)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(content, dtype=np.uint8) if content is not None and content.size else np.zeros(0, dtype=np.uint8)
    return data, offsets.astype(np.int64)


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row ranges of a batch with at most ``max_bytes`` of text each (one text at least), with its bytes and offsets."""
    data, offsets = string_parts(batch.column(column))
    row, rows = 0, batch.num_rows
    while row < rows:
        stop = int(np.searchsorted(offsets, offsets[row] + max_bytes, side="right")) - 1
        stop = min(max(stop, row + 1), rows)
        yield batch.slice(row, stop - row), data, offsets[row : stop + 1]
        row = stop
