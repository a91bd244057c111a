"""A count-min sketch of counts saturated at two, built per partition and merged on Spark.

``ROWS`` rows of 2^bits counters are bit maps ("once", "twice or more") in blocks of ``BLOCK``.  A task places at most
``HELD`` keys at a time and sends each block's places (or its bit maps, where they are shorter); blocks are merged by a
shuffle on their number, and the merged "twice" maps (ROWS * 2^bits / 8 bytes) go to all tasks.  ``width`` chooses bits
for an expected number of keys, up to ``MOST_BITS``, which bounds the maps.  An estimate never falls below the true
count, so ``repeated`` loses nothing; a sketch too small for its input only flags more.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .storage import freed
from .words import lean, mix

BLOCK = 1 << 16
ROWS = 4
HELD = 1 << 20
LEAST_BITS, MOST_BITS = 16, 28
_SALT = mix(np.arange(1, ROWS + 1, dtype=np.uint64) * np.uint64(0x5851F42D4C957F2D))
_BLOCKS = "row int, block int, once binary, twice binary"


def width(keys: float) -> int:
    """Bits for a number of keys: four to eight counters for each (at most 0.3 % of single keys are flagged)."""
    return int(np.clip(np.ceil(np.log2(max(4 * keys, 1))), LEAST_BITS, MOST_BITS))


def _place(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(keys ^ _SALT[row]) >> np.uint64(64 - bits)).astype(np.int64)


def _code(places: np.ndarray) -> bytes:
    """Sorted distinct places of a block: themselves, or a bit map of BLOCK / 8 bytes where that is shorter."""
    return places.tobytes() if 2 * len(places) < BLOCK // 8 else _bit_map(places)


def _bit_map(places: np.ndarray) -> bytes:
    flags = np.zeros(BLOCK, np.uint8)
    flags[places] = 1
    return np.packbits(flags).tobytes()


def _read(code: bytes) -> np.ndarray:
    return np.frombuffer(code if len(code) == BLOCK // 8 else _bit_map(np.frombuffer(code, "<u2")), np.uint8)


def placed(keys: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Blocks of some keys."""
    for row in range(ROWS):
        at = np.sort(_place(keys, row, bits))
        again = at[1:][at[1:] == at[:-1]]
        once, twice = (x[np.append(True, x[1:] != x[:-1])[: len(x)]] for x in (at, again))
        blocks = np.unique(once >> 16)
        cuts = [np.searchsorted(x, np.append(blocks << 16, 1 << bits)).tolist() for x in (once, twice)]
        low = [(x & (BLOCK - 1)).astype("<u2") for x in (once, twice)]
        columns = [pa.array([_code(x[a:b]) for a, b in zip(c, c[1:])], pa.binary()) for x, c in zip(low, cuts, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(blocks), row, np.int32)), pa.array(blocks.astype(np.int32)), *columns], ["row", "block", "once", "twice"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for b in batches:
        for row, block, once, twice in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            once, twice = _read(once), _read(twice)
            if (row, block) in held:
                old = held[row, block]
                twice = old[1] | twice | (old[0] & once)
                once = old[0] | once
            held[row, block] = (once, twice)
    for (row, block), (_, twice) in held.items():
        if twice.any():
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([block], pa.int32()), pa.array([zlib.compress(twice.tobytes(), 1)], pa.binary())], ["row", "block", "twice"])


def repeated_maps(rows: DataFrame, keys: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int) -> np.ndarray:
    """Merged "twice" bit maps, shape (ROWS, 2^bits / 8), of all keys that ``keys`` gives for the batches of ``rows``."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for found in keys(batch):
                for piece in (found[i : i + HELD] for i in range(0, len(found), HELD)):
                    if n + len(piece) > HELD:
                        yield from placed(np.concatenate(held), bits)
                        held, n = [], 0
                    held.append(piece)
                    n += len(piece)
        if n:
            yield from placed(np.concatenate(held), bits)

    merged = rows.mapInArrow(lean(build), _BLOCKS).repartition("row", "block").mapInArrow(lean(_merge), "row int, block int, twice binary")
    out = np.zeros((ROWS, max(BLOCK, 1 << bits) // 8), dtype=np.uint8)
    for batch in merged.toArrow().to_batches(max_chunksize=256):
        for r in batch.to_pylist():
            first = r["block"] * BLOCK // 8
            piece = np.frombuffer(zlib.decompress(r["twice"]), np.uint8)
            out[r["row"], first : first + len(piece)] = piece
    spark = rows.sparkSession
    del merged
    freed(spark)  # the blocks are as large as the keys; their shuffle goes before the next pass
    return out


def packed(maps: np.ndarray) -> tuple[tuple[int, ...], bool, bytes]:
    """The maps for a broadcast: compressed where they are mostly zeros; else as they are, so that a task holds them once."""
    sparse = np.count_nonzero(maps) < maps.size // 4
    return maps.shape, sparse, zlib.compress(maps.data, 1) if sparse else maps.tobytes()


def unpacked(value: tuple[tuple[int, ...], bool, bytes]) -> np.ndarray:
    shape, sparse, raw = value
    return np.frombuffer(zlib.decompress(raw) if sparse else raw, np.uint8).reshape(shape)


def repeated(maps: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    """Whether each key is estimated to occur twice or more."""
    out = np.ones(len(keys), dtype=bool)
    for row in range(ROWS):
        at = _place(keys, row, bits)
        out &= (maps[row][at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return out
