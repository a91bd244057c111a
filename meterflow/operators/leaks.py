"""Search for very many values in bodies at once, by an inverted index of byte grams.

A value that occurs in a body occurs there with all its grams, so one gram of a value, the one that the fewest bodies hold, is
the key by which it meets bodies; then the body is searched for the value itself.  The bodies are read once for their grams,
whatever the number of values: a bit map of all grams of values (16 MB) keeps those that no value has in their task.  Grams
are 4, 8, 16 or 32 bytes, as long as the value allows, so that long values meet few bodies by chance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written

WIDTHS = (4, 8, 16, 32)
_BITS = 27
_BUCKET = 1 << 15  # bits of one of Spark's bit maps
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(29))) * _U(0x9FB21C651E98DF25)
    return x ^ (x >> _U(32))


with np.errstate(over="ignore"):
    _BYTES = _mixed(np.arange(1, 257, dtype=_U) * _U(0xC2B2AE3D27D4EB4F))


def grams(data: np.ndarray, widths: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray]]:
    """Width by width: a 63-bit hash of the bytes from each place on, by doubling."""
    x, w = _BYTES[data], 1
    with np.errstate(over="ignore"):
        while 2 * w <= max(widths) and 2 * w <= len(data):
            x = _mixed(x[:-w] * _U(0xD6E8FEB86659FD93) + x[w:] + _U(w))
            w *= 2
            if w in widths:
                yield w, (x >> _U(1)).astype(np.int64)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, nulls as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, place, content = column.buffers()
    at = np.frombuffer(place, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(content or b"", np.uint8)[at[0] : at[-1]], at - at[0]


def _value_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """value, width, gram: grams side by side, and that at the value's end."""
    for batch in batches:
        for value in batch.column("value").to_pylist():
            data = np.frombuffer(value.encode(), np.uint8)
            width = max((w for w in WIDTHS if w <= len(data)), default=None)
            if width:
                every = dict(grams(data, (width,)))[width]
                own = np.unique(np.append(every[::width], every[-1]))
                yield pa.RecordBatch.from_arrays([pa.array([value] * len(own)), pa.array(np.full(len(own), width, np.int32)), pa.array(own)], ["value", "width", "gram"])


def _bit_map(found: DataFrame) -> np.ndarray:
    """Bits of all grams, of 2^27: at most 4,096 rows of 4 KB reach the driver, however many grams there are."""
    place = F.pmod(F.col("gram"), F.lit(1 << _BITS)) + 1
    rows = found.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros((1 << _BITS) // 8, np.uint8)
    for r in rows.collect():
        first = (r["bucket"] - 1) * _BUCKET // 8
        out[first : first + _BUCKET // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def _hits(bodies: DataFrame, widths: tuple[int, ...], bits: np.ndarray, at_once: int = 4 << 20) -> DataFrame:
    """file, gram: the grams of values in each body (and some others), once each."""
    shared = bodies.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = _bytes(batch.column("body"))
            first = 0
            while first < batch.num_rows:
                stop = max(int(np.searchsorted(at, at[first] + at_once, side="right")) - 1, first + 1)
                own, gram = [], []
                for w, h in grams(data[at[first] : at[stop]], widths):
                    place = h & ((1 << _BITS) - 1)
                    hit = np.flatnonzero((shared.value[place >> 3] >> (place & 7).astype(np.uint8)) & 1)
                    body = np.searchsorted(at[first : stop + 1] - at[first], hit, side="right") - 1
                    whole = hit + w <= at[first + 1 + body] - at[first]
                    own.append(body[whole] + first)
                    gram.append(h[hit[whole]])
                if own:
                    pairs = np.unique(np.column_stack([np.concatenate(own), np.concatenate(gram)]), axis=0)
                    yield pa.RecordBatch.from_arrays([batch.column("file").take(pa.array(pairs[:, 0])), pa.array(pairs[:, 1])], ["file", "gram"])
                first = stop

    kind = bodies.schema["file"].dataType.simpleString()
    return bodies.select("file", "body").mapInArrow(run, f"file {kind}, gram long")


def values_in(bodies: DataFrame, values: DataFrame) -> DataFrame:
    """(file, value): the values of four bytes or more (distinct, not null) that occur in each body; null bodies hold none."""
    found = written(values.select("value").where("value IS NOT NULL").distinct().mapInArrow(_value_grams, "value string, width int, gram long"), "value-grams")
    widths = tuple(sorted(r["width"] for r in found.select("width").distinct().collect()))
    if not widths:
        return bodies.select("file", F.lit("").alias("value")).where(F.lit(False))
    hits = written(_hits(bodies, widths, _bit_map(found)), "gram-hits")
    often = hits.groupBy("gram").agg(F.count("*").alias("n"))
    # a value with a gram that no body holds is nowhere
    rarest = found.join(often, "gram", "left").groupBy("value").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("x")).where("x.n > 0")
    meet = written(hits.join(rarest.select("value", "x.gram"), "gram").select(F.col("file").alias("_file"), "value").distinct(), "candidates")
    sure = meet.join(bodies.select("file", "body"), F.col("_file").eqNullSafe(F.col("file"))).where(F.contains("body", "value"))
    return sure.select("file", "value").distinct()
