"""MinHash near-dedup with sequential Bayesian verification.

A document's set holds the distinct hashed shingles of its lower-cased words.  Two documents link when
100 * intersection >= threshold * union; equal sets are one class (128-bit key), so copies cost one set.

*Banding.*  ``BANDS`` band keys of ``BAND_ROWS`` minima each make two sets of similarity s candidates with probability
1 - (1 - s^r)^b: at the threshold of 0.8 a pair is missed with 1.3e-7.

*Sequential verification.*  Each set also has ``CODES`` further minima, of which one byte is kept, so that two codes agree
with probability c = s + (1 - s) / 256.  Candidates of a bucket are compared batch by batch of codes.  With a uniform prior
on c, the chance that a pair of m agreements among n is at the threshold or above is P(Bin(n + 1, c_t) <= m); a pair is
pruned as soon as that falls below ``miss``.  Sizes prune first: a pair links only if the smaller set has threshold % of
the larger.  The pairs that survive connect sets to blocks.

*Exact check.*  Inside each block, survivors of the same sequential test are verified on their full shingle sets, which are
made only for the sets in blocks.  Verified links give the components.  Buckets and blocks of any size are spread over tasks
(see ``crowds``); no pair that may link is left out.

Edge cases: null and empty texts, and texts without words, have empty sets, no links and themselves as component; texts
with fewer words than a shingle are one shingle; very long texts are whole; null ids link like others and never become a
component's id unless all of it are null; repeated rows are copies; extra columns are ignored; an empty table gives an
empty result.  ``kept`` is null where the id is null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, named_sets
from .crowds import connected, sides
from .jaccard_join import SQL as JACCARD_SQL
from .jaccard_join import _sets_of, forest, set_keys
from .storage import small_batches, written
from .words import lean, mix, string_parts

SHINGLE = 2
THRESHOLD = 80
BANDS, BAND_ROWS = 40, 5
CODES, STEP = 128, 32
#: Posterior chance of similarity at the threshold below which a pair is given up.
MISS = 1e-8
_U = np.uint64
_N = BANDS * BAND_ROWS + CODES
with np.errstate(over="ignore"):
    _MULTIPLY = (mix(np.arange(1, _N + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) >> _U(32)).astype(np.uint32) | np.uint32(1)
    _ADD = (mix(np.arange(1, _N + 1, dtype=_U) * _U(0xD1342543DE82EF95)) >> _U(32)).astype(np.uint32)


def minima(u: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The least value of each of the hash functions over each non-empty set: shape (functions, sets)."""
    x = (mix(u) >> _U(32)).astype(np.uint32)
    out, value = np.empty((_N, len(at) - 1), np.uint32), np.empty_like(x)
    with np.errstate(over="ignore"):
        for i in range(_N):
            np.multiply(x, _MULTIPLY[i], out=value)
            np.add(value, _ADD[i], out=value)
            np.minimum.reduceat(value, at[:-1], out=out[i])
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """One key for each band of each set: shape (sets, bands)."""
    with np.errstate(over="ignore"):
        key = np.repeat(mix(np.arange(BANDS, dtype=_U) + _U(0xBA4D))[:, None], least.shape[1], axis=1)
        for r in range(BAND_ROWS):
            key = mix(key * _U(0x9E3779B97F4A7C15) + least[r : BANDS * BAND_ROWS : BAND_ROWS])
    return key.T


def codes_of(least: np.ndarray) -> np.ndarray:
    """One byte of each further minimum, mixed, as the minima themselves have small leading bytes: shape (sets, codes)."""
    return (mix(least[BANDS * BAND_ROWS :].astype(_U)) & _U(255)).astype(np.uint8).T


def posterior(m: int, n: int, threshold: float) -> float:
    """The chance that the similarity is at least ``threshold`` after m agreements among n codes."""
    c = threshold + (1 - threshold) / 256
    return math.fsum(math.comb(n + 1, j) * c**j * (1 - c) ** (n + 1 - j) for j in range(m + 1))


def least_agreements(threshold: float, miss: float = MISS) -> list[tuple[int, int]]:
    """(n, m): after n codes a pair goes on with at least m agreements."""
    return [(n, next(m for m in range(n + 1) if posterior(m, n, threshold) >= miss)) for n in range(STEP, CODES + 1, STEP)]


def survivors(codes: np.ndarray, sizes: np.ndarray, row: int, among: np.ndarray, threshold: int, plan: list[tuple[int, int]]) -> np.ndarray:
    """Rows of ``among`` whose codes keep the similarity with ``row`` credible to the end."""
    n = sizes[among]
    among = among[100 * np.minimum(n, sizes[row]) >= threshold * np.maximum(n, sizes[row])]
    agree = np.zeros(len(among), np.int64)
    for stop, least in plan:
        if not len(among):
            break
        agree += (codes[among, stop - STEP : stop] == codes[row, stop - STEP : stop]).sum(axis=1)
        keep = agree >= least
        among, agree = among[keep], agree[keep]
    return among


def pairs_alive(codes: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: int, plan: list[tuple[int, int]]) -> np.ndarray:
    """The same test for listed pairs: which of them survive."""
    out = np.flatnonzero(100 * np.minimum(sizes[a], sizes[b]) >= threshold * np.maximum(sizes[a], sizes[b]))
    agree = np.zeros(len(out), np.int64)
    for stop, least in plan:
        agree += (codes[a[out], stop - STEP : stop] == codes[b[out], stop - STEP : stop]).sum(axis=1)
        out, agree = out[agree >= least], agree[agree >= least]
    return out


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    data, offsets = string_parts(column)
    return data[offsets[0] : offsets[-1]].reshape(-1, CODES)


def _linker(threshold: int, plan: list[tuple[int, int]], exact: bool):
    """A link test for ``crowds``: pairs that survive the sequential test, and that are verified on their sets if ``exact``."""

    def link(t: pa.Table, borders: np.ndarray) -> np.ndarray:
        codes, sizes, side = _matrix(t["codes"]), t["n_shingles"].to_numpy(), t["side"].to_numpy()
        if exact:
            data, at = string_parts(t["shingles"])
            content = lambda i: np.frombuffer(data[at[i] : at[i + 1]].tobytes(), _U)

        def verified(a: int, found: np.ndarray) -> np.ndarray:
            if not exact or not len(found):
                return found
            own, keep = content(a), []
            for b in found.tolist():
                x, y = (own, content(b)) if sizes[a] >= sizes[b] else (content(b), own)
                place = np.searchsorted(x, y)
                both = int((x[np.minimum(place, len(x) - 1)] == y).sum())
                keep.append(100 * both >= threshold * (sizes[a] + sizes[b] - both))
            return found[np.array(keep)]

        n = np.diff(borders)
        two = borders[:-1][n == 2]
        two = two[side[two + 1] == 0]
        two = two[pairs_alive(codes, sizes, two, two + 1, threshold, plan)]
        out = [(a, a + 1) for a in two.tolist() if len(verified(a, np.array([a + 1])))]
        for first, stop in zip(borders[:-1][n > 1].tolist(), borders[1:][n > 1].tolist(), strict=True):
            left, right = sides(side[first:stop])
            if not len(left) or not len(right) or left is right and len(left) == 2:
                continue
            own, own_sizes = codes[first:stop], sizes[first:stop]
            search = lambda x, of_left: survivors(own, own_sizes, x, left if of_left else right, threshold, plan)  # noqa: B023, E731
            check = lambda x, found: verified(x + first, found + first) - first  # noqa: B023, E731
            out += [(a + first, b + first) for a, b in forest(left, right, search, check)]
        return np.array(out, np.int64).reshape(-1, 2)

    return link


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, threshold: int = THRESHOLD, miss: float = MISS, limit: int = 2000) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs``, which should come from a table (rows find their text again by place)."""
    small_batches(docs.sparkSession)
    plan = least_agreements(threshold / 100, miss)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[bytes] = set()
            for part, u, at in _sets_of(batch, shingle):
                n = np.diff(at)
                short, key = set_keys(u, at)
                fresh = []
                for i, k in enumerate(key.to_pylist()):
                    if n[i] and k not in seen:
                        seen.add(k)
                        fresh.append(i)
                bands: list[np.ndarray | None] = [None] * len(n)
                codes: list[bytes | None] = [None] * len(n)
                if fresh:
                    pick = np.zeros(len(n), bool)
                    pick[fresh] = True
                    least = minima(u[np.repeat(pick, n)], np.concatenate([[0], np.cumsum(n[pick])]))
                    keys, short_codes = np.ascontiguousarray(band_keys(least)).view(np.int64), codes_of(least)
                    for j, i in enumerate(fresh):
                        bands[i], codes[i] = keys[j], short_codes[j].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), pa.array(n.astype(np.int64)), key, pa.array(short.view(np.int64)), pa.array(bands, pa.list_(pa.int64())), pa.array(codes, pa.binary())],
                    ["row", "doc_id", "n_shingles", "key", "k", "bands", "codes"],
                )

    described = written(rows.mapInArrow(lean(describe), "row long, doc_id long, n_shingles long, key binary, k long, bands array<long>, codes binary"), "signatures")
    # one row of each set; k, half of the key, names sets until they are verified: equal halves of different sets only share a block
    banded = described.where("bands IS NOT NULL")
    first = F.when(F.col("bands").isNotNull(), F.struct("row", "k", "n_shingles", "codes"))
    firsts = described.where("n_shingles > 0").groupBy("key").agg(F.min(first).alias("x"), F.min("doc_id").alias("least"))
    firsts = written(firsts.select("key", "x.*", "least"), "distinct-sets")
    met = banded.select("k", F.explode("bands").alias("sig"))
    # buckets with the same members are searched once: extremes and a sum of hashes tell groups of members apart
    buckets = met.groupBy("sig").agg(F.count("*").alias("n"), F.min("k").alias("v"), F.max("k").alias("w"), F.sum(F.xxhash64("k").cast("decimal(20,0)")).alias("x"))
    buckets = buckets.where("v <> w").groupBy("n", "v", "w", "x").agg(F.min("sig").alias("sig")).select("sig")
    members = written(met.join(buckets, "sig").distinct().select("k", F.col("sig").alias("g"), F.lit(1).alias("weight")), "buckets")
    blocks = written(components(connected(members, firsts.select("k", "n_shingles", "codes"), _linker(threshold, plan, False), limit=limit)).select(F.col("node").alias("k"), F.col("root").alias("g")), "blocks")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, u, at in _sets_of(batch, shingle):
                if not set_keys(u, at)[1].equals(part.column("key")):
                    raise ValueError("rows changed their places between two passes: give a table")
                own = [part.column(c) for c in ("key", "k", "n_shingles", "codes")]
                yield pa.RecordBatch.from_arrays([*own, pa.array([u[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())], ["key", "k", "n_shingles", "codes", "shingles"])

    wanted = written(firsts.drop("least").join(blocks.select("k").distinct(), "k", "left_semi"), "wanted")
    full = rows.select("row", "t").join(wanted, "row").mapInArrow(lean(sets), "key binary, k long, n_shingles long, codes binary, shingles binary")
    full = written(full, "shingle-sets")
    weighed = blocks.join(wanted.groupBy("k").agg(F.sum("n_shingles").alias("weight")), "k")
    links = connected(weighed, full, _linker(threshold, plan, True), node="key", limit=limit)
    groups = components(links)

    named = named_sets(firsts, groups)
    filled = described.where("n_shingles > 0").join(named, "key").select("doc_id", "n_shingles", "component_id")
    empty = described.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return filled.union(empty).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op13_minhash_bayes(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_TWO_WORDS = JACCARD_SQL.replace("len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])", "len(ws) >= 2 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])")
SQL = "SELECT *, doc_id = component_id AS kept FROM (" + _TWO_WORDS.replace(">= 90 *", ">= 80 *") + ")"
