"""Approximate nearest neighbours as a block matrix join.

Every vector is quantised once to int8 with one scale; only codes and scales travel to the blocks.  Queries and candidates
are cut into blocks by a hash of their ids; every (query block, candidate block) tile is one group.  Inside a tile the
integer products give scores with a proven error bound, and whatever has an upper bound that reaches the query's k-th best
lower bound survives.  Survivors are pruned again by the k-th best lower bound of all tiles, the vectors of the rest are
fetched and scored in double precision (terms added in component order), and heaps of k are merged: first inside each task, then
per query.  Because the bounds are sound, the result equals brute force.  Of equal vectors, which
tie everywhere, only the least ids are candidates.

Edge cases: vectors that are null, empty, zero, or hold a null, NaN or infinite component take no part, neither as
query nor as candidate; vectors of different lengths are never compared; rows that repeat a query's id are its own
row and no candidate of it; other repeated rows each count; ties go to the smaller id; ids that are null take no
part; with fewer than k candidates all are returned; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written
from .words import lean

SCHEMA = "query_id long, vec_id long, score double"


def _usable(v: Column) -> Column:
    d = F.col("_v")
    finite = ~F.exists(d, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(d) > 0) & finite & F.exists(d, lambda x: x != 0)


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """int8 codes and the scale of each row; |x - scale * code| <= scale / 2 in each component."""
    scale = np.abs(x).max(axis=1) / 127.0
    scale[scale == 0] = 1e-300
    return np.clip(np.rint(x / scale[:, None]), -127, 127).astype(np.int8), scale


CODES = "row long, id long, is_q boolean, dims int, code binary, scale double, mass double, code_mass double"


def _quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        dims = b.column("dims").to_numpy()
        for d in np.unique(dims).tolist():
            part = b.filter(pa.array(dims == d))
            x = _matrix(part.column("_v"))
            code, scale = quantised(x)
            mass = pa.array(np.abs(x).sum(axis=1))
            code_mass = pa.array(np.abs(code.astype(np.float64)).sum(axis=1) * scale)
            raw = code.tobytes()
            own = [part.column(c) for c in ("row", "id", "is_q", "dims")]
            yield pa.RecordBatch.from_arrays([*own, pa.array([raw[i * d : i * d + d] for i in range(len(x))], pa.binary()), pa.array(scale), mass, code_mass], [f.split()[0] for f in CODES.split(", ")])


def tile(q: pa.Table, c: pa.Table, k: int, step: int = 128) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Survivors of a tile: row numbers in ``q`` and in ``c``, lower and upper bounds of their scores."""
    d = q["dims"][0].as_py()
    # products of int8 codes summed in float32 are exact below 2^24
    kind = np.float32 if d * 127 * 127 < 1 << 24 else np.float64
    codes = lambda t: np.frombuffer(b"".join(t["code"].to_pylist()), np.int8).reshape(-1, d).astype(kind)
    number = lambda t, name: t[name].to_numpy()
    qq, cq = codes(q), codes(c).T
    cs, cm, cid = number(c, "scale"), number(c, "code_mass"), number(c, "id")
    qs, qm, qid = number(q, "scale"), number(q, "mass"), number(q, "id")
    for i in range(0, len(qq), step):
        j = slice(i, i + step)
        score = (qq[j] @ cq).astype(np.float64) * (qs[j, None] * cs)
        bound = qm[j, None] * (cs / 2) + (qs[j, None] / 2) * cm
        bound += 1e-9 * (np.abs(score) + bound)
        own = qid[j, None] == cid
        low, high = np.where(own, -np.inf, score - bound), score + bound
        least = np.partition(low, len(cid) - k, axis=1)[:, len(cid) - k, None] if len(cid) > k else -np.inf
        rows, columns = np.nonzero((high >= least) & ~own)
        yield rows + i, columns, low[rows, columns], high[rows, columns]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, block: int = 8192, query_block: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k rows of largest inner product for every query row: query_id, rank, vec_id, score.

    ``block`` and ``query_block`` are rows per block; the codes moved (a byte a component) are rows * query blocks +
    queries * blocks, the vectors those of some k survivors a query.
    """
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("_v"), is_query.alias("is_q"))
    v = v.where(F.col("id").isNotNull() & _usable(F.col("_v"))).withColumns({"is_q": F.coalesce("is_q", F.lit(False)), "dims": F.size("_v"), "row": F.monotonically_increasing_id()})
    v = written(v, "vectors")
    sizes = v.agg(F.count("*").alias("n"), F.count_if("is_q").alias("q")).first()
    n_c, n_q = max(1, -(-sizes["n"] // block)), max(1, -(-sizes["q"] // query_block))
    # of equal vectors only those of the k + 1 smallest ids can be among the k nearest of anything: groups of copies stay small
    few = v.withColumn("_nth", F.dense_rank().over(Window.partitionBy("_v").orderBy("id"))).where(F.col("_nth") <= k + 1).drop("_nth")
    codes = lambda rows: rows.mapInArrow(lean(_quantise), CODES)
    own = F.xxhash64("id", F.lit(7))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    c = codes(few).select("row", "id", "dims", "code", "scale", "code_mass", F.pmod(own, F.lit(n_c)).cast("int").alias("cb"), numbers(n_q).alias("qb"))
    q = codes(v.where("is_q")).select("row", "id", "dims", "code", "scale", "mass", F.pmod(own, F.lit(n_q)).cast("int").alias("qb"), numbers(n_c).alias("cb"))

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        found = list(tile(left, right, k)) if left.num_rows and right.num_rows else []
        rows, columns, low, high = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 4
        ids = [left["row"].to_numpy()[rows], right["row"].to_numpy()[columns]]
        return pa.table([*(pa.array(x, pa.int64()) for x in ids), *(pa.array(x, pa.float64()) for x in (low, high))], names=["q_row", "c_row", "low", "high"])

    keys = ["dims", "qb", "cb"]
    pairs = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(join, "q_row long, c_row long, low double, high double")
    least = F.nth_value("low", k).over(Window.partitionBy("q_row").orderBy(F.desc("low")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    pairs = pairs.withColumn("least", least).where(F.col("least").isNull() | (F.col("high") >= F.col("least"))).select("q_row", "c_row")
    a = v.where("is_q").select(F.col("row").alias("q_row"), F.col("id").alias("query_id"), F.col("_v").alias("a"))
    b = v.select(F.col("row").alias("c_row"), F.col("id").alias("vec_id"), F.col("_v").alias("b"))
    product = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)
    scored = pairs.join(b, "c_row").join(a, "q_row").select("query_id", "vec_id", product.alias("score"))
    heaps = scored.mapInArrow(lean(_merged(k)), SCHEMA)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = heaps.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _merged(k: int):
    """Per task: one heap of k for each query that the task meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list[tuple[float, int]]] = {}
        for b in batches:
            for q, v, s in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                heap = heaps.setdefault(q, [])
                if len(heap) < k:
                    heapq.heappush(heap, (s, -v))
                else:
                    heapq.heappushpop(heap, (s, -v))
            if len(heaps) > 100_000:
                yield _rows(heaps)
                heaps = {}
        if heaps:
            yield _rows(heaps)

    return run


def _rows(heaps: dict[int, list[tuple[float, int]]]) -> pa.RecordBatch:
    flat = [(q, -v, s) for q, heap in heaps.items() for s, v in heap]
    q, v, s = zip(*flat, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])


def op10_ann_block_join(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, F.col("vec_id") % 20 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
