"""Embedding whitening from a compensated covariance.

*Fit list.*  Each entry c becomes the integer x = floor(SCALE * c) + SHIFT; the fit list holds each distinct x vector once.
Their number and per-dimension sums are exact (decimals), so the mean S / n is known to double-double precision.

*Covariance.*  Vectors are centred first; the outer products of the centred vectors are accumulated as double-doubles with
error-free transformations (two-sum, and Dekker's two-product), some hundred rows at a time as a tree.  Every task sends the
high and low parts of its sums, and tasks merge in two levels, in a fixed order, high and low parts together.

*Eigen-solve.*  The merged matrix, rounded once, is a symmetric d x d matrix in one task for each vector length; LAPACK's
``syevd`` (numpy's ``eigh``) brings it to tridiagonal form and solves that by divide and conquer.  The largest entry of each
component is made positive.  Components whose eigenvalue is at most ``FLAT`` of the largest have no spread to scale by and
are left out.

Edge cases: vectors that are null, or hold a null, NaN or infinite entry, are dropped; empty vectors have no components and so
no rows; vectors of different lengths are fits of their own; with one distinct vector, or equal entries throughout,
there is no spread and no component; repeated rows and null ids each get their rows; fewer dimensions than ``components``
give as many components as there are; a deviation beyond a long is null; scaled entries beyond 2^56 count as that (up to 2^53
they are exact); extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import discard, written
from .words import lean

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Eigenvalues at most this share of the largest are rounding.
FLAT = 1e-13
_SPLIT = 134217729.0  # 2^27 + 1
#: Doubles of products that a task handles at a time.
_AT_ONCE = 1 << 19
#: Parts that merge at the first level; the second has the number of tasks / TOGETHER.
TOGETHER = 256
_PARTS = "dims int, part long, n long, hi binary, lo binary"

Pair = tuple[np.ndarray, np.ndarray]


def two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    """a + b and its exact rounding error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def two_product(a: np.ndarray, b: np.ndarray) -> Pair:
    """a * b and its exact rounding error (below 2^996)."""
    p = a * b
    u, v = a * _SPLIT, b * _SPLIT
    ah, bh = u - (u - a), v - (v - b)
    al, bl = a - ah, b - bh
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def added(x: Pair, y: Pair) -> Pair:
    """Sum of double-doubles."""
    s, e = two_sum(x[0], y[0])
    t, f = two_sum(x[1], y[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def total(x: Pair) -> Pair:
    """Sum of double-doubles over the first axis, as a tree."""
    hi, lo = x
    while len(hi) > 1:
        half = len(hi) // 2
        rest = (hi[2 * half :], lo[2 * half :])
        a, b = added((hi[:half], lo[:half]), (hi[half : 2 * half], lo[half : 2 * half]))
        hi, lo = np.concatenate([a, rest[0]]), np.concatenate([b, rest[1]])
    return hi[0], lo[0]


def products(hi: np.ndarray, lo: np.ndarray) -> Pair:
    """Sums over rows of the products of every two entries i <= j of double-double rows."""
    i, j = np.triu_indices(hi.shape[1])
    step = max(1, _AT_ONCE // max(1, len(i)))
    out = (np.zeros(len(i)), np.zeros(len(i)))
    for k in range(0, len(hi), step):
        a, b, al, bl = hi[k : k + step, i], hi[k : k + step, j], lo[k : k + step, i], lo[k : k + step, j]
        p, e = two_product(a, b)
        out = added(out, total(two_sum(p, e + (a * bl + al * b))))
    return out


def double_double(x: Fraction) -> tuple[float, float]:
    hi = float(x)
    return hi, float(x - Fraction(hi))


def square(upper: np.ndarray) -> np.ndarray:
    """The symmetric matrix of its upper triangle."""
    d = int((2 * len(upper)) ** 0.5)
    out = np.zeros((d, d))
    out[np.triu_indices(d)] = upper
    return out + np.triu(out, 1).T


def _rows(column: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def _by_length(b: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = b.column("dims").to_numpy()
    for d in np.unique(dims).tolist():
        yield d, b.filter(pa.array(dims == d))


def _merge(key: tuple, group: pa.Table) -> pa.Table:
    """Sums of parts, in the order of the parts' numbers."""
    group = group.sort_by("part")
    hi, lo = (np.stack([np.frombuffer(x) for x in group[c].to_pylist()]) for c in ("hi", "lo"))
    hi, lo = total((hi, lo))
    first = [pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py() if len(key) > 1 else 0], pa.int64()), pa.array([sum(group["n"].to_pylist())], pa.int64())]
    return pa.Table.from_arrays([*first, pa.array([hi.tobytes()], pa.binary()), pa.array([lo.tobytes()], pa.binary())], names=["dims", "part", "n", "hi", "lo"])


def _merged(parts: DataFrame) -> DataFrame:
    """One row for each length: ``TOGETHER`` parts meet at a time, then what they gave."""
    near = parts.groupBy("dims", F.floor(F.col("part") / TOGETHER).alias("block")).applyInArrow(_merge, _PARTS)
    return near.groupBy("dims").applyInArrow(_merge, _PARTS)


def compensated(rows: DataFrame, centred) -> DataFrame:
    """dims, n and the sums (hi, lo) of outer products of all vectors; ``centred(d, part)`` gives the rows of a record batch
    of vectors of length d as double-doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, Pair]] = {}
        for batch in batches:
            for d, part in _by_length(batch):
                sums = products(*centred(d, part))
                n, before = held.get(d, (0, None))
                held[d] = (n + part.num_rows, added(before, sums) if before else sums)
        number = TaskContext.get().partitionId()
        for d, (n, (hi, lo)) in held.items():
            values = [pa.array([d], pa.int32()), pa.array([number], pa.int64()), pa.array([n], pa.int64()), pa.array([hi.tobytes()], pa.binary()), pa.array([lo.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(values, ["dims", "part", "n", "hi", "lo"])

    return _merged(rows.mapInArrow(lean(run), _PARTS))


def _finite(v: Column) -> Column:
    return v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def _solve(components: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        r = group.to_pylist()[0]
        cov = square((np.frombuffer(r["hi"]) + np.frombuffer(r["lo"])) / r["n"])
        values, vectors = np.linalg.eigh(cov)
        order = np.arange(len(values))[::-1][:components]
        order = order[values[order] > FLAT * max(values[-1], 0)] if values[-1] > 0 else order[:0]
        v = vectors[:, order].T
        v = v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(axis=1)])[:, None] if len(v) else v
        out = {"dims": key[0].as_py(), "n": r["n"], "values": values[order].tolist(), "vectors": v.ravel().tolist(), "trace": float(np.trace(cov))}
        kinds = [("dims", pa.int32()), ("n", pa.int64()), ("values", pa.list_(pa.float64())), ("vectors", pa.list_(pa.float64())), ("trace", pa.float64())]
        return pa.Table.from_pylist([out], pa.schema(kinds))

    return run


def _means(sums: DataFrame) -> DataFrame:
    """The exact sums of each length with the means as double-doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            means = [[dict(zip(("hi", "lo"), double_double(Fraction(int(s), n)), strict=True)) for s in row] for n, row in zip(b.column("n").to_pylist(), b.column("sums").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(means, pa.list_(pa.struct([("hi", pa.float64()), ("lo", pa.float64())])))], [*b.schema.names, "means"])

    return sums.mapInArrow(run, "dims int, n long, sums array<decimal(38,0)>, means array<struct<hi:double,lo:double>>")


def _centre(x: np.ndarray, mean: dict[str, np.ndarray]) -> Pair:
    """Integer rows less the mean."""
    return added((x.astype(np.float64), np.zeros(x.shape)), (np.broadcast_to(-mean["hi"], x.shape), np.broadcast_to(-mean["lo"], x.shape)))


def _model_rows(rows: list[dict]) -> dict[int, dict]:
    """Models by length, as arrays."""
    out = {}
    for r in rows:
        mean = {k: np.array([m[k] for m in r["means"]]) for k in ("hi", "lo")}
        out[r["dims"]] = {"n": r["n"], "mean": mean, "sums": [int(s) for s in r["sums"]], "vectors": np.array(r.get("vectors", [])).reshape(-1, r["dims"]), "values": np.array(r.get("values", []))}
    return out


def projected(x: np.ndarray, model: dict) -> np.ndarray:
    """Rows whitened: centred, projected on each component and scaled by its spread."""
    a = _centre(x, model["mean"])
    return ((a[0] + a[1]) @ model["vectors"].T) / np.sqrt(model["values"])


def deviations(x: np.ndarray, model: dict) -> list[int | None]:
    """The exact sum over dimensions of (n * x - S)^2; null beyond a long."""
    n, sums = model["n"], model["sums"]
    exact = lambda row: sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True))
    fits = lambda e: e if e < 1 << 63 else None
    if n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0) >= 1 << 62:
        return [fits(exact(row)) for row in x.tolist()]
    d = n * x - np.array(sums, np.int64)
    rough = (d.astype(np.float64) ** 2).sum(axis=1)
    small = rough < 2.0**62
    d[~small] = 0
    out = (d * d).sum(axis=1).tolist()
    for i in np.flatnonzero(~small).tolist():
        out[i] = fits(exact(x[i].tolist())) if rough[i] < 2.0**64 else None
    return out


#: Bound on the sum of all vector lengths, of which models have some 20 doubles each.
MOST_DIMS = 100_000
#: Entries count as at most so much after scaling.
LARGEST = float(1 << 56)


def whitened(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``vec_id, n, deviation, whitened (array), explained (array), identity_error`` of every row with a finite vector.

    Models (a d x ``components`` matrix for each vector length, of ``MOST_DIMS`` dimensions together, which is checked) go to
    the tasks with their code."""
    v = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where(_finite(F.col("v")) & (F.size("v") > 0))
    x = F.transform("v", lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(LARGEST)), F.lit(-LARGEST))) + SHIFT)
    rows = v.select("vec_id", F.size("v").alias("dims"), x.alias("x"))
    fit = written(rows.select("dims", "x").distinct(), "fit-list")
    entry = F.posexplode("x").alias("i", "e")
    one = fit.select("dims", entry).groupBy("dims", "i").agg(F.sum(F.col("e").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"))
    sums = one.groupBy("dims").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda t: t["s"]).alias("sums"))
    means = written(_means(sums), "means")
    if (means.agg(F.sum("dims")).first()[0] or 0) > MOST_DIMS:
        raise ValueError(f"the vector lengths add up to more than {MOST_DIMS}")
    first = _model_rows([r.asDict(recursive=True) for r in means.collect()])
    covariance = compensated(fit, lambda d, b: _centre(_rows(b.column("x"), np.int64), first[d]["mean"]))
    solved = covariance.groupBy("dims").applyInArrow(_solve(components), "dims int, n long, values array<double>, vectors array<double>, trace double")
    solved = written(solved.join(means.select("dims", "sums", "means"), "dims"), "whitening")
    found = solved.collect()
    models, trace = _model_rows([r.asDict(recursive=True) for r in found]), {r["dims"]: r["trace"] for r in found}

    # the covariance of the whitened fit list, centred by its own mean, tells how far it is from the identity
    def sum_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, b in _by_length(batch):
                y = projected(_rows(b.column("x"), np.int64), models[d])
                hi, lo = total((y, np.zeros_like(y)))
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([b.num_rows], pa.int64()), pa.array([(hi + lo).tolist()], pa.list_(pa.float64()))], ["dims", "n", "s"])

    each = fit.mapInArrow(lean(sum_rows), "dims int, n long, s array<double>").select("dims", F.posexplode("s").alias("i", "s"))
    centre: dict[int, np.ndarray] = {d: np.zeros(len(m["values"])) for d, m in models.items()}
    for r in each.groupBy("dims", "i").agg(F.sum("s").alias("s")).collect():
        centre[r["dims"]][r["i"]] = r["s"] / models[r["dims"]]["n"]

    def recentred(d: int, b: pa.RecordBatch) -> Pair:
        y = projected(_rows(b.column("x"), np.int64), models[d])
        return two_sum(y, np.broadcast_to(-centre[d], y.shape))

    error = {}
    for r in compensated(fit, recentred).collect():
        cov = square((np.frombuffer(r["hi"]) + np.frombuffer(r["lo"])) / r["n"])
        error[r["dims"]] = float(np.abs(cov - np.eye(len(cov))).max(initial=0))
    for table in (fit, means, solved):
        discard(table)

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, b in _by_length(batch):
                m, ints = models[d], _rows(b.column("x"), np.int64)
                share = (m["values"] / trace[d]).tolist()
                columns = [
                    b.column("vec_id"), pa.array([m["n"]] * len(ints), pa.int64()), pa.array(deviations(ints, m), pa.int64()), pa.array(projected(ints, m).tolist(), pa.list_(pa.float64())),
                    pa.array([share] * len(ints), pa.list_(pa.float64())), pa.array([error[d]] * len(ints), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(lean(whiten), f"vec_id {kind}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double")


def by_component(rows: DataFrame) -> DataFrame:
    """A row for each vector and component, components numbered from 1."""
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "p")
    return rows.select("vec_id", "n", "deviation", "identity_error", each).select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("p.whitened").alias("whitened"), F.col("p.explained").alias("explained"), "identity_error")


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    return by_component(whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
