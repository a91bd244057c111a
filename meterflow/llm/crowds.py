"""Connecting the members of groups by a test of pairs, without all pairs of a large group.

``connected`` gives edges that connect whatever the test links inside each group.  A group of up to ``limit`` rows is one
task.  A larger group is cut into slices, and each slice is joined by the group's pivots (members of least hashes).  Pivots
fall into classes by their own links, the same in every task; members that their slice connects with the largest of these
classes are connected with each other already.  The rest, few in a group of near copies, is held against all slices of
the group.  So a large group costs its rows times (1 + its rest / ``limit``), whatever its size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, written
from .words import lean

PIVOTS = 16

#: (table, borders of its tasks) -> pairs of row numbers that connect what is linked in each task: all rows of side 0 with
#: each other, those of side 1 with those of side 2.
Link = Callable[[pa.Table, np.ndarray], np.ndarray]


def sides(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of one task that meet: all with each other (one array, twice), or those of side 1 and those of side 2."""
    if side[0] == 0:
        every = np.arange(len(side))
        return every, every
    return np.flatnonzero(side == 1), np.flatnonzero(side == 2)


def whole_tasks(batches: Iterator[pa.RecordBatch], at_once: int = 1 << 25) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole tasks of a partition sorted by ``task`` (about ``at_once`` bytes, one task at least), with the tasks' borders."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.nbytes
        if size >= at_once:
            t = pa.Table.from_batches(held).combine_chunks()
            task = t["task"].to_numpy()
            last = int(np.searchsorted(task, task[-1]))
            if last:
                yield t.slice(0, last), _borders(task[:last])
            held = t.slice(last).to_batches()
            size = sum(x.nbytes for x in held)
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, _borders(t["task"].to_numpy())


def _borders(task: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(task[1:] != task[:-1]) + 1, [len(task)]])


def _roots(n: int, pairs: np.ndarray) -> np.ndarray:
    """The least row that each of n rows is connected with."""
    parent = list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for u, v in pairs.tolist():
        a, b = sorted((find(u), find(v)))
        parent[b] = a
    return np.array([find(i) for i in range(n)], np.int64)


def _rest(t: pa.Table, pairs: np.ndarray, link: Link) -> np.ndarray:
    """Rows of a slice (with its pivots) that it does not connect with the main class of pivots."""
    pivot = np.flatnonzero(t["pivot"].to_numpy(zero_copy_only=False))
    pivot = pivot[np.argsort(t["k"].to_numpy()[pivot], kind="stable")]
    among = _roots(len(pivot), link(t.take(pa.array(pivot)), np.array([0, len(pivot)])))
    main = pivot[np.bincount(among).argmax()]
    roots = _roots(t.num_rows, pairs)
    return np.flatnonzero(roots != roots[main])


_FOUND = "rest_k long, rest_g long"


def _run(tasks: DataFrame, payload: DataFrame, link: Link, node: str, kind: str) -> DataFrame:
    """Edges (u, v) between values of ``node`` (of type ``kind``) that ``link`` finds in the tasks (k, g, task, side, pivot), and
    the rest (rest_k, rest_g) of tasks with pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, borders in whole_tasks(batches):
            pairs = link(t, borders)
            ends = t[node].combine_chunks()
            if len(pairs):
                none = pa.nulls(len(pairs), pa.int64())
                yield pa.RecordBatch.from_arrays([*(ends.take(pa.array(pairs[:, i])) for i in (0, 1)), none, none], ["u", "v", "rest_k", "rest_g"])
            pivot = t["pivot"].to_numpy(zero_copy_only=False)
            task = np.searchsorted(borders, pairs[:, 0], side="right") - 1
            for i in np.unique(np.searchsorted(borders, np.flatnonzero(pivot), side="right") - 1).tolist():
                first, stop = int(borders[i]), int(borders[i + 1])
                rest = _rest(t.slice(first, stop - first).combine_chunks(), pairs[task == i] - first, link) + first
                if len(rest):
                    none = pa.nulls(len(rest), ends.type)
                    yield pa.RecordBatch.from_arrays([none, none, *(t[c].combine_chunks().take(pa.array(rest)) for c in ("k", "g"))], ["u", "v", "rest_k", "rest_g"])

    placed = tasks.join(payload, "k").repartition("task").sortWithinPartitions("task")
    return written(placed.mapInArrow(lean(run), f"u {kind}, v {kind}, {_FOUND}"), "crowd-edges")


def connected(members: DataFrame, payload: DataFrame, link: Link, node: str = "k", limit: int = 2000, heavy: int = 1_500_000) -> DataFrame:
    """Edges (u, v) of values of ``node`` that connect all links inside the groups of ``members`` (k, g and their weight; distinct
    rows of a table).  ``payload`` has what ``link`` needs for each k, and ``node`` itself.  Slices have about ``limit`` rows, and a
    weight of ``heavy``, at most."""
    kind = dict(payload.dtypes)[node]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cuts = F.greatest(F.ceil(F.count("*") / limit), F.ceil(F.sum("weight") / heavy)).cast("int")
    large = written(members.groupBy("g").agg(cuts.alias("cuts")).where("cuts > 1"), "large-groups")
    members = members.select("k", "g")
    alone = lambda df: df.withColumns({"task": F.xxhash64("g"), "side": F.lit(0), "pivot": F.lit(False)})
    if not large.limit(1).count():
        discard(large)
        return _run(alone(members), payload, link, node, kind).select("u", "v")
    crowd = written(members.join(large, "g").withColumn("slice", F.pmod(F.xxhash64("k"), F.col("cuts")).cast("int")), "crowd")
    pivots = crowd.groupBy("g", "cuts").agg(*(F.min_by("k", F.xxhash64("k", F.lit(i))).alias(f"p{i}") for i in range(PIVOTS)))
    pivots = pivots.select("g", "cuts", F.explode(F.array_distinct(F.array(*(f"p{i}" for i in range(PIVOTS))))).alias("k")).withColumn("slice", every("cuts"))
    sliced = crowd.withColumn("pivot", F.lit(False)).unionByName(pivots.withColumn("pivot", F.lit(True)))
    sliced = sliced.select("k", "g", F.xxhash64("g", "slice").alias("task"), F.lit(0).alias("side"), "pivot")
    found = _run(alone(members.join(large, "g", "left_anti")).unionByName(sliced), payload, link, node, kind)

    rest = written(found.where("rest_k IS NOT NULL").select(F.col("rest_k").alias("k"), F.col("rest_g").alias("g")).distinct(), "rest")
    parts = rest.groupBy("g").agg(F.ceil(F.count("*") / limit).cast("int").alias("parts"))
    left = rest.join(parts, "g").join(large, "g").withColumn("part", F.pmod(F.xxhash64("k", F.lit(3)), F.col("parts")).cast("int")).withColumn("slice", every("cuts"))
    right = crowd.join(parts, "g").withColumn("part", every("parts"))
    tasks = left.withColumn("side", F.lit(1)).unionByName(right.withColumn("side", F.lit(2))).select("k", "g", F.xxhash64("g", "part", "slice").alias("task"), "side", F.lit(False).alias("pivot"))
    edges = found.where("u IS NOT NULL").select("u", "v")
    return edges.unionByName(_run(tasks, payload, link, node, kind).select("u", "v")) if rest.limit(1).count() else edges
