"""Connected components of an edge table; nodes may be of any orderable type.

Each partition reduces its edges to a forest.  Up to ``_AT_ONCE`` edges of all forests (they are counted) are ended by one
task; more go through alternating large and small stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .storage import discard, written
from .words import lean

_AT_ONCE = 1 << 18


def _linked(parts: list[pa.RecordBatch]) -> tuple[pa.Array, np.ndarray]:
    """The nodes of some edges, in their order, and the place of the least node that they connect each with."""
    t = pa.Table.from_batches(parts)
    nodes = pa.concat_arrays([c for x in ("u", "v") for c in t[x].chunks]).unique()
    nodes = nodes.take(pc.sort_indices(nodes))
    place = {x: i for i, x in enumerate(nodes.to_pylist())}
    parent = list(range(len(nodes)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for u, v in zip(t["u"].to_pylist(), t["v"].to_pylist(), strict=True):
        a, b = sorted((find(place[u]), find(place[v])))
        parent[b] = a
    return nodes, np.array([find(i) for i in range(len(nodes))])


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a partition, ``_AT_ONCE`` at a time, as edges from each node to the least node that they connect it with."""

    def edges(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        nodes, root = _linked(parts)
        child = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([nodes.take(pa.array(child)), nodes.take(pa.array(root[child]))], ["u", "v"])

    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= _AT_ONCE:
            yield edges(held)
            held, n = [], 0
    if held:
        yield edges(held)


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges of a small table, as each node with its root."""
    held = [b for b in batches if b.num_rows]
    if held:
        nodes, root = _linked(held)
        yield pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(root))], ["node", "root"])


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Pairs (u, v): every kept neighbour of u is linked to u's least neighbour."""
    least = pairs.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
    least = least.select("c", F.least("c", "m").alias("m"))
    linked = pairs.join(least, F.col("u") == F.col("c"))
    if large:
        return linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.where(F.col("c") != F.col("m")).select(F.col("c").alias("u"), F.col("m").alias("v"))
    return linked.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(own)


def components(edges: DataFrame, max_rounds: int = 60, alone: int = _AT_ONCE) -> DataFrame:
    """(node, root) of every node of ``edges`` (columns u, v); root is the least node of its component.

    Null ends and loops are ignored.  Up to ``alone`` edges are left to one task.  Beyond, the rounds are logarithmic in the
    longest path; each is written to the shared folder, so that no lineage grows.  Only a few counts reach the driver.
    """
    e = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select("u", "v")
    kind = e.schema.simpleString()[7:-1].replace(":", " ")
    now, state = _kept(e.mapInArrow(lean(_forest), kind))
    if state[0] <= alone:
        node = dict(e.dtypes)["u"]
        out = written(now.coalesce(1).mapInArrow(lean(_ended), f"node {node}, root {node}"), "components")
        discard(now)
        return out
    for _ in range(max_rounds if state[0] else 0):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        new, moved = _kept(_star(_star(both, large=True).where("u <> v"), large=False).distinct())
        discard(now)
        now, state, before = new, moved, state
        if state == before:
            break
    else:
        if state[0]:
            raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def named_sets(firsts: DataFrame, groups: DataFrame) -> DataFrame:
    """(key, root, component_id) of every set of ``firsts`` (key and its ``least`` id); sets out of ``groups`` (node, root) stand alone."""
    linked = written(firsts.select("key", "least").join(groups.withColumnRenamed("node", "key"), "key"), "linked-sets", last=True)
    roots = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.select("key", "root").join(roots, "root")
    named = firsts.select("key", "least").join(named, "key", "left")
    named = named.select("key", F.coalesce("root", "key").alias("root"), F.coalesce("component_id", "least").alias("component_id"))
    return written(named, "named-sets", last=True)


def _kept(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """Edges in a written table, and what tells one set of edges from another: their number and two sums of hashes."""
    seen = Observation()
    sums = [F.sum(F.xxhash64("u", "v", F.lit(k)).cast("decimal(38,0)")).alias(f"h{k}") for k in (1, 2)]
    out = written(edges.observe(seen, F.count("*").alias("n"), *sums), "edges")
    return out, (seen.get["n"], seen.get["h1"], seen.get["h2"])
