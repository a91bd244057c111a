"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source gets a share of all words by its weight, capped at ``cap`` times its own words (the excess is shared
again by weight).  A source's documents fall into blocks by a seeded hash; its quota is a number of block draws:
whole passes over all blocks, then blocks in permuted order, then one boundary block of which only the documents
that fit are taken.  The quotas of all sources are split among output shards by a binary tree: each node draws its
left half from the multivariate hypergeometric law, so that shards have equal numbers of blocks and random
composition, exactly adding up to the quotas.  A shard takes the next disjoint range of each source's permuted
blocks and shuffles locally by a seeded hash.  All randomness comes from ``seed``: reruns agree.

The driver holds one row per source; tasks walk the tree from its root to the shards of their own draws, so that no table of
sources and shards exists.  Documents never pass through the driver.  Sources, blocks and picks go to all tasks if they are few,
which is counted; then a document's row moves once for each time that it is taken, to its shard, and not before.

Edge cases: null source is a source of its own, last in order; null and empty texts have size 0 and follow their
block; rows that repeat (equal id and text) are taken together; null ids are ordinary ids; an empty table gives an
empty mix; a source without words gets target 0; extra columns are carried by ``mixed``; columns whose names
begin with an underscore are reserved and replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import discard, written
from .words import lean

PARTS = 16
WEIGHTS = (5.0, 2.0, 1.0)
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of sources, of blocks and of picks that go to all tasks, at most (by estimate some 45 MB, with short names of sources).
MOST_SENT = 1 << 18


def _sent(rows: DataFrame, count: int) -> DataFrame:
    """The right side of a join: sent to all tasks if it has few rows, else joined as Spark sees fit."""
    return F.broadcast(rows) if count <= MOST_SENT else rows


def targets(sizes: list[int], weights: list[float], cap: float = 3.0) -> list[float]:
    """Shares of sum(sizes) by weight, none above cap * its size."""
    out, left, open_ = [0.0] * len(sizes), float(sum(sizes)), list(range(len(sizes)))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if unit * weights[i] > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in over:
            out[i] = float(cap * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(over)]
    return out


def _left(quotas: np.ndarray, lo: int, hi: int, seed: int) -> np.ndarray:
    """The draws of shards lo .. (lo + hi) // 2 among those of lo .. hi, by source."""
    rng = np.random.default_rng([seed, lo, hi])
    return rng.multivariate_hypergeometric(quotas, int(quotas.sum()) * ((lo + hi) // 2 - lo) // (hi - lo), method="marginals")


def shards_of(quotas: np.ndarray, shards: int, seed: int, source: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The shard of each draw, given by source number and index, by walking down the splitting tree."""
    out = np.zeros(len(index), dtype=np.int64)
    stack = [(0, shards, np.asarray(quotas, dtype=np.int64), np.arange(len(index)), np.asarray(index, dtype=np.int64))]
    while stack:
        lo, hi, q, rows, at = stack.pop()
        if hi - lo == 1 or not len(rows):
            out[rows] = lo
            continue
        mid, left = (lo + hi) // 2, _left(q, lo, hi, seed)
        first = at < left[source[rows]]
        stack += [(lo, mid, left, rows[first], at[first]), (mid, hi, q - left, rows[~first], (at - left[source[rows]])[~first])]
    return out


def splitting_tree(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """(shards, sources) block counts: rows have equal sums (to one), columns add up to the quotas."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)
    stack = [(0, shards, np.asarray(quotas, dtype=np.int64))]
    while stack:
        lo, hi, q = stack.pop()
        if hi - lo == 1:
            out[lo] = q
            continue
        mid, left = (lo + hi) // 2, _left(q, lo, hi, seed)
        stack += [(lo, mid, left), (mid, hi, q - left)]
    return out


def _keyed(docs: DataFrame, text: str, source: str, doc_id: str, seed: int) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns(
        {
            "_size": F.regexp_count(whole, F.lit(WORD)).cast("long"),
            "_u": F.xxhash64(F.lit(seed), F.col(doc_id).cast("string"), whole),
            "_source": F.col(source),
        }
    )


class Mix:
    """The plan of one mix: ``sources``, ``blocks`` (with the shards of their draws) and ``picks`` of boundary blocks."""

    def __init__(self, docs: DataFrame, weights=WEIGHTS, cap: int = 3, shard_words: int = 1 << 22, docs_per_block: int = 64, max_blocks: int = 1 << 16, seed: int = 17, text: str = "text", source: str = "source", doc_id: str = "doc_id"):
        spark = docs.sparkSession
        self.key = lambda d: _keyed(d, text, source, doc_id, seed)
        self.seed = seed
        sized = self.key(docs).select(F.col(doc_id).alias("doc_id"), "_source", "_size", "_u")
        self.sized = written(sized.withColumn("_row", F.monotonically_increasing_id()), "mix-sizes")
        found = self.sized.groupBy("_source").agg(F.sum("_size").alias("size"), F.count("*").alias("docs")).collect()
        found.sort(key=lambda r: (r[0] is None, r[0] or ""))  # str order is code point order
        sizes = [r["size"] for r in found]
        goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], cap)
        rows = []
        for r, t in zip(found, goal, strict=True):
            passes = min(int(t // r["size"]), cap) if r["size"] else 0
            blocks = max(1, min(max_blocks, r["docs"] // docs_per_block))
            rows.append((r["_source"], r["size"], t, passes, t - passes * r["size"], blocks, len(rows)))
        kind = "_source string, _source_size long, _target double, _passes int, _rest double, _n_blocks long, _no int"
        self.sources = _sent(spark.createDataFrame(rows, kind), len(rows))
        keyed = self.blocked(self.sized)

        order = Window.partitionBy("_source").orderBy(F.xxhash64(F.lit(seed), "_block"), "_block")
        totals = keyed.groupBy("_source", "_block").agg(F.sum("_size").alias("words"), F.first("_passes").alias("_passes"), F.first("_rest").alias("_rest"), F.first("_n_blocks").alias("_n_blocks"), F.first("_no").alias("_no"))
        ranked = totals.withColumns({"rank": F.row_number().over(order) - 1, "present": F.count("*").over(Window.partitionBy("_source")), "upto": F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0))})
        before = F.col("upto") - F.col("words")
        more = (F.col("_passes") < cap) & (F.col("_rest") > 0)
        ranked = ranked.withColumns({"whole": more & (F.col("upto") <= F.col("_rest")), "edge": more & (F.col("upto") > F.col("_rest")) & (before < F.col("_rest")), "before": before})
        # permuted draws: pass p covers indices p * n_blocks + rank, the last pass only a prefix of the permutation
        ranked = ranked.withColumn("draws", F.col("_passes") + (F.col("whole") | F.col("edge")).cast("int"))
        ranked = written(ranked.drop("_rest"), "mix-blocks")
        quotas = np.zeros(len(rows), dtype=np.int64)
        for r in ranked.groupBy("_no").agg(F.sum("draws").alias("n")).collect():
            quotas[r["_no"]] = r["n"]
        shards = max(1, -(-int(sum(goal)) // shard_words))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                draws, present, rank, no = (b.column(c).to_numpy().astype(np.int64) for c in ("draws", "present", "rank", "_no"))
                block = np.repeat(np.arange(len(draws)), draws)
                place = np.arange(len(block)) - np.repeat(np.cumsum(draws) - draws, draws)
                found = shards_of(quotas, shards, seed, no[block], place * present[block] + rank[block])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(draws)]).astype(np.int32)), pa.array(found.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("_source", "_block", "edge", "before")), lists], ["_bs", "_bb", "edge", "before", "_shards"])

        self.blocks = written(ranked.mapInArrow(lean(deal), "_bs string, _bb long, edge boolean, before long, _shards array<int>"), "mix-draws")
        discard(ranked)
        self.n_blocks = self.blocks.count()
        edges = _sent(self.blocks.where("edge").select("_bs", "_bb", "before"), len(rows))  # one for a source, at most
        at_edge = keyed.join(edges, F.col("_source").eqNullSafe(F.col("_bs")) & (F.col("_block") == F.col("_bb")))
        at_edge = at_edge.withColumn("room", F.col("_rest") - F.col("before")).select("_source", "_u", "_size", "room")
        self.picks = written(at_edge.groupBy("_source").applyInArrow(_fill, "_ks string, _ku long"), "mix-picks")
        self.n_picks = self.picks.count()

    def blocked(self, keyed: DataFrame) -> DataFrame:
        """Rows with their source's figures and their block."""
        s = self.sources.withColumnRenamed("_source", "_ss")
        out = keyed.join(s, F.col("_source").eqNullSafe(F.col("_ss"))).drop("_ss")
        return out.withColumn("_block", F.pmod(F.col("_u"), F.col("_n_blocks")))

    def placed(self, keyed: DataFrame) -> DataFrame:
        """Rows with ``_copies``: the shard of each time that the mix takes them."""
        blocks, picks = _sent(self.blocks, self.n_blocks), _sent(self.picks, self.n_picks)
        out = self.blocked(keyed).join(blocks, F.col("_source").eqNullSafe(F.col("_bs")) & (F.col("_block") == F.col("_bb")))
        out = out.join(picks, F.col("_source").eqNullSafe(F.col("_ks")) & (F.col("_u") == F.col("_ku")), "left")
        last = F.col("edge") & F.col("_ku").isNull()
        return out.withColumn("_copies", F.when(last, F.slice("_shards", 1, F.size("_shards") - 1)).otherwise(F.col("_shards")))

    def dealt(self, placed: DataFrame) -> DataFrame:
        """One row for each time that the mix takes a row: _pass, _shard and _part (one of ``PARTS`` pieces of a shard)."""
        rows = placed.select("*", F.posexplode("_copies").alias("_pass", "_shard"))
        return rows.drop("_copies").withColumn("_part", F.pmod("_u", F.lit(PARTS)))

    def order(self) -> list[Column]:
        """The shuffled order inside a piece of a shard."""
        return [F.xxhash64("_u", "_pass", F.lit(self.seed)), F.col("_u"), F.col("_pass")]


def _fill(block: pa.Table) -> pa.Table:
    """The documents of a boundary block that fit into what is left, in permuted order; one more if that is nearer."""
    sizes: dict[int, int] = {}
    for u, size in zip(block["_u"].to_pylist(), block["_size"].to_pylist(), strict=True):
        sizes[u] = sizes.get(u, 0) + size
    room, taken, spare = block["room"][0].as_py(), [], []
    for u in sorted(sizes):
        if sizes[u] <= room:
            taken.append(u)
            room -= sizes[u]
        else:
            spare.append((sizes[u], u))
    if spare and min(spare)[0] < 2 * room:
        taken.append(min(spare)[1])
    return pa.table({"_ks": pa.array([block["_source"][0].as_py()] * len(taken), pa.string()), "_ku": pa.array(taken, pa.int64())})


def mixed(docs: DataFrame, seed: int = 17, **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, one row per time that a document is taken, dealt to shards and shuffled in each."""
    columns = docs.columns
    mix = Mix(docs, seed=seed, **options)
    rows = mix.dealt(mix.placed(mix.key(docs))).select(*columns, "_u", "_pass", "_shard", "_part")
    return rows.repartition("_shard", "_part").sortWithinPartitions("_shard", "_part", *mix.order()).select(*columns)


def op5_mix_sources(spark, sf_dir: str) -> DataFrame:
    """The mix by document: how many of its words are taken, and the shard and the place in a piece of it of each copy."""
    mix = Mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    placed = mix.placed(mix.sized)
    own = [F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target")]
    place = F.row_number().over(Window.partitionBy("_shard", "_part").orderBy(*mix.order(), "_row"))
    copies = mix.dealt(placed).withColumn("_place", place)
    taken = copies.groupBy("_row").agg(
        *(F.first(c).alias(c) for c in ("doc_id", "_size", "_source_size", "_target")),
        F.sum("_size").alias("taken"),
        F.sort_array(F.collect_list(F.struct("_pass", "_shard", "_part", "_place"))).alias("_at"),
    )
    taken = taken.select("doc_id", *own, "taken", F.col("_at._shard").alias("shards"), F.col("_at._part").alias("parts"), F.col("_at._place").alias("places"))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    rest = placed.where(F.size("_copies") == 0).select("doc_id", *own, F.lit(0).cast("long").alias("taken"), none("int").alias("shards"), none("bigint").alias("parts"), none("int").alias("places"))
    return taken.unionByName(rest)
