"""Substring dedup: words of every window of ``window`` words that starts elsewhere too are removed.

Pass 1 sketches the corpus.  Each window is represented by its least ``GRAM``-word hash (its anchor); equal windows
have equal anchors at different positions, so the merged count-min sketch over anchor positions overestimates the
count of every window.  Pass 2 looks only at windows whose anchor is estimated repeated: neighbouring windows with one
anchor travel as one run, copies of a run are aggregated in the task, and runs meet by anchor, where windows are
grouped exactly by anchor and window hash (128 bits together).  The windows of an anchor with very many runs meet one by
one instead, by Spark's aggregation, so that no task holds all runs of a common passage.  The verdict comes back per run signature as a bit mask
and is joined to the documents' runs.  No window is lost, none is judged by the estimate.

Edge cases: null and empty texts have no words and the hash of the empty string; texts shorter than a window lose
nothing; equal texts, also rows repeated with one id, are copies of each other; a window repeated inside one document
counts; nulls in other columns, null ids and extra columns are carried through (clashing result columns are replaced;
names that begin with an underscore are reserved); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sketch import packed, repeated, repeated_maps, unpacked, width
from .storage import discard, small_batches, text_bytes, written
from .words import Words, lean, pair, slices, string_parts, words_of

WINDOW = 35
GRAM = 18
#: Bytes of text for each anchor, at least: what the sketch is sized by.
ANCHOR_BYTES = 48
_U = np.uint64


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive items, by doubling; length len(h) - k + 1 (or empty)."""
    if len(h) < k:
        return np.zeros(0, dtype=_U)
    with np.errstate(over="ignore"):
        x, size = h, 1
        while size * 2 <= k:
            x = pair(x[:-size], x[size:], size)
            size *= 2
        if size < k:
            x = pair(x[: len(x) - (k - size)], x[k - size :], k)
    return x


def _sliding(x: np.ndarray, k: int, best) -> np.ndarray:
    size = 1
    while size * 2 <= k:
        x = best(x[:-size], x[size:])
        size *= 2
    return best(x[: len(x) - (k - size)], x[k - size :]) if size < k else x


class Runs:
    """Windows of consecutive texts, joined into runs of one anchor each."""

    def __init__(self, w: Words, window: int = WINDOW, gram: int = GRAM):
        self.window = window
        n, width = len(w.start), window - gram + 1
        empty = np.zeros(0, dtype=np.int64)
        self.anchors = np.zeros(0, dtype=_U)
        self.first = self.last = self.at = empty
        if n < window:
            return
        ends = np.repeat(w.at[1:], w.counts)
        starts = np.arange(n - window + 1)
        valid = starts + window <= ends[: len(starts)]
        if not valid.any():
            return
        self.h = w.hash(0)
        g = rolled(self.h, gram) | _U(1)
        least = _sliding(g, width, np.minimum)[: len(starts)]
        least = np.where(valid, least, _U(0))
        most = _sliding(np.concatenate([np.zeros(width - 1, _U), least, np.zeros(width - 1, _U)]), width, np.maximum)
        place = np.flatnonzero(g == most[: len(g)])
        self.anchors = g[place]
        s = np.flatnonzero(valid)
        k = np.searchsorted(place, s)
        wrong = np.flatnonzero(g[place[k]] != least[s])
        while len(wrong):
            k[wrong] += 1
            wrong = wrong[g[place[k[wrong]]] != least[s[wrong]]]
        new = np.ones(len(s), dtype=bool)
        new[1:] = k[1:] != k[:-1]
        head = np.flatnonzero(new)
        self.first, self.last = s[head], s[np.append(head[1:], len(s)) - 1]
        self.key = g[place[k[head]]]

    def flagged(self, maps: np.ndarray, bits: int) -> None:
        """Keep only runs whose anchor is estimated repeated."""
        if len(self.first):
            keep = repeated(maps, self.key, bits)
            self.first, self.last, self.key = self.first[keep], self.last[keep], self.key[keep]

    def sign(self, w: Words) -> None:
        """Window hashes of the second family, and two signatures of each run's whole span."""
        self.w0, self.w1 = rolled(self.h, self.window), rolled(w.hash(1), self.window)
        with np.errstate(over="ignore"):
            self.a = pair(self.w0[self.first], self.w0[self.last], 91)
            self.b = pair(self.w1[self.first], self.w1[self.last], 92)


def _text_keys(w: Words, h0: np.ndarray, h1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two keys of each text's word sequence."""
    with np.errstate(over="ignore"):
        place = np.arange(len(h0)) - np.repeat(w.at[:-1], w.counts)
        out = []
        for h, salt in ((h0, 5), (h1, 6)):
            total = np.concatenate([np.zeros(1, _U), np.cumsum(pair(h, place.astype(_U), salt))])
            out.append(total[w.at[1:]] - total[w.at[:-1]])
    return out[0], out[1]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


_RUNS = "key long, a long, b long, weight int, hashes binary"
_DOCS = "doc int, n_words long, ka long, kb long, a array<long>, b array<long>, at array<int>"


def _runs_of(batch: pa.RecordBatch, text: str, window: int, gram: int):
    for part, data, offsets in slices(batch, text, 1 << 20):
        w = words_of(data, offsets)
        yield part, w, Runs(w, window, gram)


def _emit_runs(text: str, shared, window: int, gram: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = unpacked(shared.value)
        for batch in batches:
            found = []
            for _, w, r in _runs_of(batch, text, window, gram):
                r.flagged(maps, bits)
                if len(r.first):
                    r.sign(w)
                    size = r.last - r.first + 1
                    ends = np.cumsum(size)
                    inner = np.arange(ends[-1]) - np.repeat(ends - size, size) + np.repeat(r.first, size)
                    found.append((r.key, r.a, r.b, size, r.w1[inner]))
            if not found:
                continue
            key, a, b, size, hashes = (np.concatenate(x) for x in zip(*found, strict=True))
            ends = np.cumsum(size)
            order = np.lexsort((b, a))
            new = np.ones(len(order), dtype=bool)
            new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
            head = np.flatnonzero(new)
            weight = np.minimum(np.diff(np.append(head, len(order))), 2).astype(np.int32)
            pick = order[head]
            raw = hashes.tobytes()
            lists = [raw[8 * (e - n) : 8 * e] for e, n in zip(ends[pick].tolist(), size[pick].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([_signed(key[pick]), _signed(a[pick]), _signed(b[pick]), pa.array(weight), pa.array(lists, pa.binary())], ["key", "a", "b", "weight", "hashes"])

    return run


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs sorted by anchor: the mask of each run's windows that occur twice or more among the runs of its anchor."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy()
        cut = int(np.flatnonzero(np.append(True, key[1:] != key[:-1]))[-1])
        if held and held[-1].column("key")[0].as_py() != key[0]:
            yield from _judged(held)
            held = []
        if cut:
            yield from _judged([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield from _judged(held)


def _judged(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t = pa.Table.from_batches(parts).combine_chunks()
    key, a, b, weight = (t[c].to_numpy() for c in ("key", "a", "b", "weight"))
    lists = t["hashes"].combine_chunks() if isinstance(t["hashes"], pa.ChunkedArray) else t["hashes"]
    data, offsets = string_parts(lists)
    size = np.diff(offsets) // 8
    hashes = np.frombuffer(data[offsets[0] : offsets[-1]].tobytes(), np.uint64)
    run = np.repeat(np.arange(len(key)), size)
    order = np.lexsort((hashes, key[run]))
    k, h = key[run][order], hashes[order]
    twin = np.zeros(len(order) + 1, dtype=bool)
    twin[1:-1] = (k[1:] == k[:-1]) & (h[1:] == h[:-1])
    again = np.zeros(len(order), dtype=bool)
    again[order] = twin[1:] | twin[:-1]
    again |= weight[run] > 1
    start = np.concatenate([[0], np.cumsum(size)])[:-1]
    bit = np.arange(len(run)) - start[run]
    mask = np.bitwise_or.reduceat(again.astype(np.int64) << bit, start)
    order = np.lexsort((b, a))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    pick = order[new]
    pick = pick[mask[pick] != 0]
    if len(pick):
        yield pa.RecordBatch.from_arrays([pa.array(a[pick]), pa.array(b[pick]), pa.array(mask[pick])], ["a", "b", "mask"])


def _windows(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the windows of a batch of runs, the run of each and its place there."""
    data, offsets = string_parts(b.column("hashes"))
    size = np.diff(offsets) // 8
    run = np.repeat(np.arange(b.num_rows), size)
    return np.frombuffer(data[offsets[0] : offsets[-1]].tobytes(), np.int64), run, np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)


def _count_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        w, run, _ = _windows(b)
        key, n = b.column("key").to_numpy()[run], b.column("weight").to_numpy()[run].astype(np.int64)
        order = np.lexsort((w, key))
        key, w = key[order], w[order]
        head = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (w[1:] != w[:-1]))[: len(w)])
        if len(head):
            yield pa.RecordBatch.from_arrays([pa.array(key[head]), pa.array(w[head]), pa.array(np.add.reduceat(n[order], head))], ["key", "w", "n"])


def _spread_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        w, run, bit = _windows(b)
        key, a, c = (b.column(x).to_numpy()[run] for x in ("key", "a", "b"))
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(w), pa.array(a), pa.array(c), pa.array(np.int64(1) << bit)], ["key", "w", "a", "b", "bit"])


#: Rows of keys that go to all tasks, at most (some 3 MB).
MOST_SENT = 100_000


def _sent(keys: DataFrame) -> DataFrame:
    """Keys of a table for a join: sent to all tasks if they are few, else joined by a shuffle, which Spark can split where a key is hot."""
    return F.broadcast(keys) if keys.limit(MOST_SENT + 1).count() <= MOST_SENT else keys


def _masks(runs: DataFrame, hot_runs: int) -> DataFrame:
    """Masks of repeated windows by run; runs of anchors with over ``hot_runs`` of them are judged window by window."""
    hot = written(runs.groupBy("key").count().where(F.col("count") > hot_runs).select("key"), "hot-anchors")
    if not hot.limit(1).count():
        hot = None
    cold = runs if hot is None else runs.join(_sent(hot), "key", "left_anti")
    masks = cold.repartition("key").sortWithinPartitions("key").mapInArrow(lean(_judge), "a long, b long, mask long")
    if hot is not None:
        crowd = runs.join(_sent(hot), "key", "left_semi")
        again = crowd.mapInArrow(lean(_count_windows), "key long, w long, n long").groupBy("key", "w").agg(F.sum("n").alias("n")).where("n > 1")
        again = written(again, "repeated-windows")
        # windows of very many runs are few; the others make no large group
        common, other = again.where(F.col("n") > hot_runs).select("key", "w"), again.where(F.col("n") <= hot_runs).select("key", "w")
        each = crowd.mapInArrow(lean(_spread_windows), "key long, w long, a long, b long, bit long")
        found = each.join(_sent(common), ["key", "w"]).unionByName(each.join(other, ["key", "w"]))
        masks = masks.unionByName(found.groupBy("a", "b").agg(F.bit_or("bit").alias("mask")))
    return written(masks, "window-masks")


def dedup(docs: DataFrame, text: str = "text", window: int = WINDOW, gram: int = GRAM, bits: int | None = None, hot_runs: int = 2000) -> DataFrame:
    """``docs`` with n_words, n_removed and ``kept`` (the kept words joined by one space; the text's words where none went)."""
    if not 1 <= gram <= window or window - gram >= 62:
        raise ValueError("gram must be at most window, and window - gram below 62")
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(text).cast("string").alias("t"))

    def anchors(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, r in _runs_of(batch, "t", window, gram):
            yield r.anchors

    bits = bits or width(text_bytes(texts, "t") / ANCHOR_BYTES)
    shared = spark.sparkContext.broadcast(packed(repeated_maps(texts, anchors, bits)))
    runs = written(texts.mapInArrow(lean(_emit_runs("t", shared, window, gram, bits)), _RUNS), "runs")
    masks = _masks(runs, hot_runs)
    discard(runs)

    carried = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept")]
    whole = docs.select(*carried).withColumn("_t", F.col(text).cast("string"))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = unpacked(shared.value)
        for batch in batches:
            for part, w, r in _runs_of(batch, "_t", window, gram):
                n = part.num_rows
                r.flagged(maps, bits)
                at = np.zeros(n + 1, np.int64)
                ka, kb = np.zeros(n, _U), np.arange(n, dtype=_U)
                if len(r.first):
                    r.sign(w)
                    ka, kb = _text_keys(w, r.h, w.hash(1))
                    at = np.searchsorted(r.first, w.at)
                    base = np.repeat(w.at[:-1], np.diff(at))
                    columns = [r.a.view(np.int64), r.b.view(np.int64), (r.first - base).astype(np.int32)]
                else:
                    columns = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]
                lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(c)) for c in columns]
                own = part.drop_columns(["_t"])
                names = ["n_words", "_ka", "_kb", "_a", "_b", "_at"]
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(w.counts), _signed(ka), _signed(kb), *lists], [*own.schema.names, *names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whole.drop("_t").schema)
    found = whole.mapInArrow(lean(suspects), f"{kinds}{', ' if kinds else ''}n_words long, _ka long, _kb long, _a array<long>, _b array<long>, _at array<int>")
    found = written(found, "suspects")
    shared.destroy()  # both passes that read it have been written
    flat = found.where(F.size("_a") > 0).select("_ka", "_kb", F.explode(F.arrays_zip("_a", "_b", "_at")).alias("r"))
    flat = flat.select("_ka", "_kb", F.col("r._a").alias("a"), F.col("r._b").alias("b"), F.col("r._at").alias("at"))
    hits = flat.join(masks, ["a", "b"]).groupBy(F.col("_ka").alias("_ja"), F.col("_kb").alias("_jb")).agg(F.collect_set(F.struct("at", "mask")).alias("_hits"))
    hits = written(hits, "hits")  # a table, so that Spark can split the join where very many documents have one text
    # texts without a suspect need no Python: their words are joined by an expression, which is left out where nothing reads it
    joined = F.trim(F.regexp_replace(F.coalesce("_x", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    clean = found.where(F.size("_a") == 0).withColumn("_x", F.col(text).cast("string")).withColumns({"n_removed": F.lit(0).cast("long"), "kept": joined})
    dirty = found.where(F.size("_a") > 0).join(hits, (F.col("_ka") == F.col("_ja")) & (F.col("_kb") == F.col("_jb")), "left").drop("_ja", "_jb")
    aside = ("_ka", "_kb", "_a", "_b", "_at")
    return clean.drop(*aside, "_x").unionByName(_kept(dirty.drop(*aside), text, window))


def _kept(rows: DataFrame, text: str, window: int) -> DataFrame:
    @F.pandas_udf("struct<n_removed long, kept string>")
    def keep(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, hits in batches:
            yield pd.DataFrame([kept_words(t, h, window) for t, h in zip(texts, hits, strict=True)], columns=["n_removed", "kept"])

    out = rows.withColumn("_k", keep(F.col(text).cast("string"), F.col("_hits")))
    return out.withColumns({"n_removed": F.col("_k.n_removed"), "kept": F.col("_k.kept")}).drop("_k", "_hits")


def kept_words(text: str | None, hits, window: int) -> tuple[int, str]:
    """Number of removed words, and the kept words of a text; hits are (first window, mask of repeated windows)."""
    words = split_words(text) if text else []
    if hits is None or not len(hits):
        return 0, " ".join(words)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for h in hits:
        at, mask = h["at"], h["mask"]
        i = 0
        while mask >> i:
            if mask >> i & 1:
                edge[at + i] += 1
                edge[at + i + window] -= 1
            i += 1
    keep = np.cumsum(edge)[:-1] == 0
    return int(len(words) - keep.sum()), " ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k)


def split_words(text: str) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def brute_force(texts: list[str | None], window: int = WINDOW) -> list[tuple[int, int, str]]:
    """The same by definition, for tests: n_words, n_removed, hash of the kept words."""
    words = [split_words(t) if t else [] for t in texts]
    seen: dict[tuple[str, ...], int] = {}
    for w in words:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            seen[k] = seen.get(k, 0) + 1
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT r, i, array_to_string(ws[i:i + 34], ' ') AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY k) AS n FROM g),
hit AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM c WHERE n > 1),
one AS (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM one ANTI JOIN hit USING (r, p) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (r)
"""
