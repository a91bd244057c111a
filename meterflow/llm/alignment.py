"""Cross-tokenizer alignment of two vocabularies over a corpus, by a cogroup of postings.

Tokenizer A is a byte-level BPE file, B a sentencepiece model; A reads a space and the text, B adds that space itself.  Byte
offsets where tokens of both end cut them into groups, and the two tokens that end there are a link.  A pair of ids counts
how many links of the corpus hold it.

*Postings.*  The task that tokenizes a text keeps its links as multiplicities of (B id, A id, document); about
``PART_BYTES`` of text at a time become one posting list for each B id.  The pair counts are summed before they move.
*Cogroup.*  B ids are dealt out to ``LANES`` lanes by a hash, and parts to blocks.  Counts and posting lists meet by lane and
block in streams that Spark sorts by id (and spills): first the counts of an id, of which the task finds the highest, then
its posting lists one after the other, each of which gives its documents' shares.  Every block has its lane's counts, so
the postings of a hot id spread over the blocks; a document has a share in each lane at most, however many blocks there are.
Shares are added up by document.

Long texts are tokenized in pieces cut at a space between two word characters, where neither tokenizer has a token across:
pre-tokens of A hold a space at their start only, and B is refused if a piece holds a space after another character.

Edge cases: texts that are null or empty, or whose joined token bytes differ from space + text (so all that hold U+2581), have
no tokens and zeros; strings of special tokens are plain text; repeated rows each count; null ids are carried; other columns
are carried (result columns replace clashing ones; names that begin with an underscore are reserved); an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import codec, default_path
from .storage import small_batches, written
from .words import lean, slices

#: Text of one posting list for each B id.
PART_BYTES = 8 << 20
#: Lanes of B ids, and postings in one stream.
LANES = 16
STREAM = 1_000_000
#: Postings whose shares a task holds.
HELD = 2_000_000
#: Code points of a piece of a long text.
PIECE = 1 << 17
#: Ids of either vocabulary, at most (18 bits).
MOST_IDS = 1 << 18
_CUT = re.compile(r"(?<=\w) (?=\w)")
_U = np.uint64


class Pieces:
    """A sentencepiece model with the bytes of each id."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("▁" in name.lstrip("▁") for name in names):
            raise ValueError("pieces that hold a space after another character are not known")
        if not all(names) or len(names) > MOST_IDS:
            raise ValueError(f"every piece needs a text, and there are at most {MOST_IDS}")
        self.bytes = [bytes([int(name[3:5], 16)]) if self.model.is_byte(i) else name.replace("▁", " ").encode() for i, name in enumerate(names)]
        self.size = np.array([len(b) for b in self.bytes], np.int64)


@lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def cut(text: str, most: int = PIECE) -> list[str]:
    """Pieces of a text; all but the first begin with the space at which they were cut."""
    out, at = [], 0
    while len(text) - at > most:
        found = _CUT.search(text, at + most)
        if not found:
            break
        out.append(text[at : found.start()])
        at = found.start()
    return [*out, text[at:]]


class Aligned:
    """Tokens, groups and links of consecutive texts; texts without tokens have none."""

    def __init__(self, texts: list[str | None], path_a: str, path_b: str):
        a, b = codec(path_a), pieces(path_b)
        self.ids = max(len(a.size), len(b.size))
        if self.ids > MOST_IDS:
            raise ValueError(f"more than {MOST_IDS} ids")
        rows_a: list[list[int]] = []
        rows_b: list[list[int]] = []
        flat, owner = [], []
        for i, t in enumerate(texts):
            for p in cut(t) if t else ():
                flat.append(p)
                owner.append(i)
        first = [not k or owner[k] != owner[k - 1] for k in range(len(flat))]
        encoded_b = b.model.encode([p if f else p[1:] for p, f in zip(flat, first, strict=True)], num_threads=1) if flat else []
        encoded_a = [a.encoding.encode_ordinary(" " + p if f else p) for p, f in zip(flat, first, strict=True)]
        k = 0
        for i, t in enumerate(texts):
            own_a: list[int] = []
            own_b: list[int] = []
            while k < len(flat) and owner[k] == i:
                own_a += encoded_a[k]
                own_b += encoded_b[k]
                k += 1
            whole = b" " + (t or "").encode()
            if not own_a or b"".join(map(b.bytes.__getitem__, own_b)) != whole or a.encoding.decode_bytes(own_a) != whole:
                own_a, own_b = [], []
            rows_a.append(own_a)
            rows_b.append(own_b)
        self.n_a, self.n_b = (np.array([len(r) for r in rows], np.int64) for rows in (rows_a, rows_b))
        self.a, self.b = (np.fromiter(chain.from_iterable(rows), np.int64, int(n.sum())) for rows, n in ((rows_a, self.n_a), (rows_b, self.n_b)))
        # a text has as many bytes in A as in B, so that ends count on from text to text
        end_a, end_b = np.cumsum(a.size[self.a]), np.cumsum(b.size[self.b])
        mark = np.zeros((2, int(end_a[-1]) + 1 if len(end_a) else 1), bool)
        mark[0, end_a], mark[1, end_b] = True, True
        #: Token numbers of A and B at the end of each group, and the text of each group.
        self.last_a, self.last_b = np.flatnonzero(mark[1, end_a]), np.flatnonzero(mark[0, end_b])
        self.text = np.repeat(np.arange(len(texts)), self.n_a)[self.last_a]
        self.n_groups = np.bincount(self.text, minlength=len(texts)).astype(np.int64)

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A id, B id and text of each link."""
        return self.a[self.last_a], self.b[self.last_b], self.text

    def groups(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each text."""
        n = np.zeros((2, len(self.last_a) + 1), np.int64)
        n[0, 1:], n[1, 1:] = self.last_a + 1, self.last_b + 1
        # in the whole text, the tokens of A in a group stand after all tokens of B in the groups before it, and those of B after A's
        at_a = np.arange(len(self.a)) + np.repeat(n[1, :-1], np.diff(n[0]))
        at_b = np.arange(len(self.b)) + np.repeat(n[0, 1:], np.diff(n[1]))
        parts = np.empty(len(self.a) + len(self.b), object)
        comma, bar, semicolon = (_names(mark, self.ids) for mark in ",|;")
        parts[at_a], parts[at_b] = comma[self.a], comma[self.b]
        parts[at_a[self.last_a]], parts[at_b[self.last_b]] = bar[self.a[self.last_a]], semicolon[self.b[self.last_b]]
        flat, ends = parts.tolist(), np.cumsum(self.n_a + self.n_b).tolist()
        return ["".join(flat[i:j])[:-1] for i, j in zip([0, *ends], ends)]


@lru_cache(maxsize=4)
def _names(mark: str, ids: int) -> np.ndarray:
    """The decimal text of every id, with a mark after it."""
    return np.array([f"{i}{mark}" for i in range(ids)], object)


def _packed(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys (B id, A id, text) of links as sorted columns b, a, text and multiplicity."""
    key, m = np.unique(np.concatenate(parts), return_counts=True)
    return (key >> _U(46)).astype(np.int32), ((key >> _U(28)) & _U((1 << 18) - 1)).astype("<u4"), (key & _U((1 << 28) - 1)).astype("<u4"), m.astype("<u4")


def _binary(x: np.ndarray, at: list[int]) -> pa.Array:
    raw, w = x.tobytes(), x.itemsize
    return pa.array([raw[w * i : w * j] for i, j in zip(at, at[1:])], pa.binary())


_POSTINGS = "_part long, _local int, _b int, _n long, _as binary, _docs binary, _ms binary"
_NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]


def postings(docs: DataFrame, path_a: str, path_b: str, text: str = "text", groups: str | None = None) -> DataFrame:
    """A written table: a row for each document (``_b`` null: its other columns and numbers, and its groups as text or
    ``sha256``), and a posting list for each part of the corpus and B id."""
    small_batches(docs.sparkSession)
    results = [*_NUMBERS, "n_best", "count_sum", "groups", "groups_sha256"]
    carried = [c for c in docs.columns if c != text and c not in results]
    rows = docs.select(*carried, F.col(text).cast("string").alias("_t"))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.drop("_t").schema)
    more = {"text": "groups", "sha256": "groups_sha256"}.get(groups or "")
    schema = kinds + "".join(f"{c} long, " for c in _NUMBERS) + (f"{more} string, " if more else "") + _POSTINGS
    names = [*carried, *_NUMBERS, *([more] if more else []), *(f.split()[0] for f in _POSTINGS.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, local, size, held = TaskContext.get().partitionId() << 32, 0, 0, []

        def lists() -> pa.RecordBatch:
            b, a, doc, m = _packed(held)
            at = [*np.flatnonzero(np.append(True, b[1:] != b[:-1])).tolist(), len(b)]
            n = np.diff(at)
            own = {"_part": pa.array(np.full(len(n), part)), "_b": pa.array(b[at[:-1]]), "_n": pa.array(np.add.reduceat(m.astype(np.int64), at[:-1]))}
            own |= {"_as": _binary(a, at), "_docs": _binary(doc, at), "_ms": _binary(m, at)}
            return pa.RecordBatch.from_arrays([own.get(c, pa.nulls(len(n), kind)) for c, kind in types.items()], names)

        types: dict[str, pa.DataType] = {}
        for batch in batches:
            for rows_, _, offsets in slices(batch, "_t", 1 << 20):
                found = Aligned(rows_.column("_t").to_pylist(), path_a, path_b)
                own = {c: rows_.column(c) for c in carried} | dict(zip(_NUMBERS, map(pa.array, (found.n_a, found.n_b, found.n_groups, found.n_groups)), strict=True))
                if more:
                    texts = found.groups()
                    own[more] = pa.array(texts if more == "groups" else [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in texts], pa.string())
                own |= {"_part": pa.array(np.full(rows_.num_rows, part)), "_local": pa.array(np.arange(local, local + rows_.num_rows, dtype=np.int32))}
                kinds_ = {"_b": pa.int32(), "_n": pa.int64(), "_as": pa.binary(), "_docs": pa.binary(), "_ms": pa.binary()}
                types = {c: own[c].type if c in own else kinds_[c] for c in names}
                yield pa.RecordBatch.from_arrays([own.get(c, pa.nulls(rows_.num_rows, kind)) for c, kind in types.items()], names)
                a, b, doc = (x.astype(_U) for x in found.links())
                if len(a):
                    held.append((b << _U(46)) | (a << _U(28)) | (doc + _U(local)))
                local += rows_.num_rows
                size += int(offsets[-1] - offsets[0])
                if size >= PART_BYTES or local >= 1 << 27:
                    if held:
                        yield lists()
                    part, local, size, held = part + 1, 0, 0, []
        if held:
            yield lists()

    return written(rows.mapInArrow(lean(run), schema), "postings")


def _lists(b: pa.RecordBatch, name: str) -> np.ndarray:
    """All numbers of a column of lists."""
    return np.frombuffer(b"".join(b.column(name).to_pylist()), "<u4")


def pair_counts(lists: DataFrame) -> DataFrame:
    """b, a, n: how many links hold each pair of ids; summed in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                size = np.array([len(x) // 4 for x in batch.column("_as").to_pylist()])
                key = np.repeat(batch.column("_b").to_numpy().astype(_U), size) << _U(32) | _lists(batch, "_as")
                order = np.argsort(key, kind="stable")
                key, m = key[order], _lists(batch, "_ms").astype(np.int64)[order]
                at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                yield pa.RecordBatch.from_arrays([pa.array((key[at] >> _U(32)).astype(np.int32)), pa.array((key[at] & _U(0xFFFFFFFF)).astype(np.int32)), pa.array(np.add.reduceat(m, at))], ["b", "a", "n"])

    return lists.select("_b", "_as", "_ms").mapInArrow(lean(run), "b int, a int, n long").groupBy("b", "a").agg(F.sum("n").alias("n"))


_SHARES = "part long, docs binary, best binary, sums binary"


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams (lane, block) sorted by B id and kind: counts (kind 0), then posting lists (kind 1), to shares of documents."""
    stream = key = None
    ids, counts = [], []
    known = count = best = None
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lane, block, b, kind = (batch.column(c).to_numpy() for c in ("lane", "block", "b", "kind"))
        new = np.append(True, (lane[1:] != lane[:-1]) | (block[1:] != block[:-1]) | (b[1:] != b[:-1]) | (kind[1:] != kind[:-1]))
        at = [*np.flatnonzero(new).tolist(), batch.num_rows]
        for i, j in zip(at, at[1:]):
            if (lane[i], block[i]) != stream:
                if held:
                    yield _summed(held)
                stream, held, n = (lane[i], block[i]), [], 0
            if (*stream, b[i]) != key:
                key, ids, counts, known = (*stream, b[i]), [], [], None
            run = batch.slice(i, j - i)
            if kind[i] == 0:
                ids.append(run.column("a").to_numpy())
                counts.append(run.column("n").to_numpy())
                continue
            if known is None:
                flat_ids, flat_counts = np.concatenate(ids), np.concatenate(counts)
                order = np.argsort(flat_ids, kind="stable")
                head = np.flatnonzero(np.append(True, flat_ids[order][1:] != flat_ids[order][:-1]))
                known, count = flat_ids[order][head], np.add.reduceat(flat_counts[order], head)
                best = count.max()
            docs, m = _lists(run, "docs"), _lists(run, "ms").astype(np.int64)
            part = np.repeat(run.column("part").to_numpy(), [len(x) // 4 for x in run.column("docs").to_pylist()])
            c = count[np.searchsorted(known, _lists(run, "as"))]
            held.append((part, docs, m * (c == best), m * c))
            n += len(m)
            if n >= HELD:
                yield _summed(held)
                held, n = [], 0
    if held:
        yield _summed(held)


def _added(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Shares of (part, document), each once."""
    part, doc, best, sums = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((doc, part))
    part, doc = part[order], doc[order]
    at = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (doc[1:] != doc[:-1])))
    return part[at], doc[at], np.add.reduceat(best[order], at), np.add.reduceat(sums[order], at)


def _summed(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """A row of packed shares for each part."""
    part, doc, best, sums = _added(held)
    at = [*np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist(), len(part)]
    return pa.RecordBatch.from_arrays([pa.array(part[at[:-1]]), _binary(doc.astype("<u4"), at), _binary(best, at), _binary(sums, at)], ["part", "docs", "best", "sums"])


def _by_document(key: tuple, rows: pa.Table) -> pa.Table:
    """The shares of a part's documents, of all lanes, added up."""
    flat = lambda c, kind: np.frombuffer(b"".join(rows[c].to_pylist()), kind)
    docs = flat("docs", "<u4")
    part, doc, best, sums = _added([(np.full(len(docs), key[0].as_py()), docs, flat("best", np.int64), flat("sums", np.int64))])
    return pa.table([pa.array(part), pa.array(doc.astype(np.int32)), pa.array(best), pa.array(sums)], ["_p", "_l", "n_best", "count_sum"])


def aligned(docs: DataFrame, path_a: str, path_b: str, text: str = "text", groups: str | None = None, stream: int = STREAM) -> DataFrame:
    """``docs`` without the text, with n_a, n_b, n_groups, n_links, n_best and count_sum; with ``groups`` = "text" also the
    groups themselves, with "sha256" their digest."""
    table = postings(docs, path_a, path_b, text, groups)
    lists = table.where("_b IS NOT NULL").withColumn("lane", F.pmod(F.xxhash64("_b"), F.lit(LANES)).cast("int"))
    counts = written(pair_counts(lists), "pair-counts")
    # parts of the corpus are dealt out to blocks; the counts go to each, so a stream holds some times more postings than those
    most = lists.groupBy("lane").agg(F.sum(F.octet_length("_as") / 4).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    blocks = max(1, -(-int(most) // max(stream, 8 * counts.count() // LANES)))
    lane = F.pmod(F.xxhash64("b"), F.lit(LANES)).cast("int")
    own = counts.select(lane.alias("lane"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "b", F.lit(0).alias("kind"), "a", "n")
    spread = lists.select("lane", F.pmod(F.xxhash64("_part"), F.lit(blocks)).cast("int").alias("block"), F.col("_b").alias("b"), F.lit(1).alias("kind"), F.col("_part").alias("part"), F.col("_as").alias("as"), F.col("_docs").alias("docs"), F.col("_ms").alias("ms"))
    both = own.unionByName(spread, allowMissingColumns=True).repartition("lane", "block").sortWithinPartitions("lane", "block", "b", "kind")
    shares = both.mapInArrow(lean(_shares), _SHARES).groupBy("part").applyInArrow(_by_document, "_p long, _l int, n_best long, count_sum long")
    rows = table.where("_b IS NULL").drop("_b", "_n", "_as", "_docs", "_ms")
    out = rows.join(shares, (F.col("_part") == F.col("_p")) & (F.col("_local") == F.col("_l")), "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")})
    return out.select(*rows.drop("_part", "_local").columns, "n_best", "count_sum")


def op11_token_alignment(spark, sf_dir: str, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = aligned(docs, path_a or default_path(), path_b or default_pieces(), groups="sha256")
    return out.select("doc_id", *_NUMBERS, "n_best", "count_sum", "groups_sha256")
