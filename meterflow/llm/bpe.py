"""BPE encoding and decoding of whole texts, long ones by tree concatenation.

The vocabulary is a byte-level BPE file of the tokenizers library; its ids and special tokens are honoured as that
library does by default (no special tokens added, no truncation, no padding); a file with another pre-tokenizer,
normaliser or merge order is refused.  Texts up to ``leaf`` code points are encoded at once.  Longer texts are cut into
leaves whose ids are joined in a binary tree.  The leaves of a text of up to ``span`` code points stay in the task that
holds the text; longer texts are cut into spans, which Spark deals out, so that the parts of one text are encoded in
parallel; only their ids come back to the text's row and are joined there.

A join encodes a window of text around the cut again and grows it until it begins and ends at edges that are certain and
its ids agree exactly with the ids of both halves between such edges; the halves' ids outside and the window's ids inside
are then the ids of the whole.  An edge is certain where no pre-token can lie across it whatever else the text holds: before white space
that follows something else, and between a letter and a punctuation mark.  A window that has grown to both halves is
itself exact.

Edge cases: null and empty texts have no ids and decode to ""; the file's special tokens in a text get their ids,
also across a cut; repeated rows, null ids and extra columns are carried (result columns replace clashing ones; names
that begin with an underscore are reserved); an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import small_batches
from .words import lean, slices

#: The pre-tokenizer's pattern of byte-level vocabularies, in a form that never goes back over what it has matched.
PATTERN = r"""'(?:[stmd]|re|ve|ll)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
LEAF = 16_384
SPAN = 65_536
#: Where every tokenization has an edge: no pre-token but a run of white space holds any after its first character, and
#: none holds a letter before a mark.
CERTAIN = re.compile(r"(?<=[^\s])(?=[ \t\n])|(?<=[A-Za-z\u4e00-\u9fa5\u3041-\u3096\u30a1-\u30fa])(?=[.,;:!?()\u3001\u3002\uff0c\uff01\uff1f])")


def _byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, inverted."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = _byte_alphabet()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        _check(spec, special)
        ranks = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.encoding = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        pieces = {i: b for b, i in ranks.items()} | {i: t.encode() for t, i in special.items()}
        self.size = np.array([len(pieces.get(i, b"")) for i in range(max(pieces) + 1)], dtype=np.int64)

    def encode(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, allowed_special="all")

    def decode(self, ids: np.ndarray) -> str:
        return self.encoding.decode(ids.tolist(), errors="replace")

    def raw(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for."""
        return self.encoding.decode_bytes(ids.tolist())


def _check(spec: dict, special: dict[str, int]) -> None:
    """Refuse files that ``Codec`` would read wrongly."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = not spec.get("normalizer") and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    byte_level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    if model.get("type") != "BPE" or not plain or not byte_level or (spec.get("decoder") or {}).get("type") != "ByteLevel":
        raise ValueError("only byte-level BPE files with the usual pre-tokenizer, no prefix space and no normaliser are known")
    merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if any(a >= b for a, b in zip(merged, merged[1:])):
        raise ValueError("ids must follow the order of merges")
    odd = [t["content"] for t in spec["added_tokens"] if t.get("normalized") or t.get("lstrip") or t.get("rstrip") or t.get("single_word")]
    if odd or any(CERTAIN.search(t) or t[:1].isspace() for t in special):
        raise ValueError("special tokens must stand as they are and hold no edge of other tokens")


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def _inner(raw: bytes, at: int) -> bool:
    """Whether a byte offset lies inside a character."""
    return at < len(raw) and raw[at] & 0xC0 == 0x80


def join(c: Codec, left: tuple[bytes, np.ndarray], right: tuple[bytes, np.ndarray], width: int = 64) -> tuple[bytes, np.ndarray]:
    """Text and ids of two neighbouring pieces as one."""
    (lt, li), (rt, ri) = left, right
    if not len(li) or not len(ri):
        return lt + rt, li if len(li) else ri
    while True:
        i, j = max(0, len(li) - width), min(len(ri), width)
        first, stop = len(lt) - int(c.size[li[i:]].sum()), int(c.size[ri[:j]].sum())
        while i and _inner(lt, first):
            i -= 1
            first -= int(c.size[li[i]])
        while j < len(ri) and _inner(rt, stop):
            stop += int(c.size[ri[j]])
            j += 1
        before, after = lt[first:].decode(), rt[:stop].decode()
        if i == 0 and j == len(ri):
            return lt + rt, c.encode(before + after)
        # token numbers in each half, by the certain edges of its part of the window
        starts = [(0, 0)] * (i == 0) + _edges(c, before, li[i:])
        ends = _edges(c, after, ri[:j]) + [(len(after), j)] * (j == len(ri))
        if starts and ends:
            (p, a), (_, a2), (_, b2), (q, b) = starts[0], starts[-1], ends[0], ends[-1]
            ids = c.encode(before[p:] + after[:q])
            if len(ids) >= a2 - a + b - b2 and (ids[: a2 - a] == li[i + a : i + a2]).all() and (ids[len(ids) - (b - b2) :] == ri[b2:b]).all():
                return lt + rt, np.concatenate([li[: i + a], ids, ri[b:]])
        width *= 4


def _edges(c: Codec, text: str, ids: np.ndarray) -> list[tuple[int, int]]:
    """First and last certain edge of a text, each with the number of ids before it."""
    found = [m.start() for m in CERTAIN.finditer(text)]
    ends = np.concatenate([[0], np.cumsum(c.size[ids])])
    out = []
    for p in found[:1] + found[1:][-1:]:
        at = len(text[:p].encode())
        k = int(np.searchsorted(ends, at))
        if ends[k] == at:
            out.append((p, k))
    return out


def joined(c: Codec, pieces: list[tuple[bytes, np.ndarray]]) -> np.ndarray:
    """Ids of the whole text of neighbouring pieces, joined pairwise level by level."""
    while len(pieces) > 1:
        pieces = [join(c, pieces[i], pieces[i + 1]) if i + 1 < len(pieces) else pieces[i] for i in range(0, len(pieces), 2)]
    return pieces[0][1]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _raw(ids: np.ndarray) -> bytes:
    return ids.astype("<u4").tobytes()


def tree(c: Codec, text: str, leaf: int) -> np.ndarray:
    """Ids of a text by its leaves."""
    if len(text) <= leaf:
        return c.encode(text)
    leaves = [text[i : i + leaf] for i in range(0, len(text), leaf)]
    return joined(c, [(t.encode(), c.encode(t)) for t in leaves])


def encode(docs: DataFrame, path: str, text: str = "text", leaf: int = LEAF, span: int = SPAN) -> DataFrame:
    """``docs`` with ``ids`` (binary, little-endian unsigned 32-bit) and ``n_tokens``.

    ``docs`` should come from a table (or another stable plan): parts of a long text find their row again by its place."""
    small_batches(docs.sparkSession)
    rows = docs.drop("ids", "n_tokens").withColumn("_t", F.col(text).cast("string"))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.drop("_t").schema)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for part, _, _ in slices(batch, "_t", 8 << 20):
                ids = [_raw(tree(c, t, leaf)) if t else b"" for t in part.column("_t").to_pylist()]
                own = part.drop_columns(["_t"])
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(ids, pa.binary())], [*own.schema.names, "ids"])

    within = rows.where(F.coalesce(F.length("_t"), F.lit(0)) <= span).mapInArrow(lean(whole), f"{kinds}ids binary")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The spans of each text; its first one carries the other columns."""
        for batch in batches:
            for k in range(batch.num_rows):
                own, t = batch.slice(k, 1).drop_columns(["_t"]), batch.column("_t")[k].as_py()
                n = -(-len(t) // span)
                for i in range(n):
                    row, part = own.column("_row"), pa.array([t[i * span : (i + 1) * span]])
                    carried = [x if not i else pa.nulls(1, x.type) for x in own.drop_columns(["_row"]).columns]
                    yield pa.RecordBatch.from_arrays([*carried, row, pa.array([i], pa.int32()), pa.array([n], pa.int32()), part], [*own.drop_columns(["_row"]).schema.names, "_row", "_part", "_parts", "_t"])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            own = batch.drop_columns(["_t"])
            ids = [_raw(tree(c, t, leaf)) for t in batch.column("_t").to_pylist()]
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(ids, pa.binary())], [*own.schema.names, "ids"])

    def meet(group: pa.Table) -> pa.Table:
        c = codec(path)
        group = group.sort_by("_part")
        if group["_part"].to_pylist() != list(range(group["_parts"][0].as_py())):
            raise ValueError("parts of a text are missing: its row changed its place between two attempts")
        ids = [np.frombuffer(x, "<u4").astype(np.uint32) for x in group["ids"].to_pylist()]
        out = group.slice(0, 1).drop_columns(["_row", "_part", "_parts", "ids"])
        return out.append_column("ids", pa.array([_raw(joined(c, [(c.raw(x), x) for x in ids]))], pa.binary()))

    spans = rows.where(F.length("_t") > span).withColumn("_row", F.monotonically_increasing_id())
    parts = spans.mapInArrow(lean(cut), f"{kinds}_row long, _part int, _parts int, _t string").repartition("_row", "_part")
    apart = parts.mapInArrow(lean(encoded), f"{kinds}_row long, _part int, _parts int, ids binary").groupBy("_row").applyInArrow(meet, f"{kinds}ids binary")
    return within.unionByName(apart).withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """``tokens`` with ``decoded``, the text of its ``ids``."""
    rows = tokens.drop("decoded")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                texts = [c.decode(np.frombuffer(x or b"", "<u4")) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "decoded"])

    return rows.mapInArrow(lean(run), f"{kinds}, decoded string")


def op6_bpe_tree(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    path = path or default_path()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = decode(encode(docs, path).drop("text"), path)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
