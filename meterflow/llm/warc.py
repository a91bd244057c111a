"""WARC archives with dictionary-compressed records, written and read back on Spark.

``archive(pages)`` gives one row per archive: ``archive_id`` and ``content``, the bytes of a ``.warc.zst`` file.  Each
archive holds about ``archive_bytes`` of records.  A Zstandard dictionary is trained from the records of that very
archive and stands, itself compressed, in a leading skippable frame (magic 0x184D2A5D); every record follows as a
frame of its own, compressed with that dictionary, so that any record can be read alone.  Archives are written as a
table through Spark's committer, so a lost executor costs a retry and never a torn file; ``save`` puts them into a
folder as files.  ``read_archives`` parses such rows back into records.

Payloads of at least ``min_revisit`` bytes that are equal share one response, that of the smallest page_id; the
others are revisit records which keep the HTTP header (with the payload's length), the payload's digest and a
reference to the response.

Edge cases: null html is an empty payload; null url is written without WARC-Target-URI and read as null; a null page_id
never becomes the response of others unless all of a group are null; rows that repeat the smallest page_id of a group
are all responses (record ids still differ); line breaks in urls are percent-encoded in the header; one record larger than an archive has an
archive of its own; too few bytes for training give a raw dictionary, or none below 8 bytes; an empty table gives no
archive; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written
from .words import lean

#: Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
ZSTD_MAGIC = 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def _one_line(url: str) -> str:
    return url.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, refers_url: str | None, revisit: bool, place: str) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP header of its response without the payload.

    ``place`` tells records apart.  Urls stand as they are; one with line breaks has them percent-encoded, and itself in a
    header of its own."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = uuid.uuid5(_SPACE, f"{place} {page_id} {digest}")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {DATE}"]
    if url is not None:
        plain = _one_line(url)
        head += [f"WARC-Target-URI: {plain}", *([f"X-Original-URI: {json.dumps(url)}"] if plain != url else [])]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Page-ID: {refers_to}"]
        if refers_url is not None:
            head.append(f"WARC-Refers-To-Target-URI: {_one_line(refers_url)}")
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes], size: int = 1 << 16) -> zstd.ZstdCompressionDict | None:
    """Trained from all records of the archive; where there is too little to train on, their first bytes as they are."""
    total = sum(map(len, records))
    try:
        return zstd.train_dictionary(min(size, max(1024, total // 20)), records, k=512, d=8)
    except zstd.ZstdError:
        raw = b"".join(records)[: min(size, 4096)]
        return zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_RAWCONTENT) if len(raw) >= 8 else None


def pack(records: list[bytes], level: int = 3) -> bytes:
    """The bytes of one archive."""
    words = dictionary(records)
    out = []
    if words:
        frame = zstd.ZstdCompressor(level=level).compress(words.as_bytes())
        out += [struct.pack("<II", DICTIONARY_MAGIC, len(frame)), frame]
    one = zstd.ZstdCompressor(level=level, dict_data=words, write_content_size=True, write_checksum=True)
    out += [one.compress(r) for r in records]
    return b"".join(out)


def unpack(content: bytes, piece: int = 1 << 12) -> Iterator[bytes]:
    """The records of one archive, frame by frame; a frame is fed in growing pieces, so that no frame sees the rest."""
    at, words, view = 0, None, memoryview(content)
    reader = zstd.ZstdDecompressor()
    while at < len(content):
        if len(content) - at < 8:
            raise ValueError("truncated archive")
        magic, size = struct.unpack_from("<II", content, at)
        if magic == DICTIONARY_MAGIC:
            raw = bytes(view[at + 8 : at + 8 + size])
            if raw[:4] == struct.pack("<I", ZSTD_MAGIC):
                raw = zstd.ZstdDecompressor().decompress(raw)
            trained = raw[:4] == struct.pack("<I", 0xEC30A437)
            words = zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_FULLDICT if trained else zstd.DICT_TYPE_RAWCONTENT)
            at += 8 + size
            reader = zstd.ZstdDecompressor(dict_data=words)
            continue
        frame, parts, step = reader.decompressobj(), [], piece
        while not frame.eof:
            if at >= len(content):
                raise ValueError("truncated archive")
            parts.append(frame.decompress(view[at : at + step]))
            at = min(at + step, len(content))
            step = min(2 * step, 1 << 20)
        at -= len(frame.unused_data)
        yield b"".join(parts)


def parse(raw: bytes) -> dict:
    """The columns of RECORDS of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields["WARC-Type"] == "revisit"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    if not revisit:
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"record {fields['WARC-Record-ID']} does not hold its payload")
    url = fields.get("WARC-Target-URI")
    number = lambda k: int(fields[k]) if k in fields else None
    return {
        "page_id": number("X-Page-ID"),
        "url": json.loads(fields["X-Original-URI"]) if "X-Original-URI" in fields else url,
        "record_type": fields["WARC-Type"],
        "refers_to": number("X-Refers-To-Page-ID"),
        "payload_bytes": size,
        "payload_digest": digest,
        "payload": None if revisit else payload,
    }


def with_revisits(pages: DataFrame, min_revisit: int = 100) -> DataFrame:
    """page_id, url, payload, size, digest, first and first_url (page_id and url of the payload's response, null without repeats)."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    groups = p.where(F.col("size") >= min_revisit).groupBy(F.col("digest").alias("_digest"))
    groups = groups.agg(F.min("page_id").alias("first"), F.min_by("url", "page_id").alias("first_url"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return p.join(groups, F.col("digest") == F.col("_digest"), "left").drop("_digest")


def archive(pages: DataFrame, archive_bytes: int = 8 << 20, min_revisit: int = 100) -> DataFrame:
    """Archives of all pages: archive_id string, content binary."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records: list[bytes] = []
        held = done = 0
        task = TaskContext.get().partitionId()

        def flush() -> pa.RecordBatch:
            content = pack(records)
            name = hashlib.sha256(content).hexdigest()[:32]
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())], ["archive_id", "content"])

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, size, digest, first, first_url = (batch.column(j)[i].as_py() for j in range(7))
                revisit = first is not None and first != page_id
                done += 1
                records.append(record(page_id, url, payload, size, digest, first, first_url, revisit, f"{task} {done}"))
                held += len(records[-1])
                if held >= archive_bytes:
                    yield flush()
                    records, held = [], 0
        if records:
            yield flush()

    return with_revisits(pages, min_revisit).select("page_id", "url", "payload", "size", "digest", "first", "first_url").mapInArrow(lean(write), "archive_id string, content binary")


def read_archives(archives: DataFrame) -> DataFrame:
    """All records of the archives (RECORDS); every response is checked against its digest and length."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for raw in unpack(content.as_py()):
                    rows.append(parse(raw))
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return archives.select("content").mapInArrow(lean(read), RECORDS)


def save(archives: DataFrame, folder: str) -> None:
    """Archives as files of a folder that all executors mount; each appears whole or not at all."""

    def put(rows) -> None:
        for r in rows:
            part = f"{folder}/.{r.archive_id}.{uuid.uuid4().hex}"
            with open(part, "wb") as f:
                f.write(r.content)
            os.replace(part, f"{folder}/{r.archive_id}.warc.zst")

    archives.foreachPartition(put)


def op1_warc_dictionary(spark, sf_dir: str) -> DataFrame:
    archives = written(archive(spark.read.parquet(f"{sf_dir}/pages.parquet")), "warc")
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first, count(*) AS n FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN n > 1 AND first IS DISTINCT FROM page_id AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n > 1 AND first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
