"""Cross-tokenizer alignment: against a brute-force version with other tokenizer libraries' own calls, hot ids, odd rows."""

import collections
import hashlib

import numpy as np
import pytest

from meterflow.llm import alignment as A
from meterflow.llm.bpe import default_path

SCHEMA = "doc_id long, text string"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def byte_tokens(tokenizer, text):
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    return [(i, bytes(table[c] for c in tokenizer.id_to_token(i))) for i in ids]


def piece_tokens(model, text):
    out = []
    for i in model.encode(text):
        name = model.id_to_piece(i)
        out.append((i, bytes([int(name[1:-1], 16)]) if model.is_byte(i) else name.replace("▁", " ").encode()))
    return out


def brute_force(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    t.encode_special_tokens = True
    m = sentencepiece.SentencePieceProcessor(model_file=A.default_pieces())
    found, counts = [], collections.Counter()
    for _, text in rows:
        a, b = (byte_tokens(t, " " + text), piece_tokens(m, text)) if text else ([], [])
        whole = b" " + (text or "").encode()
        if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            found.append(([], [], [], []))
            continue
        ends = []
        for side in (a, b):
            at, own = 0, {}
            for i, x in side:
                at += len(x)
                own[at] = i
            ends.append(own)
        links = [(ends[0][e], ends[1][e]) for e in sorted(set(ends[0]) & set(ends[1]))]
        counts.update(links)
        groups, last = [], 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            groups.append("|".join(",".join(str(own[p]) for p in sorted(own) if last < p <= e) for own in ends))
            last = e
        found.append((a, b, links, groups))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for (i, _), (a, b, links, groups) in zip(rows, found, strict=True):
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((i, len(a), len(b), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return sorted(out, key=str)


TEXTS = [
    "The quick brown fox, it's 1234 jumps!", "the the the The quick brown", "", None, " ", "  two  spaces ", "line\n\nbreaks\tand\r\ntabs", "<|endoftext|> and </s> <s> <unk> <0x41>",
    "a ▁ b", "日本語のテキスト。", "é ü ñ", "🙂🙃", "x" * 300, "  lead", "trail   ", "naïve café", "don't we'll", "  ", "A B　C",
]


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


@pytest.fixture
def rows():
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"])
    own = [(r["doc_id"], r["text"]) for r in table.to_pylist()][:60]
    return [*((10_000 + i, t) for i, t in enumerate(TEXTS)), *own, own[3], (None, own[4][1])]


@pytest.mark.parametrize("stream", [A.STREAM, 40])
def test_against_brute_force(spark, rows, stream, monkeypatch):
    """Also with hot ids over many streams (streams of 40 postings)."""
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(A.aligned(docs, default_path(), A.default_pieces(), groups="sha256", stream=stream)) == brute_force(rows)


def test_long_texts_are_cut(rows):
    text = "\n".join(t for _, t in rows if t and "▁" not in t)
    whole = A.Aligned([text], default_path(), A.default_pieces())
    for most in (50, 1000):
        assert "".join(A.cut(text, most)) == text and len(A.cut(text, most)) > 20
    cut = A.cut
    try:
        A.cut = lambda t: cut(t, 50)
        parts = A.Aligned([None, text, "end"], default_path(), A.default_pieces())
    finally:
        A.cut = cut
    assert np.array_equal(whole.a, parts.a[: len(whole.a)]) and np.array_equal(whole.b, parts.b[: len(whole.b)])
    assert parts.groups()[1] == whole.groups()[0] and parts.groups()[0] == ""


def test_groups_and_odd_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert A.aligned(none, default_path(), A.default_pieces()).collect() == []
    one = spark.createDataFrame([(1, "hello world", 5, "x")], "doc_id long, text string, n_a int, part string")
    r = A.aligned(one, default_path(), A.default_pieces(), groups="text").collect()[0]
    assert r.n_a == 2 and r.part == "x" and r.groups.count(";") + 1 == r.n_groups and r.n_links == r.n_best == r.count_sum
