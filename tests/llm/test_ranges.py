"""Signatures by ranges, and the bit map of wanted texts."""

import collections

import numpy as np
import pytest

from meterflow.llm import jaccard_join as J
from meterflow.llm.storage import bit_map, in_bit_map
from meterflow.llm.words import string_parts


@pytest.mark.parametrize("ranges", [1, 7, 400])
def test_ranges_give_back_repeats_and_nothing_else(spark, ranges):
    """Whatever the number of ranges, no signature of one set alone passes, and none of two sets is lost."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 500, 80)) for _ in range(30)]
    texts = [b for b in base] + [b + f" end{i}" for i, b in enumerate(base[:12])] + base[:5] + [None, "", "one word"]
    data, at = string_parts(pa.array(texts, pa.string()))
    u, offsets = J.shingle_sets(data, at, 3)
    sig, who = J.signatures(u, offsets, 90)
    keys = J.set_keys(u, offsets)[0].view(np.int64)
    sets = collections.defaultdict(set)
    for s, w in zip(sig.view(np.int64).tolist(), who.tolist(), strict=True):
        sets[s].add(int(keys[w]))
    want = {(s, k) for s, ks in sets.items() if len(ks) > 1 for k in ks}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(6)
    got = {tuple(r) for r in J.repeated_signatures(rows, 3, 90, ranges).collect()}
    assert got == want and 0 < len(want) < len(sets)


def test_bit_map(spark):
    values = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 2000)
    bits = bit_map(spark.createDataFrame([(int(v),) for v in values], "v long"), "v")
    assert in_bit_map(bits, values).all() and in_bit_map(bits, np.array([-1, 0, 2**27 - 1, 2**27])).sum() == 0
    others = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 100_000)
    assert in_bit_map(bits, others).sum() < 20
    edges = np.array([0, -1, 2**27, 2**63 - 1, -(2**63)])
    assert in_bit_map(bit_map(spark.createDataFrame([(int(v),) for v in edges], "v long"), "v"), edges).all()
    assert not any(bit_map(spark.createDataFrame([], "v long"), "v"))


def test_the_map_of_few_wanted_texts_is_small(spark, monkeypatch):
    """The driver and the tasks hold bits in proportion to the wanted texts, up to the bound; none of them is lost."""
    from meterflow.llm import storage

    made = []
    real = storage.bit_map
    monkeypatch.setattr(J, "bit_map", lambda *a: made.append(real(*a)) or made[-1])
    texts = [" ".join(f"w{i}x{j % 90}" for j in range(120)) + f" end{k}" for i in range(20) for k in range(2)]
    got = {r.doc_id: r.component_id for r in J.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), threshold=80).collect()}
    assert got == {i: i // 2 * 2 for i in range(40)}
    assert made and max(map(len, made)) == 1 << 12
    assert [storage.map_bits(n) for n in (0, 1, 512, 513, 1 << 21, 1 << 40)] == [15, 15, 15, 16, 27, 27]
    values = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 2000)
    bits = real(spark.createDataFrame([(int(v),) for v in values], "v long"), "v", storage.map_bits(2000))
    others = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 100_000)
    assert in_bit_map(bits, values).all() and in_bit_map(bits, others).mean() < 1 / 60
