"""MinHash near-dedup: against brute force, the sequential test's odds, large groups and odd rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import Row

from meterflow.llm import minhash_dedup as M
from meterflow.llm.jaccard_join import brute_force
from meterflow.llm.storage import written
from meterflow.llm.words import string_parts

SCHEMA = "doc_id long, text string"


def by_id(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def near_copies(groups: int, size: int, words: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    out = []
    for _ in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(words)]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randrange(words // 8)):
                own[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(own))
    return out


def test_against_brute_force(spark):
    texts = [*near_copies(12, 6, 60, 1), *near_copies(3, 12, 9, 2), "one", "ONE", "two words", "Two  words", "", None, " \t\n"]
    rows = list(enumerate(texts)) + [(3, texts[40]), (None, texts[5])]
    expected = sorted(brute_force([i for i, _ in rows if i is not None], [t for i, t in rows if i is not None], 2, 80), key=str)
    got = by_id(M.near_duplicates(written(spark.createDataFrame(rows, SCHEMA).repartition(3), "docs")))
    assert [r for r in got if r[0] is not None] == expected
    assert [r for r in got if r[0] is None] == [(None, len(set(zip(texts[5].split(), texts[5].split()[1:]))), next(r[2] for r in expected if r[0] == 5))]


def test_large_groups_are_cut(spark):
    """Buckets and blocks of many slices: a group of near copies, and sets that share much but link with few."""
    rng = random.Random(5)
    texts = near_copies(1, 60, 80, 3)
    base = [f"b{i}" for i in range(70)]
    texts += [" ".join([*base, *(f"y{rng.randrange(10**6)}" for _ in range(25 + i % 3))]) for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    assert by_id(M.near_duplicates(docs, limit=5)) == sorted(brute_force(list(range(len(texts))), texts, 2, 80), key=str)


def test_sequential_test(spark):
    plan = M.least_agreements(0.8)
    assert plan[-1][0] == M.CODES and all(M.posterior(m, n, 0.8) >= M.MISS > (M.posterior(m - 1, n, 0.8) if m else 0) for n, m in plan)
    # the chance that a pair at the threshold is pruned, by all ways of agreeing batch by batch
    c = 0.8 + 0.2 / 256
    odds = {0: 1.0}
    for n, least in plan:
        new: dict[int, float] = {}
        for m, p in odds.items():
            for j in range(M.STEP + 1):
                new[m + j] = new.get(m + j, 0) + p * math.comb(M.STEP, j) * c**j * (1 - c) ** (M.STEP - j)
        odds = {m: p for m, p in new.items() if m >= least}
    assert 1 - sum(odds.values()) < 1e-6
    assert (1 - 0.8**M.BAND_ROWS) ** M.BANDS < 2e-7
    # minima agree as often as sets are similar
    rng = np.random.default_rng(0)
    u = rng.integers(0, 1 << 63, 1500, dtype=np.uint64)
    agree = [np.mean(x[:, 0] == x[:, 1]) for k in range(10) for x in [M.minima(np.concatenate([np.sort(u[100 * k : 100 * k + 90]), np.sort(u[100 * k + 10 : 100 * k + 100])]), np.array([0, 90, 180]))]]
    assert abs(np.mean(agree) - 0.8) < 0.02
    # unlike sets are given up at the first batch
    codes = rng.integers(0, 256, (50, M.CODES), dtype=np.uint8)
    assert list(M.survivors(codes, np.full(50, 10), 0, np.arange(50), 80, plan)) == [0]


def test_odd_tables(spark):
    assert M.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    long = " ".join(f"w{i % 5000}" for i in range(60_000))
    rows = [Row(doc_id=7, text=long, key="a", k=1, n_shingles=None), Row(doc_id=2, text=long + " end", key="b", k=2, n_shingles=None)]
    got = M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, key string, k long, n_shingles long"))
    assert by_id(got) == [(2, 5001, 2), (7, 5000, 2)] and {r.doc_id: r.kept for r in got.collect()} == {2: True, 7: False}


def test_string_parts_of_empty_columns():
    import pyarrow as pa

    data, at = string_parts(pa.array([], pa.binary()))
    assert len(data) == 0 and list(at) == [0]


@pytest.mark.parametrize("n,threshold", [(32, 0.5), (128, 0.9)])
def test_posterior_is_a_share(n, threshold):
    values = [M.posterior(m, n, threshold) for m in range(n + 1)]
    assert all(a <= b for a, b in zip(values, values[1:])) and 0 < values[0] < values[-1] <= 1


def test_signatures_met_again():
    """Ranges pass on the sets of every signature that two sets have, whatever the steps in which they come."""
    from meterflow.llm.jaccard_join import Seen

    rng = np.random.default_rng(2)
    sig, k = rng.integers(0, 60, 500).astype(np.uint64), rng.integers(0, 40, 500)
    sig[:40], k[:40] = 1000, 7  # one set alone, again and again
    for steps in (1, 7, 500):
        order, seen, got = rng.permutation(500), Seen(), set()
        for part in np.array_split(order, steps):
            a, b = seen.add(sig[part], k[part])
            got |= set(zip(a.tolist(), b.tolist(), strict=True))
        by = {}
        for s, x in zip(sig.tolist(), k.tolist(), strict=True):
            by.setdefault(s, set()).add(x)
        assert got == {(s, x) for s, xs in by.items() if len(xs) > 1 for x in xs}
