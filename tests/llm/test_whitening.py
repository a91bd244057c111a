"""Whitening: against exact rational covariances, and odd rows."""

import math
from fractions import Fraction

import numpy as np

from meterflow.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>"


def exact(rows):
    """n, S and the covariance of the fit list in rational numbers, by definition."""
    fit = sorted({tuple(math.floor(W.SCALE * float(np.float32(c))) + W.SHIFT for c in v) for v in rows})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[i] for x in fit) for i in range(d)]
    cov = [[sum((x[i] - Fraction(sums[i], n)) * (x[j] - Fraction(sums[j], n)) for x in fit) / n for j in range(d)] for i in range(d)]
    return n, sums, cov


def test_against_exact_covariance(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 20)) @ np.diag(np.geomspace(300, 0.05, 20)) @ np.linalg.qr(rng.normal(size=(20, 20)))[0]
    rows = [(i, [float(c) for c in np.float32(v)]) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[7][1]) for i in range(80)]
    odd = [(2000, None), (2001, [float("nan")] * 20), (2002, [1.0] * 19 + [float("inf")]), (2003, [1.0] * 19 + [None]), (2004, []), (None, rows[3][1])]
    got = W.by_component(W.whitened(spark.createDataFrame(rows + odd, SCHEMA).repartition(7))).collect()
    n, sums, cov = exact([v for _, v in rows])
    assert {r.vec_id for r in got} == {i for i, _ in rows} | {None} and len(got) == 16 * (len(rows) + 1)
    values, vectors = np.linalg.eigh(np.array([[float(c) for c in row] for row in cov]))
    values, vectors = values[::-1], vectors.T[::-1]
    trace = float(sum(cov[i][i] for i in range(20)))
    x = {i: [math.floor(W.SCALE * c) + W.SHIFT for c in v] for i, v in rows}
    sign = {}
    for r in got:
        assert r.n == n and 0 <= r.identity_error <= 1e-6 and abs(r.explained * trace / values[r.component - 1] - 1) < 1e-9
        v = x[3 if r.vec_id is None else r.vec_id]
        assert r.deviation == sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))
        y = float(np.array([float(a - Fraction(s, n)) for a, s in zip(v, sums, strict=True)]) @ vectors[r.component - 1] / math.sqrt(values[r.component - 1]))
        if abs(y) > 1e-3:
            s = sign.setdefault(r.component, math.copysign(1, y * r.whitened))
            assert abs(r.whitened - s * y) < 1e-7


def test_compensation():
    """Double-doubles keep what doubles lose, in any order of merging."""
    rng = np.random.default_rng(1)
    hi = rng.normal(size=(500, 3)) * np.array([1e9, 1.0, 1e-6])
    lo = hi * rng.normal(size=hi.shape) * 2.0**-55
    i, j = np.triu_indices(3)
    want = [sum((Fraction(a[p]) + Fraction(b[p])) * (Fraction(a[q]) + Fraction(b[q])) for a, b in zip(hi.tolist(), lo.tolist(), strict=True)) for p, q in zip(i, j, strict=True)]
    parts = [W.products(hi[a:b], lo[a:b]) for a, b in ((0, 123), (123, 124), (124, 500))]
    for order in ((0, 1, 2), (2, 0, 1)):
        s = parts[order[0]]
        for k in order[1:]:
            s = W.added(s, parts[k])
        for h, low, w in zip(*s, want, strict=True):
            scale = float(sum(abs(Fraction(a[0]) * Fraction(a[1])) for a in hi.tolist())) or 1
            assert abs(float(Fraction(float(h)) + Fraction(float(low)) - w)) <= 1e-26 * max(abs(float(w)), scale)
    a, b = np.array([1e16 + 2, 0.1]), np.array([3.0, 0.3])
    p, e = W.two_product(a, b)
    assert all(Fraction(x) + Fraction(y) == Fraction(u) * Fraction(v) for x, y, u, v in zip(p.tolist(), e.tolist(), a.tolist(), b.tolist(), strict=True))


def test_deviations_beyond_a_long():
    model = {"n": 10**7, "sums": [10**13 + 7, 10**13 - 5]}
    x = np.array([[10**6, 10**6], [10**6 + 300, 10**6], [10**6 + 400, 10**6 + 10]])
    want = [sum((model["n"] * v - s) ** 2 for v, s in zip(row, model["sums"], strict=True)) for row in x.tolist()]
    assert W.deviations(x, model) == [w if w < 2**63 else None for w in want] and W.deviations(x, model)[1:] != [None, None]
    wide = {"n": 10**13, "sums": [10**19, 10**19 + 1]}
    assert W.deviations(np.array([[10**6, 10**6]]), wide) == [1]


def test_odd_tables(spark):
    assert W.by_component(W.whitened(spark.createDataFrame([], SCHEMA))).collect() == []
    same = spark.createDataFrame([(1, [2.0, 3.0]), (2, [2.0, 3.0]), (3, [1e30, -1e30, 5.0])], SCHEMA)
    assert W.by_component(W.whitened(same)).collect() == []
    both = [(1, [0.0, 1.0]), (2, [1.0, 3.0]), (3, [2.0, 2.0]), (4, [5.0]), (5, [9.0]), (6, [9.0])]
    extra = spark.createDataFrame([(*r, 1, 2) for r in both], SCHEMA + ", n long, dims int")
    got = {(r.vec_id, r.component): (r.n, round(r.whitened, 6)) for r in W.by_component(W.whitened(extra)).collect()}
    assert {k[0] for k in got} == {1, 2, 3, 4, 5, 6} and got[4, 1] == (2, -1.0) and got[5, 1] == got[6, 1] == (2, 1.0) and got[1, 2][0] == 3
