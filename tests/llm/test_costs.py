"""What steps cost: work that a table's size must not multiply."""

import numpy as np
import pyarrow as pa
import pytest

from meterflow.llm import bpe, jaccard_join, substring_dedup
from meterflow.llm.words import distinct

rng = np.random.default_rng(7)


def near_copies(n: int, changes: int, size: int = 300) -> list[np.ndarray]:
    """Sets of one origin, each with some other hashes."""
    base = rng.integers(0, 2**64, size, dtype=np.uint64)
    return [np.unique(np.concatenate([base[changes:], rng.integers(0, 2**64, changes, dtype=np.uint64)])) for _ in range(n)]


def task_table(groups: list[list[int]], sets: list[np.ndarray]) -> tuple[pa.Table, np.ndarray]:
    k = np.concatenate([np.array(g, np.int64) for g in groups])
    points = [jaccard_join.count_points(sets[i], np.array([0, len(sets[i])]))[0] for i in k]
    t = pa.table({"k": k, "n_shingles": np.array([len(sets[i]) for i in k]), "point": pa.array(points, pa.binary()), "side": np.zeros(len(k), np.int32), "pivot": np.zeros(len(k), bool)})
    return t.combine_chunks(), np.concatenate([[0], np.cumsum([len(g) for g in groups])])


def components(n: int, pairs) -> list[int]:
    group = list(range(n))
    for a, b in pairs:
        group = [group[a] if g == group[b] else g for g in group]
    return group


def test_pairs_that_meet_in_many_tasks_are_held_against_the_bound_once(monkeypatch):
    """Near copies share most of their signatures: a pair costs one bound and one edge, not one for each task."""
    sets = [*near_copies(4, 3), *near_copies(3, 3), *near_copies(2, 200)]
    groups = [[0, 1, 2, 3], [0, 1], [1, 2, 3], [4, 5, 6], [5, 6], [0, 4, 7], [7, 8]] * 5
    held = []
    monkeypatch.setattr(jaccard_join, "_forest_of", lambda pairs, f=jaccard_join._forest_of: held.append(len(pairs)) or f(pairs))
    t, borders = task_table(groups, sets)
    k = t["k"].to_numpy()
    pairs = jaccard_join._bounded(80)(t, borders)
    assert held == [6 + 3] and len(pairs) == 3 + 2
    assert components(9, k[pairs].tolist()) == components(9, [(0, 1), (1, 2), (2, 3), (4, 5), (5, 6)])


@pytest.mark.parametrize("same", [True, False])
@pytest.mark.parametrize("exact", [True, False])
def test_blocks_connect_what_links(same, exact):
    for sizes in ([40, 1, 1, 30, 2, 50, *[1] * 60], [1] * 100, [200]):
        sets = [s for n in sizes for s in near_copies(n, 8, int(rng.integers(40, 400)))]
        n = len(sets)
        rng.shuffle(where := np.arange(n))
        sets = [sets[i] for i in where]
        left = np.arange(n) if same else np.arange(n // 3)
        right = left if same else np.arange(n // 3, n)
        count = np.array([len(s) for s in sets])
        points = jaccard_join._folded([jaccard_join.count_points(s, np.array([0, len(s)]))[0] for s in sets])
        if exact:
            both = np.array([[len(np.intersect1d(a, b)) if 2 * min(len(a), len(b)) > max(len(a), len(b)) else 0 for b in sets] for a in sets])
            got = jaccard_join.linked(sets, left, right, 80)
        else:
            both = np.minimum(points[:, None], points[None]).sum(axis=2)
            got = jaccard_join.near(points, count, left, right, 80)
        links = both * 180 >= 80 * (count[:, None] + count[None])
        group = np.array(components(n, got))
        assert all(links[a, b] for a, b in got) and len(got) < n
        assert (group[left][:, None] == group[right][None])[links[np.ix_(left, right)]].all()


def test_a_large_group_of_near_copies_needs_few_searches(monkeypatch):
    sets = near_copies(600, 5)
    points = jaccard_join._folded([jaccard_join.count_points(s, np.array([0, len(s)]))[0] for s in sets])
    calls = []
    monkeypatch.setattr(jaccard_join.RTree, "search", lambda self, block, f=jaccard_join.RTree.search: calls.append(1) or f(self, block))
    every = np.arange(600)
    assert len(jaccard_join.near(points, np.array([len(s) for s in sets]), every, every, 80)) == 599 and len(calls) <= 3


def test_pretokens_are_those_of_the_usual_pattern():
    import tiktoken

    c = bpe.codec(bpe.default_path())
    usual = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    plain = tiktoken.Encoding("usual", pat_str=usual, mergeable_ranks=c.encoding._mergeable_ranks, special_tokens=c.encoding._special_tokens)
    parts = ["'s", "'re", "'ll", "'S", "'", " ", "  ", "\n", "\r\n", "\t", "　", " ", "\x0b", "\x85", "a", "Word", "é", "中", "١٢", "12", "½", "!", "...", "😀", "‍", "_", *c.encoding._special_tokens]
    for _ in range(5000):
        text = "".join(rng.choice(parts, int(rng.integers(0, 14))))
        assert c.encode(text).tolist() == plain.encode(text, allowed_special="all")
    assert c.encode("") .dtype == np.uint32


def test_clean_texts_need_no_python(spark):
    """Only texts with a suspect window go through Python; the others' words are the same by an expression."""
    repeated = " ".join(f"r{i}" for i in range(40))
    texts = [None, "", " \t\n", " a  b\x0b\x0cc ", "a  ", "  \x85 b c\n", "x" + " " * 300_000 + "y\r\n", f"one {repeated}", f"{repeated} two"]
    out = substring_dedup.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in out.collect()}
    for i, t in enumerate(texts):
        words = substring_dedup.split_words(t or "")
        kept = [w for w in words if w not in repeated.split()]
        assert got[i] == (len(words), len(words) - len(kept), " ".join(kept))
    plan = out.select("doc_id", "kept")._jdf.queryExecution().optimizedPlan().toString()
    assert len([x for x in plan.splitlines() if "ArrowEvalPython" in x]) == 1 and "Union" in plan.split("ArrowEvalPython")[0]


def test_distinct():
    for n in (0, 1, 50):
        x = rng.integers(0, 20, n).astype(np.uint64)
        assert (distinct(x.copy()) == np.unique(x)).all()
