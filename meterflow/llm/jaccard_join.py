"""N-gram Jaccard join with count-vector R-trees: documents of equal or nearly equal shingle sets, as components.

A document's set holds the distinct hashed shingles of its lower-cased words.  Two documents link when
100 * intersection >= threshold * union.  Equal sets are one class (128-bit key), so copies cost one set.

*Meeting.*  Token hashes are cut into G groups (ranges of the hash space); sets that link differ in at most
(|a| + |b|) * (100 - t) / (100 + t) tokens, so with more groups than that some group is equal in both.  G is chosen per size
class, with E groups to spare, so that an equal group is not an empty one unless
both sets have more than E empty groups; such sets also use the least hashes of their prefix.  A set's signatures are the
hashes of its groups.  They travel once, packed by ranges of their values; the task of a range holds the distinct signatures
of that range and gives back those of two sets or more, exactly, at any size of the corpus.

*Bounding.*  The group counts of a set (with more dimensions for larger sets) are its point.  The points that share a
signature are indexed in an R-tree, whose boxes bound the overlap with a block of queries by the summed minima of the upper
corners of both; the trees of a single leaf in a task are searched at once.  Sets connected by pairs that survive the bound form a block, so that a common shingle alone
joins nothing.  Signatures with the same members are searched once.

*Verifying.*  In a block, pairs that survive the bound, and are not already connected, are verified exactly.  Signatures
and blocks of any size are spread over tasks (see ``crowds``), so that no task holds an unbounded group.

Edge cases: null and empty texts, and texts without words, have empty sets, no links and themselves as component; texts
with fewer words than a shingle are one shingle; null ids link like others and never become a component's id unless all
of it are null; repeated rows are copies; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, named_sets
from .crowds import connected, sides
from .storage import bit_map, discard, freed, in_bit_map, map_bits, small_batches, text_bytes, written
from .substring_dedup import rolled
from .words import lean, mix, pair, slices, string_parts, words_of

SHINGLE = 3
THRESHOLD = 90
MAX_DEPTH = 16
_U = np.uint64


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of consecutive texts, and the offsets of each text's set."""
    w = words_of(data, offsets, lower=True)
    docs = len(offsets) - 1
    n = w.counts
    h = w.hash(0)
    grams = rolled(h, size)
    starts = np.arange(len(grams))
    ends = np.repeat(w.at[1:], n)[: len(grams)]
    valid = starts + size <= ends
    owner = w.doc()[: len(grams)][valid]
    found = grams[valid]
    for d in np.flatnonzero((n > 0) & (n < size)):
        whole = h[w.at[d] : w.at[d] + 1]
        with np.errstate(over="ignore"):
            for i in range(1, n[d]):
                whole = pair(whole, h[w.at[d] + i : w.at[d] + i + 1], 70 + i)
            whole = mix(whole + _U(1000 + n[d]))
        place = np.searchsorted(owner, d)
        owner, found = np.insert(owner, place, d), np.insert(found, place, whole)
    at = np.searchsorted(owner, np.arange(docs + 1))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        found[a:b].sort()
    new = np.ones(len(found), dtype=bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    return found[new], np.searchsorted(owner[new], np.arange(docs + 1))


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, _U), np.cumsum(values)])
        return total[at[1:]] - total[at[:-1]]


def size_class(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(n, 1)) / np.log(1.5) + 1e-9).astype(np.int64)


def group_plan(c: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Groups G and spare groups E of each size class; the largest size of a class bounds the differences of its pairs."""
    largest = np.ceil(1.5 ** (c + 1.0) + 1e-6)
    differ = np.floor(2 * largest * (100 - threshold) / (100 + threshold)).astype(np.int64)
    spare = 2 + differ // 100
    return differ + 1 + spare, spare


def _signatures(u: np.ndarray, at: np.ndarray, c: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of sets within given size classes, with their owners."""
    n = np.diff(at)
    owner = np.repeat(np.arange(len(n)), n)
    g, spare = group_plan(c, threshold)
    with np.errstate(over="ignore"):
        part = ((u >> _U(32)) * g[owner].astype(_U)) >> _U(32)
        new = np.ones(len(u), dtype=bool)
        new[1:] = (part[1:] != part[:-1]) | (owner[1:] != owner[:-1])
        head = np.flatnonzero(new)
        total = _sums(mix(u ^ _U(0x1F2E3D4C5B6A7988)), np.append(head, len(u)))
        who = owner[head]
        sig = mix(total ^ mix(part[head] + _U(977) * c[who].astype(_U)))
        sparse = g - np.bincount(who, minlength=len(n)) > spare
        # two sets with many empty groups may have only those in common: they share one of their least hashes too
        if (sparse & (n > 0)).any():
            need = n - -(-threshold * n // 100) + 1
            rank = np.arange(len(u)) - np.repeat(at[:-1], n)
            first = sparse[owner] & (rank < need[owner])
            sig = np.concatenate([sig, mix(u[first] + _U(31) * c[owner[first]].astype(_U) + _U(5))])
            who = np.concatenate([who, owner[first]])
    return sig, who


def signatures(u: np.ndarray, at: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """All signatures of consecutive sets: those of the own size class, and of the next where a larger partner may be."""
    n = np.diff(at)
    c = size_class(n)
    up = size_class(n * 100 // threshold)
    sig, who = _signatures(u, at, c, threshold)
    more = np.flatnonzero((up > c) & (n > 0))
    if len(more):
        pick = np.repeat(np.isin(np.arange(len(n)), more), n)
        sub = np.concatenate([[0], np.cumsum(n[more])])
        sig2, who2 = _signatures(u[pick], sub, up[more], threshold)
        sig, who = np.concatenate([sig, sig2]), np.concatenate([who, more[who2]])
    return sig, who


class RTree:
    """Points (group counts) in nested boxes; a search yields those whose summed minima with a query may suffice."""

    LEAF = 32

    def __init__(self, points: np.ndarray, sizes: np.ndarray, threshold: int):
        self.points, self.sizes, self.threshold = points, sizes, threshold
        self.root = self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray):
        p, n = self.points[rows], self.sizes[rows]
        box = (p.max(axis=0), int(n.min()), int(n.max()))
        if len(rows) <= self.LEAF:
            return box, rows, None
        # sizes that can't link part best, then the widest range
        by = n if 100 * box[1] < self.threshold * box[2] else p[:, int((box[0] - p.min(axis=0)).argmax())]
        order = rows[np.argsort(by, kind="stable")]
        half = len(order) // 2
        return box, None, (self._build(order[:half]), self._build(order[half:]))

    def leaves(self) -> list[np.ndarray]:
        out, stack = [], [self.root]
        while stack:
            _, rows, below = stack.pop()
            if below:
                stack += below[::-1]
            else:
                out.append(rows)
        return out

    def search(self, block: np.ndarray) -> np.ndarray:
        """Rows whose boxes may hold partners of some row of a block."""
        t = self.threshold
        corner, low, high = self.points[block].max(axis=0), int(self.sizes[block].min()), int(self.sizes[block].max())
        out, stack = [], [self.root]
        while stack:
            (upper, least, most), rows, below = stack.pop()
            if 100 * high < t * least or 100 * most < t * low or np.minimum(corner, upper).sum(dtype=np.float64) * (100 + t) < t * (low + least):
                continue
            if below:
                stack += below
            else:
                out.append(rows)
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def count_points(u: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Points of consecutive sets: counts of their hashes in 2^d ranges, about 3 to 6 hashes each, 32 ranges at least."""
    n = np.diff(at)
    depth = np.clip(np.ceil(np.log2(np.maximum(n, 1) / 6)), 5, MAX_DEPTH).astype(np.int64)
    size = 1 << depth
    base = np.concatenate([[0], np.cumsum(size)])
    place = np.repeat(base[:-1], n) + (u >> np.repeat(64 - depth, n).astype(_U)).astype(np.int64)
    raw = np.bincount(place, minlength=base[-1]).astype("<u4").tobytes()
    return [raw[4 * a : 4 * b] for a, b in zip(base[:-1].tolist(), base[1:].tolist(), strict=True)]


def _folded(points: list[bytes]) -> np.ndarray:
    """Points of several depths at the least of them: neighbouring ranges add up."""
    counts = [np.frombuffer(p, "<u4").astype(np.int64) for p in points]
    least = min(len(c) for c in counts)
    return np.stack([c.reshape(least, -1).sum(axis=1) for c in counts])


def forest(left: np.ndarray, right: np.ndarray, search, verify) -> list[tuple[int, int]]:
    """A spanning forest of the links between ``left`` and ``right`` (row numbers; the same rows, or disjoint ones).

    Each row looks among the other side's rows that no tree has reached yet, so that a group whose rows all link is
    connected by a few searches.  ``search(row, of_left)`` gives candidates, ``verify(row, candidates)`` those that link.
    """
    reached = np.zeros(int(max(left.max(), right.max())) + 1, dtype=bool)
    both = left is right
    is_left = np.zeros(len(reached), dtype=bool)
    is_left[left] = True
    open_left, open_right = len(left), len(right)  # rows not reached
    out = []
    for seed in left.tolist():
        if reached[seed]:
            continue
        reached[seed] = True
        open_left -= 1
        open_right -= both
        queue = [seed]
        while queue:
            x = queue.pop()
            if not (open_right if is_left[x] else open_left):
                continue
            found = search(x, not is_left[x] or both)
            found = verify(x, found[~reached[found]])
            if len(found):
                reached[found] = True
                open_left -= len(found) if both or not is_left[x] else 0
                open_right -= len(found) if both or is_left[x] else 0
                out += [(x, y) for y in found.tolist()]
                queue += found.tolist()
        if both and not open_left:
            break
    return out


def _real(sizes: np.ndarray) -> type:
    """A kind of floats that holds counts of these sets, and their sums, exactly."""
    return np.float32 if not len(sizes) or sizes.max() < 1 << 24 else np.float64


def near(points: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: int, verify=None) -> list[tuple[int, int]]:
    """Pairs of row numbers that connect all pairs of ``left`` and ``right`` (the same rows, or disjoint ones; together all) that
    survive the bound, and ``verify(row, candidates)`` if given: a spanning forest.

    Rows are searched by blocks of one component, or of rows that stand alone, among all rows not searched yet of other
    components, so that a group whose rows all link is connected by a few searches."""
    points = points.astype(_real(sizes))
    n, both, tree = len(points), left is right, RTree(points, sizes, threshold)
    of_left = np.zeros(n, bool)
    of_left[left] = True
    least, ones = threshold * sizes, np.ones(points.shape[1], points.dtype)
    order, comp, out = np.concatenate(tree.leaves()), np.arange(n), []
    while len(order):
        own, seed, count = comp[order], order[0], np.bincount(comp, minlength=n)
        alone = count[comp[seed]] == 1
        block = order[count[own] == 1] if alone else order[own == comp[seed]]
        if not both:
            block = block[of_left[block] == of_left[seed]]
        waiting = np.zeros(n, bool)
        waiting[order] = True
        if not alone:
            waiting[comp == comp[seed]] = False
        if not both:
            waiting &= of_left != of_left[seed]
        if waiting.any():
            block = block[: tree.LEAF]
            found = tree.search(block)
            found = found[waiting[found]]
            candidates = points[found]
            for x in block.tolist() if len(found) else []:
                hits = found[(np.minimum(points[x], candidates) @ ones).astype(np.int64) * (100 + threshold) >= least[x] + least[found]]
                hits = hits[comp[hits] != comp[x]]
                if len(hits) and verify:
                    hits = verify(x, hits)
                if len(hits):
                    parts, at = np.unique(comp[hits], return_index=True)
                    out += [(x, y) for y in hits[at].tolist()]
                    comp[np.isin(comp, parts)] = comp[x]
        gone = np.zeros(n, bool)
        gone[block] = True
        order = order[~gone[order]]
    return out


def _shared(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many hashes of a set each of the others has."""
    flat = np.concatenate(others)
    at = np.searchsorted(own, flat)
    return np.add.reduceat((own[np.minimum(at, len(own) - 1)] == flat).astype(np.int64), np.concatenate([[0], np.cumsum([len(x) for x in others])[:-1]]))


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links between sets of ``left`` and of ``right`` (row numbers) that connect all that is linked: a spanning forest."""
    n = np.array([len(s) for s in sets])

    def verify(a: int, found: np.ndarray) -> np.ndarray:
        keep = []
        for i in range(0, len(found), 64):
            part = found[i : i + 64]
            both = _shared(sets[a], [sets[b] for b in part.tolist()])
            keep.append(part[100 * both >= threshold * (n[a] + n[part] - both)])
        return np.concatenate(keep)

    if len(sets) == 2:
        return [(0, 1)] if len(verify(0, np.array([1]))) else []
    return near(_folded([p for s in sets for p in count_points(s, np.array([0, len(s)]))]), n, left, right, threshold, verify)


def _pack(a: np.ndarray, b: np.ndarray) -> pa.Array:
    """Two uint64 columns as one 16-byte binary column."""
    raw = np.column_stack([a.astype(">u8"), b.astype(">u8")]).tobytes()
    return pa.array([raw[16 * i : 16 * i + 16] for i in range(len(a))], pa.binary())


def _sets_of(batch: pa.RecordBatch, size: int):
    for part, data, offsets in slices(batch, "t", 1 << 20):
        yield part, *shingle_sets(data, offsets, size)


def set_keys(u: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """64-bit and 128-bit key of each set."""
    with np.errstate(over="ignore"):
        short = _sums(mix(u ^ _U(0xA5A5)), at)
        return short, _pack(short, _sums(mix(u ^ _U(0x5A5A5A)), at) + np.diff(at).astype(_U))


#: Signatures of a range, about.
RANGE = 500_000


def repeated_signatures(rows: DataFrame, shingle: int, threshold: int, ranges: int) -> DataFrame:
    """(sig, k): the signatures that two different sets of the texts ``rows`` (t) or more have, with the keys of those sets.

    Signatures travel packed by range, 8 bytes each and 8 of their set; a range's task holds its distinct signatures, and
    passes those of another set on as they come."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, seen = [(np.zeros(0, _U), np.zeros(0, np.int64))], np.zeros(0, _U)
            for _, u, at in _sets_of(batch, shingle):
                k = set_keys(u, at)[0]
                fresh = np.zeros(len(k), bool)
                fresh[np.unique(k, return_index=True)[1]] = True
                fresh &= (np.diff(at) > 0) & ~np.isin(k, seen)
                seen = np.concatenate([seen, k[fresh]])
                sig, who = signatures(u[np.repeat(fresh, np.diff(at))], np.concatenate([[0], np.cumsum(np.diff(at)[fresh])]), threshold)
                held.append((sig, k[fresh].view(np.int64)[who]))
            sig, k = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(sig)
            sig, k = sig[order], k[order]
            place = ((sig >> _U(32)) * _U(ranges)) >> _U(32)
            cut = [*np.flatnonzero(np.append(True, place[1:] != place[:-1])[: len(place)]).tolist(), len(place)]
            packed = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array(place[cut[:-1]].astype(np.int32)), packed(sig), packed(k)], ["range", "sigs", "ks"])

    sent = rows.select("t").mapInArrow(lean(send), "range int, sigs binary, ks binary")
    return sent.repartition("range").sortWithinPartitions("range").mapInArrow(lean(_met_again), "sig long, k long")


def _met_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, seen = None, Seen()
    for batch in batches:
        place, i = batch.column("range").to_numpy(), 0
        while i < batch.num_rows:
            if place[i] != now:
                now, seen = place[i], Seen()
            j, sig, k = i, [], []
            while j < batch.num_rows and place[j] == now and sum(map(len, sig)) < RANGE:
                sig.append(np.frombuffer(batch.column("sigs")[j].as_py(), _U))
                k.append(np.frombuffer(batch.column("ks")[j].as_py(), np.int64))
                j += 1
            i = j
            sig, k = seen.add(np.concatenate(sig), np.concatenate(k))
            if len(sig):
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(k)], ["sig", "k"])


class Seen:
    """Distinct signatures met so far (sorted), the set that each was first met in, and whether that is its only one."""

    def __init__(self):
        self.sig, self.k, self.once = np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, sig: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """More signatures with their sets: those of two sets or more now, with all sets not passed on before."""
        order = np.lexsort((k, sig))
        sig, k = sig[order], k[order]
        head = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])[: len(sig)])
        place = np.searchsorted(self.sig, sig[head])
        new = np.ones(len(head), bool) if not len(self.sig) else self.sig[np.minimum(place, len(self.sig) - 1)] != sig[head]
        where = np.concatenate([self.sig, sig[head[new]]])
        order = np.argsort(where, kind="stable")
        self.sig, self.k = where[order], np.concatenate([self.k, k[head[new]]])[order]
        self.once = np.concatenate([self.once, np.ones(int(new.sum()), bool)])[order]
        at = np.searchsorted(self.sig, sig)
        other = np.unique(at[self.once[at] & (k != self.k[at])])
        again = ~self.once[at]
        self.once[other] = False
        now = ~self.once[at] & ~again & (k != self.k[at])
        out = again | now
        return np.concatenate([self.sig[other], sig[out]]), np.concatenate([self.k[other], k[out]])


def _by_task(find):
    """A link test for ``crowds`` of ``find(table, left, right)``, which gives pairs of row numbers of one task."""

    def link(t: pa.Table, borders: np.ndarray) -> np.ndarray:
        side, out = t["side"].to_numpy(), []
        for first, stop in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
            left, right = sides(side[first:stop])
            if stop - first > 1 and len(left) and len(right):
                out += [(a + first, b + first) for a, b in find(t.slice(first, stop - first), left, right)]
        return np.array(out, np.int64).reshape(-1, 2)

    return link


def _forest_of(pairs: np.ndarray) -> np.ndarray:
    """The numbers of those pairs that connect what all do."""
    parent, out = list(range(int(pairs.max()) + 1 if len(pairs) else 0)), []

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for at, (u, v) in enumerate(pairs.tolist()):
        a, b = find(u), find(v)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append(at)
    return np.array(out, np.int64)


def _leaf_pairs(borders: np.ndarray, small: np.ndarray) -> np.ndarray:
    """All pairs of rows of each task that is marked as small."""
    n, out = np.diff(borders), [np.zeros((0, 2), np.int64)]
    for size in np.unique(n[small & (n > 1)]).tolist():
        a, b = np.triu_indices(size, 1)
        first = borders[:-1][small & (n == size)][:, None]
        out.append(np.column_stack([(first + a).ravel(), (first + b).ravel()]))
    return np.concatenate(out)


def _near_in_leaves(t: pa.Table, pairs: np.ndarray, threshold: int) -> np.ndarray:
    """A spanning forest of the listed pairs that survive the bound; a pair of sets that meets in several tasks is held against it once."""
    k, sizes = t["k"].to_numpy(), t["n_shingles"].to_numpy()
    pairs = pairs[100 * np.minimum(sizes[pairs[:, 0]], sizes[pairs[:, 1]]) >= threshold * np.maximum(sizes[pairs[:, 0]], sizes[pairs[:, 1]])]
    if not len(pairs):
        return pairs
    used = np.unique(pairs)
    first, code = np.unique(k[used], return_index=True, return_inverse=True)[1:]
    place = np.zeros(len(k), np.int64)
    place[used] = code
    rows, pairs = used[first], np.sort(place[pairs], axis=1)
    pairs = np.unique(pairs[:, 0] * len(rows) + pairs[:, 1])
    pairs = np.column_stack([pairs // len(rows), pairs % len(rows)])
    data, at = string_parts(t["point"])
    counts = np.frombuffer(data[at[0] : at[-1]].tobytes(), "<u4")
    begin, width, sizes = (at[rows] - at[0]) // 4, (at[rows + 1] - at[rows]) // 4, sizes[rows]
    least, alive = np.minimum(width[pairs[:, 0]], width[pairs[:, 1]]), np.zeros(len(pairs), bool)
    for d in np.unique(least).tolist():
        which = np.flatnonzero(least == d)
        own, ends = np.unique(pairs[which], return_inverse=True)
        points, ends, ones = np.zeros((len(own), d), _real(sizes)), ends.reshape(-1, 2), np.ones(d, _real(sizes))
        for w in np.unique(width[own]).tolist():
            mine = np.flatnonzero(width[own] == w)
            for i in range(0, len(mine), step := max(1, (1 << 20) // w)):
                part = mine[i : i + step]
                points[part] = counts[begin[own[part]][:, None] + np.arange(w)].reshape(len(part), d, -1).sum(axis=2)
        for i in range(0, len(which), step := max(1, (1 << 18) // d)):
            a, b = ends[i : i + step].T
            both = (np.minimum(points[a], points[b]) @ ones).astype(np.int64)
            alive[which[i : i + step]] = both * (100 + threshold) >= threshold * (sizes[own[a]] + sizes[own[b]])
    pairs = pairs[alive]
    return rows[pairs[_forest_of(pairs)]]


def _bounded(threshold: int):
    """Tasks of up to a leaf's rows are searched together, others one after the other."""

    def link(t: pa.Table, borders: np.ndarray) -> np.ndarray:
        n = np.diff(borders)
        small = (n <= RTree.LEAF) & ~np.logical_or.reduceat(t["pivot"].to_numpy(zero_copy_only=False) | (t["side"].to_numpy() != 0), borders[:-1])
        out = [_near_in_leaves(t, _leaf_pairs(borders, small), threshold)]
        for i in np.flatnonzero(~small).tolist():
            out.append(large(t.slice(int(borders[i]), int(n[i])), np.array([0, n[i]])) + borders[i])
        return np.concatenate(out)

    large = _by_task(lambda t, left, right: near(_folded(t["point"].to_pylist()), t["n_shingles"].to_numpy(), left, right, threshold))
    return link


def _verified(threshold: int):
    def find(t: pa.Table, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
        return linked([np.frombuffer(x, _U) for x in t["shingles"].to_pylist()], left, right, threshold)

    return _by_task(find)


def _of_texts(rows: DataFrame, wanted: DataFrame, shingle: int, name: str, make) -> DataFrame:
    """A table (key, k, n_shingles, ``name``) of the sets ``wanted`` (key, h1), each once, with what ``make(hashes, offsets)`` gives for them.

    Texts stay where they are: a bit map of bounded size tells the tasks which of them may be wanted, and only results move."""
    spark = rows.sparkSession
    wanted = written(wanted.select("key", "h1"), "wanted")
    shared = spark.sparkContext.broadcast(bit_map(wanted, "h1", map_bits(wanted.count())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            hit = batch.filter(pa.array(in_bit_map(shared.value, batch.column("h1").to_numpy())))
            for _, u, at in _sets_of(hit, shingle):
                short, key = set_keys(u, at)
                fresh = []
                for i, x in enumerate(key.to_pylist()):
                    if x not in seen:
                        seen.add(x)
                        fresh.append(i)
                own = [key, pa.array(short.view(np.int64)), pa.array(np.diff(at).astype(np.int64)), pa.array(make(u, at), pa.binary())]
                yield pa.RecordBatch.from_arrays([c.take(pa.array(fresh, pa.int64())) for c in own], ["key", "k", "n_shingles", name])

    found = rows.select("h1", "t").mapInArrow(lean(run), f"key binary, k long, n_shingles long, {name} binary")
    once = found.join(wanted.select("key"), "key", "left_semi").groupBy("key").agg(*(F.first(c).alias(c) for c in ("k", "n_shingles", name)))
    out = written(once, f"{name}-of-texts", last=True)
    shared.destroy()
    discard(wanted)
    return out


def jaccard_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, threshold: int = THRESHOLD, slice_rows: int = 2000, slice_shingles: int = 1_500_000, ranges: int | None = None, row: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``; with a ``row`` key (long, of its own for each row), that and the
    component's ``root`` too (null where empty)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t"), (F.col(row) if row else F.lit(0)).cast("long").alias("row"))
    rows = rows.withColumn("h1", F.xxhash64("t"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, u, at in _sets_of(batch, shingle):
                short, key = set_keys(u, at)
                own = [part.column(c) for c in ("row", "doc_id", "h1")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(at).astype(np.int64)), key, pa.array(short.view(np.int64))], ["row", "doc_id", "h1", "n_shingles", "key", "k"])

    described = written(rows.mapInArrow(lean(describe), "row long, doc_id long, h1 long, n_shingles long, key binary, k long"), "set-keys")
    # one text of each set; k, half of the key, names sets until they are verified: equal halves of different sets only share a block
    firsts = described.where("n_shingles > 0").groupBy("key").agg(F.min(F.struct("h1", "k", "n_shingles")).alias("x"), F.min("doc_id").alias("least"))
    firsts = written(firsts.select("key", "x.*", "least"), "distinct-sets")
    # words have some six bytes; a set has one group for each difference of its largest class, and half of the sets two plans
    ranges = ranges or max(1, int(text_bytes(rows, "t") * 4.5 * (100 - threshold) / (100 + threshold) / 6 / RANGE))
    met = written(repeated_signatures(rows, shingle, threshold, ranges), "repeated-signatures", last=True)
    freed(spark)  # the shuffle of all signatures goes before the next pass
    # rows, extremes and sum of hashes tell groups of members apart
    groups = met.groupBy("sig").agg(F.count("*").alias("n"), F.min("k").alias("v"), F.max("k").alias("w"), F.sum(F.xxhash64("k").cast("decimal(20,0)")).alias("x"))
    groups = groups.groupBy("n", "v", "w", "x").agg(F.min("sig").alias("sig")).select("sig")
    members = written(met.join(groups, "sig").distinct().select("k", F.col("sig").alias("g"), F.lit(1).alias("weight")), "meetings", last=True)
    discard(met)

    # points are a small part of the sets, which only those in blocks need
    points = _of_texts(rows, firsts.join(members.select("k").distinct(), "k", "left_semi"), shingle, "point", count_points)
    blocks = components(connected(members, points.select("k", "n_shingles", "point"), _bounded(threshold), limit=slice_rows))
    blocks = written(blocks.select(F.col("node").alias("k"), F.col("root").alias("g")), "blocks")
    for table in (points, members):
        discard(table)
    freed(spark)
    placed = written(firsts.join(blocks, "k"), "placed")
    content = lambda u, at: [u[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    full = _of_texts(rows, placed, shingle, "shingles", content)
    weighed = written(placed.groupBy("k", "g").agg(F.sum("n_shingles").alias("weight")), "weighed-blocks")
    groups = components(connected(weighed, full, _verified(threshold), node="key", limit=slice_rows, heavy=slice_shingles))

    named = named_sets(firsts, groups)
    columns = ["doc_id", "n_shingles", "component_id", *(["row", "root"] if row else [])]
    full = described.where("n_shingles > 0").join(named, "key").select(*columns)
    empty = described.where("n_shingles = 0").withColumns({"component_id": F.col("doc_id"), "root": F.lit(None).cast("binary")}).select(*columns)
    return full.union(empty)


def op8_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def brute_force(ids: list[int], texts: list[str | None], shingle: int = SHINGLE, threshold: int = THRESHOLD) -> list[tuple[int, int, int]]:
    """The same by definition, for tests."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(fold))
        grams = [tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] or ([tuple(w)] if w else [])
        sets.append(frozenset(grams))
    by_set: dict = {}
    for i, s in enumerate(sets):
        by_set.setdefault(s, []).append(i)
    kinds = [s for s in by_set if s]
    parent = list(range(len(kinds)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(kinds):
        for j in range(i):
            b = kinds[j]
            if min(len(a), len(b)) * 100 >= threshold * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= threshold * (len(a) + len(b) - both) and find(i) != find(j):
                    parent[find(i)] = find(j)
    least: dict = {}
    for i, s in enumerate(kinds):
        r = find(i)
        least[r] = min([least.get(r, float("inf")), *(ids[k] for k in by_set[s])])
    where = {s: least[find(i)] for i, s in enumerate(kinds)}
    return [(i, len(s), where.get(s, i)) for i, s in zip(ids, sets, strict=True)]


SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT r, doc_id, list_distinct(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
e AS (SELECT r, len(g) AS n, unnest(g) AS x FROM s),
p AS (SELECT a.r AS u, b.r AS v FROM e a JOIN e b ON a.x = b.x AND a.r < b.r AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
two_way AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p),
reach(r, t) AS (SELECT r, r FROM s UNION SELECT reach.r, two_way.v FROM reach JOIN two_way ON reach.t = two_way.u)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, c.component_id
FROM s JOIN (SELECT reach.r, min(o.doc_id) AS component_id FROM reach JOIN s o ON o.r = reach.t GROUP BY reach.r) c USING (r)
"""
