"""Hidden Markov language model: Baum-Welch on Spark, exact likelihoods by the scaled forward recursion.

A text is its lower-cased words and one end token; hidden states emit words.  The odds of a word in a state are
(expected count + 1/K) / (expected tokens of the state + (V + 1)/K) for K states and V distinct tokens, where the spare
one stands for all unknown words; with one state these are the add-one unigram odds of ``base_score``.

*Training.*  Every round is a pass over all training texts.  In the first ``init_rounds`` words of one hash class (of
2^CLASS_BITS) share their odds, from a seeded model; their counts are summed over partitions.  The next round keeps the
expected counts of every word, and up to ``rounds`` more begin with every word's own odds, until the log likelihood gains
less than ``settled`` of itself.  Texts are held in written chunks with local word numbers; a chunk has the expected
counts of its own words, in whole parts of 1/FIXED so that sums do not depend on their order.  A window over each word's
hash sums them over all chunks, and the sums of words that several chunks hold return to these chunks by a shuffle.

*Scoring.*  The same sums give each chunk the odds of its words for the exact forward likelihood.  No table of words is
ever broadcast or collected.

Long texts are cut into segments whose transfer matrices are chained, which keeps the recursion exact and its Python
loop short.  Words are identified by 64-bit hashes.  A word has at most one row per chunk of ``CHUNK`` bytes of text in
the window's group.

Edge cases: null and empty texts are one end token; a null id is trained on and not held out; without training texts
all counts are 0 (N = V = 0) and the model is uniform; repeated rows count each time; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .storage import discard, small_batches, written
from .words import lean, slices, words_of

STATES = 4
CLASS_BITS = 12
SEGMENT = 512
CHUNK = 8 << 20
FIXED = 1 << 20
_U = np.uint64
_AT_ONCE = 300_000  # tokens whose forward and backward vectors are held together
END = 1 << CLASS_BITS  # class of the end token


def class_of(h: np.ndarray) -> np.ndarray:
    return (h >> _U(64 - CLASS_BITS)).astype(np.int32)


def sequences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of consecutive texts, their offsets, and the classes of all tokens with each text's end."""
    w = words_of(data, offsets, lower=True)
    h = w.hash(0)
    return h, w.at, np.insert(class_of(h), w.at[1:], END)


def hashed(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the texts (column t) of a batch and their offsets, read in small slices to hold little at a time."""
    found, counts = [], []
    for _, data, offsets in slices(part, "t", 1 << 20):
        w = words_of(data, offsets, lower=True)
        found.append(w.hash(0))
        counts.append(w.counts)
    at = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64)
    return np.concatenate(found), at


class _Plan:
    """Segments of sequences in order of falling size, and their tokens step by step: first tokens, second ones and so on."""

    def __init__(self, at: np.ndarray):
        n = np.diff(at)
        parts = np.maximum(1, -(-n // SEGMENT))
        doc = np.repeat(np.arange(len(n)), parts)
        rank = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = at[:-1][doc] + rank * SEGMENT
        size = np.minimum(SEGMENT, at[1:][doc] - begin)
        order = np.argsort(-size, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.before = np.append(-1, place)[:-1][order]  # the segment before, of the same sequence where rank > 0
        self.doc, self.rank, self.size = doc[order], rank[order], size[order]
        self.active = len(size) - np.searchsorted(self.size[::-1], np.arange(self.size[0] if len(size) else 0), side="right")
        self.offset = np.concatenate([[0], np.cumsum(self.active)])
        step = np.repeat(np.arange(len(self.active)), self.active)
        self.slot = np.arange(len(step)) - self.offset[step]
        self.token = begin[order][self.slot] + step
        self.previous = (self.offset[step - 1] + self.slot)[len(size) :]  # of tokens from the second step on
        self.several = np.flatnonzero(np.bincount(doc, minlength=len(n))[self.doc] > 1)
        self.by_rank = [np.flatnonzero(self.rank == r) for r in range(1, int(rank.max(initial=0)) + 1)] if len(self.several) else []
        self.at_several = np.full(len(order), -1)
        self.at_several[self.several] = np.arange(len(self.several))


class Hmm:
    """start (K), move (K, K), emit (symbols, K)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    def _odds(self, plan: _Plan, sym: np.ndarray) -> np.ndarray:
        return np.take(np.ascontiguousarray(self.emit.T), sym[plan.token], axis=1)

    def _transfer(self, plan: _Plan, odds: np.ndarray) -> np.ndarray:
        """Scaled products of (move diag(odds)) over each segment of ``plan.several``, without the first move."""
        k, pick = len(self.start), plan.several
        out = np.repeat(np.eye(k)[:, :, None], len(pick), axis=2)
        for t, n in enumerate(plan.active):
            m = int(np.searchsorted(pick, n))
            if not m:
                break
            e = odds[:, plan.offset[t] + pick[:m]]
            now = out[:, :, :m] if t == 0 else np.matmul(self.move.T, out[:, :, :m])
            now = now * e[None]
            out[:, :, :m] = now / now.sum(axis=(0, 1))
        return out

    def _priors(self, plan: _Plan, transfer: np.ndarray) -> np.ndarray:
        """State odds before the first token of each segment."""
        prior = np.repeat(self.start[:, None], len(plan.size), axis=1)
        for here in plan.by_rank:
            end = np.einsum("in,ijn->jn", prior[:, plan.before[here]], transfer[:, :, plan.at_several[plan.before[here]]])
            prior[:, here] = self.move.T @ (end / end.sum(axis=0))
        return prior

    def _forward(self, plan: _Plan, odds: np.ndarray, prior: np.ndarray, keep: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Scale of each token, and with ``keep`` the scaled forward vectors."""
        scale, alpha, back = np.empty(odds.shape[1]), np.empty_like(odds) if keep else None, np.ascontiguousarray(self.move.T)
        a = prior
        for t, n in enumerate(plan.active):
            s = plan.offset[t]
            a = (a[:, :n] if t == 0 else back @ a[:, :n]) * odds[:, s : s + n]
            z = a.sum(axis=0)
            a /= z
            scale[s : s + n] = z
            if keep:
                alpha[:, s : s + n] = a
        return scale, alpha

    def forward(self, sym: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log likelihood of each sequence."""
        total = np.zeros(len(at) - 1)
        for a, b in _ranges(at):
            plan = _Plan(at[a : b + 1] - at[a])
            odds = self._odds(plan, sym[at[a] : at[b]])
            prior = self._priors(plan, self._transfer(plan, odds) if len(plan.several) else odds)
            scale, _ = self._forward(plan, odds, prior, False)
            total[a:b] = np.bincount(plan.doc[plan.slot], weights=np.log(scale), minlength=b - a)
        return total

    def counts(self, sym: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Expected counts of starts, moves and emissions, flat."""
        return self.expected(sym, at)[0]

    def expected(self, sym: np.ndarray, at: np.ndarray, kinds: np.ndarray | None = None, size: int | None = None) -> tuple[np.ndarray, float]:
        """The expected counts, and the log likelihood of all sequences; emissions by ``kinds`` (below ``size``) in place of symbols."""
        k = len(self.start)
        kinds, size = (sym, len(self.emit)) if kinds is None else (kinds, size)
        starts, moves, emitted, log = np.zeros(k), np.zeros((k, k)), np.zeros((k, size)), 0.0
        for a, b in _ranges(at):
            some = slice(at[a], at[b])
            one = self._expected(sym[some], at[a : b + 1] - at[a], kinds[some], size)
            for whole, part in zip((starts, moves, emitted), one, strict=False):
                whole += part
            log += one[3]
        return np.concatenate([starts, moves.ravel(), emitted.T.ravel()]), log

    def _expected(self, sym, at, kinds, size):
        plan = _Plan(at)
        odds = self._odds(plan, sym)
        transfer = self._transfer(plan, odds) if len(plan.several) else odds
        scale, alpha = self._forward(plan, odds, self._priors(plan, transfer), True)
        last = np.ones((len(self.start), len(plan.size)))
        for here in reversed(plan.by_rank):
            back = self.move @ np.einsum("ijn,jn->in", transfer[:, :, plan.at_several[here]], last[:, here])
            last[:, plan.before[here]] = back / back.sum(axis=0)
        beta, w, m = np.empty_like(odds), None, 0
        for t in range(len(plan.active) - 1, -1, -1):
            s, n = plan.offset[t], plan.active[t]
            now = beta[:, s : s + n]
            now[:, m:] = last[:, m:n]
            if m:
                now[:, :m] = self.move @ w
            w = odds[:, s : s + n] * now
            w /= w.sum(axis=0)
            m = n
        odds *= beta  # odds of each token and all after it, by state
        beta *= alpha
        beta /= beta.sum(axis=0)
        moves = np.zeros_like(self.move)
        first = np.flatnonzero(plan.rank > 0)
        for now, before in (
            (odds[:, len(plan.size) :], alpha[:, plan.previous]),
            (odds[:, first], alpha[:, plan.offset[plan.size[plan.before[first]] - 1] + plan.before[first]]),
        ):
            z = ((self.move.T @ before) * now).sum(axis=0)
            moves += (before / z) @ now.T
        kind = kinds[plan.token]
        emitted = np.stack([np.bincount(kind, weights=g, minlength=size) for g in beta])
        starts = beta[:, : len(plan.size)][:, plan.rank == 0].sum(axis=1)
        return starts, moves * self.move, emitted, float(np.log(scale).sum())

    @staticmethod
    def from_counts(x: np.ndarray, share: np.ndarray, k: int) -> "Hmm":
        """The next model; a unit of prior mass keeps every odd positive."""
        start = x[:k] + 1.0 / k
        move = x[k : k + k * k].reshape(k, k) + 1.0 / k
        emit = x[k + k * k :].reshape(-1, k) + share[:, None]
        return Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def _ranges(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of sequences of about ``_AT_ONCE`` tokens together, one sequence at least."""
    a, n = 0, len(at) - 1
    while a < n:
        b = min(n, max(a + 1, int(np.searchsorted(at, at[a] + _AT_ONCE, side="right")) - 1))
        yield a, b
        a = b


def seeded(share: np.ndarray, k: int, seed: int) -> Hmm:
    rng = np.random.default_rng(seed)
    emit = share[:, None] * rng.uniform(0.5, 1.5, (len(share), k))
    stay = 0.98 if k > 1 else 1.0
    move = np.full((k, k), (1 - stay) / max(k - 1, 1))
    np.fill_diagonal(move, stay)
    return Hmm(np.full(k, 1.0 / k), move, emit / emit.sum(axis=0))


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers by byte planes, compressed."""
    return zstd.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def _unpacked(raw: bytes, kind) -> np.ndarray:
    plain = np.frombuffer(zstd.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(plain.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _names(k: int) -> list[str]:
    return [f"x{j}" for j in range(k - 1)]


_FIELDS = ["rows", "at", "train", "local", "words", "n", "x", "stats"]
_KINDS = "at binary, train binary, local binary, words binary, n binary, x binary, stats array<double>"


class _Chunk:
    """Texts of one chunk: offsets and local numbers of their tokens (the end token's follows those of the words), the training
    ones among them, the words' hashes, and the training counts and expected counts of these words within the chunk."""

    def __init__(self, at: np.ndarray, train: np.ndarray, local: np.ndarray, words: np.ndarray):
        self.at, self.train, self.local, self.words = at, train, local, words
        self.tokens, self.sym = at + np.arange(len(at)), np.insert(local, at[1:], len(words))
        inside = np.repeat(train, np.diff(at))
        self.n = np.bincount(local[inside], minlength=len(words)).astype(np.int64)

    def expect(self, hmm: Hmm, symbols: np.ndarray) -> None:
        """Expected counts of the training texts by a model over ``symbols`` (by local number), and their totals."""
        k, size = len(hmm.start), len(self.words) + 1
        inside = np.repeat(self.train, np.diff(self.tokens))
        kinds, at = self.sym[inside], np.concatenate([[0], np.cumsum(np.diff(self.tokens)[self.train])])
        x, log = hmm.expected(symbols[kinds], at, kinds, size)
        by_word = x[k + k * k :].reshape(-1, k)
        self.x = np.zeros((k - 1, size - 1), np.int64)
        left = self.n * FIXED
        for j in range(k - 1):
            self.x[j] = np.minimum(np.floor(by_word[:-1, j] * FIXED), left)
            left = left - self.x[j]
        mass = np.append(self.x.sum(axis=1), left.sum()) / FIXED
        self.stats = np.concatenate([x[: k + k * k], by_word[-1], mass, [at[-1], (self.n > 0).sum(), log]])

    def batch(self, rows: pa.Array) -> pa.RecordBatch:
        blobs = [_packed(self.at.astype(np.int64)), np.packbits(self.train).tobytes(), _packed(self.local.astype(np.uint32)), _packed(np.diff(self.words, prepend=_U(0))), _packed(self.n), _packed(self.x)]
        return pa.RecordBatch.from_arrays([rows, *(pa.array([b], pa.binary()) for b in blobs), pa.array([self.stats])], _FIELDS)

    @staticmethod
    def read(r: dict, k: int) -> "_Chunk":
        at = _unpacked(r["at"], np.int64)
        train = np.unpackbits(np.frombuffer(r["train"], np.uint8), count=len(at) - 1).astype(bool)
        out = _Chunk(at, train, _unpacked(r["local"], np.uint32).astype(np.int64), _hashes(r["words"]))
        out.x = _unpacked(r["x"], np.int64).reshape(k - 1, -1) if k > 1 else np.zeros((0, len(out.words)), np.int64)
        return out


def _hashes(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(raw, _U), dtype=_U)


def _chunks(docs: DataFrame, text: str, train: Column, carry: tuple[str, ...], hmm: Hmm) -> DataFrame:
    """Written chunks of all rows, with the expected counts of the training texts by classes of words."""
    row = F.struct(*carry) if carry else F.struct(F.lit(0).alias("none"))
    rows = docs.select(row.alias("row"), F.col(text).cast("string").alias("t"), F.coalesce(train, F.lit(False)).alias("train"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in slices(batch, "t", CHUNK):
                h, at = hashed(part)
                words, local = np.unique(h, return_inverse=True)
                c = _Chunk(at, part.column("train").to_numpy(zero_copy_only=False).astype(bool), local, words)
                c.expect(hmm, np.append(class_of(words), END))
                own = part.column("row")
                yield c.batch(pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own))

    found = rows.mapInArrow(lean(build), f"rows array<{rows.schema['row'].dataType.simpleString()}>, {_KINDS}")
    return written(found.withColumn("chunk", F.monotonically_increasing_id()), "chunks")


def _pairs(chunks: DataFrame, k: int) -> DataFrame:
    """A row (w, chunk, i, n, x0, ...) for each word of each chunk."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                w, n = _hashes(r["words"]).view(np.int64), _unpacked(r["n"], np.int64)
                x = _unpacked(r["x"], np.int64).reshape(k - 1, -1) if k > 1 else []
                i = np.arange(len(w), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in (w, np.full(len(w), r["chunk"]), i, n, *x)], ["w", "chunk", "i", "n", *_names(k)])

    kinds = "".join(f", {x} long" for x in _names(k))
    return chunks.select("chunk", "words", "n", "x").mapInArrow(lean(spread), f"w long, chunk long, i int, n long{kinds}")


class LanguageModel:
    """The trained model: start and move odds in ``hmm``, the expected counts of words in the written ``chunks``, those of the
    end token and of all tokens of each state in ``end`` and ``mass``."""

    def __init__(self, docs: DataFrame, text: str = "text", train: Column | None = None, carry: tuple[str, ...] = (), states: int = STATES, rounds: int = 0, init_rounds: int = 4, seed: int = 5, settled: float = 1e-3):
        self.spark, self.text, self.k = docs.sparkSession, text, states
        small_batches(self.spark)
        train = F.lit(True) if train is None else train
        rows = docs.where(train).select(F.col(text).cast("string").alias("t"))
        share = np.full(END + 1, 1.0 / (END + 1))
        self.hmm = seeded(share, states, seed)
        self.likelihoods: list[float] = []
        for _ in range(init_rounds):
            self.hmm = Hmm.from_counts(self._expected(rows), share, states)
        self.seen = self.hmm  # the classes' model
        self.chunks = _chunks(docs, text, train, carry, self.hmm)
        self._maximise()
        self.sums = self._summed(_pairs(self.chunks, states))
        multi = self.sums.agg(F.count_if("own").alias("own"), F.count_if(F.col("lead") & (F.col("n") > 0)).alias("words")).first()
        self.words = self.own - multi["own"] + multi["words"] + (self.ends > 0)
        for _ in range(rounds if self.tokens else 0):
            self._round()
            if len(self.likelihoods) > 2 and self.likelihoods[-1] - self.likelihoods[-2] < settled * abs(self.likelihoods[-2]):
                break

    def _expected(self, rows: DataFrame) -> np.ndarray:
        """Baum-Welch counts of all texts, summed over partitions."""
        shared = self.spark.sparkContext.broadcast(self.hmm)
        size = self.k * (1 + self.k + END + 1)
        pieces = 8

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hmm, total = shared.value, np.zeros(size)
            for batch in batches:
                for part, _, _ in slices(batch, "t", CHUNK // 2):
                    h, at = hashed(part)
                    total += hmm.counts(np.insert(class_of(h), at[1:], END), at + np.arange(len(at)))
            for i, piece in enumerate(np.array_split(total, pieces)):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([piece.tobytes()], pa.binary())], ["piece", "x"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for b in batches:
                for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    held[i] = held.get(i, 0) + np.frombuffer(x)
            for i, x in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["piece", "x"])

        kind = "piece int, x binary"
        parts = rows.mapInArrow(lean(expect), kind).repartition("piece").mapInArrow(lean(add), kind).collect()
        whole = [np.frombuffer(r["x"]) for r in sorted(parts, key=lambda r: r["piece"])]
        return np.concatenate(whole) if whole else np.zeros(size)

    def _maximise(self) -> None:
        """The next model of starts and moves, and the totals of states, from the chunks' sums."""
        k = self.k
        found = self.chunks.select(F.posexplode("stats").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
        total = np.zeros(3 * k + k * k + 3)
        for r in found:
            total[r["i"]] = r["x"]
        start, move = total[:k] + 1.0 / k, total[k : k + k * k].reshape(k, k) + 1.0 / k
        self.hmm = Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), np.zeros((0, k)))
        self.end, mass = total[k + k * k : 2 * k + k * k], total[2 * k + k * k : 3 * k + k * k]
        self.mass, self.ends = mass + self.end, int(round(self.end.sum()))
        self.tokens, self.own = int(total[-3]), int(total[-2])
        self.likelihoods.append(float(total[-1]))

    def _summed(self, pairs: DataFrame, asked: str = "true") -> DataFrame:
        """Sums over all chunks for the words of the ``asked`` chunks that others hold too: to, i, n, x0, ..., and whether the
        chunk's training texts have the word (``own``) and whether it is the word's first chunk (``lead``)."""
        one = Window.partitionBy("w")
        sums = {x: F.sum(x).over(one) for x in ("n", *_names(self.k))}
        found = pairs.withColumns({"own": F.col("n") > 0, "several": F.count("*").over(one) > 1, "lead": F.min("chunk").over(one) == F.col("chunk"), **sums})
        found = found.where(F.col("several") & F.expr(asked)).select(F.col("chunk").alias("to"), "i", "n", *_names(self.k), "own", "lead")
        return written(found, "word-sums")

    def _given(self):
        """What a chunk's task needs besides the chunk and the sums."""
        k, hmm, end, mass, v = self.k, self.hmm, self.end, self.mass, self.words

        def model(c: _Chunk, sums: pa.Table) -> tuple[Hmm, np.ndarray]:
            """The model over the chunk's words and the end token, and the words' counts in the training texts."""
            i, n, x = sums["i"].to_numpy(), c.n.copy(), c.x.copy()
            n[i] = sums["n"].to_numpy()
            for j, name in enumerate(_names(k)):
                x[j, i] = sums[name].to_numpy()
            counts = np.vstack([x, n * FIXED - x.sum(axis=0)]).T / FIXED
            return Hmm(hmm.start, hmm.move, (np.vstack([counts, end]) + 1 / k) / (mass + (v + 1) / k)), n

        return model

    def _meet(self, chunks: DataFrame, sums: DataFrame, run, schema: str) -> DataFrame:
        """``run`` over each chunk (a record, its _Chunk, and the rows of sums that go to it); tables."""
        k, empty = self.k, to_arrow_schema(StructType.fromDDL(schema)).empty_table()

        def each(left: pa.Table, right: pa.Table) -> pa.Table:
            out = []
            for b in left.to_batches():
                for j in range(b.num_rows):
                    r = {f: b.column(f)[j].as_py() for f in ("chunk", *_FIELDS[1:-1])}
                    out.append(run(r["chunk"], b.column("rows").slice(j, 1), _Chunk.read(r, k), right))
            return pa.concat_tables(out) if out else empty

        return chunks.groupBy("chunk").cogroup(sums.select("to", "i", "n", *_names(k)).groupBy("to")).applyInArrow(each, schema)

    def _round(self) -> None:
        """One more Baum-Welch pass over all training texts, words being the symbols."""
        model = self._given()
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self.chunks.schema)

        def run(chunk: int, rows: pa.Array, c: _Chunk, sums: pa.Table) -> pa.Table:
            hmm, _ = model(c, sums)
            c.expect(hmm, np.arange(len(c.words) + 1))
            b = c.batch(rows)
            return pa.Table.from_arrays([*b.columns, pa.array([chunk])], [*b.schema.names, "chunk"])

        old = self.chunks, self.sums
        self.chunks = written(self._meet(*old, run, schema), "chunks")
        for table in old:
            discard(table)
        self._maximise()
        self.sums = self._summed(_pairs(self.chunks, self.k))

    def scored(self, fields: StructType) -> DataFrame:
        """The ``carry`` columns (their types: ``fields``) of all rows that the model was made from, with n_tokens, n_known,
        train_tokens, base_score and score."""
        return self._scores(self.chunks, self.sums, fields)

    def score(self, docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
        """The same for the rows of any ``docs``."""
        chunks = _chunks(docs, self.text, F.lit(False), carry, self.seen).withColumn("chunk", -1 - F.col("chunk"))
        pairs = _pairs(self.chunks, self.k).unionByName(_pairs(chunks, self.k))
        return self._scores(chunks, self._summed(pairs, "chunk < 0"), docs.select(*carry).schema)

    def _scores(self, chunks: DataFrame, sums: DataFrame, fields: StructType) -> DataFrame:
        model, ends, n, base = self._given(), self.ends, self.tokens, np.log10(self.tokens + self.words + 1)

        def run(chunk: int, rows: pa.Array, c: _Chunk, sums: pa.Table) -> pa.Table:
            hmm, count = model(c, sums)
            size = np.diff(c.tokens)
            doc = np.repeat(np.arange(len(size)), size - 1)
            plain, seen = (np.bincount(doc, weights=x[c.local], minlength=len(size)) for x in (np.log10(count + 1), count > 0))
            items = rows.flatten()
            own = {f.name: items.field(f.name) for f in items.type}
            own |= {
                "n_tokens": pa.array(size),
                "n_known": pa.array((np.rint(seen) + (ends > 0)).astype(np.int64)),
                "train_tokens": pa.array(np.full(len(size), n, np.int64)),
                "base_score": pa.array(plain + np.log10(ends + 1) - size * base),
                "score": pa.array(hmm.forward(c.sym, c.tokens) / np.log(10)),
            }
            return pa.table(own)

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        return self._meet(chunks, sums, run, f"{kinds}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def op9_hmm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id")))
    carry = ("doc_id", "held_out")
    return LanguageModel(docs, train=~F.col("held_out"), carry=carry).scored(docs.select(*carry).schema)
