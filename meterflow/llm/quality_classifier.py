"""Quality classifier: ordinal regression with cumulative links on graded ratings.

A document's rating is one of ordered grades.  One weight vector over hashed text features is shared by all grades;
ordered thresholds turn its score into P(grade > k) = sigmoid(score - threshold[k]).  From these come the expected
grade and the tail probability P(grade >= select), which selects documents.

Features of the *whole* text, each present or not, so that a few telling words show in long texts too: the hashed
lower-cased words without punctuation, the first 4, 5 and 6 bytes of each (stems of inflected words), the shape of each
word as written (capitals, closing punctuation), and in eighths the shares of words of odd shapes.  Only features of at least ``min_df`` training documents have a
weight.

The fit uses at most ``max_train`` labelled rows (a documented bound; those with the smallest hashes of doc_id), gathered
in one task as lists of features; labelled texts of over ``max_bytes`` take no part in the fit.  Scoring reads all rows.

Edge cases: null and empty texts have no feature and get the model's intercept; labels with a null rating or null id are
not used; ids labelled twice count twice; documents without label are scored alike; null ids are scored; without any
usable label every grade is equally likely; extra columns of ``docs`` are carried, clashing ones replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import set_aside, small_batches
from .words import _LOWER, distinct, lean, mix, slices, words_of

BITS = 22
GRADES = 3
PREFIXES = (4, 5, 6)
_EDGE = np.zeros(256, dtype=bool)
_EDGE[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_PLAIN = np.zeros(256, dtype=bool)
_PLAIN[[ord(c) for c in ".,;:"]] = True


def _starts(w, k: int) -> np.ndarray:
    """Hashes of the first k bytes of the words that have as many."""
    at = w.start[w.end - w.start >= k]
    with np.errstate(over="ignore"):
        out = np.full(len(at), 0x9E3779B97F4A7C15 + k, dtype=np.uint64)
        for j in range(k):
            out = (out ^ w.data[at + j]) * np.uint64(0x100000001B3)
            out ^= out >> np.uint64(29)
    return mix(out)


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of consecutive texts: codes, and the offsets of each text's codes."""
    docs = len(offsets) - 1
    w = words_of(data, offsets)
    if not len(w.start):
        return np.zeros(0, np.int32), np.zeros(docs + 1, np.int64)
    last, first = w.data[w.end - 1], w.data[w.start]
    body = _LOWER[w.data]
    body[_EDGE[body]] = 32  # punctuation separates, so that bare words are hashed
    bare = words_of(body, w.offsets)
    capital = ((first >= 65) & (first <= 90)).astype(np.uint64) + 2 * ((last >= 65) & (last <= 90)).astype(np.uint64)
    shape = mix(np.where(_EDGE[last], last, 0).astype(np.uint64) * np.uint64(8) + capital + np.uint64(977))
    doc, length = bare.doc(), bare.end - bare.start
    codes, owners = [shape, bare.hash(1)], [w.doc(), doc]
    count = np.maximum(w.counts, 1)
    owner = w.doc()
    odd = _EDGE[last] & ~_PLAIN[last]
    for kind, marks in enumerate((odd, (capital >= 2), w.end - w.start == 1, odd & (w.end - w.start == 1))):
        share = np.bincount(owner, weights=marks, minlength=docs) / count
        codes.append(mix((np.ceil(np.minimum(share, 1.0) * 8) + 100 * kind + 7000).astype(np.uint64)))
        owners.append(np.arange(docs))
    for k in PREFIXES:
        codes.append(_starts(bare, k))
        owners.append(doc[length >= k])
    code = np.concatenate(codes) >> np.uint64(64 - bits)
    both = distinct(np.concatenate(owners).astype(np.uint64) << np.uint64(bits) | code)
    at = np.searchsorted(both, np.arange(docs + 1, dtype=np.uint64) << np.uint64(bits))
    return (both & np.uint64((1 << bits) - 1)).astype(np.int32), at


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


class Model:
    """Shared weights and ordered thresholds."""

    def __init__(self, weight: np.ndarray, cut: np.ndarray, trained: bool = True):
        self.weight, self.cut, self.trained = weight, cut, trained

    def score(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(self.weight[codes], dtype=np.float64)])
        return total[at[1:]] - total[at[:-1]]

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k."""
        return sigmoid(score[:, None] - self.cut[None, :])


def loss_and_slopes(score: np.ndarray, grade: np.ndarray, cut: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log likelihood of the grades and its derivatives by score and by threshold."""
    n, k = len(score), len(cut)
    above = np.column_stack([np.ones(n), sigmoid(score[:, None] - cut[None, :]), np.zeros(n)])
    slope = above * (1 - above)
    rows = np.arange(n)
    p = np.maximum(above[rows, grade] - above[rows, grade + 1], 1e-12)
    by_score = -(slope[rows, grade] - slope[rows, grade + 1]) / p / n
    by_cut = np.zeros(k)
    np.add.at(by_cut, np.clip(grade - 1, 0, k - 1), np.where(grade > 0, slope[rows, grade] / p / n, 0))
    np.add.at(by_cut, np.clip(grade, 0, k - 1), np.where(grade < k, -slope[rows, grade + 1] / p / n, 0))
    return float(-np.log(p).mean()), by_score, by_cut


def fit(codes: np.ndarray, at: np.ndarray, grade: np.ndarray, grades: int = GRADES, bits: int = BITS, min_df: int = 30, steps: int = 200, l2: float = 3e-3, rate: float = 0.1) -> Model:
    """Adam on the whole sample; thresholds stay ordered (a first one plus positive gaps)."""
    size, docs = 1 << bits, len(at) - 1
    weight = np.zeros(size)
    if not docs:
        k = np.arange(1, grades)
        return Model(weight, np.log(k / (grades - k)), trained=False)
    df = np.bincount(codes, minlength=size)
    used = df >= min(min_df, max(1, docs // 40))
    value = np.sqrt(np.log(np.maximum(docs, 2) / df[used].clip(1)) / np.log(max(docs, 2)))  # common features say little
    rank = np.cumsum(used) - 1
    owner = np.repeat(np.arange(docs), np.diff(at))[used[codes]]
    codes = rank[codes[used[codes]]]
    n = int(used.sum())
    above = np.clip([(grade > k).mean() for k in range(grades - 1)], 0.01, 0.99)
    prior = np.log(1 / above - 1)
    x = np.concatenate([np.zeros(n), prior[:1], np.log(np.maximum(np.diff(prior), 0.1))])  # weights, first threshold, log gaps
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, steps + 1):
        score = np.bincount(owner, weights=(x[:n] * value)[codes], minlength=docs)
        _, by_score, by_cut = loss_and_slopes(score, grade, _cuts(x[n:]))
        by_gap = by_cut[::-1].cumsum()[::-1]
        by_gap[1:] *= np.exp(x[n + 1 :])
        g = np.concatenate([np.bincount(codes, weights=by_score[owner], minlength=n) * value + l2 * value**4 * x[:n], by_gap])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6) / np.sqrt(1 + t / 50)
    weight[used] = x[:n] * value
    return Model(weight, _cuts(x[n:]))


def _cuts(gaps: np.ndarray) -> np.ndarray:
    return np.cumsum(np.concatenate([gaps[:1], np.exp(gaps[1:])]))


def train(labelled: DataFrame, max_train: int = 8192, grades: int = GRADES, max_bytes: int = 1 << 20, text: str = "text", grade: str = "grade", doc_id: str = "doc_id") -> Model:
    """The model of at most ``max_train`` rows of ``labelled``, fitted in one task over their features."""
    short = F.octet_length(F.coalesce(F.col(text).cast("string"), F.lit(""))) <= max_bytes
    small_batches(labelled.sparkSession)
    rows = labelled.where(F.col(grade).isNotNull() & F.col(doc_id).isNotNull() & short)
    rows = rows.select(F.col(text).cast("string").alias("t"), F.col(grade).cast("int").alias("grade"), F.xxhash64(doc_id).alias("u"))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "t", 1 << 20):
                codes, at = features(data, offsets)
                lists = [codes[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("grade"), part.column("u"), pa.array(lists, pa.binary())], ["grade", "u", "codes"])

    sample = rows.mapInArrow(lean(featured), "grade int, u long, codes binary").orderBy("u", "codes").limit(max_train)

    def one(group: pa.Table) -> pa.Table:
        lists = [np.frombuffer(x.as_py(), np.int32) for x in group["codes"]]
        at = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
        model = fit(np.concatenate(lists) if lists else np.zeros(0, np.int32), at, np.clip(group["grade"].to_numpy(), 0, grades - 1), grades)
        return pa.table({"weight": pa.array([model.weight.astype(np.float32).tobytes()], pa.binary()), "cut": pa.array([model.cut.tobytes()], pa.binary())})

    found = sample.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(one, "weight binary, cut binary").first()
    if found is None:
        return fit(np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int64), grades)
    return Model(np.frombuffer(found["weight"], np.float32).astype(np.float64), np.frombuffer(found["cut"], np.float64))


def classify(docs: DataFrame, model: Model, text: str = "text", select: int = GRADES - 1, threshold: float = 0.4) -> DataFrame:
    """``docs`` with expected_grade, tail_probability (P(grade >= select)) and kept."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.weight.astype(np.float32), model.cut))
    docs, back = set_aside(docs, "_t")
    text = next((new for new, c in back.items() if c == text), text)
    carried = docs.drop("expected_grade", "tail_probability", "kept")
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in carried.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            for part, data, offsets in slices(batch, "_t", 1 << 20):
                tails = own.tails(own.score(*features(data, offsets)))
                kept = part.drop_columns(["_t"])
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(tails.sum(axis=1)), pa.array(tails[:, select - 1])], [*kept.schema.names, "expected_grade", "tail_probability"])

    rows = carried.withColumn("_t", F.col(text).cast("string"))
    scored = rows.mapInArrow(lean(run), f"{kinds}expected_grade double, tail_probability double")
    return scored.withColumn("kept", F.col("tail_probability") >= F.lit(threshold) if model.trained else F.lit(True)).withColumnsRenamed(back)


def graded(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled documents; grades: 0 toxic (unfit whatever its form), 1 of low quality, 2 good."""
    grade: Column = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    rated = labels.select(F.col("doc_id").alias("_id"), grade.alias("grade")).where("_id IS NOT NULL AND grade IS NOT NULL")
    return docs.select("doc_id", "text").join(rated, F.col("doc_id") == F.col("_id")).drop("_id")


def sampled(labels: DataFrame, n: int) -> DataFrame:
    """At most n labels, those of the smallest hashes of their ids."""
    return labels.where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic = 1)").orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


def quality_model(spark, docs: DataFrame, sf_dir: str, max_train: int = 8192) -> Model:
    labels = sampled(spark.read.parquet(f"{sf_dir}/labels.parquet"), max_train)
    return train(graded(docs, F.broadcast(labels)), max_train)


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return classify(docs, quality_model(spark, docs, sf_dir)).select("doc_id", "expected_grade", "tail_probability", "kept")
