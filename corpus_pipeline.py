"""A training-data pipeline over ``documents``: classify, join near copies, dedup passages, mix, encode.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; its result is written as
Parquet and read again.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterflow.llm.bpe import decode, default_path, encode
from meterflow.llm.jaccard_join import jaccard_components
from meterflow.llm.mixing import mixed
from meterflow.llm.quality_classifier import classify, quality_model
from meterflow.llm.storage import discard, result, written
from meterflow.llm.substring_dedup import dedup


def _packed(docs: DataFrame, *needed: str) -> DataFrame:
    """text and the ``needed`` columns, with all others in a struct that no operator's columns can clash with."""
    return docs.select("text", *needed, F.struct(F.lit(0).alias("_none"), *(c for c in docs.columns if c != "text")).alias("_own"))


def _unpacked(df: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    return df.select(*(changed.get(c, F.col("text") if c == "text" else F.col("_own").getField(c)).alias(c) for c in docs.columns))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return _unpacked(classify(_packed(docs), quality_model(spark, docs, sf_dir)).where("kept"), docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest doc_id, of each group of near copies (five words, 0.8) stays, and all rows without words."""
    rows = written(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    found = written(jaccard_components(rows, shingle=5, threshold=80, row="_row"), "near-copies")
    first = found.where("n_shingles > 0").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("x"))
    staying = first.select(F.col("x.row").alias("row")).union(found.where("n_shingles = 0").select("row"))
    return rows.join(staying, F.col("_row") == F.col("row"), "left_semi").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages leave the texts; texts without any stay as they are."""
    out = dedup(_packed(docs))
    gone = F.col("n_removed") > 0
    length = F.when(gone, F.length("kept").cast("long")).otherwise(F.col("_own").getField("n_chars")) if "n_chars" in docs.columns else None
    return _unpacked(out, docs, text=F.when(gone, F.col("kept")).otherwise(F.col("text")), **({} if length is None else {"n_chars": length}))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document that the mix takes more than once appears as often."""
    return _unpacked(mixed(_packed(docs, "doc_id", "source")), docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether decoding gives the text again."""
    path = default_path()
    out = decode(encode(docs, path), path)
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit(""))
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", same.alias("round_trip"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("substring dedup", substring_dedup),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", bpe),
]

#: Training, tokenizing and seeded permutations are not SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, result(spark, lambda: stage(spark, docs, sf_dir), f"pipeline-{i}")  # noqa: B023
        discard(before)
    return docs
