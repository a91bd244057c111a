"""Native histograms as bucket rows: expansion, encoding, resolution reduction, limits, validation.

Integer histograms code their buckets as deltas of counts, float histograms as the counts themselves; bucket rows hold absolute
counts of either kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.numbers import format_bound

MIN_SCHEMA, MAX_SCHEMA = -4, 8
SPANS = "array<struct<offset:int,length:bigint>>"


def span_indices(spans: Column, buckets: Column) -> Column:
    """Absolute bucket indices of spans that cover ``buckets`` buckets: the first offset is absolute, later ones are gaps.

    Spans that cover another number (their lengths are not trusted before that) or overflow have null."""
    start = F.struct(F.lit(0).cast("bigint").alias("next"), F.array().cast("array<bigint>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        first = F.try_add(acc["next"], s["offset"].cast("bigint"))
        after = F.try_add(first, s["length"])
        more = F.when(s["length"] > 0, F.sequence(first, after - 1)).otherwise(F.array().cast("array<bigint>"))
        return F.struct(after.alias("next"), F.when(after.isNotNull(), F.concat(acc["out"], more)).alias("out"))

    return F.when(covered(spans) == buckets, F.aggregate(spans, start, step, lambda acc: acc["out"]))


def covered(spans: Column) -> Column:
    """Buckets that spans cover, null beyond a long."""
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: F.try_add(n, F.greatest(s["length"], F.lit(0).cast("bigint"))))


def running(deltas: Column) -> Column:
    """Absolute counts of delta-coded counts, null from an overflow on."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.array().cast("array<bigint>").alias("out"))

    def step(acc: Column, d: Column) -> Column:
        n = F.try_add(acc["n"], d)
        return F.struct(n.alias("n"), F.concat(acc["out"], F.array(n)).alias("out"))

    return F.aggregate(deltas, start, step, lambda acc: acc["out"])


def histogram_buckets(df: DataFrame, key: list[str], spans: str, values: str, side: str, absolute: bool = False) -> DataFrame:
    """(key, side, index, count) rows of one side; none of a histogram whose spans do not fit its buckets.

    ``values`` are deltas, or with ``absolute`` the counts of a float histogram."""
    index = span_indices(F.col(spans), F.size(values).cast("bigint"))
    counts = F.col(values) if absolute else running(F.col(values))
    pairs = F.when(index.isNotNull(), F.arrays_zip(index.alias("index"), counts.alias("count")))
    return L.each(df.withColumn("side", F.lit(side)), pairs, "b").select(*key, "side", F.col("b.index").alias("index"), F.col("b.count").alias("count"))


def encode_buckets(buckets: DataFrame, key: list[str], absolute: bool = False) -> DataFrame:
    """Spans of each key and side, with deltas, or with ``counts`` if ``absolute``: neighbouring indices form a span."""
    by = [*key, "side"]
    order = Window.partitionBy(*by).orderBy("index")
    value = F.col("count") if absolute else F.col("count") - F.coalesce(F.lag("count").over(order), F.lit(0))
    df = buckets.withColumns({"gap": F.col("index") - F.lag("index").over(order) - 1, "value": value})
    df = df.withColumn("_new", (F.col("gap").isNull() | (F.col("gap") > 0)).cast("int"))
    df = df.withColumn("_span", F.sum("_new").over(order))
    spans = df.groupBy(*by, "_span").agg(F.min(F.struct("index", F.coalesce("gap", "index").cast("int").alias("offset"))).alias("f"), F.count("*").alias("length"), F.sort_array(F.collect_list(F.struct("index", "value"))).alias("d"))
    rows = spans.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_span", F.col("f.offset").alias("offset"), "length", "d"))).alias("s"))
    values = F.flatten(F.transform("s", lambda x: F.transform(x["d"], lambda y: y["value"])))
    return rows.select(*by, F.transform("s", lambda x: F.struct(x["offset"].alias("offset"), x["length"].alias("length"))).alias("spans"), values.alias("counts" if absolute else "deltas"))


def reduced_index(index: Column, shift: Column | int) -> Column:
    """Bucket index after ``shift`` halvings of the resolution (arithmetic shift)."""
    by = F.pow(F.lit(2.0), shift if isinstance(shift, Column) else F.lit(shift))
    return (F.floor((index - 1) / by) + 1).cast("bigint")


def reduce_histogram_resolution(buckets: DataFrame, key: list[str], shift: Column | int) -> DataFrame:
    return buckets.groupBy(*key, "side", reduced_index(F.col("index"), shift).alias("index")).agg(F.sum("count").alias("count"))


def cap_histogram_schema(df: DataFrame, schema: str = "schema") -> DataFrame:
    """``shift`` that brings a schema to at most 8, and the schema after it."""
    return df.withColumn("shift", F.greatest(F.col(schema) - MAX_SCHEMA, F.lit(0))).withColumn(schema, F.least(F.col(schema), F.lit(MAX_SCHEMA)))


def _sizes(buckets: DataFrame, key: list[str], schema: str) -> DataFrame:
    """(key, schema, apart): for each bucket of a histogram, the least shift at which it is one with the bucket before it on its
    side (64 for a side's first bucket).  A histogram has as many buckets after a shift as entries above it."""
    order = Window.partitionBy(*key).orderBy("side", "index")
    # two places are one after as many halvings as their numbers need to agree above: up to their highest differing bit
    bits = (F.col("index") - 1).bitwiseXOR(F.lag("index").over(order) - 1)
    apart = F.when(~F.col("side").eqNullSafe(F.lag("side").over(order)) | (bits < 0), 64).when(bits == 0, 0).otherwise(F.length(F.bin(bits)))
    rows = buckets.withColumn("_apart", F.coalesce(apart, F.lit(64)))
    return rows.groupBy(*key).agg(F.max(schema).alias("_schema"), F.collect_list("_apart").alias("_apart"))


def _least_shift(first: Column, limit: int) -> Column:
    """The least shift from ``first`` on that leaves at most ``limit`` buckets (0: no limit), or null if even the coarsest has more."""
    shifts = F.sequence(first, F.greatest(F.col("_schema") - MIN_SCHEMA, first))
    fits = lambda s: F.size(F.filter("_apart", lambda x: x > s)) <= limit
    return F.get(F.filter(shifts, fits) if limit else shifts, F.lit(0))


def limit_histogram_buckets(buckets: DataFrame, key: list[str], limit: int, schema: str = "schema") -> DataFrame:
    """(key, shift): the least coarsening with at most ``limit`` buckets on both sides; null if even -4 has more.

    All resolutions come from one sorted pass over a histogram's buckets: each tells at which shift it is lost.  A limit of
    0 is off.
    """
    return _sizes(buckets, key, schema).select(*key, _least_shift(F.lit(0), limit).alias("shift"))


def fit_histograms(buckets: DataFrame, key: list[str], limit: int = 0, schema: str = "schema") -> tuple[DataFrame, DataFrame]:
    """(bucket rows, faults): buckets of integer or float histograms with their schema brought to at most 8 and their number to at
    most ``limit``, in one coarsening; a histogram with too many buckets even at -4 has a row (key, error) instead."""
    first = F.greatest(F.col("_schema") - MAX_SCHEMA, F.lit(0))
    found = _sizes(buckets, key, schema).select(*(F.col(c).alias(f"_{c}") for c in key), _least_shift(first, limit).alias("_shift"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
    rows = buckets.join(found.where("_shift IS NOT NULL"), same)
    rows = rows.groupBy(*key, "side", reduced_index(F.col("index"), F.col("_shift")).alias("index")).agg((F.max(schema) - F.max("_shift")).cast("int").alias(schema), F.sum("count").alias("count"))
    faults = found.where("_shift IS NULL").select(*(F.col(f"_{c}").alias(c) for c in key), F.lit("bucket limit exceeded at the coarsest schema").alias("error"))
    return rows, faults


def validate_native_histogram(schema: Column, spans: Column, deltas: Column, counts: Column | None = None, is_float: Column | None = None) -> Column:
    """Why one side of a histogram is malformed, or null; sums beyond a long are found, not raised.

    Integer histograms have ``deltas``.  Where ``is_float``, the buckets are ``counts``, which may be of any size."""
    start = F.struct(F.lit(0).cast("bigint").alias("next"), F.lit(False).alias("bad"))

    def reach(acc: Column, s: Column) -> Column:
        first = F.try_add(acc["next"], s["offset"].cast("bigint"))
        last = F.try_add(first, F.greatest(s["length"], F.lit(1).cast("bigint")) - 1)
        fits = F.coalesce(first.between(-(2**31), 2**31 - 1) & last.between(-(2**31), 2**31 - 1), F.lit(False))
        return F.struct(F.coalesce(F.try_add(first, s["length"]), F.lit(0).cast("bigint")).alias("next"), (acc["bad"] | ~fits).alias("bad"))

    def negative(n: Column) -> Column:
        return F.when(F.coalesce(F.exists(n, lambda x: x < 0), F.lit(False)), "negative bucket count").when(F.exists(n, lambda x: x.isNull()), "bucket count overflow")

    later = F.exists(F.filter(spans, lambda s, i: i > 0), lambda s: s["offset"] < 0)
    total = F.coalesce(covered(spans), F.lit(-1).cast("bigint"))
    floats = F.lit(False) if is_float is None else is_float
    buckets = F.size(deltas) if counts is None else F.when(floats, F.size(counts)).otherwise(F.size(deltas))
    return (
        F.when(schema < MIN_SCHEMA, "unsupported schema")
        .when(later, "negative span offset")
        .when(F.aggregate(spans, start, reach, lambda acc: acc["bad"]), "bucket index overflow")
        .when(total != buckets, "spans do not cover the buckets")
        .when(floats, F.lit(None).cast("string"))
        .otherwise(F.get(F.transform(F.array(running(deltas)), negative), F.lit(0)))
    )


def float_or_int(floating: Column, whole: Column) -> Column:
    """A count that is exposed twice: the float one where it is above 0, else the integer one (0 where there is none)."""
    return F.when(floating > 0, floating).otherwise(F.coalesce(whole.cast("double"), F.lit(0.0)))


def expand_classic_histogram(df: DataFrame, key: list[str], buckets: str = "buckets", count: str = "count", total: str = "sum", count_float: str | None = None) -> DataFrame:
    """_count, _sum and cumulative _bucket{le} rows (``bound`` is the text of le); +Inf is added unless the last bucket has it.

    ``buckets`` is array<struct<upper_bound double, cumulative_count>>, with cumulative_count_float where float counts are
    exposed; ``count_float`` names the float count.  Float counts win where they are above 0.
    """
    inf = F.lit(float("inf"))
    last = F.coalesce(F.try_element_at(buckets, F.lit(-1))["upper_bound"] == inf, F.lit(False))
    row = lambda suffix, le, v: F.struct(F.lit(suffix).alias("suffix"), le.alias("le"), v.cast("double").alias("value"))
    null = F.lit(None).cast("double")
    floats = "cumulative_count_float" in df.schema[buckets].dataType.elementType.names
    steps = F.transform(buckets, lambda b: row("_bucket", F.coalesce(b["upper_bound"], F.lit(0.0)), float_or_int(b["cumulative_count_float"], b["cumulative_count"]) if floats else b["cumulative_count"]))
    n = float_or_int(F.col(count_float), F.col(count)) if count_float else F.col(count)
    top = F.when(last, F.array().cast("array<struct<suffix:string,le:double,value:double>>")).otherwise(F.array(row("_bucket", inf, n)))
    rows = F.concat(F.array(row("_count", null, n), row("_sum", null, F.col(total))), F.coalesce(steps, F.array()), top)
    return df.select(*key, F.explode(rows).alias("r")).select(*key, "r.suffix", "r.le", format_bound(F.col("r.le")).alias("bound"), "r.value")


def expand_summary(df: DataFrame, key: list[str], quantiles: str = "quantiles", count: str = "count", total: str = "sum") -> DataFrame:
    """_count, _sum and one row per quantile (array<struct<quantile double, value double>>)."""
    row = lambda suffix, q, v: F.struct(F.lit(suffix).alias("suffix"), q.alias("quantile"), v.cast("double").alias("value"))
    null = F.lit(None).cast("double")
    rows = F.concat(F.array(row("_count", null, F.col(count)), row("_sum", null, F.col(total))), F.transform(quantiles, lambda b: row("", b["quantile"], b["value"])))
    return df.select(*key, F.explode(rows).alias("r")).select(*key, "r.suffix", "r.quantile", format_bound(F.col("r.quantile")).alias("bound"), "r.value")
