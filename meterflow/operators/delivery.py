"""Delivery: fan-out to endpoints, batches, write relabeling, symbol tables and outcomes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..shared import written
from .relabel import Rule, relabel


MOST_ENDPOINTS = 1000


def fan_out_endpoints(samples: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Every sample to every endpoint.  The endpoints are a configuration table of at most ``MOST_ENDPOINTS`` rows, which is
    checked; they become a literal that each row explodes, so that nothing is joined."""
    rows = endpoints.limit(MOST_ENDPOINTS + 1).collect()
    if len(rows) > MOST_ENDPOINTS:
        raise ValueError(f"more than {MOST_ENDPOINTS} endpoints")
    one = lambda r: F.struct(*[F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in endpoints.schema])
    all_ = F.array(*map(one, rows)).cast(f"array<{endpoints.schema.simpleString()}>")
    return samples.withColumn("_e", F.explode(all_)).select(*samples.columns, *[F.col(f"_e.{c}").alias(c) for c in endpoints.columns])


def drop_native_histograms(df: DataFrame) -> DataFrame:
    """Endpoints without the flag lose histogram rows before batching; stale markers are no histograms."""
    return df.where(F.col("send_native_histograms") | ~F.col("is_histogram"))


def assign_batches(df: DataFrame, order: list[str], shards: int = 1, size: str = "max_samples_per_send", shard_by: str = "target_id") -> DataFrame:
    """shard and batch_id in arrival order: chunks of ``size`` rows per endpoint and shard.

    Rows are dealt out by ranges of endpoint, shard and all of ``order`` (of any orderable types, nulls first; together they
    should tell rows apart) and sorted there.  Each range numbers its rows on from the rows that the ranges before it hold of
    the same endpoint and shard, so no task sorts a whole endpoint.  The ranges are a table in the shared folder, as their
    bounds come from a sample and must be the same for the counts and for the rows.
    """
    names, ranged = df.columns, ranged_rows(df, order, shards, shard_by)
    parts = range_counts(ranged)
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_endpoint", "_shard").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = ranged.join(parts.withColumn("_before", before - F.col("_first")), in_range())
    batch = F.floor((F.col("_at") + F.col("_before")) / F.col(size)).cast("bigint")
    return numbered.select(*(c for c in names if c != "shard"), "shard", batch.alias("batch_id"))


def ranged_rows(df: DataFrame, order: list[str], shards: int, shard_by: str = "target_id", path: str | None = None) -> DataFrame:
    """``df`` with its shard as a table of sorted ranges of endpoint, shard and ``order``; ``_part`` is a row's range, ``_at`` numbers
    the rows of one."""
    shard = F.pmod(F.xxhash64(shard_by), F.lit(shards)).cast("int") if shards > 1 else F.lit(0)
    key = ["endpoint", "shard"]
    ranged = df.drop("shard").withColumn("shard", shard).repartitionByRange(*key, *order).sortWithinPartitions(*key, *order)
    # the lower bits number a partition's rows, the upper ones are the partition
    return written(ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "ranges", path)


def range_counts(ranged: DataFrame) -> DataFrame:
    """The rows (_n) of each endpoint and shard in each range (_endpoint, _shard, _p), and the number of the first (_first)."""
    parts = ranged.groupBy("endpoint", "shard", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    return parts.select(F.col("endpoint").alias("_endpoint"), F.col("shard").alias("_shard"), F.col("_part").alias("_p"), "_first", "_n")


def in_range() -> Column:
    return (F.col("_part") == F.col("_p")) & F.col("endpoint").eqNullSafe(F.col("_endpoint")) & (F.col("shard") == F.col("_shard"))


def write_relabel(batches: DataFrame, chains: dict[str, list[Rule]], labels: str = "labels") -> DataFrame:
    """Batched rows after their endpoint's own rules, labels (a map) sorted into the canonical form.

    Rows of endpoints without a chain stay as they are, empty labels included; a batch that loses all rows has none left
    and is not sent."""
    df = batches.withColumns({"_kept": F.lit(True), "_new": F.col(labels)})
    for endpoint, rules in chains.items():
        own = F.col("endpoint") == endpoint
        df = relabel(df.withColumn("_own", F.when(own, F.col(labels))), rules, "_own", flag="_flag")
        df = df.withColumns({"_new": F.when(own, F.col("_own")).otherwise(F.col("_new")), "_kept": F.when(own, F.col("_flag")).otherwise(F.col("_kept"))})
    df = df.where("_kept").withColumn(labels, L.sort_labels(F.col("_new")))
    return df.drop("_kept", "_new", "_own", "_flag")


def batch_counts(df: DataFrame) -> DataFrame:
    """Samples and histograms of each batch."""
    return df.groupBy("endpoint", "shard", "batch_id").agg(F.count_if(~F.col("is_histogram")).alias("n_samples"), F.count_if("is_histogram").alias("n_histograms"))


def _symbols(labels: str) -> Column:
    """Names and values of a series in turn, '' for null values; none for null labels."""
    return F.coalesce(F.flatten(F.transform(F.col(labels), lambda p: F.array(p["name"], F.coalesce(p["value"], F.lit(""))))), F.array().cast("array<string>"))


def symbol_table(batches: DataFrame, key: list[str], order: list[str], labels: str = "labels") -> DataFrame:
    """(key, symbol, ref): '' is 0, others number by first appearance over series order, label order, name before value.

    A batch is one row until its distinct symbols are known, so that no row for each symbol of each series is sorted."""
    series = F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), _symbols(labels).alias("s"))
    one = batches.groupBy(*key).agg(F.sort_array(F.collect_list(series)).alias("_x"))
    found = F.array_distinct(F.concat(F.array(F.lit("")), F.flatten(F.transform("_x", lambda x: x["s"]))))
    return one.select(*key, found.alias("_x")).select(*key, F.posexplode("_x").alias("ref", "symbol")).select(*key, "symbol", "ref")


def _nullable(t: pa.DataType) -> pa.DataType:
    """The type with nullable elements at all depths, as a schema in text has them."""
    if pa.types.is_struct(t):
        return pa.struct([pa.field(f.name, _nullable(f.type)) for f in t])
    if pa.types.is_map(t):
        return pa.map_(_nullable(t.key_type), pa.field(t.item_field.name, _nullable(t.item_type)))
    return pa.list_(pa.field(t.value_field.name, _nullable(t.value_type))) if pa.types.is_list(t) else t


def symbol_refs(batches: DataFrame, key: list[str], order: list[str], labels: str = "labels") -> DataFrame:
    """``batches`` with ``refs``: the table's number of each name and value of a series in turn, 0 for empty and null values.

    A batch holds few rows: its series meet in order by its key, and a dictionary of the batch numbers their symbols, so they are
    shuffled and sorted once.  ``order`` must tell series apart.  Series without labels have no refs."""
    own = batches.drop("refs")
    names = own.columns
    rows = own.withColumns({"_symbols": _symbols(labels), "_row": F.row_number().over(Window.partitionBy(*key).orderBy(*order))})
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)

    def numbered(batch: pa.Table) -> pa.Table:
        batch = batch.sort_by("_row")
        refs = {"": 0}
        found = [[refs.setdefault(s, len(refs)) for s in x] for x in batch["_symbols"].to_pylist()]
        columns = [batch[c].cast(_nullable(batch[c].type)) for c in names]
        return pa.table([*columns, pa.array(found, pa.list_(pa.int32()))], [*names, "refs"])

    return rows.groupBy(*key).applyInArrow(numbered, f"{kinds}, refs array<int>")


def delivery_outcomes(deliveries: DataFrame, counts: DataFrame) -> DataFrame:
    """Each attempt's outcome (by endpoint, shard and batch; deliveries without shard by endpoint and batch): ok, partial (fewer written than sent), retry (5xx, 429, transport) or dropped."""
    key = [c for c in ("endpoint", "shard", "batch_id") if c in deliveries.columns and c in counts.columns]
    if "shard" in counts.columns and "shard" not in key:
        counts = counts.groupBy(*key).agg(F.sum("n_samples").alias("n_samples"), F.sum("n_histograms").alias("n_histograms"))
    sent = counts.select(*(F.col(c).alias(f"_{c}") for c in key), "n_samples", "n_histograms")
    same = F.lit(True)
    for c in key:
        same &= F.col(c) == F.col(f"_{c}")
    df = deliveries.join(sent, same, "left").drop(*(f"_{c}" for c in key))
    status = F.col("http_status")
    short = (F.col("samples_written") < F.col("n_samples")) | (F.col("histograms_written") < F.col("n_histograms"))
    outcome = (
        F.when(status.isNull() | (status >= 500) | (status == 429), "retry")
        .when(status.between(200, 299) & F.coalesce(short, F.lit(False)), "partial")
        .when(status.between(200, 299), "ok")
        .otherwise("dropped")
    )
    return df.withColumn("outcome", outcome)


#: Waits of a batch's sender, by default.
MIN_BACKOFF_MS, MAX_BACKOFF_MS = 30, 5_000


def retry_chains(outcomes: DataFrame, min_backoff_ms: int = MIN_BACKOFF_MS, max_backoff_ms: int = MAX_BACKOFF_MS) -> DataFrame:
    """One row for each batch of ``delivery_outcomes`` (endpoint, shard if there, batch_id, attempt, ts_ms, outcome):

    ``outcome`` of the last attempt (``retry``: still waiting for the next one), ``attempts``, ``retries``, ``waited_ms`` (the
    waits that its retries called for: doubled from ``min_backoff_ms``, at most ``max_backoff_ms``), ``elapsed_ms`` from first to
    last attempt, and ``fault``: what no sender does, or null.  Faults: ``attempts missing`` (numbers do not run from 1),
    ``sent after its end`` (an attempt follows one that was no retry), ``sent too early`` (an attempt began before its wait
    was over).  Repeated reports of one attempt count once, the first to come."""
    key = [c for c in ("endpoint", "shard", "batch_id") if c in outcomes.columns]
    one = outcomes.groupBy(*key, "attempt").agg(F.min_by(F.struct("ts_ms", "outcome"), F.struct("ts_ms", "outcome")).alias("x")).select(*key, "attempt", "x.*")
    order = Window.partitionBy(*key).orderBy("attempt")
    # 2^30 times the least wait is beyond any sensible most
    wait = F.least(F.lit(max_backoff_ms).cast("bigint"), min_backoff_ms * F.pow(F.lit(2), F.least(F.col("attempt") - 1, F.lit(30))).cast("bigint"))
    before = lambda c: F.lag(c).over(order)
    steps = one.withColumn("_wait", wait).withColumns({"_n": F.row_number().over(order), "_was": before("outcome"), "_gap": F.col("ts_ms") - before("ts_ms"), "_due": before("_wait")})
    fault = (
        F.when(F.col("attempt") != F.col("_n"), "attempts missing")
        .when(F.col("_was").isNotNull() & (F.col("_was") != "retry"), "sent after its end")
        .when(F.col("_gap") < F.col("_due"), "sent too early")
    )
    steps = steps.withColumn("_fault", fault)
    again = F.col("outcome") == "retry"
    return steps.groupBy(*key).agg(
        F.max_by("outcome", "attempt").alias("outcome"),
        F.count("*").alias("attempts"),
        F.count_if(again).alias("retries"),
        F.sum(F.when(again, F.col("_wait")).otherwise(0)).alias("waited_ms"),
        (F.max("ts_ms") - F.min("ts_ms")).alias("elapsed_ms"),
        F.min_by("_fault", F.when(F.col("_fault").isNotNull(), F.col("attempt"))).alias("fault"),
    )
