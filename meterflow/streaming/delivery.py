"""Delivery as a stream: batches that fill over triggers and leave at their size, at a deadline or at the end.

With a deadline, the rows that an endpoint's shard has not sent yet wait in the state store (RocksDB provider), fewer than one
batch of them after each trigger; the arrival of fewer rows than fill a batch only appends to them.  Without a deadline they wait
in a table, and triggers of any size are dealt out by ranges.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from ..operators.delivery import fan_out_endpoints, in_range, range_counts, ranged_rows
from ..shared import delete, written


class _Buffer(StatefulProcessor):
    """Per endpoint and shard: waiting rows, the number of the next batch and the time at which the rest leaves."""

    def __init__(self, columns: list[str], order: list[str], deadline_ms: int | None):
        self.columns, self.order, self.deadline_ms = columns, order, deadline_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "row binary")
        self.head = handle.getValueState("head", "batch_id long, waiting int, deadline long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        batch, waiting, deadline = self.head.get() if self.head.exists() else (0, 0, None)
        new, end, size = [], False, 1
        for r in rows:
            size = r["max_samples_per_send"]
            if r["_end"]:
                end = True
            else:
                new.append(r)
        new.sort(key=lambda r: tuple((r[c] is not None, r[c]) for c in self.order))
        if end or new and waiting + len(new) >= size:
            every = [*self._waiting(), *(tuple(r[c] for c in self.columns) for r in new)]
            full = len(every) // size * size
            for i, row in enumerate(every[:full]):
                yield self._sent(row, batch + i // size, "size")
            batch += full // size
            every = every[full:]
            if end and every:
                yield from (self._sent(row, batch, "end") for row in every)
                batch, every = batch + 1, []
            self.rows.clear()
            self._add(every)
            deadline = self._timer(deadline, timerValues, bool(every))
            waiting = len(every)
        elif new:
            self._add([tuple(r[c] for c in self.columns) for r in new])
            waiting += len(new)
            if deadline is None:
                deadline = self._timer(None, timerValues, True)
        self.head.update((batch, waiting, deadline))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        batch, waiting, _ = self.head.get()
        for row in self._waiting():
            yield self._sent(row, batch, "deadline")
        self.rows.clear()
        self.head.update((batch + (waiting > 0), 0, None))

    def close(self) -> None:
        pass

    def _waiting(self) -> list[tuple]:
        return [pickle.loads(bytes(r[0])) for r in self.rows.get()] if self.rows.exists() else []

    def _add(self, rows: list[tuple]) -> None:
        if rows:
            self.rows.appendList([(bytearray(pickle.dumps(r)),) for r in rows])

    def _timer(self, deadline: int | None, timers, wanted: bool) -> int | None:
        """The deadline starts anew when a full batch has left, and with the first row that waits."""
        if deadline is not None:
            self.handle.deleteTimer(deadline)
        if not wanted or self.deadline_ms is None:
            return None
        at = timers.getCurrentProcessingTimeInMs() + self.deadline_ms
        self.handle.registerTimer(at)
        return at

    def _sent(self, row: tuple, batch: int, why: str) -> Row:
        return Row(**dict(zip(self.columns, row, strict=True)), batch_id=batch, closed_by=why)


def _check(shards: int) -> None:
    if not 1 <= shards <= 10_000:
        raise ValueError("from 1 to 10,000 shards")


def stream_batches(samples: DataFrame, endpoints: DataFrame, order: list[str], deadline_ms: int | None = 5000, shards: int = 1, end: DataFrame | None = None, shard_by: str = "target_id") -> DataFrame:
    """Every sample of a stream at every endpoint (``max_samples_per_send``, ``send_native_histograms``), with shard, batch_id and
    ``closed_by``: rows appear when their batch leaves.

    Rows of a trigger are taken by ``order``, triggers one after the other; batches of an endpoint and shard are numbered on from
    trigger to trigger.  A batch leaves when it has its size; what waits leaves ``deadline_ms`` after the last full batch or the
    first row that waits (None: never), and at once for each row of the stream ``end``, of whatever columns.  Endpoints without
    native histograms lose such rows before batching.  Rows of one endpoint and shard that arrive in one trigger are sorted in one
    task: ``shards`` and the trigger bound them."""
    _check(shards)
    rows = samples.withColumn("_end", F.lit(False))
    if end is not None:
        rows = rows.unionByName(end.select(F.lit(True).alias("_end")), allowMissingColumns=True)
    rows = fan_out_endpoints(rows, endpoints).where(F.col("_end") | F.col("send_native_histograms") | ~F.coalesce("is_histogram", F.lit(False)))
    own = F.array(F.pmod(F.xxhash64(shard_by), F.lit(shards)).cast("int"))
    rows = rows.withColumn("shard", F.explode(F.when(F.col("_end"), F.sequence(F.lit(0), F.lit(shards - 1))).otherwise(own)))
    columns = [c for c in rows.columns if c != "_end"]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns) + ", batch_id long, closed_by string"
    time = "None" if deadline_ms is None else "ProcessingTime"
    return rows.groupBy("endpoint", "shard").transformWithState(_Buffer(columns, order, deadline_ms), outputStructType=schema, outputMode="Append", timeMode=time)


def stream_delivery(samples: DataFrame, endpoints: DataFrame, order: list[str], path: str, checkpoint: str, deadline_ms: int | None = 5000, shards: int = 1, end: DataFrame | None = None) -> DataStreamWriter:
    """A writer of the rows of ``stream_batches`` to Parquet files by endpoint; a restart from the checkpoint doubles nothing.

    A deadline needs timers, so with one the rows go through the state store.  Without, every trigger is a batch job: its rows and
    those that wait are dealt out by ranges as in ``assign_batches``, so that no task holds an endpoint's rows, whatever came at
    once.  What waits, and the numbers of the next batches, are tables of the trigger beside the checkpoint; the files of a
    trigger are a folder (column ``turn``), which a repeated trigger writes anew."""
    if deadline_ms is not None:
        batches = stream_batches(samples, endpoints, order, deadline_ms, shards, end)
        return batches.writeStream.format("parquet").partitionBy("endpoint").option("path", path).option("checkpointLocation", checkpoint)
    _check(shards)
    rows = samples.withColumn("_end", F.lit(False))
    if end is not None:
        rows = rows.unionByName(end.select(F.lit(True).alias("_end")), allowMissingColumns=True)

    def deliver(part: DataFrame, turn: int) -> None:
        _deliver(part, turn, endpoints, order, path, f"{checkpoint}/delivery", shards)

    return rows.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint)


def _deliver(part: DataFrame, turn: int, endpoints: DataFrame, order: list[str], path: str, place: str, shards: int) -> None:
    """One trigger: what fills a batch is written, the rest waits for the next one."""
    spark, own, last = part.sparkSession, f"{place}/{turn}", f"{place}/{turn - 1}"
    ended = not part.where("_end").isEmpty()
    rows = fan_out_endpoints(part.where(~F.col("_end")).drop("_end"), endpoints)
    rows = rows.where(F.col("send_native_histograms") | ~F.coalesce("is_histogram", F.lit(False))).withColumn("_turn", F.lit(turn).cast("long"))
    columns = [*(c for c in rows.columns if c not in ("shard", "_turn")), "shard"]
    heads = spark.createDataFrame([], "endpoint string, shard int, first long")
    if turn:
        waiting = spark.read.parquet(f"{last}/waiting")
        rows, heads = rows.drop("shard").unionByName(waiting.drop("shard"), allowMissingColumns=True), spark.read.parquet(f"{last}/heads").select("endpoint", "shard", F.col("next").alias("first"))
    ranged = ranged_rows(rows, ["_turn", *order], shards, path=f"{own}/rows")
    parts = range_counts(ranged)
    # an endpoint's rows follow its newest size
    size = ranged.groupBy(F.col("endpoint").alias("_endpoint"), F.col("shard").alias("_shard")).agg(F.count("*").alias("all"), F.max_by("max_samples_per_send", "_turn").alias("size"))
    heads = heads.join(size, F.col("endpoint").eqNullSafe(F.col("_endpoint")) & (F.col("shard") == F.col("_shard")), "full")
    full = F.floor(F.col("all") / F.col("size"))
    heads = heads.select(
        F.coalesce("endpoint", "_endpoint").alias("endpoint"), F.coalesce("shard", "_shard").alias("shard"), F.coalesce("first", F.lit(0)).alias("first"), "size", (full * F.col("size")).alias("filled"),
        (F.coalesce("first", F.lit(0)) + F.coalesce(F.ceil(F.col("all") / F.col("size")) if ended else full, F.lit(0))).alias("next"),
    )
    heads = written(heads, path=f"{own}/heads")
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_endpoint", "_shard").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own_head = heads.select(F.col("endpoint").alias("_e"), F.col("shard").alias("_s"), F.col("first").alias("_next"), F.col("size").alias("_size"), F.col("filled").alias("_filled"))
    parts = parts.withColumn("_before", before - F.col("_first")).join(own_head, F.col("_endpoint").eqNullSafe(F.col("_e")) & (F.col("_shard") == F.col("_s")))
    numbered = ranged.join(parts, in_range()).withColumn("_at", F.col("_at") + F.col("_before"))
    filled = F.col("_at") < F.col("_filled")
    sent = numbered if ended else numbered.where(filled)
    batch = (F.col("_next") + F.floor(F.col("_at") / F.col("_size"))).cast("bigint").alias("batch_id")
    sent.select(*columns, batch, F.when(filled, "size").otherwise("end").alias("closed_by")).write.mode("overwrite").partitionBy("endpoint").parquet(f"{path}/turn={turn}")
    (numbered.where(F.lit(False)) if ended else numbered.where(~filled)).select(*columns, "_turn").write.mode("overwrite").parquet(f"{own}/waiting")
    delete(spark, f"{own}/rows")
    delete(spark, f"{place}/{turn - 2}")
