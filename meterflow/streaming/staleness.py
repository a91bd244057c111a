"""Staleness of a stream of scrapes, with the drain of targets that discovery removes.

``staleness_events`` is an operator with state, for triggers that bring few scrapes.  ``stream_staleness`` writes the same events to
files: each of its triggers is a batch job over what came and the live series, for triggers of any size.

In the operator, a target's series are spread over buckets by a hash of their identity; the header of each scrape goes to every bucket, so
that a bucket can tell what vanished.  The state of a bucket (RocksDB provider) is a map of its live series, of which only
entries that come or go are written, and the time of the last event.  Removals of targets are events of the same operator.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from ..operators.scrapes import REPORTS
from ..shared import delete, written

LABELS = "array<struct<name:string,value:string>>"
#: Labels in the state are flat: names and values in turn.
EVENTS = "target_id string, kind string, identity string, flat array<string>, ts_ms long"
SERIES = "array<struct<bucket:int,identity:string,flat:array<string>>>"


class _Bucket(StatefulProcessor):
    """Per target and bucket: its live series, the time of the last event, and whether it has been scraped since a removal."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.live = handle.getMapState("live", "identity string", "flat array<string>")
        self.last = handle.getValueState("last", "at long, scraped boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        target, bucket = key
        event = lambda kind, identity, flat, at: Row(target_id=target, kind=kind, identity=identity, flat=flat, ts_ms=at)
        events: dict[tuple[int, bool], dict[str, list]] = {}
        for r in rows:
            own = events.setdefault((r.at, r.removed), {})
            if r.identity is not None:
                own.setdefault(r.identity, list(r.flat))
        # every call to the state is a round trip, and most buckets of small targets are empty
        head = self.last.get()
        last, scraped = head or (None, False)
        known = {k[0] for k in self.live.keys()} if head else set()
        #: The live series now, and the labels of those that the state does not hold as they are.
        live, labels = set(known), {}
        for at, removed in sorted(events):
            if last is not None and (at < last if removed else at <= last):
                if bucket == 0:  # once for the event: what follows it has been judged
                    yield event("late", None, None, at)
                continue
            now = {} if removed else events[at, removed]
            for identity in sorted(live - now.keys()):
                yield event("stale", identity, labels.pop(identity) if identity in labels else list(self.live.getValue((identity,))[0]), at)
            if removed and scraped:  # its report series end as well
                for identity, flat in events[at, removed].items():
                    yield event("stale", identity, flat, at)
            labels.update((i, now[i]) for i in now.keys() - live)
            live, last, scraped = set(now), at, not removed
        for identity in known - live:
            self.live.removeKey((identity,))
        for identity, flat in labels.items():
            self.live.updateValue((identity,), (flat,))
        if head is None or (last, scraped) != tuple(head):
            self.last.update((last, scraped))

    def close(self) -> None:
        pass


def _flat(labels: Column) -> Column:
    return F.flatten(F.transform(labels, lambda p: F.array(p["name"], p["value"])))


def staleness_events(judged: DataFrame, series: Column, removed: DataFrame | None = None, target_labels: Column | None = None, buckets: int = 16) -> DataFrame:
    """Events (target_id, kind, identity, labels, ts_ms) of a stream of judged scrapes (target_id, start_ms), failed ones included.

    ``series`` is the array<struct<identity, labels>> of a scrape's tracked series, those whose time is the scrape's start
    (empty for a failed one).  ``removed`` is a stream of removals (target_id, ts_ms) with ``target_labels``, a map of its
    columns.  Kinds: ``stale`` for a series that vanished, and at a removal for all live series and the target's report
    series; ``late`` for a scrape that began no later than its target's last event, or a removal before that: its successor has
    been judged, so it changes nothing.  Without an event nothing ends: a shutdown gives no markers.
    """
    headers = F.expr(f"transform(sequence(0, {buckets - 1}), b -> struct(b AS bucket, cast(null AS string) AS identity, cast(null AS array<string>) AS flat))").cast(SERIES)
    own = F.transform(F.coalesce(series, F.array()).cast(f"array<struct<identity:string,labels:{LABELS}>>"), lambda s: F.struct(F.pmod(F.xxhash64(s["identity"]), F.lit(buckets)).cast("int"), s["identity"], _flat(s["labels"]))).cast(SERIES)
    rows = judged.select("target_id", F.col("start_ms").alias("at"), F.lit(False).alias("removed"), F.explode(F.concat(headers, own)).alias("s"))
    if removed is not None:
        none = F.create_map().cast("map<string,string>")
        base = F.array_sort(F.map_entries(F.map_filter(none if target_labels is None else target_labels, lambda k, v: k != "__name__")))
        report = lambda name: F.struct(F.lit(0), F.lit(name), F.concat(F.array(F.lit("__name__"), F.lit(name)), F.flatten(F.transform(base, lambda p: F.array(p["key"], p["value"])))))
        ends = F.concat(headers, F.array(*map(report, REPORTS)).cast(SERIES))
        rows = rows.unionByName(removed.select("target_id", F.col("ts_ms").alias("at"), F.lit(True).alias("removed"), F.explode(ends).alias("s")))
    rows = rows.select("target_id", "at", "removed", "s.bucket", "s.identity", "s.flat")
    found = rows.groupBy("target_id", "bucket").transformWithState(_Bucket(), outputStructType=EVENTS, outputMode="Append", timeMode="None")
    at = lambda r: F.filter("flat", lambda x, i: i % 2 == r)
    labels = F.zip_with(at(0), at(1), lambda n, v: F.struct(n.alias("name"), v.alias("value")))
    return found.select("target_id", "kind", "identity", labels.alias("labels"), "ts_ms")


def stream_stale_markers(judged: DataFrame, series: Column, removed: DataFrame | None = None, target_labels: Column | None = None, buckets: int = 16) -> DataFrame:
    """The markers among ``staleness_events``, as the batch operators give them."""
    found = staleness_events(judged, series, removed, target_labels, buckets).where("kind = 'stale'")
    return found.select("target_id", "identity", "labels", "ts_ms", F.lit(float("nan")).alias("value"), F.lit(True).alias("is_stale"))


#: Rows of ``stream_staleness``'s files; ``turn`` and ``kind`` are folders.
FILES = f"target_id string, identity string, labels {LABELS}, ts_ms long, turn long, kind string"
_SERIES = f"array<struct<identity:string,labels:{LABELS}>>"
_HEADS = "target_id string, last long, scraped boolean"
_WALKED = f"target_id string, identity string, labels {LABELS}, at long, ts_ms long, live boolean"


def stream_staleness(judged: DataFrame, series: Column, path: str, checkpoint: str, removed: DataFrame | None = None, target_labels: Column | None = None) -> DataStreamWriter:
    """A writer of the rows of ``staleness_events`` to Parquet files by kind; a restart from the checkpoint doubles nothing.

    Every trigger is a batch job without a group for each target: its events are numbered within their target, and a series is
    stale at the event after one that has it, if that one has not.  The targets' last events and the live series are tables of the
    trigger beside the checkpoint, which each trigger writes anew, so it costs what came and the series that live.  Labels of a
    marker are those of the series' last scrape, as in the batch operators; the files of a trigger are a folder (column ``turn``),
    which a repeated trigger writes anew."""
    own = F.coalesce(series, F.array()).cast(_SERIES)
    rows = judged.select(F.col("target_id").cast("string").alias("target_id"), F.col("start_ms").cast("long").alias("at"), F.lit(False).alias("removed"), own.alias("series"))
    if removed is not None:
        none = F.create_map().cast("map<string,string>")
        base = F.array_sort(F.map_entries(F.map_filter(none if target_labels is None else target_labels, lambda k, v: k != "__name__")))
        base = F.transform(base, lambda p: F.struct(p["key"].alias("name"), p["value"].alias("value")))
        report = lambda name: F.struct(F.lit(name), F.concat(F.array(F.struct(F.lit("__name__").alias("name"), F.lit(name).alias("value"))), base))
        rows = rows.unionByName(removed.select(F.col("target_id").cast("string").alias("target_id"), F.col("ts_ms").cast("long").alias("at"), F.lit(True).alias("removed"), F.array(*map(report, REPORTS)).cast(_SERIES).alias("series")))
    return rows.writeStream.foreachBatch(lambda part, turn: _follow(part, turn, path, f"{checkpoint}/staleness")).option("checkpointLocation", checkpoint)


def _follow(part: DataFrame, turn: int, path: str, place: str) -> None:
    """One trigger: its events in their order after each target's last one, what ends at them, and what lives on."""
    spark, own, before = part.sparkSession, f"{place}/{turn}", f"{place}/{turn - 1}"
    part = written(part, path=f"{own}/arrived")
    heads, live = spark.createDataFrame([], _HEADS), spark.createDataFrame([], _WALKED)
    if turn:
        heads, live = spark.read.schema(_HEADS).parquet(f"{before}/heads"), spark.read.schema(_WALKED).parquet(f"{before}/walked").where("live")
    came = part.groupBy("target_id", "at", "removed").agg(F.lit(False).alias("old"))
    came = came.unionByName(heads.select("target_id", F.col("last").alias("at"), (~F.col("scraped")).alias("removed"), F.lit(True).alias("old")))
    last = F.max(F.when(F.col("old"), F.col("at"))).over(Window.partitionBy("target_id"))
    late = ~F.col("old") & F.coalesce(F.when(F.col("removed"), F.col("at") < last).otherwise(F.col("at") <= last), F.lit(False))
    order = Window.partitionBy("target_id", "late").orderBy("at", "removed", F.col("old").desc())
    events = came.withColumn("late", late).withColumns({"n": F.row_number().over(order), "next_at": F.lead("at").over(order), "after_scrape": F.coalesce(~F.lag("removed").over(order), F.lit(False))})
    events = written(events, path=f"{own}/events")
    written(events.where(~F.col("late") & F.col("next_at").isNull()).select("target_id", F.col("at").alias("last"), (~F.col("removed")).alias("scraped")), path=f"{own}/heads")

    def numbered(rows: DataFrame, known: DataFrame) -> DataFrame:
        """``rows`` of events, with what the events ``known`` have of their own."""
        known = known.select(F.col("target_id").alias("_t"), F.col("at").alias("_at"), "n", "next_at")
        return rows.join(known, F.col("target_id").eqNullSafe(F.col("_t")) & (F.col("at") == F.col("_at"))).drop("_t", "_at")

    timely = events.where(~F.col("late"))
    scrapes = numbered(part.where(~F.col("removed")), timely.where(~F.col("removed") & ~F.col("old")))
    named = lambda rows: rows.select("target_id", "at", "n", "next_at", F.posexplode("series").alias("_i", "_s")).select("target_id", "at", "n", "next_at", "_i", "_s.identity", "_s.labels")
    held = numbered(live.select("target_id", "identity", "labels", "at"), timely.where("old")).withColumn("_i", F.lit(0))
    seen = named(scrapes).unionByName(held)
    following = F.lead("n").over(Window.partitionBy("target_id", "identity").orderBy("n", F.col("_i").desc()))
    seen = seen.withColumn("_next", following).where("_next IS NULL OR _next > n")  # of an identity's lines in a scrape, the first
    seen = seen.where("next_at IS NULL OR _next IS NULL OR _next > n + 1")
    walked = seen.select("target_id", "identity", "labels", "at", F.col("next_at").alias("ts_ms"), F.col("next_at").isNull().alias("live"))
    walked.write.mode("overwrite").partitionBy("live").parquet(f"{own}/walked")

    stale = spark.read.schema(_WALKED).parquet(f"{own}/walked").where(~F.col("live")).select("target_id", "identity", "labels", "ts_ms")
    reports = named(numbered(part.where("removed"), timely.where(F.col("removed") & ~F.col("old") & F.col("after_scrape")))).dropDuplicates(["target_id", "at", "identity"])
    found = stale.unionByName(reports.select("target_id", "identity", "labels", F.col("at").alias("ts_ms"))).withColumn("kind", F.lit("stale"))
    late = events.where("late").select("target_id", F.lit(None).cast("string").alias("identity"), F.lit(None).cast(LABELS).alias("labels"), F.col("at").alias("ts_ms"), F.lit("late").alias("kind"))
    found.unionByName(late).write.mode("overwrite").partitionBy("kind").parquet(f"{path}/turn={turn}")
    delete(spark, f"{own}/arrived")
    delete(spark, f"{place}/{turn - 2}")
