"""Staleness over scrape history: series that vanish get a marker at the next scrape of their target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from ..functions import labels as L
from .scrapes import REPORTS


def tracked_identities(samples: DataFrame) -> DataFrame:
    """Distinct series per scrape that staleness follows: emitted samples whose time is the scrape's start.

    An identity's final labels are those of its first line.
    """
    at_start = samples.where(F.col("ts_ms") == F.col("start_ms"))
    return at_start.groupBy("target_id", "start_ms", "identity").agg(F.min_by("labels", "line_no").alias("labels"))


def next_starts(scrapes: DataFrame) -> DataFrame:
    """Each scrape's successor of the same target, failed scrapes included."""
    order = Window.partitionBy("target_id").orderBy("start_ms")
    return scrapes.select("target_id", "start_ms").distinct().withColumn("next_start", F.lead("start_ms").over(order))


def stale_markers(samples: DataFrame, scrapes: DataFrame) -> DataFrame:
    """Markers (target_id, identity, labels, ts_ms, is_stale): present at a scrape, absent at the next one.

    The join keys contain the identity, so a large target spreads over the partitions; a failed scrape has no samples,
    so everything of its predecessor goes stale, and recovery emits nothing.
    """
    tracked = tracked_identities(samples)
    followed = tracked.join(next_starts(scrapes).where("next_start IS NOT NULL"), ["target_id", "start_ms"])
    present = tracked.select(F.col("target_id").alias("_t"), F.col("start_ms").alias("_s"), F.col("identity").alias("_i"))
    gone = followed.join(present, (F.col("target_id") == F.col("_t")) & (F.col("identity") == F.col("_i")) & (F.col("next_start") == F.col("_s")), "left_anti")
    return gone.select("target_id", "identity", "labels", F.col("next_start").alias("ts_ms"), F.lit(float("nan")).alias("value"), F.lit(True).alias("is_stale"))


def _last_tracked(samples: DataFrame, scrapes: DataFrame) -> DataFrame:
    last = scrapes.groupBy(F.col("target_id").alias("_t")).agg(F.max("start_ms").alias("_last"))
    return tracked_identities(samples).join(last, (F.col("target_id") == F.col("_t")) & (F.col("start_ms") == F.col("_last"))).drop("_t", "_last")


def tracked_series_count(samples: DataFrame, scrapes: DataFrame) -> DataFrame:
    """Live tracked identities of each target after its last scrape."""
    live = _last_tracked(samples, scrapes).groupBy(F.col("target_id").alias("_t")).agg(F.count("*").alias("n"))
    return scrapes.select("target_id").distinct().join(live, F.col("target_id") == F.col("_t"), "left").select("target_id", F.coalesce("n", F.lit(0)).alias("tracked"))


def removed_target_markers(samples: DataFrame, scrapes: DataFrame, removed: DataFrame, target_labels: Column | None = None) -> DataFrame:
    """``removed`` (target_id, ts_ms): markers (target_id, identity, labels, ts_ms, value, is_stale) for all tracked series of
    the target, with their final labels, and for its five report series, with ``target_labels`` (a map of the columns of
    ``removed``) and their name."""
    none = F.create_map().cast("map<string,string>")
    own = none if target_labels is None else target_labels
    gone = removed.select(F.col("target_id").alias("_r"), "ts_ms", own.alias("_own"))
    series = _last_tracked(samples, scrapes).join(gone, F.col("target_id") == F.col("_r")).select("target_id", "identity", "labels", "ts_ms")
    known = scrapes.select("target_id").distinct()
    reports = gone.join(known, F.col("target_id") == F.col("_r"), "left_semi").withColumn("identity", F.explode(F.array(*[F.lit(r) for r in REPORTS])))
    named = F.map_concat(F.map_filter("_own", lambda k, v: k != "__name__"), F.create_map(F.lit("__name__"), F.col("identity")))
    kind = samples.schema["labels"].dataType
    if not isinstance(kind, MapType):
        named = L.sort_labels(named).cast(kind)
    reports = reports.select(F.col("_r").alias("target_id"), "identity", named.alias("labels"), "ts_ms")
    return series.unionByName(reports).withColumns({"value": F.lit(float("nan")), "is_stale": F.lit(True)})
