"""Decoded metric families to series: validation, scalar series, and the form that a histogram takes.

A scrape's row has ``families``, an array of ``FAMILY`` structs in the order of its body.  Its verdict is found inside the row,
as for text bodies; a malformed family fails the whole body.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.exposition import LABEL_NAME, MAX_LABELS, NAME, let
from .histograms import validate_native_histogram

SPAN = "struct<offset:int,length:bigint>"
HISTOGRAM = (
    "struct<sample_count:decimal(20,0),sample_count_float:double,sample_sum:double,schema:int,zero_threshold:double,zero_count:decimal(20,0),zero_count_float:double,"
    f"positive_span:array<{SPAN}>,positive_delta:array<bigint>,positive_count:array<double>,negative_span:array<{SPAN}>,negative_delta:array<bigint>,negative_count:array<double>,"
    "bucket:array<struct<upper_bound:double,cumulative_count:decimal(20,0),cumulative_count_float:double>>>"
)
METRIC = f"struct<label:array<struct<name:string,value:string>>,timestamp_ms:bigint,value:double,quantile:array<struct<quantile:double,value:double>>,histogram:{HISTOGRAM}>"
FAMILY = f"struct<name:string,type:string,metric:array<{METRIC}>>"
SCALARS = ("counter", "gauge", "untyped")
HISTOGRAMS = ("histogram", "gauge_histogram")
TYPES = (*SCALARS, "summary", *HISTOGRAMS)


def is_native(h: Column) -> Column:
    """Spans, a zero bucket or zero observations make a histogram native."""
    more = lambda c: F.coalesce(c > 0, F.lit(False))
    return more(F.size(h["positive_span"])) | more(F.size(h["negative_span"])) | more(h["zero_threshold"]) | more(h["zero_count"]) | more(h["zero_count_float"])


def is_float(h: Column) -> Column:
    """Any float count makes a histogram a float histogram, whose buckets are absolute counts."""
    return F.coalesce(h["sample_count_float"] > 0, F.lit(False)) | F.coalesce(h["zero_count_float"] > 0, F.lit(False))


def _first(c: Column) -> Column:
    return F.get(F.filter(c, lambda x: x.isNotNull()), F.lit(0))


def family_error(f: Column, native_histograms: bool = False, classic_histograms: bool = False) -> Column:
    """Why a family is malformed, or null."""
    name = F.coalesce(f["name"], F.lit(""))

    def metric(m: Column) -> Column:
        pairs = F.coalesce(m["label"], F.array().cast("array<struct<name:string,value:string>>"))
        names = F.transform(pairs, lambda p: F.coalesce(p["name"], F.lit("")))
        all_ = F.concat(F.array(F.lit("__name__")), names)
        h = m["histogram"]
        native = is_native(h) if native_histograms else F.lit(False)
        classic = (F.size(h["bucket"]) > 0) if classic_histograms else F.lit(False)
        derived = F.when(f["type"] == "summary", "quantile").when(f["type"].isin(*HISTOGRAMS) & (~native | classic), "le")
        spans = lambda side: F.coalesce(h[f"{side}_span"], F.array().cast(f"array<{SPAN}>"))
        deltas = lambda side: F.coalesce(h[f"{side}_delta"], F.array().cast("array<bigint>"))
        counts = lambda side: F.coalesce(h[f"{side}_count"], F.array().cast("array<double>"))
        side = lambda s: validate_native_histogram(F.coalesce(h["schema"], F.lit(0)), spans(s), deltas(s), counts(s), is_float(h))
        histogram = F.when(f["type"].isin(*HISTOGRAMS) & h.isNotNull() & native, F.coalesce(side("negative"), side("positive")))
        return (
            F.when(F.size(pairs) + 1 > MAX_LABELS, "too many labels")
            .when(F.exists(names, lambda n: ~n.rlike(rf"\A{LABEL_NAME}\z")), "invalid label name")
            .when(F.size(F.array_distinct(all_)) < F.size(all_), "duplicate label name")
            .when(derived.isNotNull() & F.array_contains(names, F.coalesce(derived, F.lit(""))), F.concat(derived, F.lit(" collides with a derived label")))
            .otherwise(histogram)
        )

    metrics = F.coalesce(f["metric"], F.array().cast(f"array<{METRIC}>"))
    return (
        F.when(name == "", "metric family without a name")
        .when(~name.rlike(rf"\A{NAME}\z"), "invalid metric name")
        .when(~F.coalesce(f["type"], F.lit("counter")).isin(*TYPES), "unknown metric type")
        .otherwise(_first(F.transform(metrics, metric)))
    )


def validate_families(scrapes: DataFrame, native_histograms: bool = False, classic_histograms: bool = False) -> DataFrame:
    """``scrapes`` with ``error`` (of the first malformed family) and ``families`` emptied where there is one."""
    families = F.coalesce(F.col("families"), F.array().cast(f"array<{FAMILY}>"))
    out = scrapes.withColumn("error", _first(F.transform(families, lambda f: family_error(f, native_histograms, classic_histograms))))
    return out.withColumn("families", F.when(F.col("error").isNull(), families).otherwise(F.slice(families, 1, 0)))


def family_timestamps(exposed: Column, start: Column, honor: bool = True) -> Column:
    """The exposed milliseconds if they are honored and not 0, else the scrape's start."""
    return F.when(F.lit(honor) & (exposed != 0), exposed).otherwise(start)


def family_metrics(scrapes: DataFrame, honor_timestamps: bool = True) -> DataFrame:
    """One row per metric of sound bodies: scrape_id, family, type, labels (a map, __name__ first), ts_ms, metric."""
    df = L.each(scrapes.select("scrape_id", "start_ms", "families"), F.col("families"), "f").drop("families").select("*", F.explode("f.metric").alias("metric"))
    pairs = F.transform(F.coalesce("metric.label", F.array().cast("array<struct<name:string,value:string>>")), lambda p: F.struct(p["name"].alias("key"), F.coalesce(p["value"], F.lit("")).alias("value")))
    labels = F.map_from_entries(F.concat(F.array(F.struct(F.lit("__name__").alias("key"), F.col("f.name").alias("value"))), pairs))
    kind = F.coalesce("f.type", F.lit("counter"))
    return df.select("scrape_id", F.col("f.name").alias("family"), kind.alias("type"), labels.alias("labels"), family_timestamps(F.col("metric.timestamp_ms"), F.col("start_ms"), honor_timestamps).alias("ts_ms"), "metric")


def expand_scalar_metrics(metrics: DataFrame) -> DataFrame:
    """One series per counter, gauge and untyped metric; a missing value is 0."""
    return metrics.where(F.col("type").isin(*SCALARS)).withColumn("value", F.coalesce("metric.value", F.lit(0.0))).drop("metric")


def select_histogram_form(metrics: DataFrame, native_histograms: bool, classic_histograms: bool = False) -> DataFrame:
    """Histogram metrics with ``form``: a row "native", a row "classic", or both where classic series are always kept and
    classic buckets exist; a missing histogram is an empty one."""
    h = F.coalesce(F.col("metric.histogram"), F.lit(None).cast(HISTOGRAM))
    df = metrics.where(F.col("type").isin(*HISTOGRAMS)).withColumn("histogram", h).drop("metric")
    df = df.withColumn("_native", F.lit(native_histograms) & is_native(F.col("histogram")))
    both = F.lit(classic_histograms) & F.coalesce(F.size("histogram.bucket") > 0, F.lit(False))
    forms = F.filter(F.array(F.when(F.col("_native"), "native"), F.when(~F.col("_native") | both, "classic")), lambda x: x.isNotNull())
    return df.withColumn("form", F.explode(forms)).drop("_native")


def build_native_histogram(h: Column, kind: Column) -> Column:
    """The native histogram of an exposed one: any float count makes it a float histogram with absolute counts, else it has
    integer counts and deltas; a gauge histogram's reset hint is gauge."""
    zero = lambda c, v: F.coalesce(c, F.lit(v))
    floats = is_float(h)
    spans = lambda s: F.transform(zero_array(h[s], f"array<{SPAN}>"), lambda x: F.struct(zero(x["offset"], 0).alias("offset"), F.coalesce(x["length"], F.lit(0).cast("bigint")).alias("length")))

    def built(floating: Column) -> Column:
        whole = lambda c: F.when(~floating, F.coalesce(c, F.lit(0).cast("decimal(20,0)")))
        double = lambda c: F.when(floating, zero(c, 0.0))
        return F.struct(
            F.when(kind == "gauge_histogram", "gauge").otherwise("unknown").alias("reset_hint"),
            floating.alias("is_float"),
            zero(h["schema"], 0).alias("schema"),
            zero(h["sample_sum"], 0.0).alias("sum"),
            zero(h["zero_threshold"], 0.0).alias("zero_threshold"),
            whole(h["sample_count"]).alias("count_int"),
            double(h["sample_count_float"]).alias("count_float"),
            whole(h["zero_count"]).alias("zero_count_int"),
            double(h["zero_count_float"]).alias("zero_count_float"),
            spans("positive_span").alias("positive_spans"),
            spans("negative_span").alias("negative_spans"),
            *(F.when(~floating, zero_array(h[f"{s}_delta"], "array<bigint>")).alias(f"{s}_deltas") for s in ("positive", "negative")),
            *(F.when(floating, zero_array(h[f"{s}_count"], "array<double>")).alias(f"{s}_counts") for s in ("positive", "negative")),
        )

    return let(floats, built)


def zero_array(c: Column, kind: str) -> Column:
    return F.coalesce(c, F.array().cast(kind))
