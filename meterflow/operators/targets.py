"""Discovery groups to scrape targets, and differences between snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from .relabel import Rule, relabel


def static_target_groups(spark, groups: list[tuple[list[str], dict[str, str]]]) -> DataFrame:
    return spark.createDataFrame([("static", a, m) for a, m in groups], "source string, targets array<string>, labels map<string,string>")


def merge_target_groups(*groups: DataFrame) -> DataFrame:
    out = groups[0]
    for g in groups[1:]:
        out = out.unionByName(g)
    return out


def _defaults(labels: Column, defaults: dict[str, Column]) -> Column:
    return L.add_absent(labels, F.create_map(*[x for k, v in defaults.items() for x in (F.lit(k), v)]))


def build_targets(groups: DataFrame, job: str, rules: list[Rule] = [], scheme: str = "http", path: str = "/metrics", params: dict[str, list[str]] = {}) -> DataFrame:  # noqa: B006
    """url, params and final labels of each address; defaults only where discovery set none, then relabeling."""
    df = groups.select("labels", F.explode("targets").alias("_address"))
    first = {f"__param_{k}": F.lit(v[0]) for k, v in params.items() if v}
    labels = F.map_concat(L.remove_label(F.coalesce("labels", F.create_map().cast("map<string,string>")), F.lit("__address__")), F.create_map(F.lit("__address__"), F.col("_address")))
    labels = _defaults(labels, {"job": F.lit(job), "__scheme__": F.lit(scheme), "__metrics_path__": F.lit(path)} | first)
    df = relabel(df.withColumn("labels", labels), rules).where(L.get(F.col("labels"), "__address__") != "")
    return finalize_target_labels(target_url_and_params(df)).drop("_address")


def target_url_and_params(df: DataFrame) -> DataFrame:
    m, get = F.col("labels"), lambda k: L.get(F.col("labels"), k)
    path = F.when(get("__metrics_path__").startswith("/"), get("__metrics_path__")).otherwise(F.concat(F.lit("/"), get("__metrics_path__")))
    params = F.transform_keys(F.map_filter(m, lambda k, v: k.startswith("__param_")), lambda k, v: F.substring(k, F.lit(9), F.length(k)))
    return df.withColumns({"url": F.concat(get("__scheme__"), F.lit("://"), get("__address__"), path), "params": params})


def finalize_target_labels(df: DataFrame) -> DataFrame:
    """instance defaults to the address, names that begin with two underscores go, the rest is sorted."""
    m = _defaults(F.col("labels"), {"instance": L.get(F.col("labels"), "__address__")})
    return df.withColumn("labels", L.sort_labels(F.map_filter(m, lambda k, v: ~k.startswith("__"))))


def distinct_targets(targets: DataFrame) -> DataFrame:
    return targets.withColumn("params", L.sort_labels(F.col("params"))).dropDuplicates(["url", "params", "labels"])


def diff_targets(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """key with change: removed, added or unchanged; keys are null-safe."""
    a = old.select(*key, F.lit(1).alias("o"), F.lit(0).alias("n"))
    both = a.union(new.select(*key, F.lit(0), F.lit(1))).groupBy(*key).agg(F.max("o").alias("o"), F.max("n").alias("n"))
    return both.withColumn("change", F.when(F.col("n") == 0, "removed").when(F.col("o") == 0, "added").otherwise("unchanged")).drop("o", "n")


def effective_job_settings(jobs: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Per-job settings fall back to the global ones."""
    return jobs.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in defaults.items()})


def join_host_port(host: Column, port: Column) -> Column:
    """``host:port``, IPv6 bracketed."""
    return F.when(F.contains(host, F.lit(":")), F.concat(F.lit("["), host, F.lit("]:"), port.cast("string"))).otherwise(F.concat(host, F.lit(":"), port.cast("string")))
