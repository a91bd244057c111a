"""Files of all kinds that jobs begin and end with, read by Spark from any file system that it knows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scrapes import fail_malformed_bodies

GROUPS = "array<struct<targets:array<string>,labels:map<string,string>>>"
_META = "name string, namespace string, uid string, labels map<string,string>, annotations map<string,string>"
_META_TYPE = _META.replace(" string", ":string").replace(" map", ":map").replace(", ", ",")
_CONTAINERS = "array<struct<name:string,image:string,ports:array<struct<name:string,containerPort:int,protocol:string>>>>"
_STATUSES = "array<struct<name:string,containerID:string>>"
#: Schemas of the four kinds of objects, as far as the jobs read them.
K8S = {
    "pods": (
        f"metadata struct<{_META_TYPE},ownerReferences:array<struct<kind:string,name:string,controller:boolean>>>, "
        f"spec struct<nodeName:string,containers:{_CONTAINERS},initContainers:{_CONTAINERS}>, "
        f"status struct<podIP:string,hostIP:string,phase:string,conditions:array<struct<type:string,status:string>>,containerStatuses:{_STATUSES},initContainerStatuses:{_STATUSES}>"
    ),
    "services": f"metadata struct<{_META_TYPE}>",
    "nodes": f"metadata struct<{_META_TYPE}>",
    "endpointslices": (
        f"metadata struct<{_META_TYPE}>, addressType string, ports array<struct<name:string,port:int,protocol:string,appProtocol:string>>, "
        "endpoints array<struct<addresses:array<string>,conditions:struct<ready:boolean,serving:boolean,terminating:boolean>,hostname:string,nodeName:string,zone:string,targetRef:struct<kind:string,name:string,namespace:string>>>"
    ),
}


def read_exposition_bodies(spark: SparkSession, path: str, pattern: str = "*.prom") -> DataFrame:
    """(file, body) of the text bodies of a folder; empty ones, those that are not UTF-8 and those that do not parse are left out."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(F.col("path").alias("file"), "content")
    text = raw.where(F.is_valid_utf8(F.col("content").cast("string"))).select("file", F.col("content").cast("string").alias("body"))
    text = text.where(F.col("body").rlike(r"\S"))
    scrapes = text.select("*", F.col("file").alias("scrape_id"), F.lit("").alias("target_id"), F.lit(0).cast("long").alias("start_ms"), F.lit(None).cast("double").alias("duration_s"), F.lit(None).cast("string").alias("fetch_error"))
    return fail_malformed_bodies(scrapes, body_limit=0).where("error IS NULL").select("file", "body")


def read_target_groups(spark: SparkSession, path: str, pattern: str = "*.{json,yml,yaml}") -> DataFrame:
    """(source, targets, labels) of the groups in files of JSON, or YAML where the parser is there; malformed files are left out.

    A file is malformed as a whole if it is no list of groups or one of them has no targets."""
    files = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True).select(F.input_file_name().alias("source"), F.col("value").alias("text"))
    is_yaml = F.col("source").rlike(r"\.ya?ml\z")
    groups = F.from_json("text", GROUPS, {"mode": "PERMISSIVE"})
    parsed = files.where(~is_yaml).select("source", groups.alias("groups")).unionByName(_yaml(files.where(is_yaml)))
    sound = F.size("groups") >= 0
    whole = ~F.exists("groups", lambda g: g.isNull() | g["targets"].isNull() | F.exists(g["targets"], lambda t: t.isNull()))
    rows = parsed.where(sound & whole).select("source", F.explode("groups").alias("g"))
    return rows.select("source", F.col("g.targets").alias("targets"), F.coalesce("g.labels", F.create_map().cast("map<string,string>")).alias("labels"))


def _yaml(files: DataFrame) -> DataFrame:
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            import json

            import yaml  # needed for YAML files only

            out = []
            for t in b["text"]:
                try:
                    out.append(json.dumps(yaml.safe_load(t), default=str))
                except (yaml.YAMLError, TypeError, ValueError):
                    out.append(None)
            yield pd.DataFrame({"source": b["source"], "json": out})

    return files.mapInPandas(parse, "source string, json string").select("source", F.from_json("json", GROUPS).alias("groups"))


def read_k8s_objects(spark: SparkSession, path: str, kind: str, namespaces: list[str] | None = None) -> DataFrame:
    """Objects of one kind from a snapshot of JSON lines; only those of ``namespaces`` (none or empty: all; nodes have none)."""
    df = spark.read.schema(K8S[kind]).json(path).where("metadata.name IS NOT NULL")
    return df.where(F.col("metadata.namespace").isin(namespaces)) if namespaces and kind != "nodes" else df


def write_samples(samples: DataFrame, path: str, mode: str = "append", ts_ms: str = "ts_ms") -> None:
    """Samples, markers or reports as Parquet, a folder for each day (UTC) of their time."""
    day = F.date_from_unix_date(F.floor(F.col(ts_ms) / 86_400_000).cast("int"))
    samples.withColumn("date", day).write.mode(mode).partitionBy("date").parquet(path)
