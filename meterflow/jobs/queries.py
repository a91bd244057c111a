"""Registered queries over the driver's tables, each beside the SQL that gives the same rows.

Scrape bodies are rendered from ``events``: a target is a user, a scrape is a day of one, a line is an event, so that bodies
stay short and grow in number; every event whose id is divisible by 997 is a malformed line, which fails its whole body.  Label sets come from ``customer`` and ``nation``,
groups from ``supplier``, Kubernetes snapshots from ``part``, ``orders``, ``lineitem`` and ``customer``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exposition as X
from ..functions import labels as L
from ..functions import units as U
from ..functions.numbers import format_bound as format_text
from .. import sources as I
from .. import streaming as STREAM
from ..operators import delivery as D
from ..operators import families as M
from ..operators import histograms as H
from ..operators import kubernetes as K
from ..operators import pseudonyms as P
from ..operators import scrapes as S
from ..operators import staleness as ST
from ..operators import targets as T
from ..operators.relabel import Rule, relabel

QUERIES: dict = {}
SQL: dict = {}
DAY_MS = 86_400_000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- scrapes -----------------------------------------------------------------------------------------------------------


def scrapes(spark, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", "props", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    value = F.when(F.col("event_id") % 997 == 0, "oops").otherwise(F.col("value").cast("string"))
    spaced = F.col("event_id") % 5 == 0
    part = lambda plain, wide: F.when(spaced, wide).otherwise(plain)
    time = F.when(F.col("event_id") % 7 == 0, "").otherwise(F.concat(F.lit(" "), "ms"))
    line = F.concat("event_type", part('{k="', '{ k = "'), F.get_json_object("props", "$.k"), part('",user="', '" , user= "'), "user_id", part('",id="', '",\tid ="'), "event_id", part('"} ', '", } '), value, time)
    day = F.floor(F.col("ms") / DAY_MS)
    e = e.select(F.col("user_id").alias("t"), day.alias("d"), F.struct("event_id", line.alias("line")).alias("x"))
    g = e.groupBy("t", "d").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return g.select((F.col("d") * 10_000_000_000 + F.col("t")).alias("scrape_id"), F.concat(F.lit("t"), "t").alias("target_id"), (F.col("d") * DAY_MS).alias("start_ms"), F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("body"), F.lit(0.5).alias("duration_s"), F.lit(None).cast("string").alias("fetch_error"))


RULES = [Rule("drop", ("__name__",), regex="err.*"), Rule("replace", ("user",), regex="(.*)", target_label="customer", replacement="c-$1"), Rule("labeldrop", regex="user")]


def own_labels():
    return F.create_map(F.lit("job"), F.lit("events"), F.lit("k"), F.lit("target"), F.lit("instance"), F.col("target_id"))


def stats(spark, sf: str) -> DataFrame:
    return S.scrape_stats(S.fail_malformed_bodies(scrapes(spark, sf)), own_labels(), RULES)


def pipeline(spark, sf: str):
    return S.scrape_pipeline(scrapes(spark, sf), own_labels(), RULES, F.create_map(F.lit("region"), F.lit("eu"), F.lit("job"), F.lit("unused")))


EV = f"""e AS (SELECT *, user_id AS t, (epoch_us(ts) // 1000) // {DAY_MS} AS d, (epoch_us(ts) // 1000) AS ms, json_extract_string(props, '$.k') AS k FROM events),
n AS (SELECT *, CASE WHEN event_id % 7 = 0 THEN d * {DAY_MS} ELSE ms END AS stamp, d * 10000000000 + t AS scrape_id, row_number() OVER (PARTITION BY t, d ORDER BY event_id) AS line_no FROM e),
s AS (SELECT scrape_id, 't' || any_value(t) AS target_id, any_value(d) * {DAY_MS} AS start_ms, count(*) AS lines,
        count(*) FILTER (event_type NOT LIKE 'err%') AS good, min(line_no) FILTER (event_id % 997 = 0) AS bad FROM n GROUP BY scrape_id)"""


@query(f"WITH {EV} SELECT scrape_id, line_no::INTEGER AS line_no, event_type AS name, 4 AS n_labels, value, stamp AS ts_ms FROM n JOIN s USING (scrape_id) WHERE bad IS NULL")
def parse_sample_lines(spark, sf):
    df = S.parse_samples(S.fail_malformed_bodies(scrapes(spark, sf)))
    return df.select("scrape_id", "line_no", L.get(F.col("labels"), "__name__").alias("name"), F.size("labels").alias("n_labels"), "value", "ts_ms")


@query(f"WITH {EV} SELECT scrape_id, CASE WHEN bad IS NOT NULL THEN 'malformed value' END AS error, bad::INTEGER AS error_line, CASE WHEN bad IS NULL THEN lines ELSE 0 END AS scraped FROM s")
def fail_malformed_bodies(spark, sf):
    return S.fail_malformed_bodies(scrapes(spark, sf)).select("scrape_id", "error", "error_line", "scraped")


@query(f"""WITH {EV} SELECT scrape_id, CASE WHEN bad IS NOT NULL THEN 'malformed value' WHEN lines > 3 THEN 'sample limit exceeded' END AS error, bad::INTEGER AS error_line, CASE WHEN bad IS NULL THEN lines ELSE 0 END AS scraped FROM s""")
def judge_bodies(spark, sf):
    """Verdicts of bodies that are cut into pieces of some lines."""
    return S.judge_bodies(scrapes(spark, sf), sample_limit=3, piece_bytes=90)[0].select("scrape_id", "error", "error_line", "scraped")


@query(SQL["parse_sample_lines"])
def parse_body_pieces(spark, sf):
    df = S.parse_samples(S.judge_bodies(scrapes(spark, sf), piece_bytes=90)[1])
    return df.select("scrape_id", "line_no", L.get(F.col("labels"), "__name__").alias("name"), F.size("labels").alias("n_labels"), "value", "ts_ms")


@query(f"WITH {EV} SELECT scrape_id, CASE WHEN bad IS NOT NULL THEN 'malformed value' WHEN lines > 3 THEN 'sample limit exceeded' END AS error, CASE WHEN bad IS NULL THEN lines ELSE 0 END AS scraped, CASE WHEN bad IS NULL AND lines <= 3 THEN lines ELSE 0 END::INTEGER AS passed FROM s")
def enforce_sample_limit(spark, sf):
    return S.fail_malformed_bodies(scrapes(spark, sf), sample_limit=3).select("scrape_id", "error", "scraped", F.size("lines").alias("passed"))


@query(f"""WITH {EV}, b AS (SELECT scrape_id, sum(octet_length(encode(event_type || '{{k="' || k || '",user="' || user_id || '",id="' || event_id || '"}} ' || CASE WHEN event_id % 997 = 0 THEN 'oops' ELSE value::VARCHAR END || CASE WHEN event_id % 7 = 0 THEN '' ELSE ' ' || ms END)) + CASE WHEN event_id % 5 = 0 THEN 10 ELSE 0 END + 1) - 1 AS bytes FROM n GROUP BY 1)
SELECT scrape_id, bytes > 200 AS too_big FROM b""")
def enforce_body_size_limit(spark, sf):
    df = S.fail_malformed_bodies(scrapes(spark, sf), body_limit=200)
    return df.select("scrape_id", F.coalesce(F.col("error") == "body size limit exceeded", F.lit(False)).alias("too_big"))


@query(f"""WITH {EV} SELECT scrape_id, line_no::INTEGER AS line_no, '__name__=' || event_type || ',customer=c-' || user_id || ',exported_k=' || k || ',id=' || event_id || ',instance=' || target_id || ',job=events,k=target,region=eu' AS labels, value, stamp AS ts_ms
FROM n JOIN s USING (scrape_id) WHERE bad IS NULL AND event_type NOT LIKE 'err%'""")
def scrape_pipeline(spark, sf):
    return pipeline(spark, sf)[1].select("scrape_id", "line_no", shown("labels"), "value", "ts_ms")


@query(SQL["scrape_pipeline"])
def relabel_by_series(spark, sf):
    """The pipeline's samples by a dimension of series: of the earlier half first, then brought up to date."""
    samples = I.written(S.parse_samples(S.fail_malformed_bodies(scrapes(spark, sf))), "samples")
    region = F.create_map(F.lit("region"), F.lit("eu"), F.lit("job"), F.lit("unused"))
    early = I.written(S.series_dimension(samples.where(F.col("start_ms") < F.lit(1_705_276_800_000)), own_labels(), RULES, region), "series")
    series = I.written(S.series_dimension(samples, own_labels(), RULES, region, known=early), "series")
    return S.with_series_labels(samples, series).select("scrape_id", "line_no", shown("labels"), "value", "ts_ms")


def shown(labels: str, sort: bool = False):
    """Labels as one string, for comparison."""
    c = L.sort_labels(F.col(labels)) if sort else F.col(labels)
    return F.array_join(F.transform(c, lambda p: F.concat(p["name"], F.lit("="), p["value"])), ",").alias(labels)


@query(f"WITH {EV} SELECT scrape_id, target_id, start_ms, (bad IS NULL)::INTEGER AS up, CASE WHEN bad IS NULL THEN lines ELSE 0 END AS scraped, CASE WHEN bad IS NULL THEN good ELSE 0 END AS kept FROM s")
def scrape_stats(spark, sf):
    return stats(spark, sf).drop("duration_s", "error")


@query(f"""WITH {EV}, r AS (SELECT scrape_id, start_ms AS ts_ms, (bad IS NULL)::DOUBLE AS up, CASE WHEN bad IS NULL THEN lines ELSE 0 END::DOUBLE AS a, CASE WHEN bad IS NULL THEN good ELSE 0 END::DOUBLE AS b FROM s)
SELECT scrape_id, ts_ms, 'up' AS name, up AS value FROM r UNION ALL SELECT scrape_id, ts_ms, 'scrape_duration_seconds', 0.5 FROM r
UNION ALL SELECT scrape_id, ts_ms, 'scrape_samples_scraped', a FROM r UNION ALL SELECT scrape_id, ts_ms, 'scrape_samples_post_metric_relabeling', b FROM r
UNION ALL SELECT scrape_id, ts_ms, 'scrape_series_added', b FROM r""")
def scrape_report_series(spark, sf):
    return S.report_series(stats(spark, sf)).select("scrape_id", "ts_ms", "name", "value")


@query(f"""WITH {EV}, o AS (SELECT *, bad IS NOT NULL AS f, lag(bad IS NOT NULL) OVER (PARTITION BY target_id ORDER BY start_ms) AS p, sum((bad IS NULL)::INT) OVER (PARTITION BY target_id ORDER BY start_ms) AS i FROM s)
SELECT scrape_id, CASE WHEN f AND coalesce(NOT p, true) THEN 'down' WHEN NOT f AND p THEN 'recovered' WHEN f THEN 'failing' END AS transition, sum(f::INT) OVER (PARTITION BY target_id, i ORDER BY start_ms)::BIGINT AS failures FROM o""")
def scrape_health_transitions(spark, sf):
    return S.scrape_health_transitions(stats(spark, sf)).select("scrape_id", "transition", "failures")


@query("""SELECT event_id, value AS parsed, CASE event_id % 4 WHEN 0 THEN 'NaN' WHEN 1 THEN NULL WHEN 2 THEN '-inf' ELSE 'inf' END AS special, event_id * 1000 + 500 AS from_seconds, event_id AS from_ms FROM events""")
def parse_values_and_timestamps(spark, sf):
    e = table(spark, sf, "events")
    odd = F.element_at(F.array(F.lit("nan"), F.lit("0x1p3"), F.lit("-INF"), F.lit("++Infinity")), (F.col("event_id") % 4 + 1).cast("int"))
    v = X.parse_metric_value(odd)
    special = F.when(F.isnan(v), "NaN").when(v == float("inf"), "inf").when(v == float("-inf"), "-inf")
    return e.select("event_id", X.parse_metric_value(F.concat(F.lit("+"), F.col("value").cast("string"))).alias("parsed"), special.alias("special"), X.parse_sample_timestamp(F.concat("event_id", F.lit(".5"))).alias("from_seconds"), X.parse_sample_timestamp(F.col("event_id").cast("string")).alias("from_ms"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'protobuf' WHEN 3 THEN 'protobuf' WHEN 4 THEN 'text' END AS format FROM events""")
def body_format(spark, sf):
    kinds = ["text/plain; version=0.0.4", "application/vnd.google.protobuf; proto=io.prometheus.client.MetricFamily; encoding=delimited", "application/vnd.google.protobuf; proto=other; encoding=delimited", 'Application/VND.google.protobuf;PROTO="io.prometheus.client.MetricFamily"; Encoding=delimited', "weird/type"]
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", X.body_format(kind).alias("format"))


# --- labels and relabeling ---------------------------------------------------------------------------------------------

CU = "c AS (SELECT c_custkey, c_name, c_mktsegment, n_name, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'z' || c_custkey % 7 END AS zone FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def customers(spark, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    zone = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.concat(F.lit("z"), F.col("c_custkey") % 7))
    labels = F.create_map(F.lit("__meta_name"), "c_name", F.lit("__meta_segment"), "c_mktsegment", F.lit("nation"), "n_name", F.lit("zone"), zone)
    return c.select("c_custkey", labels.alias("labels"))


def _rel(name: str, rules: list[Rule], labels: str, where: str = "true"):
    """Registers one relabeling query; ``labels`` is SQL for the sorted labels, zone left out when empty."""

    def run(spark, sf):
        return relabel(customers(spark, sf), rules).select("c_custkey", shown("labels", sort=True))

    run.__name__ = name
    query(f"WITH {CU}, z AS (SELECT *, '__meta_name=' || c_name || ',__meta_segment=' || c_mktsegment AS m, 'nation=' || n_name AS na, CASE WHEN zone <> '' THEN ',zone=' || zone ELSE '' END AS zo FROM c) SELECT c_custkey, {labels} AS labels FROM z WHERE {where}")(run)


_rel("relabel_replace", [Rule("replace", ("nation", "zone"), regex=r"NATION_(\d+);(.*)", target_label="nation_${1}", replacement="$2-${1}$$"), Rule("replace", ("zone",), target_label="zone2")], "m || ',' || na || ',nation_' || substr(n_name, 8) || '=' || zone || '-' || substr(n_name, 8) || '$' || zo || replace(zo, 'zone', 'zone2')")
_rel("relabel_keep", [Rule("keep", ("__meta_segment", "nation"), regex="F.*;NATION_1[0-9]*")], "m || ',' || na || zo", "c_mktsegment LIKE 'F%' AND n_name LIKE 'NATION_1%'")
_rel("relabel_drop", [Rule("drop", ("zone",), regex="z[12]|")], "m || ',' || na || zo", "zone NOT IN ('z1', 'z2', '')")
_rel("relabel_keepequal", [Rule("lowercase", ("zone",), target_label="copy"), Rule("replace", ("nation",), regex=".*_(.)", target_label="copy", replacement="z$1"), Rule("keepequal", ("zone",), target_label="copy")], "'__meta_name=' || c_name || ',__meta_segment=' || c_mktsegment || CASE WHEN zone <> '' THEN ',copy=' || zone ELSE '' END || ',' || na || zo", "zone = CASE WHEN length(n_name) = 8 THEN 'z' || substr(n_name, 8) ELSE zone END")
_rel("relabel_dropequal", [Rule("dropequal", ("zone",), target_label="missing")], "m || ',' || na || zo", "zone <> ''")
_rel("relabel_hashmod", [Rule("hashmod", ("__meta_name",), target_label="__shard", modulus=1000)], "m || ',__shard=' || (('0x' || substr(md5(c_name), 17, 16))::UBIGINT % 1000) || ',' || na || zo")
_rel("relabel_labelmap", [Rule("labelmap", regex="__meta_(.*)", replacement="flag_$1")], "m || ',flag_name=' || c_name || ',flag_segment=' || c_mktsegment || ',' || na || zo")
_rel("relabel_labeldrop", [Rule("labeldrop", regex="__.*")], "na || zo")
_rel("relabel_labelkeep", [Rule("labelkeep", regex="__meta_n.*|zone")], "'__meta_name=' || c_name || zo")
# an empty result stays in its label until the chain ends, so that it is copied over the nation
_rel("relabel_lowercase", [Rule("lowercase", ("__meta_segment",), target_label="low"), Rule("lowercase", ("zone",), target_label="t1"), Rule("labelmap", regex="t1", replacement="nation")], "m || ',low=' || lower(c_mktsegment) || CASE WHEN zone <> '' THEN ',nation=' || zone || ',t1=' || zone ELSE '' END || zo")
_rel("relabel_uppercase", [Rule("uppercase", ("__meta_name", "zone"), separator="/", target_label="up"), Rule("uppercase", ("zone",), target_label="t1"), Rule("labelmap", regex="t1", replacement="nation")], "m || CASE WHEN zone <> '' THEN ',nation=' || upper(zone) || ',t1=' || upper(zone) ELSE '' END || ',up=' || upper(c_name || '/' || zone) || zo")
_rel("drop_empty_labels", [], "m || ',' || na || zo")


@query(f"""WITH {CU} SELECT c_custkey,
 '__meta_name=' || c_name || ',__meta_segment=s,exported___meta_segment=y,exported_exported___meta_segment=' || c_mktsegment || ',exported_nation=' || n_name || ',nation=home,region=r,zone=' || zone AS mine,
 '__meta_name=' || c_name || ',__meta_segment=' || c_mktsegment || ',exported___meta_segment=y,exported_nation=e,nation=' || n_name || ',region=r,zone=' || zone AS theirs FROM c""")
def merge_target_labels(spark, sf):
    own = {"nation": "home", "region": "r", "exported_nation": "e", "__meta_segment": "s", "exported___meta_segment": "y"}
    target = F.create_map(*[F.lit(x) for p in own.items() for x in p])
    df = customers(spark, sf)
    df = df.select("c_custkey", L.merge_target_labels(F.col("labels"), target, F.lit(False)).alias("mine"), L.merge_target_labels(F.col("labels"), target, F.lit(True)).alias("theirs"))
    return df.select("c_custkey", shown("mine", True), shown("theirs", True))


@query(f"WITH {CU} SELECT c_custkey, '__meta_name=' || c_name || ',__meta_segment=' || c_mktsegment || ',dc=x,nation=' || n_name || ',zone=' || zone AS labels FROM c")
def add_external_labels(spark, sf):
    more = F.create_map(F.lit("zone"), F.lit("ext"), F.lit("dc"), F.lit("x"))
    return customers(spark, sf).withColumn("labels", L.add_external_labels(F.col("labels"), more)).select("c_custkey", shown("labels", True))


@query("SELECT p_partkey, regexp_replace(p_brand || '-' || p_name, '[^a-zA-Z0-9_]', '_', 'g') AS name FROM part")
def sanitize_label_name(spark, sf):
    return table(spark, sf, "part").select("p_partkey", L.sanitize_label_name(F.concat("p_brand", F.lit("-"), "p_name")).alias("name"))


@query("""SELECT p_partkey, p_partkey * 3600000 + p_size * 60000 + 5 AS ms, CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE 0 END::BIGINT AS odd,
 CASE p_partkey % 5 WHEN 0 THEN p_size * 1048576 + 524288 WHEN 1 THEN p_partkey * 1000 WHEN 2 THEN p_size * 1024 // CASE WHEN p_size < 10 THEN 10 ELSE 100 END WHEN 3 THEN p_size * 1048576 + 1073741825 END::DOUBLE AS bytes FROM part""")
def parse_units(spark, sf):
    p = table(spark, sf, "part")
    odd = F.when(F.col("p_partkey") % 2 == 0, "1m1h").otherwise("0")
    sizes = F.array(F.concat("p_size", F.lit(".5MiB")), F.concat(F.lit(" "), F.col("p_partkey") * 1000, F.lit("\n")), F.concat(F.lit("."), "p_size", F.lit("KB")), F.concat(F.lit("\t"), "p_size", F.lit(".MiB1.000000001GiB")), F.concat("p_size", F.lit("kB")))
    size = F.get(sizes, (F.col("p_partkey") % 5).cast("int"))
    return p.select("p_partkey", U.parse_duration_ms(F.concat("p_partkey", F.lit("h"), "p_size", F.lit("m5ms"))).alias("ms"), U.parse_duration_ms(odd).alias("odd"), U.parse_size_bytes(size).cast("double").alias("bytes"))


# --- staleness ---------------------------------------------------------------------------------------------------------


def history(spark, sf: str) -> tuple[DataFrame, DataFrame]:
    """Samples and scrapes per user and day; days divisible by 11 with the user failed and have no samples."""
    e = table(spark, sf, "events").select(F.concat(F.lit("u"), "user_id").alias("target_id"), (F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / DAY_MS) * DAY_MS).alias("start_ms"), F.concat("event_type", F.lit("|"), F.get_json_object("props", "$.k").cast("int") % 5).alias("identity"), "event_id", "user_id")
    failed = (F.floor(F.col("start_ms") / DAY_MS) + F.col("user_id")) % 11 == 0
    samples = e.where(~failed).select("target_id", "start_ms", "identity", F.col("event_id").alias("line_no"), F.create_map(F.lit("id"), "identity").alias("labels"), F.when(F.col("event_id") % 10 == 0, F.col("start_ms") + 1).otherwise(F.col("start_ms")).alias("ts_ms"))
    return samples, e.select("target_id", "start_ms").distinct()


HI = f"""h AS (SELECT 'u' || user_id AS target_id, (epoch_us(ts) // 1000) // {DAY_MS} * {DAY_MS} AS start_ms, event_type || '|' || (json_extract_string(props, '$.k')::INT % 5) AS identity, event_id, ((epoch_us(ts) // 1000) // {DAY_MS} + user_id) % 11 = 0 AS failed FROM events),
sc AS (SELECT *, lead(start_ms) OVER (PARTITION BY target_id ORDER BY start_ms) AS next_start FROM (SELECT DISTINCT target_id, start_ms FROM h)),
tr AS (SELECT DISTINCT target_id, start_ms, identity FROM h WHERE NOT failed AND event_id % 10 <> 0)"""


@query(f"WITH {HI} SELECT target_id, start_ms, identity FROM tr")
def tracked_identities(spark, sf):
    return ST.tracked_identities(history(spark, sf)[0]).drop("labels")


@query(f"WITH {HI} SELECT target_id, identity, next_start AS ts_ms, true AS is_stale FROM tr JOIN sc USING (target_id, start_ms) WHERE next_start IS NOT NULL AND NOT EXISTS (SELECT 1 FROM tr x WHERE x.target_id = tr.target_id AND x.identity = tr.identity AND x.start_ms = sc.next_start)")
def stale_markers(spark, sf):
    return ST.stale_markers(*history(spark, sf)).select("target_id", "identity", "ts_ms", "is_stale")


@query(f"WITH {HI} SELECT target_id, count(tr.identity) AS tracked FROM sc LEFT JOIN tr USING (target_id, start_ms) WHERE next_start IS NULL GROUP BY 1")
def tracked_series_count(spark, sf):
    return ST.tracked_series_count(*history(spark, sf))


@query(f"""WITH {HI}, r AS (SELECT target_id, start_ms + 1000 AS ts_ms, start_ms FROM sc WHERE next_start IS NULL AND target_id LIKE '%7')
SELECT target_id, identity, ts_ms, true AS stale, 'id=' || identity AS labels FROM r JOIN tr USING (target_id, start_ms) UNION ALL
SELECT target_id, name, ts_ms, true, '__name__=' || name || ',instance=' || target_id FROM (SELECT *, unnest(['up', 'scrape_duration_seconds', 'scrape_samples_scraped', 'scrape_samples_post_metric_relabeling', 'scrape_series_added']) AS name FROM r)""")
def removed_target_markers(spark, sf):
    samples, starts = history(spark, sf)
    removed = starts.where(F.col("target_id").endswith("7")).groupBy("target_id").agg((F.max("start_ms") + 1000).alias("ts_ms"))
    out = ST.removed_target_markers(samples, starts, removed, F.create_map(F.lit("instance"), F.col("target_id")))
    return out.select("target_id", "identity", "ts_ms", F.isnan("value").alias("stale"), shown("labels", sort=True))


# --- targets -----------------------------------------------------------------------------------------------------------


def groups(spark, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").join(F.broadcast(table(spark, sf, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    host = F.lower(F.regexp_replace("s_name", "#", "-"))
    addresses = F.transform(F.sequence(F.lit(0), (F.col("s_suppkey") % 3).cast("int")), lambda i: F.concat(host, F.lit(":"), (9000 + i).cast("string")))
    labels = F.create_map(F.lit("nation"), "n_name", F.lit("__param_module"), F.when(F.col("s_suppkey") % 2 == 0, "even").otherwise("odd"))
    return s.select(F.lit("file").alias("source"), addresses.alias("targets"), labels.alias("labels"), "s_suppkey")


GR = "a AS (SELECT s_suppkey, n_name, lower(replace(s_name, '#', '-')) || ':' || (9000 + unnest(range(0, s_suppkey % 3 + 1))) AS addr, CASE WHEN s_suppkey % 2 = 0 THEN 'even' ELSE 'odd' END AS module FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
TARGET_RULES = [Rule("drop", ("__address__",), regex=".*:9002"), Rule("replace", ("nation",), regex="NATION_(.*)", target_label="env", replacement="n$1")]


@query(f"WITH {GR} SELECT 'https://' || addr || '/custom' AS url, module, 'env=n' || substr(n_name, 8) || ',instance=' || addr || ',job=suppliers,nation=' || n_name AS labels FROM a WHERE addr NOT LIKE '%:9002'")
def build_targets(spark, sf):
    t = T.build_targets(groups(spark, sf), "suppliers", TARGET_RULES, "https", "custom", {"module": ["default"], "x": []})
    return t.select("url", F.element_at("params", F.lit("module")).alias("module"), shown("labels"))


@query(f"WITH {GR} SELECT addr, n_name AS nation FROM a UNION ALL SELECT unnest(['one:1', 'two:2']), 'none'")
def static_target_groups(spark, sf):
    """Groups of a configuration beside those of a table."""
    both = T.merge_target_groups(groups(spark, sf).drop("s_suppkey"), T.static_target_groups(spark, [(["one:1", "two:2"], {"nation": "none"}), ([], {"nation": "empty"})]))
    return both.select(F.explode("targets").alias("addr"), F.element_at("labels", F.lit("nation")).alias("nation"))


@query(f"WITH {GR} SELECT 'http://' || addr || '/metrics' AS url FROM a")
def distinct_targets(spark, sf):
    g = groups(spark, sf)
    return T.distinct_targets(T.build_targets(T.merge_target_groups(g, g), "j")).select("url")


@query(f"WITH {GR} SELECT 'http://' || addr || '/metrics' AS url, CASE WHEN s_suppkey % 3 = 0 THEN 'added' WHEN s_suppkey % 2 = 0 THEN 'removed' ELSE 'unchanged' END AS change FROM a")
def diff_targets(spark, sf):
    g = groups(spark, sf)
    old, new = T.build_targets(g.where("s_suppkey % 3 <> 0"), "j"), T.build_targets(g.where("s_suppkey % 3 = 0 OR s_suppkey % 2 <> 0"), "j")
    return T.diff_targets(old, new, ["url", "labels"]).select("url", "change")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey::VARCHAR || 's' ELSE '1m' END AS scrape_interval, CASE WHEN s_suppkey % 3 = 0 THEN true ELSE false END AS honor_labels FROM supplier")
def effective_job_settings(spark, sf):
    jobs = table(spark, sf, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.concat("s_suppkey", F.lit("s"))).alias("scrape_interval"), F.when(F.col("s_suppkey") % 3 == 0, True).alias("honor_labels"))
    return T.effective_job_settings(jobs, {"scrape_interval": "1m", "honor_labels": False})


# --- Kubernetes --------------------------------------------------------------------------------------------------------

PODS = """SELECT named_struct('name', concat('pod-', p_partkey), 'namespace', concat('ns', p_partkey % 5), 'uid', concat('u', p_partkey), 'labels', map('app', p_type, 'a.b', p_brand), 'annotations', cast(map() AS map<string,string>),
  'ownerReferences', array(named_struct('kind', 'ReplicaSet', 'name', concat('rs-', p_size), 'controller', p_partkey % 2 = 0))) AS metadata,
 named_struct('nodeName', concat('NATION_', p_size), 'containers', array(named_struct('name', 'main', 'image', p_name, 'ports', array(named_struct('name', 'http', 'containerPort', cast(8000 + p_size % 4 AS int), 'protocol', 'TCP'), named_struct('name', 'adm', 'containerPort', 9000, 'protocol', 'TCP'))), named_struct('name', 'side', 'image', 'side', 'ports', cast(null AS array<struct<name:string,containerPort:int,protocol:string>>))),
  'initContainers', cast(null AS array<struct<name:string,image:string,ports:array<struct<name:string,containerPort:int,protocol:string>>>>)) AS spec,
 named_struct('podIP', CASE WHEN p_partkey % 10 = 0 THEN null WHEN p_partkey % 7 = 0 THEN concat('fd00::', p_partkey) ELSE concat('10.0.', p_partkey div 250, '.', p_partkey % 250) END, 'hostIP', '1.1.1.1', 'phase', 'Running', 'conditions', array(named_struct('type', 'Ready', 'status', 'True')),
  'containerStatuses', array(named_struct('name', 'main', 'containerID', concat('cid-', p_partkey))), 'initContainerStatuses', cast(null AS array<struct<name:string,containerID:string>>)) AS status FROM part_"""
PO = "po AS (SELECT *, 'ns' || p_partkey % 5 AS ns, 'pod-' || p_partkey AS pod, CASE WHEN p_partkey % 7 = 0 THEN '[fd00::' || p_partkey || ']' ELSE '10.0.' || p_partkey // 250 || '.' || p_partkey % 250 END AS host, CASE WHEN p_partkey % 7 = 0 THEN 'fd00::' || p_partkey ELSE '10.0.' || p_partkey // 250 || '.' || p_partkey % 250 END AS ip FROM part WHERE p_partkey % 10 <> 0)"


def pods(spark, sf: str) -> DataFrame:
    return spark.sql(PODS.replace("part_", "{part}"), part=table(spark, sf, "part"))


def nodes(spark, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(F.struct(F.col("n_name").alias("name"), F.create_map(F.lit("region"), F.col("n_regionkey").cast("string")).alias("labels"), F.create_map().cast(K.EMPTY).alias("annotations")).alias("metadata"))


def services(spark, sf: str) -> DataFrame:
    return table(spark, sf, "customer").where("c_custkey % 4 <> 0").select(F.struct(F.concat(F.lit("svc-"), "c_custkey").alias("name"), F.concat(F.lit("ns"), F.col("c_custkey") % 5).alias("namespace"), F.create_map(F.lit("team"), "c_mktsegment").alias("labels"), F.create_map().cast(K.EMPTY).alias("annotations")).alias("metadata"))


SLICES = """SELECT named_struct('name', concat('slice-', o_orderkey), 'namespace', concat('ns', o_custkey % 5), 'labels', map('kubernetes.io/service-name', concat('svc-', o_custkey)), 'annotations', cast(map() AS map<string,string>)) AS metadata,
 'IPv4' AS addressType, array(named_struct('name', 'p', 'port', cast(8000 + o_orderkey % 4 AS int), 'protocol', 'TCP', 'appProtocol', cast(null AS string))) AS ports,
 array(named_struct('addresses', array(concat('10.1.', o_orderkey % 250, '.1')), 'conditions', named_struct('ready', true, 'serving', cast(null AS boolean), 'terminating', false), 'hostname', cast(null AS string), 'nodeName', cast(null AS string), 'zone', o_orderpriority,
  'targetRef', named_struct('kind', CASE WHEN o_orderkey % 3 = 0 THEN 'Node' ELSE 'Pod' END, 'name', concat('pod-', o_orderkey % p), 'namespace', concat('ns', (o_orderkey % p) % 5)))) AS endpoints FROM orders_ CROSS JOIN n_"""
SL = "sl AS (SELECT *, 'ns' || o_custkey % 5 AS ns, 'slice-' || o_orderkey AS slice, 8000 + o_orderkey % 4 AS port, o_orderkey % (SELECT count(*) FROM part) AS pk FROM orders)"


def slices(spark, sf: str) -> DataFrame:
    n = table(spark, sf, "part").agg(F.count("*").alias("p"))
    return spark.sql(SLICES.replace("FROM orders_ CROSS JOIN n_", "FROM {o} CROSS JOIN {n}"), o=table(spark, sf, "orders"), n=n)


@query(f"""WITH {PO}, x AS (SELECT *, unnest([0, 1, 2]) AS i FROM po JOIN nation ON n_name = 'NATION_' || p_size)
SELECT pod, CASE i WHEN 0 THEN host || ':' || (8000 + p_size % 4) WHEN 1 THEN host || ':9000' ELSE ip END AS address, CASE WHEN i < 2 THEN 'main' ELSE 'side' END AS container, CASE WHEN i < 2 THEN 'cid-' || p_partkey ELSE '' END AS id, p_type AS app, p_brand AS ab, CASE WHEN p_partkey % 2 = 0 THEN 'rs-' || p_size END AS controller, n_regionkey::VARCHAR AS region FROM x""")
def pod_targets(spark, sf):
    t = K.pod_targets(pods(spark, sf), nodes(spark, sf))
    get = lambda k, n: F.try_element_at("labels", F.lit(K.P + k)).alias(n)
    return t.select("pod", "address", get("pod_container_name", "container"), get("pod_container_id", "id"), get("pod_label_app", "app"), get("pod_label_a_b", "ab"), get("pod_controller_name", "controller"), get("node_label_region", "region"))


@query(f"""WITH {SL} SELECT slice, '10.1.' || o_orderkey % 250 || '.1:' || port AS address, o_orderpriority AS zone, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS team,
 CASE WHEN o_orderkey % 3 <> 0 THEN p_type END AS app, CASE WHEN o_orderkey % 3 <> 0 AND 8000 + p_size % 4 = port THEN 'main' END AS container FROM sl LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN part ON p_partkey = pk""")
def endpointslice_targets(spark, sf):
    t = K.join_backing_pod(K.join_owning_service(K.endpointslice_targets(slices(spark, sf)), services(spark, sf)), pods(spark, sf))
    get = lambda k, n: F.try_element_at("labels", F.lit(K.P + k)).alias(n)
    return t.select("slice", "address", get("endpointslice_endpoint_zone", "zone"), get("service_label_team", "team"), get("pod_label_app", "app"), get("pod_container_name", "container"))


@query(f"""WITH {SL}, {PO}, x AS (SELECT slice, pod, port, host, o_custkey, p_type, unnest([8000 + p_size % 4, 9000]) AS cp FROM sl JOIN po ON p_partkey = pk WHERE o_orderkey % 3 <> 0)
SELECT slice, pod, cp::INTEGER AS port, host || ':' || cp AS address, slice AS own, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS team, p_type AS app, NULL::VARCHAR AS zone FROM x LEFT JOIN customer ON c_custkey = o_custkey WHERE cp <> port""")
def uncovered_pod_ports(spark, sf):
    t = K.uncovered_pod_ports(K.endpointslice_targets(slices(spark, sf)), pods(spark, sf), services(spark, sf))
    get = lambda k, n: F.try_element_at("labels", F.lit(K.P + k)).alias(n)
    return t.select("slice", "pod", "port", "address", get("endpointslice_name", "own"), get("service_label_team", "team"), get("pod_label_app", "app"), get("endpointslice_endpoint_zone", "zone"))


@query(f"""WITH {SL} SELECT slice, '10.1.' || o_orderkey % 250 || '.1:' || port AS address, CASE WHEN o_orderkey % 3 <> 0 THEN n_name END AS node, CASE WHEN o_orderkey % 3 <> 0 THEN n_regionkey::VARCHAR END AS region
FROM sl LEFT JOIN nation ON n_name = 'NATION_' || o_orderkey % 30""")
def attach_node_metadata(spark, sf):
    s = slices(spark, sf)
    named = F.transform("endpoints", lambda e: e.withField("nodeName", F.concat(F.lit("NATION_"), F.regexp_extract("metadata.name", r"(\d+)", 1).cast("long") % 30)))
    t = K.attach_endpoint_nodes(K.endpointslice_targets(s.withColumn("endpoints", named)), nodes(spark, sf))
    get = lambda k, n: F.try_element_at("labels", F.lit(K.P + k)).alias(n)
    return t.select("slice", "address", get("node_name", "node"), get("node_label_region", "region"))


# --- delivery ----------------------------------------------------------------------------------------------------------

ENDPOINTS = [("a", "v1", True, 500), ("b", "v2", False, 2000), ("c", "v2", True, 100)]
EP = "ep AS (SELECT * FROM (VALUES ('a', true, 500), ('b', false, 2000), ('c', true, 100)) t(endpoint, native, size)), f AS (SELECT * FROM events CROSS JOIN ep), g AS (SELECT *, event_type = 'view' AS is_histogram FROM f WHERE native OR event_type <> 'view'), b AS (SELECT *, (row_number() OVER (PARTITION BY endpoint ORDER BY event_id) - 1) // size AS batch_id FROM g)"


def batches(spark, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "event_type", "props", F.col("user_id").alias("target_id"), (F.col("event_type") == "view").alias("is_histogram"))
    out = spark.createDataFrame(ENDPOINTS, "endpoint string, message string, send_native_histograms boolean, max_samples_per_send int")
    return D.assign_batches(D.drop_native_histograms(D.fan_out_endpoints(e, out)), ["event_id"])


def labelled_batches(spark, sf: str) -> DataFrame:
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), v.cast("string").alias("value"))
    user = F.when(F.col("target_id") % 4 == 0, "").otherwise(F.col("target_id").cast("string"))
    return batches(spark, sf).withColumn("labels", F.array(pair("k", F.get_json_object("props", "$.k")), pair("type", F.col("event_type")), pair("u", user)))


@query(f"WITH {EP} SELECT endpoint, event_id FROM f")
def fan_out_endpoints(spark, sf):
    out = spark.createDataFrame(ENDPOINTS, "endpoint string, message string, send_native_histograms boolean, max_samples_per_send int")
    return D.fan_out_endpoints(table(spark, sf, "events").select("event_id"), out).select("endpoint", "event_id")


@query(f"WITH {EP} SELECT endpoint, event_id, batch_id FROM b")
def assign_batches(spark, sf):
    return batches(spark, sf).select("endpoint", "event_id", "batch_id")


@query(f"WITH {EP} SELECT endpoint, batch_id, count(*) FILTER (NOT is_histogram) AS n_samples, count(*) FILTER (is_histogram) AS n_histograms FROM b GROUP BY 1, 2")
def batch_counts(spark, sf):
    return D.batch_counts(batches(spark, sf)).drop("shard")


@query(f"""WITH {EP}, l AS (SELECT endpoint, batch_id, row_number() OVER (PARTITION BY endpoint, batch_id ORDER BY event_id) AS r, unnest(['k', json_extract_string(props, '$.k'), 'type', event_type, 'u', CASE WHEN user_id % 4 = 0 THEN '' ELSE user_id::VARCHAR END]) AS symbol, unnest(range(0, 6)) AS p FROM b),
f1 AS (SELECT endpoint, batch_id, symbol, min(r * 10 + p) AS m FROM l WHERE symbol <> '' GROUP BY 1, 2, 3)
SELECT endpoint, batch_id, symbol, row_number() OVER (PARTITION BY endpoint, batch_id ORDER BY m)::INTEGER AS ref FROM f1 UNION ALL SELECT DISTINCT endpoint, batch_id, '', 0 FROM b""")
def symbol_table(spark, sf):
    return D.symbol_table(labelled_batches(spark, sf), ["endpoint", "batch_id"], ["event_id"])


@query(f"""WITH {EP}, c AS (SELECT endpoint, batch_id, count(*) FILTER (NOT is_histogram) AS n FROM b GROUP BY 1, 2)
SELECT endpoint, batch_id, CASE batch_id % 5 WHEN 0 THEN 'retry' WHEN 1 THEN 'retry' WHEN 2 THEN 'dropped' WHEN 3 THEN CASE WHEN n > 0 THEN 'partial' ELSE 'ok' END ELSE 'ok' END AS outcome FROM c""")
def delivery_outcomes(spark, sf):
    counts = D.batch_counts(batches(spark, sf))
    status = F.element_at(F.array(F.lit(None).cast("int"), F.lit(429), F.lit(404), F.lit(200), F.lit(204)), (F.col("batch_id") % 5 + 1).cast("int"))
    written = F.when(F.col("batch_id") % 5 == 3, F.greatest(F.col("n_samples") - 1, F.lit(0))).otherwise(F.col("n_samples"))
    sent = counts.select("endpoint", "batch_id", status.alias("http_status"), written.alias("samples_written"), F.col("n_histograms").alias("histograms_written"))
    return D.delivery_outcomes(sent, counts).select("endpoint", "batch_id", "outcome")


@query(f"""WITH {EP}, l AS (SELECT endpoint, batch_id, event_id, row_number() OVER (PARTITION BY endpoint, batch_id ORDER BY event_id) AS r, unnest(['k', json_extract_string(props, '$.k'), 'type', event_type, 'u', CASE WHEN user_id % 4 = 0 THEN '' ELSE user_id::VARCHAR END]) AS symbol, unnest(range(0, 6)) AS p FROM b),
f1 AS (SELECT endpoint, batch_id, symbol, min(r * 10 + p) AS m FROM l WHERE symbol <> '' GROUP BY 1, 2, 3),
t AS (SELECT endpoint, batch_id, symbol, row_number() OVER (PARTITION BY endpoint, batch_id ORDER BY m) AS ref FROM f1)
SELECT endpoint, batch_id, event_id, string_agg(coalesce(ref, 0)::VARCHAR, ',' ORDER BY p) AS refs, string_agg(symbol, ',' ORDER BY p) AS decoded FROM l LEFT JOIN t USING (endpoint, batch_id, symbol) GROUP BY 1, 2, 3""")
def symbol_refs(spark, sf):
    """The references of each series, and what they stand for in its batch's table."""
    df, key = labelled_batches(spark, sf), ["endpoint", "batch_id"]
    refs = D.symbol_refs(df, key, ["event_id"])
    symbols = D.symbol_table(df, key, ["event_id"]).groupBy(*(F.col(c).alias(f"_{c}") for c in key)).agg(F.transform(F.sort_array(F.collect_list(F.struct("ref", "symbol"))), lambda x: x["symbol"]).alias("symbols"))
    both = refs.join(symbols, (F.col("endpoint") == F.col("_endpoint")) & (F.col("batch_id") == F.col("_batch_id")))
    decoded = F.array_join(F.transform("refs", lambda r: F.get("symbols", r)), ",")
    return both.select(*key, "event_id", F.array_join(F.col("refs").cast("array<string>"), ",").alias("refs"), decoded.alias("decoded"))


RETRIES = f"""{EP}, k AS (SELECT DISTINCT endpoint, batch_id, batch_id % 4 + 1 AS n, batch_id // 4 % 3 AS last FROM b),
q AS (SELECT *, CASE WHEN batch_id % 11 = 5 AND n > 1 THEN 'attempts missing' WHEN batch_id % 13 = 6 AND last <> 2 THEN 'sent after its end' WHEN batch_id % 7 = 3 AND n > 1 THEN 'sent too early' END AS fault FROM k),
z AS (SELECT *, CASE fault WHEN 'attempts missing' THEN 2 ELSE 1 END AS a, CASE fault WHEN 'sent after its end' THEN n + 1 ELSE n END AS z, CASE WHEN last = 2 THEN n ELSE n - 1 END AS r, [0, 30, 90, 190, 290] AS w FROM q)"""


@query(f"""WITH {RETRIES} SELECT endpoint, batch_id, CASE WHEN fault = 'sent after its end' OR last = 0 THEN 'ok' WHEN last = 1 THEN 'dropped' ELSE 'retry' END AS outcome, z - a + 1 AS attempts, r - a + 1 AS retries,
 w[r + 1] - w[a] AS waited_ms, CASE fault WHEN 'sent too early' THEN 0 ELSE w[z] - w[a] END + 5 * (z - a) AS elapsed_ms, fault FROM z""")
def retry_chains(spark, sf):
    """Attempts of each batch: up to three retries, then an answer; some lack an attempt, come too early or go on after the end."""
    counts = D.batch_counts(batches(spark, sf)).withColumns({"n": F.col("batch_id") % 4 + 1, "last": F.floor(F.col("batch_id") / 4) % 3})
    kind = F.when((F.col("batch_id") % 11 == 5) & (F.col("n") > 1), "missing").when((F.col("batch_id") % 13 == 6) & (F.col("last") != 2), "after").when((F.col("batch_id") % 7 == 3) & (F.col("n") > 1), "early").otherwise("none")
    tries = counts.withColumn("kind", kind).withColumn("attempt", F.explode(F.sequence(F.when(F.col("kind") == "missing", 2).otherwise(1), (F.col("n") + F.when(F.col("kind") == "after", 1).otherwise(0)).cast("int"))))
    answer = F.element_at(F.array(F.lit(200), F.lit(404), F.lit(429)), (F.col("last") + 1).cast("int"))
    status = F.when(F.col("attempt") < F.col("n"), 503).when(F.col("attempt") == F.col("n"), answer).otherwise(204)
    waits = F.element_at(F.array(*map(F.lit, (0, 30, 90, 190, 290))), F.col("attempt"))
    at = F.col("batch_id") * 1000 + F.when(F.col("kind") == "early", 0).otherwise(waits) + 5 * (F.col("attempt") - 1)
    sent = tries.select("endpoint", "batch_id", "attempt", at.alias("ts_ms"), status.alias("http_status"), F.col("n_samples").alias("samples_written"), F.col("n_histograms").alias("histograms_written"))
    return D.retry_chains(D.delivery_outcomes(sent, counts.drop("n", "last")), max_backoff_ms=100)


@query(f"""WITH {EP} SELECT endpoint, batch_id, event_id, CASE endpoint WHEN 'a' THEN 'kind=' || event_type || ',type=' || event_type WHEN 'b' THEN 'none=,type=' || event_type ELSE 'type=' || event_type END AS labels FROM b
WHERE endpoint <> 'c' OR event_type = 'click'""")
def write_relabel(spark, sf):
    chains = {"a": [Rule("replace", ("type",), target_label="kind")], "c": [Rule("keep", ("type",), regex="click")]}
    df = batches(spark, sf).withColumn("labels", F.create_map(F.lit("type"), F.col("event_type"), F.lit("none"), F.lit("")))
    return D.write_relabel(df, chains).select("endpoint", "batch_id", "event_id", shown("labels"))


# --- streams -----------------------------------------------------------------------------------------------------------

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_stream(spark, parts: list[dict[str, DataFrame]], start) -> None:
    """Files that arrive part by part in a folder for each name, and after each part a run of the query that ``start`` makes of
    the streams: it takes what there is and ends, and the next one goes on from its checkpoint."""
    where, key = scratch(spark), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)
    try:
        for part in parts:
            for name, df in part.items():
                df.write.mode("append").parquet(f"{where}/{name}")
            streams = {name: spark.readStream.schema(df.schema).parquet(f"{where}/{name}") for name, df in part.items()}
            start(f"{where}/checkpoint", **streams).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def to_files(df: DataFrame, path: str, checkpoint: str):
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)


@query(SQL["scrape_pipeline"])
def stream_scrape_pipeline(spark, sf):
    out, rows = scratch(spark), scrapes(spark, sf)
    run = lambda checkpoint, scrapes: to_files(STREAM.stream_scrape_pipeline(scrapes, own_labels(), RULES, F.create_map(F.lit("region"), F.lit("eu"), F.lit("job"), F.lit("unused")))[1], out, checkpoint)
    early = F.col("scrape_id") % 2 == 0
    run_stream(spark, [{"scrapes": rows.where(early)}, {"scrapes": rows.where(~early)}], run)
    return spark.read.parquet(out).select("scrape_id", "line_no", shown("labels"), "value", "ts_ms")


@query(f"{SQL['stale_markers']} UNION ALL SELECT target_id, identity, ts_ms, stale FROM ({SQL['removed_target_markers']})")
def stream_stale_markers(spark, sf):
    """Half of the history, then the rest with the removals."""
    samples, starts = history(spark, sf)
    series = ST.tracked_identities(samples).groupBy(F.col("target_id").alias("_t"), F.col("start_ms").alias("_s")).agg(F.collect_list(F.struct("identity", L.sort_labels(F.col("labels")).alias("labels"))).alias("series"))
    judged = I.written(starts.join(series, (F.col("target_id") == F.col("_t")) & (F.col("start_ms") == F.col("_s")), "left").select("target_id", "start_ms", "series"), "judged")
    removed = starts.where(F.col("target_id").endswith("7")).groupBy("target_id").agg((F.max("start_ms") + 1000).alias("ts_ms"))
    early, out = F.col("start_ms") < F.lit(1_705_276_800_000), scratch(spark)
    run = lambda checkpoint, judged, removed: STREAM.stream_staleness(judged, F.col("series"), out, checkpoint, removed, F.create_map(F.lit("instance"), F.col("target_id")))
    run_stream(spark, [{"judged": judged.where(early), "removed": removed.where(F.lit(False))}, {"judged": judged.where(~early), "removed": removed}], run)
    return spark.read.schema(STREAM.FILES).parquet(out).where("kind = 'stale'").select("target_id", "identity", "ts_ms", F.lit(True).alias("is_stale"))


@query(f"WITH {EP} SELECT endpoint, event_id, batch_id, CASE WHEN count(*) OVER (PARTITION BY endpoint, batch_id) = size THEN 'size' ELSE 'end' END AS closed_by FROM b")
def stream_delivery(spark, sf):
    """Three parts of the events and then the end: the batches of ``assign_batches``."""
    e = table(spark, sf, "events").select("event_id", F.col("user_id").alias("target_id"), (F.col("event_type") == "view").alias("is_histogram"))
    endpoints = spark.createDataFrame(ENDPOINTS, "endpoint string, message string, send_native_histograms boolean, max_samples_per_send int")
    most, out = (e.agg(F.max("event_id")).first()[0] or 0) + 1, scratch(spark)
    end = spark.range(1)
    parts = [{"samples": e.where(F.floor(F.col("event_id") * 3 / most) == i), "end": end.where(F.lit(i == 2))} for i in range(3)]
    run_stream(spark, parts, lambda checkpoint, samples, end: STREAM.stream_delivery(samples, endpoints, ["event_id"], out, checkpoint, None, end=end))
    return spark.read.parquet(out).select("endpoint", "event_id", "batch_id", "closed_by")


# --- histograms --------------------------------------------------------------------------------------------------------


def buckets(spark, sf: str) -> DataFrame:
    """Counts of line quantities by supplier, as schema-3 buckets."""
    return table(spark, sf, "lineitem").groupBy("l_suppkey", F.lit("positive").alias("side"), F.col("l_quantity").cast("bigint").alias("index")).agg(F.count("*").alias("count"))


BU = "bu AS (SELECT l_suppkey, l_quantity::BIGINT AS i, count(*) AS n FROM lineitem GROUP BY 1, 2)"


@query(f"WITH {BU} SELECT l_suppkey, 'positive' AS side, i AS index, n AS count FROM bu")
def histogram_buckets(spark, sf):
    spans = H.encode_buckets(buckets(spark, sf), ["l_suppkey"])
    return H.histogram_buckets(spans, ["l_suppkey"], "spans", "deltas", "positive")


@query(f"WITH {BU} SELECT l_suppkey, 'positive' AS side, ((i - 1) >> 2) + 1 AS index, sum(n)::BIGINT AS count FROM bu GROUP BY 1, 3")
def reduce_histogram_resolution(spark, sf):
    return H.reduce_histogram_resolution(buckets(spark, sf), ["l_suppkey"], 2)


@query(f"WITH {BU}, t AS (SELECT l_suppkey, s, count(DISTINCT ((i - 1) >> s) + 1) AS n FROM bu CROSS JOIN range(0, 8) r(s) GROUP BY 1, 2) SELECT l_suppkey, (min(s) FILTER (n <= 20))::INTEGER AS shift FROM t GROUP BY 1")
def limit_histogram_buckets(spark, sf):
    return H.limit_histogram_buckets(buckets(spark, sf).withColumn("schema", F.lit(3)), ["l_suppkey"], 20)


@query(f"WITH {BU} SELECT l_suppkey, count(*)::INTEGER AS n, NULL::VARCHAR AS sound, 'unsupported schema' AS low, 'negative bucket count' AS negative, 'spans do not cover the buckets' AS short, NULL::VARCHAR AS float_sound, 'spans do not cover the buckets' AS float_short, 'unsupported schema' AS float_low FROM bu GROUP BY 1")
def validate_native_histogram(spark, sf):
    s = H.encode_buckets(buckets(spark, sf), ["l_suppkey"])
    check = lambda schema, d: H.validate_native_histogram(F.lit(schema), F.col("spans"), d)
    counts = F.transform("deltas", lambda d: -d / 2.0)
    floats = lambda schema, c: H.validate_native_histogram(F.lit(schema), F.col("spans"), F.array().cast("array<bigint>"), c, F.lit(True))
    return s.select(
        "l_suppkey", F.size("deltas").alias("n"), check(3, F.col("deltas")).alias("sound"), check(-5, F.col("deltas")).alias("low"),
        check(3, F.transform("deltas", lambda d: F.lit(-1).cast("bigint"))).alias("negative"), check(3, F.slice("deltas", F.lit(2), F.size("deltas"))).alias("short"),
        floats(3, counts).alias("float_sound"), floats(3, F.slice(counts, F.lit(2), F.size("deltas"))).alias("float_short"), floats(-9, counts).alias("float_low"),
    )


@query(f"WITH {BU} SELECT l_suppkey, 'negative' AS side, i AS index, n * 0.5::DOUBLE AS count FROM bu")
def float_histogram_buckets(spark, sf):
    """Float histograms: absolute counts coded under their spans and read again."""
    rows = buckets(spark, sf).withColumns({"count": F.col("count") * 0.5, "side": F.lit("negative")})
    return H.histogram_buckets(H.encode_buckets(rows, ["l_suppkey"], absolute=True), ["l_suppkey"], "spans", "counts", "negative", absolute=True)


@query(f"""WITH {BU}, sc AS (SELECT DISTINCT l_suppkey, (3 + l_suppkey % 8)::INTEGER AS schema FROM bu), t AS (SELECT l_suppkey, s, count(DISTINCT ((i - 1) >> s) + 1) AS n FROM bu CROSS JOIN range(0, 15) r(s) GROUP BY 1, 2),
m AS (SELECT l_suppkey, schema, min(s) AS s FROM t JOIN sc USING (l_suppkey) WHERE n <= CASE WHEN l_suppkey % 5 = 0 THEN 0 ELSE 20 END AND s >= greatest(schema - 8, 0) AND s <= schema + 4 GROUP BY 1, 2)
SELECT l_suppkey, ((i - 1) >> s) + 1 AS index, (schema - s)::INTEGER AS schema, sum(n)::DOUBLE * 0.5 AS count, NULL::VARCHAR AS error FROM bu JOIN m USING (l_suppkey) GROUP BY l_suppkey, 2, schema, s
UNION ALL SELECT l_suppkey, NULL, NULL, NULL, 'bucket limit exceeded at the coarsest schema' FROM sc WHERE l_suppkey % 5 = 0""")
def fit_histograms(spark, sf):
    """Float histograms of schemas up to 10 at a limit of 20 buckets; every fifth has 64 more that no halving brings together."""
    rows = buckets(spark, sf).select("l_suppkey", (F.col("l_suppkey") % 8 + 3).cast("int").alias("schema"), "side", "index", (F.col("count") * 0.5).alias("count"))
    far = rows.where("l_suppkey % 5 = 0").select("l_suppkey", "schema").distinct().withColumns({"side": F.lit("positive"), "index": F.explode(F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: i.cast("bigint") * (1 << 20))), "count": F.lit(1.0)})
    fitted, faults = H.fit_histograms(rows.unionByName(far), ["l_suppkey"], 20)
    return fitted.drop("side").withColumn("error", F.lit(None).cast("string")).unionByName(faults, allowMissingColumns=True)


CLASSIC = "q AS (SELECT l_returnflag AS flag, count(*) AS n, sum(l_quantity) AS total, count(*) FILTER (l_quantity <= 10) AS b10, count(*) FILTER (l_quantity <= 25) AS b25 FROM lineitem GROUP BY 1)"


def classic(spark, sf: str) -> DataFrame:
    """Histograms with integer counts, beside which one flag has float counts and one has float counts of 0."""
    g = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("count"), F.sum("l_quantity").alias("sum"), F.count_if(F.col("l_quantity") <= 10).alias("b10"), F.count_if(F.col("l_quantity") <= 25).alias("b25"))
    floating = lambda c: F.when(F.col("flag") == "A", F.col(c) + 0.25).when(F.col("flag") == "N", 0.0)
    b = lambda le, c: F.struct(F.lit(le).cast("double").alias("upper_bound"), F.col(c).alias("cumulative_count"), floating(c).alias("cumulative_count_float"))
    return g.withColumns({"buckets": F.array(b(10, "b10"), b(25, "b25")), "count_float": floating("count")})


@query(f"""WITH {CLASSIC}, z AS (SELECT *, CASE WHEN flag = 'A' THEN 0.25 ELSE 0 END::DOUBLE AS more FROM q) SELECT flag, '_count' AS suffix, NULL::VARCHAR AS le, n + more AS value FROM z UNION ALL SELECT flag, '_sum', NULL, total FROM z UNION ALL
SELECT flag, '_bucket', '10.0', b10 + more FROM z UNION ALL SELECT flag, '_bucket', '25.0', b25 + more FROM z UNION ALL SELECT flag, '_bucket', '+Inf', n + more FROM z""")
def expand_classic_histogram(spark, sf):
    out = H.expand_classic_histogram(classic(spark, sf), ["flag"], count_float="count_float")
    return out.select("flag", "suffix", F.col("bound").alias("le"), "value")


@query(f"""WITH {CLASSIC} SELECT flag, '_count' AS suffix, NULL::DOUBLE AS quantile, n::DOUBLE AS value FROM q UNION ALL SELECT flag, '_sum', NULL, total FROM q UNION ALL SELECT flag, '', 0.5, b10 FROM q UNION ALL SELECT flag, '', 0.9, b25 FROM q""")
def expand_summary(spark, sf):
    p = lambda q, c: F.struct(F.lit(q).alias("quantile"), F.col(c).cast("double").alias("value"))
    return H.expand_summary(classic(spark, sf).withColumn("quantiles", F.array(p(0.5, "b10"), p(0.9, "b25"))), ["flag"]).drop("bound")


@query("SELECT p_partkey, least(p_size - 20, 8)::INTEGER AS schema, greatest(p_size - 28, 0)::INTEGER AS shift FROM part")
def cap_histogram_schema(spark, sf):
    return H.cap_histogram_schema(table(spark, sf, "part").select("p_partkey", (F.col("p_size") - 20).alias("schema")))


# --- pseudonymization --------------------------------------------------------------------------------------------------

KEEP, HIGH_RISK = ["k"], ["user"]
VALUES = f"""{EV}, v AS (SELECT scrape_id AS file, line_no::INTEGER AS line_no, 'k' AS label, k AS value FROM n UNION ALL SELECT scrape_id, line_no, 'user', user_id::VARCHAR FROM n UNION ALL SELECT scrape_id, line_no, 'id', event_id::VARCHAR FROM n),
public AS (SELECT DISTINCT value FROM v WHERE label = 'k' AND NOT (length(value) >= 4 AND value IN (SELECT value FROM v WHERE label = 'user') AND NOT regexp_full_match(value, '[a-z]*')))"""


def _moved(half: str, other: str, r: int) -> str:
    roll = f"('0x' || md5('0|{r}|' || i || '|' || {other})[1:8])::BIGINT"
    kinds = " ".join(f"WHEN regexp_full_match({half}[i], '[{c}]') THEN chr(({o} + (ascii({half}[i]) - {o} + {roll}) % {m})::INTEGER)" for c, o, m in (("a-z", 97, 26), ("A-Z", 65, 26), ("0-9", 48, 10)))
    return f"array_to_string(list_transform(range(1, length({half}) + 1), lambda i: CASE {kinds} ELSE {half}[i] END), '')"


NAMES = f"""p0 AS (SELECT value, value[1:length(value) // 2] AS a, value[length(value) // 2 + 1:] AS b FROM (SELECT DISTINCT value FROM v)),
p1 AS (SELECT value, a, {_moved("b", "a", 0)} AS b FROM p0), p2 AS (SELECT value, {_moved("a", "b", 1)} AS a, b FROM p1),
p3 AS (SELECT value, a, {_moved("b", "a", 2)} AS b FROM p2), p4 AS (SELECT value, {_moved("a", "b", 3)} || b AS pseudonym FROM p3)"""


def bodies(spark, sf: str) -> DataFrame:
    return scrapes(spark, sf).select(F.col("scrape_id").alias("file"), "body")


def clean(spark, sf: str) -> DataFrame:
    raw = bodies(spark, sf)
    values = I.written(P.corpus_label_values(raw), "label-values")  # read by every step
    denied = P.denied_values(values, KEEP, P.public_vocabulary(values, KEEP, HIGH_RISK))
    return P.pseudonymize_bodies(raw, denied, P.pseudonym_map(denied), KEEP)


@query(f"WITH {VALUES} SELECT * FROM v")
def corpus_label_values(spark, sf):
    return P.corpus_label_values(bodies(spark, sf))


@query(f"WITH {VALUES} SELECT * FROM public")
def public_vocabulary(spark, sf):
    return P.public_vocabulary(P.corpus_label_values(bodies(spark, sf)), KEEP, HIGH_RISK)


@query(f"WITH {VALUES} SELECT DISTINCT value FROM v WHERE label = 'user'")
def high_risk_values(spark, sf):
    return P.high_risk_values(P.corpus_label_values(bodies(spark, sf)), HIGH_RISK)


@query(f"WITH {VALUES}, {NAMES} SELECT value, pseudonym FROM p4")
def pseudonym_map(spark, sf):
    return P.pseudonym_map(P.corpus_label_values(bodies(spark, sf)))


@query(f"WITH {VALUES}, {NAMES} SELECT file, line_no, label, CASE WHEN label = 'k' OR value IN (SELECT value FROM public) THEN value ELSE pseudonym END AS value FROM v JOIN p4 USING (value)")
def pseudonymize_bodies(spark, sf):
    return P.corpus_label_values(clean(spark, sf))


@query(f"WITH {VALUES} SELECT label, count(*) AS redacted FROM v WHERE label <> 'k' AND value NOT IN (SELECT value FROM public) GROUP BY label")
def redaction_report(spark, sf):
    values = P.corpus_label_values(bodies(spark, sf))
    return P.redaction_report(P.denied_values(values, KEEP, P.public_vocabulary(values, KEEP, HIGH_RISK)))


@query("""SELECT c_custkey AS file, 'comment' AS kind, '10.0.' || c_nationkey || '.' || c_custkey % 300 AS token FROM customer WHERE c_custkey % 300 <= 255
UNION ALL SELECT c_custkey, 'value', c_name FROM customer UNION ALL SELECT c_custkey, 'label', '00:1a:2B:3c:4d:5e' FROM customer""")
def leak_scan(spark, sf):
    c = table(spark, sf, "customer")
    body = F.concat(F.lit("# HELP m of "), "c_name", F.lit(" at 10.0."), "c_nationkey", F.lit("."), F.col("c_custkey") % 300, F.lit('\nm{k="00:1a:2B:3c:4d:5e"} 1'))
    return P.leak_scan(c.select(F.col("c_custkey").alias("file"), body.alias("body")), c.select(F.col("c_name").alias("value")), KEEP)


@query(f"WITH {EV} SELECT scrape_id AS file, true AS same_bytes, true AS same_values FROM s")
def fidelity_check(spark, sf):
    return P.fidelity_check(bodies(spark, sf), clean(spark, sf))


# --- agent metrics -----------------------------------------------------------------------------------------------------

WEEK = 7 * DAY_MS
METRICS = f"""{HI}, {EV.replace("e AS", "ev AS", 1).replace("FROM e)", "FROM ev)").replace("s AS (SELECT", "st AS (SELECT")}, {EP.replace(", b AS", ", bt AS").replace("f AS (", "ff AS (").replace("FROM f ", "FROM ff ")},
mk AS (SELECT next_start AS ts FROM tr JOIN sc USING (target_id, start_ms) WHERE next_start IS NOT NULL AND NOT EXISTS (SELECT 1 FROM tr x WHERE x.target_id = tr.target_id AND x.identity = tr.identity AND x.start_ms = sc.next_start)),
tk AS (SELECT start_ms // {WEEK} * {WEEK} AS w, target_id, arg_max(n, start_ms) AS n FROM (SELECT target_id, start_ms, count(tr.identity) AS n FROM sc LEFT JOIN tr USING (target_id, start_ms) GROUP BY 1, 2) GROUP BY 1, 2),
bc AS (SELECT endpoint, batch_id, count(*) AS n, 1704067200000 + batch_id * 3600000 AS ts FROM bt GROUP BY 1, 2),
oc AS (SELECT *, CASE batch_id % 4 WHEN 0 THEN 'retry' WHEN 1 THEN 'dropped' ELSE 'ok' END AS o FROM bc),
u AS (SELECT start_ms // {WEEK} * {WEEK} AS w, 1 AS scrapes, (bad IS NOT NULL)::INT AS failures, CASE WHEN bad IS NULL THEN lines ELSE 0 END AS samples_scraped, CASE WHEN bad IS NULL THEN good ELSE 0 END AS samples_kept, 0 AS markers, 0 AS tracked_series, 0 AS batches, 0 AS sent_bytes, 0 AS retries, 0 AS failed_batches FROM st
 UNION ALL SELECT ts // {WEEK} * {WEEK}, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0 FROM mk UNION ALL SELECT w, 0, 0, 0, 0, 0, n, 0, 0, 0, 0 FROM tk
 UNION ALL SELECT ts // {WEEK} * {WEEK}, 0, 0, 0, 0, 0, 0, (o = 'ok')::INT, CASE WHEN o = 'ok' THEN n * 10 ELSE 0 END, (o = 'retry')::INT, (o = 'dropped')::INT FROM oc),
im AS (SELECT w::BIGINT AS bucket_ms, {", ".join(f"sum({m})::BIGINT AS {m}" for m in S.MEASURES)} FROM u GROUP BY 1)"""


def agent_inputs(spark, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Statistics, markers, tracked series by scrape, and delivery outcomes."""
    samples, starts = history(spark, sf)
    tracked = ST.tracked_identities(samples).groupBy("target_id", "start_ms").agg(F.count("*").alias("tracked"))
    tracked = starts.join(tracked, ["target_id", "start_ms"], "left").withColumn("tracked", F.coalesce("tracked", F.lit(0)))
    counts = D.batch_counts(batches(spark, sf))
    status = F.element_at(F.array(F.lit(503), F.lit(400), F.lit(200), F.lit(204)), (F.col("batch_id") % 4 + 1).cast("int"))
    sent = counts.select("endpoint", "shard", "batch_id", status.alias("http_status"), F.col("n_samples").alias("samples_written"), F.col("n_histograms").alias("histograms_written"), (1_704_067_200_000 + F.col("batch_id") * 3_600_000).alias("ts_ms"), ((F.col("n_samples") + F.col("n_histograms")) * 10).alias("bytes"))
    return stats(spark, sf), ST.stale_markers(samples, starts), tracked, D.delivery_outcomes(sent, counts)


@query(f"WITH {METRICS} SELECT * FROM im")
def ingestion_metrics(spark, sf):
    scraped, markers, tracked, outcomes = agent_inputs(spark, sf)
    return S.ingestion_metrics(scraped, WEEK, markers, tracked, outcomes)


@query(f"""WITH {METRICS}, pt AS (SELECT target_id, start_ms AS tm, 0 AS last, count(tr.identity) AS n FROM sc LEFT JOIN tr USING (target_id, start_ms) GROUP BY 1, 2 UNION ALL SELECT target_id, max(start_ms) + 1000, 1, 0 FROM sc WHERE target_id LIKE '%7' GROUP BY 1),
gn AS (SELECT bucket_ms, target_id, arg_max(n, tm * 2 + last) AS n FROM im JOIN pt ON tm < bucket_ms + {WEEK} GROUP BY 1, 2), gs AS (SELECT bucket_ms, sum(n)::BIGINT AS tracked_series FROM gn GROUP BY 1)
SELECT bucket_ms, coalesce(gs.tracked_series, 0) AS tracked_series, {", ".join(f"(sum({m}) OVER (ORDER BY bucket_ms))::BIGINT AS {m}" for m in S.MEASURES if m != "tracked_series")} FROM im LEFT JOIN gs USING (bucket_ms)""")
def ingestion_totals(spark, sf):
    """Totals at the end of each week; some targets go after their last scrape."""
    scraped, markers, tracked, outcomes = agent_inputs(spark, sf)
    removed = tracked.where(F.col("target_id").endswith("7")).groupBy("target_id").agg((F.max("start_ms") + 1000).alias("ts_ms"))
    return S.ingestion_totals(S.ingestion_metrics(scraped, WEEK, markers, tracked, outcomes), tracked, WEEK, removed)


@query(f"WITH {METRICS}, l AS (UNPIVOT im ON {', '.join(S.MEASURES)} INTO NAME name VALUE v) SELECT '__name__=meterflow_' || name || ',instance=i,job=agent,region=eu' AS labels, bucket_ms AS ts_ms, v::DOUBLE AS value FROM l")
def ingestion_metric_series(spark, sf):
    return S.ingestion_metric_series(ingestion_metrics(spark, sf), {"job": "agent", "instance": "i", "region": "eu"}).select(shown("labels"), "ts_ms", "value")


@query("""WITH l AS (SELECT p_brand, 'size' || p_size % 3 AS name, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE '{type="' || replace(p_type, ' ', '\\\\') || '\\"",k="' || p_partkey || '"}' END AS block, p_size / 4 AS v FROM part),
f AS (SELECT p_brand, name, '# HELP ' || name || ' Size \\\\ of' || chr(92) || 'nparts' || chr(10) || '# TYPE ' || name || ' gauge' || chr(10) || string_agg(name || block || ' ' || CASE WHEN v = floor(v) THEN v::BIGINT::VARCHAR ELSE v::VARCHAR END, chr(10) ORDER BY encode(name || block || ' ' || CASE WHEN v = floor(v) THEN v::BIGINT::VARCHAR ELSE v::VARCHAR END)) || chr(10) AS t FROM l GROUP BY 1, 2)
SELECT p_brand, string_agg(t, '' ORDER BY name) AS body FROM f GROUP BY 1""".replace("\\\\", "\\\\"))
def render_exposition(spark, sf):
    p = table(spark, sf, "part")
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), v.cast("string").alias("value"))
    own = F.array(pair("type", F.concat(F.replace("p_type", F.lit(" "), F.lit("\\")), F.lit('"'))), pair("k", F.col("p_partkey")))
    labels = F.when(F.col("p_partkey") % 4 == 0, F.slice(own, 1, 0)).otherwise(own)
    rows = p.select("p_brand", F.concat(F.lit("size"), F.col("p_size") % 3).alias("name"), F.lit("Size \\ of\nparts").alias("help"), F.lit("gauge").alias("kind"), labels.alias("labels"), (F.col("p_size") / 4).alias("value"))
    return S.render_exposition(rows, ["p_brand"])


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type || '\"' || chr(10) || user_id || chr(92) || 'n' ELSE event_type END AS value FROM events")
def unescape_label_value(spark, sf):
    raw = F.when(F.col("event_id") % 2 == 0, F.concat("event_type", F.lit('\\"\\n'), "user_id", F.lit("\\\\n"))).otherwise(F.col("event_type"))
    return table(spark, sf, "events").select("event_id", X.unescape_label_value(raw).alias("value"))


@query(f"""WITH {EV} SELECT scrape_id, line_no::INTEGER AS line_no, event_type || CASE WHEN event_id % 5 = 0 THEN '{{ k = "' || k || '" , user= "' || user_id || '",' || chr(9) || 'id ="' || event_id || '", }}' ELSE '{{k="' || k || '",user="' || user_id || '",id="' || event_id || '"}}' END AS identity FROM n JOIN s USING (scrape_id) WHERE bad IS NULL""")
def series_identity(spark, sf):
    return S.parse_samples(S.fail_malformed_bodies(scrapes(spark, sf))).select("scrape_id", "line_no", "identity")


# --- families and bounds -----------------------------------------------------------------------------------------------

THIRD = """CASE p_partkey % 10 WHEN 1 THEN '{"name":"","type":"counter"}' WHEN 2 THEN '{"name":"1x","type":"counter"}' WHEN 3 THEN '{"name":"x","type":"odd"}' WHEN 4 THEN '{"name":"x","metric":[{"label":[{"name":"0"}]}]}'
 WHEN 5 THEN '{"name":"x","metric":[{},{"label":[{"name":"a"},{"name":"a"}]}]}' WHEN 6 THEN '{"name":"x","metric":[{"label":[{"name":"__name__"}]}]}' WHEN 7 THEN '{"name":"x","type":"summary","metric":[{"label":[{"name":"quantile"}]}]}'
 WHEN 8 THEN '{"name":"x","type":"histogram","metric":[{"label":[{"name":"le"}]}]}' WHEN 9 THEN concat('{"name":"x","metric":[{"label":[', array_join(transform(sequence(1, 128), i -> concat('{"name":"l', i, '"}')), ','), ']}]}') ELSE '{"name":"fine","type":"untyped","metric":[{"value":1}]}' END"""


def family_bodies(spark, sf: str) -> DataFrame:
    first = """concat('[{"name":"parts_total","type":"counter","metric":[{"label":[{"name":"brand","value":"', p_brand, '"}],"timestamp_ms":', CASE p_partkey % 30 WHEN 0 THEN '0' WHEN 10 THEN 'null' ELSE cast(p_partkey * 7 AS string) END, ',"value":', p_size, '},{"label":[{"name":"brand","value":"none"}]}]},{"name":"size","type":"gauge","metric":[{"value":', p_retailprice, '}]},', """
    json = F.expr(first + THIRD + ", ']')")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("scrape_id"), (F.col("p_partkey") * 1000).alias("start_ms"), F.from_json(json, f"array<{M.FAMILY}>").alias("families"))


@query("""SELECT p_partkey AS scrape_id, CASE p_partkey % 10 WHEN 1 THEN 'metric family without a name' WHEN 2 THEN 'invalid metric name' WHEN 3 THEN 'unknown metric type' WHEN 4 THEN 'invalid label name' WHEN 5 THEN 'duplicate label name' WHEN 6 THEN 'duplicate label name'
 WHEN 7 THEN 'quantile collides with a derived label' WHEN 8 THEN 'le collides with a derived label' WHEN 9 THEN 'too many labels' END AS error, CASE WHEN p_partkey % 10 = 0 THEN 3 ELSE 0 END AS families FROM part""")
def validate_families(spark, sf):
    return M.validate_families(family_bodies(spark, sf)).select("scrape_id", "error", F.size("families").alias("families"))


@query("""WITH p AS (SELECT *, CASE p_partkey % 30 WHEN 20 THEN p_partkey * 7 ELSE p_partkey * 1000 END AS stamp FROM part WHERE p_partkey % 10 = 0)
SELECT p_partkey AS scrape_id, '__name__=parts_total,brand=' || p_brand AS labels, stamp AS ts_ms, p_size::DOUBLE AS value FROM p UNION ALL SELECT p_partkey, '__name__=parts_total,brand=none', p_partkey * 1000, 0 FROM p
UNION ALL SELECT p_partkey, '__name__=size', p_partkey * 1000, p_retailprice FROM p UNION ALL SELECT p_partkey, '__name__=fine', p_partkey * 1000, 1 FROM p""")
def expand_scalar_metrics(spark, sf):
    rows = M.expand_scalar_metrics(M.family_metrics(M.validate_families(family_bodies(spark, sf))))
    return rows.select("scrape_id", shown("labels", sort=True), "ts_ms", "value")


@query("SELECT event_id, CASE WHEN event_id % 3 = 1 THEN event_id ELSE user_id END AS honored, user_id AS ignored FROM events")
def family_timestamps(spark, sf):
    exposed = F.when(F.col("event_id") % 3 == 0, 0).when(F.col("event_id") % 3 == 1, F.col("event_id"))
    return table(spark, sf, "events").select("event_id", M.family_timestamps(exposed, F.col("user_id")).alias("honored"), M.family_timestamps(exposed, F.col("user_id"), False).alias("ignored"))


def exposed_histograms(spark, sf: str) -> DataFrame:
    """Histogram metrics by supplier: native ones, native ones with classic buckets, classic ones; some counts are beyond a long."""
    kind = F.col("l_suppkey") % 3
    native, none = kind != 2, F.lit(None)
    bucket = F.when(kind > 0, F.array(F.struct(F.lit(10.0), F.lit(4).cast("decimal(20,0)"), F.lit(None).cast("double"))))
    count = F.size("deltas").cast("decimal(20,0)") + F.when(F.col("l_suppkey") % 8 == 1, F.lit("18446744073709551000")).otherwise(F.lit("0")).cast("decimal(20,0)")
    h = F.struct(count.cast("decimal(20,0)"), F.when(F.col("l_suppkey") % 4 == 0, 2.5), F.lit(1.5), F.lit(3), F.lit(0.0), none, none, F.when(native, F.col("spans")), F.when(native, F.col("deltas")), none, none, none, none, bucket).cast(M.HISTOGRAM)
    s = H.encode_buckets(buckets(spark, sf), ["l_suppkey"])
    return s.select("l_suppkey", F.when(F.col("l_suppkey") % 2 == 0, "gauge_histogram").otherwise("histogram").alias("type"), F.struct(h.alias("histogram")).alias("metric"))


@query(f"WITH {BU}, k AS (SELECT DISTINCT l_suppkey FROM bu) SELECT l_suppkey, 'native' AS form FROM k WHERE l_suppkey % 3 <> 2 UNION ALL SELECT l_suppkey, 'classic' FROM k WHERE l_suppkey % 3 > 0")
def select_histogram_form(spark, sf):
    return M.select_histogram_form(exposed_histograms(spark, sf), True, True).select("l_suppkey", "form")


@query(f"""WITH {BU}, k AS (SELECT l_suppkey, count(*) AS n FROM bu GROUP BY 1 HAVING l_suppkey % 3 <> 2)
SELECT l_suppkey, CASE WHEN l_suppkey % 2 = 0 THEN 'gauge' ELSE 'unknown' END AS reset_hint, l_suppkey % 4 = 0 AS is_float, CASE WHEN l_suppkey % 4 <> 0 THEN (n::HUGEINT + CASE WHEN l_suppkey % 8 = 1 THEN 18446744073709551000 ELSE 0 END)::VARCHAR END AS count_int, CASE WHEN l_suppkey % 4 = 0 THEN 2.5::DOUBLE END AS count_float, CASE WHEN l_suppkey % 4 <> 0 THEN n ELSE -1 END::INTEGER AS deltas FROM k""")
def build_native_histogram(spark, sf):
    rows = M.select_histogram_form(exposed_histograms(spark, sf), True).where("form = 'native'")
    built = rows.select("l_suppkey", M.build_native_histogram(F.col("histogram"), F.col("type")).alias("h"))
    return built.select("l_suppkey", "h.reset_hint", "h.is_float", F.col("h.count_int").cast("string").alias("count_int"), "h.count_float", F.coalesce(F.size("h.positive_deltas"), F.lit(-1)).alias("deltas"))


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice::VARCHAR AS plain, CASE WHEN l_orderkey = 0 THEN '0.0' ELSE rtrim(l_orderkey::VARCHAR, '0')[1] || CASE WHEN length(rtrim(l_orderkey::VARCHAR, '0')) > 1 THEN '.' || rtrim(l_orderkey::VARCHAR, '0')[2:] ELSE '' END || 'e+' || lpad((length(l_orderkey::VARCHAR) + 5)::VARCHAR, 2, '0') END AS large FROM lineitem""")
def format_bound(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", format_text(F.col("l_extendedprice").cast("double")).alias("plain"), format_text(F.col("l_orderkey") * 1e6).alias("large"))


# --- files -------------------------------------------------------------------------------------------------------------


def scratch(spark) -> str:
    """A new folder that the driver and all executors share."""
    return I.shared_folder(spark, "files")


@query("SELECT event_id::VARCHAR AS id, value FROM events WHERE event_id % 997 <> 0")
def read_exposition_bodies(spark, sf):
    where, e = scratch(spark), table(spark, sf, "events")
    line = lambda v: F.concat("event_type", F.lit('{id="'), "event_id", F.lit('"} '), v)
    e.where("event_id % 997 <> 0").select(line(F.col("value").cast("string"))).write.text(f"{where}/a")
    e.where("event_id % 997 = 0").select(line(F.lit("oops"))).write.text(f"{where}/b")
    found = I.read_exposition_bodies(spark, f"{where}/*", "*.txt")
    rows = S.fail_malformed_bodies(found.select(F.col("file").alias("scrape_id"), F.lit("t").alias("target_id"), F.lit(0).alias("start_ms"), "body", F.lit(0.0).alias("duration_s"), F.lit(None).cast("string").alias("fetch_error")))
    return S.parse_samples(rows).select(F.element_at("labels", F.lit("id")).alias("id"), "value")


@query(f"WITH {GR} SELECT addr, n_name AS nation, module FROM a")
def read_target_groups(spark, sf):
    where = scratch(spark)
    files = groups(spark, sf).groupBy(F.floor(F.col("s_suppkey") / 50).alias("b")).agg(F.to_json(F.collect_list(F.struct("targets", "labels"))).alias("json"))
    files.repartition("b").write.partitionBy("b").text(where)
    table(spark, sf, "supplier").limit(1).select(F.lit('[{"labels":{}}]')).write.mode("append").text(f"{where}/b=-1")
    got = I.read_target_groups(spark, where, "*.txt")
    return got.select(F.explode("targets").alias("addr"), F.element_at("labels", F.lit("nation")).alias("nation"), F.element_at("labels", F.lit("__param_module")).alias("module"))


@query("SELECT 'svc-' || c_custkey AS name, c_mktsegment AS team FROM customer WHERE c_custkey % 4 <> 0 AND c_custkey % 5 IN (1, 3)")
def read_k8s_objects(spark, sf):
    where = scratch(spark)
    services(spark, sf).write.json(where)
    return I.read_k8s_objects(spark, where, "services", ["ns1", "ns3"]).select("metadata.name", F.element_at("metadata.labels", F.lit("team")).alias("team"))


@query("SELECT event_id, value, (epoch_us(ts) // 1000) AS ts_ms, strftime(ts, '%Y-%m-%d') AS date FROM events")
def write_samples(spark, sf):
    where = scratch(spark)
    rows = table(spark, sf, "events").select("event_id", "value", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))
    I.write_samples(rows, where)
    return spark.read.parquet(where).select("event_id", "value", "ts_ms", F.col("date").cast("string").alias("date"))
