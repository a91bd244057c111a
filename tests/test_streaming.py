"""A stream of scrapes gives the rows of the batch operators."""

import collections
import time

import pytest
from pyspark.sql import functions as F

from meterflow.functions.exposition import identity_of
from meterflow.operators import delivery as D
from meterflow.operators import scrapes as S
from meterflow.operators import staleness as ST
from meterflow.operators.relabel import Rule
from meterflow.streaming import staleness_events, stream_batches, stream_delivery, stream_scrape_pipeline, stream_stale_markers, stream_staleness

SCHEMA = "scrape_id long, target_id string, start_ms long, body string, duration_s double, fetch_error string"
BODIES = ['a{x="1"} 1\nb 2\n', 'a{x="1"} 2\nc 3\n', "broken{ 1", "b 2\nc 3\nd 4 5\n", "", "b 1\n", None]
ROWS = [(10 * i + t, f"t{t}", 1000 * i, b if (i + t) % 5 else BODIES[0], 0.5, "down" if (i, t) == (4, 1) else None) for t in range(3) for i, b in enumerate(BODIES)]
RULES = [Rule("drop", ("__name__",), regex="c"), Rule("replace", ("x",), target_label="y")]


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def marked(df):
    return collections.Counter((r.target_id, r.identity, tuple(sorted((p.name, p.value) for p in r.labels)), r.ts_ms) for r in df.collect())


@pytest.fixture
def stream(spark, tmp_path):
    """Two scrapes of each target arrive at a time."""
    for i in range(0, len(BODIES), 2):
        rows = [r for r in ROWS if r[2] // 1000 in (i, i + 1)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/batch={i}")
    return spark.readStream.schema(SCHEMA + ", batch int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").drop("batch")


def finished(df, path, name):
    q = df.writeStream.format("parquet").option("path", f"{path}/{name}").option("checkpointLocation", f"{path}/c-{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.parquet(f"{path}/{name}")


def test_stream_scrape_pipeline(spark, stream, tmp_path):
    target = lambda: F.create_map(F.lit("instance"), F.col("target_id"))
    judged, samples = stream_scrape_pipeline(stream, target(), RULES)
    expected = S.scrape_pipeline(spark.createDataFrame(ROWS, SCHEMA), target(), RULES)
    shape = lambda df: collections.Counter(map(str, df.select("scrape_id", "line_no", "identity", "labels", "value", "ts_ms").collect()))
    assert shape(finished(samples, tmp_path, "samples")) == shape(expected[1])
    errors = lambda df: collections.Counter(map(tuple, df.select("scrape_id", "error", "scraped").collect()))
    assert errors(finished(judged.drop("lines"), tmp_path, "judged")) == errors(expected[0])


def series():
    at_start = F.filter("lines", lambda x: x["p"]["ts_ms"].isNull() | (x["p"]["ts_ms"] == F.col("start_ms")))
    return F.transform(at_start, lambda x: F.struct(identity_of(x["p"]["name"], x["p"]["block"]).alias("identity"), x["p"]["labels"].alias("labels")))


def batch_side(spark):
    scrapes = spark.createDataFrame(ROWS, SCHEMA)
    samples = S.parse_samples(S.fail_malformed_bodies(scrapes))
    own = F.transform(F.map_entries(F.map_filter("labels", lambda k, v: k != "__name__")), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))
    return samples.withColumn("labels", own), scrapes


@pytest.mark.parametrize("buckets", [1, 5])
def test_stream_stale_markers(spark, stream, tmp_path, buckets):
    got = marked(finished(stream_stale_markers(S.fail_malformed_bodies(stream), series(), buckets=buckets), tmp_path, "markers"))
    expected = marked(ST.stale_markers(*batch_side(spark)))
    assert got == expected and sum(got.values()) > 5


HISTORY = "target_id string, start_ms long, series array<struct<identity:string,labels:array<struct<name:string,value:string>>>>, batch int"
REMOVED = "target_id string, ts_ms long, zone string, batch int"


def history(spark, path, parts, kinds, name):
    """A stream of one part a trigger."""
    for i, rows in enumerate(parts):
        spark.createDataFrame([(*r, i) for r in rows], kinds).coalesce(1).write.parquet(f"{path}/{name}/b={i}")
    return spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(f"{path}/{name}")


def of(*identities):
    return [(i, [("n", i)]) for i in identities]


@pytest.mark.parametrize("at_once", [False, True])
def test_removed_targets_drain(spark, tmp_path, at_once):
    """Removals among scrapes give the rows of the batch operators; what comes late goes aside, and a target may come back."""
    scrapes = [[("t", 1000, of("a", "b")), ("u", 1000, of("a"))], [("t", 2000, of("b", "c")), ("u", 2000, [])], [("u", 3000, of("z")), ("v", 1000, of("q"))], [("t", 1500, of("late")), ("t", 6000, of("again"))]]
    removals = [[("none", 500, "y")], [], [("t", 5000, "x"), ("u", 3000, "y")], [("v", 900, "z")]]
    if at_once:
        scrapes, removals = [[r for part in scrapes[:3] for r in part]], [[r for part in removals[:3] for r in part]]
    judged = history(spark, tmp_path, scrapes, HISTORY, "s")
    gone = history(spark, tmp_path, removals, REMOVED, "r")
    zone = F.create_map(F.lit("zone"), F.col("zone"))
    rows = finished(staleness_events(judged, F.col("series"), gone, zone, 3), tmp_path, "events").collect()
    late = sorted((r.target_id, r.ts_ms) for r in rows if r.kind == "late")
    assert late == ([] if at_once else [("t", 1500), ("v", 900)])
    flat = [(t, at, i, j, i_) for part in scrapes[:3] for t, at, s in part for j, (i, i_) in enumerate(s)]
    samples = spark.createDataFrame([(t, at, i, at, j, dict(own)) for t, at, i, j, own in flat], "target_id string, start_ms long, identity string, ts_ms long, line_no int, labels map<string,string>")
    starts = spark.createDataFrame([r[:2] for part in scrapes[:3] for r in part], "target_id string, start_ms long")
    ends = spark.createDataFrame([r for part in removals[:3] for r in part], "target_id string, ts_ms long, zone string")
    expected = [*ST.stale_markers(samples, starts).collect(), *ST.removed_target_markers(samples, starts, ends, zone).collect()]
    shape = lambda rows, labels: collections.Counter((r.target_id, r.identity, tuple(sorted(labels(r))), r.ts_ms) for r in rows)
    assert shape([r for r in rows if r.kind == "stale"], lambda r: map(tuple, r.labels)) == shape(expected, lambda r: r.labels.items())


def test_state_follows_the_changes(spark, tmp_path):
    """A large target: a scrape that changes three series writes three entries, whatever the target's size."""
    n = 20_000
    names = [str(i) for i in range(n)]
    parts = [[("t", 1000, of(*names))], [("t", 2000, of(*names[1:], "x", "y"))], [("t", 3000, of(*names[1:], "x", "y"))]]
    query = stream_stale_markers(history(spark, tmp_path, parts, HISTORY, "s"), F.col("series"), buckets=32).writeStream.format("parquet").option("path", f"{tmp_path}/o").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    changes = [p.stateOperators[0] for p in query.recentProgress if p.numInputRows]
    written = [s.numRowsUpdated + s.numRowsRemoved - 32 for s in changes]  # each bucket notes the time of its last event
    assert written[0] >= n and written[1] == 3 and written[2] == 0
    assert [r.identity for r in spark.read.parquet(f"{tmp_path}/o").collect()] == ["0"]


def test_an_empty_bucket_asks_the_state_twice():
    from pyspark.sql import Row

    from meterflow.streaming.staleness import _Bucket

    calls = []

    class State:
        def __getattr__(self, name):
            return lambda *a: calls.append(name)

    bucket = _Bucket()
    bucket.live = bucket.last = State()
    header = Row(at=1000, removed=False, identity=None, flat=None)
    assert list(bucket.handleInputRows(("t", 3), iter([header]), None)) == [] and calls == ["get", "update"]


def followed(spark, path, scrapes, removals, name="w"):
    """Events that the writer gives, a part a trigger, and the queries' progress."""
    zone = F.create_map(F.lit("zone"), F.col("zone"))
    judged, gone = history(spark, path, scrapes, HISTORY, f"{name}-s"), history(spark, path, removals, REMOVED, f"{name}-r")
    query = stream_staleness(judged, F.col("series"), f"{path}/{name}", f"{path}/c-{name}", gone, zone).trigger(availableNow=True).start()
    query.awaitTermination()
    assert all(not p.stateOperators for p in query.recentProgress)
    return spark.read.parquet(f"{path}/{name}").collect()


def shaped(rows):
    return collections.Counter((r.kind, r.target_id, r.identity, tuple(map(tuple, r.labels or [])), r.ts_ms) for r in rows)


@pytest.mark.parametrize("at_once", [False, True])
def test_triggers_of_staleness_are_batch_jobs(spark, tmp_path, at_once):
    """The writer gives the events of the operator with state, without a state group for each target and bucket."""
    scrapes = [[("t", 1000, of("a", "b", "b")), ("u", 1000, of("a"))], [("t", 2000, of("b", "c")), ("u", 2000, [])], [("u", 3000, of("z")), ("v", 1000, of("q"))], [("t", 1500, of("late")), ("t", 6000, of("again")), ("v", 1000, of("r")), ("w", 1, None)]]
    removals = [[("none", 500, "y")], [], [("t", 5000, "x"), ("u", 3000, "y")], [("v", 900, "z"), ("v", 1000, "z"), ("u", 3000, "y"), ("t", 6000, "x"), ("t", 7000, "x")]]
    if at_once:
        scrapes, removals = [[r for part in scrapes for r in part]], [[r for part in removals for r in part]]
    got = shaped(followed(spark, tmp_path, scrapes, removals))
    judged, gone = history(spark, tmp_path, scrapes, HISTORY, "s"), history(spark, tmp_path, removals, REMOVED, "r")
    events = staleness_events(judged, F.col("series"), gone, F.create_map(F.lit("zone"), F.col("zone")), 3)
    assert got == shaped(finished(events, tmp_path, "events").collect()) and sum(n for k, n in got.items() if k[0] == "stale") > 15


def test_random_histories_in_triggers_of_any_size(spark, tmp_path):
    import random

    rnd = random.Random(3)
    scrapes = sorted({(f"t{rnd.randrange(5)}", 1000 * rnd.randrange(40)) for _ in range(90)}, key=lambda x: x[1])
    scrapes = [(t, at, of(*sorted(rnd.sample("abcdefg", rnd.randrange(6))))) for t, at in scrapes]
    removals = [(f"t{i}", 1000 * at + rnd.choice([0, 1]), "z") for i in range(5) for at in rnd.sample(range(40), 3)]
    results = []
    for cuts in ((40_000,), (9000, 12_000, 12_001, 30_000, 40_000)):
        parts = lambda rows: [[r for r in rows if a <= r[1] < b] for a, b in zip((0, *cuts), cuts)]  # noqa: B023, B905, E731
        results.append(shaped(followed(spark, tmp_path, parts(scrapes), parts(removals), f"w{len(cuts)}")))
    assert results[0] == results[1] and {k[0] for k in results[0]} == {"stale"} and sum(results[0].values()) > 100


def test_a_repeated_trigger_of_staleness_doubles_nothing(spark, tmp_path):
    from meterflow.streaming.staleness import _SERIES, _follow

    part = lambda rows: spark.createDataFrame([(t, at, False, [(i, [("n", i)]) for i in s]) for t, at, s in rows], f"target_id string, at long, removed boolean, series {_SERIES}")
    _follow(part([("t", 1, "ab"), ("u", 1, "q")]), 0, f"{tmp_path}/o", f"{tmp_path}/p")
    for _ in range(2):
        _follow(part([("t", 2, "bc"), ("t", 3, "c"), ("t", 1, "z")]), 1, f"{tmp_path}/o", f"{tmp_path}/p")
    for _ in range(2):
        _follow(part([("u", 4, "")]), 2, f"{tmp_path}/o", f"{tmp_path}/p")
    got = sorted((r.kind, r.target_id, r.identity or "", r.ts_ms) for r in spark.read.parquet(f"{tmp_path}/o").collect())
    assert got == [("late", "t", "", 1), ("stale", "t", "a", 2), ("stale", "t", "b", 3), ("stale", "u", "q", 4)]
    live = spark.read.parquet(f"{tmp_path}/p/2/walked").where("live = 'true'").collect()
    assert [(r.target_id, r.identity) for r in live] == [("t", "c")]


KINDS = "event_id long, target_id long, is_histogram boolean, ts_ms long, labels array<struct<name:string,value:string>>, b int"
OUT = [("a", True, 30), ("b", False, 8)]


def deliveries(spark, tmp_path, parts):
    rows = [(i, i % 7, i % 3 == 0, i * 1000, [("n", str(i))]) for i in range(50 * parts)]
    stream = history(spark, tmp_path, [rows[50 * i : 50 * i + 50] for i in range(parts)], KINDS, "in")
    return rows, stream, spark.createDataFrame(OUT, "endpoint string, send_native_histograms boolean, max_samples_per_send int")


def run(writer):
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()


@pytest.mark.parametrize("shards", [1, 3])
def test_stream_delivery(spark, tmp_path, shards):
    """Batches fill over triggers and restarts as one batch job fills them; the end sends the rest."""
    rows, stream, out = deliveries(spark, tmp_path, 4)
    spark.createDataFrame([], "stop long").write.parquet(f"{tmp_path}/end")
    end = spark.readStream.schema("stop long").parquet(f"{tmp_path}/end")
    start = lambda: run(stream_delivery(stream.drop("b"), out, ["event_id"], f"{tmp_path}/out", f"{tmp_path}/c", None, shards, end))
    start()
    read = lambda: {(r.endpoint, r.event_id): (r.shard, r.batch_id, r.closed_by, r.labels[0].value) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    table = spark.createDataFrame([r[:4] for r in rows], KINDS.split(", labels")[0])
    expected = {(r.endpoint, r.event_id): (r.shard, r.batch_id) for r in D.assign_batches(D.drop_native_histograms(D.fan_out_endpoints(table, out)), ["event_id"], shards).collect()}
    sizes = collections.Counter((e, *b) for (e, _), b in expected.items())
    full = {k: b for k, b in expected.items() if sizes[k[0], *b] == (30 if k[0] == "a" else 8)}
    got = read()
    assert {k: v[:2] for k, v in got.items()} == full and {v[2] for v in got.values()} == {"size"} and all(v[3] == str(k[1]) for k, v in got.items())
    start()  # nothing new, nothing twice
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(full)
    spark.createDataFrame([(1,)], "stop long").write.mode("append").parquet(f"{tmp_path}/end")
    start()
    got = read()
    assert {k: v[:2] for k, v in got.items()} == expected and spark.read.parquet(f"{tmp_path}/out").count() == len(expected)
    assert {v[2] for k, v in got.items() if k not in full} == {"end"}


def test_a_large_trigger_is_dealt_out(spark, tmp_path):
    """Without a deadline no state operator, and so no task, holds an endpoint's rows; a repeated trigger doubles nothing."""
    from meterflow.streaming.delivery import _deliver

    n = 20_000
    table = spark.range(n).selectExpr("id AS event_id", "id % 7 AS target_id", "id % 3 = 0 AS is_histogram")
    table.write.parquet(f"{tmp_path}/in")
    out = spark.createDataFrame(OUT, "endpoint string, send_native_histograms boolean, max_samples_per_send int")
    query = stream_delivery(spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in"), out, ["event_id"], f"{tmp_path}/out", f"{tmp_path}/c", None).trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.recentProgress and all(not p.stateOperators for p in query.recentProgress)
    expected = {(r.endpoint, r.event_id): r.batch_id for r in D.assign_batches(D.drop_native_histograms(D.fan_out_endpoints(table, out)), ["event_id"]).collect()}
    waiting = {("a", n // 30): 30, ("b", (n - -(-n // 3)) // 8): 8}
    full = {k: b for k, b in expected.items() if (k[0], b) not in waiting}
    read = lambda: sorted((r.endpoint, r.event_id, r.batch_id) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert read() == sorted((*k, b) for k, b in full.items())
    more = table.selectExpr(f"event_id + {n} AS event_id", "target_id", "is_histogram").limit(100).withColumn("_end", F.lit(False))
    for _ in range(2):
        _deliver(more, 1, out, ["event_id"], f"{tmp_path}/out", f"{tmp_path}/c/delivery", 1)
    assert len(got := read()) == len({g[:2] for g in got}) > len(full)


def test_deadline_sends_the_rest(spark, tmp_path):
    rows, stream, out = deliveries(spark, tmp_path, 1)
    q = stream_delivery(stream.drop("b"), out, ["event_id"], f"{tmp_path}/out", f"{tmp_path}/c", 1500).trigger(processingTime="500 milliseconds").start()
    until = time.time() + 60
    while time.time() < until and not (q.lastProgress and spark.read.schema("endpoint string, closed_by string").parquet(f"{tmp_path}/out").where("closed_by = 'deadline'").count() >= 20 + 1):
        time.sleep(0.5)
    q.stop()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    by = collections.Counter((r.endpoint, r.batch_id, r.closed_by) for r in got)
    floats = sum(not r[2] for r in rows)
    assert by == {("a", 0, "size"): 30, ("a", 1, "deadline"): 20, **{("b", i, "size"): 8 for i in range(floats // 8)}, ("b", floats // 8, "deadline"): floats % 8}


def test_shards_are_bounded(spark, tmp_path):
    _, stream, out = deliveries(spark, tmp_path, 1)
    with pytest.raises(ValueError):
        stream_batches(stream, out, ["event_id"], shards=0)
