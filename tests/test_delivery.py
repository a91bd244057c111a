"""Batches are numbered in ranges, whatever the order columns hold; symbols, retries, outcomes."""

import pytest
from pyspark.sql import functions as F

from meterflow.operators.delivery import assign_batches, batch_counts, delivery_outcomes, fan_out_endpoints, retry_chains, symbol_refs, symbol_table, write_relabel
from meterflow.operators.relabel import Rule


@pytest.mark.parametrize("shards", [1, 3])
def test_batches_follow_the_order_over_ranges(spark, shards):
    rows = [(e, None if i == 7 else (i * 37) % 500 // 2, i, i % 9, 6) for e in ("a", "b", None) for i in range(500)]
    df = spark.createDataFrame(rows, "endpoint string, at int, id int, target_id int, max_samples_per_send int").repartition(5)
    out = assign_batches(df, ["at", "id"], shards)
    assert out.columns == [*df.columns, "shard", "batch_id"]
    for r in (got := out.collect()):
        own = sorted((x.at is not None, x.at, x.id) for x in got if (x.endpoint, x.shard) == (r.endpoint, r.shard))
        assert r.batch_id == own.index((r.at is not None, r.at, r.id)) // 6
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan and plan.count("Window") <= 2  # only ranges are summed in a window, no rows
    assert assign_batches(df.where(F.lit(False)), ["at", "id"]).count() == 0


def test_outcomes_meet_by_shard(spark):
    rows = [(i, i % 50, False, "a", 10) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, target_id int, is_histogram boolean, endpoint string, max_samples_per_send int")
    counts = batch_counts(assign_batches(df, ["id"], shards=4))
    assert counts.select("shard").distinct().count() == 4
    sent = counts.select("endpoint", "shard", "batch_id", F.lit(200).alias("http_status"), F.when(F.col("batch_id") == 0, F.col("n_samples") - 1).otherwise(F.col("n_samples")).alias("samples_written"), F.col("n_histograms").alias("histograms_written"))
    got = delivery_outcomes(sent, counts).collect()
    assert len(got) == counts.count() and all(r.outcome == ("partial" if r.batch_id == 0 else "ok") for r in got)
    whole = counts.groupBy("endpoint", "batch_id").agg(F.sum("n_samples").alias("samples_written"), F.sum("n_histograms").alias("histograms_written"))
    got = delivery_outcomes(whole.withColumn("http_status", F.lit(204)), counts).collect()
    assert len(got) == whole.count() and {r.outcome for r in got} == {"ok"}


def test_write_relabel_keeps_unchained_rows(spark):
    df = spark.createDataFrame([("a", 0, {"x": "", "b": "1"}), ("b", 0, {"x": "", "b": "1"}), ("b", 0, {"b": "2"}), ("c", 1, None)], "endpoint string, batch_id int, labels map<string,string>")
    out = write_relabel(df, {"b": [Rule("drop", ("b",), regex="2")]}).collect()
    shown = sorted((r.endpoint, r.labels and [tuple(p) for p in r.labels]) for r in out)
    assert shown == [("a", [("b", "1"), ("x", "")]), ("b", [("b", "1")]), ("c", None)]


def test_endpoints_are_bounded(spark):
    many = spark.range(1001).selectExpr("cast(id as string) as endpoint")
    with pytest.raises(ValueError):
        fan_out_endpoints(spark.range(1), many)
    assert fan_out_endpoints(spark.range(3), many.limit(0)).count() == 0


def test_batches_in_order_of_other_types(spark):
    """Texts and times order rows as well as numbers do, over several ranges."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(300).selectExpr("id", "'e' AS endpoint", "cast(id % 3 AS int) AS target_id", "cast(concat('x', id * 77 % 300) AS string) AS name", "timestamp_seconds(id % 50) AS at", "7 AS max_samples_per_send")
        for order in (["name"], ["at", "id"], ["name", "at"]):
            out = assign_batches(df, order).collect()
            expected = sorted(out, key=lambda r: tuple(r[c] for c in order))
            assert all(r.batch_id == i // 7 for i, r in enumerate(expected)) and len(out) == 300
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_symbol_refs_resolve(spark):
    rows = [("a", 0, 1, [("__name__", "up"), ("job", "x"), ("none", "")]), ("a", 0, 2, [("__name__", "up"), ("up", "job")]), ("a", 0, 3, []), ("a", 0, 4, None), ("b", 0, 1, [("z", "__name__")]), (None, 0, 1, [("k", None)])]
    df = spark.createDataFrame(rows, "endpoint string, batch_id long, id int, labels array<struct<name:string,value:string>>")
    table = {}
    for r in symbol_table(df, ["endpoint", "batch_id"], ["id"]).collect():
        table.setdefault(r.endpoint, {})[r.ref] = r.symbol
    assert table["a"] == dict(enumerate(["", "__name__", "up", "job", "x", "none"])) and table["b"] == dict(enumerate(["", "z", "__name__"])) and table[None] == {0: "", 1: "k"}
    got = {(r.endpoint, r.id): r.refs for r in symbol_refs(df, ["endpoint", "batch_id"], ["id"]).collect()}
    assert got["a", 1] == [1, 2, 3, 4, 5, 0] and got["a", 2] == [1, 2, 2, 3] and got["a", 3] == got["a", 4] == [] and got["b", 1] == [1, 2] and got[None, 1] == [1, 0]
    for e, _, i, labels in rows:
        assert [table[e][n] for n in got[e, i]] == [x or "" for p in labels or [] for x in p]


def test_symbols_are_sorted_by_series_not_one_by_one(spark):
    """No plan sorts or joins a row for each symbol: series are shuffled once, whatever other columns they have."""
    rows = [(e, b, -i, {"m": [i]}, [("name", "x" * (i % 3)), (f"n{i % 40}", f"v{i % 7}")]) for e in "ab" for b in range(5) for i in range(200)]
    df = spark.createDataFrame(rows, "endpoint string, batch_id long, id int, own map<string,array<int>>, labels array<struct<name:string,value:string>>").repartition(3)
    table, refs = symbol_table(df, ["endpoint", "batch_id"], ["id"]), symbol_refs(df, ["endpoint", "batch_id"], ["id"])
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan(table) + plan(refs) and "Window" not in plan(table) and "SortAggregate" not in plan(table) and "Generate" not in plan(refs)
    symbols = {(r.endpoint, r.batch_id, r.ref): r.symbol for r in table.collect()}
    got = refs.collect()
    assert len(got) == len(rows) and {(r.endpoint, r.batch_id, r.id, r.own["m"][0]) for r in got} == {(e, b, i, o["m"][0]) for e, b, i, o, _ in rows}
    assert all([symbols[r.endpoint, r.batch_id, x] for x in r.refs] == [s for p in r.labels for s in (p.name, p.value)] for r in got)
    first = {k: symbols[(*k, 1)] for k in {(r.endpoint, r.batch_id) for r in got}}
    assert set(first.values()) == {"name"} and len(symbols) == 10 * (1 + 1 + 2 + 40 + 7)


def test_retry_chains(spark):
    tries = {
        1: [(1, 0, "retry"), (2, 30, "retry"), (3, 95, "ok")],
        2: [(1, 0, "retry"), (2, 10, "ok")],
        3: [(1, 0, "dropped")],
        4: [(1, 0, "ok"), (2, 500, "ok")],
        5: [(2, 40, "retry"), (3, 200, "partial")],
        6: [(i, 10_000 * i, "retry") for i in range(1, 12)],
        7: [(1, 0, "retry"), (1, 0, "retry"), (2, 30, "ok")],
    }
    df = spark.createDataFrame([("e", 0, b, *t) for b, ts in tries.items() for t in ts], "endpoint string, shard int, batch_id long, attempt int, ts_ms long, outcome string")
    got = {r.batch_id: (r.outcome, r.attempts, r.retries, r.waited_ms, r.elapsed_ms, r.fault) for r in retry_chains(df).collect()}
    assert got == {
        1: ("ok", 3, 2, 90, 95, None), 2: ("ok", 2, 1, 30, 10, "sent too early"), 3: ("dropped", 1, 0, 0, 0, None), 4: ("ok", 2, 0, 0, 500, "sent after its end"), 5: ("partial", 2, 1, 60, 160, "attempts missing"),
        6: ("retry", 11, 11, sum(min(30 * 2**i, 5000) for i in range(11)), 100_000, None), 7: ("ok", 2, 1, 30, 30, None),
    }
    assert retry_chains(df.where("false")).count() == 0
