from pyspark.sql import functions as F

from meterflow.operators import histograms as H
from meterflow.operators import staleness as ST


def test_staleness_sequence(spark):
    rows = [(1000, 'a{case="x"}', 1000), (1000, "b", 1000), (1000, "explicit", 500), (2000, 'a{case="x"}', 2000), (4000, 'a{case="x"}', 4000)]
    samples = spark.createDataFrame([("t", s, i, n, {"id": i}, ts) for n, (s, i, ts) in enumerate(rows)], "target_id string, start_ms long, identity string, line_no int, labels map<string,string>, ts_ms long")
    samples = samples.withColumn("labels", F.map_entries("labels"))
    scrapes = spark.createDataFrame([("t", s) for s in (1000, 2000, 3000, 4000)], "target_id string, start_ms long")
    got = sorted((r.ts_ms, r.identity) for r in ST.stale_markers(samples, scrapes).collect())
    assert got == [(2000, "b"), (3000, 'a{case="x"}')]
    removed = spark.createDataFrame([("t", 5000)], "target_id string, ts_ms long")
    assert ST.removed_target_markers(samples, scrapes, removed).count() == 6


def spans(spark, s, d, schema=0):
    return spark.createDataFrame([(1, schema, s, d)], "k int, schema int, spans array<struct<offset:int,length:bigint>>, deltas array<bigint>")


def encoded(df):
    r = H.encode_buckets(df, ["k"]).first()
    return [tuple(x) for x in r.spans], list(r.deltas)


def test_schema_nine_to_eight(spark):
    b = H.histogram_buckets(spans(spark, [(1, 4), (2, 1)], [1, 1, 1, 1, 1]), ["k"], "spans", "deltas", "positive")
    got = {r["index"]: r["count"] for r in H.reduce_histogram_resolution(b, ["k"], 1).collect()}
    assert got == {1: 3, 2: 7, 4: 5}
    assert encoded(b) == ([(1, 4), (2, 1)], [1, 1, 1, 1, 1])


def test_validation(spark):
    check = lambda s, d, schema=0: spans(spark, s, d, schema).select(H.validate_native_histogram(F.col("schema"), F.col("spans"), F.col("deltas"))).first()[0]
    assert check([(0, 3)], [1, 1, -1]) is None
    assert check([(0, 2)], [1]) == "spans do not cover the buckets"
    assert check([(0, 1), (-1, 1)], [1, 1]) == "negative span offset"
    assert check([(0, 1)], [-1]) == "negative bucket count"
    assert check([(0, 1)], [1], -5) == "unsupported schema"
    assert check([(2**31 - 1, 2)], [1, 1]) == "bucket index overflow"


def test_overflow_names_the_histogram(spark):
    from meterflow.operators import histograms as H

    most = 2**63 - 1
    rows = [(1, [(0, 2)], [1, 1]), (2, [(0, 2)], [most, 1]), (3, [(0, most), (1, most)], [1, 1]), (4, [(2**31 - 1, 2)], [1, 1]), (5, [(0, 1), (-1, 1)], [1, 1]), (6, [(0, 2)], [1, -2]), (7, [(0, 10**12)], [1]), (8, [], [])]
    df = spark.createDataFrame(rows, f"id int, spans {H.SPANS}, deltas array<bigint>")
    got = {r.id: r.e for r in df.select("id", H.validate_native_histogram(F.lit(3), F.col("spans"), F.col("deltas")).alias("e")).collect()}
    assert got == {1: None, 2: "bucket count overflow", 3: "bucket index overflow", 4: "bucket index overflow", 5: "negative span offset", 6: "negative bucket count", 7: "bucket index overflow", 8: None}
    assert {r.id for r in H.histogram_buckets(df.where("id in (1, 3, 7, 8)"), ["id"], "spans", "deltas", "positive").collect()} == {1}


def test_names_that_sanitise_alike(spark):
    from meterflow.operators import kubernetes as K

    nodes = spark.sql("SELECT named_struct('name', 'n', 'labels', map('a.b', '1', 'a-b', '2', 'c', '3'), 'annotations', cast(null AS map<string,string>)) AS metadata")
    out = K.attach_node_metadata(spark.sql("SELECT 'n' AS x UNION ALL SELECT 'unknown'"), nodes, F.col("x"), "left").collect()
    got = {r.x: r._node for r in out}
    assert got["n"] == {"__meta_kubernetes_node_name": "n", "__meta_kubernetes_node_label_a_b": "1", "__meta_kubernetes_node_labelpresent_a_b": "true", "__meta_kubernetes_node_label_c": "3", "__meta_kubernetes_node_labelpresent_c": "true"}
    assert got["unknown"] == {}


def test_limits_by_one_pass(spark):
    """Shifts from the highest differing bits equal those found by halving again and again."""
    import random

    rng = random.Random(4)
    rows, expected = [], {}
    for k in range(40):
        schema = rng.randrange(-4, 14)
        own = {(side, rng.randrange(-300, 300)) for side in ("negative", "positive") for _ in range(rng.randrange(0, 30))} or {("positive", 0)}
        rows += [(k, schema, side, i, 1.5) for side, i in own]
        sizes = {s: len({(side, (i - 1) >> s) for side, i in own}) for s in range(20)}
        expected[k] = (schema, own, sizes)
    df = spark.createDataFrame(rows, "k int, schema int, side string, index long, count double")
    for limit in (0, 1, 2, 7, 20):
        got = {r.k: r["shift"] for r in H.limit_histogram_buckets(df, ["k"], limit).collect()}
        for k, (schema, _, sizes) in expected.items():
            assert got[k] == next((s for s in range(max(schema + 4, 0) + 1) if not limit or sizes[s] <= limit), None)
        fitted, faults = H.fit_histograms(df, ["k"], limit)
        rows_of, bad = fitted.collect(), {r.k for r in faults.collect()}
        for k, (schema, own, sizes) in expected.items():
            shift = next((s for s in range(max(schema - 8, 0), max(schema + 4, 0) + 1) if not limit or sizes[s] <= limit), None)
            mine = {(r.side, r["index"]): (r.schema, r["count"]) for r in rows_of if r.k == k}
            if shift is None:
                assert k in bad and not mine
                continue
            want = {}
            for side, i in own:
                at = (side, ((i - 1) >> shift) + 1)
                want[at] = (schema - shift, want.get(at, (0, 0))[1] + 1.5)
            assert mine == want and k not in bad


def test_float_counts_code_and_decode(spark):
    rows = [(1, "positive", i, c) for i, c in ((-3, 0.5), (-2, 2.25), (4, 1e300), (5, 0.0))]
    coded = H.encode_buckets(spark.createDataFrame(rows, "k int, side string, index long, count double"), ["k"], absolute=True)
    r = coded.first()
    assert [tuple(s) for s in r.spans] == [(-3, 2), (5, 2)] and r.counts == [0.5, 2.25, 1e300, 0.0]
    assert sorted((x.k, x.side, x["index"], x["count"]) for x in H.histogram_buckets(coded, ["k"], "spans", "counts", "positive", absolute=True).collect()) == rows


def test_classic_float_counts(spark):
    df = spark.createDataFrame([(1, 10, 2.5, 1.0, [(1.0, 4, 3.5), (2.0, 5, 0.0), (float("inf"), 6, None)]), (2, 10, 0.0, 1.0, [(1.0, None, None)])], "k int, count long, count_float double, sum double, buckets array<struct<upper_bound:double,cumulative_count:long,cumulative_count_float:double>>")
    got = {(r.k, r.suffix, r.bound): r.value for r in H.expand_classic_histogram(df, ["k"], count_float="count_float").collect()}
    assert got == {(1, "_count", None): 2.5, (1, "_sum", None): 1.0, (1, "_bucket", "1.0"): 3.5, (1, "_bucket", "2.0"): 5.0, (1, "_bucket", "+Inf"): 6.0, (2, "_count", None): 10.0, (2, "_sum", None): 1.0, (2, "_bucket", "1.0"): 0.0, (2, "_bucket", "+Inf"): 10.0}
