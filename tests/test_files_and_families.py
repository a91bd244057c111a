"""Readers, families and bounds on small inputs with odd cases."""

import math

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meterflow.functions.numbers import bound_text, plain_text
from meterflow.operators import families as M
from meterflow.operators import histograms as H
from meterflow.operators import targets as T
from meterflow.sources import read_exposition_bodies, read_k8s_objects, read_target_groups, write_samples


@given(st.one_of(st.floats(allow_nan=False, allow_infinity=False), st.integers(-(10**7), 10**7).map(float), st.sampled_from([x * y for x in (1e-4, 1e6) for y in (1 - 2**-53, 1.0, 1 + 2**-52)])))
def test_bounds(value):
    """A bound reads back as itself, has no digit too many, and an exponent of two digits or more just where it should."""
    text = bound_text(value)
    assert float(text) == value and text.startswith("-") == (math.copysign(1, value) < 0)
    digits, _, power = text.lstrip("-").partition("e")
    assert bool(power) == (value != 0 and not 1e-4 <= abs(value) < 1e6)
    assert len(digits.replace(".", "").strip("0")) == len(repr(value).lstrip("-").partition("e")[0].replace(".", "").strip("0"))
    if power:
        assert power[0] in "+-" and len(power) >= 3 and not digits.endswith("0") and len(digits.partition(".")[0]) == 1
        assert value == 0 or int(power) == math.floor(math.log10(abs(value)) + (1e-12 if abs(value) > 1e-300 else 0)) or abs(float(digits)) < 10
    else:
        assert "." in digits and (digits.endswith(".0") or not digits.endswith("0"))
    assert float(plain_text(value)) == value and "e" not in plain_text(value)


@pytest.mark.parametrize(("value", "text"), [(5e-324, "5e-324"), (0.30000000000000004, "0.30000000000000004"), (999999.5, "999999.5"), (2**53 + 2.0, "9.007199254740994e+15"), (-3e-5, "-3e-05")])
def test_some_bounds(value, text):
    assert bound_text(value) == text


def test_bounds_beyond_numbers():
    assert [bound_text(x) for x in (math.inf, -math.inf, math.nan)] == [plain_text(x) for x in (math.inf, -math.inf, math.nan)] == ["+Inf", "-Inf", "NaN"]


def test_read_exposition_bodies(spark, tmp_path):
    for name, raw in {"a.prom": b"m 1\n", "b.prom": b" \n", "c.prom": b"m oops\n", "d.prom": b"m{a=\"\xff\"} 1\n", "e.txt": b"m 1\n"}.items():
        (tmp_path / name).write_bytes(raw)
    assert [(r.file.split("/")[-1], r.body) for r in read_exposition_bodies(spark, str(tmp_path)).collect()] == [("a.prom", "m 1\n")]


def test_read_target_groups(spark, tmp_path):
    for name, text in {"a.json": '[{"targets":["x:1","y:2"],"labels":{"k":"v"}},{"targets":[]}]', "b.json": "[{", "c.json": '[{"labels":{}}]', "d.json": "{}", "e.json": '[{"targets":["z"]}]', "f.json": ""}.items():
        (tmp_path / name).write_text(text)
    got = {(r.source.split("/")[-1], tuple(r.targets), tuple(r.labels.items())) for r in read_target_groups(spark, str(tmp_path), "*.json").collect()}
    assert got == {("a.json", ("x:1", "y:2"), (("k", "v"),)), ("a.json", (), ()), ("e.json", ("z",), ())}
    static = T.static_target_groups(spark, [(["q:1"], {"a": "b"})])
    both = T.merge_target_groups(static, read_target_groups(spark, str(tmp_path), "*.json"))
    assert {u.url for u in T.build_targets(both, "j").collect()} == {f"http://{a}/metrics" for a in ("q:1", "x:1", "y:2", "z")}


def test_read_k8s_objects(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"metadata":{"name":"s","namespace":"n1","labels":{"a":"b"}},"extra":1}\n{"metadata":{"name":"t","namespace":"n2"}}\nbroken\n')
    read = lambda *a: sorted(r.metadata.name for r in read_k8s_objects(spark, str(tmp_path), *a).collect())
    assert read("services") == ["s", "t"] and read("services", ["n2"]) == ["t"] and read("services", []) == ["s", "t"] and read("nodes", ["n2"]) == ["s", "t"]
    assert read_k8s_objects(spark, str(tmp_path), "pods").select("status.podIP", "spec.containers").count() == 2


def test_write_samples(spark, tmp_path):
    write_samples(spark.createDataFrame([(0, 1.0), (86_400_000, 2.0), (-1, 3.0)], "ts_ms long, value double"), f"{tmp_path}/out")
    assert {(str(r.date), r.value) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {("1970-01-01", 1.0), ("1970-01-02", 2.0), ("1969-12-31", 3.0)}


def test_native_histogram_families(spark):
    json = """[{"name":"h","type":"histogram","metric":[{"histogram":{"sample_count":3,"schema":3,"positive_span":[{"offset":0,"length":2}],"positive_delta":[1,%s],"bucket":[{"upper_bound":1.0,"cumulative_count":2}]}},{"histogram":{"sample_count":1}}]}]"""
    df = spark.createDataFrame([(1, 5, json % 1), (2, 5, json % -2), (3, 5, None)], "scrape_id long, start_ms long, j string").withColumn("families", F.from_json("j", f"array<{M.FAMILY}>"))
    judged = M.validate_families(df, native_histograms=True)
    assert {r.scrape_id: r.error for r in judged.collect()} == {1: None, 2: "negative bucket count", 3: None}
    rows = M.family_metrics(judged)
    forms = lambda *a: sorted((r.histogram.sample_count, r.form) for r in M.select_histogram_form(rows, *a).collect())
    assert forms(True) == [(1, "classic"), (3, "native")] and forms(True, True) == [(1, "classic"), (3, "classic"), (3, "native")] and forms(False) == [(1, "classic"), (3, "classic")]


def test_float_histogram_families(spark):
    """Float histograms are checked as others are, but their buckets are counts, of any size."""
    json = """[{"name":"h","type":"histogram","metric":[{"histogram":{"sample_count_float":2.5,"schema":%s,"positive_span":[{"offset":0,"length":%s}],"positive_count":%s}}]}]"""
    cases = {1: (3, 2, "[1.5,1.0]"), 2: (-9, 2, "[1.5,1.0]"), 3: (3, 5, "[1.5,1.0]"), 4: (3, 2, "[-1.5,1e300]"), 5: (3, 0, "[]")}
    df = spark.createDataFrame([(i, 5, json % c) for i, c in cases.items()], "scrape_id long, start_ms long, j string").withColumn("families", F.from_json("j", f"array<{M.FAMILY}>"))
    judged = M.validate_families(df, native_histograms=True)
    assert {r.scrape_id: r.error for r in judged.collect()} == {1: None, 2: "unsupported schema", 3: "spans do not cover the buckets", 4: None, 5: None}
    built = M.select_histogram_form(M.family_metrics(judged), True).where("form = 'native'").select("scrape_id", M.build_native_histogram(F.col("histogram"), F.col("type")).alias("h")).collect()
    got = {r.scrape_id: (r.h.is_float, r.h.count_int, r.h.count_float, r.h.positive_counts, r.h.positive_deltas) for r in built}
    assert got == {1: (True, None, 2.5, [1.5, 1.0], None), 4: (True, None, 2.5, [-1.5, 1e300], None), 5: (True, None, 2.5, [], None)}


def test_counts_beyond_a_long(spark):
    json = '[{"name":"h","type":"histogram","metric":[{"histogram":{"sample_count":18446744073709551615,"zero_count":9223372036854775808,"bucket":[{"upper_bound":2.0,"cumulative_count":18446744073709551614}]}}]}]'
    rows = M.family_metrics(M.validate_families(spark.createDataFrame([(1, 5, json)], "scrape_id long, start_ms long, j string").withColumn("families", F.from_json("j", f"array<{M.FAMILY}>")), True))
    h = M.select_histogram_form(rows, True).select(M.build_native_histogram(F.col("histogram"), F.col("type")).alias("h")).first().h
    assert (int(h.count_int), int(h.zero_count_int)) == (2**64 - 1, 2**63)
    classic = M.select_histogram_form(rows, False).select("histogram.*")
    out = H.expand_classic_histogram(classic, [], "bucket", "sample_count", "sample_sum", "sample_count_float").collect()
    assert [(r.suffix, r.bound, r.value) for r in out] == [("_count", None, 2.0**64), ("_sum", None, None), ("_bucket", "2.0", 2.0**64), ("_bucket", "+Inf", 2.0**64)]
