import pytest
from pyspark.sql import functions as F

from meterflow.operators.relabel import Rule, relabel, validate_relabel_rules


def run(spark, labels, *rules):
    df = spark.createDataFrame([(labels,)], "labels map<string,string>")
    found = relabel(df, list(rules)).collect()
    return found[0].labels if found else None


CASES = [
    ({"a": "foo"}, Rule(source_labels=("a",), regex="f(.*)", target_label="d", replacement="ch${1}-ch${1}"), {"a": "foo", "d": "choo-choo"}),
    ({"a": "boo"}, Rule(source_labels=("a",), target_label="${1}", replacement="value"), {"a": "boo", "boo": "value"}),
    ({"a": "foo"}, Rule(source_labels=("a",), regex="o(.*)a", target_label="d"), {"a": "foo"}),
    ({"a": "foo", "b": "x"}, Rule(source_labels=("a",), regex="(f)(.*)o", target_label="b", replacement="${3}"), {"a": "foo"}),
    ({"a": "foo"}, Rule(source_labels=("a",), target_label="0${1}"), {"a": "foo"}),
    ({"a": "foo"}, Rule("hashmod", ("a",), target_label="d", modulus=1000), {"a": "foo", "d": "696"}),
    ({"__meta_x": "1"}, Rule("labelmap", regex="__meta_(.*)", replacement="flag_${1}"), {"__meta_x": "1", "flag_x": "1"}),
    ({"__a": "1", "b": "2"}, Rule("labeldrop", regex="__.*"), {"b": "2"}),
    ({"keep_a": "1", "b": "2"}, Rule("labelkeep", regex="keep.*"), {"keep_a": "1"}),
    ({"a": "MixedCase"}, Rule("lowercase", ("a",), target_label="b"), {"a": "MixedCase", "b": "mixedcase"}),
    ({"a": "MixedCase"}, Rule("uppercase", ("a",), target_label="b"), {"a": "MixedCase", "b": "MIXEDCASE"}),
    ({"a": "foo", "b": "bar"}, Rule("keep", ("a", "b"), regex="foo;bar"), {"a": "foo", "b": "bar"}),
    ({"a": "foo", "b": "bar"}, Rule("drop", ("a", "b"), regex="foo;bar"), None),
    ({"a": "x", "b": "x"}, Rule("keepequal", ("a",), target_label="b"), {"a": "x", "b": "x"}),
    ({"a": "x", "b": "y"}, Rule("keepequal", ("a",), target_label="b"), None),
    ({"a": "x", "b": "x"}, Rule("dropequal", ("a",), target_label="b"), None),
    ({"a": "a\n"}, Rule(source_labels=("a",), target_label="b"), {"a": "a\n"}),
    ({"a": "a\rb"}, Rule(source_labels=("a",), target_label="b"), {"a": "a\rb", "b": "a\rb"}),
    ({"a": "é"}, Rule(source_labels=("a",), regex=r"\w", target_label="b", replacement="$$"), {"a": "é", "b": "$"}),
    ({"a": "xy"}, Rule(source_labels=("a",), regex="(?P<first>.)(.)", target_label="b", replacement="${first}-$2"), {"a": "xy", "b": "x-y"}),
]


@pytest.mark.parametrize(("labels", "rule", "expected"), CASES)
def test_cases(spark, labels, rule, expected):
    assert run(spark, labels, rule) == expected


def test_chain_and_empty(spark):
    assert run(spark, {"__address__": "h:1"}, Rule(source_labels=("__address__",), target_label="instance"), Rule("labeldrop", regex="__.*")) == {"instance": "h:1"}
    assert run(spark, {"a": "", "b": "1"}) == {"b": "1"}


@pytest.mark.parametrize("rule", [Rule("hashmod", ("a",), target_label="d"), Rule("hashmod", ("a",), modulus=3), Rule(), Rule("lowercase"), Rule("nope"), Rule("keep", regex="(?=x)"), Rule("keep", regex="(")])
def test_bad_rules(rule):
    with pytest.raises(ValueError):
        validate_relabel_rules([rule])


MERGES = [
    ({"job": "custom"}, {"job": "node"}, {"job": "node", "exported_job": "custom"}, {"job": "custom"}),
    # the exported name of a later target label is there already, and then holds the scraped value
    ({"instance": "s"}, {"exported_instance": "e", "instance": "i"}, {"exported_instance": "s", "instance": "i"}, {"exported_instance": "e", "instance": "s"}),
    # an exported label that the merge itself made moves on
    ({"a": "1"}, {"a": "2", "exported_a": "3"}, {"a": "2", "exported_a": "3", "exported_exported_a": "1"}, {"a": "1", "exported_a": "3"}),
    ({"a": "1", "exported_a": "0"}, {"a": "2"}, {"a": "2", "exported_a": "1"}, {"a": "1", "exported_a": "0"}),
    ({"a": ""}, {"a": "2"}, {"a": "2", "exported_a": ""}, {"a": ""}),
    ({"x": "1"}, {"exported_x": "2"}, {"x": "1", "exported_x": "2"}, {"x": "1", "exported_x": "2"}),
    ({"x": "1"}, {}, {"x": "1"}, {"x": "1"}),
]


@pytest.mark.parametrize(("scraped", "target", "off", "on"), MERGES)
def test_merge(spark, scraped, target, off, on):
    from meterflow.functions import labels as L

    df = spark.createDataFrame([(scraped, target)], "a map<string,string>, t map<string,string>")
    r = df.select(L.merge_target_labels(F.col("a"), F.col("t"), F.lit(False)).alias("off"), L.merge_target_labels(F.col("a"), F.col("t"), F.lit(True)).alias("on")).first()
    assert (r.off, r.on) == (off, on)


@pytest.mark.parametrize("action", ["lowercase", "uppercase"])
def test_empty_results_last_to_the_end(spark, action):
    chain = [Rule(action, ("missing",), target_label="a"), Rule("labelmap", regex="a", replacement="b")]
    assert run(spark, {"b": "keep", "c": "1"}, *chain) == {"c": "1"}
    assert run(spark, {"a": "old", "b": "keep", "c": "1"}, *chain) == {"c": "1"}


def test_sizes(spark):
    from meterflow.functions.units import parse_size_bytes

    cases = {
        "0": 0, "1048576": 1048576, "007": 7, " 1KB": 1024, "1KB\u3000": 1024, ".5MiB": 524288, "1.MiB": 1048576, "1MiB512KiB": 1048576 + 524288, "1.000000001GiB": 1073741825,
        "0.0000000001EiB": 115292150, "0.99999999999999999999B": 0, "0.9999999999999999999999EiB": (10**19 - 1) * 2**60 // 10**19, "15.5EiB": 31 * 2**59, "18446744073709551615": 2**64 - 1,
        "0.5B0.5B": 0, "00000000000000000000000001KB": 1024, "18446744073709551616": None, "16EiB": None, "99999999999999999999999B": None, "15EiB1024PiB": None,
        "": None, " ": None, ".": None, ".MiB": None, "1": 1, "1.5": None, "1 KB": None, "1kB": None, "1KB ": 1024, "-1KB": None, "1K": None, "1..5KB": None, "5B5": None, "1B\x001B": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", parse_size_bytes(F.col("t")).alias("n"))
    assert {r.t: None if r.n is None else int(r.n) for r in df.collect()} == cases
