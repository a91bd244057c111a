import math

import pytest
from pyspark.sql import functions as F

from meterflow.functions import exposition as X
from meterflow.functions import units as U
from meterflow.operators import scrapes as S


def judged(spark, body, **options):
    df = spark.createDataFrame([(1, "t", 1000, body, 0.1, None)], "scrape_id long, target_id string, start_ms long, body string, duration_s double, fetch_error string")
    return S.fail_malformed_bodies(df, **options)


def parsed(spark, body, **options):
    return S.parse_samples(judged(spark, body), **options).orderBy("line_no").collect()


def one(spark, column, values, f):
    rows = [(i, v) for i, v in enumerate(values)]
    return [r[0] for r in spark.createDataFrame(rows, "i int, x string").orderBy("i").select(f(F.col("x"))).collect()]


def test_labels_escapes_and_identity(spark):
    body = '# HELP x y\n\n  my:metric{a="back\\\\slash", b="quote\\"here",c="new\\nline",d="{é,}=",} 1.5e3 1000 # {x="y"} 3\r\nplain 2\n'
    a, b = parsed(spark, body)
    assert a.labels == {"__name__": "my:metric", "a": "back\\slash", "b": 'quote"here', "c": "new\nline", "d": "{é,}="}
    assert (a.value, a.ts_ms, a.line_no) == (1500.0, 1000, 3)
    assert a.identity.startswith("my:metric{") and a.identity.endswith("}")
    assert (b.labels, b.ts_ms, b.identity) == ({"__name__": "plain"}, 1000, "plain")


def test_timestamps_not_honored(spark):
    assert parsed(spark, "a 1 5", honor_timestamps=False)[0].ts_ms == 1000


def test_values(spark):
    got = one(spark, "x", ["5", "-3", "1.5E-3", "+Inf", "inf", "-Inf", "NaN", "++1", "1d", "0x1p3", "", "1_0", ".5", "5."], X.parse_metric_value)
    assert got[:6] == [5.0, -3.0, 0.0015, math.inf, math.inf, -math.inf]
    assert math.isnan(got[6]) and got[7:] == [1.0, None, None, None, None, 0.5, 5.0]


def test_timestamp_forms(spark):
    got = one(spark, "x", ["1395066363000", "-1000", "1.5", "1395066363.123", "1.5e0", "-0.0005", "nan.", "1e300", "x", "9223372036854775808"], X.parse_sample_timestamp)
    assert got == [1395066363000, -1000, 1500, 1395066363123, 1500, -1, None, None, None, None]


@pytest.mark.parametrize(
    "line",
    ["1bad 1", 'a{b="c} 1', 'a{b="\\x"} 1', 'a{b="1",b="2"} 1', 'a{__name__="x"} 1', "a", "a x", "a 1 2 3", "a 1 z", 'a{b"c"} 1', 'a{,b="c"} 1', "a{" + ",".join(f'l{i}="v"' for i in range(128)) + "} 1"],
)
def test_malformed_lines_fail_the_body(spark, line):
    row = judged(spark, f"ok 1\n{line}\nother bad line").first()
    assert row.error and row.error_line == 2 and row.scraped == 0 and row.lines == []


def test_limits(spark):
    row = judged(spark, "a 1\nb 2\n", sample_limit=1).first()
    assert (row.error, row.scraped, row.lines) == ("sample limit exceeded", 2, [])
    assert judged(spark, "a 1\n", body_limit=3).first().error == "body size limit exceeded"
    assert judged(spark, None).first().error is None


def test_long_value_does_not_overflow(spark):
    value = '\\"' * 20_000
    assert len(parsed(spark, f'a{{b="{value}"}} 1')[0].labels["b"]) == 20_000


def test_units(spark):
    assert one(spark, "x", ["1h30m", "0", "1d2h", "5ms", "1m1h", "", "1.5h", "90", "1000000000000y", "99999999999999999999h"], U.parse_duration_ms) == [5_400_000, 0, 93_600_000, 5, *[None] * 6]
    got = one(spark, "x", ["1.5MiB", "1MiB512KiB", "100B", "0", "1mb", "x", "2EiB", "16EiB", "99999999999999999999999B"], U.parse_size_bytes)
    assert [None if v is None else int(v) for v in got] == [1572864, 1572864, 100, 0, None, None, 2 << 60, None, None]


def test_body_format(spark):
    proto = "application/vnd.google.protobuf"
    got = one(spark, "x", [None, "text/html", f"{proto}; proto=io.prometheus.client.MetricFamily; encoding=delimited", f"{proto}; encoding=delimited", proto.upper()], X.body_format)
    assert got == ["text", "text", "protobuf", None, None]
