"""Bodies in pieces, series dimensions and totals against the direct ways."""

import random

import pytest
from pyspark.sql import functions as F

from meterflow.operators import scrapes as S
from meterflow.operators.relabel import Rule

SCHEMA = "scrape_id long, target_id string, start_ms long, body string, duration_s double, fetch_error string"


def bodies():
    rng = random.Random(3)
    good = lambda n: "\n".join(rng.choice([f'm{i % 4}{{x="{i}é"}} {i}', "# note", "", f"n {i} {i * 1000}", f'm{{a="1"}} {i}\r']) for i in range(n))
    out = [good(n) for n in (0, 1, 3, 10, 50, 200)]
    out += [good(60) + "\nbad{ 1\n" + good(60) + "\nworse{", "bad{\n" + good(40), good(40) + "\nbad{", good(30) + "\n", "\n\n\n", "x" * 500, "\n" + "y 1" + "\n" * 300, None]
    return [(i, f"t{i % 3}", 1000 * i, b, 0.5, "down" if i == 4 else None) for i, b in enumerate(out)]


@pytest.mark.parametrize("piece_bytes", [1, 30, 300, 1 << 20])
def test_pieces_equal_whole_bodies(spark, piece_bytes):
    scrapes = spark.createDataFrame(bodies(), SCHEMA)
    for limits in ({}, {"body_limit": 1500, "sample_limit": 20}):
        judged, parts = S.judge_bodies(scrapes, piece_bytes=piece_bytes, **limits)
        whole = S.fail_malformed_bodies(scrapes, **limits)
        verdict = lambda df: sorted(map(tuple, df.select("scrape_id", "target_id", "start_ms", "duration_s", "fetch_error", "error", "error_line", "scraped").collect()))
        assert verdict(judged) == verdict(whole)
        rows = lambda df: sorted(map(str, S.parse_samples(df).select("scrape_id", "line_no", "identity", "labels", "value", "ts_ms").collect()))
        assert rows(parts) == rows(whole) and len(rows(whole)) > 20
        target = F.create_map(F.lit("instance"), F.col("target_id"))
        counted = lambda df: sorted(map(tuple, S.scrape_stats(df, target, [Rule("drop", ("__name__",), regex="n")]).select("scrape_id", "error", "scraped", "kept").collect()), key=str)
        assert counted(parts) == counted(whole)


def test_cuts_keep_every_byte(spark):
    rows = bodies()
    pieces = S.cut_bodies(spark.createDataFrame(rows, SCHEMA), 40).collect()
    for i, *_, body, _, _ in [(r[0], r[1], r[2], r[3], r[4], r[5]) for r in rows]:
        own = sorted((p.piece, p.lines_before, p.body) for p in pieces if p.scrape_id == i)
        assert (body is None) == (not own) and (body is None or "\n".join(p[2] for p in own) == body)
        assert all(p[1] == sum(q[2].count("\n") + 1 for q in own[:k]) for k, p in enumerate(own)) and [p[0] for p in own] == list(range(len(own)))


def test_cuts_leave_in_large_batches():
    """Pieces of many small bodies share an Arrow batch, which each had of its own before."""
    import pyarrow as pa

    class Scrapes:
        schema = []
        drop = lambda self, *names: self
        mapInArrow = lambda self, run, kinds: run  # noqa: E731, N815

    rows = pa.record_batch({"scrape_id": pa.array(range(500)), "body": pa.array(["a 1\nb 2\nc 3", None, ""] * 166 + ["x", None])})
    got = list(S.cut_bodies(Scrapes(), 3)(iter([rows, rows.slice(0, 0)])))
    assert len(got) == 1 and got[0].num_rows == 166 * 4 + 1
    assert got[0].slice(0, 4).to_pydict() == {"scrape_id": [0, 0, 0, 2], "body": ["a 1", "b 2", "c 3", ""], "piece": [0, 1, 2, 0], "lines_before": [0, 1, 2, 0]}


def test_a_large_body(spark):
    """A body of many pieces: no row of the plan holds its parsed lines together."""
    body = "\n".join(f'metric_{i % 7}{{series="{i}"}} {i}' for i in range(200_000))
    scrapes = spark.createDataFrame([(1, "t", 5, body, 0.5, None)], SCHEMA)
    judged, parts = S.judge_bodies(scrapes, piece_bytes=256 << 10)
    assert [(r.error, r.scraped) for r in judged.collect()] == [(None, 200_000)] and parts.count() == -(-len(body) // (256 << 10)) and parts.agg(F.max(F.size("lines"))).first()[0] < 10_000
    assert S.parse_samples(parts).agg(F.sum("value"), F.max("line_no")).first() == (sum(range(200_000)), 200_000)


def test_series_dimension(spark):
    """Labels by series equal labels by sample, also when the dimension grows."""
    scrapes = spark.createDataFrame(bodies(), SCHEMA)
    target, rules = (lambda: F.create_map(F.lit("instance"), F.col("target_id"), F.lit("x"), F.lit("own"))), [Rule("drop", ("exported_x",), regex="1.*"), Rule("replace", ("__name__",), regex="m(.*)", target_label="kind"), Rule("labeldrop", regex="a")]
    external = F.create_map(F.lit("region"), F.lit("eu"))
    samples = S.parse_samples(S.fail_malformed_bodies(scrapes))
    shape = lambda df: sorted(map(str, df.select("scrape_id", "line_no", "labels", "value", "ts_ms").collect()))
    expected = shape(S.scrape_pipeline(scrapes, target(), rules, external)[1])
    series = S.series_dimension(samples, target(), rules, external)
    assert shape(S.with_series_labels(samples, series)) == expected and 0 < series.where("NOT kept").count() < series.count()
    early = S.series_dimension(samples.where("scrape_id < 5"), target(), rules, external)
    later = S.series_dimension(samples, target(), rules, external, known=early)
    assert shape(S.with_series_labels(samples, later)) == expected and later.count() == series.count() > early.count()


def test_totals(spark):
    """Counters never fall; the gauge keeps what targets had that a bucket does not scrape, until they go."""
    metrics = spark.createDataFrame([(b, *([n] * len(S.MEASURES))) for b, n in ((0, 1), (100, 2), (300, 0), (500, 5))], "bucket_ms long, " + ", ".join(f"{m} long" for m in S.MEASURES))
    tracked = spark.createDataFrame([("a", 10, 3), ("a", 20, 4), ("b", 50, 10), ("b", 310, 7), ("c", 120, 1), ("c", 520, 2)], "target_id string, start_ms long, tracked long")
    removed = spark.createDataFrame([("a", 330), ("c", 520)], "target_id string, ts_ms long")
    got = {r.bucket_ms: r for r in S.ingestion_totals(metrics, tracked, 100, removed).collect()}
    assert [(b, got[b].tracked_series, got[b].scrapes) for b in sorted(got)] == [(0, 14, 1), (100, 15, 3), (300, 8, 3), (500, 7, 8)]
    assert S.ingestion_totals(metrics.where("false"), tracked.where("false"), 100).count() == 0
