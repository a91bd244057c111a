"""The scrape pipeline: bodies to samples, statistics and report series, with whole-body error semantics.

A scrape's verdict (failed fetch, body too large, first malformed line, too many samples) is found inside its row, so
nothing is shuffled before the samples exist.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exposition as X
from ..functions import labels as L
from ..functions.numbers import format_number
from ..shared import written
from .relabel import Rule, relabel

BODY_LIMIT = 128 << 20
REPORTS = ("up", "scrape_duration_seconds", "scrape_samples_scraped", "scrape_samples_post_metric_relabeling", "scrape_series_added")


def fail_malformed_bodies(scrapes: DataFrame, body_limit: int = BODY_LIMIT, sample_limit: int = 0) -> DataFrame:
    """``scrapes`` (scrape_id, target_id, start_ms, body string, duration_s, fetch_error) with lines, error and error_line.

    ``lines`` holds the parsed sample lines of a sound body (line_no and the fields of ``parse_line``) and is empty
    otherwise; ``scraped`` counts them, also when the sample limit fails the scrape.  A limit of 0 is off; a null body
    counts as empty.  Every line is matched once.
    """
    body = F.coalesce(F.col("body"), F.lit(""))
    too_big = (F.octet_length(body) > body_limit) if body_limit else F.lit(False)
    # what fails as a whole is not parsed
    df = scrapes.withColumn("_lines", _parsed(F.when(F.col("fetch_error").isNotNull() | too_big, "").otherwise(body)))
    df = df.withColumn("_bad", _first_bad(F.col("_lines")))
    broken = F.col("fetch_error").isNotNull() | too_big | F.col("_bad").isNotNull()
    many = (F.size("_lines") > sample_limit) if sample_limit else F.lit(False)
    return df.withColumns(
        {
            "error": F.when(F.col("fetch_error").isNotNull(), F.col("fetch_error"))
            .when(too_big, "body size limit exceeded")
            .when(F.col("_bad").isNotNull(), F.col("_bad.p.error"))
            .when(many, "sample limit exceeded"),
            "error_line": F.when(F.col("fetch_error").isNull() & ~too_big, F.col("_bad.line_no")),
            "scraped": F.when(broken, 0).otherwise(F.size("_lines")).cast("bigint"),
            "lines": F.when(broken | many, F.slice("_lines", 1, 0)).otherwise(F.col("_lines")),
        }
    ).drop("_lines", "_bad")


def _parsed(body: Column) -> Column:
    lines = F.filter(X.explode_lines(body), lambda x: X.is_sample_line(x["text"]))
    return F.transform(lines, lambda x: F.struct(x["line_no"].alias("line_no"), X.parse_line(x["text"]).alias("p")))


def _first_bad(lines: Column) -> Column:
    return F.get(F.filter(lines, lambda x: x["p"]["error"].isNotNull()), F.lit(0))


#: Bodies above this size are parsed in pieces of about as much.
PIECE_BYTES = 4 << 20


def cut_bodies(scrapes: DataFrame, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """``scrapes`` with a row for each piece of a body: ``body`` cut at line ends after ``piece_bytes`` or more, ``piece``, and
    ``lines_before``, the number of line ends before it.  A body without line ends is one piece, a null body none."""
    own = scrapes.drop("piece", "lines_before")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, place = batch.column("body"), batch.schema.get_field_index("body")
            rows, texts, pieces, lines, held = [], [], [], [], 0

            def some() -> pa.RecordBatch:
                at = pa.array(rows, pa.int64())  # noqa: B023
                text = pa.array(texts, pa.binary()).cast(pa.string())  # noqa: B023
                columns = [text if j == place else c.take(at) for j, c in enumerate(batch.columns)]  # noqa: B023
                return pa.RecordBatch.from_arrays([*columns, pa.array(pieces, pa.int32()), pa.array(lines, pa.int64())], [*batch.schema.names, "piece", "lines_before"])  # noqa: B023

            for i in range(batch.num_rows):
                if not bodies[i].is_valid:
                    continue
                body = bodies[i].as_buffer().to_pybytes()
                first = piece = before = 0
                while first <= len(body):
                    end = body.find(b"\n", first + piece_bytes)
                    end = len(body) if end < 0 else end
                    for column, value in ((rows, i), (texts, body[first:end]), (pieces, piece), (lines, before)):
                        column.append(value)
                    held += end - first
                    before += body.count(b"\n", first, end + 1)
                    first, piece = end + 1, piece + 1
                    if held >= PIECE_BYTES or len(rows) >= 10_000:
                        yield some()
                        rows, texts, pieces, lines, held = [], [], [], [], 0
            if rows:
                yield some()

    return own.mapInArrow(run, f"{kinds}, piece int, lines_before long")


def judge_bodies(scrapes: DataFrame, body_limit: int = BODY_LIMIT, sample_limit: int = 0, piece_bytes: int = PIECE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(verdicts, parts) of ``scrapes`` (scrape_id tells them apart), whatever the size of their bodies.

    Verdicts have what ``fail_malformed_bodies`` gives but the lines, a row for each scrape; parts are rows for
    ``parse_samples`` and ``scrape_stats``, with the lines.  Bodies up to ``piece_bytes`` are one part and move nowhere.  Larger ones
    are cut at line ends and their pieces dealt out, so that a task never holds the parsed lines of more than some pieces;
    the first bad line and the number of samples are merged by scrape and go back to the pieces."""
    body, fine = F.octet_length(F.coalesce("body", F.lit(""))), F.col("fetch_error").isNull()
    large = fine & (body > piece_bytes) & ((body <= body_limit) if body_limit else F.lit(True))
    small = fail_malformed_bodies(scrapes.where(~large), body_limit, sample_limit)

    others = [c for c in scrapes.columns if c != "body"]
    pieces = cut_bodies(scrapes.where(large), piece_bytes).repartition("scrape_id", "piece").withColumn("_lines", _parsed(F.coalesce("body", F.lit("")))).drop("body")
    moved = F.transform("_lines", lambda x: F.struct((x["line_no"] + F.col("lines_before")).cast("int").alias("line_no"), x["p"].alias("p")))
    pieces = pieces.withColumn("_lines", moved).withColumns({"_bad": _first_bad(F.col("_lines")), "_size": F.size("_lines")})
    pieces = written(pieces, "pieces")  # verdicts read no lines
    bad = F.struct(F.col("_bad.line_no").alias("line_no"), F.col("_bad.p.error").alias("error"))
    merged = pieces.groupBy("scrape_id").agg(*(F.first(c).alias(c) for c in others if c != "scrape_id"), F.min(F.when(F.col("_bad").isNotNull(), bad)).alias("_first"), F.sum("_size").alias("_n"))
    many = (F.col("_n") > sample_limit) if sample_limit else F.lit(False)
    broken = F.col("_first").isNotNull()
    verdict = {"error": F.coalesce(F.col("_first.error"), F.when(many, "sample limit exceeded")), "error_line": F.col("_first.line_no"), "scraped": F.when(broken, 0).otherwise(F.col("_n")).cast("bigint")}
    judged = merged.withColumns(verdict).drop("_first", "_n")
    own = judged.select(F.col("scrape_id").alias("_id"), *verdict)
    parts = pieces.join(own, F.col("scrape_id") == F.col("_id")).withColumn("lines", F.when(F.col("error").isNull(), F.col("_lines")).otherwise(F.slice("_lines", 1, 0)))
    columns = [*others, *verdict]
    return small.select(columns).unionByName(judged.select(columns)), small.select(*columns, "lines").unionByName(parts.select(*columns, "lines"))


def parse_samples(judged: DataFrame, honor_timestamps: bool = True, outer: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per sample line of sound bodies: line_no, identity, labels (map in text order, __name__ first), value, ts_ms.

    With ``outer`` a scrape without samples has one row of null labels."""
    df = judged.select("scrape_id", "target_id", "start_ms", *carry, "lines")
    df = (df.withColumn("line", F.explode_outer("lines")) if outer else L.each(df, F.col("lines"), "line")).drop("lines")
    own = F.transform("line.p.labels", lambda p: F.struct(p["name"].alias("key"), p["value"].alias("value")))
    head = F.array(F.struct(F.lit("__name__").alias("key"), F.col("line.p.name").alias("value")))
    ts = F.coalesce("line.p.ts_ms", "start_ms") if honor_timestamps else F.col("start_ms")
    columns = {"line_no": F.col("line.line_no"), "value": F.col("line.p.value"), "identity": X.identity_of(F.col("line.p.name"), F.col("line.p.block")), "labels": F.map_from_entries(F.concat(head, own)), "ts_ms": ts}
    if outer:
        columns["labels"] = F.when(F.col("line").isNotNull(), columns["labels"])
    return df.withColumns(columns).drop("line")


def _labelled(df: DataFrame, target_labels: Column, rules: list[Rule], external: Column | None, honor_labels: bool, flag: str | None = None) -> DataFrame:
    df = relabel(df.withColumn("labels", L.merge_target_labels(F.col("labels"), target_labels, F.lit(honor_labels))), rules, flag=flag)
    return df if external is None else df.withColumn("labels", L.add_external_labels(F.col("labels"), external))


def series_dimension(samples: DataFrame, target_labels: Column, rules: list[Rule] = [], external: Column | None = None, honor_labels: bool = False, known: DataFrame | None = None) -> DataFrame:  # noqa: B006
    """A row for each series (target_id, identity) of parsed ``samples``: ``kept``, and its final ``labels`` (sorted; null if not kept).

    An identity is the text of a series, so a target's label rules give it the same labels at each scrape: they are worked out
    once for each series and not for each sample.  ``known`` is an earlier dimension, whose series are taken over as they are;
    ``target_labels`` must depend on nothing but the target."""
    new = samples if known is None else samples.join(known.select("target_id", "identity"), ["target_id", "identity"], "left_anti")
    own = new.groupBy("target_id", "identity").agg(F.first("labels").alias("labels"))
    own = _labelled(own, target_labels, rules, external, honor_labels, flag="kept")
    own = own.select("target_id", "identity", "kept", F.when(F.col("kept"), L.sort_labels(F.col("labels"))).alias("labels"))
    return own if known is None else known.select(*own.columns).unionByName(own)


def with_series_labels(samples: DataFrame, dimension: DataFrame) -> DataFrame:
    """Parsed ``samples`` of kept series, with the labels that the dimension has for them."""
    own = dimension.where("kept").select(F.col("target_id").alias("_t"), F.col("identity").alias("_i"), F.col("labels").alias("_labels"))
    joined = samples.join(own, (F.col("target_id") == F.col("_t")) & (F.col("identity") == F.col("_i")))
    return joined.withColumn("labels", F.col("_labels")).select(*samples.columns)


def scrape_pipeline(scrapes: DataFrame, target_labels: Column, rules: list[Rule] = [], external: Column | None = None, honor_labels: bool = False, honor_timestamps: bool = True, body_limit: int = BODY_LIMIT, sample_limit: int = 0) -> tuple[DataFrame, DataFrame]:  # noqa: B006
    """(judged scrapes, final samples): parse, merge target labels, metric relabeling, external labels, sorted labels."""
    judged = fail_malformed_bodies(scrapes, body_limit, sample_limit)
    df = _labelled(parse_samples(judged, honor_timestamps), target_labels, rules, external, honor_labels)
    return judged, df.withColumn("labels", L.sort_labels(F.col("labels")))


def scrape_stats(judged: DataFrame, target_labels: Column, rules: list[Rule] = [], honor_labels: bool = False) -> DataFrame:  # noqa: B006
    """scrape_id, target_id, start_ms, duration_s, error, up, scraped and kept (samples after relabeling) of every judged
    scrape, empty and failed ones included, in one pass over the bodies."""
    carry = ("duration_s", "error", "scraped")
    df = _labelled(parse_samples(judged, outer=True, carry=carry), target_labels, rules, None, honor_labels, flag="_kept")
    by = df.groupBy("scrape_id").agg(*(F.first(c).alias(c) for c in ("target_id", "start_ms", *carry)), F.count_if("_kept").alias("kept"))
    return by.select("scrape_id", "target_id", "start_ms", "duration_s", "error", F.col("error").isNull().cast("int").alias("up"), "scraped", "kept")


def report_series(stats: DataFrame) -> DataFrame:
    """The five synthetic series of every scrape: scrape_id, target_id, ts_ms, name, value."""
    values = ("up", "duration_s", "scraped", "kept", "kept")
    pairs = ", ".join(f"'{n}', cast({v} AS double)" for n, v in zip(REPORTS, values, strict=True))
    return stats.selectExpr("scrape_id", "target_id", "start_ms AS ts_ms", f"stack(5, {pairs}) AS (name, value)")


def scrape_health_transitions(stats: DataFrame) -> DataFrame:
    """Per scrape: transition (down, recovered, changed, failing, or null) and consecutive failures so far."""
    order = Window.partitionBy("target_id").orderBy("start_ms", "scrape_id")
    before = F.lag("error").over(order)
    first = F.lag(F.lit(1)).over(order).isNull()
    kind = (
        F.when(F.col("error").isNotNull() & (first | before.isNull()), "down")
        .when(F.col("error").isNull() & before.isNotNull(), "recovered")
        .when(F.col("error").isNotNull() & (F.col("error") != before), "changed")
        .when(F.col("error").isNotNull(), "failing")
    )
    df = stats.withColumns({"transition": kind, "_island": F.sum(F.col("error").isNull().cast("int")).over(order)})
    run = F.sum(F.col("error").isNotNull().cast("int")).over(Window.partitionBy("target_id", "_island").orderBy("start_ms", "scrape_id"))
    return df.withColumn("failures", run).drop("_island")


MEASURES = ("scrapes", "failures", "samples_scraped", "samples_kept", "markers", "tracked_series", "batches", "sent_bytes", "retries", "failed_batches")


def ingestion_metrics(stats: DataFrame, bucket_ms: int, markers: DataFrame | None = None, tracked: DataFrame | None = None, outcomes: DataFrame | None = None) -> DataFrame:
    """``MEASURES`` per time bucket, 0 where there is nothing.

    ``markers`` (ts_ms) are staleness markers; ``tracked`` (target_id, start_ms, tracked) is the number of series that a
    target has after a scrape, of which a bucket counts each target's last; ``outcomes`` (ts_ms, outcome, bytes) are
    delivery attempts: a batch counts when it is accepted, with its bytes."""
    at = lambda c: (F.floor(F.col(c) / bucket_ms) * bucket_ms).cast("bigint").alias("bucket_ms")
    up = F.when(F.col("up") == 0, 1).otherwise(0)
    parts = [stats.select(at("start_ms"), F.lit(1).alias("scrapes"), up.alias("failures"), F.col("scraped").alias("samples_scraped"), F.col("kept").alias("samples_kept"))]
    if markers is not None:
        parts.append(markers.select(at("ts_ms"), F.lit(1).alias("markers")))
    if tracked is not None:
        last = tracked.groupBy(at("start_ms"), "target_id").agg(F.max_by("tracked", "start_ms").alias("tracked_series"))
        parts.append(last.drop("target_id"))
    if outcomes is not None:
        sent = F.col("outcome").isin("ok", "partial")
        one = lambda c: F.when(c, 1).otherwise(0)
        parts.append(outcomes.select(at("ts_ms"), one(sent).alias("batches"), F.when(sent, F.col("bytes")).otherwise(0).alias("sent_bytes"), one(F.col("outcome") == "retry").alias("retries"), one(F.col("outcome") == "dropped").alias("failed_batches")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    for m in MEASURES:
        rows = rows if m in rows.columns else rows.withColumn(m, F.lit(0))
    return rows.groupBy("bucket_ms").agg(*(F.coalesce(F.sum(m), F.lit(0)).cast("bigint").alias(m) for m in MEASURES))


def ingestion_totals(metrics: DataFrame, tracked: DataFrame, bucket_ms: int, removed: DataFrame | None = None) -> DataFrame:
    """``ingestion_metrics`` as an agent shows them at the end of each bucket: counters since the first bucket, and the number of
    series that all targets have by then.

    ``tracked`` (target_id, start_ms, tracked) is as there; a target keeps its last number through buckets that do not scrape
    it, until ``removed`` (target_id, ts_ms) ends it.  Only changes of a target are summed, so no target is repeated for a
    bucket; what is numbered in one window is a row for each bucket."""
    at = lambda c: (F.floor(F.col(c) / bucket_ms) * bucket_ms).cast("bigint").alias("bucket_ms")
    states = tracked.select("target_id", at("start_ms"), F.struct(F.col("start_ms").alias("at"), F.lit(0).alias("last"), F.col("tracked").cast("bigint").alias("n")).alias("s"))
    if removed is not None:
        states = states.unionByName(removed.select("target_id", at("ts_ms"), F.struct(F.col("ts_ms").cast("bigint").alias("at"), F.lit(1).alias("last"), F.lit(0).cast("bigint").alias("n")).alias("s")))
    ends = states.groupBy("target_id", "bucket_ms").agg(F.max("s").alias("s"))
    before = F.coalesce(F.lag("s.n").over(Window.partitionBy("target_id").orderBy("bucket_ms")), F.lit(0))
    changes = ends.select("bucket_ms", (F.col("s.n") - before).alias("tracked_series"))
    counters = [m for m in MEASURES if m != "tracked_series"]
    rows = metrics.select("bucket_ms", *counters).unionByName(changes, allowMissingColumns=True).groupBy("bucket_ms").agg(*(F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in MEASURES))
    so_far = Window.orderBy("bucket_ms").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("bucket_ms", *(F.sum(m).over(so_far).cast("bigint").alias(m) for m in MEASURES))


def ingestion_metric_series(metrics: DataFrame, labels: dict[str, str], prefix: str = "meterflow_") -> DataFrame:
    """Each measure of each bucket as a series (labels sorted, ts_ms, value), in order of labels and time.

    ``labels`` are job, instance and external labels; a measure's own name wins."""
    pairs = ", ".join(f"'{prefix}{m}', cast({m} AS double)" for m in MEASURES)
    rows = metrics.selectExpr("bucket_ms AS ts_ms", f"stack({len(MEASURES)}, {pairs}) AS (name, value)")
    more = F.create_map(*[F.lit(x) for k, v in labels.items() if k != "__name__" for x in (k, v)]) if labels else F.create_map().cast("map<string,string>")
    named = L.sort_labels(F.map_concat(more, F.create_map(F.lit("__name__"), F.col("name"))))
    return rows.select(named.alias("labels"), "ts_ms", "value").orderBy("labels", "ts_ms")


def render_exposition(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, body): text of ``rows`` (key, name, help, kind, labels array, value), families and their lines in order.

    Help texts and label values are escaped; a family without samples has no text."""
    escaped = lambda c: F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    quoted = lambda v: F.concat(F.lit('"'), F.replace(escaped(v), F.lit('"'), F.lit('\\"')), F.lit('"'))
    block = F.concat(F.lit("{"), F.array_join(F.transform("labels", lambda p: F.concat(p["name"], F.lit("="), quoted(p["value"]))), ","), F.lit("}"))
    line = F.concat("name", F.when(F.size("labels") > 0, block).otherwise(""), F.lit(" "), format_number(F.col("value")))
    head = F.concat(F.lit("# HELP "), "name", F.lit(" "), escaped(F.col("help")), F.lit("\n# TYPE "), "name", F.lit(" "), "kind", F.lit("\n"))
    lines = rows.select(*key, "name", head.alias("head"), line.alias("line"))
    families = lines.groupBy(*key, "name").agg(F.min("head").alias("head"), F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("lines"))
    body = F.transform(F.sort_array(F.collect_list(F.struct("name", "head", "lines"))), lambda f: F.concat(f["head"], f["lines"], F.lit("\n")))
    return families.groupBy(*key).agg(F.array_join(body, "").alias("body"))
