"""Column functions for the text exposition format: lines, labels, values, timestamps.

The grammar is one anchored regular expression with possessive quantifiers, so that long label values neither backtrack
nor overflow.  All functions take and return columns; nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAME = "[a-zA-Z_:][a-zA-Z0-9_:]*+"
LABEL_NAME = "[a-zA-Z_][a-zA-Z0-9_]*+"
VALUE = r'[^"\\]*+(?:\\[\\"n][^"\\]*+)*+'
PAIR = rf'({LABEL_NAME})[ \t]*+=[ \t]*+"({VALUE})"'
ONE = rf'{LABEL_NAME}[ \t]*+=[ \t]*+"{VALUE}"[ \t]*+'
PAIRS = rf'[ \t]*+\{{?+[ \t]*+{PAIR}[ \t]*+(?:,[ \t]*+)?+\}}?+'
BLOCK = rf"\{{[ \t]*+(?:{ONE}(?:,[ \t]*+{ONE})*+(?:,[ \t]*+)?+)?+\}}"
LINE = (
    rf"(?sd)\A[ \t]*+({NAME})([ \t]*+(?:{BLOCK})?+)[ \t]*+(?!\{{)([^ \t]++)"
    r"(?:[ \t]++([^ \t#][^ \t]*+))?+[ \t]*+(?:(?<=[ \t])#.*)?+\z"
)
FLOAT = r"(?i)\A[+-]?(?:inf|infinity|nan|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?)\z"
PLAIN = r"\A-?[0-9]{1,15}(?:\.[0-9]{1,15})?\z"
INTEGER = r"\A[+-]?[0-9]+\z"
MAX_LABELS = 128
#: Largest magnitude of a timestamp in seconds whose milliseconds fit a long.
_MAX_MS = 9.223372036854775e18


def explode_lines(body: Column) -> Column:
    """array<struct<line_no, text>>: 1-based lines, one trailing carriage return stripped."""
    return F.transform(F.split(body, "\n"), lambda x, i: F.struct((i + 1).alias("line_no"), F.regexp_replace(x, r"\r\z", "").alias("text")))


def is_sample_line(text: Column) -> Column:
    """Neither blank nor a comment (leading spaces and tabs allowed)."""
    return ~text.rlike(r"(?s)\A[ \t]*+(?:#.*)?\z")


def parse_metric_value(token: Column) -> Column:
    """The double of a value token, null if malformed; one extra leading plus is tolerated."""
    bare = F.regexp_replace(token, r"\A\+", "")
    low = F.lower(F.regexp_replace(bare, r"\A[+-]", ""))
    big = F.when(bare.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    number = F.when(low.isin("inf", "infinity"), big).when(low == "nan", F.lit(float("nan"))).otherwise(bare.try_cast("double"))
    return F.when(token.rlike(PLAIN), token.try_cast("double")).when(bare.rlike(FLOAT), number)


def parse_sample_timestamp(token: Column) -> Column:
    """Milliseconds of a timestamp token, null if malformed: integers are ms, decimals seconds (half away from zero)."""
    seconds = F.when(token.rlike(FLOAT), token.try_cast("double"))
    ms = seconds * 1000
    ms = F.when(ms >= 0, F.floor(ms + 0.5)).otherwise(F.ceil(ms - 0.5))
    ms = F.when(seconds.isNotNull() & ~F.isnan(seconds) & (F.abs(seconds) * 1000 < _MAX_MS), ms)
    return F.when(token.rlike(INTEGER), token.try_cast("bigint")).when(token.rlike("[.eE]"), ms)


def unescape_label_value(value: Column) -> Column:
    r"""``\\``, ``\"`` and ``\n`` decoded; a pair of backslashes never joins its neighbour."""
    parts = F.split(value, r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(F.replace(p, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n"))), "\\")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a one-element transform."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def line_fields(text: Column) -> Column:
    """name, label block, value and timestamp of a line in one match (a line holds no line break); one element if malformed."""
    return F.split(F.regexp_replace(text, LINE, "$1\n$2\n$3\n$4"), "\n")


def label_parts(block: Column) -> Column:
    """Names and raw values in turn."""
    parts = F.split(F.regexp_replace(block, PAIRS, "$1\n$2\n"), "\n")
    return F.when(F.contains(block, F.lit('"')), parts).otherwise(F.array(F.lit("")))


def _names(parts: Column) -> Column:
    return F.filter(parts, lambda x, i: (i % 2 == 0) & (i + 1 < F.size(parts)))


def _pairs(parts: Column) -> Column:
    plain = lambda v: F.when(F.contains(v, F.lit("\\")), unescape_label_value(v)).otherwise(v)
    values = F.filter(parts, lambda x, i: i % 2 == 1)
    return F.zip_with(_names(parts), values, lambda n, v: F.struct(n.alias("name"), plain(v).alias("value")))


def label_names(block: Column) -> Column:
    return let(label_parts(block), _names)


def parse_label_block(block: Column) -> Column:
    """array<struct<name, value>> in the order of the text."""
    return let(label_parts(block), _pairs)


def parse_line(text: Column) -> Column:
    """struct<name, block, value, ts_ms, labels, error> of a sample line; ts_ms is null without timestamp, error if sound."""

    def judged(f: Column) -> Column:
        part = lambda i: F.coalesce(F.get(f, F.lit(i)), F.lit(""))
        ts = F.when(part(3) != "", parse_sample_timestamp(part(3)))
        read = F.struct(parse_metric_value(part(2)).alias("value"), ts.alias("ts_ms"), let(label_parts(part(1)), _pairs).alias("labels"))
        return let(read, lambda r: F.struct(part(0).alias("name"), part(1).alias("block"), r["value"].alias("value"), r["ts_ms"].alias("ts_ms"), r["labels"].alias("labels"), _error(f, part(3), r).alias("error")))

    def _error(f: Column, ts: Column, r: Column) -> Column:
        names = r["labels"]["name"]
        return (
            F.when(F.size(f) < 4, "malformed line")
            .when(F.array_contains(names, "__name__"), "__name__ inside braces")
            .when(F.size(F.array_distinct(names)) < F.size(names), "duplicate label name")
            .when(F.size(names) + 1 > MAX_LABELS, "too many labels")
            .when(r["value"].isNull(), "malformed value")
            .when((ts != "") & r["ts_ms"].isNull(), "malformed timestamp")
        )

    return let(line_fields(text), judged)


def line_error(text: Column) -> Column:
    """Why a sample line is malformed, or null."""
    return parse_line(text)["error"]


def identity_of(name: Column, block: Column) -> Column:
    return F.when(F.contains(block, F.lit("{")), F.concat(name, block)).otherwise(name)


def series_identity(text: Column) -> Column:
    """The raw text from the metric name through the closing brace: identity is textual."""
    return let(line_fields(text), lambda f: identity_of(F.get(f, F.lit(0)), F.coalesce(F.get(f, F.lit(1)), F.lit(""))))


def body_format(content_type: Column) -> Column:
    """"text", "protobuf" or null (a scrape error) from a content type."""
    parts = F.transform(F.split(F.coalesce(content_type, F.lit("")), ";"), lambda p: F.trim(p))
    media = F.lower(F.get(parts, F.lit(0)))
    pairs = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.struct(F.lower(F.trim(F.substring_index(p, "=", 1))).alias("k"), F.regexp_replace(F.trim(F.regexp_extract(p, "(?s)=(.*)", 1)), r'\A"(.*)"\z', "$1").alias("v")))
    has = lambda k, v: F.exists(pairs, lambda p: (p["k"] == k) & (p["v"] == v))
    proto = media == "application/vnd.google.protobuf"
    good = has("proto", "io.prometheus.client.MetricFamily") & has("encoding", "delimited")
    return F.when(~proto, "text").when(good, "protobuf")
