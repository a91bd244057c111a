"""Pseudonymization of scrape bodies: label values that are not allowed to stay are replaced, and leaks are looked for.

Bodies are a table (file, body).  ``keep`` names the labels whose values stay, ``high_risk`` those that hold identities.
Comments, metric names, values, timestamps, blanks and commas are copied.  Null bodies hold no labels and stay null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.exposition import let
from .leaks import values_in

QUOTED = r'"(?:[^"\\]++|\\.)*+"'
SET = rf'(?s)\A([^{{]*+\{{)((?:[^"}}]++|{QUOTED})*+)(\}}.*)\z'
#: A pair up to its value's opening quote, and the value; blanks may stand around the equals sign.
PAIR = r'([^=,{"\s][^=,{"\s]*+[ \t]*+=[ \t]*+")((?:[^"\\]++|\\.)*+)'
DISTINCTIVE = 4


def is_distinctive(value: Column) -> Column:
    """Specific enough to search for: four bytes or more, not lower-case letters alone."""
    return (F.octet_length(value) >= DISTINCTIVE) & ~value.rlike(r"\A[a-z]*\z")


def _pieces(line: Column) -> Column:
    """A line in threes: other text, a pair's text up to its value, the value; the rest of the line last.

    Comments and lines without a closed label set are one piece."""
    block = F.regexp_replace(F.regexp_extract(line, SET, 2), PAIR, "\n$1\n$2\n")
    whole = F.split(F.concat(F.regexp_extract(line, SET, 1), block, F.regexp_extract(line, SET, 3)), "\n")
    return F.when(line.rlike(r"\A[ \t]*#") | ~line.rlike(SET), F.array(line)).otherwise(whole)


def _name(piece: Column) -> Column:
    return F.regexp_extract(piece, r"\A([^= \t]*)", 1)


def _pairs(line: Column) -> Column:
    def read(p: Column) -> Column:
        names = F.transform(F.filter(p, lambda x, i: i % 3 == 1), _name)
        return F.arrays_zip(names.alias("label"), F.filter(p, lambda x, i: i % 3 == 2).alias("value"))

    return let(_pieces(line), read)


def corpus_label_values(bodies: DataFrame) -> DataFrame:
    """file, line_no, label, value (escapes left as they are) of every label of every sample line."""
    lines = bodies.select("file", F.posexplode(F.split("body", "\n")).alias("i", "line"))
    found = L.each(lines.select("file", (F.col("i") + 1).alias("line_no"), "line"), _pairs(F.col("line")), "p")
    return found.select("file", "line_no", F.col("p.label").alias("label"), F.col("p.value").alias("value"))


def high_risk_values(values: DataFrame, high_risk: list[str]) -> DataFrame:
    """Distinct non-empty values under high-risk labels."""
    return values.where(F.col("label").isin(high_risk) & (F.col("value") != "")).select("value").distinct()


def public_vocabulary(values: DataFrame, keep: list[str], high_risk: list[str]) -> DataFrame:
    """Distinct values under kept labels, without those that are high-risk and distinctive."""
    public = values.where(F.col("label").isin(keep) & (F.col("value") != "")).select("value").distinct()
    secret = high_risk_values(values, high_risk).where(is_distinctive(F.col("value")))
    return public.join(secret, "value", "left_anti")


def denied_values(values: DataFrame, keep: list[str], public: DataFrame) -> DataFrame:
    """The occurrences that must be replaced."""
    return values.where(~F.col("label").isin(keep) & (F.col("value") != "")).join(public, "value", "left_anti")


def _shifted(half: Column, other: Column, key: str) -> Column:
    """Each letter and digit of ``half`` moved within its class by a digest of the key, its place and ``other``."""

    def one(c: Column, i: Column) -> Column:
        digest = F.md5(F.concat_ws("|", F.lit(key), (i + 1).cast("string"), other))
        roll = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
        move = lambda first, size: F.char(F.lit(ord(first)) + (F.ascii(c) - ord(first) + roll) % size)
        return F.when(c.rlike("[a-z]"), move("a", 26)).when(c.rlike("[A-Z]"), move("A", 26)).when(c.rlike("[0-9]"), move("0", 10)).otherwise(c)

    return F.array_join(F.transform(F.split(half, ""), one), "")


def pseudonym_map(values: DataFrame, salt: str = "0", rounds: int = 4) -> DataFrame:
    """value, pseudonym of the distinct non-null ``values``: same length and character classes, one raw value per pseudonym.

    The halves of a value move each other in turn; every round can be undone, so pseudonyms never collide and nothing is
    tried again.
    """
    half = F.floor(F.length("value") / 2).cast("int")
    df = values.select("value").where("value IS NOT NULL").distinct()
    df = df.withColumns({"_a": F.left("value", half), "_b": F.substring(F.col("value"), half + 1, F.length("value"))})
    for r in range(rounds):
        a, b = ("_a", "_b") if r % 2 else ("_b", "_a")
        df = df.withColumn(a, _shifted(F.col(a), F.col(b), f"{salt}|{r}"))
    return df.select("value", F.concat("_a", "_b").alias("pseudonym"))


def pseudonymize_bodies(bodies: DataFrame, denied: DataFrame, mapping: DataFrame, keep: list[str]) -> DataFrame:
    """``bodies`` with every denied value replaced in place.  Only a body's own pseudonyms travel to it."""
    own = denied.select("file", "value").distinct().join(mapping, "value")
    own = own.groupBy(F.col("file").alias("_f")).agg(F.map_from_entries(F.collect_list(F.struct("value", "pseudonym"))).alias("_m"))
    kept = F.array(*[F.lit(k) for k in keep]).cast("array<string>")

    def rewritten(line: Column) -> Column:
        other = lambda v: F.coalesce(F.try_element_at("_m", v), v)

        def put(p: Column) -> Column:
            value = lambda v, i: F.when((i % 3 == 2) & ~F.array_contains(kept, _name(F.get(p, i - 1))), other(v)).otherwise(v)
            return F.array_join(F.transform(p, value), "")

        return let(_pieces(line), put)

    out = bodies.join(own, F.col("file") == F.col("_f"), "left")
    return out.withColumn("body", F.array_join(F.transform(F.split("body", "\n"), rewritten), "\n")).drop("_f", "_m")


def redaction_report(denied: DataFrame) -> DataFrame:
    """Replaced occurrences of each label."""
    return denied.groupBy("label").agg(F.count("*").alias("redacted"))


def suspicious(text: Column) -> Column:
    """Tokens of seven characters or more shaped like an IPv4 or a MAC address."""
    octet = "(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]))"
    shape = rf"\A(?:(?=[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}}\z){octet}(?:\.{octet}){{3}}|[0-9a-fA-F]{{2}}(?::[0-9a-fA-F]{{2}}){{5}})\z"
    return F.filter(F.split(text, r"[^a-zA-Z0-9.:_-]"), lambda t: (F.length(t) >= 7) & t.rlike(shape))


def leak_scan(clean: DataFrame, secrets: DataFrame, keep: list[str]) -> DataFrame:
    """Leaks (file, kind, token): high-risk distinctive values anywhere, addresses in comments and in kept labels.

    Values meet bodies by their rarest grams (see ``leaks``): one pass over the bodies for any number of values, of which none
    goes through the driver."""
    lines = clean.select("file", F.explode(F.split("body", "\n")).alias("line"))
    comments = lines.where(F.ltrim("line").startswith("#")).select("file", F.lit("comment").alias("kind"), F.explode(suspicious(F.col("line"))).alias("token"))
    kept = corpus_label_values(clean).where(F.col("label").isin(keep))
    labels = kept.select("file", F.lit("label").alias("kind"), F.explode(suspicious(F.col("value"))).alias("token"))
    found = values_in(clean, secrets.where(is_distinctive(F.col("value"))))
    return comments.union(labels).union(found.select("file", F.lit("value").alias("kind"), F.col("value").alias("token"))).distinct()


def fidelity_check(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per file: equal byte length, and equal numbers of distinct label values."""

    def described(df: DataFrame, tag: str) -> DataFrame:
        n = corpus_label_values(df).groupBy(F.col("file").alias("_f")).agg(F.countDistinct("value").alias("n"))
        out = df.select("file", F.octet_length("body").alias("bytes")).join(n, F.col("file") == F.col("_f"), "left")
        return out.select("file", F.struct("bytes", F.coalesce("n", F.lit(0)).alias("n")).alias(tag))

    both = described(before, "a").join(described(after, "b"), "file")
    return both.select("file", (F.col("a.bytes") == F.col("b.bytes")).alias("same_bytes"), (F.col("a.n") == F.col("b.n")).alias("same_values"))
