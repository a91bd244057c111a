"""Quality rules: a threshold table compiled into one Spark projection (built-in expressions only).

``quality_rules(docs)`` keeps every row and column of ``docs`` and adds the measures and verdicts; nothing is
shuffled.  Semantics of the edge cases:

* null and empty text: zero words, all counts 0, ``base_failed`` true, ``kept`` false; no ratio is null.
* rows repeated, ties, nulls in other columns: each row is judged alone, other columns are untouched.
* extra columns: kept; an input column with the name of a result column is replaced by the result.
* repeated 3-word windows are found by 64-bit hashes within one text (a collision needs some 2^32 windows in a text).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import set_aside

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for on as with was be by this are from or at have not "
    "le la les de des du et un une en que qui dans est pour au sur par "
    "der die das und den dem ein eine von zu mit sich auf ist im nicht für als auch es "
    "el los las y del se por con para su al lo una no"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes if ``low <= measure <= high`` (a bound of None is open)."""

    measure: str
    low: float | None = None
    high: float | None = None


#: The threshold table.
RULES = (
    Rule("n_words", 50),
    Rule("mean_word_length", 2.0, 14.0),
    Rule("symbol_ratio", None, 0.10),
    Rule("stop_ratio", 0.03, None),
    Rule("dup_line_ratio", None, 0.30),
    Rule("repeat_word_ratio", None, 0.50),
    Rule("bullet_line_ratio", None, 0.90),
    Rule("ellipsis_line_ratio", None, 0.30),
)


def _long(c: Column) -> Column:
    return F.coalesce(c, F.lit(0)).cast("long")


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def _without(text: Column, chars: str) -> Column:
    """Code points of ``text`` other than ``chars``."""
    return F.length(F.translate(text, chars, ""))


def _repeat_words(words: Column, n: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text."""
    grams = F.slice(F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))), F.lit(1), n - 2)

    def covered(g: Column) -> Column:
        ranked = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            again = F.filter(
                s,
                lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]),
            )
            return F.sort_array(F.transform(again, lambda x: x["i"]))

        count = lambda p: F.aggregate(
            p,
            F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
            lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")),
            lambda acc: acc["n"],
        )
        return _let(_let(ranked, starts), count)

    def judged(g: Column) -> Column:
        return F.when(F.size(F.array_distinct(g)) < F.size(g), covered(g)).otherwise(F.lit(0))

    return F.when(n >= 4, _let(grams, judged)).otherwise(F.lit(0))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a one-element transform."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def measures(text: Column) -> list[tuple[str, Column]]:
    """First-level measures of a text column, by name."""
    text = F.coalesce(text, F.lit(""))
    words, lines = F.col("_words"), F.col("_lines")
    return [
        ("n_words", _long(F.size(words))),
        ("word_chars", _long(F.length(F.array_join(words, "")))),
        ("n_symbols", _long(F.length(text) - _without(text, SYMBOLS))),
        ("n_dup_lines", _long(F.size(lines) - F.size(F.array_distinct(lines)))),
        ("n_repeat_words", _long(_repeat_words(words, F.size(words)))),
        ("n_lines", _long(F.size(lines))),
        ("n_stop_words", _long(F.size(F.filter(words, lambda w: w.isin(*STOP_WORDS))))),
        ("n_bullet_lines", _long(F.size(F.filter(lines, lambda x: F.substring(x, 1, 1).isin("-", "*", "\u2022"))))),
        ("n_ellipsis_lines", _long(F.size(F.filter(lines, lambda x: F.endswith(x, F.lit("...")) | F.endswith(x, F.lit("\u2026")))))),
    ]


RATIOS = (
    ("mean_word_length", "word_chars", "n_words"),
    ("symbol_ratio", "n_symbols", "n_words"),
    ("stop_ratio", "n_stop_words", "n_words"),
    ("dup_line_ratio", "n_dup_lines", "n_lines"),
    ("repeat_word_ratio", "n_repeat_words", "n_words"),
    ("bullet_line_ratio", "n_bullet_lines", "n_lines"),
    ("ellipsis_line_ratio", "n_ellipsis_lines", "n_lines"),
)


def compiled(rules=RULES) -> Column:
    """The threshold table as one boolean column."""
    verdict = F.lit(True)
    for r in rules:
        if r.low is not None:
            verdict = verdict & (F.col(r.measure) >= F.lit(r.low))
        if r.high is not None:
            verdict = verdict & (F.col(r.measure) <= F.lit(r.high))
    return verdict


def quality_rules(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """``docs`` with measures, ratios, ``base_failed`` and ``kept`` (see the module's docstring)."""
    docs, back = set_aside(docs, "_words", "_lines")
    text_col = F.col(next((new for new, c in back.items() if c == text), text))
    whole = F.coalesce(text_col, F.lit(""))
    docs = docs.withColumns(
        {
            "_words": F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)),
            "_lines": F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        }
    )
    docs = docs.withColumns(dict(measures(text_col))).drop("_words", "_lines")
    docs = docs.withColumns({name: _ratio(a, b) for name, a, b in RATIOS})
    docs = docs.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return docs.withColumn("kept", ~F.col("base_failed") & compiled(rules)).withColumnsRenamed(back)


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_rules(docs).select(*COLUMNS)


_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)
SQL = f"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM documents),
g AS (
  SELECT *, list_transform(range(1, greatest(len(ws) - 1, 1)), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) AS gs
  FROM w),
spread AS (SELECT rowid_ AS r, unnest(gs) AS gram, unnest(range(1, len(gs) + 1)) AS i
           FROM (SELECT row_number() OVER () AS rowid_, * FROM g)),
base AS (SELECT row_number() OVER () AS r, * FROM g),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c FROM spread) WHERE c >= 2),
hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY r),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(hit.n, 0)::BIGINT AS n_repeat_words,
         len(ls) AS n_lines,
         len(list_filter(ws, lambda x: x IN ({_STOP_SQL}))) AS n_stop_words,
         len(list_filter(ls, lambda x: regexp_matches(x, '^[-*\u2022]'))) AS n_bullet_lines,
         len(list_filter(ls, lambda x: regexp_matches(x, '(\\.\\.\\.|\u2026)$'))) AS n_ellipsis_lines
  FROM base LEFT JOIN hit USING (r)),
v AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed
   AND word_chars / n_words BETWEEN 2.0 AND 14.0
   AND n_symbols / n_words <= 0.10 AND n_stop_words / n_words >= 0.03
   AND n_dup_lines / greatest(n_lines, 1) <= 0.30 AND n_repeat_words / n_words <= 0.50
   AND n_bullet_lines / greatest(n_lines, 1) <= 0.90 AND n_ellipsis_lines / greatest(n_lines, 1) <= 0.30) AS kept
FROM v
"""
