"""Relabeling: an ordered list of rules compiled to one projection or filter each.

Patterns are anchored at both ends with a true end of text, ``.`` excludes only the newline, and classes are Unicode.
Templates (``$1``, ``${1}``, ``$name``, ``$$``) compile to concatenations of group extractions on the driver.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L

ACTIONS = ("replace", "keep", "drop", "keepequal", "dropequal", "hashmod", "labelmap", "labeldrop", "labelkeep", "lowercase", "uppercase")
_NEED_TARGET = {"replace", "hashmod", "lowercase", "uppercase", "keepequal", "dropequal"}
_TARGET_NAME = r"\A[a-zA-Z_][a-zA-Z0-9_]*\z"


@dataclass(frozen=True)
class Rule:
    action: str = "replace"
    source_labels: tuple[str, ...] = field(default=())
    separator: str = ";"
    regex: str = "(.*)"
    target_label: str = ""
    replacement: str = "$1"
    modulus: int = 0


def validate_relabel_rules(rules: list[Rule]) -> None:
    for r in rules:
        if r.action not in ACTIONS:
            raise ValueError(f"unknown action {r.action}")
        if r.action in _NEED_TARGET and not r.target_label:
            raise ValueError(f"{r.action} needs a target label")
        if r.action == "hashmod" and r.modulus <= 0:
            raise ValueError("hashmod needs a modulus")
        if re.search(r"\(\?(?:[=!]|<[=!])|\\[1-9]", r.regex):
            raise ValueError("look-around and back-references are not supported")
        try:
            re.compile(r.regex)
        except re.error as e:
            raise ValueError(f"bad pattern {r.regex}: {e}") from e


def anchored(pattern: str) -> str:
    return "(?dU)^(?:" + pattern.replace("(?P<", "(?<") + r")\z"


def _groups(pattern: str) -> tuple[int, dict[str, int]]:
    compiled = re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", pattern))
    return compiled.groups, dict(compiled.groupindex)


def expand(template: str, value: Column, pattern: str) -> Column:
    """The template with the groups of a matched value; unknown groups are empty."""
    count, names = _groups(pattern)
    parts: list[Column] = []
    at = 0
    for m in re.finditer(r"\$(?:(\$)|\{(\w+)\}|(\w+))", template):
        if m.start() > at:
            parts.append(F.lit(template[at : m.start()]))
        at = m.end()
        if m[1]:
            parts.append(F.lit("$"))
            continue
        name = m[2] or m[3]
        group = int(name) if name.isdigit() else names.get(name, -1)
        if 0 <= group <= count:
            parts.append(F.regexp_extract(value, anchored(pattern), group))
    if at < len(template):
        parts.append(F.lit(template[at:]))
    return F.concat(*parts) if parts else F.lit("")


def join_source_labels(labels: Column, names: tuple[str, ...], separator: str = ";") -> Column:
    return F.concat_ws(separator, *[L.get(labels, n) for n in names]) if names else F.lit("")


def relabel_replace(labels: Column, r: Rule) -> Column:
    value = join_source_labels(labels, r.source_labels, r.separator)
    target = expand(r.target_label, value, r.regex) if "$" in r.target_label else F.lit(r.target_label)
    new = expand(r.replacement, value, r.regex)
    changed = F.when(new == "", L.remove_label(labels, target)).otherwise(L.set_label(labels, target, new))
    return F.when(value.rlike(anchored(r.regex)) & target.rlike(_TARGET_NAME), changed).otherwise(labels)


def relabel_labelmap(labels: Column, r: Rule) -> Column:
    """Labels whose name matches are copied to the expanded name, in label order; a later copy of one name wins."""
    hits = F.filter(F.map_entries(labels), lambda e: e["key"].rlike(anchored(r.regex)))
    copies = F.transform(hits, lambda e: F.struct(expand(r.replacement, e["key"], r.regex).alias("key"), e["value"].alias("value")))
    return F.aggregate(copies, labels, lambda m, e: L.set_label(m, e["key"], e["value"]))


def _filter(labels: Column, r: Rule) -> Column | None:
    value = join_source_labels(labels, r.source_labels, r.separator)
    match r.action:
        case "keep":
            return value.rlike(anchored(r.regex))
        case "drop":
            return ~value.rlike(anchored(r.regex))
        case "keepequal":
            return value == L.get(labels, r.target_label)
        case "dropequal":
            return value != L.get(labels, r.target_label)
    return None


def _project(labels: Column, r: Rule) -> Column:
    value = join_source_labels(labels, r.source_labels, r.separator)
    # an empty result is set as well: it lasts to the end of the chain; only replace removes
    put = lambda v: L.set_label(labels, F.lit(r.target_label), v)
    match r.action:
        case "replace":
            return relabel_replace(labels, r)
        case "hashmod":
            return put(L.hash_mod(value, r.modulus).cast("string"))
        case "lowercase":
            return put(F.lower(value))
        case "uppercase":
            return put(F.upper(value))
        case "labelmap":
            return relabel_labelmap(labels, r)
        case "labeldrop":
            return F.map_filter(labels, lambda k, v: ~k.rlike(anchored(r.regex)))
    return F.map_filter(labels, lambda k, v: k.rlike(anchored(r.regex)))


def relabel(df: DataFrame, rules: list[Rule], column: str = "labels", flag: str | None = None) -> DataFrame:
    """Rows that all rules keep, with their new labels; empty labels go at the end of the chain, also of an empty one.

    With ``flag`` no row goes: that column says whether all rules keep it (null labels are not kept)."""
    validate_relabel_rules(rules)
    if flag:
        df = df.withColumn(flag, F.col(column).isNotNull())
    for r in rules:
        kept = _filter(F.col(column), r)
        if kept is None:
            df = df.withColumn(column, _project(F.col(column), r))
        else:
            df = df.withColumn(flag, F.col(flag) & kept) if flag else df.where(kept)
    return df.withColumn(column, L.drop_empty_labels(F.col(column)))
