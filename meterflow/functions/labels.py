"""Column functions on label maps (``MAP<STRING, STRING>`` in text order) and canonical label arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTRY = "array<struct<key:string,value:string>>"


def each(df: DataFrame, array: Column, name: str) -> DataFrame:
    """``df`` with a row for each non-null element of an array that is dear to compute.

    A plain explode lets the optimizer add a filter on the array's size, which computes it a second time."""
    return df.withColumn(name, F.explode_outer(array)).where(F.col(name).isNotNull())


def from_entries(entries: Column) -> Column:
    return F.map_from_entries(entries)


def sort_labels(labels: Column) -> Column:
    """The canonical form: array<struct<name, value>> in order of names."""
    return F.transform(F.sort_array(F.map_entries(labels)), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))


def drop_empty_labels(labels: Column) -> Column:
    return F.map_filter(labels, lambda k, v: v != "")


def get(labels: Column, name: str | Column) -> Column:
    """The value of a label, '' if missing."""
    return F.coalesce(F.try_element_at(labels, F.lit(name) if isinstance(name, str) else name), F.lit(""))


def set_label(labels: Column, name: Column, value: Column) -> Column:
    """Set in place (a label keeps its position), or append."""
    here = F.map_contains_key(labels, name)
    return F.when(here, F.transform_values(labels, lambda k, v: F.when(k == name, value).otherwise(v))).otherwise(F.map_concat(labels, F.create_map(name, value)))


def remove_label(labels: Column, name: Column) -> Column:
    return F.map_filter(labels, lambda k, v: k != name)


def add_absent(labels: Column, more: Column) -> Column:
    """Labels of ``more`` that are not there yet, appended (presence counts, not emptiness; label values are never null)."""
    return F.map_zip_with(labels, more, lambda k, own, other: F.coalesce(own, other))  # by a hash table, not pair by pair


def overlaid(labels: Column, more: Column) -> Column:
    """Labels with those of ``more``, which win."""
    return F.map_zip_with(labels, more, lambda k, own, other: F.coalesce(other, own))


add_external_labels = add_absent


def merge_target_labels(labels: Column, target: Column, honor: Column) -> Column:
    """honor: scraped labels win; else target labels win and a scraped value moves to ``exported_<name>``.

    Target labels are taken one after the other in order of their names, each on what the one before left: an exported name
    may be a target label itself, and then counts as scraped when that label's turn comes."""

    def put(m: Column, e: Column) -> Column:
        before = F.try_element_at(m, e["key"])
        moved = F.concat(F.lit("exported_"), e["key"])
        return F.when(F.map_contains_key(m, e["key"]), set_label(set_label(m, e["key"], e["value"]), moved, before)).otherwise(F.map_concat(m, F.create_map(e["key"], e["value"])))

    # no label is looked at twice: one pass does where no target label clashes, and none has an exported name
    entries = F.sort_array(F.map_entries(target))
    apart = ~F.exists(entries, lambda e: F.map_contains_key(labels, e["key"]) | e["key"].startswith("exported_"))
    folded = F.when(apart, F.map_concat(labels, target)).otherwise(F.aggregate(entries, labels, put))
    return F.when(honor, add_absent(labels, target)).otherwise(folded)


def sanitize_label_name(name: Column) -> Column:
    return F.regexp_replace(name, "[^a-zA-Z0-9_]", "_")


def hash_mod(value: Column, modulus: int) -> Column:
    """The last 8 bytes of the MD5 digest, big-endian and unsigned, modulo ``modulus``."""
    number = F.conv(F.substring(F.md5(value), 17, 16), 16, 10).cast("decimal(20,0)")
    return (number % F.lit(modulus).cast("decimal(20,0)")).cast("bigint")
