"""Durations and sizes as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DURATION = r"\A(?:([0-9]+)y)?(?:([0-9]+)w)?(?:([0-9]+)d)?(?:([0-9]+)h)?(?:([0-9]+)m)?(?:([0-9]+)s)?(?:([0-9]+)ms)?\z"
_MS = (31_536_000_000, 604_800_000, 86_400_000, 3_600_000, 60_000, 1_000, 1)
_NUMBER = r"(?:[0-9]+\.?[0-9]*|\.[0-9]+)"
_SIZE = rf"\A(?:{_NUMBER}(?:B|[KMGTPE]i?B))+\z"
#: Unicode white space.
_BLANK = r"[\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
_POWER = {"": 0, "K": 1, "M": 2, "G": 3, "T": 4, "P": 5, "E": 6}
_MAX_BYTES = str(2**64 - 1)


def parse_duration_ms(text: Column) -> Column:
    """``1h30m`` and the like (each unit once, in descending order) as milliseconds; "0" is 0, malformed or too long is null."""
    total = F.lit(0).cast("bigint")
    for i, ms in enumerate(_MS, 1):
        digits = F.regexp_extract(text, _DURATION, i)
        n = F.when(digits == "", F.lit(0).cast("bigint")).otherwise(digits.try_cast("bigint"))
        total = F.try_add(total, F.try_multiply(n, F.lit(ms).cast("bigint")))
    return F.when(text == "0", F.lit(0).cast("bigint")).when((text != "") & text.rlike(_DURATION), total)


def parse_size_bytes(text: Column) -> Column:
    """``1.5MiB``, ``.5KB``, ``1.MiB``, ``1MiB512KiB``, ``1048576`` as bytes, 1024-based, blanks around left out; each part's
    fraction is cut to whole bytes (digits after the 19th do not count).  Malformed or above 2^64 - 1 is null."""
    text = F.regexp_replace(text, rf"\A{_BLANK}+|{_BLANK}+\z", "")
    numbers, units = (F.regexp_extract_all(text, F.lit(rf"({_NUMBER})([KMGTPE]?)i?B"), F.lit(i)) for i in (1, 2))
    scale = F.create_map(*[x for k, p in _POWER.items() for x in (F.lit(k), F.lit(1024**p).cast("decimal(19,0)"))])
    digits = lambda d: F.when(d.rlike(r"\A0*[0-9]{0,20}\z"), F.concat(F.lit("0"), F.regexp_extract(d, r"\A0*([0-9]{0,20})\z", 1)).cast("decimal(20,0)"))

    def size(n: Column, u: Column) -> Column:
        by = F.element_at(scale, u)
        whole = F.try_multiply(digits(F.regexp_extract(n, r"\A([0-9]*)", 1)), by).try_cast("decimal(38,0)")
        fraction = F.rpad(F.left(F.regexp_extract(n, r"\.([0-9]*)", 1), F.lit(19)), 19, "0").cast("decimal(19,0)")
        part = F.call_function("div", fraction * by, F.lit("1" + "0" * 19).cast("decimal(20,0)"))
        return F.try_add(whole, part.cast("decimal(38,0)")).try_cast("decimal(38,0)")

    total = F.aggregate(F.zip_with(numbers, units, size), F.lit(0).cast("decimal(38,0)"), lambda a, x: F.try_add(a, x).try_cast("decimal(38,0)"))
    total = F.when(text.rlike(r"\A[0-9]+\z"), digits(text).cast("decimal(38,0)")).when(text.rlike(_SIZE), total)
    return F.when(total <= F.lit(_MAX_BYTES).cast("decimal(38,0)"), total)
