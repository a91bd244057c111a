"""Numbers as text, by Arrow-batched Python: the JVM's own digits are not always the shortest."""

from __future__ import annotations

from decimal import Decimal
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def bound_text(value: float) -> str:
    """Shortest digits, an exponent of two digits at least below 1e-4 and from 1e6 on, ``.0`` on whole numbers."""
    return _bound(repr(float(value)))  # the text tells 0.0 from -0.0


@lru_cache(maxsize=65_536)
def _bound(shortest: str) -> str:
    value = float(shortest)
    if value != value:
        return "NaN"
    if value in (float("inf"), float("-inf")):
        return "+Inf" if value > 0 else "-Inf"
    sign, digits, place = Decimal(shortest).as_tuple()
    head = "-" if sign else ""
    text = "".join(map(str, digits)).rstrip("0")
    if not text:
        return head + "0.0"
    power = len(digits) + place - 1
    if -4 <= power < 6:
        plain = format(Decimal((0, tuple(map(int, text)), power - len(text) + 1)), "f")
        return head + (plain if "." in plain else plain + ".0")
    rest = "." + text[1:] if len(text) > 1 else ""
    return f"{head}{text[0]}{rest}e{'-' if power < 0 else '+'}{abs(power):02d}"


def plain_text(value: float) -> str:
    """Shortest digits without exponent; whole numbers without a point."""
    if value != value or value in (float("inf"), float("-inf")):
        return bound_text(value)
    text = format(Decimal(repr(value)), "f")
    return text.rstrip("0").rstrip(".") if "." in text else text


def format_bound(value: Column) -> Column:
    """The text of an ``le`` or ``quantile`` bound."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.astype(object).map(lambda v: None if v is None else bound_text(float(v)))

    # nulls would reach pandas as NaN
    return F.when(value.isNotNull(), run(value))


def format_number(value: Column) -> Column:
    """The text of a sample value."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(plain_text)

    return F.when(value.isNotNull(), run(value))
