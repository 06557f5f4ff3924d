"""Numeric column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# What integer and decimal text looks like. Checking first keeps failing casts,
# which are slow, out of the common path.
INT_TEXT = r"^\s*[+-]?[0-9]+\s*$"
FLOAT_TEXT = r"(?i)^\s*[+-]?(?:(?:[0-9]++\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|inf|infinity|nan)\s*$"


def int_text(text: Column) -> Column:
    """Integer text as BIGINT, anything else NULL."""
    return F.when(text.rlike(INT_TEXT), text.try_cast("bigint"))


def float_text(text: Column) -> Column:
    """Number text as DOUBLE, anything else NULL."""
    return F.when(text.rlike(FLOAT_TEXT), text.try_cast("double"))


def fixed_text(x: Column, places: int = 2) -> Column:
    """Fixed-point text without grouping."""
    return F.call_function("format_number", x, F.lit("0." + "0" * places))


def fixed(x: Column, places: int = 2) -> Column:
    """`x` rounded the way fixed-point text formatting rounds it.

    Formatting looks at the exact binary value (1.005 gives 1.00, 0.125 gives
    0.12) where `round` works on the shortest decimal text. Only values close
    to a tie need the slow formatting path; the rest is plain arithmetic.
    """
    scale = 10**places
    y = x * F.lit(float(scale))
    near_tie = F.abs(y - F.floor(y) - F.lit(0.5)) <= F.lit(1e-3)
    exact = fixed_text(x, places).cast("double") + F.lit(0.0)
    quick = F.floor(y + F.lit(0.5)) / F.lit(float(scale))
    return (
        F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), x)
        .when((F.abs(y) >= F.lit(1e12)) | near_tie, exact)
        .otherwise(quick)
    )


def as_int(raw: Column, kind: Column | None = None, value: Column | None = None) -> Column:
    """Integer reading of a sample: text must be an integer, a float is truncated."""
    text = int_text(raw)
    if kind is None or value is None:
        return text
    return F.when(kind == "float", value.try_cast("bigint")).otherwise(text)


def ratio(num: Column, den: Column) -> Column:
    """num / den as double, NULL when den is 0."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def percent_of(num: Column, den: Column) -> Column:
    """num * 100 / den; NULL when either is 0."""
    return F.when((num != 0) & (den != 0), ratio(num * 100, den))


def percent_rest(avail: Column, total: Column) -> Column:
    """100 - avail * 100 / total."""
    return F.lit(100.0) - ratio(avail * 100, total)


def percent_share(used: Column, free: Column) -> Column:
    """used / (used + free) * 100."""
    return ratio(used, used + free) * 100


def post_rate(rate: Column, how: str) -> Column:
    """Rate post-processing: `int` truncates, `tenth` divides by ten to 2 places,
    `non_negative` turns a negative rate into NULL."""
    if how == "int":
        return rate.cast("bigint")
    if how == "tenth":
        return fixed(rate / 10)
    if how == "non_negative":
        return F.when(rate >= 0, rate)
    raise ValueError(f"unknown rate post-processing {how!r}")
