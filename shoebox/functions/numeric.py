"""Number helpers as column expressions, with the rounding and clamping rules of the data model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """True for numbers that are neither null, NaN nor infinite."""
    x = x.cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def clamp01(x: Column) -> Column:
    """x held within 0 and 1; 0 for what is not finite."""
    return F.when(finite(x), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x.cast("double")))).otherwise(F.lit(0.0))


def round_to(x: Column, digits: int) -> Column:
    """Rounding with ties toward positive infinity on the binary value (unlike `round`)."""
    f = F.lit(float(10**digits))
    return F.when(finite(x), F.floor(x.cast("double") * f + 0.5) / f).otherwise(x.cast("double"))


def leading_number(text: Column) -> Column:
    """The number that a text begins with ('12.5 fps' is 12.5), else null."""
    return F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")


def rational(text: Column) -> Column:
    """'a/b' as a / b; null unless both are numbers and b is not 0."""
    a, b = leading_number(F.split_part(text, F.lit("/"), F.lit(1))), leading_number(F.split_part(text, F.lit("/"), F.lit(2)))
    return F.when(b != 0, a / b)


def backoff_ms(retries: Column, base: int = 1000, most: int = 60_000) -> Column:
    """Delay before the next try: base * 2 ** retries, at most `most`."""
    return F.least(F.lit(float(base)) * F.pow(F.lit(2.0), retries), F.lit(float(most))).cast("long")
