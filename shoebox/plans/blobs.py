"""Bytes made in the JVM from columns, as hex digits that `data` turns into binary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, however often body mentions it: nested boxes would double the expression at each level."""
    return F.transform(F.array(value), body)[0]


def data(*parts: Column) -> Column:
    return F.unhex(F.concat(*parts))


def u(value, size: int, little: Column | None = None) -> Column:
    """A number as so many bytes, most significant first unless `little` holds."""
    big = F.lpad(F.hex((value if isinstance(value, Column) else F.lit(value)).cast("long")), 2 * size, "0")
    if little is None:
        return big
    return let(big, lambda b: F.when(little, F.concat(*[F.substring(b, 2 * (size - i) - 1, 2) for i in range(size)])).otherwise(b))


def text(value, size: int | None = None) -> Column:
    """A text's bytes; with a size, filled up with zero bytes."""
    digits = F.hex(F.encode(value if isinstance(value, Column) else F.lit(value), "UTF-8"))
    return digits if size is None else F.rpad(digits, 2 * size, "0")


def box(kind: str, *parts: Column, wide: Column | None = None) -> Column:
    """A box of an MP4 file; where `wide` holds, with a size of 64 bits."""
    def made(body: Column) -> Column:
        size = F.length(body) / 2
        short = F.concat(u(size + 8, 4), text(kind), body)
        return short if wide is None else F.when(wide, F.concat(u(1, 4), text(kind), u(size + 16, 8), body)).otherwise(short)

    return let(F.concat(*parts) if parts else F.lit(""), made)
