"""Perceptual hashes of pixel arrays as column expressions: no Python process sees a pixel.

Pixels are array columns of numbers in rows from the top. An array that is null, holds nulls or has another length gives null.
The Arrow forms in kernels.py take bytes and give the same hashes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the hashes: side of the gray square, side of the block of low terms, size of the gradient grid.
SIDE, LOW, GRADIENT = 32, 8, (9, 8)


def _once(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _basis() -> Column:
    """The first rows of the cosine transform, as literals."""
    return F.array(*[F.array(*[F.lit(math.cos(math.pi / SIDE * (n + 0.5) * k)) for n in range(SIDE)]) for k in range(LOW)])


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _checked(pixels: Column, size: int, body) -> Column:
    """body of the pixels as doubles, if there are so many and none is null."""
    whole = (F.size(pixels) == size) & ~F.exists(pixels, lambda p: p.isNull())
    return F.when(whole, _once(F.transform(pixels, lambda p: p.cast("double")), body))


def _hex(bits: Column) -> Column:
    """64 conditions, the first the highest bit, as 16 hex digits."""
    packed = F.aggregate(bits, F.lit(0).cast("long"), lambda s, b: F.shiftleft(s, 1).bitwiseOR(b.cast("long")))
    return F.lpad(F.lower(F.hex(packed)), 16, "0")


def cosine_terms(pixels: Column) -> Column:
    """The 64 low terms of the two-dimensional cosine transform of 32 x 32 pixels, row by row: basis x pixels x basis transposed."""
    slices = lambda p: F.transform(F.sequence(F.lit(0), F.lit(SIDE - 1)), lambda y: F.slice(p, y * SIDE + 1, SIDE))

    def product(p: Column) -> Column:
        across = F.transform(slices(p), lambda row: F.transform(_basis(), lambda b: _dot(row, b)))  # 32 rows of 8
        columns = _once(across, lambda rows: F.transform(F.sequence(F.lit(0), F.lit(LOW - 1)), lambda k: F.transform(rows, lambda r: r[k])))
        return _once(columns, lambda cols: F.flatten(F.transform(_basis(), lambda b: F.transform(cols, lambda c: _dot(c, b)))))

    return _checked(pixels, SIDE * SIDE, product)


def median(values: Column) -> Column:
    """The middle of an array, or the mean of its two middle values, by sorting it in the row."""
    at = lambda s, k: F.get(s, k.cast("int"))
    return _once(F.sort_array(values), lambda s: (at(s, F.floor((F.size(s) - 1) / 2)) + at(s, F.floor(F.size(s) / 2))) / 2)


def phash(pixels: Column) -> Column:
    """16 hex digits of 32 x 32 gray pixels: which low cosine terms lie above their median."""
    return _once(cosine_terms(pixels), lambda t: F.when(t.isNotNull(), _hex(_once(median(t), lambda m: F.transform(t, lambda v: v > m)))))


def dhash(pixels: Column) -> Column:
    """16 hex digits of 9 x 8 gray pixels: which are brighter than the next in their row."""
    w, h = GRADIENT
    places = F.array(*[F.lit(y * w + x) for y in range(h) for x in range(w - 1)])
    return _checked(pixels, w * h, lambda p: _hex(F.transform(places, lambda i: F.get(p, i) > F.get(p, i + 1))))
