"""Distances of two array columns, in double precision.

Arrays of different lengths raise, and so do empty ones where a distance of nothing has no meaning. A null array, or a null
in one, gives null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least probability in the divergences' logarithms.
FLOOR = 1e-10


def doubles(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def summed(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def over_pairs(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    return summed(F.zip_with(doubles(a), doubles(b), f))


def checked(a: Column, b: Column, value: Column, empty: Column | None = None) -> Column:
    """``value`` where lengths agree; ``empty`` for two empty arrays, which else raise."""
    nothing = F.raise_error(F.lit("distance of empty arrays")).cast("double") if empty is None else empty
    unequal = F.raise_error(F.concat(F.lit("arrays of lengths "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string"))).cast("double")
    known = a.isNotNull() & b.isNotNull()
    return F.when(known & (F.size(a) != F.size(b)), unequal).when(known & (F.size(a) == 0), nothing).when(known, value)


def l1(a: Column, b: Column) -> Column:
    return checked(a, b, over_pairs(a, b, lambda x, y: F.abs(x - y)))


def l2(a: Column, b: Column) -> Column:
    return checked(a, b, F.sqrt(over_pairs(a, b, lambda x, y: (x - y) * (x - y))))


def dot(a: Column, b: Column) -> Column:
    """max(0, 1 - a.b)."""
    return checked(a, b, F.greatest(F.lit(0.0), 1 - over_pairs(a, b, lambda x, y: x * y)))


def cosine(a: Column, b: Column) -> Column:
    """1 - cos; 1 where a vector is zero."""
    norms = over_pairs(a, a, lambda x, y: x * y) * over_pairs(b, b, lambda x, y: x * y)
    return checked(a, b, F.when(norms == 0, 1.0).otherwise(1 - over_pairs(a, b, lambda x, y: x * y) / F.sqrt(F.nullif(norms, F.lit(0.0)))))


def hamming(a: Column, b: Column) -> Column:
    """Share of places that differ."""
    differ = F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda x: x))
    return checked(a, b, differ.cast("double") / F.nullif(F.size(a), F.lit(0)))


def hellinger(a: Column, b: Column) -> Column:
    return checked(a, b, F.sqrt(over_pairs(a, b, lambda x, y: F.pow(F.sqrt(x) - F.sqrt(y), F.lit(2.0))) / 2))


def floored(x: Column) -> Column:
    return F.greatest(x, F.lit(FLOOR))


def jeffreys(a: Column, b: Column) -> Column:
    return checked(a, b, over_pairs(a, b, lambda x, y: (floored(x) - floored(y)) * (F.ln(floored(x)) - F.ln(floored(y)))))


def jensen_shannon(a: Column, b: Column) -> Column:
    def one(x: Column, y: Column) -> Column:
        p, q = floored(x), floored(y)
        m = F.ln((p + q) / 2)
        return (p * (F.ln(p) - m) + q * (F.ln(q) - m)) / 2

    return checked(a, b, F.sqrt(F.greatest(F.lit(0.0), over_pairs(a, b, one))))


def jaccard(a: Column, b: Column) -> Column:
    """Weighted: 1 - sum of minima / sum of maxima; 0 for empty or all-zero arrays."""
    most = over_pairs(a, b, lambda x, y: F.greatest(x, y))
    return checked(a, b, F.when(most == 0, 0.0).otherwise(1 - over_pairs(a, b, lambda x, y: F.least(x, y)) / F.nullif(most, F.lit(0.0))), F.lit(0.0))


def levenshtein(a: Column, b: Column) -> Column:
    """Edit distance of two arrays of 16-bit units, of any lengths.

    Units become characters one to one, those of the surrogate range moved to another plane, so that the built-in edit
    distance of strings applies.
    """

    def text(units: Column) -> Column:
        code = F.transform(units, lambda x: F.lpad(F.hex(F.when(x >= 0xD800, x + 0x10000).otherwise(x).cast("bigint")), 8, "0"))
        return F.decode(F.unhex(F.array_join(code, "")), "UTF-32")

    return F.levenshtein(text(a), text(b)).cast("double")
