"""Element-wise arithmetic, comparison and mathematics on doubles, as IEEE 754 has them.

Spark raises on division by zero, gives null for logarithms of what isn't positive, and holds NaN equal to itself and
greater than all else; these functions don't. Null in, null out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")
UINT32 = 4294967295


def known(*columns: Column) -> Column:
    out = columns[0].isNotNull()
    for c in columns[1:]:
        out = out & c.isNotNull()
    return out


def add(a: Column, b: Column) -> Column:
    return a + b


def subtract(a: Column, b: Column) -> Column:
    return a - b


def multiply(a: Column, b: Column) -> Column:
    return a * b


def divide(a: Column, b: Column) -> Column:
    """By zero: NaN for 0 and NaN, else an infinity with the sign of both operands' signs."""
    below = b.cast("string") == "-0.0"
    by_zero = F.when((a == 0) | F.isnan(a), NAN).when((a > 0) != below, INF).otherwise(-INF)
    return F.when(known(a, b), F.when(b == 0, by_zero).otherwise(a / F.when(b != 0, b)))


def modulo(a: Column, b: Column) -> Column:
    """The remainder with the dividend's sign; NaN for a zero divisor."""
    return F.when(known(a, b), F.when(b == 0, NAN).otherwise(a % F.when(b != 0, b)))


def power(a: Column, b: Column) -> Column:
    return F.pow(a, b)


def mask(test: Column, *of: Column) -> Column:
    return F.when(known(*of), test.cast("double"))


def equal(a: Column, b: Column) -> Column:
    return mask((a == b) & ~F.isnan(a), a, b)


def not_equal(a: Column, b: Column) -> Column:
    return mask((a != b) | F.isnan(a), a, b)


def greater_than(a: Column, b: Column) -> Column:
    return mask((a > b) & ~F.isnan(a), a, b)


def less_than(a: Column, b: Column) -> Column:
    return mask((a < b) & ~F.isnan(b), a, b)


def greater_equal(a: Column, b: Column) -> Column:
    return mask((a >= b) & ~F.isnan(a) & ~F.isnan(b), a, b)


def less_equal(a: Column, b: Column) -> Column:
    return mask((a <= b) & ~F.isnan(a) & ~F.isnan(b), a, b)


def is_nan(v: Column) -> Column:
    return mask(F.isnan(v), v)


def logarithm(v: Column, f) -> Column:
    return F.when(v > 0, f(v)).when(v == 0, -INF).when(v.isNotNull(), NAN)


def log(v: Column) -> Column:
    return logarithm(v, F.ln)


def log2(v: Column) -> Column:
    return logarithm(v, F.log2)


def log10(v: Column) -> Column:
    return logarithm(v, F.log10)


def whole(v: Column, f) -> Column:
    """Rounding in doubles: beyond 2^52, and for what isn't finite, a value is its own."""
    return F.when((F.abs(v) < 4503599627370496.0), f(v).cast("double")).otherwise(v)


def floor(v: Column) -> Column:
    return whole(v, F.floor)


def ceil(v: Column) -> Column:
    return whole(v, F.ceil)


def round_half_away(v: Column) -> Column:
    return whole(v, lambda x: F.signum(x) * F.floor(F.abs(x) + 0.5))


def sgn(v: Column) -> Column:
    return F.signum(v) + F.lit(0.0)


def clamp(v: Column, lo: float, hi: float) -> Column:
    return F.when(F.isnan(v), v).otherwise(F.least(F.greatest(v, F.lit(lo)), F.lit(hi)))


def clamp_min(v: Column, lo: float) -> Column:
    return F.when(F.isnan(v), v).otherwise(F.greatest(v, F.lit(lo)))


def clamp_max(v: Column, hi: float) -> Column:
    return F.when(F.isnan(v), v).otherwise(F.least(v, F.lit(hi)))


#: Functions of one double that Spark has with the same meaning.
SAME = {"abs": F.abs, "neg": F.negative, "sqrt": F.sqrt, "sin": F.sin, "cos": F.cos, "tan": F.tan, "exp": F.exp, "acosh": F.acosh, "asinh": F.asinh, "atanh": F.atanh, "acos": F.acos, "asin": F.asin, "atan": F.atan, "cosh": F.cosh, "sinh": F.sinh, "tanh": F.tanh, "deg": F.degrees, "rad": F.radians}
OWN = {"log": log, "log2": log2, "log10": log10, "floor": floor, "ceil": ceil, "round": round_half_away, "sgn": sgn}


def subtract_saturating(v: Column, s: int) -> Column:
    return F.greatest(v - s, F.lit(0))


def quantize(v: Column, lo: float, scale: float, hi: float) -> Column:
    """trunc((v - lo) / scale * hi), kept within 0 and hi; NaN gives 0."""
    return F.when(F.isnan(v), 0).otherwise(F.least(F.greatest((v - lo) / scale * hi, F.lit(0.0)), F.lit(hi)).cast("bigint"))


def fma(a: Column, b: Column, c: Column) -> Column:
    return a * b + c


def interpolate(lo: Column, hi: Column, w: Column) -> Column:
    return lo + w * (hi - lo)


def to_u32(n: Column) -> Column:
    return F.least(F.greatest(n, F.lit(0)), F.lit(UINT32)).cast("bigint")
