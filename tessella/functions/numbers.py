"""Integer, float and boolean columns. Integers are 64-bit; overflow is an error."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _fail(text: str, kind: str) -> Column:
    return F.raise_error(F.lit(text)).cast(kind)


# Integers


def add(a: Column, b) -> Column:
    return a + _col(b)


def subtract(a: Column, b) -> Column:
    return a - _col(b)


def multiply(a: Column, b) -> Column:
    return a * _col(b)


def int_divide(a: Column, b) -> Column:
    """Division rounded down (-7 / 2 is -4); a zero divisor is an error."""
    a, b = a.cast("long"), _col(b).cast("long")
    return F.call_function("div", a, b) - F.when((a % b != 0) & ((a < 0) != (b < 0)), F.lit(1)).otherwise(F.lit(0))


def int_remainder(a: Column, b) -> Column:
    """Remainder with the sign of the dividend; a zero divisor is an error."""
    return a.cast("long") % _col(b).cast("long")


def int_pow(a: Column, n) -> Column:
    """a to the n; a negative exponent is an error. Exact up to 2**53."""
    n = _col(n)
    return F.when(n >= 0, F.round(F.pow(a.cast("double"), n.cast("double")))).otherwise(_fail("negative exponent", "double")).cast("long")


def negate(a: Column) -> Column:
    return -a


def absolute(a: Column) -> Column:
    return F.abs(a)


def int_sign(a: Column) -> Column:
    return F.signum(a).cast("long")


def int_log(a: Column, base) -> Column:
    """How often abs(a) can be divided by base before it is below it; 0 for a = 0 or base <= 1."""
    a, base = F.abs(a.cast("long")), _col(base).cast("long")
    # At most 62 divisions; exact, where a quotient of logarithms is not.
    steps = F.aggregate(F.sequence(F.lit(1), F.lit(62)), F.struct(a.alias("x"), F.lit(0).cast("long").alias("n")), lambda s, _: F.when(s["x"] >= base, F.struct(F.floor(s["x"] / F.greatest(base, F.lit(2))).cast("long").alias("x"), (s["n"] + 1).alias("n"))).otherwise(s))
    return F.when((a == 0) | (base <= 1), F.lit(0).cast("long")).otherwise(steps["n"])


def int_to_float(a: Column) -> Column:
    return a.cast("double")


# Floats


def float_divide(a: Column, b) -> Column:
    """a / b; a zero divisor is an error."""
    return a.cast("double") / _col(b).cast("double")


def float_remainder(a: Column, b) -> Column:
    """Truncated remainder with the sign of the dividend; NaN for a zero divisor."""
    a, b = a.cast("double"), _col(b).cast("double")
    return F.when(b == 0, F.lit(math.nan)).otherwise(F.try_mod(a, b))


def float_pow(a: Column, b) -> Column:
    return F.pow(a, _col(b))


def float_sign(a: Column) -> Column:
    """-1, 0 or 1; 0 for NaN."""
    return F.when(F.isnan(a), F.lit(0.0)).otherwise(F.signum(a))


def float_sqrt(a: Column) -> Column:
    """Square root; a negative number is an error."""
    return F.when(a < 0, _fail("square root of a negative number", "double")).otherwise(F.sqrt(a))


def float_log(a: Column) -> Column:
    """Natural logarithm; zero and less is an error."""
    return F.when(a <= 0, _fail("logarithm of zero or less", "double")).otherwise(F.ln(a))


def float_exp(a: Column) -> Column:
    """Exponential; a result beyond the doubles is an error."""
    return F.when((F.exp(a) == float("inf")) & (a != float("inf")), _fail("exponential out of range", "double")).otherwise(F.exp(a))


def sin(a: Column) -> Column:
    return F.sin(a)


def cos(a: Column) -> Column:
    return F.cos(a)


def tan(a: Column) -> Column:
    return F.tan(a)


def float_to_int(a: Column) -> Column:
    """Truncated; NaN, infinities and numbers beyond 64 bits are an error."""
    return a.cast("double").cast("long")


# Booleans


def and_(a: Column, b: Column) -> Column:
    return a & b


def or_(a: Column, b: Column) -> Column:
    return a | b


def not_(a: Column) -> Column:
    return ~a


def xor(a: Column, b: Column) -> Column:
    return a != b
