"""Equality and order over all values.

NaN equals NaN and is last; arrays and structs are compared item by item, a shorter
beginning first. ``strict`` tells -0.0 from 0.0 as well, which Spark's own equality
does not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict(x: Column) -> Column:
    """A key of a double that sorts and groups -0.0 before and apart from 0.0."""
    return F.struct(x.alias("x"), (~((x == 0) & (F.lit(1.0).cast("double") / F.when(x == 0, F.lit(1.0)).otherwise(x) > 0) & (x.cast("string") == "-0.0"))).alias("plus"))


def is_(a: Column, b: Column) -> Column:
    """Sameness of values; there is no identity beyond equality among columns."""
    return a.eqNullSafe(b)


def equal(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def not_equal(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def less(a: Column, b: Column) -> Column:
    return a < b


def less_equal(a: Column, b: Column) -> Column:
    return a <= b


def greater(a: Column, b: Column) -> Column:
    return a > b


def greater_equal(a: Column, b: Column) -> Column:
    return a >= b
