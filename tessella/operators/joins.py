"""Keyed lookups and merges. Catalyst picks the join; nothing is hinted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup(df: DataFrame, table: DataFrame, on: str, default: dict[str, object] | None = None) -> DataFrame:
    """Left outer lookup in a keyed frame, with defaults for the columns of a missing key."""
    out = df.join(table, on, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in (default or {}).items()})


def inner(df: DataFrame, table: DataFrame, on: str) -> DataFrame:
    return df.join(table, on)


def semi(df: DataFrame, table: DataFrame, on: str) -> DataFrame:
    return df.join(table, on, "left_semi")


def anti(df: DataFrame, table: DataFrame, on: str) -> DataFrame:
    return df.join(table, on, "left_anti")


def merge_dicts(a: DataFrame, b: DataFrame, key: str, value: str, merge: Callable[[Column, Column], Column]) -> DataFrame:
    """All keys of both; ``merge(of a, of b)`` where both have one."""
    x, y = a.select(key, F.col(value).alias("__a"), F.lit(True).alias("__in_a")), b.select(key, F.col(value).alias("__b"), F.lit(True).alias("__in_b"))
    both = x.join(y, key, "full")
    merged = F.when(F.col("__in_a") & F.col("__in_b"), merge(F.col("__a"), F.col("__b"))).when(F.col("__in_a"), F.col("__a")).otherwise(F.col("__b"))
    return both.select(key, merged.alias(value))


def merge_all(a: DataFrame, b: DataFrame, key: str, value: str, merge: Callable[[Column, Column], Column], default: Callable[[Column], Column]) -> DataFrame:
    """As merge_dicts, but a key that only b has gets ``merge(default(key), of b)``."""
    x, y = a.select(key, F.col(value).alias("__a"), F.lit(True).alias("__in_a")), b.select(key, F.col(value).alias("__b"), F.lit(True).alias("__in_b"))
    both = x.join(y, key, "full")
    old = F.when(F.col("__in_a"), F.col("__a")).otherwise(default(F.col(key)))
    return both.select(key, F.when(F.col("__in_b"), merge(old, F.col("__b"))).otherwise(F.col("__a")).alias(value))


def gather(df: DataFrame, positions: DataFrame, index: str, default: dict[str, object] | None = None) -> DataFrame:
    """Rows at the given positions, with defaults where there is none."""
    return lookup(positions, df, index, default)


def as_of(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """For each left row the values of the last right row of the same key at or before its time.

    Both sides are laid in one time line per key and the last values carried
    forward: one shuffle and one sort, where a range join would compare pairs.
    Of right rows at one time, the largest (by the values' order) counts.
    """
    payload = F.struct(*values)
    lines = left.withColumn("__time", F.col(left_time)).withColumn("__side", F.lit(1)).withColumn("__value", F.lit(None).cast(right.select(payload.alias("v")).schema["v"].dataType))
    marks = right.select(F.col(by), F.col(right_time).alias("__time"), F.lit(0).alias("__side"), payload.alias("__value"))
    both = lines.unionByName(marks, allowMissingColumns=True)
    carry = Window.partitionBy(by).orderBy("__time", "__side", F.col("__value")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = both.withColumn("__held", F.last("__value", ignorenulls=True).over(carry)).where("__side = 1")
    return held.select(*left.columns, *(F.col(f"__held.{v}").alias(v) for v in values))


def band_join(left: DataFrame, right: DataFrame, left_value: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs with low <= left_value < high, by equi-join on bins of ``width``.

    A right row stands in each bin that its interval touches, so ``width`` should be
    about as wide as the intervals.
    """
    bins = F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))
    spread = right.where(F.col(low) < F.col(high)).withColumn("__bin", F.explode(bins))
    return left.withColumn("__bin", F.floor(F.col(left_value) / width)).join(spread, "__bin").where((F.col(left_value) >= F.col(low)) & (F.col(left_value) < F.col(high))).drop("__bin")
