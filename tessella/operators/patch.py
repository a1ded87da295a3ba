"""Structural differences of keyed frames: diff, apply, compose, invert.

A patch has the key columns, ``before`` and ``after`` (structs of the other columns,
null where the row isn't there) and ``change``: insert, delete or update.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _rows(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    return df.select(*keys, F.struct(*(c for c in df.columns if c not in keys)).alias(name))


def _labelled(df: DataFrame, keys: list[str]) -> DataFrame:
    change = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").otherwise("update")
    return df.where(~F.col("before").eqNullSafe(F.col("after"))).select(*keys, change.alias("change"), "before", "after")


def diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """What turns old into new; keys that don't change have no row."""
    both = _rows(old, keys, "before").join(_rows(new, keys, "after"), keys, "full")
    return _labelled(both, keys)


def apply(df: DataFrame, patch: DataFrame, keys: list[str]) -> DataFrame:
    """The frame after a patch; a row that isn't as the patch says it was is an error."""
    now = _rows(df, keys, "now").withColumn("__there", F.lit(True))
    change = patch.select(*keys, "before", "after", F.lit(True).alias("__patched"))
    both = now.join(change, keys, "full")
    fits = F.col("now").eqNullSafe(F.col("before"))
    checked = F.when(F.col("__patched").isNull(), F.col("now")).when(fits, F.col("after")).otherwise(F.when(F.raise_error(F.lit("conflict: a row is not as the patch expects")).cast("boolean"), F.col("now")))
    return both.select(*keys, checked.alias("__row")).where("__row is not null").select(*keys, "__row.*")


def invert(patch: DataFrame, keys: list[str]) -> DataFrame:
    """The patch that takes it back."""
    return _labelled(patch.select(*keys, F.col("after").alias("before"), F.col("before").alias("after")), keys)


def compose(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """One patch that does both; what the second undoes vanishes."""
    a = first.select(*keys, F.col("before").alias("b1"), F.col("after").alias("a1"), F.lit(True).alias("__1"))
    b = second.select(*keys, F.col("before").alias("b2"), F.col("after").alias("a2"), F.lit(True).alias("__2"))
    both = a.join(b, keys, "full")
    meets = F.col("__1").isNotNull() & F.col("__2").isNotNull()
    checked = F.when(meets & ~F.col("a1").eqNullSafe(F.col("b2")), F.raise_error(F.lit("conflict: the second patch does not follow the first")).cast("boolean")).otherwise(F.lit(True))
    before = F.when(checked, F.when(F.col("__1").isNotNull(), F.col("b1")).otherwise(F.col("b2")))
    after = F.when(F.col("__2").isNotNull(), F.col("a2")).otherwise(F.col("a1"))
    return _labelled(both.select(*keys, before.alias("before"), after.alias("after")), keys)


def common_subsequence(a, b):
    """Per row, a longest common subsequence of two array columns, as a SQL expression of built-ins.

    Quadratic in the arrays' lengths, as the problem is; for arrays of bounded size.
    """
    zero = F.array_repeat(F.struct(F.lit(0).alias("n"), F.slice(a, 1, 0).alias("s")), F.size(b) + 1)

    def row(above, x):
        def cell(acc, j):
            left, up, diagonal = F.element_at(acc, -1), F.get(above, j + 1), F.get(above, j)
            longer = F.struct((diagonal["n"] + 1).alias("n"), F.array_append(diagonal["s"], x).alias("s"))
            return F.array_append(acc, F.when(x.eqNullSafe(F.get(b, j)), longer).when(left["n"] >= up["n"], left).otherwise(up))

        steps = F.filter(F.sequence(F.lit(0), F.size(b)), lambda j: j < F.size(b))
        return F.aggregate(steps, F.slice(zero, 1, 1), cell)

    return F.element_at(F.aggregate(a, zero, row), -1)["s"]
