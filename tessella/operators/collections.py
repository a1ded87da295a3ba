"""Collection operators on DataFrames: an array is a frame with a row index, a set a
frame of distinct rows, a dict a frame with a unique key.

Order is opt-in: ``with_index`` numbers rows once, and only operators that need
order use the number.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import stable

INDEX = "__ix"


def with_index(df: DataFrame, *order: Column | str) -> DataFrame:
    """Number rows 0, 1, .. in the given order without gathering them in one task.

    Rows are range-partitioned by the order, counted per partition, and numbered
    within each; only one count per partition is summed over. Range borders come
    from a sample, so the partitions are computed once and kept.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__ix_part", F.spark_partition_id())
    numbered = stable(ranged.withColumn("__ix_in", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    counts = numbered.groupBy("__ix_part").agg(F.count("*").alias("__ix_n"))
    before = Window.orderBy("__ix_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__ix_part", F.coalesce(F.sum("__ix_n").over(before), F.lit(0)).alias("__ix_start"))
    return numbered.join(starts, "__ix_part").withColumn(INDEX, F.col("__ix_start") + F.col("__ix_in")).drop("__ix_part", "__ix_in", "__ix_start", "__ix_n")


def generate(spark, n: int, *columns: Column) -> DataFrame:
    """A row for each i in 0..n-1; ``columns`` are made of the column i."""
    base = spark.range(max(0, n)).withColumnRenamed("id", "i")
    return base.select(*columns) if columns else base


def map_(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*(c.alias(n) for n, c in columns.items()))


def filter_(df: DataFrame, p: Column) -> DataFrame:
    return df.where(p)


def filter_map(df: DataFrame, value: Column, name: str, *keep: str) -> DataFrame:
    """``value`` of each row, where it is not null, beside the kept columns."""
    return df.select(*keep, value.alias(name)).where(F.col(name).isNotNull())


def first_map(df: DataFrame, value: Column, name: str, order: Sequence[Column | str]) -> DataFrame:
    """The first value that is not null in an order: top-1, not a sort of all rows."""
    return df.select(value.alias(name), *(F.col(o) if isinstance(o, str) else o for o in order)).where(F.col(name).isNotNull()).orderBy(*order).limit(1).select(name)


def flat_map(df: DataFrame, items: Column, name: str, *keep: str) -> DataFrame:
    """A row for each item of an array column; rows with none vanish."""
    return df.select(*keep, F.explode(items).alias(name))


def concat(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def sort(df: DataFrame, *keys: Column | str, index: str | None = None) -> DataFrame:
    """Stable sort: the row index, where there is one, breaks ties."""
    return df.orderBy(*keys, *([index] if index else []))


def slice_(df: DataFrame, start: int, end: int, *order: Column | str) -> DataFrame:
    """Rows start..end-1 of an order, as top-k and offset."""
    return df.orderBy(*order).offset(start).limit(max(0, end - start)) if start else df.orderBy(*order).limit(max(0, end))


def is_sorted(df: DataFrame, key: str, order: str, group: str) -> DataFrame:
    """(group, is_sorted): whether ``key`` never falls along ``order`` within each group."""
    w = Window.partitionBy(group).orderBy(order)
    return df.withColumn("__before", F.lag(key).over(w)).groupBy(group).agg(F.bool_and(F.coalesce(F.col("__before") <= F.col(key), F.lit(True))).alias("is_sorted"))


def find_first(df: DataFrame, p: Column, index: str = INDEX) -> DataFrame:
    """The smallest index of a row for which p holds."""
    return df.agg(F.min(F.when(p, F.col(index))).alias("index"))


def to_set(df: DataFrame, *columns: Column | str) -> DataFrame:
    return df.select(*columns).distinct()


def to_dict(df: DataFrame, key: Column, value: Column, merge: Callable[[Column], Column]) -> DataFrame:
    """(key, value) with one row a key; ``merge`` is an aggregate such as F.sum."""
    return df.groupBy(key.alias("key")).agg(merge(value).alias("value"))


def group_fold(df: DataFrame, keys: Sequence[Column | str], **folds: Column) -> DataFrame:
    """Group by keys and fold each group by built-in aggregates, combined before the shuffle."""
    return df.groupBy(*keys).agg(*(c.alias(n) for n, c in folds.items()))


def ordered_fold(df: DataFrame, key: str, order: str, initial: Column, step: Callable[[Column, Column], Column], name: str) -> DataFrame:
    """A fold that depends on order: each group's rows are gathered in order and folded.

    For groups of bounded size only; a group is one row of memory. ``step`` takes
    (acc, row).
    """
    rest = [c for c in df.columns if c != key]
    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *(c for c in rest if c != order)))).alias("__rows"))
    return rows.select(key, F.aggregate("__rows", initial, step).alias(name))


def reduce(df: DataFrame, **folds: Column) -> DataFrame:
    return df.agg(*(c.alias(n) for n, c in folds.items()))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def sym_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only: one aggregate over both, not two subtractions."""
    both = a.withColumn("__a", F.lit(1)).withColumn("__b", F.lit(0)).union(b.withColumn("__a", F.lit(0)).withColumn("__b", F.lit(1)))
    return both.groupBy(*a.columns).agg(F.max("__a").alias("__a"), F.max("__b").alias("__b")).where("__a <> __b").drop("__a", "__b")


def is_subset(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.distinct(), a.columns, "left_anti").agg((F.count("*") == 0).alias("is_subset"))


def is_disjoint(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, a.columns, "left_semi").agg((F.count("*") == 0).alias("is_disjoint"))
