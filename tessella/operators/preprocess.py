"""Scalers, encoders, class weights, splits. A fitted state is a small frame, not a pickle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.statistics import exact_quantiles


def _fit(df: DataFrame, columns: Sequence[str], centre, scale) -> DataFrame:
    total = df.agg(*(f(F.col(c)).alias(f"{c}__{k}") for c in columns for k, f in (("centre", centre), ("scale", scale))))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"{c}__centre").cast("double").alias("centre"), F.col(f"{c}__scale").cast("double").alias("scale")) for c in columns))
    return total.select(F.inline(rows))


def standard_scaler(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, centre, scale: mean and population standard deviation."""
    return _fit(df, columns, F.avg, F.stddev_pop)


def min_max_scaler(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _fit(df, columns, F.min, lambda c: F.max(c) - F.min(c))


def robust_scaler(df: DataFrame, columns: Sequence[str], accuracy: int | None = None) -> DataFrame:
    """Median and interquartile range, exact; ``accuracy`` asks for mergeable sketches instead."""
    if accuracy:
        q = lambda c, p: F.percentile_approx(c, p, accuracy)
        return _fit(df, columns, lambda c: q(c, 0.5), lambda c: q(c, 0.75) - q(c, 0.25))
    rows = []
    for c in columns:
        median, q1, q3 = exact_quantiles(df, c, [0.5, 0.25, 0.75])
        rows.append((c, median, None if q1 is None else q3 - q1))
    return df.sparkSession.createDataFrame(rows, "column string, centre double, scale double")


def scale(df: DataFrame, fitted: DataFrame) -> DataFrame:
    """(x - centre) / scale; a column that doesn't vary is only centred.

    The state has one row per column, bounded by the schema, and becomes literals.
    """
    state = {r["column"]: (r["centre"], r["scale"] or 1.0) for r in fitted.collect()}
    return df.withColumns({c: (F.col(c) - m) / s for c, (m, s) in state.items()})


def label_encoder(df: DataFrame, column: str) -> DataFrame:
    """value, code: sorted distinct values numbered from 0. One row a category."""
    from tessella.operators.collections import with_index

    values = df.select(F.col(column).alias("value")).where("value is not null").distinct()
    return with_index(values, "value").select("value", F.col("__ix").alias("code"))


def encode(df: DataFrame, encoder: DataFrame, column: str, name: str) -> DataFrame:
    """Codes by lookup; a value that the encoder hasn't seen is an error."""
    joined = df.join(encoder.select(F.col("value").alias(column), F.col("code").alias("__code")), column, "left")
    unseen = F.col("__code").isNull() & F.col(column).isNotNull()
    return joined.withColumn(name, F.when(unseen, F.raise_error(F.lit(f"unseen value in {column}")).cast("long")).otherwise(F.col("__code"))).drop("__code")


def decode(df: DataFrame, encoder: DataFrame, column: str, name: str) -> DataFrame:
    joined = df.join(encoder.withColumnRenamed("code", column), column, "left")
    return joined.withColumnRenamed("value", name)


def ordinal_fit(df: DataFrame, columns: Sequence[str]) -> dict[str, DataFrame]:
    """The fitted state: for each column its distinct values, numbered in order."""
    return {c: label_encoder(df, c) for c in columns}


def ordinal_apply(df: DataFrame, fitted: dict[str, DataFrame]) -> DataFrame:
    """``<column>_code`` of each fitted column, in any rows; a value that the fit hasn't seen is an error."""
    for c, encoder in fitted.items():
        df = encode(df, encoder, c, f"{c}_code")
    return df


def ordinal_encode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return ordinal_apply(df, ordinal_fit(df, columns))


def class_weight(df: DataFrame, column: str) -> DataFrame:
    """class, weight: n / (k * count of the class)."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("class")).agg(F.count("*").alias("n"))
    everything = Window.partitionBy()  # one row per class
    return counts.select("class", (F.sum("n").over(everything) / (F.count("*").over(everything) * F.col("n"))).alias("weight"))


def overlap(target: DataFrame, reference: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of target whose value is seen in reference, in each of the columns."""
    for c in columns:
        target = target.join(reference.select(c).distinct(), c, "left_semi")
    return target


def split(df: DataFrame, sizes: Sequence[float], key: str, seed: int = 0, stratify: str | None = None) -> DataFrame:
    """A column ``split``, 0, 1, ..: each row's part, by a seeded hash of its key.

    Parts have their sizes within one row in each stratum; rows are ordered only
    inside hash buckets at the parts' borders, and counted elsewhere.
    """
    order = F.xxhash64(F.lit(seed), F.col(key))
    bucket = F.shiftrightunsigned(order, 52)
    strata = [F.col(stratify)] if stratify else [F.lit(0)]
    rows = df.withColumn("__order", order).withColumn("__bucket", bucket).withColumn("__stratum", strata[0])
    counts = rows.groupBy("__stratum", "__bucket").agg(F.count("*").alias("__n"))
    by = Window.partitionBy("__stratum")
    before = by.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__stratum", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"), F.sum("__n").over(by).alias("__total"))
    inside = Window.partitionBy("__stratum", "__bucket").orderBy("__order", key)
    place = (F.col("__start") + F.row_number().over(inside) - 0.5) / F.col("__total") * sum(sizes)
    placed = rows.join(starts, ["__stratum", "__bucket"]).withColumn("__place", place)
    part, upto = F.lit(len(sizes) - 1), sum(sizes)
    for k in range(len(sizes) - 2, -1, -1):
        upto -= sizes[k + 1]
        part = F.when(F.col("__place") < upto, F.lit(k)).otherwise(part)
    return placed.withColumn("split", part).select(*df.columns, "split")
