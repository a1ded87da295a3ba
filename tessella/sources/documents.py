"""Filters, updates and deletes of document frames by example documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OPS = {
    "$eq": lambda c, v: c.eqNullSafe(F.lit(v)),
    "$ne": lambda c, v: ~c.eqNullSafe(F.lit(v)),
    "$gt": lambda c, v: c > v,
    "$gte": lambda c, v: c >= v,
    "$lt": lambda c, v: c < v,
    "$lte": lambda c, v: c <= v,
    "$in": lambda c, v: c.isin(*v),
    "$nin": lambda c, v: ~c.isin(*v),
    "$exists": lambda c, v: c.isNotNull() if v else c.isNull(),
    "$regex": lambda c, v: c.rlike(v),
}


def predicate(filter_: dict) -> Column:
    """A filter document as a predicate, which the scan can push down."""
    parts = []
    for key, want in filter_.items():
        if key in ("$and", "$or"):
            join = (lambda a, b: a & b) if key == "$and" else (lambda a, b: a | b)
            parts.append(reduce(join, map(predicate, want)))
        elif key == "$not":
            parts.append(~predicate(want))
        elif isinstance(want, dict) and any(k.startswith("$") for k in want):
            parts += [_OPS[op](F.col(key), v) for op, v in want.items()]
        else:
            parts.append(_OPS["$eq"](F.col(key), want))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def find(df: DataFrame, filter_: dict, order: list[str], skip: int = 0, limit: int | None = None) -> DataFrame:
    out = df.where(predicate(filter_)).orderBy(*order).offset(skip)
    return out if limit is None else out.limit(limit)


def find_one(df: DataFrame, filter_: dict, order: list[str]) -> DataFrame:
    return find(df, filter_, order, limit=1)


def _changes(update: dict) -> dict[str, Column]:
    if not any(k.startswith("$") for k in update):
        update = {"$set": update}
    out: dict[str, Column] = {k: F.lit(v) for k, v in update.get("$set", {}).items()}
    out |= {k: F.col(k) + F.lit(v) for k, v in update.get("$inc", {}).items()}
    out |= {k: F.lit(None) for k in update.get("$unset", {})}
    return out


def update_many(df: DataFrame, filter_: dict, update: dict) -> DataFrame:
    """The frame with matching rows changed."""
    hit = F.coalesce(predicate(filter_), F.lit(False))
    kinds = dict(df.dtypes)
    return df.withColumns({k: F.when(hit, v.cast(kinds[k])).otherwise(F.col(k)) for k, v in _changes(update).items()})


def update_one(df: DataFrame, filter_: dict, update: dict, key: str) -> DataFrame:
    """The frame with the matching row of the smallest key changed."""
    first = df.where(predicate(filter_)).agg(F.min(key).alias("k")).first()["k"]
    return update_many(df, {key: first}, update) if first is not None else df


def delete_many(df: DataFrame, filter_: dict) -> DataFrame:
    return df.where(~F.coalesce(predicate(filter_), F.lit(False)))


def delete_one(df: DataFrame, filter_: dict, key: str) -> DataFrame:
    first = df.where(predicate(filter_)).agg(F.min(key).alias("k")).first()["k"]
    return delete_many(df, {key: first}) if first is not None else df


def insert(df: DataFrame, rows: list[dict]) -> DataFrame:
    return df.unionByName(df.sparkSession.createDataFrame(rows, df.schema))
