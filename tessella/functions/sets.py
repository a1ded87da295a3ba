"""Set columns: arrays of distinct items, kept sorted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions import arrays, dicts

Fn = Callable[..., Column]
_col = arrays._col


def of(a: Column) -> Column:
    """The set of an array's items."""
    return F.array_sort(F.array_distinct(a))


def generate(n, f: Fn) -> Column:
    """Distinct f(i), i in 0..n-1."""
    return of(arrays.generate(n, f))


size = arrays.size


def has(s: Column, value) -> Column:
    return F.array_contains(s, _col(value))


def insert(s: Column, value) -> Column:
    """The set with value; it is an error if it is there."""
    return F.when(has(s, value), F.array(F.coalesce(F.raise_error(F.lit("set has the value already")), F.get(s, F.lit(0))))).otherwise(try_insert(s, value)["set"])


def try_insert(s: Column, value) -> Column:
    """struct(set, inserted)."""
    return F.struct(of(F.array_append(s, _col(value))).alias("set"), (~has(s, value)).alias("inserted"))


def delete(s: Column, value) -> Column:
    """The set without value; it is an error if it isn't there."""
    return F.when(has(s, value), F.array_remove(s, _col(value))).otherwise(F.array(F.coalesce(F.raise_error(F.lit("set lacks the value")), F.get(s, F.lit(0)))))


def try_delete(s: Column, value) -> Column:
    """struct(set, found)."""
    return F.struct(F.array_remove(s, _col(value)).alias("set"), has(s, value).alias("found"))


clear = arrays.clear
copy = arrays.copy


def union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def intersect(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def diff(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_except(a, b))


def sym_diff(a: Column, b: Column) -> Column:
    return F.array_sort(F.concat(F.array_except(a, b), F.array_except(b, a)))


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def is_disjoint(a: Column, b: Column) -> Column:
    return ~F.arrays_overlap(a, b)


def map_(s: Column, f: Fn) -> Column:
    """Dict of item to f(item)."""
    return dicts.entries(s, f)


def filter_(s: Column, p: Fn) -> Column:
    return F.filter(s, p)


def filter_map(s: Column, f: Fn) -> Column:
    """Dict of item to f(item), where that is not null."""
    return F.filter(dicts.entries(s, f), lambda e: e["value"].isNotNull())


first_map = arrays.first_map
map_reduce = arrays.map_reduce
to_array = arrays.map_
to_set = arrays.to_set
to_dict = arrays.to_dict
flatten_to_array = arrays.flatten_to_array
flatten_to_set = arrays.flatten_to_set
flatten_to_dict = arrays.flatten_to_dict
group_fold = arrays.group_fold


def reduce(s: Column, f: Fn, initial) -> Column:
    """f(acc, item) over the items in order."""
    return F.aggregate(s, _col(initial), f)
