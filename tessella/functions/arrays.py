"""Array columns: 0-based, ordered, total.

Callbacks of maps, filters and folds take (item, index); sort and search keys take
the item. What changed a mutable array elsewhere returns the new array here.
Everything is a built-in expression, so it stays in generated code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Fn = Callable[..., Column]


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def size(a: Column) -> Column:
    return F.array_size(a).cast("long")


def _call(f: Fn, item: Column, index: Column) -> Column:
    return f(item, index) if f.__code__.co_argcount >= 2 else f(item)


def generate(n, f: Fn) -> Column:
    """f(i) for i in 0..n-1; empty for n <= 0."""
    n = _col(n)
    return F.transform(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).otherwise(F.array().cast("array<long>")), f)


def range_(start, end, step=1) -> Column:
    """start, start + step, .. before end; empty if end is not ahead; a zero step is an error."""
    start, end, step = (_col(x).cast("long") for x in (start, end, step))
    some = ((step > 0) & (start < end)) | ((step < 0) & (start > end))
    # sequence() counts down by itself where the end lies behind, so it only runs where there is something to count.
    last = F.when(step > 0, end - 1).otherwise(end + 1)
    return F.when(step == 0, F.raise_error(F.lit("range step is zero")).cast("array<long>")).when(some, F.sequence(start, last, step)).otherwise(F.array().cast("array<long>"))


def linspace(start, end, n) -> Column:
    """n evenly spaced numbers, both ends included; one number is the start."""
    start, end, n = _col(start).cast("double"), _col(end).cast("double"), _col(n)
    step = F.when(n > 1, (end - start) / (n - 1)).otherwise(F.lit(0.0))
    return generate(n, lambda i: start + i * step)


def has(a: Column, i) -> Column:
    i = _col(i)
    return (i >= 0) & (i < F.size(a))


def get(a: Column, i) -> Column:
    """Element i; an index outside is an error, also a negative one."""
    i = _col(i)
    return F.when(has(a, i), F.get(a, i.cast("int"))).otherwise(F.raise_error(F.concat(F.lit("array index out of range: "), i.cast("string"))))


def get_or_default(a: Column, i, default: Fn) -> Column:
    i = _col(i)
    return F.when(has(a, i), F.get(a, i.cast("int"))).otherwise(default(i))


def try_get(a: Column, i) -> Column:
    return F.get(a, _col(i).cast("int"))


def update(a: Column, i, value) -> Column:
    """A copy with element i replaced; an index outside is an error."""
    i = _col(i)
    return F.transform(F.when(has(a, i), a).otherwise(_missing_array(a)), lambda x, j: F.when(j == i, _col(value)).otherwise(x))


def _missing_array(a: Column) -> Column:
    # An element of the wanted type, made only when it raises.
    return F.array(F.coalesce(F.raise_error(F.lit("array index out of range")), F.get(a, F.lit(0))))


def merge(a: Column, i, value, f: Fn) -> Column:
    """A copy with element i set to f(old, value, i)."""
    i = _col(i)
    return F.transform(F.when(has(a, i), a).otherwise(_missing_array(a)), lambda x, j: F.when(j == i, f(x, _col(value), j)).otherwise(x))


def push_last(a: Column, value) -> Column:
    return F.array_append(a, _col(value))


def push_first(a: Column, value) -> Column:
    return F.array_prepend(a, _col(value))


def _nonempty(a: Column) -> Column:
    return F.when(F.size(a) > 0, a).otherwise(_missing_array(a))


def pop_last(a: Column) -> Column:
    """struct(value, rest); an empty array is an error."""
    b = _nonempty(a)
    return F.struct(F.element_at(b, -1).alias("value"), F.slice(b, 1, F.size(b) - 1).alias("rest"))


def pop_first(a: Column) -> Column:
    b = _nonempty(a)
    return F.struct(F.element_at(b, 1).alias("value"), F.slice(b, 2, F.size(b) - 1).alias("rest"))


def concat(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def append(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def prepend(a: Column, b: Column) -> Column:
    return F.concat(b, a)


def merge_all(a: Column, b: Column, f: Fn) -> Column:
    """f(x, y, i) on the common beginning; what a has more stays."""
    return F.transform(a, lambda x, i: F.when(i < F.size(b), f(x, F.get(b, i), i)).otherwise(x))


def clear(a: Column) -> Column:
    return F.slice(a, 1, 0)


def sort(a: Column, key: Fn = lambda x: x) -> Column:
    """Stable ascending sort by key, in Spark's order (NaN last, shorter arrays first)."""
    keyed = F.transform(a, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


def reverse(a: Column) -> Column:
    return F.reverse(a)


def is_sorted(a: Column, key: Fn = lambda x: x) -> Column:
    """Whether keys never fall."""
    keys = F.transform(a, key)
    steps = F.zip_with(F.slice(keys, 1, F.greatest(F.size(keys) - 1, F.lit(0))), F.slice(keys, 2, F.greatest(F.size(keys) - 1, F.lit(0))), lambda x, y: x <= y)
    return F.forall(steps, lambda ok: ok)


def find_sorted_first(a: Column, target, key: Fn = lambda x: x) -> Column:
    """Lower bound: where target would go before its equals."""
    return F.size(F.filter(a, lambda x: key(x) < _col(target))).cast("long")


def find_sorted_last(a: Column, target, key: Fn = lambda x: x) -> Column:
    """Upper bound: where target would go after its equals."""
    return F.size(F.filter(a, lambda x: key(x) <= _col(target))).cast("long")


def find_sorted_range(a: Column, target, key: Fn = lambda x: x) -> Column:
    return F.struct(find_sorted_first(a, target, key).alias("start"), find_sorted_last(a, target, key).alias("end"))


def find_first(a: Column, target, key: Fn = lambda x: x) -> Column:
    """Index of the first item whose key is the target, or null."""
    return (F.nullif(F.array_position(F.transform(a, key), _col(target)), F.lit(0)) - 1).cast("long")


def find_all(a: Column, target, key: Fn = lambda x: x) -> Column:
    """All indexes whose key is the target."""
    hits = F.transform(a, lambda x, i: F.when(key(x).eqNullSafe(_col(target)), i.cast("long")))
    return F.array_compact(hits)


def slice_(a: Column, start, end) -> Column:
    """Items start..end-1; negative bounds count from the end, bounds outside are clamped."""
    n = F.size(a)
    clamp = lambda i: F.least(F.greatest(F.when(i < 0, i + n).otherwise(i), F.lit(0)), n)
    lo, hi = clamp(_col(start)), clamp(_col(end))
    return F.slice(a, (lo + 1).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int"))


def get_keys(a: Column, indexes: Column, default: Fn) -> Column:
    """Items at the given indexes, default(i) where there is none."""
    return F.transform(indexes, lambda i: get_or_default(a, i, default))


def copy(a: Column) -> Column:
    return a


def map_(a: Column, f: Fn) -> Column:
    return F.transform(a, lambda x, i: _call(f, x, i))


def filter_(a: Column, p: Fn) -> Column:
    return F.filter(a, lambda x, i: _call(p, x, i))


def filter_map(a: Column, f: Fn) -> Column:
    """f of each item, where it is not null."""
    return F.array_compact(map_(a, f))


def first_map(a: Column, f: Fn) -> Column:
    """The first f that is not null, or null."""
    return F.get(filter_map(a, f), F.lit(0))


def map_reduce(a: Column, f: Fn, reduce: Callable[[Column, Column], Column]) -> Column:
    """Reduce f of the items from the left; an empty array is an error."""
    return F.reduce(F.slice(map_(_nonempty(a), f), 2, F.greatest(F.size(a) - 1, F.lit(0))), F.get(map_(_nonempty(a), f), F.lit(0)), reduce)


def fold(a: Column, initial, f: Fn) -> Column:
    """f(acc, item, index) from the left."""
    start = F.struct(_col(initial).alias("acc"), F.lit(0).cast("long").alias("i"))
    if f.__code__.co_argcount < 3:
        return F.aggregate(a, _col(initial), f)
    return F.aggregate(a, start, lambda s, x: F.struct(f(s["acc"], x, s["i"]).alias("acc"), (s["i"] + 1).alias("i")))["acc"]


def string_join(a: Column, separator: str) -> Column:
    return F.array_join(a, separator)


def to_set(a: Column, f: Fn = lambda x: x) -> Column:
    """Distinct f of the items, sorted."""
    return F.array_sort(F.array_distinct(map_(a, f)))


def flatten_to_array(a: Column, f: Fn = lambda x: x) -> Column:
    return F.flatten(map_(a, f))


def flatten_to_set(a: Column, f: Fn = lambda x: x) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(map_(a, f))))


def to_dict(a: Column, key: Fn, value: Fn, merge: Fn) -> Column:
    """Sorted entries of key and value; merge(old, new, key) in array order where keys meet."""
    from tessella.functions import dicts

    return dicts.from_entries(F.transform(a, lambda x, i: F.struct(_call(key, x, i).alias("key"), _call(value, x, i).alias("value"))), merge)


def flatten_to_dict(a: Column, f: Fn, merge: Fn) -> Column:
    """Entries of the dicts f(item), merged in array order."""
    from tessella.functions import dicts

    return dicts.from_entries(F.flatten(map_(a, f)), merge)


def group_fold(a: Column, key: Fn, initial: Fn, f: Fn) -> Column:
    """Entries of key and f folded over the items of that key in order, from initial(key)."""
    from tessella.functions import dicts

    keyed = F.transform(a, lambda x, i: F.struct(_call(key, x, i).alias("k"), x.alias("x"), i.cast("long").alias("i")))
    step = (lambda acc, s: f(acc, s["x"], s["i"])) if f.__code__.co_argcount >= 3 else (lambda acc, s: f(acc, s["x"]))
    return dicts.by_key(keyed, lambda s: s["k"], lambda k, own: F.aggregate(own, initial(k), step))
