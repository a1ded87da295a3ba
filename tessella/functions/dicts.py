"""Dict columns: arrays of struct(key, value) with distinct keys, sorted by key.

Spark's maps keep insertion order and cannot be compared, so a map is only the
form at the edge (``from_map``, ``to_map``). Callbacks take (value, key); merges
take (old, new, key).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Fn = Callable[..., Column]


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _entry(k: Column, v: Column) -> Column:
    return F.struct(k.alias("key"), v.alias("value"))


def _call(f: Fn, e: Column) -> Column:
    return f(e["value"], e["key"]) if f.__code__.co_argcount >= 2 else f(e["value"])


def _sorted(d: Column) -> Column:
    return F.transform(F.array_sort(F.transform(d, lambda e, i: F.struct(e["key"].isNull().alias("none"), e["key"].alias("k"), i.alias("i"), e.alias("e")))), lambda s: s["e"])


def entries(keys: Column, f: Fn) -> Column:
    """A dict of sorted distinct keys to f(key)."""
    return F.transform(keys, lambda k: _entry(k, f(k)))


def from_map(m: Column) -> Column:
    return _sorted(F.map_entries(m))


def to_map(d: Column) -> Column:
    return F.map_from_entries(d)


def let(value: Column, body: Fn) -> Column:
    """body(value), with value computed once, however often body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def by_key(items: Column, key: Fn, value: Fn) -> Column:
    """A dict of each distinct key(item) in order to value(key, its items in array order): one sort, one pass over its runs."""

    def grouped(xs: Column) -> Column:
        tagged = F.transform(xs, lambda x, i: F.struct(key(x).isNull().alias("none"), key(x).alias("k"), i.alias("i")))

        def runs(s: Column) -> Column:
            new = lambda i: (i == 0) | ~F.get(s, i)["k"].eqNullSafe(F.get(s, i - 1)["k"])
            starts = F.filter(F.transform(s, lambda _, i: i), new)

            def cut(at: Column) -> Column:
                part = lambda b, j: F.slice(s, b + 1, F.coalesce(F.get(at, j + 1), F.size(s)) - b)
                own = lambda run: F.transform(run, lambda r: F.get(xs, r["i"]))
                return F.transform(at, lambda b, j: let(part(b, j), lambda run: _entry(F.get(run, F.lit(0))["k"], value(F.get(run, F.lit(0))["k"], own(run)))))

            return let(starts, cut)

        return let(F.array_sort(tagged), runs)

    return let(items, grouped)


def from_entries(pairs: Column, merge: Fn) -> Column:
    """A dict of pairs in any order; merge(old, new, key) from the left where keys meet."""
    joined = lambda k: (lambda old, new: merge(old, new, k)) if merge.__code__.co_argcount >= 3 else merge
    values = lambda own: F.transform(own, lambda e: e["value"])
    fold = lambda k, vs: F.reduce(F.slice(vs, 2, F.greatest(F.size(vs) - 1, F.lit(0))), F.get(vs, F.lit(0)), joined(k))
    return by_key(pairs, lambda e: e["key"], lambda k, own: let(values(own), lambda vs: fold(k, vs)))


def generate(n, key: Fn, value: Fn, merge: Fn) -> Column:
    from tessella.functions import arrays

    return from_entries(arrays.generate(n, lambda i: _entry(key(i), value(i))), merge)


def size(d: Column) -> Column:
    return F.size(d).cast("long")


def keys(d: Column) -> Column:
    return F.transform(d, lambda e: e["key"])


def values(d: Column) -> Column:
    return F.transform(d, lambda e: e["value"])


def has(d: Column, key) -> Column:
    return F.exists(d, lambda e: e["key"] == _col(key))


def _found(d: Column, key) -> Column:
    return F.get(F.filter(d, lambda e: e["key"] == _col(key)), F.lit(0))


def try_get(d: Column, key) -> Column:
    return _found(d, key)["value"]


def get(d: Column, key) -> Column:
    """The value of a key; a missing key is an error."""
    missing = F.raise_error(F.concat(F.lit("missing key: "), _col(key).cast("string")))
    return let(_found(d, key), lambda e: F.when(e.isNotNull(), e["value"]).otherwise(missing))


def get_or_default(d: Column, key, default: Fn) -> Column:
    return let(_found(d, key), lambda e: F.when(e.isNotNull(), e["value"]).otherwise(default(_col(key))))


def get_keys(d: Column, wanted: Column, default: Fn) -> Column:
    """A dict of the wanted keys to their values, default(key) where there is none."""
    return entries(wanted, lambda k: get_or_default(d, k, default))


def _put(d: Column, key, value) -> Column:
    part = lambda p: F.filter(d, lambda e: p(e["key"], _col(key)))
    return F.concat(part(lambda a, b: a < b), F.array(_entry(_col(key), _col(value))), part(lambda a, b: a > b))


def _error(d: Column, text: str) -> Column:
    return F.array(F.coalesce(F.raise_error(F.lit(text)), F.get(d, F.lit(0))))


def insert(d: Column, key, value) -> Column:
    """The dict with a new key; it is an error if it is there."""
    return F.when(has(d, key), _error(d, "dict has the key already")).otherwise(_put(d, key, value))


def get_or_insert(d: Column, key, default: Fn) -> Column:
    """struct(value, dict)."""
    v = get_or_default(d, key, default)
    return F.struct(v.alias("value"), F.when(has(d, key), d).otherwise(_put(d, key, default(_col(key)))).alias("dict"))


def insert_or_update(d: Column, key, value, merge: Fn) -> Column:
    """merge(old, new, key) if the key is there, else insert."""
    return _put(d, key, F.when(has(d, key), merge(try_get(d, key), _col(value), _col(key))).otherwise(_col(value)))


def update(d: Column, key, value) -> Column:
    """The dict with a key's value replaced; a missing key is an error."""
    placed = F.transform(d, lambda e: F.when(e["key"] == _col(key), _entry(_col(key), _col(value))).otherwise(e))
    return F.when(has(d, key), placed).otherwise(_error(d, "missing key"))


def swap(d: Column, key, value) -> Column:
    """struct(old, dict)."""
    return F.struct(get(d, key).alias("old"), update(d, key, value).alias("dict"))


def merge(d: Column, key, value, f: Fn, initial: Fn) -> Column:
    """f(value there or initial(key), value, key) at a key."""
    return _put(d, key, f(get_or_default(d, key, initial), _col(value), _col(key)))


def delete(d: Column, key) -> Column:
    """The dict without a key; a missing key is an error."""
    return F.when(has(d, key), F.filter(d, lambda e: e["key"] != _col(key))).otherwise(_error(d, "missing key"))


def try_delete(d: Column, key) -> Column:
    """struct(dict, found)."""
    return F.struct(F.filter(d, lambda e: e["key"] != _col(key)).alias("dict"), has(d, key).alias("found"))


def pop(d: Column, key) -> Column:
    """struct(value, dict)."""
    return F.struct(get(d, key).alias("value"), delete(d, key).alias("dict"))


def clear(d: Column) -> Column:
    return F.slice(d, 1, 0)


def copy(d: Column) -> Column:
    return d


def union(a: Column, b: Column, merge: Fn) -> Column:
    """All keys of both; merge(of a, of b, key) where both have one."""
    return from_entries(F.concat(a, b), merge)


def merge_all(a: Column, b: Column, f: Fn, default: Fn) -> Column:
    """As union, but a key that only b has gets f(default(key), value, key)."""
    joined = f if f.__code__.co_argcount >= 3 else lambda old, new, _: f(old, new)
    found = lambda d, k: F.get(F.filter(d, lambda e: e["key"].eqNullSafe(k)), F.lit(0))
    met = F.transform(a, lambda e: let(found(b, e["key"]), lambda n: _entry(e["key"], F.when(n.isNull(), e["value"]).otherwise(joined(e["value"], n["value"], e["key"])))))
    fresh = F.transform(F.filter(b, lambda e: found(a, e["key"]).isNull()), lambda e: _entry(e["key"], joined(default(e["key"]), e["value"], e["key"])))
    return _sorted(F.concat(met, fresh))


def map_(d: Column, f: Fn) -> Column:
    return F.transform(d, lambda e: _entry(e["key"], _call(f, e)))


def filter_(d: Column, p: Fn) -> Column:
    return F.filter(d, lambda e: _call(p, e))


def filter_map(d: Column, f: Fn) -> Column:
    return F.filter(map_(d, f), lambda e: e["value"].isNotNull())


def first_map(d: Column, f: Fn) -> Column:
    return F.get(filter_map(d, f), F.lit(0))["value"]


def map_reduce(d: Column, f: Fn, reduce: Fn) -> Column:
    """Reduce f of the entries in key order; an empty dict is an error."""
    from tessella.functions import arrays

    return arrays.map_reduce(to_array(d, f), lambda x: x, reduce)


def reduce(d: Column, f: Fn, initial) -> Column:
    """f(acc, value, key) in key order."""
    return F.aggregate(d, _col(initial), lambda acc, e: f(acc, e["value"], e["key"]) if f.__code__.co_argcount >= 3 else f(acc, e["value"]))


def to_array(d: Column, f: Fn) -> Column:
    return F.transform(d, lambda e: _call(f, e))


def to_set(d: Column, f: Fn) -> Column:
    return F.array_sort(F.array_distinct(to_array(d, f)))


def to_dict(d: Column, key: Fn, value: Fn, merge: Fn) -> Column:
    return from_entries(F.transform(d, lambda e: _entry(_call(key, e), _call(value, e))), merge)


def flatten_to_array(d: Column, f: Fn) -> Column:
    return F.flatten(to_array(d, f))


def flatten_to_set(d: Column, f: Fn) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(to_array(d, f))))


def flatten_to_dict(d: Column, f: Fn, merge: Fn) -> Column:
    return from_entries(F.flatten(to_array(d, f)), merge)


def group_fold(d: Column, key: Fn, initial: Fn, f: Fn) -> Column:
    """Entries grouped by key(value, key), f(acc, value, key) folded in key order from initial(group)."""
    step = lambda acc, e: f(acc, e["value"], e["key"]) if f.__code__.co_argcount >= 3 else f(acc, e["value"])
    return by_key(d, lambda e: _call(key, e), lambda g, own: F.aggregate(own, initial(g), step))
