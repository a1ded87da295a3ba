"""Typed JSON: a text form that keeps every type apart.

Integers are strings, timestamps ISO texts with milliseconds, binaries 0x and hex
digits, doubles that JSON lacks are words, entry arrays are arrays of {key, value}.
The schema says what each text is, so values are re-shaped by expressions and the
built-in writer and reader do the rest.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _out(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return c.cast("string")
    if isinstance(kind, T.TimestampType):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    if isinstance(kind, T.TimestampNTZType):
        return F.date_format(c.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    if isinstance(kind, T.BinaryType):
        return F.concat(F.lit("0x"), F.lower(F.hex(c)))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _out(x, kind.elementType))
    if isinstance(kind, T.StructType):
        inner = F.struct(*(_out(c[f.name], f.dataType).alias(f.name) for f in kind))
        return F.when(c.isNotNull(), inner)
    if isinstance(kind, T.MapType):
        return _out(F.array_sort(F.map_entries(c)), T.ArrayType(T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])))
    return c


def _text_type(kind: T.DataType) -> T.DataType:
    if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.TimestampType, T.TimestampNTZType, T.BinaryType)):
        return T.StringType()
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_text_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _text_type(f.dataType)) for f in kind])
    if isinstance(kind, T.MapType):
        return T.ArrayType(T.StructType([T.StructField("key", _text_type(kind.keyType)), T.StructField("value", _text_type(kind.valueType))]))
    return kind


def _in(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.TimestampType)):
        return c.cast(kind)
    if isinstance(kind, T.TimestampNTZType):
        return c.cast("timestamp").cast(kind)
    if isinstance(kind, T.BinaryType):
        return F.unhex(F.substring(c, F.lit(3), F.length(c)))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _in(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*(_in(c[f.name], f.dataType).alias(f.name) for f in kind)))
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.transform(c, lambda e: F.struct(_in(e["key"], kind.keyType).alias("key"), _in(e["value"], kind.valueType).alias("value"))))
    return c


def print_json(c: Column, kind: T.DataType) -> Column:
    """The typed JSON text of a struct, array or map column."""
    return F.to_json(_out(c, kind))


def parse_json(text: Column, kind: T.DataType) -> Column:
    """A value of typed JSON; a text that doesn't fit is an error."""
    return _in(F.from_json(text, _text_type(kind), {"mode": "FAILFAST"}), kind)


def variant(tag: str, cases: dict[str, str], value: Column | None = None) -> Column:
    """A tagged struct with one case set: struct<tag, case1, case2, ..>."""
    if tag not in cases:
        raise ValueError(f"no such case: {tag}")
    return F.struct(F.lit(tag).alias("tag"), *((value.cast(k) if n == tag and value is not None else F.lit(None).cast(k)).alias(n) for n, k in cases.items()))


def match(c: Column, **branches) -> Column:
    """Branch on a tagged struct's tag; a tag without a branch is an error."""
    out = None
    for tag, f in branches.items():
        value = f(c[tag])
        out = F.when(c["tag"] == tag, value) if out is None else out.when(c["tag"] == tag, value)
    return out.otherwise(F.raise_error(F.concat(F.lit("unmatched tag: "), c["tag"])))
