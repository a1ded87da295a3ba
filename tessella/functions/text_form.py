"""One text form for values of every type, made of expressions.

null, true, 1, 1.0, "text", 0xff, dates as ISO texts with milliseconds, [a, b] for
arrays, (name=a, other=b) for structs, {k:v,k:v} for dicts (maps, or entry arrays where
``dict_`` is asked for), {a,b} for sets. In texts only backslash and quote are escaped.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGERS = (T.LongType, T.IntegerType, T.ShortType, T.ByteType)


def _float(c: Column) -> Column:
    """A shortest decimal text with a point; exponents as 1e+16 and 1e-07."""
    text = c.cast("string")
    exponent = F.regexp_extract(text, r"E(-?\d+)$", 1)
    digits = F.regexp_replace(F.regexp_replace(text, r"E-?\d+$", ""), r"\.0$", "")
    signed = F.when(F.startswith(exponent, F.lit("-")), F.concat(F.lit("-"), F.lpad(F.substring(exponent, 2, 4), 2, "0"))).otherwise(F.concat(F.lit("+"), F.lpad(exponent, 2, "0")))
    small = (F.abs(c) < 1e16) & (F.abs(c) >= 1e-4)
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%.20f", c), r"0+$", ""), r"\.$", ".0")
    written = F.when(exponent == "", text).when(small & (F.abs(c) >= 1), F.concat(c.cast("decimal(17,0)").cast("string"), F.lit(".0"))).when(small, plain).otherwise(F.concat(digits, F.lit("e"), signed))
    return F.when(F.isnan(c), "NaN").when(c == float("inf"), "Infinity").when(c == float("-inf"), "-Infinity").otherwise(written)


def _entries(a: Column, key: T.DataType, value: T.DataType) -> Column:
    items = F.transform(a, lambda e: F.concat(print_value(e["key"], key), F.lit(":"), print_value(e["value"], value)))
    return F.when(F.size(a) == 0, "{:}").otherwise(F.concat(F.lit("{"), F.array_join(items, ","), F.lit("}")))


def print_value(c: Column, kind: T.DataType) -> Column:
    """The text of a value of the given type."""
    if isinstance(kind, T.BooleanType) or isinstance(kind, _INTEGERS):
        text = c.cast("string")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        text = _float(c.cast("double"))
    elif isinstance(kind, T.StringType):
        text = F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS")
    elif isinstance(kind, T.BinaryType):
        text = F.concat(F.lit("0x"), F.lower(F.hex(c)))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: print_value(x, kind.elementType)), ", "), F.lit("]"))
    elif isinstance(kind, T.MapType):
        text = _entries(F.array_sort(F.map_entries(c)), kind.keyType, kind.valueType)
    elif isinstance(kind, T.StructType):
        fields = [F.concat(F.lit(f"{f.name}="), print_value(c[f.name], f.dataType)) for f in kind]
        text = F.concat(F.lit("("), F.concat_ws(", ", *fields), F.lit(")")) if fields else F.lit("()")
    else:
        text = c.cast("string")
    return F.when(c.isNull(), "null").otherwise(text)


def print_set(c: Column, element: T.DataType) -> Column:
    return F.concat(F.lit("{"), F.array_join(F.transform(c, lambda x: print_value(x, element)), ","), F.lit("}"))


def print_dict(c: Column, key: T.DataType, value: T.DataType) -> Column:
    """A sorted entry array as a dict."""
    return _entries(c, key, value)


def print_variant(c: Column, cases: dict[str, T.DataType]) -> Column:
    """A tagged struct: .tag, and the value of its case where it has one."""
    out = F.concat(F.lit("."), c["tag"])
    for tag, kind in cases.items():
        out = F.when((c["tag"] == tag) & c[tag].isNotNull(), F.concat(F.lit(f".{tag} "), print_value(c[tag], kind))).otherwise(out)
    return out


def parse_scalar(text: Column, kind: T.DataType) -> Column:
    """A scalar of its text form; a text that isn't one is an error."""
    bad = F.raise_error(F.concat(F.lit(f"not a {kind.simpleString()}: "), text))
    if isinstance(kind, T.StringType):
        inner = F.substring(text, F.lit(2), F.length(text) - 2)
        fine = text.rlike(r'(?s)^"(?:[^"\\]|\\["\\])*"$')
        value = F.regexp_replace(inner, r'\\(["\\])', "$1")
    elif isinstance(kind, T.BooleanType):
        fine, value = text.isin("true", "false"), text == "true"
    elif isinstance(kind, _INTEGERS):
        fine = text.rlike(r"^-?\d+$")
        value = F.when(fine, text).cast(kind)
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        fine = text.rlike(r"^(?:-?\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|NaN|-?Infinity)$")
        value = F.when(fine, text).cast(kind)
    elif isinstance(kind, T.BinaryType):
        fine, value = text.rlike(r"^0x(?:[0-9a-fA-F]{2})*$"), F.unhex(F.substring(text, F.lit(3), F.length(text)))
    else:
        fine, value = text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3}$"), F.try_to_timestamp(text)
    return F.when(text == "null", F.lit(None).cast(kind)).when(fine, value).otherwise(bad.cast(kind))
