"""Typed CSV with a checked row contract."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    delimiter: str = ",",
    quote: str = '"',
    escape: str = '"',
    header: bool = True,
    null_strings: Sequence[str] = ("",),
    mapping: Mapping[str, str] | None = None,
    strict: bool = False,
    trim: bool = False,
) -> DataFrame:
    """Rows of the schema from files with a header, matched by name.

    ``mapping`` gives the file's names of columns. A required column that is
    missing, and under ``strict`` one too many, is an error before any row is read.
    A field that isn't of its type, or null in a column that may not be, is an
    error when read. Booleans are only true and false; binary is 0x and hex digits.
    """
    options = {"sep": delimiter, "quote": quote, "escape": escape, "header": header, "multiLine": True, "ignoreLeadingWhiteSpace": trim, "ignoreTrailingWhiteSpace": trim, "nullValue": "\0", "emptyValue": "", "mode": "FAILFAST"}
    named = mapping or {}
    if header:
        raw = spark.read.options(**options).csv(path)
    else:
        raw = spark.read.options(**options).schema(T.StructType([T.StructField(named.get(f.name, f.name), T.StringType()) for f in schema])).csv(path)
    wanted = [named.get(f.name, f.name) for f in schema]
    missing = [w for w, f in zip(wanted, schema, strict=True) if w not in raw.columns and not f.nullable]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    extra = [c for c in raw.columns if c not in wanted]
    if strict and extra:
        raise ValueError(f"unknown columns: {extra}")
    return raw.select(*(field(F.col(f"`{w}`") if w in raw.columns else F.lit(None).cast("string"), f, null_strings).alias(f.name) for w, f in zip(wanted, schema, strict=True)))


def field(text: Column, f: T.StructField, null_strings: Sequence[str] = ("",)) -> Column:
    """A text as a value of the field's type; other texts are an error."""
    given = F.when(text.isin(*null_strings), F.lit(None)).otherwise(text) if null_strings else text
    kind = f.dataType
    bad = F.raise_error(F.concat(F.lit(f"{f.name}: not a {kind.simpleString()}: "), text))
    if isinstance(kind, T.BooleanType):
        value = F.when(given == "true", True).when(given == "false", False).when(given.isNull(), None).otherwise(bad.cast("boolean"))
    elif isinstance(kind, (T.LongType, T.IntegerType)):
        value = F.when(given.isNull() | given.rlike(r"^-?\d+$"), given).otherwise(bad.cast("string")).cast(kind)
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        value = F.when(given.isNull() | given.rlike(r"^(?:-?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|NaN|-?Infinity)$"), given).otherwise(bad.cast("string")).cast(kind)
    elif isinstance(kind, T.BinaryType):
        value = F.when(given.isNull() | given.rlike(r"^0x(?:[0-9a-fA-F]{2})*$"), F.unhex(F.substring(given, F.lit(3), F.length(given)))).otherwise(bad.cast("binary"))
    else:
        value = given.cast(kind)
    if f.nullable:
        return value
    return F.when(given.isNull(), F.raise_error(F.lit(f"{f.name}: null in a column that may not be null")).cast(kind)).otherwise(value)


def write_csv(df: DataFrame, path: str, delimiter: str = ",", null_string: str = "", always_quote: bool = False) -> None:
    """Files with a header; fields are quoted only where needed, quotes doubled."""
    df.write.mode("overwrite").options(sep=delimiter, header=True, nullValue=null_string, quoteAll=always_quote, escape='"').csv(path)


def to_csv_lines(df: DataFrame, delimiter: str = ",", null_string: str = "") -> DataFrame:
    """line: each row as a CSV record, by expressions."""

    def cell(c: str) -> Column:
        text = F.coalesce(F.col(c).cast("string"), F.lit(null_string))
        return F.when(text.rlike(f'[{delimiter}"\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    return df.select(F.concat_ws(delimiter, *map(cell, df.columns)).alias("line"))


def from_csv_blob(df: DataFrame, blob: str, schema: T.StructType, delimiter: str = ",") -> DataFrame:
    """Rows of CSV texts held in a binary column, header skipped; for records without line ends in fields."""
    lines = df.select(F.posexplode(F.split(F.regexp_replace(F.col(blob).cast("string"), "^﻿", ""), "\r?\n")).alias("n", "line")).where("n > 0 and trim(line) <> ''")
    strings = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    row = F.from_csv("line", strings.simpleString()[7:-1].replace(":", " "), {"sep": delimiter, "escape": '"'})
    return lines.select(row.alias("r")).select(*(field(F.col(f"r.{f.name}"), f).alias(f.name) for f in schema))
