"""SQL text and databases: results with a checked row contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WIDENS = {("bigint", "double"), ("int", "bigint"), ("int", "double"), ("bigint", "boolean"), ("double", "bigint"), ("boolean", "bigint"), ("float", "double"), ("timestamp_ntz", "timestamp"), ("date", "timestamp")}


def query(spark: SparkSession, text: str, args: list | dict | None = None) -> DataFrame:
    """Any SQL with positional or named parameters."""
    return spark.sql(text, args) if args else spark.sql(text)


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of a schema: each must exist and be of its type or widen to it; null only where it may be."""
    have = {f.name: f.dataType for f in df.schema}
    out = []
    for f in schema:
        if f.name not in have:
            raise ValueError(f"missing column: {f.name}")
        was, now = have[f.name].simpleString(), f.dataType.simpleString()
        if was != now and (was, now) not in _WIDENS and not was.startswith("decimal"):
            raise ValueError(f"{f.name}: {was} is not {now}")
        c = F.col(f"`{f.name}`").cast(f.dataType)
        if not f.nullable:
            c = F.coalesce(c, F.raise_error(F.lit(f"{f.name}: null in a column that may not be null")).cast(f.dataType))
        out.append(c.alias(f.name))
    return df.select(*out)


def select(spark: SparkSession, text: str, schema: T.StructType, args: list | dict | None = None) -> DataFrame:
    return typed(query(spark, text, args), schema)


def cells(df: DataFrame) -> DataFrame:
    """cells: each row as sorted entries of column name and a tagged cell, for results of no known schema."""
    kinds = {"String": "string", "Integer": "bigint", "Float": "double", "Boolean": "boolean", "Blob": "binary", "DateTime": "timestamp"}
    names = {"string": "String", "bigint": "Integer", "int": "Integer", "smallint": "Integer", "tinyint": "Integer", "double": "Float", "float": "Float", "boolean": "Boolean", "binary": "Blob", "timestamp": "DateTime", "timestamp_ntz": "DateTime", "date": "DateTime"}

    def cell(f: T.StructField):
        kind = f.dataType.simpleString()
        tag = names.get(kind, "Float" if kind.startswith("decimal") else "String")
        c = F.col(f"`{f.name}`")
        value = F.struct(F.when(c.isNull(), "Null").otherwise(tag).alias("tag"), *((c.cast(k) if n == tag else F.lit(None).cast(k)).alias(n) for n, k in kinds.items()))
        return F.struct(F.lit(f.name).alias("key"), value.alias("value"))

    return df.select(F.array(*(cell(f) for f in sorted(df.schema, key=lambda f: f.name))).alias("cells"))


def jdbc(spark: SparkSession, url: str, table_or_query: str, partition: tuple[str, int, int, int] | None = None, **options) -> DataFrame:
    """A database's table or query; ``partition`` is (column, low, high, tasks) for a parallel read."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    reader = reader.option("query" if " " in table_or_query.strip() else "dbtable", table_or_query)
    if partition:
        column, low, high, n = partition
        reader = reader.options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=n)
    return reader.load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options) -> int:
    """Insert the rows into a database's table; the number of rows inserted."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.format("jdbc").mode(mode).option("url", url).option("dbtable", table).options(**options).save()
    return seen.get["n"]


def execute(spark: SparkSession, text: str, args: list | dict | None = None) -> DataFrame:
    """tag, rows_affected, cells: the result variant of any one statement of Spark SQL.

    A statement that has rows (select, with, values, show, describe) gives a row of tag
    "select" for each; an insert, update, delete or merge one row with its tag and the
    number of rows its source reports, null where the source reports none; any other
    statement one row of tag "other".
    """
    word = text.lstrip(" \t\r\n(").split(None, 1)[0].lower() if text.strip(" \t\r\n(") else ""
    out = query(spark, text, args)
    if word in ("select", "with", "values", "show", "describe", "desc", "table", "from"):
        return cells(out).select(F.lit("select").alias("tag"), F.lit(None).cast("long").alias("rows_affected"), "cells")
    counted = [c for c in out.columns if c.lower() in ("num_affected_rows", "num_inserted_rows", "count")]
    n = out.first()[counted[0]] if counted else None
    tag = word if word in ("insert", "update", "delete", "merge") else "other"
    empty = cells(spark.range(0)).schema["cells"].dataType
    return spark.range(1).select(F.lit(tag).alias("tag"), F.lit(n).cast("long").alias("rows_affected"), F.lit(None).cast(empty).alias("cells"))


def page(df: DataFrame, order: list[str], offset: int = 0, limit: int | None = None) -> DataFrame:
    out = df.orderBy(*order).offset(offset)
    return out if limit is None else out.limit(limit)
