"""Event-time windows that run alike on streams and on tables.

On a stream call ``watermarked`` first; on a table it changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def watermarked(df: DataFrame, time: str, late: str) -> DataFrame:
    return df.withWatermark(time, late) if df.isStreaming else df


def tumbling(df: DataFrame, time: str, width: str, *keys: str, **folds: Column) -> DataFrame:
    grouped = df.groupBy(F.window(time, width).alias("w"), *keys).agg(*(c.alias(n) for n, c in folds.items()))
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *folds)


def sliding(df: DataFrame, time: str, width: str, slide: str, *keys: str, **folds: Column) -> DataFrame:
    grouped = df.groupBy(F.window(time, width, slide).alias("w"), *keys).agg(*(c.alias(n) for n, c in folds.items()))
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *folds)


def sessions(df: DataFrame, time: str, gap: str, *keys: str, **folds: Column) -> DataFrame:
    grouped = df.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*(c.alias(n) for n, c in folds.items()))
    return grouped.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, *folds)


def run_to_memory(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Drive a stream over what is there now and give the result table; for tests and small results."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def upsert_into(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """A stream whose batches go to ``write(frame, number)``; a batch may come twice, with one number."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update").start()
