"""Tables written to the shared folder, to cut lineage and to survive lost executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.session import shared_folder


class Scratch:
    """A folder of its own below ``spark.checkpoint.dir``.

    Only in a local session that leaves it unset a temporary folder takes its
    place; elsewhere that is an error. ``keep`` writes a frame as Parquet and reads it back, so
    that a lost executor costs a read, not a recomputation; ``drop`` deletes
    tables that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = shared_folder(spark, name)

    def keep(self, frame: DataFrame, name: str) -> DataFrame:
        frame.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(frame.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        """Lets the context cleaner delete shuffle files of jobs that are done; it waits for the driver's garbage collection."""
        self.spark._jvm.System.gc()


def spare_mark(*frames: DataFrame) -> str:
    """A beginning that no column's name has, for columns of an operator's own beside a caller's."""
    mark = "__"
    while any(c.lower().startswith(mark) for f in frames for c in f.columns):
        mark += "_"
    return mark
