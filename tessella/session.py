"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a Spark application, through Spark's own file server."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="tessella-code-")
    path = os.path.join(folder, "tessella_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(p.relative_to(top.parent)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def shared_root(spark: SparkSession) -> str | None:
    """The folder in ``spark.checkpoint.dir``, which executors and driver share; only a local session may leave it unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not root and (not master.startswith("local") or master.startswith("local-")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return root.rstrip("/") if root else None


def shared_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder below the shared one, a temporary one in a local session without."""
    return f"{shared_root(spark) or tempfile.mkdtemp(prefix='tessella-')}/{name}-{uuid.uuid4().hex}"


def stable(df: DataFrame) -> DataFrame:
    """The frame, computed once: what reads it twice sees the same rows in the same partitions.

    It is written to the shared folder; a local session without one, which has no
    executor to lose, keeps it in memory.
    """
    return df.checkpoint() if shared_root(df.sparkSession) else df.persist()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
