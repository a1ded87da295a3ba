"""Files of any store that Spark knows, archives and markup, as frames."""

from __future__ import annotations

import gzip
import io
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """path, modificationTime, length, content."""
    return spark.read.format("binaryFile").load(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """value: each file whole."""
    return spark.read.text(path, wholetext=True)


def list_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """path, length, modificationTime below a folder or prefix; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path).select("path", "length", "modificationTime")


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def is_file(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isFile()


def is_directory(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def make_directory(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.mkdirs(p)


def delete(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.delete(p, True)


def write_texts(df: DataFrame, path: str, append: bool = False) -> None:
    """One text column as lines."""
    df.write.mode("append" if append else "overwrite").text(path)


def write_blobs(df: DataFrame, folder: str) -> DataFrame:
    """Each row's ``content`` as a file ``name`` in a folder of a store that Arrow knows; name and length of what was written.

    A file is written beside its place and moved there, so a task that runs again
    leaves whole files. The result must be read for the files to be written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                part = f"{root}/.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(content.as_buffer() if content.is_valid else b"")
                store.move(part, f"{root}/{name}")
            sizes = [len(c.as_buffer()) if c.is_valid else 0 for c in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], names=["name", "length"])

    return df.select("name", "content").mapInArrow(run, "name string, length long")


def _each(f):
    """A blob column function over batches; f is a small codec."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: None if x is None else f(bytes(x)))

    return run


def gzip_compress(blob, level: int = 6):
    return _each(lambda x: gzip.compress(x, level, mtime=0))(blob)


def gzip_decompress(blob):
    return _each(gzip.decompress)(blob)


def _tar(data: bytes):
    with tarfile.open(fileobj=io.BytesIO(data)) as t:
        for m in t:
            if m.isfile():
                yield m.name, t.extractfile(m).read()


def _zip(data: bytes):
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for name in z.namelist():
            if not name.endswith("/"):
                yield name, z.read(name)


def archive_entries(df: DataFrame, key: str, blob: str, kind: str) -> DataFrame:
    """key, name, content: a row for each file in tar or zip blobs."""
    opener = {"tar": _tar, "zip": _zip}[kind]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, x in zip(b[key], b[blob], strict=True):
                rows = list(opener(bytes(x))) if x is not None else []
                yield pd.DataFrame({key: [k] * len(rows), "name": [n for n, _ in rows], "content": [c for _, c in rows]})

    return df.select(key, blob).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, name string, content binary")


def archive(df: DataFrame, key: str, name: str, blob: str, kind: str) -> DataFrame:
    """key, content: the files of each key as one tar or zip, in order of name.

    An archive is one value of one row, so a key's files must fit in memory together.
    """

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows, out = rows.sort_values(name), io.BytesIO()
        if kind == "zip":
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for n, c in zip(rows[name], rows[blob], strict=True):
                    z.writestr(zipfile.ZipInfo(n), bytes(c))
        else:
            with tarfile.open(fileobj=out, mode="w") as t:
                for n, c in zip(rows[name], rows[blob], strict=True):
                    info = tarfile.TarInfo(n)
                    info.size = len(c)
                    t.addfile(info, io.BytesIO(bytes(c)))
        return pd.DataFrame({key: [rows[key].iloc[0]], "content": [out.getvalue()]})

    return df.select(key, name, blob).groupBy(key).applyInPandas(pack, f"{key} {dict(df.dtypes)[key]}, content binary")


def read_xml(spark: SparkSession, path: str, row_tag: str, schema=None) -> DataFrame:
    """Elements of XML files as rows, by Spark's own reader."""
    reader = spark.read.format("xml").option("rowTag", row_tag)
    return (reader.schema(schema) if schema else reader).load(path)


def parse_xml(text, schema: str):
    """A struct of an XML text column."""
    return F.from_xml(text, schema)


def to_xml(struct, row_tag: str = "row"):
    return F.to_xml(struct, {"rowTag": row_tag})
