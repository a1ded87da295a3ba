import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.sources import csvs, documents, files, sql, typed_json

KINDS = T.StructType([T.StructField("k", T.LongType(), False), T.StructField("name", T.StringType()), T.StructField("ok", T.BooleanType()), T.StructField("x", T.DoubleType()), T.StructField("b", T.BinaryType())])


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, 'a "q", b', True, 1.5, b"\x01\xff"), (2, None, False, None, None), (3, "line\nend", None, float("inf"), b"")]
    df = spark.createDataFrame(rows, KINDS)
    text = df.select("k", "name", "ok", F.when(F.col("x") == float("inf"), "Infinity").otherwise(F.col("x").cast("string")).alias("x"), F.concat(F.lit("0x"), F.hex("b")).alias("b"))
    csvs.write_csv(text, str(tmp_path / "c"))
    back = csvs.read_csv(spark, str(tmp_path / "c"), KINDS, strict=True)
    assert sorted(map(tuple, back.collect())) == sorted((k, n, o, x, bytearray(b) if b is not None else None) for k, n, o, x, b in rows)


def test_csv_contract(spark, tmp_path):
    (tmp_path / "a.csv").write_text("key,extra\n1,z\n")
    one = T.StructType([T.StructField("k", T.LongType(), False)])
    with pytest.raises(ValueError):
        csvs.read_csv(spark, str(tmp_path / "a.csv"), one)
    assert csvs.read_csv(spark, str(tmp_path / "a.csv"), one, mapping={"k": "key"}).first()["k"] == 1
    with pytest.raises(ValueError):
        csvs.read_csv(spark, str(tmp_path / "a.csv"), one, mapping={"k": "key"}, strict=True)
    (tmp_path / "b.csv").write_text("k\nTRUE\n")
    for bad in (one, T.StructType([T.StructField("k", T.BooleanType())])):
        with pytest.raises(PySparkException):
            csvs.read_csv(spark, str(tmp_path / "b.csv"), bad).collect()


def test_csv_blob(spark):
    df = spark.createDataFrame([(bytearray("﻿k,x\r\n1,2.5\r\n\r\n3,\r\n".encode()),)], "blob binary")
    kinds = T.StructType([T.StructField("k", T.LongType(), False), T.StructField("x", T.DoubleType())])
    assert sorted(map(tuple, csvs.from_csv_blob(df, "blob", kinds).collect())) == [(1, 2.5), (3, None)]


def test_typed_json(spark):
    kind = T.StructType([T.StructField("n", T.LongType()), T.StructField("at", T.TimestampType()), T.StructField("b", T.BinaryType()), T.StructField("m", T.MapType(T.StringType(), T.LongType())), T.StructField("a", T.ArrayType(T.DoubleType()))])
    df = spark.createDataFrame([((2**60, dt.datetime(2024, 1, 2, 3, 4, 5, 678000), bytearray(b"\x0a"), {"z": 1, "a": 2}, [1.0, 2.5]),)], T.StructType([T.StructField("r", kind)]))
    text = df.select(typed_json.print_json(F.col("r"), kind).alias("t"))
    assert text.first()["t"] == '{"n":"1152921504606846976","at":"2024-01-02T03:04:05.678Z","b":"0x0a","m":[{"key":"a","value":"2"},{"key":"z","value":"1"}],"a":[1.0,2.5]}'
    assert text.select(typed_json.parse_json(F.col("t"), kind).alias("r")).first()["r"] == df.first()["r"]


def test_variants(spark):
    cases = {"income": "double", "note": "string"}
    df = spark.range(1).select(typed_json.variant("income", cases, F.lit(2.0)).alias("v"))
    assert df.select(typed_json.match(F.col("v"), income=lambda x: x * 2, note=lambda s: F.length(s).cast("double")).alias("x")).first()["x"] == 4
    with pytest.raises(PySparkException):
        df.select(typed_json.match(F.col("v"), note=lambda s: s)).collect()


def test_sql_contract(spark):
    kinds = T.StructType([T.StructField("a", T.DoubleType(), False)])
    assert sql.select(spark, "SELECT 1L AS a, 2 AS b", kinds).first()["a"] == 1.0
    with pytest.raises(ValueError):
        sql.select(spark, "SELECT 1 AS b", kinds)
    with pytest.raises(ValueError):
        sql.select(spark, "SELECT 'x' AS a", kinds)
    with pytest.raises(PySparkException):
        sql.select(spark, "SELECT CAST(NULL AS DOUBLE) AS a", kinds).collect()
    assert sql.query(spark, "SELECT ? + 1 AS x", [4]).first()["x"] == 5
    cells = sql.cells(sql.query(spark, "SELECT 1 AS b, NULL AS a, 'x' AS c")).first()["cells"]
    assert [(c["key"], c["value"]["tag"]) for c in cells] == [("a", "Null"), ("b", "Integer"), ("c", "String")]


def test_documents(spark):
    df = spark.createDataFrame([(k, k % 3, f"n{k}") for k in range(9)], "k long, g long, n string")
    assert [r["k"] for r in documents.find(df, {"$or": [{"g": 1}, {"k": {"$gte": 8}}]}, ["k"], skip=1).collect()] == [4, 7, 8]
    assert documents.delete_one(df, {"g": 2}, "k").count() == 8
    assert documents.find_one(documents.update_one(df, {"g": 2}, {"$set": {"n": "x"}}, "k"), {"n": "x"}, ["k"]).first()["k"] == 2
    assert documents.insert(df, [{"k": 10, "g": 0, "n": None}]).count() == 10


def test_archives_and_files(spark, tmp_path):
    df = spark.createDataFrame([("a", "x.txt", bytearray(b"one")), ("a", "y.txt", bytearray(b"two")), ("b", "z", bytearray(b""))], "k string, name string, content binary")
    for kind in ("zip", "tar"):
        packed = files.archive(df, "k", "name", "content", kind)
        assert sorted((r["k"], r["name"], bytes(r["content"])) for r in files.archive_entries(packed, "k", "content", kind).collect()) == [("a", "x.txt", b"one"), ("a", "y.txt", b"two"), ("b", "z", b"")]
    same = df.select("content", files.gzip_decompress(files.gzip_compress(F.col("content"))).alias("c"))
    assert all(bytes(r["content"]) == bytes(r["c"]) for r in same.collect())
    folder = str(tmp_path / "f")
    files.make_directory(spark, folder)
    (tmp_path / "f" / "t.txt").write_text("hi")
    assert files.is_directory(spark, folder) and files.is_file(spark, folder + "/t.txt")
    assert bytes(files.read_blobs(spark, folder + "/t.txt").first()["content"]) == b"hi"
    assert files.read_texts(spark, folder).first()["value"] == "hi"
    assert files.delete(spark, folder + "/t.txt") and not files.exists(spark, folder + "/t.txt")


def test_xml(spark):
    df = spark.createDataFrame([("<r><a>1</a><b>x &amp; y</b></r>",)], "t string")
    assert tuple(df.select(files.parse_xml(F.col("t"), "a long, b string").alias("s")).first()["s"]) == (1, "x & y")
