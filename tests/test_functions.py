"""Edge cases of column functions."""

import hashlib
import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessella.functions import arrays, blobs, compare, datetimes, dicts, numbers, sets, strings, vectors
from tessella.functions import random as rnd


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def ints(*xs):
    return F.array(*(F.lit(x).cast("long") for x in xs)).cast("array<long>")


def fails(spark, c):
    with pytest.raises(PySparkException):
        one(spark, c)


def test_integer_division_rounds_down(spark):
    for a in (-7, -6, 0, 6, 7):
        for b in (-3, -1, 2, 5):
            x, y = F.lit(a).cast("long") + F.col("id") * 0, F.lit(b).cast("long") + F.col("id") * 0
            assert one(spark, numbers.int_divide(x, y)) == a // b
            assert one(spark, numbers.int_remainder(x, y)) == int(math.fmod(a, b))
    fails(spark, numbers.int_divide(F.col("id"), F.lit(0)))


def test_integer_log_and_power(spark):
    for a in (0, 1, 2, 8, 9, 26, 27, -27, 3**30, 3**30 - 1):
        n, x = 0, abs(a)
        while a and x >= 3:
            n, x = n + 1, x // 3
        assert one(spark, numbers.int_log(F.lit(a).cast("long"), 3)) == n
    assert one(spark, numbers.int_log(F.lit(9).cast("long"), 1)) == 0
    assert one(spark, numbers.int_pow(F.lit(-3).cast("long"), 3)) == -27
    fails(spark, numbers.int_pow(F.lit(2).cast("long"), F.lit(-1)))


def test_float_corners(spark):
    nan = F.lit(float("nan"))
    assert one(spark, numbers.float_sign(nan)) == 0.0
    assert math.isnan(one(spark, numbers.float_remainder(F.lit(3.0), F.lit(0.0))))
    assert one(spark, numbers.float_remainder(F.lit(-7.5), F.lit(2.0))) == -1.5
    for bad in (numbers.float_sqrt(F.lit(-1.0)), numbers.float_log(F.lit(0.0)), numbers.float_exp(F.lit(1e6)), numbers.float_to_int(nan), numbers.float_divide(F.lit(1.0), F.lit(0.0))):
        fails(spark, bad)
    assert one(spark, compare.equal(nan, F.lit(float("nan")))) is True
    order = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),)], "x double").select("x", compare.strict(F.col("x")).alias("k")).orderBy("k").collect()
    assert [str(r["x"]) for r in order] == ["-0.0", "0.0", "nan"]


def test_arrays_empty_and_out_of_range(spark):
    none = ints()
    assert one(spark, arrays.generate(F.lit(0), lambda i: i)) == []
    assert one(spark, arrays.range_(3, 3)) == [] == one(spark, arrays.range_(3, 9, -1))
    assert one(spark, arrays.range_(0, 7, 3)) == [0, 3, 6]
    assert one(spark, arrays.linspace(1, 5, 1)) == [1.0]
    assert one(spark, arrays.try_get(none, 0)) is None
    assert one(spark, arrays.slice_(ints(1, 2, 3), -2, 9)) == [2, 3]
    assert one(spark, arrays.is_sorted(none)) is True
    for bad in (arrays.get(ints(1), 1), arrays.get(ints(1), -1), arrays.pop_last(none), arrays.update(ints(1), 4, 2), arrays.map_reduce(none, lambda x: x, lambda a, b: a + b), arrays.range_(0, 3, 0)):
        fails(spark, bad)


def test_array_sort_is_stable(spark):
    a = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in ((2, "a"), (1, "b"), (2, "c"), (1, "d"))))
    assert [r["v"] for r in one(spark, arrays.sort(a, lambda s: s["k"]))] == ["b", "d", "a", "c"]


def test_sets_and_dicts_raise_where_they_must(spark):
    s = ints(1, 3)
    assert one(spark, sets.insert(s, F.lit(2).cast("long"))) == [1, 2, 3]
    assert one(spark, sets.delete(s, F.lit(3).cast("long"))) == [1]
    fails(spark, sets.insert(s, F.lit(1).cast("long")))
    fails(spark, sets.delete(s, F.lit(9).cast("long")))
    d = dicts.entries(s, lambda k: k * 10)
    assert [tuple(e) for e in one(spark, dicts.merge_all(d, dicts.entries(ints(3, 5), lambda k: k), lambda o, n: o + n, lambda k: k * 100))] == [(1, 10), (3, 33), (5, 505)]
    assert one(spark, dicts.swap(d, F.lit(1).cast("long"), F.lit(7).cast("long"))["old"]) == 10
    assert [tuple(e) for e in one(spark, dicts.merge(d, F.lit(9).cast("long"), F.lit(1).cast("long"), lambda o, n, k: o + n, lambda k: k))] == [(1, 10), (3, 30), (9, 10)]
    assert [tuple(e) for e in one(spark, dicts.from_map(dicts.to_map(d)))] == [(1, 10), (3, 30)]
    for bad in (dicts.get(d, F.lit(2).cast("long")), dicts.insert(d, F.lit(1).cast("long"), F.lit(1).cast("long")), dicts.update(d, F.lit(2).cast("long"), F.lit(1).cast("long")), dicts.delete(d, F.lit(2).cast("long"))):
        fails(spark, bad)


def test_strings(spark):
    s = F.lit(" \t hé llo \n")
    assert one(spark, strings.trim(s)) == " \t hé llo \n".strip()
    assert one(spark, strings.split(F.lit("a.b..c"), ".")) == ["a", "b", "", "c"]
    assert one(spark, strings.split(F.lit("añ🙂"), "")) == ["a", "ñ", "🙂"]
    assert one(spark, strings.split(F.lit(""), "")) == [""]
    assert one(spark, strings.substring(F.lit("abc"), 2, 1)) == ""
    assert one(spark, strings.regex_replace(F.lit("John Smith"), r"(?<a>\w+) (?<b>\w+)", "$<b>, $1 $& $$")) == "Smith, John John Smith $"
    assert one(spark, strings.regex_contains(F.lit("A\nb"), "^B$", "im")) is True
    with pytest.raises(ValueError):
        strings.regex_contains(s, "a", "x")


def test_blobs_and_paths(spark):
    text = F.lit("aé🙂")
    assert bytes(one(spark, blobs.encode_utf16(text))) == b"\xff\xfe" + "aé🙂".encode("utf-16-le")
    assert one(spark, blobs.decode_utf16(F.lit(b"\xfe\xff\x00a"))) == "a"
    assert one(spark, blobs.get_uint8(F.lit(b"\x00\xff"), 1)) == 255
    assert bytes(one(spark, blobs.sha256_bytes(F.lit(b"x")))) == hashlib.sha256(b"x").digest()
    assert len(one(spark, blobs.random_bytes(20))) == 20
    fails(spark, blobs.get_uint8(F.lit(b"a"), 1))
    fails(spark, blobs.decode_utf8(F.lit(b"\xff")))
    import posixpath

    for parts in (("a", "b/../c"), ("/a/", "./b", ""), ("..", "x"), ("/", ".."), ("a", "..")):
        want = posixpath.normpath(posixpath.join(*[p for p in parts if p])) if any(parts) else "."
        assert one(spark, blobs.path_join(*parts)) == want
    assert one(spark, blobs.path_extname(F.lit("/a/b.tar.gz"))) == ".gz"
    assert one(spark, blobs.path_extname(F.lit("/a/.hidden"))) == ""
    assert one(spark, blobs.path_dirname(F.lit("/a"))) == "/"
    assert one(spark, blobs.path_basename(F.lit("/a/b/"))) == "b"


def test_datetimes(spark):
    t = F.lit("2024-02-29 13:05:09.250").cast("timestamp")
    assert one(spark, datetimes.print_format(t, "dddd D MMM YYYY, h:mm A")) == "Thursday 29 Feb 2024, 1:05 PM"
    assert one(spark, datetimes.print_format(t, r"dd [\at] a")) == "Th [at] pm"
    assert one(spark, datetimes.millisecond(t)) == 250
    assert one(spark, datetimes.duration_milliseconds(datetimes.add_milliseconds(t, -1001), t)) == -1001
    assert one(spark, datetimes.time_zone_offset(t, "America/New_York")) == -300
    fails(spark, datetimes.parse_format(F.lit("2024-13-01"), "YYYY-MM-DD"))


def test_vectors_and_matrices(spark):
    m = vectors.vector_to_matrix(F.array(*(F.lit(float(k)) for k in range(6))), 2, 3)
    assert one(spark, vectors.matrix_transpose(m))["data"] == [0, 3, 1, 4, 2, 5]
    assert one(spark, vectors.matrix_map_rows(m, lambda row, r: F.reverse(row)))["data"] == [2, 1, 0, 5, 4, 3]
    assert one(spark, vectors.matrix_set(m, 1, 1, 9.0))["data"][4] == 9
    assert one(spark, vectors.zeros(0)) == []
    for bad in (vectors.matrix_get(m, 2, 0), vectors.vector_to_matrix(F.array(F.lit(1.0)), 2, 2), vectors.matrix_from_array(F.array(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))))):
        fails(spark, bad)


def test_random_distributions(spark):
    n = 20_000
    draws = {
        "uniform": (rnd.uniform(1), 0.5),
        "normal": (rnd.normal(2), 0.0),
        "range": (rnd.range_(3, 7, 3), 5.0),
        "exponential": (rnd.exponential(2.0, 4), 0.5),
        "weibull": (rnd.weibull(1.0, 5), 1.0),
        "bernoulli": (rnd.bernoulli(0.3, 6), 0.3),
        "binomial": (rnd.binomial(10, 0.4, 7), 4.0),
        "geometric": (rnd.geometric(0.25, 30), 4.0),
        "poisson": (rnd.poisson(4.0, 31), 4.0),
        "poisson_large": (rnd.poisson(50.0, 32), 50.0),
        "pareto": (rnd.pareto(4.0, 33), 4 / 3),
        "log_normal": (rnd.log_normal(0.0, 0.5, 34), math.exp(0.125)),
        "irwin_hall": (rnd.irwin_hall(6, 40), 3.0),
        "bates": (rnd.bates(6, 50), 0.5),
    }
    row = spark.range(n).select(*(c.alias(k) for k, (c, _) in draws.items())).agg(*(F.avg(k).alias(k) for k in draws), *(F.stddev(k).alias(f"{k}_sd") for k in draws)).first()
    for k, (_, mean) in draws.items():
        assert abs(row[k] - mean) < 5 * row[f"{k}_sd"] / math.sqrt(n) + 1e-9, k


def test_text_form(spark):
    import datetime as dt

    from pyspark.sql import types as T

    from tessella.functions import text_form as tf

    kind = T.StructType([T.StructField("a", T.LongType()), T.StructField("s", T.StringType()), T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("m", T.MapType(T.StringType(), T.BooleanType())), T.StructField("b", T.BinaryType()), T.StructField("t", T.TimestampType())])
    row = (1, 'q"\\\n', [1.0, 0.5, float("nan"), float("-inf"), 1e22, 1e-7, 123456789.0, 0.001, -0.0], {"z": True, "b": None}, bytearray(b"\x0a"), dt.datetime(2024, 1, 2, 3, 4, 5, 6000))
    df = spark.createDataFrame([(row,)], T.StructType([T.StructField("r", kind)]))
    want = '(a=1, s="q\\"\\\\\n", x=[1.0, 0.5, NaN, -Infinity, 1e+22, 1e-07, 123456789.0, 0.001, -0.0], m={"b":null,"z":true}, b=0x0a, t=2024-01-02T03:04:05.006)'
    assert df.select(tf.print_value(F.col("r"), kind).alias("t")).first()["t"] == want
    for text, k, value in (('"a\\"b\\\\"', T.StringType(), 'a"b\\'), ("-12", T.LongType(), -12), ("1e3", T.DoubleType(), 1000.0), ("0xff", T.BinaryType(), bytearray(b"\xff")), ("null", T.LongType(), None), ("true", T.BooleanType(), True), ("2024-01-02T03:04:05.006", T.TimestampType(), dt.datetime(2024, 1, 2, 3, 4, 5, 6000))):
        assert one(spark, tf.parse_scalar(F.lit(text), k)) == value
    for text, k in (('"a', T.StringType()), ("1.5", T.LongType()), ("yes", T.BooleanType()), ("2024", T.TimestampType())):
        fails(spark, tf.parse_scalar(F.lit(text), k))
    assert one(spark, tf.print_set(ints(1, 2), T.LongType())) == "{1,2}"
    assert one(spark, tf.print_dict(dicts.entries(ints(1), lambda k: k), T.LongType(), T.LongType())) == "{1:1}"
    assert one(spark, tf.print_variant(F.struct(F.lit("none").alias("tag"), F.lit(None).cast("long").alias("some")), {"some": T.LongType()})) == ".none"


def test_dict_changes_keep_order_and_sort_nothing(spark):
    from pyspark.sql import functions as F

    from tessella.functions import dicts as D

    pair = lambda k, v: F.struct(F.lit(k).cast("long").alias("key"), F.lit(v).cast("long").alias("value"))
    d = F.array(pair(2, 20), pair(5, None), pair(9, 90))
    b = F.array(pair(1, 7), pair(5, 3), pair(9, 1))
    got = {
        "put": D.insert_or_update(d, F.lit(4).cast("long"), F.lit(1).cast("long"), lambda old, new, k: old + new),
        "changed": D.update(d, F.lit(5).cast("long"), F.lit(6).cast("long")),
        "merged": D.merge_all(d, b, lambda old, new, k: F.coalesce(old, F.lit(0)) * 100 + new + k, lambda k: k * 10),
        "none": D.get_or_default(d, F.lit(5).cast("long"), lambda k: k),
    }
    df = spark.range(1).select(*(c.alias(n) for n, c in got.items()))
    row = df.first()
    listed = lambda n: [(e["key"], e["value"]) for e in row[n]]
    assert listed("put") == [(2, 20), (4, 1), (5, None), (9, 90)] and listed("changed") == [(2, 20), (5, 6), (9, 90)]
    assert listed("merged") == [(1, 1008), (2, 20), (5, 8), (9, 9010)] and row["none"] is None
    col = F.col("d")
    kept = spark.range(1).select(D.from_map(F.create_map(F.lit(1), F.col("id"))).alias("d"))
    plan = kept.select(D.update(col, F.lit(1), F.lit(5).cast("long")).alias("x"), D.insert_or_update(col, F.lit(1), F.lit(5).cast("long"), lambda o, n, k: n).alias("y"))
    assert plan._jdf.queryExecution().analyzed().toString().split("Project")[1].count("array_sort") == 0
