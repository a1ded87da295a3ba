"""Queries over the rest of the collection, comparison, vector, text, file, random and model members."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as K

from tessella.functions import arrays as A
from tessella.functions import blobs as B
from tessella.functions import compare as C
from tessella.functions import datetimes as DT
from tessella.functions import dicts as D
from tessella.functions import numbers as N
from tessella.functions import random as R
from tessella.functions import sets as S
from tessella.functions import strings as ST
from tessella.functions import text_form as TF
from tessella.functions import vectors as V
from tessella.operators import metrics, models
from tessella.plans.nested import _SQL_DICTS, _SQL_LISTS, _SQL_SETS, _dict_text, _dicts, _dj, _j, _lists, _sets, _text
from tessella.session import shared_folder
from tessella.session import table as T
from tessella.sources import csvs, documents, files


def _long(x):
    return F.lit(x).cast("long")


def _pair(k, v):
    return F.struct(k.cast("long").alias("key"), v.cast("long").alias("value"))


def array_rest_suite(spark, d):
    a = F.col("a")
    return _lists(spark, d).select(
        "l_orderkey",
        _text(A.concat(a, A.reverse(a))).alias("mirrored"),
        _text(A.copy(a)).alias("copied"),
        _dict_text(A.flatten_to_dict(a, lambda x: F.array(_pair(x % 3, x), _pair(x % 5, -x)), lambda old, new, k: F.greatest(old, new))).alias("flat"),
    )


def set_make_suite(spark, d):
    s, t = F.col("s"), F.col("t")
    return _sets(spark, d).select(
        "l_orderkey",
        _text(S.generate(F.size(s) * 3, lambda i: i % 4)).alias("generated"),
        _text(S.insert(s, _long(99))).alias("inserted"),
        _text(S.delete(s, F.get(s, F.lit(0)))).alias("deleted"),
        S.size(S.clear(s)).alias("cleared"),
        _text(S.copy(s)).alias("copied"),
        S.first_map(s, lambda x: F.when(x % 2 == 1, x * 10)).alias("first_odd"),
        S.map_reduce(s, lambda x: x + 1, lambda p, q: p * 2 + q).alias("reduced"),
        _text(S.to_array(s, lambda x: x * x)).alias("listed"),
        _text(S.to_set(s, lambda x: x % 3)).alias("kinds"),
        _dict_text(S.to_dict(s, lambda x: x % 4, lambda x: x, lambda old, new, k: F.greatest(old, new))).alias("keyed"),
        _text(S.flatten_to_array(s, lambda x: F.array(x, x + 100))).alias("flat"),
        _text(S.flatten_to_set(s, lambda x: F.array(x % 2, x % 3))).alias("flat_set"),
        _dict_text(S.flatten_to_dict(s, lambda x: F.array(_pair(x % 2, x)), lambda old, new, k: F.least(old, new))).alias("flat_dict"),
        _dict_text(S.group_fold(t, lambda x: x % 3, lambda k: k * 1000, lambda acc, x: acc + x)).alias("grouped"),
    )


def dict_change_suite(spark, d):
    c = F.col("d")
    top = F.get(D.keys(c), F.lit(0))
    other = F.array(_pair(_long(1), _long(500)), _pair(_long(9), _long(900)))
    got, swapped, popped = D.get_or_insert(c, _long(6), lambda k: k * 11), D.swap(c, top, _long(77)), D.pop(c, top)
    return _dicts(spark, d).select(
        "l_orderkey",
        D.get(c, top).alias("got"),
        _dict_text(D.get_keys(c, F.array(_long(1), _long(8)), lambda k: k * -1)).alias("gathered"),
        _dict_text(D.insert(c, _long(50), _long(5))).alias("inserted"),
        got["value"].alias("sixth"),
        _dict_text(got["dict"]).alias("with_sixth"),
        _dict_text(D.update(c, top, _long(33))).alias("updated"),
        swapped["old"].alias("swapped_out"),
        _dict_text(swapped["dict"]).alias("swapped"),
        _dict_text(D.merge(c, _long(2), _long(7), lambda old, new, k: old * 10 + new + k, lambda k: k * 100)).alias("merged"),
        _dict_text(D.delete(c, top)).alias("deleted"),
        popped["value"].alias("popped_out"),
        _dict_text(popped["dict"]).alias("popped"),
        D.size(D.clear(c)).alias("cleared"),
        _dict_text(D.copy(c)).alias("copied"),
        _dict_text(D.merge_all(c, other, lambda old, new, k: old * 1000 + new, lambda k: k)).alias("merged_all"),
    )


def dict_map_suite(spark, d):
    c = F.col("d")
    return _dicts(spark, d).select(
        "l_orderkey",
        _dict_text(D.generate(F.size(c), lambda i: i % 3, lambda i: i * i, lambda old, new, k: old + new)).alias("generated"),
        _dict_text(D.filter_map(c, lambda v, k: F.when(v > 25, v * k))).alias("high"),
        D.map_reduce(c, lambda v, k: v + k, lambda p, q: p * 2 % 1009 + q).alias("reduced"),
        _text(D.flatten_to_array(c, lambda v, k: F.array(k, v))).alias("flat"),
        _text(D.flatten_to_set(c, lambda v, k: F.array(v % 3, k % 2))).alias("flat_set"),
        _dict_text(D.flatten_to_dict(c, lambda v, k: F.array(_pair(v % 4, k)), lambda old, new, k: F.greatest(old, new))).alias("flat_dict"),
    )


def compare_suite(spark, d):
    """Numbers with NaN and null, texts and arrays against each other."""
    n = F.when(F.col("l_linenumber") % 5 == 0, F.lit(float("nan"))).when(F.col("l_linenumber") % 7 == 0, None).otherwise(F.col("l_quantity"))
    m = F.when(F.col("l_suppkey") % 4 == 0, F.lit(float("nan"))).when(F.col("l_suppkey") % 9 == 0, None).otherwise(F.col("l_linenumber") * 9.0)
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    one, two = F.array(F.col("l_linenumber").cast("long"), F.col("l_suppkey")), F.array(F.lit(3).cast("long"))
    return T(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        C.is_(n, m).alias("same"), C.equal(n, m).alias("eq"), C.not_equal(n, m).alias("ne"),
        C.less(n, m).alias("lt"), C.less_equal(n, m).alias("le"), C.greater(n, m).alias("gt"), C.greater_equal(n, m).alias("ge"),
        C.less(flag, status).alias("text_lt"), C.greater_equal(flag, status).alias("text_ge"), C.equal(flag, status).alias("text_eq"),
        C.less(one, two).alias("list_lt"), C.greater(one, two).alias("list_gt"), C.is_(one, one).alias("list_is"),
    )


def scalar_rest_suite(spark, d):
    name = F.concat(F.lit(" \t"), F.col("p_name"), F.lit(" \n"))
    frames = F.array(F.struct(F.col("p_brand").alias("file"), F.col("p_size").alias("line"), F.lit(3).alias("column")))
    return T(spark, d, "part").select(
        "p_partkey",
        ST.trim_start(name).alias("from_start"),
        ST.trim_end(name).alias("to_end"),
        ST.print_error(F.col("p_name"), frames).alias("error"),
        N.int_to_float(F.col("p_partkey")).alias("as_float"),
        F.round(N.tan(F.col("p_size") / 40.0), 6).alias("tangent"),
        DT.to_epoch_milliseconds(DT.from_epoch_milliseconds(F.col("p_partkey") * 86_400_123)).alias("epoch"),
        TF.parse_scalar(F.col("p_size").cast("string"), K.LongType()).alias("parsed_long"),
        TF.parse_scalar(F.concat(F.lit('"'), F.col("p_name"), F.lit('"')), K.StringType()).alias("parsed_text"),
        TF.parse_scalar((F.col("p_size") > 20).cast("string"), K.BooleanType()).alias("parsed_flag"),
    )


def path_rest_suite(spark, d):
    return T(spark, d, "pages").select(
        "page_id",
        B.path_join(F.lit("a/./b"), F.lit(""), F.col("page_id").cast("string"), F.lit("../c")).alias("joined"),
        B.path_join(F.lit("/x"), F.concat(F.lit("y//"), F.col("page_id").cast("string"))).alias("rooted"),
        B.path_resolve(F.concat(F.lit("n/"), F.col("page_id").cast("string")), "/base").alias("from_base"),
        B.path_resolve(F.concat(F.lit("/abs/"), F.col("page_id").cast("string")), "/base").alias("absolute"),
    )


def vector_make_suite(spark, d):
    v = V.from_array(F.col("embedding"))
    return T(spark, d, "embeddings").select(
        "vec_id",
        F.round(V.get(V.set_(v, 2, F.lit(5.5)), 2), 5).alias("set_there"),
        F.round(V.get(V.set_(v, 2, F.lit(5.5)), 1), 5).alias("beside"),
        F.size(V.to_array(v)).alias("n"),
        F.round(V.dot(v, V.ones(F.size(v))), 5).alias("total"),
        F.round(V.dot(v, V.fill(F.size(v), 2.0)), 5).alias("twice"),
    )


def matrix_make_suite(spark, d):
    n = F.size("embedding")
    m = V.vector_to_matrix(F.col("embedding").cast("array<double>"), F.lit(4), (n / 4).cast("int"))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
    return T(spark, d, "embeddings").select(
        "vec_id",
        F.round(V.matrix_get(V.matrix_set(m, 1, 2, F.lit(9.0)), 1, 2), 5).alias("set_there"),
        F.round(total(V.matrix_to_vector(m)), 5).alias("total"),
        total(V.matrix_to_vector(V.matrix_zeros(3, 5))).alias("zeros"),
        total(V.matrix_to_vector(V.matrix_ones(3, 5))).alias("ones"),
        total(V.matrix_to_vector(V.matrix_fill(2, 4, 2.5))).alias("filled"),
        F.round(V.matrix_get(V.matrix_map_rows(m, lambda row, r: F.transform(row, lambda x: x * (r + 1))), 3, 1), 5).alias("mapped"),
        F.size(V.matrix_to_rows(m)).alias("n_rows"),
        F.round(V.matrix_get(V.matrix_from_rows(F.reverse(V.matrix_to_rows(m))), 0, 0), 5).alias("turned"),
    )


_CUSTOMER = K.StructType([K.StructField("c_custkey", K.LongType(), False), K.StructField("c_name", K.StringType()), K.StructField("c_acctbal", K.DoubleType()), K.StructField("c_mktsegment", K.StringType())])


def csv_file_round_trip(spark, d):
    path = f"{shared_folder(spark, 'csv')}/customers"
    csvs.write_csv(T(spark, d, "customer").select(*_CUSTOMER.names), path)
    return csvs.read_csv(spark, path, _CUSTOMER)


def csv_blob_rows(spark, d):
    """A CSV text per region, decoded again."""
    lines = T(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.concat_ws(";", F.col("n_nationkey").cast("string"), F.col("n_name")))).alias("lines"))
    blobs = lines.select(F.encode(F.concat(F.lit("n_nationkey;n_name\n"), F.array_join("lines", "\n")), "utf-8").alias("blob"))
    return csvs.from_csv_blob(blobs, "blob", K.StructType([K.StructField("n_nationkey", K.LongType()), K.StructField("n_name", K.StringType())]), ";")


def file_suite(spark, d):
    """Texts written, added to, read, listed and removed, told in one row."""
    top = shared_folder(spark, "files")
    files.make_directory(spark, top)
    made = files.is_directory(spark, top) and not files.is_file(spark, top)
    lines = T(spark, d, "nation").select("n_name")
    files.write_texts(lines, f"{top}/names")
    files.write_texts(lines, f"{top}/names", append=True)
    listed = files.list_files(spark, f"{top}/names")
    n_files = listed.where("path like '%part-%' and length > 0").count() > 0
    some = listed.where("length > 0").first()["path"]
    seen = files.exists(spark, some) and files.is_file(spark, some)
    read = spark.read.text(f"{top}/names").agg(F.count("*").alias("n_lines"), F.countDistinct("value").alias("n_names")).first()
    sizes = files.read_blobs(spark, f"{top}/names").agg(F.sum("length").alias("n_bytes")).first()["n_bytes"]
    whole = files.read_texts(spark, f"{top}/names").agg(F.sum(F.length("value")).alias("n")).first()["n"]
    gone = files.delete(spark, top) and not files.exists(spark, top)
    schema = "made boolean, listed boolean, seen boolean, n_lines long, n_names long, n_bytes long, n_chars long, gone boolean"
    return spark.createDataFrame([(made, n_files, seen, read["n_lines"], read["n_names"], sizes, whole, gone)], schema)


def document_one_suite(spark, d):
    nation = T(spark, d, "nation")
    more = documents.insert(nation, [{"n_nationkey": 90, "n_name": "ATLANTIS", "n_regionkey": 2}])
    changed = documents.update_one(more, {"n_regionkey": 2}, {"$set": {"n_name": "first of two"}}, "n_nationkey")
    less = documents.delete_one(changed, {"n_regionkey": 3}, "n_nationkey")
    found = documents.find_one(less, {"n_regionkey": {"$gte": 2}}, ["n_nationkey"])
    return less.withColumn("found", F.lit(False)).unionByName(found.withColumn("found", F.lit(True)))


def random_suite(spark, d):
    """Whether the draws of each distribution keep their bounds and come near their mean."""
    draws = {
        "uniform": (R.uniform(1), 0.0, 1.0, 0.5, 0.29),
        "normal": (R.normal(2), -9.0, 9.0, 0.0, 1.0),
        "range": (R.range_(3, 7, 3), 3, 7, 5.0, 1.42),
        "exponential": (R.exponential(2.0, 4), 0.0, 1e9, 0.5, 0.5),
        "weibull": (R.weibull(2.0, 5), 0.0, 1e9, 0.8862, 0.47),
        "bernoulli": (R.bernoulli(0.3, 6), 0, 1, 0.3, 0.46),
        "binomial": (R.binomial(6, 0.25, 7), 0, 6, 1.5, 1.07),
        "geometric": (R.geometric(0.4, 8), 1, 1e9, 2.5, 1.94),
        "poisson": (R.poisson(3.5, 9), 0, 1e9, 3.5, 1.88),
        "poisson_large": (R.poisson(80.0, 10), 0, 1e9, 80.0, 8.95),
        "pareto": (R.pareto(4.0, 11), 1.0, 1e9, 1.3333, 0.48),
        "log_normal": (R.log_normal(0.0, 0.5, 12), 0.0, 1e9, 1.1331, 0.61),
        "irwin_hall": (R.irwin_hall(4, 13), 0.0, 4.0, 2.0, 0.58),
        "bates": (R.bates(4, 14), 0.0, 1.0, 0.5, 0.15),
    }
    rows = T(spark, d, "lineitem").select(*(x.cast("double").alias(k) for k, (x, *_) in draws.items()))
    # Six standard errors of the mean.
    fits = lambda k, lo, hi, mean, dev: (F.min(k) >= lo) & (F.max(k) <= hi) & (F.abs(F.avg(k) - mean) < 6 * dev / F.sqrt(F.count(k))) & (F.abs(F.stddev(k) / dev - 1) < 0.2)
    return rows.agg(*(fits(k, *how).alias(k) for k, (_, *how) in draws.items()))


def chance_suite(spark, d):
    """Ids and bytes are of their form and don't repeat; now is now."""
    rows = T(spark, d, "orders").select("o_orderkey", B.uuid().alias("u"), F.hex(B.random_bytes(16)).alias("b"), DT.now_milliseconds().alias("t"))
    return rows.agg(
        (F.countDistinct("u") == F.count("*")).alias("distinct_ids"),
        F.min(F.col("u").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")).alias("id_form"),
        (F.countDistinct("b") == F.count("*")).alias("distinct_bytes"),
        (F.min(F.length("b")) == F.lit(32)).alias("byte_count"),
        F.min(F.abs(F.unix_millis(F.current_timestamp()) - F.col("t")) < 3_600_000).alias("recent"),
    )


def metrics_of_targets(spark, d):
    rows = T(spark, d, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1000).alias("p"), (F.col("l_tax") * 100).alias("z"), (F.col("l_discount") * 100).alias("q"))
    out = metrics.regression_multi(rows, {"price": ("y", "p"), "share": ("z", "q")}, ["mse", "mae"])
    return out.select("target", F.round("mse", 3).alias("mse"), F.round("mae", 5).alias("mae"))


def class_metrics_of_targets(spark, d):
    rows = T(spark, d, "lineitem").select((F.col("l_linenumber") % 3).alias("a"), (F.col("l_suppkey") % 3).alias("b"), (F.col("l_partkey") % 2).alias("c"), (F.col("l_orderkey") % 2).alias("e"))
    out = metrics.classification_multi(rows, {"three": ("a", "b"), "two": ("c", "e")})
    return out.select("target", F.round("accuracy", 6).alias("accuracy"))


def curve_of_line(spark, d):
    """A line through points on one."""
    rows = T(spark, d, "part").select(F.col("p_size").cast("double").alias("x"), (F.col("p_size") * 2.5 + 4).alias("y"))
    fit = models.curve_fit(rows, "x", "y", "linear", [1.0, 0.0])
    return spark.createDataFrame([(round(fit["params"][0], 4) + 0.0, round(fit["params"][1], 3) + 0.0, fit["r_squared"] > 0.999, fit["success"])], "slope double, offset double, close boolean, success boolean")


def model_suite(spark, d):
    """What holds of any fit: forms, sums, bounds and coverage."""
    rows = T(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), (F.col("p_partkey") % 7).cast("double").alias("z"), (F.col("p_size") * 3.0 + F.col("p_partkey") % 7).alias("y"), (F.col("p_size") > 25).cast("int").alias("big"))
    trained, held, rest = (rows.where(f"p_partkey % 3 = {k}") for k in range(3))
    regressor = models.boosted_regressor(trained, ["x", "z"], "y", rounds=5)
    predicted = models.predict(regressor, rest, ["x", "z"])
    near = predicted.agg(F.avg(F.abs(F.col("prediction") - F.col("y"))) < 20).first()[0]
    width = models.conformal_width(models.predict(regressor, held, ["x", "z"]), "y", 0.9)
    ranged = models.conformal_interval(predicted, width).agg(F.min(F.col("lower") <= F.col("upper")), F.avg((F.col("y").between(F.col("lower"), F.col("upper"))).cast("int")) > 0.6).first()
    classifier = models.boosted_classifier(trained, ["x"], "big", rounds=3)
    classes = models.predict(classifier, rest, ["x"])
    known = classes.agg(F.avg((F.col("prediction") == F.col("big")).cast("int")) > 0.8, F.max(F.abs(F.aggregate("probability", F.lit(0.0), lambda s, p: s + p) - 1)) < 1e-9).first()
    sets = models.conformal_sets(classes, models.predict(classifier, held, ["x"]), "big", 0.9).agg(F.min(F.size("set")) >= 0, F.avg(F.array_contains("set", F.col("big").cast("long")).cast("int")) > 0.6).first()
    chain = models.predict_chain(models.regressor_chain(trained.withColumn("w", F.col("y") * 2), ["x", "z"], ["y", "w"], rounds=3), rest)
    mixed = models.mixture(rows, ["x"], 2, seed=1, iterations=10)
    criteria = models.mixture_criteria(mixed, 1, rows.count())
    mass = models.predict(mixed, rows, ["x"]).agg(F.max(F.abs(F.aggregate("probability", F.lit(0.0), lambda s, p: s + p) - 1)) < 1e-6, F.countDistinct("prediction") == 2).first()
    scores = models.mixture_scores(mixed, rows, ["x"]).agg(F.abs(F.sum("score") - float(mixed.summary.logLikelihood)) < 0.05 * abs(float(mixed.summary.logLikelihood))).first()[0]
    drawn = models.mixture_sample(spark, mixed, 500, ["x"], seed=3).agg(F.count("*") == 500, F.avg("x").between(15, 36)).first()
    out = [near, *ranged, *known, *sets, {"y", "w"} <= set(chain.columns), criteria["bic"] > criteria["aic"], *mass, scores, *drawn]
    names = ["near", "ordered", "covered", "classes", "shares", "sized", "held", "chained", "criteria", "mass", "both_parts", "scores", "drawn", "drawn_mean"]
    return spark.createDataFrame([tuple(map(bool, out))], ", ".join(f"{n} boolean" for n in names))


def ordinal_codes_of_other_rows(spark, d):
    """An encoder fitted on all customers, applied to those of one nation."""
    from tessella.operators import preprocess

    customers = T(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    fitted = preprocess.ordinal_fit(customers, ["c_mktsegment", "c_nationkey"])
    return preprocess.ordinal_apply(customers.where("c_nationkey > 12"), fitted).select("c_custkey", F.col("c_mktsegment_code").alias("segment"), F.col("c_nationkey_code").alias("nation"))


def quantile_suite(spark, d):
    """Shares below fitted quantile lines, coverage and widths of calibrated intervals, bounds of uncertainty."""
    rows = T(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").alias("x"), (F.col("l_quantity") * 10 + F.col("l_quantity") * (F.col("l_partkey") % 17)).alias("y"), (F.col("l_quantity") > 25).cast("int").alias("big"))
    trained, held, rest = (rows.where(f"l_orderkey % 3 = {k}") for k in range(3))
    fitted, width = models.conformal_quantile_fit(trained, held, ["x"], "y", 0.8)
    below = models.quantile_predict(trained, fitted).agg(*(F.abs(F.avg((F.col("y") <= F.get("quantiles", F.lit(k))).cast("int")) - q) < 0.07 for k, q in enumerate(sorted(fitted)))).first()
    ranged = models.interval_uncertainty(models.conformal_quantile_interval(rest, fitted, width))
    inside = ranged.agg(F.abs(F.avg(F.col("y").between(F.col("lower"), F.col("upper")).cast("int")) - 0.8) < 0.07, F.corr("x", "uncertainty") > 0.9).first()
    classes = models.class_uncertainty(models.predict(models.boosted_classifier(trained, ["x"], "big", rounds=2), rest, ["x"]))
    bounds = classes.agg(F.min(F.col("uncertainty").between(0, 1.0000001))).first()[0]
    return spark.createDataFrame([tuple(map(bool, (*below, *inside, bounds)))], "low boolean, median boolean, high boolean, covered boolean, wider boolean, bounded boolean")


def blob_files(spark, d):
    """Binary files written from rows and read back."""
    top = shared_folder(spark, "blobs")
    rows = T(spark, d, "nation").select(F.concat(F.col("n_nationkey").cast("string"), F.lit(".bin")).alias("name"), F.encode("n_name", "utf-8").alias("content"))
    files.write_blobs(rows, top).count()
    return files.read_blobs(spark, top).select(F.substring_index("path", "/", -1).alias("name"), F.decode("content", "utf-8").alias("text"), "length")


def statement_results(spark, d):
    """Statements of each kind and their result variants."""
    from tessella.sources import sql

    top = shared_folder(spark, "sql")
    T(spark, d, "nation").createOrReplaceTempView("statement_nation")
    made = sql.execute(spark, "CREATE OR REPLACE TEMP VIEW statement_few AS SELECT * FROM statement_nation WHERE n_regionkey = 1")
    chosen = sql.execute(spark, "SELECT n_name, n_nationkey FROM statement_few WHERE n_nationkey < :most", {"most": 20})
    put = sql.execute(spark, f"INSERT OVERWRITE DIRECTORY '{top}' USING parquet SELECT n_name FROM statement_few")
    back = spark.read.parquet(top).select(F.lit("read").alias("tag"), F.col("n_name").alias("text"))
    name = F.get(F.filter("cells", lambda c: c["key"] == "n_name"), F.lit(0))["value"]["String"]
    return made.unionByName(put).unionByName(chosen).select("tag", name.alias("text")).unionByName(back)


def _true(*names: str) -> str:
    return "SELECT " + ", ".join(f'TRUE AS "{n}"' for n in names)


_NUMBERS = """WITH r AS (SELECT *, CASE WHEN l_linenumber % 5 = 0 THEN 'nan'::DOUBLE WHEN l_linenumber % 7 = 0 THEN NULL ELSE l_quantity END n,
CASE WHEN l_suppkey % 4 = 0 THEN 'nan'::DOUBLE WHEN l_suppkey % 9 = 0 THEN NULL ELSE l_linenumber * 9.0::DOUBLE END m FROM lineitem) """

QUERIES_SQL = {
    array_rest_suite: _SQL_LISTS
    + f""", p AS (SELECT l_orderkey, unnest(flatten([[{{'k': x % 3, 'v': x}}, {{'k': x % 5, 'v': -x}}] for x in a])) e FROM l), q AS (SELECT l_orderkey, e.k k, max(e.v) v FROM p GROUP BY 1, 2)
SELECT l_orderkey, {_j("list_concat(a, list_reverse(a))")} mirrored, {_j("a")} copied, flat FROM l JOIN (SELECT l_orderkey, string_agg(k || '=' || v, ',' ORDER BY k) flat FROM q GROUP BY 1) USING (l_orderkey)""",
    set_make_suite: _SQL_SETS
    + f""", m AS (SELECT l_orderkey, string_agg(k || '=' || v, ',' ORDER BY k) keyed FROM (SELECT l_orderkey, x % 4 k, max(x) v FROM (SELECT l_orderkey, unnest(s) x FROM s) GROUP BY 1, 2) GROUP BY 1),
f AS (SELECT l_orderkey, string_agg(k || '=' || v, ',' ORDER BY k) flat_dict FROM (SELECT l_orderkey, x % 2 k, min(x) v FROM (SELECT l_orderkey, unnest(s) x FROM s) GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT l_orderkey, string_agg(k || '=' || v, ',' ORDER BY k) grouped FROM (SELECT l_orderkey, x % 3 k, CAST(x % 3 * 1000 + sum(x) AS BIGINT) v FROM (SELECT l_orderkey, unnest(t) x FROM s) GROUP BY 1, x % 3) GROUP BY 1)
SELECT l_orderkey, {_j("list_sort(list_distinct([i % 4 for i in range(0, len(s) * 3)]))")} AS generated, {_j("list_append(s, 99)")} inserted, {_j("s[2:]")} deleted, CAST(0 AS BIGINT) cleared, {_j("s")} copied,
[x * 10 for x in s if x % 2 = 1][1] first_odd, list_reduce([x + 1 for x in s], lambda p, q: p * 2 + q) reduced, {_j("[x * x for x in s]")} listed, {_j("list_sort(list_distinct([x % 3 for x in s]))")} kinds, keyed,
{_j("flatten([[x, x + 100] for x in s])")} flat, {_j("list_sort(list_distinct(flatten([[x % 2, x % 3] for x in s])))")} flat_set, flat_dict, grouped FROM s JOIN m USING (l_orderkey) JOIN f USING (l_orderkey) JOIN g USING (l_orderkey)""",
    dict_change_suite: _SQL_DICTS
    + f"""SELECT l_orderkey, d[1].v got, '1=' || coalesce([x.v for x in d if x.k = 1][1], -1) || ',8=' || coalesce([x.v for x in d if x.k = 8][1], -8) gathered, {_dj("list_append(d, {'k': 50, 'v': 5})")} inserted,
coalesce([x.v for x in d if x.k = 6][1], 66) sixth, {_dj("list_sort(list_concat([y for y in d if y.k <> 6], [{'k': 6, 'v': coalesce([x.v for x in d if x.k = 6][1], 66)}]))")} with_sixth,
{_dj("list_prepend({'k': d[1].k, 'v': 33}, d[2:])")} updated, d[1].v swapped_out, {_dj("list_prepend({'k': d[1].k, 'v': 77}, d[2:])")} swapped,
{_dj("list_sort(list_concat([y for y in d if y.k <> 2], [{'k': 2, 'v': coalesce([z.v for z in d if z.k = 2][1], 200) * 10 + 9}]))")} AS merged,
{_dj("d[2:]")} deleted, d[1].v popped_out, {_dj("d[2:]")} popped, CAST(0 AS BIGINT) cleared, {_dj("d")} copied,
{_dj("list_sort(list_concat([y for y in d if y.k <> 1], [{'k': 1, 'v': coalesce([z.v for z in d if z.k = 1][1], 1) * 1000 + 500}, {'k': 9, 'v': 9900}]))")} merged_all FROM d""",
    dict_map_suite: _SQL_DICTS
    + f""", f AS (SELECT l_orderkey, string_agg(q || '=' || v, ',' ORDER BY q) flat_dict FROM (SELECT l_orderkey, v % 4 q, max(k) v FROM e GROUP BY 1, 2) GROUP BY 1),
n AS (SELECT l_orderkey, i % 3 q, CAST(sum(i * i) AS BIGINT) v FROM (SELECT l_orderkey, unnest(range(0, len(d))) i FROM d) GROUP BY 1, 2), g AS (SELECT l_orderkey, string_agg(q || '=' || v, ',' ORDER BY q) AS generated FROM n GROUP BY 1)
SELECT d.l_orderkey, g.generated, {_dj("[{'k': y.k, 'v': y.v * y.k} for y in d if y.v > 25]")} high, list_reduce([y.v + y.k for y in d], lambda p, q: p * 2 % 1009 + q) reduced, {_j("flatten([[y.k, y.v] for y in d])")} flat,
{_j("list_sort(list_distinct(flatten([[y.v % 3, y.k % 2] for y in d])))")} flat_set, flat_dict FROM d JOIN f USING (l_orderkey) JOIN g USING (l_orderkey)""",
    compare_suite: _NUMBERS
    + """SELECT l_orderkey, l_linenumber, l_partkey, n IS NOT DISTINCT FROM m same, n IS NOT DISTINCT FROM m eq, n IS DISTINCT FROM m ne, n < m lt, n <= m le, n > m gt, n >= m ge,
l_returnflag < l_linestatus text_lt, l_returnflag >= l_linestatus text_ge, l_returnflag = l_linestatus text_eq, l_linenumber < 3 list_lt, l_linenumber >= 3 list_gt, TRUE list_is FROM r""",
    scalar_rest_suite: """SELECT p_partkey, p_name || chr(32) || chr(10) from_start, chr(32) || chr(9) || p_name to_end, 'Error: ' || p_name || chr(10) || '  1. ' || p_brand || ' ' || p_size || ':3' AS error, CAST(p_partkey AS DOUBLE) as_float,
round(tan(p_size / 40.0), 6) tangent, p_partkey * 86400123 epoch, CAST(p_size AS BIGINT) parsed_long, p_name parsed_text, p_size > 20 parsed_flag FROM part""",
    path_rest_suite: "SELECT page_id, 'a/b/c' joined, '/x/y/' || page_id rooted, '/base/n/' || page_id from_base, '/abs/' || page_id absolute FROM pages",
    vector_make_suite: """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) e FROM embeddings) SELECT vec_id, 5.5::DOUBLE set_there, round(e[2], 5) beside, CAST(len(e) AS INTEGER) n, round(list_sum(e), 5) total, round(2 * list_sum(e), 5) twice FROM v""",
    matrix_make_suite: """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) e FROM embeddings) SELECT vec_id, 9.0::DOUBLE set_there, round(list_sum(e), 5) total, 0.0::DOUBLE zeros, 15.0::DOUBLE ones, 20.0::DOUBLE filled,
round(e[len(e) // 4 * 3 + 2] * 4, 5) mapped, CAST(4 AS INTEGER) n_rows, round(e[len(e) // 4 * 3 + 1], 5) turned FROM v""",
    csv_file_round_trip: "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer",
    csv_blob_rows: "SELECT CAST(n_nationkey AS BIGINT) n_nationkey, n_name FROM nation",
    file_suite: """SELECT TRUE made, TRUE listed, TRUE seen, 2 * count(*) n_lines, count(DISTINCT n_name) n_names, CAST(2 * sum(strlen(n_name) + 1) AS BIGINT) n_bytes, CAST(2 * sum(length(n_name) + 1) AS BIGINT) n_chars, TRUE gone FROM nation""",
    document_one_suite: """WITH m AS (SELECT * FROM nation UNION ALL SELECT 90, 'ATLANTIS', 2), u AS (SELECT n_nationkey, CASE WHEN n_nationkey = (SELECT min(n_nationkey) FROM m WHERE n_regionkey = 2) THEN 'first of two' ELSE n_name END n_name, n_regionkey FROM m),
l AS (SELECT * FROM u WHERE n_nationkey <> (SELECT min(n_nationkey) FROM u WHERE n_regionkey = 3)) SELECT *, FALSE AS found FROM l UNION ALL SELECT *, TRUE FROM (SELECT * FROM l WHERE n_regionkey >= 2 ORDER BY n_nationkey LIMIT 1)""",
    random_suite: _true("uniform", "normal", "range", "exponential", "weibull", "bernoulli", "binomial", "geometric", "poisson", "poisson_large", "pareto", "log_normal", "irwin_hall", "bates"),
    chance_suite: _true("distinct_ids", "id_form", "distinct_bytes", "byte_count", "recent"),
    metrics_of_targets: """SELECT 'price' target, round(avg((l_extendedprice - l_quantity * 1000) ** 2), 3) mse, round(avg(abs(l_extendedprice - l_quantity * 1000)), 5) mae FROM lineitem
UNION ALL SELECT 'share', round(avg((l_tax * 100 - l_discount * 100) ** 2), 3), round(avg(abs(l_tax * 100 - l_discount * 100)), 5) FROM lineitem""",
    class_metrics_of_targets: """SELECT 'three' target, round(avg(CASE WHEN l_linenumber % 3 = l_suppkey % 3 THEN 1.0 ELSE 0.0 END), 6) accuracy FROM lineitem UNION ALL SELECT 'two', round(avg(CASE WHEN l_partkey % 2 = l_orderkey % 2 THEN 1.0 ELSE 0.0 END), 6) FROM lineitem""",
    curve_of_line: "SELECT 2.5::DOUBLE slope, 4.0::DOUBLE AS offset, TRUE AS close, TRUE AS success",
    ordinal_codes_of_other_rows: """WITH s AS (SELECT c_mktsegment v, row_number() OVER (ORDER BY c_mktsegment) - 1 k FROM (SELECT DISTINCT c_mktsegment FROM customer)), n AS (SELECT c_nationkey v, row_number() OVER (ORDER BY c_nationkey) - 1 k FROM (SELECT DISTINCT c_nationkey FROM customer))
SELECT c_custkey, s.k segment, n.k nation FROM customer JOIN s ON s.v = c_mktsegment JOIN n ON n.v = c_nationkey WHERE c_nationkey > 12""",
    quantile_suite: _true("low", "median", "high", "covered", "wider", "bounded"),
    blob_files: "SELECT n_nationkey || '.bin' AS name, n_name AS text, CAST(strlen(n_name) AS BIGINT) length FROM nation",
    statement_results: """SELECT 'other' tag, NULL AS text UNION ALL SELECT 'insert', NULL UNION ALL SELECT 'select', n_name FROM nation WHERE n_regionkey = 1 AND n_nationkey < 20 UNION ALL SELECT 'read', n_name FROM nation WHERE n_regionkey = 1""",
    model_suite: _true("near", "ordered", "covered", "classes", "shares", "sized", "held", "chained", "criteria", "mass", "both_parts", "scores", "drawn", "drawn_mean"),
}
