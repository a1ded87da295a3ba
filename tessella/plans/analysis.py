"""Queries over statistics, metrics, preprocessing and sources."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as TY

from tessella.operators import metrics as M
from tessella.operators import preprocess as P
from tessella.operators import statistics as S
from tessella.session import table as T
from tessella.sources import csvs, documents, sql


def describe_value(spark, d):
    return T(spark, d, "events").groupBy("event_type").agg(*((F.round(c, 6) if n != "count" else c).alias(n) for n, c in S.describe(F.col("value")).items()))


def robust_value(spark, d):
    r = S.robust(T(spark, d, "events"), "value")
    return r.select(*(F.round(c, 6).alias(c) for c in r.columns))


def percentiles_value(spark, d):
    p = S.group_quantiles(T(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.05, 0.5, 0.95])
    return p.select("l_returnflag", *(F.round(F.col("quantiles")[k], 4).alias(f"p{v}") for k, v in enumerate((5, 50, 95))))


def percentile_of_score(spark, d):
    return T(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(S.percentile_of_score(F.col("l_quantity"), 25.0), 6).alias("rank"))


def pearson_prices(spark, d):
    return S.pearson(T(spark, d, "lineitem"), "l_quantity", "l_extendedprice").select(F.round("correlation", 8).alias("correlation"))


def spearman_prices(spark, d):
    return S.spearman(T(spark, d, "lineitem"), "l_quantity", "l_extendedprice").select(F.round("correlation", 8).alias("correlation"))


def histogram_value(spark, d):
    h = S.histogram(T(spark, d, "events"), "value", 8, 0.0, 400.0)
    return h.select("bin", "low", "high", "count")


def kde_value(spark, d):
    return S.kde(T(spark, d, "events"), "value", [0.0, 50.0, 100.0, 200.0], 12.5).select("point", F.round("density", 10).alias("density"))


def interpolate_price(spark, d):
    knots = T(spark, d, "part").groupBy(F.col("p_size").cast("double").alias("x")).agg(F.avg("p_retailprice").alias("y"))
    points = spark.range(4, 190).select((F.col("id") / 4).alias("x"))
    return S.interpolate(points, knots, "x", "y").select("x", F.round("y", 6).alias("y"))


def _scaled(spark, d, fit):
    columns = ["l_quantity", "l_extendedprice"]
    rows = T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *columns)
    out = P.scale(rows, fit(rows, columns))
    return out.select("l_orderkey", "l_linenumber", *(F.round(c, 6).alias(c) for c in columns))


def standard_scale(spark, d):
    return _scaled(spark, d, P.standard_scaler)


def min_max_scale(spark, d):
    return _scaled(spark, d, P.min_max_scaler)


def robust_scale(spark, d):
    return _scaled(spark, d, P.robust_scaler)


def label_encode(spark, d):
    rows = T(spark, d, "part").select("p_partkey", "p_type")
    return P.encode(rows, P.label_encoder(rows, "p_type"), "p_type", "code")


def ordinal_encode(spark, d):
    return P.ordinal_encode(T(spark, d, "part").select("p_partkey", "p_brand", "p_type"), ["p_brand", "p_type"])


def label_decode(spark, d):
    rows = T(spark, d, "part").select("p_partkey", "p_type")
    e = P.label_encoder(rows, "p_type")
    return P.decode(P.encode(rows, e, "p_type", "c").select("p_partkey", "c"), e, "c", "p_type").select("p_partkey", "p_type")


def class_weights(spark, d):
    w = P.class_weight(T(spark, d, "orders"), "o_orderpriority")
    return w.select("class", F.round("weight", 8).alias("weight"))


def overlap_filter(spark, d):
    ref = T(spark, d, "customer").where("c_nationkey < 10").select(F.col("c_nationkey").alias("s_nationkey"))
    return P.overlap(T(spark, d, "supplier").select("s_suppkey", "s_nationkey"), ref, ["s_nationkey"])


def split_sizes(spark, d):
    s = P.split(T(spark, d, "orders"), [0.6, 0.3, 0.1], "o_orderkey", 7, "o_orderstatus")
    return s.groupBy("o_orderstatus").agg(F.count("*").alias("n"), (F.abs(F.sum((F.col("split") == 0).cast("int")) - 0.6 * F.count("*")) <= 1).alias("first_fits"), (F.abs(F.sum((F.col("split") == 2).cast("int")) - 0.1 * F.count("*")) <= 1).alias("last_fits"))


def _judged(spark, d):
    docs = T(spark, d, "documents").select("doc_id", (F.col("n_chars") % 7 < 5).cast("int").alias("guess"), ((F.col("n_chars") * 37) % 101 / 101.0).alias("score"))
    return T(spark, d, "labels").join(docs, "doc_id")


def confusion_labels(spark, d):
    return M.confusion(_judged(spark, d), "quality", "guess")


def classification_labels(spark, d):
    m = M.classification(_judged(spark, d), "quality", "guess")
    return m.select(*(F.round(c, 8).alias(c) for c in m.columns))


def roc_auc_labels(spark, d):
    return M.roc_auc(_judged(spark, d), "quality", "score").select(F.round("roc_auc", 8).alias("roc_auc"))


def log_loss_labels(spark, d):
    return _judged(spark, d).agg(F.round(M.log_loss(F.col("quality"), F.col("score")), 6).alias("loss"))


def regression_metrics(spark, d):
    names = ["mse", "rmse", "mae", "r2", "mape", "explained_variance", "max_error", "median_ae", "mean_error", "pinball_loss", "huber"]
    m = M.regression_row(T(spark, d, "lineitem"), F.col("l_extendedprice"), F.col("l_quantity") * 1000, names)
    return m.select(*(F.round(k, 4).alias(k) for k in names))


def csv_fields(spark, d):
    rows = T(spark, d, "part").select(F.concat(F.lit(" "), F.col("p_partkey").cast("string")).alias("bad"), F.col("p_partkey").cast("string").alias("k"), F.when(F.col("p_size") % 2 == 0, "true").otherwise("false").alias("b"), F.when(F.col("p_size") < 10, "").otherwise(F.col("p_size").cast("string")).alias("s"))
    kinds = TY.StructType([TY.StructField("k", TY.LongType(), False), TY.StructField("b", TY.BooleanType()), TY.StructField("s", TY.LongType())])
    return rows.select(*(csvs.field(F.col(f.name), f).alias(f.name) for f in kinds))


def csv_lines(spark, d):
    return csvs.to_csv_lines(T(spark, d, "nation").select("n_nationkey", F.concat(F.col("n_name"), F.when(F.col("n_nationkey") % 2 == 0, ', "x"').otherwise("")).alias("name")))


def document_find(spark, d):
    return documents.find(T(spark, d, "customer"), {"c_mktsegment": {"$in": ["BUILDING", "MACHINERY"]}, "c_acctbal": {"$gt": 0}}, ["c_custkey"], skip=5, limit=40).select("c_custkey", "c_acctbal")


def document_update(spark, d):
    df = documents.update_many(T(spark, d, "nation"), {"n_regionkey": 1}, {"$set": {"n_name": "changed"}, "$inc": {"n_regionkey": 10}})
    return documents.delete_many(df, {"n_nationkey": {"$lt": 3}})


def sql_typed_select(spark, d):
    T(spark, d, "orders").createOrReplaceTempView("orders_for_select")
    kinds = TY.StructType([TY.StructField("o_orderkey", TY.LongType(), False), TY.StructField("total", TY.DoubleType(), False)])
    return sql.select(spark, "SELECT o_orderkey, CAST(o_totalprice AS BIGINT) AS total FROM orders_for_select WHERE o_totalprice > :low", kinds, {"low": 150000})


_SQL_JUDGED = "WITH j AS (SELECT l.doc_id, quality, CASE WHEN n_chars % 7 < 5 THEN 1 ELSE 0 END guess, (n_chars * 37) % 101 / 101.0 score FROM labels l JOIN documents d ON l.doc_id = d.doc_id) "


def _sql_scale(centre: str, scale: str) -> str:
    both = ", ".join(f"{centre.format(c)} AS m_{c}, {scale.format(c)} AS s_{c}" for c in ("l_quantity", "l_extendedprice"))
    return f"SELECT l_orderkey, l_linenumber, round((l_quantity - m_l_quantity) / s_l_quantity, 6) l_quantity, round((l_extendedprice - m_l_extendedprice) / s_l_extendedprice, 6) l_extendedprice FROM lineitem, (SELECT {both} FROM lineitem)"


QUERIES_SQL = {
    describe_value: """SELECT event_type, count(value) AS count, round(avg(value), 6) mean, round(var_samp(value), 6) variance, round(avg(pow(value - m, 3)) / pow(stddev_pop(value), 3), 6) skewness, round(kurtosis_pop(value), 6) kurtosis, round(min(value), 6) AS min, round(max(value), 6) AS max
FROM (SELECT event_type, value, avg(value) OVER (PARTITION BY event_type) m FROM events) GROUP BY 1""",
    robust_value: "WITH q AS (SELECT median(value) m, quantile_cont(value, 0.25) q1, quantile_cont(value, 0.75) q3 FROM events) SELECT round(m, 6) median, round(q3 - q1, 6) iqr, round((SELECT median(abs(value - m)) FROM events, q), 6) mad, round(q1, 6) q1, round(q3, 6) q3 FROM q",
    percentiles_value: "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.05), 4) p5, round(quantile_cont(l_extendedprice, 0.5), 4) p50, round(quantile_cont(l_extendedprice, 0.95), 4) p95 FROM lineitem GROUP BY 1",
    percentile_of_score: "SELECT l_returnflag, round((count(*) FILTER (l_quantity < 25) + count(*) FILTER (l_quantity <= 25) + CASE WHEN count(*) FILTER (l_quantity = 25) > 0 THEN 1 ELSE 0 END) * 50.0 / count(*), 6) AS rank FROM lineitem GROUP BY 1",
    pearson_prices: "SELECT round(corr(l_quantity, l_extendedprice), 8) correlation FROM lineitem",
    spearman_prices: """WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 b FROM lineitem)
SELECT round(corr(CAST(a AS DOUBLE), CAST(b AS DOUBLE)), 8) correlation FROM r""",
    histogram_value: "WITH b AS (SELECT unnest(range(8)) bin), c AS (SELECT least(CAST(floor(value / 50.0) AS BIGINT), 7) bin, count(*) n FROM events WHERE value BETWEEN 0 AND 400 GROUP BY 1) SELECT b.bin, b.bin * 50.0::DOUBLE low, (b.bin + 1) * 50.0::DOUBLE high, coalesce(n, 0) AS count FROM b LEFT JOIN c ON b.bin = c.bin",
    kde_value: """WITH p AS (SELECT unnest([0.0, 50.0, 100.0, 200.0])::DOUBLE point), s AS (SELECT 12.5 * sqrt(var_samp(value)) h, count(*) n FROM events)
SELECT point, round(sum(exp(-pow((point - value) / h, 2) / 2)) / (min(n) * min(h) * sqrt(2 * pi())), 10) density FROM events, p, s GROUP BY point""",
    interpolate_price: """WITH k AS (SELECT p_size::DOUBLE x, avg(p_retailprice) y FROM part GROUP BY 1), p AS (SELECT unnest(range(4, 190)) / 4.0::DOUBLE x), n AS (SELECT p.x, (SELECT max(k.x) FROM k WHERE k.x <= p.x) a, (SELECT min(k.x) FROM k WHERE k.x >= p.x) b FROM p)
SELECT n.x, round(CASE WHEN a = b THEN ka.y ELSE ka.y + (kb.y - ka.y) / (b - a) * (n.x - a) END, 6) y FROM n LEFT JOIN k ka ON ka.x = a LEFT JOIN k kb ON kb.x = b""",
    standard_scale: _sql_scale("avg({})", "stddev_pop({})"),
    min_max_scale: _sql_scale("min({})", "(max({0}) - min({0}))"),
    robust_scale: _sql_scale("median({})", "(quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25))"),
    label_encode: "SELECT p_partkey, p_type, dense_rank() OVER (ORDER BY p_type) - 1 code FROM part",
    ordinal_encode: "SELECT p_partkey, p_brand, p_type, dense_rank() OVER (ORDER BY p_brand) - 1 p_brand_code, dense_rank() OVER (ORDER BY p_type) - 1 p_type_code FROM part",
    label_decode: "SELECT p_partkey, p_type FROM part",
    class_weights: "SELECT o_orderpriority AS class, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 8)::DOUBLE weight FROM orders GROUP BY 1",
    overlap_filter: "SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer WHERE c_nationkey < 10)",
    split_sizes: "SELECT o_orderstatus, count(*) n, true first_fits, true last_fits FROM orders GROUP BY 1",
    confusion_labels: _SQL_JUDGED + ", c AS (SELECT unnest([0, 1])::BIGINT c) SELECT a.c actual, b.c predicted, (SELECT count(*) FROM j WHERE quality = a.c AND guess = b.c) n FROM c a, c b",
    classification_labels: _SQL_JUDGED
    + """, m AS (SELECT count(*) FILTER (quality = 1 AND guess = 1)::DOUBLE tp, count(*) FILTER (quality = 0 AND guess = 1)::DOUBLE fp, count(*) FILTER (quality = 1 AND guess = 0)::DOUBLE fn, count(*) FILTER (quality = 0 AND guess = 0)::DOUBLE tn FROM j)
SELECT round((tp + tn) / (tp + tn + fp + fn), 8) accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 8) balanced_accuracy, round((tp / (tp + fp) + tn / (tn + fn)) / 2, 8) AS precision, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 8) recall,
round((2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2, 8) f1, round((tp / (tp + fp + fn) + tn / (tn + fp + fn)) / 2, 8) jaccard, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 8) matthews_corrcoef,
round(1 - (fp + fn) * (tp + tn + fp + fn) / ((tn + fp) * (tp + fp) + (tp + fn) * (tn + fn)), 8) cohen_kappa FROM m""",
    roc_auc_labels: _SQL_JUDGED + "SELECT round(avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END), 8)::DOUBLE roc_auc FROM j a, j b WHERE a.quality = 1 AND b.quality = 0",
    log_loss_labels: _SQL_JUDGED + ", q AS (SELECT quality, least(greatest(score::DOUBLE, 2.220446049250313e-16), 1 - 2.220446049250313e-16) p FROM j) SELECT round(-avg(CASE WHEN quality = 1 THEN ln(p) ELSE ln(1 - p) END), 6) loss FROM q",
    regression_metrics: """WITH e AS (SELECT l_extendedprice y, l_extendedprice - l_quantity * 1000 e FROM lineitem) SELECT round(avg(e * e), 4) mse, round(sqrt(avg(e * e)), 4) rmse, round(avg(abs(e)), 4) mae, round(1 - avg(e * e) / var_pop(y), 4) r2, round(avg(abs(e) / y), 4) mape,
round(1 - var_pop(e) / var_pop(y), 4) explained_variance, round(max(abs(e)), 4) max_error, round(median(abs(e)), 4) median_ae, round(avg(-e), 4) mean_error, round(avg(greatest(0.5 * e, -0.5 * e)), 4) pinball_loss, round(avg(CASE WHEN abs(e) <= 1 THEN e * e / 2 ELSE abs(e) - 0.5 END), 4) huber FROM e""",
    csv_fields: "SELECT p_partkey k, p_size % 2 = 0 b, CASE WHEN p_size < 10 THEN NULL ELSE p_size::BIGINT END s FROM part",
    csv_lines: '''SELECT n_nationkey || ',' || CASE WHEN n_nationkey % 2 = 0 THEN '"' || n_name || ', ""x""' || '"' ELSE n_name END line FROM nation''',
    document_find: "SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal > 0 ORDER BY c_custkey LIMIT 40 OFFSET 5",
    document_update: "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'changed' ELSE n_name END n_name, CASE WHEN n_regionkey = 1 THEN 11 ELSE n_regionkey END n_regionkey FROM nation WHERE n_nationkey >= 3",
    sql_typed_select: "SELECT o_orderkey, trunc(o_totalprice)::DOUBLE total FROM orders WHERE o_totalprice > 150000",
}
