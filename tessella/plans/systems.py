"""Queries over event lines, streams, archives, markup and text forms."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as TY

from tessella.functions import text_form
from tessella.operators import metrics as M
from tessella.operators import models, simulation
from tessella.session import table as T
from tessella.sources import files, sql
from tessella.streaming import windows as W


def _add(state, _time, event):
    return {"cents": state["cents"] + int(event["cents"])}, []


def simulate_accounts(spark, d):
    events = T(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    out = simulation.simulate(events, "user_id", "ts", {"cents": 0}, _add, "user_id long, cents long, events_processed long, final_time timestamp")
    return out.select("user_id", "cents", "events_processed")


def stream_daily(spark, d):
    schema = T(spark, d, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/[e]vents.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = W.tumbling(W.watermarked(stream, "ts", "1 day"), "ts", "1 day", "event_type", n=F.count("*"))
    live = W.run_to_memory(counts, f"stream_daily_{uuid.uuid4().hex}")
    return live.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def archive_round_trip(spark, d):
    rows = T(spark, d, "nation").select(F.col("n_regionkey").alias("k"), F.concat(F.col("n_nationkey").cast("string"), F.lit(".txt")).alias("name"), F.encode("n_name", "UTF-8").alias("content"))
    out = None
    for kind in ("zip", "tar"):
        packed = files.archive(rows, "k", "name", "content", kind)
        packed = packed.withColumn("content", files.gzip_decompress(files.gzip_compress(F.col("content"))))
        part = files.archive_entries(packed, "k", "content", kind).select(F.lit(kind).alias("kind"), "k", "name", F.decode("content", "UTF-8").alias("text"))
        out = part if out is None else out.unionByName(part)
    return out


def xml_round_trip(spark, d):
    rows = T(spark, d, "customer").select("c_custkey", F.struct("c_name", "c_nationkey").alias("r"))
    return rows.select("c_custkey", files.parse_xml(files.to_xml(F.col("r")), "c_name string, c_nationkey int").alias("x")).select("c_custkey", "x.*")


def text_forms(spark, d):
    kind = TY.StructType([TY.StructField("k", TY.LongType()), TY.StructField("name", TY.StringType()), TY.StructField("tags", TY.ArrayType(TY.LongType()))])
    row = F.struct(F.col("o_orderkey").alias("k"), F.concat(F.col("o_orderpriority"), F.lit(' "\\')).alias("name"), F.array(F.col("o_custkey"), F.lit(1).cast("long")).alias("tags"))
    return T(spark, d, "orders").select("o_orderkey", text_form.print_value(row, kind).alias("form"))


def sql_cells(spark, d):
    c = sql.cells(T(spark, d, "nation").select("n_nationkey", "n_name"))
    get = lambda k: F.get("cells", F.lit(k))
    return c.select(get(0)["key"].alias("first_key"), get(0)["value"]["String"].alias("name"), get(1)["value"]["tag"].alias("tag"), get(1)["value"]["Integer"].alias("number"))


def silhouette_embeddings(spark, d):
    s = M.silhouette(T(spark, d, "embeddings"), "embedding", "label", "vec_id")
    return s.select(F.round("silhouette", 6).alias("silhouette"))


def importance_lineitem(spark, d):
    i = M.importance(T(spark, d, "lineitem"), {"tax": "l_tax", "discount": "l_discount"})
    return i.select("feature", F.round("mean", 8).alias("mean"), F.round("std", 8).alias("std"))


def boosted_prices(spark, d):
    rows = T(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), (F.col("p_partkey") % 10).cast("double").alias("digit"), "p_retailprice")
    model = models.boosted_regressor(rows, ["size", "digit"], "p_retailprice", rounds=5)
    out = models.predict(model, rows, ["size", "digit"])
    return models.conformal_interval(out, models.conformal_width(out, "p_retailprice", 0.9)).select("p_partkey", "lower", "prediction", "upper")


def mixture_values(spark, d):
    rows = T(spark, d, "events").select("event_id", "value")
    model = models.mixture(rows, ["value"], 2, seed=1, iterations=20)
    return models.mixture_scores(model, rows, ["value"]).select("event_id", "score")


QUERIES_SQL = {
    simulate_accounts: "SELECT user_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) cents, count(*) events_processed FROM events GROUP BY 1",
    stream_daily: "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) n FROM events GROUP BY 1, 2",
    archive_round_trip: "SELECT kind, n_regionkey k, n_nationkey || '.txt' AS name, n_name AS text FROM nation, (SELECT unnest(['zip', 'tar']) kind)",
    xml_round_trip: "SELECT c_custkey, c_name, c_nationkey FROM customer",
    text_forms: """SELECT o_orderkey, '(k=' || o_orderkey || ', name="' || o_orderpriority || ' \\"\\\\", tags=[' || o_custkey || ', 1])' form FROM orders""",
    sql_cells: "SELECT 'n_name' first_key, n_name AS name, 'Integer' tag, CAST(n_nationkey AS BIGINT) number FROM nation",
    silhouette_embeddings: """WITH v AS (SELECT vec_id id, label c, CAST(embedding AS DOUBLE[]) e FROM embeddings), p AS (SELECT a.id, a.c, b.c k, sum(list_distance(a.e, b.e)) d, count(*) n FROM v a JOIN v b ON true GROUP BY 1, 2, 3),
s AS (SELECT id, max(CASE WHEN c = k THEN d / nullif(n - 1, 0) END) a, min(CASE WHEN c <> k THEN d / n END) b FROM p GROUP BY 1) SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) silhouette FROM s""",
    importance_lineitem: "SELECT 'tax' feature, round(avg(abs(l_tax)), 8) mean, round(stddev_pop(abs(l_tax)), 8) std FROM lineitem UNION ALL SELECT 'discount', round(avg(abs(l_discount)), 8), round(stddev_pop(abs(l_discount)), 8) FROM lineitem",
    boosted_prices: None,
    mixture_values: None,
}
