"""Queries over whole tables: projections, filters, folds, joins, sets, order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import collections as C
from tessella.operators import joins as J
from tessella.operators import patch as P
from tessella.session import table as T
from tessella.streaming import windows as W

def _revenue():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))



def _dec(c):
    """Money in exact decimals, so that sums don't depend on order."""
    return c.cast("decimal(18,4)")


def group_fold_pricing(spark: SparkSession, d: str) -> DataFrame:
    rows = C.filter_(T(spark, d, "lineitem"), F.col("l_shipdate") <= "1998-09-02")
    return C.group_fold(
        rows,
        ["l_returnflag", "l_linestatus"],
        sum_qty=F.sum(_dec(F.col("l_quantity"))).cast("double"),
        sum_base=F.sum(_dec(F.col("l_extendedprice"))).cast("double"),
        sum_disc=F.sum(_dec(_revenue())).cast("double"),
        n=F.count("*"),
    )


def array_map_project(spark, d):
    return C.map_(T(spark, d, "orders"), o_orderkey=F.col("o_orderkey"), cents=F.round(F.col("o_totalprice") * 100).cast("long"), open=F.col("o_orderstatus") == "O")


def array_filter_orders(spark, d):
    return C.filter_(T(spark, d, "orders"), (F.col("o_totalprice") > 100000) & (F.col("o_orderpriority") == "1-URGENT")).select("o_orderkey", "o_custkey")


def filter_map_discount(spark, d):
    return C.filter_map(T(spark, d, "lineitem"), F.when(F.col("l_discount") > 0.05, (F.col("l_extendedprice").cast("decimal(18,2)") * F.col("l_discount").cast("decimal(4,2)")).cast("double")), "saved", "l_orderkey", "l_linenumber")


def first_map_large_order(spark, d):
    return C.first_map(T(spark, d, "orders"), F.when(F.col("o_totalprice") > 50000, F.col("o_orderkey")), "first_key", ["o_orderkey"])


def sort_slice_orders(spark, d):
    return C.slice_(T(spark, d, "orders").select("o_orderkey", "o_totalprice"), 10, 60, F.desc("o_totalprice"), "o_orderkey")


def row_index_customers(spark, d):
    return C.with_index(T(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey").select("c_custkey", F.col("__ix").alias("ix"))


def is_sorted_events(spark, d):
    return C.is_sorted(T(spark, d, "events").select("user_id", "ts", "event_id"), "event_id", "ts", "user_id")


def reduce_lineitem(spark, d):
    return C.reduce(T(spark, d, "lineitem"), n=F.count("*"), total=F.sum(_dec(F.col("l_quantity"))).cast("double"), low=F.min("l_quantity"), high=F.max("l_quantity"))


def to_set_segments(spark, d):
    return C.to_set(T(spark, d, "customer"), "c_mktsegment", "c_nationkey")


def to_dict_merge(spark, d):
    return C.to_dict(T(spark, d, "supplier"), F.col("s_nationkey"), F.col("s_suppkey"), F.max)


def flatten_tokens(spark, d):
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)
    return C.group_fold(C.flat_map(T(spark, d, "documents"), words, "word"), [F.lower("word").alias("word")], n=F.count("*"))


def ordered_fold_balance(spark, d):
    rows = T(spark, d, "events").select("user_id", "event_id", F.round("value", 2).cast("decimal(18,2)").alias("v"))
    out = C.ordered_fold(rows, "user_id", "event_id", F.lit(0).cast("decimal(18,2)"), lambda acc, r: F.greatest(acc + r["v"] - 50, F.lit(0)).cast("decimal(18,2)"), "level")
    return out.select("user_id", F.col("level").cast("double").alias("level"))


def nation_lookup(spark, d):
    right = T(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return J.lookup(T(spark, d, "customer").select("c_custkey", "c_nationkey"), right, "c_nationkey", {"n_name": "elsewhere"})


def revenue_by_nation(spark, d):
    n = T(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    c = J.inner(T(spark, d, "customer").select("c_custkey", "c_nationkey"), n, "c_nationkey")
    o = T(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("l_orderkey"))
    rows = J.inner(J.inner(T(spark, d, "lineitem"), o, "l_orderkey"), c, "c_custkey")
    return C.group_fold(rows, ["n_name"], revenue=F.sum(_dec(_revenue())).cast("double"), n=F.count("*"))


def _by_nation(spark, d, name, key):
    return T(spark, d, name).groupBy(F.col(key).alias("nation")).agg(F.count("*").alias("n"))


def merge_counts(spark, d):
    return J.merge_dicts(_by_nation(spark, d, "customer", "c_nationkey"), _by_nation(spark, d, "supplier", "s_nationkey"), "nation", "n", lambda a, b: a + b)


def merge_all_counts(spark, d):
    few = _by_nation(spark, d, "customer", "c_nationkey").where("nation < 12")
    return J.merge_all(few, _by_nation(spark, d, "supplier", "s_nationkey"), "nation", "n", lambda old, new: old * 10 + new, lambda k: k.cast("long"))


def customers_with_orders(spark, d):
    return J.semi(T(spark, d, "customer").select("c_custkey"), T(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


def customers_without_orders(spark, d):
    return J.anti(T(spark, d, "customer").select("c_custkey"), T(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


def _keys(spark, d):
    a = T(spark, d, "part").select((F.col("p_partkey") % 997).alias("k"))
    return a.distinct(), T(spark, d, "orders").select((F.col("o_custkey") * 3 % 1499).alias("k")).distinct()


def set_union_keys(spark, d):
    return C.union(*_keys(spark, d))


def set_intersect_keys(spark, d):
    return C.intersect(*_keys(spark, d))


def set_diff_keys(spark, d):
    return C.diff(*_keys(spark, d))


def set_sym_diff_keys(spark, d):
    return C.sym_diff(*_keys(spark, d))


def set_subset_disjoint(spark, d):
    a, b = _keys(spark, d)
    # Both are single rows.
    return C.is_subset(a, C.union(a, b)).join(F.broadcast(C.is_disjoint(a, C.diff(b, a))), F.lit(True))


def gather_positions(spark, d):
    data = C.with_index(T(spark, d, "supplier").select("s_suppkey", "s_name"), "s_suppkey").select(F.col("__ix").alias("ix"), "s_name")
    asked = spark.range(0, 400, 7).select(F.col("id").alias("ix"))
    return J.gather(data, asked, "ix", {"s_name": "none"})


def as_of_event(spark, d):
    o = T(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0, pmod(o_orderkey * 7919, 2592000))").alias("at"))
    e = T(spark, d, "events").groupBy("user_id", "ts").agg(F.max("event_id").alias("event_id"))
    return J.as_of(o, e, "user_id", "at", "ts", ["event_id"]).select("o_orderkey", "event_id")


def band_join_price(spark, d):
    bands = spark.range(0, 60).select((F.col("id") * 10000.0).alias("low"), (F.col("id") * 10000.0 + 15000.0).alias("high"), F.col("id").alias("band"))
    rows = J.band_join(T(spark, d, "orders").select("o_orderkey", "o_totalprice"), bands, "o_totalprice", "low", "high", 15000.0)
    return C.group_fold(rows, ["band"], n=F.count("*"))


def _versions(spark, d):
    old = T(spark, d, "part").select("p_partkey", "p_brand", F.col("p_size").cast("long").alias("p_size"))
    new = old.where("p_partkey % 11 <> 0").withColumn("p_size", F.col("p_size") + (F.col("p_partkey") % 5 == 0).cast("long"))
    return old, new.unionByName(old.where("p_partkey % 13 = 0").withColumn("p_partkey", F.col("p_partkey") + 10_000_000))


def patch_diff(spark, d):
    p = P.diff(*_versions(spark, d), ["p_partkey"])
    return p.select("p_partkey", "change", F.col("before.p_size").alias("before_size"), F.col("after.p_size").alias("after_size"))


def patch_apply(spark, d):
    old, new = _versions(spark, d)
    return P.apply(old, P.diff(old, new, ["p_partkey"]), ["p_partkey"])


def patch_invert(spark, d):
    old, new = _versions(spark, d)
    return P.apply(new, P.invert(P.diff(old, new, ["p_partkey"]), ["p_partkey"]), ["p_partkey"])


def patch_compose(spark, d):
    old, new = _versions(spark, d)
    third = new.where("p_partkey % 7 <> 0")
    p = P.compose(P.diff(old, new, ["p_partkey"]), P.diff(new, third, ["p_partkey"]), ["p_partkey"])
    return P.apply(old, p, ["p_partkey"])


def event_hourly(spark, d):
    rows = W.tumbling(T(spark, d, "events"), "ts", "1 hour", "event_type", n=F.count("*"), high=F.max("value"))
    return rows.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n", "high")


def event_sliding(spark, d):
    rows = W.sliding(T(spark, d, "events"), "ts", "6 hours", "3 hours", n=F.count("*"))
    return rows.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("start"), "n")


def event_sessions(spark, d):
    rows = W.sessions(T(spark, d, "events"), "ts", "2 hours", "user_id", n=F.count("*"))
    return rows.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


_SQL_VERSIONS = """WITH old AS (SELECT p_partkey, p_brand, CAST(p_size AS BIGINT) p_size FROM part),
new AS (SELECT p_partkey, p_brand, p_size + CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END p_size FROM old WHERE p_partkey % 11 <> 0
UNION ALL SELECT p_partkey + 10000000, p_brand, p_size FROM old WHERE p_partkey % 13 = 0)"""
_SQL_KEYS = "WITH a AS (SELECT DISTINCT p_partkey % 997 k FROM part), b AS (SELECT DISTINCT o_custkey * 3 % 1499 k FROM orders)"
_SQL_NATION = "WITH c AS (SELECT c_nationkey nation, count(*) n FROM customer GROUP BY 1), s AS (SELECT s_nationkey nation, count(*) n FROM supplier GROUP BY 1)"

QUERIES_SQL = {
    group_fold_pricing: """SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) sum_base,
CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) sum_disc, count(*) n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""",
    array_map_project: "SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) cents, o_orderstatus = 'O' AS open FROM orders",
    array_filter_orders: "SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 100000 AND o_orderpriority = '1-URGENT'",
    filter_map_discount: "SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DOUBLE) saved FROM lineitem WHERE l_discount > 0.05",
    first_map_large_order: "SELECT min(o_orderkey) first_key FROM orders WHERE o_totalprice > 50000",
    sort_slice_orders: "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 10",
    row_index_customers: "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 ix FROM customer",
    is_sorted_events: "SELECT user_id, bool_and(coalesce(b <= event_id, true)) is_sorted FROM (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts) b FROM events) GROUP BY 1",
    reduce_lineitem: "SELECT count(*) n, CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) total, min(l_quantity) low, max(l_quantity) high FROM lineitem",
    to_set_segments: "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer",
    to_dict_merge: "SELECT s_nationkey AS key, max(s_suppkey) AS value FROM supplier GROUP BY 1",
    flatten_tokens: "SELECT lower(word) word, count(*) n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) word FROM documents) GROUP BY 1",
    ordered_fold_balance: """WITH RECURSIVE e AS (SELECT user_id, CAST(round(value, 2) AS DECIMAL(18,2)) v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) r FROM events),
f AS (SELECT user_id, r, greatest(v - 50, 0)::DECIMAL(18,2) lv FROM e WHERE r = 1 UNION ALL SELECT e.user_id, e.r, greatest(f.lv + e.v - 50, 0)::DECIMAL(18,2) FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1)
SELECT user_id, CAST(arg_max(lv, r) AS DOUBLE) AS level FROM f GROUP BY 1""",
    nation_lookup: "SELECT c_custkey, c_nationkey, coalesce(n_name, 'elsewhere') n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey",
    revenue_by_nation: "SELECT n_name, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) revenue, count(*) n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    merge_counts: _SQL_NATION + " SELECT coalesce(c.nation, s.nation) nation, coalesce(c.n, 0) + coalesce(s.n, 0) n FROM c FULL JOIN s ON c.nation = s.nation",
    merge_all_counts: _SQL_NATION + ", f AS (SELECT * FROM c WHERE nation < 12) SELECT coalesce(f.nation, s.nation) nation, CASE WHEN s.n IS NULL THEN f.n ELSE coalesce(f.n, s.nation) * 10 + s.n END n FROM f FULL JOIN s ON f.nation = s.nation",
    customers_with_orders: "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
    customers_without_orders: "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)",
    set_union_keys: _SQL_KEYS + " SELECT k FROM a UNION SELECT k FROM b",
    set_intersect_keys: _SQL_KEYS + " SELECT k FROM a INTERSECT SELECT k FROM b",
    set_diff_keys: _SQL_KEYS + " SELECT k FROM a EXCEPT SELECT k FROM b",
    set_sym_diff_keys: _SQL_KEYS + " (SELECT k FROM a EXCEPT SELECT k FROM b) UNION (SELECT k FROM b EXCEPT SELECT k FROM a)",
    set_subset_disjoint: _SQL_KEYS + " SELECT (SELECT count(*) = 0 FROM a WHERE k NOT IN (SELECT k FROM a UNION SELECT k FROM b)) is_subset, (SELECT count(*) = 0 FROM a WHERE k IN (SELECT k FROM b EXCEPT SELECT k FROM a)) is_disjoint",
    gather_positions: "WITH s AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 ix, s_name FROM supplier) SELECT r.ix, coalesce(s_name, 'none') s_name FROM (SELECT unnest(range(0, 400, 7)) ix) r LEFT JOIN s ON r.ix = s.ix",
    as_of_event: """WITH o AS (SELECT o_orderkey, o_custkey user_id, TIMESTAMP '2024-01-01' + to_seconds((o_orderkey * 7919) % 2592000) AS at FROM orders), e AS (SELECT user_id, ts, max(event_id) event_id FROM events GROUP BY 1, 2)
SELECT o_orderkey, event_id FROM o ASOF LEFT JOIN e ON o.user_id = e.user_id AND o.at >= e.ts""",
    band_join_price: "WITH b AS (SELECT unnest(range(60)) band) SELECT band, count(*) n FROM orders JOIN b ON o_totalprice >= band * 10000.0 AND o_totalprice < band * 10000.0 + 15000.0 GROUP BY 1",
    patch_diff: _SQL_VERSIONS
    + """ SELECT coalesce(o.p_partkey, n.p_partkey) p_partkey, CASE WHEN o.p_partkey IS NULL THEN 'insert' WHEN n.p_partkey IS NULL THEN 'delete' ELSE 'update' END AS change, o.p_size before_size, n.p_size after_size
FROM old o FULL JOIN new n ON o.p_partkey = n.p_partkey WHERE o.p_partkey IS NULL OR n.p_partkey IS NULL OR o.p_size <> n.p_size OR o.p_brand <> n.p_brand""",
    patch_apply: _SQL_VERSIONS + " SELECT * FROM new",
    patch_invert: _SQL_VERSIONS + " SELECT * FROM old",
    patch_compose: _SQL_VERSIONS + " SELECT * FROM new WHERE p_partkey % 7 <> 0",
    event_hourly: "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) n, max(value) high FROM events GROUP BY 1, 2",
    event_sliding: "SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, count(*) n FROM (SELECT time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '2000-01-01') - to_hours(x * 3) s FROM events, (SELECT unnest([0, 1]) x)) GROUP BY 1",
    event_sessions: """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) n FROM s GROUP BY user_id, k""",
}
