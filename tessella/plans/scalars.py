"""Queries over scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import blobs, datetimes, numbers, strings
from tessella.session import table as T
from tessella.sources import typed_json


def integer_suite(spark, d):
    k = F.col("o_orderkey").cast("long") - 7000
    m = (F.col("o_custkey") % 13 - 6).cast("long")
    return T(spark, d, "orders").where((F.col("o_custkey") % 13 - 6) != 0).select(
        "o_orderkey",
        numbers.int_divide(k, m).alias("floor_div"),
        numbers.int_remainder(k, m).alias("remainder"),
        numbers.int_pow(m, 3).alias("cube"),
        numbers.int_sign(k).alias("sign"),
        numbers.absolute(k).alias("magnitude"),
        numbers.int_log(k, 3).alias("log3"),
        numbers.add(k, 5).alias("plus"),
        numbers.subtract(k, m).alias("minus"),
        numbers.multiply(k, m).alias("times"),
        numbers.negate(k).alias("negated"),
    )


def float_suite(spark, d):
    x, y = F.col("l_extendedprice"), F.col("l_quantity")
    return T(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        numbers.float_divide(x, y).alias("ratio"),
        numbers.float_remainder(-x, y).alias("remainder"),
        F.round(numbers.float_pow(y, 1.5), 6).alias("power"),
        numbers.float_sign(y - 25).alias("sign"),
        numbers.float_sqrt(x).alias("root"),
        F.round(numbers.float_log(x), 8).alias("log"),
        F.round(numbers.float_exp(F.col("l_discount")), 8).alias("exp"),
        F.round(numbers.sin(y) + numbers.cos(y), 8).alias("waves"),
        numbers.float_to_int(-x).alias("whole"),
    )


def boolean_suite(spark, d):
    a, b = F.col("l_returnflag") == "A", F.col("l_linestatus") == "F"
    return T(spark, d, "lineitem").groupBy(numbers.and_(a, b).alias("both"), numbers.or_(a, b).alias("any_of"), numbers.not_(a).alias("not_a"), numbers.xor(a, b).alias("one")).agg(F.count("*").alias("n"))


def string_suite(spark, d):
    s = F.col("p_name")
    return T(spark, d, "part").select(
        "p_partkey",
        strings.concat(s, F.col("p_brand")).alias("joined"),
        strings.repeat(F.col("p_brand"), 2).alias("twice"),
        strings.length(s).alias("n"),
        strings.substring(s, 2, 6).alias("piece"),
        strings.substring(s, -3, 2).alias("head"),
        strings.index_of(s, "a").alias("at"),
        F.size(strings.split(s, " ")).cast("long").alias("parts"),
        strings.trim(F.concat(F.lit("\t  "), s, F.lit("\n "))).alias("trimmed"),
        strings.upper_case(s).alias("upper"),
        strings.lower_case(F.col("p_type")).alias("lower"),
        strings.replace(s, "e", "<e>").alias("replaced"),
        strings.starts_with(F.col("p_type"), "S").alias("starts"),
        strings.ends_with(F.col("p_type"), "R").alias("ends"),
        strings.contains(s, "ar").alias("has"),
    )


def regex_suite(spark, d):
    s = F.col("text")
    return T(spark, d, "documents").select(
        "doc_id",
        strings.regex_contains(s, "the [a-z]+ of", "i").alias("has"),
        strings.regex_index_of(s, "[.]").alias("at"),
        F.md5(strings.regex_replace(s, "([a-z])([.,])", "$2$1")).alias("swapped"),
    )


def datetime_suite(spark, d):
    t = F.col("ts")
    return T(spark, d, "events").select(
        "event_id",
        datetimes.year(t).alias("y"),
        datetimes.month(t).alias("m"),
        datetimes.day_of_month(t).alias("dd"),
        datetimes.hour(t).alias("h"),
        datetimes.minute(t).alias("mi"),
        datetimes.second(t).alias("s"),
        datetimes.millisecond(t).alias("ms"),
        datetimes.day_of_week(t).alias("dow"),
        datetimes.to_epoch_milliseconds(t).alias("epoch"),
        datetimes.duration_milliseconds(datetimes.add_milliseconds(t, 90_061_001), t).alias("moved"),
        datetimes.print_format(t, "YYYY-MM-DD HH:mm:ss").alias("text"),
        datetimes.to_epoch_milliseconds(datetimes.from_components(datetimes.year(t), datetimes.month(t), datetimes.day_of_month(t), 12, 30, 15, 250)).alias("noon"),
        datetimes.time_zone_offset(t, "Europe/Paris").alias("paris"),
    )


def datetime_parse(spark, d):
    text = datetimes.print_format(F.col("ts"), "DD/MM/YYYY HH-mm-ss")
    return T(spark, d, "events").select("event_id", datetimes.to_epoch_milliseconds(datetimes.parse_format(text, "DD/MM/YYYY HH-mm-ss")).alias("epoch"))


def blob_suite(spark, d):
    b = blobs.encode_utf8(F.col("text"))
    return T(spark, d, "documents").select(
        "doc_id",
        blobs.size(b).alias("n_bytes"),
        blobs.get_uint8(b, 0).alias("first_byte"),
        (blobs.decode_utf8(b) == F.col("text")).alias("same"),
        (blobs.decode_utf16(blobs.encode_utf16(F.col("text"))) == F.col("text")).alias("same16"),
        blobs.sha256_text(F.col("text")).alias("sha"),
    )


def sha256_names(spark, d):
    return T(spark, d, "customer").select("c_custkey", blobs.sha256_text(F.col("c_name")).alias("sha"), F.hex(blobs.sha256_bytes(blobs.encode_utf8(F.col("c_name")))).alias("raw"))


def path_suite(spark, d):
    p = F.regexp_replace("url", "[?#].*$", "")
    return T(spark, d, "pages").select("page_id", blobs.path_basename(p).alias("base"), blobs.path_dirname(p).alias("dir"), blobs.path_extname(p).alias("ext"))


def json_props(spark, d):
    return T(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k")).groupBy("k").agg(F.count("*").alias("n"))


def typed_json_round_trip(spark, d):
    o = T(spark, d, "orders").select("o_orderkey", F.struct("o_orderkey", "o_totalprice", F.col("o_orderdate").cast("timestamp").alias("at"), F.encode("o_orderstatus", "UTF-8").alias("b")).alias("r"))
    kind = o.schema["r"].dataType
    text = typed_json.print_json(F.col("r"), kind)
    back = typed_json.parse_json(text, kind)
    return o.select("o_orderkey", back.eqNullSafe(F.col("r")).alias("same"), F.get_json_object(text, "$.o_orderkey").alias("key_text"), F.get_json_object(text, "$.b").alias("b_text"), F.substring(F.get_json_object(text, "$.at"), 1, 19).alias("at_text"))


QUERIES_SQL = {
    integer_suite: """WITH o AS (SELECT o_orderkey, CAST(o_orderkey - 7000 AS BIGINT) k, CAST(o_custkey % 13 - 6 AS BIGINT) m FROM orders WHERE o_custkey % 13 - 6 <> 0)
SELECT o_orderkey, CAST(k // m - CASE WHEN k % m <> 0 AND (k < 0) <> (m < 0) THEN 1 ELSE 0 END AS BIGINT) floor_div, k % m remainder, CAST(m * m * m AS BIGINT) "cube", CAST(sign(k) AS BIGINT) sign, abs(k) magnitude,
CAST((SELECT count(*) FROM range(1, 15) t(i) WHERE CAST(pow(3, i) AS BIGINT) <= abs(k)) AS BIGINT) log3, k + 5 plus, k - m minus, k * m times, -k negated FROM o""",
    float_suite: """SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity ratio, -fmod(l_extendedprice, l_quantity) remainder, round(pow(l_quantity, 1.5), 6) AS power, CAST(sign(l_quantity - 25) AS DOUBLE) sign,
sqrt(l_extendedprice) root, round(ln(l_extendedprice), 8) log, round(exp(l_discount), 8) exp, round(sin(l_quantity) + cos(l_quantity), 8) waves, CAST(trunc(-l_extendedprice) AS BIGINT) whole FROM lineitem""",
    boolean_suite: "SELECT l_returnflag = 'A' AND l_linestatus = 'F' AS both, l_returnflag = 'A' OR l_linestatus = 'F' AS any_of, l_returnflag <> 'A' AS not_a, (l_returnflag = 'A') <> (l_linestatus = 'F') AS one, count(*) n FROM lineitem GROUP BY 1, 2, 3, 4",
    string_suite: """SELECT p_partkey, p_name || p_brand AS joined, p_brand || p_brand AS twice, length(p_name) n, substring(p_name, 3, 4) piece, substring(p_name, 1, 2) head, CAST(instr(p_name, 'a') - 1 AS BIGINT) AS at, CAST(len(string_split(p_name, ' ')) AS BIGINT) parts,
p_name AS trimmed, upper(p_name) AS upper, lower(p_type) AS lower, replace(p_name, 'e', '<e>') replaced, starts_with(p_type, 'S') starts, suffix(p_type, 'R') ends, contains(p_name, 'ar') has FROM part""",
    regex_suite: "SELECT doc_id, regexp_matches(text, '(?i)the [a-z]+ of') has, CAST(instr(text, '.') - 1 AS BIGINT) AS at, md5(regexp_replace(text, '([a-z])([.,])', '\\2\\1', 'g')) swapped FROM documents",
    datetime_suite: """SELECT event_id, year(ts) y, month(ts) m, day(ts) dd, hour(ts) h, minute(ts) mi, second(ts) s, CAST(millisecond(ts) % 1000 AS BIGINT) ms, isodow(ts) dow, epoch_us(ts) // 1000 epoch, CAST(90061001 AS BIGINT) moved, strftime(ts, '%Y-%m-%d %H:%M:%S') AS text,
epoch_ms(date_trunc('day', ts)) + 45015250 noon, CAST(60 AS BIGINT) paris FROM events""",
    datetime_parse: "SELECT event_id, epoch_ms(date_trunc('second', ts)) epoch FROM events",
    blob_suite: "SELECT doc_id, octet_length(encode(text)) n_bytes, CAST(('0x' || substring(hex(encode(text)), 1, 2)) AS BIGINT) first_byte, true AS same, true AS same16, sha256(text) sha FROM documents",
    sha256_names: "SELECT c_custkey, sha256(c_name) sha, upper(sha256(c_name)) raw FROM customer",
    path_suite: """WITH u AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') p FROM pages) SELECT page_id, regexp_extract(p, '[^/]*$') base, regexp_replace(p, '/[^/]*$', '') dir, regexp_extract(regexp_extract(p, '[^/]*$'), '^.+?(\\.[^.]*)$', 1) ext FROM u""",
    json_props: "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) k, count(*) n FROM events GROUP BY 1",
    typed_json_round_trip: "SELECT o_orderkey, true AS same, CAST(o_orderkey AS VARCHAR) key_text, '0x' || lower(hex(encode(o_orderstatus))) b_text, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') at_text FROM orders",
}
