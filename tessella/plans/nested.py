"""Queries over nested columns: arrays, sets, dicts, vectors, matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import arrays as A
from tessella.functions import dicts as D
from tessella.functions import sets as S
from tessella.functions import vectors as V
from tessella.session import table as T


def _text(a):
    return F.array_join(F.transform(a, lambda x: x.cast("string")), ",")


def _dict_text(d):
    return F.array_join(F.transform(d, lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"].cast("string"))), ",")


def _lists(spark, d):
    """Quantities of each order in line order."""
    rows = T(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("long").alias("q")))).alias("r"))
    return rows.select("l_orderkey", F.transform("r", lambda s: s["q"]).alias("a"))


_SQL_LISTS = "WITH l AS (SELECT l_orderkey, list(CAST(l_quantity AS BIGINT) ORDER BY l_linenumber, l_quantity) a FROM lineitem GROUP BY 1) "


def array_make_suite(spark, d):
    n = F.col("n_nationkey")
    return T(spark, d, "nation").select(
        "n_nationkey",
        _text(A.generate(n % 4 - 1, lambda i: i * 2)).alias("generated"),
        _text(A.range_(n, 10, 3)).alias("up"),
        _text(A.range_(10, n, -4)).alias("down"),
        _text(F.transform(A.linspace(0, n, 5), lambda x: F.round(x * 4).cast("long"))).alias("spaced"),
    )


def array_access_suite(spark, d):
    a = F.col("a")
    return _lists(spark, d).select(
        "l_orderkey",
        A.size(a).alias("n"),
        A.get(a, 0).alias("first"),
        A.get_or_default(a, 4, lambda i: -i).alias("fifth"),
        A.try_get(a, 2).alias("third"),
        A.has(a, 3).alias("has3"),
        A.find_first(a, 10).alias("at10"),
        _text(A.find_all(a, 10)).alias("all10"),
        _text(A.get_keys(a, F.array(F.lit(0), F.lit(9)), lambda i: i * 100)).alias("gathered"),
        _text(A.slice_(a, 1, -1)).alias("inner"),
        _text(A.slice_(a, -2, 99)).alias("tail"),
    )


def array_order_suite(spark, d):
    a = F.col("a")
    s = A.sort(a)
    r = A.find_sorted_range(s, 20)
    return _lists(spark, d).select(
        "l_orderkey",
        _text(s).alias("sorted"),
        _text(A.sort(a, lambda x: x % 7)).alias("stable"),
        _text(A.reverse(a)).alias("reversed"),
        A.is_sorted(a).alias("is_sorted"),
        A.find_sorted_first(s, 20).alias("lower"),
        A.find_sorted_last(s, 20).alias("upper"),
        (r["end"] - r["start"]).alias("equal"),
    )


def array_change_suite(spark, d):
    a = F.col("a")
    b = F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))
    return _lists(spark, d).select(
        "l_orderkey",
        _text(A.update(a, 0, F.lit(-1).cast("long"))).alias("updated"),
        _text(A.merge(a, 0, 5, lambda old, new, i: old * 10 + new)).alias("merged"),
        _text(A.push_last(a, F.lit(7).cast("long"))).alias("pushed"),
        _text(A.push_first(a, F.lit(7).cast("long"))).alias("led"),
        A.pop_last(a)["value"].alias("last"),
        _text(A.pop_last(a)["rest"]).alias("but_last"),
        A.pop_first(a)["value"].alias("first"),
        _text(A.pop_first(a)["rest"]).alias("rest"),
        _text(A.append(a, b)).alias("appended"),
        _text(A.prepend(a, b)).alias("prepended"),
        _text(A.merge_all(a, b, lambda x, y, i: x + y * 100)).alias("over"),
        A.size(A.clear(a)).alias("cleared"),
    )


def array_higher_suite(spark, d):
    a = F.col("a")
    return _lists(spark, d).select(
        "l_orderkey",
        _text(A.map_(a, lambda x, i: x * 2 + i)).alias("mapped"),
        _text(A.filter_(a, lambda x: x % 2 == 0)).alias("even"),
        _text(A.filter_map(a, lambda x: F.when(x > 25, x - 25))).alias("kept"),
        A.first_map(a, lambda x: F.when(x > 25, x)).alias("first_big"),
        A.map_reduce(a, lambda x: x + 1, lambda p, q: p + q).alias("reduced"),
        A.fold(a, F.lit(0).cast("long"), lambda acc, x, i: acc * 3 % 1009 + x * (i + 1)).alias("folded"),
        A.string_join(F.transform(a, lambda x: x.cast("string")), "-").alias("joined"),
        _text(A.to_set(a, lambda x: x % 10)).alias("digits"),
        _text(A.flatten_to_array(a, lambda x: F.array(x, -x))).alias("both"),
        _text(A.flatten_to_set(a, lambda x: F.array(x % 3, x % 5))).alias("residues"),
    )


def array_to_dict_suite(spark, d):
    a = F.col("a")
    return _lists(spark, d).select(
        "l_orderkey",
        _dict_text(A.to_dict(a, lambda x: x % 3, lambda x: x, lambda old, new, k: old * 2 + new)).alias("merged"),
        _dict_text(A.group_fold(a, lambda x: x % 4, lambda k: k * 1000, lambda acc, x, i: acc + x)).alias("folded"),
    )


def _sets(spark, d):
    a = F.col("a")
    return _lists(spark, d).select("l_orderkey", S.of(F.transform(a, lambda x: x % 12)).alias("s"), S.of(F.transform(a, lambda x: (x * 5) % 12)).alias("t"))


_SQL_SETS = _SQL_LISTS + ", s AS (SELECT l_orderkey, list_sort(list_distinct([x % 12 for x in a])) s, list_sort(list_distinct([x * 5 % 12 for x in a])) t FROM l) "


def set_suite(spark, d):
    s, t = F.col("s"), F.col("t")
    three = F.lit(3).cast("long")
    return _sets(spark, d).select(
        "l_orderkey",
        S.size(s).alias("n"),
        S.has(s, three).alias("has3"),
        _text(S.union(s, t)).alias("either"),
        _text(S.intersect(s, t)).alias("common"),
        _text(S.diff(s, t)).alias("minus"),
        _text(S.sym_diff(s, t)).alias("odd"),
        S.is_subset(s, t).alias("subset"),
        S.is_disjoint(s, t).alias("disjoint"),
        _text(S.try_insert(s, three)["set"]).alias("with3"),
        S.try_insert(s, three)["inserted"].alias("fresh"),
        _text(S.try_delete(s, three)["set"]).alias("without3"),
        _dict_text(S.map_(s, lambda x: x * x)).alias("squares"),
        S.reduce(s, lambda acc, x: acc * 7 % 101 + x, F.lit(1).cast("long")).alias("folded"),
        _text(S.filter_(s, lambda x: x > 5)).alias("high"),
        _dict_text(S.filter_map(s, lambda x: F.when(x % 2 == 0, x + 1))).alias("even"),
    )


def _dicts(spark, d):
    # One shuffle by order serves both aggregates; lines of an order seldom meet before it.
    lines = T(spark, d, "lineitem").repartition("l_orderkey").groupBy("l_orderkey", F.col("l_linenumber").cast("long").alias("key")).agg(F.max("l_quantity").cast("long").alias("value"))
    return lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("key", "value"))).alias("d"))


_SQL_DICTS = "WITH e AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) k, CAST(max(l_quantity) AS BIGINT) v FROM lineitem GROUP BY 1, 2), d AS (SELECT l_orderkey, list({'k': k, 'v': v} ORDER BY k) d FROM e GROUP BY 1) "


def dict_suite(spark, d):
    c = F.col("d")
    other = F.array(*(F.struct(F.lit(k).cast("long").alias("key"), F.lit(v).cast("long").alias("value")) for k, v in ((1, 500), (9, 900))))
    one = F.lit(1).cast("long")
    return _dicts(spark, d).select(
        "l_orderkey",
        D.size(c).alias("n"),
        D.has(c, 3).alias("has3"),
        D.try_get(c, 2).alias("second"),
        D.get_or_default(c, F.lit(5).cast("long"), lambda k: -k).alias("fifth"),
        _text(D.keys(c)).alias("keys"),
        _dict_text(D.insert_or_update(c, one, F.lit(1000).cast("long"), lambda old, new, k: old + new)).alias("upserted"),
        _dict_text(D.try_delete(c, one)["dict"]).alias("deleted"),
        _dict_text(D.union(c, other, lambda x, y, k: x * 1000 + y)).alias("unioned"),
        _dict_text(D.map_(c, lambda v, k: v * k)).alias("mapped"),
        _dict_text(D.filter_(c, lambda v: v > 25)).alias("high"),
        D.first_map(c, lambda v, k: F.when(v > 25, k)).alias("first_high"),
        D.reduce(c, lambda acc, v, k: acc * 3 % 1009 + v * k, F.lit(0).cast("long")).alias("folded"),
        _text(D.to_array(c, lambda v, k: v - k)).alias("listed"),
        _text(D.to_set(c, lambda v: v % 4)).alias("kinds"),
        _dict_text(D.to_dict(c, lambda v: v % 3, lambda v: v, lambda old, new, k: F.greatest(old, new))).alias("rekeyed"),
        _dict_text(D.group_fold(c, lambda v: v % 2, lambda g: F.lit(0).cast("long"), lambda acc, v, k: acc + k)).alias("grouped"),
    )


def vector_suite(spark, d):
    v = F.col("embedding").cast("array<double>")
    return T(spark, d, "embeddings").select(
        "vec_id",
        V.length(v).alias("n"),
        F.round(V.norm(v), 5).alias("norm"),
        F.round(V.dot(v, F.reverse(v)), 5).alias("mirror"),
        F.round(V.get(v, 3), 5).alias("third"),
        F.round(V.fold(V.slice_(v, 0, 8), F.lit(0.0), lambda s, x: s + x), 5).alias("lead"),
        V.length(V.concat(v, V.zeros(3))).alias("longer"),
        F.round(V.get(V.map_(v, lambda x: x * 2), 0), 5).alias("doubled"),
    )


def matrix_suite(spark, d):
    m = V.vector_to_matrix(V.slice_(F.col("embedding").cast("array<double>"), 0, 12), 3, 4)
    t = V.matrix_transpose(m)
    scaled = V.matrix_map_elements(m, lambda x, r, c: x * (r + 1))
    return T(spark, d, "embeddings").select(
        "vec_id",
        V.matrix_rows(t).alias("rows"),
        V.matrix_cols(t).alias("cols"),
        F.round(V.matrix_get(m, 1, 2), 5).alias("cell"),
        F.round(V.matrix_get(t, 2, 1), 5).alias("turned"),
        F.round(F.aggregate(V.matrix_get_row(m, 2), F.lit(0.0), lambda s, x: s + x), 5).alias("row_sum"),
        F.round(F.aggregate(V.matrix_get_col(m, 1), F.lit(0.0), lambda s, x: s + x), 5).alias("col_sum"),
        F.round(V.matrix_get(scaled, 2, 3), 5).alias("scaled"),
        F.size(V.matrix_to_array(m)).cast("long").alias("n_rows"),
        F.round(V.matrix_get(V.matrix_from_array(V.matrix_to_array(m)), 2, 0), 5).alias("again"),
    )


def _j(x: str) -> str:
    return f"array_to_string({x}, ',')"


def _dj(x: str) -> str:
    """Entries {k, v} as text."""
    return f"array_to_string([x.k || '=' || x.v for x in {x}], ',')"


QUERIES_SQL = {
    array_make_suite: f"""SELECT n_nationkey, {_j("[i * 2 for i in range(0, greatest(n_nationkey % 4 - 1, 0))]")} AS generated, {_j("range(n_nationkey, 10, 3)")} AS up, {_j("range(10, n_nationkey, -4)")} AS down,
{_j("[CAST(round(i * n_nationkey / 4.0 * 4) AS BIGINT) for i in range(0, 5)]")} spaced FROM nation""",
    array_access_suite: _SQL_LISTS
    + f"""SELECT l_orderkey, len(a) n, a[1] AS first, coalesce(a[5], -4) fifth, a[3] third, len(a) > 3 has3, nullif(list_position(a, 10), 0) - 1 at10, {_j("[i - 1 for i in range(1, len(a) + 1) if a[i] = 10]")} all10,
a[1] || ',' || coalesce(a[10], 900) gathered, {_j("a[2:len(a) - 1]")} AS inner, {_j("a[greatest(len(a) - 1, 1):len(a)]")} tail FROM l""",
    array_order_suite: _SQL_LISTS
    + f"""SELECT l_orderkey, {_j("list_sort(a)")} sorted, {_j("[s.x for s in list_sort([{'k': a[i] % 7, 'i': i, 'x': a[i]} for i in range(1, len(a) + 1)])]")} AS stable, {_j("list_reverse(a)")} reversed, list_sort(a) = a is_sorted,
len([x for x in a if x < 20]) AS lower, len([x for x in a if x <= 20]) AS upper, len([x for x in a if x = 20]) equal FROM l""",
    array_change_suite: _SQL_LISTS
    + f"""SELECT l_orderkey, {_j("[CASE WHEN i = 1 THEN -1 ELSE a[i] END for i in range(1, len(a) + 1)]")} updated, {_j("[CASE WHEN i = 1 THEN a[i] * 10 + 5 ELSE a[i] END for i in range(1, len(a) + 1)]")} merged,
{_j("list_append(a, 7)")} pushed, {_j("list_prepend(7, a)")} led, a[-1] AS last, {_j("a[1:len(a) - 1]")} but_last, a[1] AS first, {_j("a[2:]")} rest, {_j("list_concat(a, [1, 2])")} appended, {_j("list_concat([1, 2], a)")} prepended,
{_j("[CASE WHEN i <= 2 THEN a[i] + i * 100 ELSE a[i] END for i in range(1, len(a) + 1)]")} AS over, CAST(0 AS BIGINT) cleared FROM l""",
    array_higher_suite: _SQL_LISTS
    + f"""SELECT l_orderkey, {_j("[a[i] * 2 + i - 1 for i in range(1, len(a) + 1)]")} mapped, {_j("[x for x in a if x % 2 = 0]")} even, {_j("[x - 25 for x in a if x > 25]")} kept, [x for x in a if x > 25][1] first_big,
CAST(list_sum(a) + len(a) AS BIGINT) reduced, list_reduce(list_concat([0], [a[i] * i for i in range(1, len(a) + 1)]), lambda p, q: p * 3 % 1009 + q) folded, array_to_string(a, '-') joined,
{_j("list_sort(list_distinct([x % 10 for x in a]))")} digits, {_j("flatten([[x, -x] for x in a])")} AS both, {_j("list_sort(list_distinct(flatten([[x % 3, x % 5] for x in a])))")} residues FROM l""",
    array_to_dict_suite: """WITH e AS (SELECT l_orderkey, CAST(l_quantity AS BIGINT) x, l_linenumber i FROM lineitem), m AS (SELECT l_orderkey, x % 3 k, list(x ORDER BY i, x) v FROM e GROUP BY 1, 2),
g AS (SELECT l_orderkey, x % 4 k, CAST(sum(x) AS BIGINT) v FROM e GROUP BY 1, 2), a AS (SELECT l_orderkey, string_agg(k || '=' || list_reduce(v, lambda p, q: p * 2 + q), ',' ORDER BY k) merged FROM m GROUP BY 1),
b AS (SELECT l_orderkey, string_agg(k || '=' || (k * 1000 + v), ',' ORDER BY k) folded FROM g GROUP BY 1) SELECT l_orderkey, merged, folded FROM a JOIN b USING (l_orderkey)""",
    set_suite: _SQL_SETS
    + f"""SELECT l_orderkey, len(s) n, list_contains(s, 3) has3, {_j("list_sort(list_distinct(list_concat(s, t)))")} AS either, {_j("list_sort(list_intersect(s, t))")} common, {_j("[x for x in s if NOT list_contains(t, x)]")} AS minus,
{_j("list_sort(list_concat([x for x in s if NOT list_contains(t, x)], [x for x in t if NOT list_contains(s, x)]))")} odd, list_has_all(t, s) subset, NOT list_has_any(s, t) disjoint, {_j("list_sort(list_distinct(list_append(s, 3)))")} with3,
NOT list_contains(s, 3) fresh, {_j("[x for x in s if x <> 3]")} without3, {_j("[x || '=' || (x * x) for x in s]")} squares, list_reduce(list_concat([1], s), lambda p, q: p * 7 % 101 + q) folded, {_j("[x for x in s if x > 5]")} high,
{_j("[x || '=' || (x + 1) for x in s if x % 2 = 0]")} even FROM s""",
    dict_suite: _SQL_DICTS
    + f""", r AS (SELECT l_orderkey, string_agg(q || '=' || v, ',' ORDER BY q) rekeyed FROM (SELECT l_orderkey, v % 3 q, max(v) v FROM e GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT l_orderkey, string_agg(q || '=' || v, ',' ORDER BY q) grouped FROM (SELECT l_orderkey, v % 2 q, CAST(sum(k) AS BIGINT) v FROM e GROUP BY 1, 2) GROUP BY 1)
SELECT d.l_orderkey, len(d) n, len([x for x in d if x.k = 3]) > 0 has3, [x.v for x in d if x.k = 2][1] AS second, coalesce([x.v for x in d if x.k = 5][1], -5) fifth, {_j("[x.k for x in d]")} keys,
array_to_string(list_concat(['1=' || (coalesce([x.v for x in d if x.k = 1][1], 0) + 1000)], [x.k || '=' || x.v for x in d if x.k <> 1]), ',') upserted, {_dj("[y for y in d if y.k <> 1]")} deleted,
array_to_string(list_concat(['1=' || CASE WHEN len([x for x in d if x.k = 1]) > 0 THEN [x.v for x in d if x.k = 1][1] * 1000 + 500 ELSE 500 END], [x.k || '=' || x.v for x in d if x.k <> 1], ['9=900']), ',') unioned,
array_to_string([x.k || '=' || (x.v * x.k) for x in d], ',') mapped, {_dj("[y for y in d if y.v > 25]")} high, [x.k for x in d if x.v > 25][1] first_high,
list_reduce(list_concat([0], [x.v * x.k for x in d]), lambda p, q: p * 3 % 1009 + q) folded, {_j("[x.v - x.k for x in d]")} listed, {_j("list_sort(list_distinct([x.v % 4 for x in d]))")} kinds, rekeyed, grouped
FROM d JOIN r USING (l_orderkey) JOIN g USING (l_orderkey)""",
    vector_suite: """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) e FROM embeddings) SELECT vec_id, len(e) n, round(sqrt(list_inner_product(e, e)), 5) norm, round(list_inner_product(e, list_reverse(e)), 5) mirror, round(e[4], 5) third,
round(list_sum(e[1:8]), 5) AS lead, len(e) + 3 longer, round(e[1] * 2, 5) doubled FROM v""",
    matrix_suite: """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) e FROM embeddings) SELECT vec_id, CAST(4 AS BIGINT) AS rows, CAST(3 AS BIGINT) cols, round(e[7], 5) cell, round(e[7], 5) turned, round(list_sum(e[9:12]), 5) row_sum,
round(e[2] + e[6] + e[10], 5) col_sum, round(e[12] * 3, 5) scaled, CAST(3 AS BIGINT) n_rows, round(e[9], 5) again FROM v""",
}
