"""Descriptive and robust statistics, correlation, histograms and densities as aggregates."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import stable


def describe(x: Column) -> dict[str, Column]:
    """count, mean, variance (n - 1), skewness and excess kurtosis (population), min, max."""
    return {
        "count": F.count(x),
        "mean": F.avg(x),
        "variance": F.var_samp(x),
        "skewness": F.skewness(x),
        "kurtosis": F.kurtosis(x),
        "min": F.min(x),
        "max": F.max(x),
    }


def quantile(x: Column, q: float) -> Column:
    """Exact quantile with linear interpolation."""
    return F.percentile(x, F.lit(q))


def percentiles(x: Column, points: list[float]) -> Column:
    return F.percentile(x, F.array(*(F.lit(p / 100) for p in points)))


def median(x: Column) -> Column:
    return F.median(x)


def iqr(x: Column) -> Column:
    return quantile(x, 0.75) - quantile(x, 0.25)


def percentile_of_score(x: Column, score: float) -> Column:
    """Percent of values below the score, and half of the places of its equals, and half a place if it has any."""
    below, upto = F.sum((x < score).cast("long")), F.sum((x <= score).cast("long"))
    return (below + upto + (upto > below).cast("long")) * 50.0 / F.count(x)


SMALL = 1_000_000
FEW_GROUPS = 10_000


def nth(values: DataFrame, n: int, k: int, small: int, accuracy: int = 10_000) -> float:
    """The value of rank k (from 0) among n: a sketch gives bounds around it, what lies between is looked at again."""
    below, reach = 0, 2.0
    while n > small:
        share = lambda d: min(1.0, max(0.0, (k - below + d * n / accuracy) / n))  # noqa: E731, B023
        low, high = values.agg(F.percentile_approx("v", [share(-reach), share(reach)], accuracy).alias("b")).first()["b"]
        row = values.agg(F.count_if(F.col("v") < low).alias("less"), F.count_if(F.col("v").between(low, high)).alias("inside")).first()
        if not below + row["less"] <= k < below + row["less"] + row["inside"]:
            reach *= 4
            continue
        if low == high:
            return low
        if row["inside"] == n:
            # Few distinct values: their counts are small.
            counts = values.groupBy("v").agg(F.count("*").alias("n"))
            upto = F.sum("n").over(Window.orderBy("v"))
            return counts.withColumn("upto", upto).where(F.col("upto") > k - below).agg(F.min("v").alias("v")).first()["v"]
        below, n, values = below + row["less"], row["inside"], values.where(F.col("v").between(low, high))
    return values.agg(F.get(F.array_sort(F.collect_list("v")), F.lit(k - below)).alias("v")).first()["v"]


def exact_quantiles(df: DataFrame, x: str, points: list[float], small: int = SMALL, accuracy: int = 10_000) -> list[float | None]:
    """Exact quantiles with linear interpolation; no task holds more than ``small`` values.

    Up to ``small`` rows one aggregate gives them. Beyond, each pass over the rows
    narrows the range that holds a quantile by a factor of about ``accuracy`` / 4.
    """
    values = df.select(F.col(x).cast("double").alias("v")).where("v is not null")
    n = values.count()
    if n == 0:
        return [None] * len(points)
    if n <= small:
        return list(values.agg(F.percentile("v", F.array(*map(F.lit, points))).alias("q")).first()["q"])
    out = []
    for q in points:
        at = q * (n - 1)
        k = min(int(at), n - 1)
        a = nth(values, n, k, small, accuracy)
        b = a if at == k else nth(values, n, k + 1, small, accuracy)
        out.append(a + (b - a) * (at - k))
    return out


def group_quantiles(df: DataFrame, by: list[str], x: str, points: list[float], accuracy: int = 10_000) -> DataFrame:
    """The columns ``by`` and ``quantiles``, exact with linear interpolation, per group of any size.

    Sketches bound each quantile; only the counts of the distinct values within these
    bounds, about four of ``accuracy`` parts of a group, meet in one task.
    """
    keys = [f"k{i}" for i in range(len(by))]
    same = lambda a, b: functools.reduce(Column.__and__, (F.col(f"{a}{k}").eqNullSafe(F.col(f"{b}{k}")) for k in keys), F.lit(True))
    values = df.select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), F.col(x).cast("double").alias("v"))
    shares = [min(1.0, max(0.0, q + side * 2 / accuracy)) for q in points for side in (-1, 1)]
    sketch = F.percentile_approx("v", shares, accuracy).alias("s")
    ends = values.groupBy(*keys).agg(F.count("v").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), sketch)
    # A small group is looked at as a whole.
    whole = F.col("n") <= 4 * accuracy
    at = lambda k, q: [(q * (F.col("n") - 1)).alias("at"), F.when(whole, F.col("least")).otherwise(F.col("s")[2 * k]).alias("low"), F.when(whole, F.col("most")).otherwise(F.col("s")[2 * k + 1]).alias("high")]
    ends = ends.select(*(F.col(k).alias(f"g{k}") for k in keys), "n", *(F.struct(*at(k, q)).alias(f"e{k}") for k, q in enumerate(points)))
    ends = stable(ends)
    # The large groups would each go to one task; few groups' bounds go to the rows instead.
    met = values.where("v is not null").join(F.broadcast(ends) if ends.count() <= FEW_GROUPS else ends, same("", "g"))
    less = met.groupBy(*keys).agg(*(F.count_if(F.col("v") < F.col(f"e{k}.low")).alias(f"less{k}") for k in range(len(points))))
    less = less.select(*(F.col(k).alias(f"l{k}") for k in keys), F.array(*(F.col(f"less{k}") for k in range(len(points)))).alias("less"))
    inside = lambda k: F.when(F.col("v").between(F.col(f"e{k}.low"), F.col(f"e{k}.high")), F.struct(F.lit(k).alias("p"), F.col(f"e{k}.at").alias("at")))
    near = met.select(*keys, "v", "n", F.explode(F.array_compact(F.array(*map(inside, range(len(points)))))).alias("e"))
    counts = near.groupBy(*keys, "n", F.col("e.p").alias("p"), F.col("e.at").alias("at"), "v").agg(F.count("*").alias("m"))
    base = F.get("less", F.col("p"))
    upto = F.sum("m").over(Window.partitionBy(*keys, "p").orderBy("v"))
    ranked = counts.withColumn("upto", upto).join(less, same("", "l")).select(*keys, "p", "at", "n", "v", (base + F.col("upto")).alias("upto"), base.alias("base"))
    first, second = F.floor("at"), F.least(F.floor("at") + 1, F.col("n") - 1)
    found = ranked.groupBy(*keys, "p", "at", "n").agg(F.min("base").alias("base"), F.min(F.when(F.col("upto") > first, F.col("v"))).alias("a"), F.min(F.when(F.col("upto") > second, F.col("v"))).alias("b"))
    sound = (F.col("base") <= first) & F.col("b").isNotNull()
    value = F.when(sound, F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - first)).otherwise(F.raise_error(F.lit("a sketch missed a quantile")).cast("double"))
    held = found.select(*keys, "p", value.alias("q")).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "q"))), lambda e: e["q"]).alias("quantiles"))
    # Groups without any value keep their row.
    held = held.select(*(F.col(k).alias(f"h{k}") for k in keys), "quantiles")
    return ends.join(held, same("g", "h"), "left").select(*(F.col(f"g{k}").alias(c) for c, k in zip(by, keys, strict=True)), "quantiles")


def robust(df: DataFrame, x: str, approximate: int | None = None) -> DataFrame:
    """median, iqr, mad, q1, q3 of a column, exact; ``approximate`` is the accuracy of sketches instead."""
    points = [0.5, 0.25, 0.75]
    if approximate:
        find = lambda d, c, p: d.agg(F.percentile_approx(c, p, approximate).alias("q")).first()["q"] or [None] * len(p)
    else:
        find = exact_quantiles
    median, q1, q3 = find(df, x, points)
    if median is None:
        return df.sparkSession.createDataFrame([(None,) * 5], "median double, iqr double, mad double, q1 double, q3 double")
    (mad,) = find(df.select(F.abs(F.col(x) - median).alias("d")), "d", [0.5])
    return df.sparkSession.createDataFrame([tuple(map(float, (median, q3 - q1, mad, q1, q3)))], "median double, iqr double, mad double, q1 double, q3 double")


def _t_tail(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation by the normal approximation of Fisher's transform."""
    z = F.abs(F.atanh(r)) * F.sqrt(n - 3)
    # Abramowitz and Stegun 26.2.17; fixed values.
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.least(2 * poly * F.exp(-z * z / 2) / math.sqrt(2 * math.pi), F.lit(1.0))


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """correlation and p_value of two columns."""
    out = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.corr(x, y).alias("correlation"), F.count("*").alias("__n"))
    return out.select("correlation", _t_tail(F.col("correlation"), F.col("__n")).alias("p_value"))


def average_ranks(df: DataFrame, x: str, name: str) -> DataFrame:
    """Each row with the average rank of its value among all.

    Only the counts of distinct values are ranked, by range partitions; rows get
    their rank by a join on the value.
    """
    from tessella.operators.collections import with_index

    counts = df.groupBy(x).agg(F.count("*").alias("__n"))
    ordered = with_index(counts, x).withColumnRenamed("__ix", "__i")
    part = ordered.withColumn("__p", F.floor(F.col("__i") / 10_000))
    sums = part.groupBy("__p").agg(F.sum("__n").alias("__s"))
    starts = sums.select("__p", F.coalesce(F.sum("__s").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__p").orderBy("__i").rowsBetween(Window.unboundedPreceding, -1)
    ranks = part.withColumn("__before", F.coalesce(F.sum("__n").over(inside), F.lit(0))).join(starts, "__p")
    ranks = ranks.select(x, (F.col("__start") + F.col("__before") + (F.col("__n") + 1) / 2).alias(name))
    return df.join(ranks, x)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation and p_value."""
    pairs = df.select(x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_ranks(average_ranks(pairs, x, "__rx"), y, "__ry")
    return pearson(ranked, "__rx", "__ry")


_RULES = ("sqrt", "sturges", "rice", "scott", "fd", "doane", "auto")


def bin_count(rule: str, n: int, low: float, high: float, std: float, iqr_: float, skew: float) -> int:
    """Bins of a rule; at least one."""
    if n == 0 or high == low:
        return 1
    sturges = math.log2(n) + 1
    by_width = lambda w: (high - low) / w if w > 0 else sturges
    fd = by_width(2 * iqr_ / n ** (1 / 3))
    if rule == "doane":
        sigma = math.sqrt(6 * (n - 2) / ((n + 1) * (n + 3))) if n > 2 else 0
        value = 1 + math.log2(n) + math.log2(1 + abs(skew) / sigma) if sigma else 1
    else:
        value = {"sqrt": math.sqrt(n), "sturges": sturges, "rice": 2 * n ** (1 / 3), "scott": by_width((24 * math.sqrt(math.pi) / n) ** (1 / 3) * std), "fd": fd, "auto": max(fd, sturges) if iqr_ > 0 else sturges}[rule]
    return max(1, math.ceil(value))


def histogram(df: DataFrame, x: str, bins: int | str = 10, low: float | None = None, high: float | None = None, weight: str | None = None, density: bool = False) -> DataFrame:
    """bin, low, high, count per bin; the last bin holds its upper edge. Empty bins have a row.

    ``bins`` may be the name of a rule, for which a row of statistics is fetched.
    """
    c = F.col(x)
    if low is None or high is None or isinstance(bins, str):
        s = df.agg(F.count(c).alias("n"), F.min(c).alias("a"), F.max(c).alias("b"), F.stddev_pop(c).alias("sd"), F.percentile_approx(c, [0.25, 0.75], 10_000).alias("q"), F.skewness(c).alias("sk")).first()
        if s["n"] == 0:
            low, high = low if low is not None else 0.0, high if high is not None else 1.0
        low, high = float(s["a"] if low is None else low), float(s["b"] if high is None else high)
        if isinstance(bins, str):
            bins = bin_count(bins, s["n"], low, high, s["sd"] or 0.0, (s["q"][1] - s["q"][0]) if s["q"] else 0.0, s["sk"] or 0.0)
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    number = F.least(F.floor((c - low) / width), F.lit(bins - 1)).cast("long")
    amount = F.sum(weight) if weight else F.count("*")
    counts = df.where((c >= low) & (c <= high)).groupBy(number.alias("bin")).agg(amount.alias("count"))
    every = df.sparkSession.range(bins).select(F.col("id").alias("bin"))
    out = every.join(counts, "bin", "left").select("bin", (low + F.col("bin") * width).alias("low"), (low + (F.col("bin") + 1) * width).alias("high"), F.coalesce("count", F.lit(0)).alias("count"))
    if density:
        total = out.agg(F.sum("count").alias("__t"))
        out = out.join(F.broadcast(total), F.lit(True)).withColumn("density", F.col("count") / F.col("__t") / width).drop("__t")
    return out


def kde(df: DataFrame, x: str, points: list[float], bandwidth: str | float = "scott", weight: str | None = None) -> DataFrame:
    """point, density: a Gaussian kernel density at the given points, in one aggregate over the rows."""
    w = F.col(weight) if weight else F.lit(1.0)
    s = df.agg(F.sum(w).alias("w"), F.sum(w * w).alias("w2"), F.sum(w * F.col(x)).alias("wx"), F.sum(w * F.col(x) * F.col(x)).alias("wxx")).first()
    effective = s["w"] ** 2 / s["w2"]
    mean = s["wx"] / s["w"]
    variance = (s["wxx"] / s["w"] - mean * mean) / (1 - 1 / effective)
    factor = {"scott": effective ** (-1 / 5), "silverman": (effective * 3 / 4) ** (-1 / 5)}.get(bandwidth, bandwidth)
    h = math.sqrt(variance) * factor
    spots = F.explode(F.array(*map(F.lit, points))).alias("point")
    kernel = w * F.exp(-F.pow((F.col("point") - F.col(x)) / h, F.lit(2.0)) / 2)
    weighted = df.select(x, *([weight] if weight else []), spots)
    return weighted.groupBy("point").agg((F.sum(kernel) / (s["w"] * h * math.sqrt(2 * math.pi))).alias("density"))


def interpolate(points: DataFrame, knots: DataFrame, x: str, y: str, bins: int = 256) -> DataFrame:
    """Linear interpolation of y at points.x from knots (x, y); null outside them.

    The line is cut into bins at quantiles of the knots. Within a bin knots are
    carried forward and backward along one order; the nearest knots of other bins
    come from a table of one row per bin.
    """
    cuts = sorted(set(knots.select(F.col(x).cast("double").alias(x)).approxQuantile(x, [k / bins for k in range(1, bins)], 0.25 / bins)))
    bin_of = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda c: c <= F.col(x)))
    knot = F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    spots = points.select(F.col(x), F.lit(None).cast("struct<x:double,y:double>").alias("k"), F.lit(True).alias("ask"), bin_of.alias("bin"))
    marks = knots.select(F.col(x), knot.alias("k"), F.lit(False).alias("ask"), bin_of.alias("bin"))
    ends = marks.groupBy("bin").agg(F.min("k").alias("first"), F.max("k").alias("last"))
    every = knots.sparkSession.range(len(cuts) + 1).select(F.col("id").cast("int").alias("bin")).join(ends, "bin", "left")
    before = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("bin").rowsBetween(1, Window.unboundedFollowing)
    near = every.select("bin", F.last("last", True).over(before).alias("prev"), F.first("first", True).over(after).alias("next"))  # a row per bin
    back = Window.partitionBy("bin").orderBy(x, "ask").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy("bin").orderBy(x, F.desc("ask")).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    carried = spots.unionByName(marks).withColumn("__a", F.last("k", True).over(back)).withColumn("__b", F.first("k", True).over(ahead)).where("ask")
    held = carried.join(F.broadcast(near), "bin").withColumn("a", F.coalesce("__a", "prev")).withColumn("b", F.coalesce("__b", "next"))
    slope = (F.col("b.y") - F.col("a.y")) / F.nullif(F.col("b.x") - F.col("a.x"), F.lit(0.0))
    return held.select(x, F.when(F.col("a.x") == F.col("b.x"), F.col("a.y")).otherwise(F.col("a.y") + slope * (F.col(x) - F.col("a.x"))).alias(y))
