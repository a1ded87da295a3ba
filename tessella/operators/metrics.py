"""Evaluation metrics as aggregates of label and prediction columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def regression(y: Column, p: Column, alpha: float = 0.5, delta: float = 1.0, power: float = 0.0) -> dict[str, Column]:
    """Regression metrics by name; one that is undefined is null. r2 needs ``r2`` of a frame's own moments, done here in one pass.

    ``median_ae`` as an aggregate holds a group's distinct errors in one task; ``regression_row`` doesn't.
    """
    e = y - p
    n = F.count(e)
    var = lambda x: F.var_pop(x)
    tweedie = (
        e * e
        if power == 0
        else 2 * (F.when(y == 0, 0.0).otherwise(y * F.ln(y / p)) - e)
        if power == 1
        else 2 * (F.ln(p / y) + y / p - 1)
        if power == 2
        else 2 * (F.pow(F.greatest(y, F.lit(0.0)), F.lit(2 - power)) / ((1 - power) * (2 - power)) - y * F.pow(p, F.lit(1 - power)) / (1 - power) + F.pow(p, F.lit(2 - power)) / (2 - power))
    )
    return {
        "mse": F.avg(e * e),
        "rmse": F.sqrt(F.avg(e * e)),
        "mae": F.avg(F.abs(e)),
        "r2": 1 - F.avg(e * e) / F.nullif(var(y), F.lit(0.0)),
        "mape": F.avg(F.abs(e) / F.greatest(F.abs(y), F.lit(2.220446049250313e-16))),
        "explained_variance": 1 - var(e) / F.nullif(var(y), F.lit(0.0)),
        "max_error": F.max(F.abs(e)),
        "median_ae": F.median(F.abs(e)),
        "mean_error": F.avg(-e),
        "pinball_loss": F.avg(F.greatest(alpha * e, (alpha - 1) * e)),
        "huber": F.avg(F.when(F.abs(e) <= delta, e * e / 2).otherwise(delta * (F.abs(e) - delta / 2))),
        "mean_tweedie_deviance": F.when(n > 0, F.avg(tweedie)),
    }


def _regression(df: DataFrame, targets: dict[str, tuple[Column, Column]], names: list[str]) -> DataFrame:
    """One row of ``target__name`` columns: one pass for all, and narrowing passes for each median."""
    from tessella.operators.statistics import exact_quantiles

    medians = {t: exact_quantiles(df.select(F.abs(y - p).alias("e")), "e", [0.5])[0] for t, (y, p) in targets.items() if "median_ae" in names}
    each = {f"{t}__{n}": F.max(F.lit(medians[t]).cast("double")) if n == "median_ae" else regression(y, p)[n] for t, (y, p) in targets.items() for n in names}
    return df.agg(*(c.alias(k) for k, c in each.items()))


def regression_row(df: DataFrame, y: Column, p: Column, names: list[str]) -> DataFrame:
    """The named metrics of a whole frame; no task holds more than a bounded number of values."""
    row = _regression(df, {"t": (y, p)}, names)
    return row.select(*(F.col(f"t__{n}").alias(n) for n in names))


def regression_multi(df: DataFrame, targets: dict[str, tuple[str, str]], names: list[str], average: bool = False) -> DataFrame:
    """target and the named metrics for each (label, prediction) pair, or their mean over targets; rows are read once, and again for medians."""
    wide = _regression(df, {t: (F.col(y), F.col(p)) for t, (y, p) in targets.items()}, names)
    rows = F.array(*(F.struct(F.lit(t).alias("target"), *(F.col(f"{t}__{n}").alias(n) for n in names)) for t in targets))
    each = wide.select(F.inline(rows))
    return each.agg(*(F.avg(n).alias(n) for n in names)) if average else each


def classification_multi(df: DataFrame, targets: dict[str, tuple[str, str]], average: str = "macro") -> DataFrame:
    """target and the classification metrics for each (label, prediction) pair."""
    out = None
    for t, (y, p) in targets.items():
        one = classification(df, y, p, average).select(F.lit(t).alias("target"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def confusion(df: DataFrame, y: str, p: str) -> DataFrame:
    """actual, predicted, n over the union of classes on both axes."""
    classes = df.select(F.explode(F.array(F.col(y).cast("long"), F.col(p).cast("long"))).alias("c")).distinct()
    counts = df.groupBy(F.col(y).cast("long").alias("actual"), F.col(p).cast("long").alias("predicted")).agg(F.count("*").alias("n"))
    # Classes only: a label set, not rows.
    grid = classes.select(F.col("c").alias("actual"), F.lit(1).alias("__one")).join(classes.select(F.col("c").alias("predicted"), F.lit(1).alias("__one")), "__one").drop("__one")
    return grid.join(counts, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def classification(df: DataFrame, y: str, p: str, average: str = "macro", positive: int = 1, kappa: str = "none") -> DataFrame:
    """accuracy, balanced_accuracy, precision, recall, f1, jaccard, matthews_corrcoef, cohen_kappa in one row; x / 0 is 0.

    Everything comes from the confusion counts, so rows are read once.
    """
    m = confusion(df, y, p)
    diagonal = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    rows = m.groupBy(F.col("actual").alias("c")).agg(F.sum("n").alias("t"), F.sum(diagonal).alias("tp"))
    cols = m.groupBy(F.col("predicted").alias("c")).agg(F.sum("n").alias("q"))
    per = rows.join(cols, "c")
    zero = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    prec, rec = zero(F.col("tp"), F.col("q")), zero(F.col("tp"), F.col("t"))
    jac = zero(F.col("tp"), F.col("t") + F.col("q") - F.col("tp"))
    f1 = zero(2 * F.col("tp"), F.col("t") + F.col("q"))
    if average == "macro":
        pick = lambda x: F.avg(x)
    elif average == "weighted":
        pick = lambda x: F.sum(x * F.col("t")) / F.sum("t")
    elif average == "binary":
        pick = lambda x: F.max(F.when(F.col("c") == positive, x))
    elif average == "micro":
        tp, t, q = F.sum("tp"), F.sum("t"), F.sum("q")
        micro = {"precision": tp / q, "recall": tp / t, "f1": 2 * tp / (t + q), "jaccard": tp / (t + q - tp)}
    else:
        raise ValueError(f"unknown average: {average}")
    scores = micro if average == "micro" else {"precision": pick(prec), "recall": pick(rec), "f1": pick(f1), "jaccard": pick(jac)}
    n, hit = F.sum("t"), F.sum("tp")
    cross, tt, qq = F.sum(F.col("t") * F.col("q")), F.sum(F.col("t") * F.col("t")), F.sum(F.col("q") * F.col("q"))
    spread = F.sqrt((n * n - tt).cast("double") * (n * n - qq).cast("double"))
    mcc = F.when(spread == 0, F.lit(0.0)).otherwise((hit * n - cross) / spread)
    seen = F.col("t") > 0
    out = per.agg(
        (hit / n).alias("accuracy"),
        F.avg(F.when(seen, F.col("tp") / F.col("t"))).alias("balanced_accuracy"),
        *(c.alias(k) for k, c in scores.items()),
        mcc.alias("matthews_corrcoef"),
    )
    ranks = rows.select("c", (F.row_number().over(Window.orderBy("c")) - 1).alias("r"))  # over classes
    wide = m.join(ranks.select(F.col("c").alias("actual"), F.col("r").alias("i")), "actual").join(ranks.select(F.col("c").alias("predicted"), F.col("r").alias("j")), "predicted")
    wide = wide.join(rows.select(F.col("c").alias("actual"), "t"), "actual").join(cols.select(F.col("c").alias("predicted"), "q"), "predicted")
    w = {"none": (F.col("i") != F.col("j")).cast("double"), "linear": F.abs(F.col("i") - F.col("j")).cast("double"), "quadratic": F.pow((F.col("i") - F.col("j")).cast("double"), F.lit(2.0))}[kappa]
    k = wide.agg((1 - F.sum(w * F.col("n")) * F.sum("n") / F.nullif(F.sum(w * F.col("t") * F.col("q")), F.lit(0.0))).alias("cohen_kappa"))
    return out.join(F.broadcast(k), F.lit(True))


def roc_auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """Area under the ROC curve of 0/1 labels: pairs counted from the label counts of each distinct score, in range order."""
    from tessella.operators.statistics import average_ranks

    ranked = average_ranks(df.select(y, score), score, "__rank")
    pos = F.sum((F.col(y) == 1).cast("long"))
    neg = F.count("*") - pos
    ranks = F.sum(F.when(F.col(y) == 1, F.col("__rank")))
    return ranked.agg(((ranks - pos * (pos + 1) / 2) / F.nullif(pos * neg, F.lit(0))).alias("roc_auc"))


def roc_auc_multi(df: DataFrame, y: str, scores: dict[int, str], weighted: bool = False) -> DataFrame:
    """One against the rest, averaged over classes."""
    parts = None
    for c, s in scores.items():
        one = roc_auc(df.select((F.col(y) == c).cast("int").alias("y"), F.col(s).alias("s")), "y", "s")
        one = one.join(F.broadcast(df.agg(F.sum((F.col(y) == c).cast("long")).alias("w"))), F.lit(True))
        parts = one if parts is None else parts.unionByName(one)
    return parts.agg((F.sum(F.col("roc_auc") * F.col("w")) / F.sum("w") if weighted else F.avg("roc_auc")).alias("roc_auc"))


def log_loss(y: Column, p: Column, eps: float = 2.220446049250313e-16) -> Column:
    """Cross entropy of 0/1 labels and the probability of 1."""
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return -F.avg(F.when(y == 1, F.ln(q)).otherwise(F.ln(1 - q)))


def silhouette(df: DataFrame, features: str, label: str, row_id: str, left: int = 1 << 15, right: int = 1 << 17) -> DataFrame:
    """Mean Euclidean silhouette. Quadratic by definition: at most about ``left`` rows meet ``right`` rows in a task, and only sums per row and cluster leave it.

    A row without label or features, or alone in its cluster, counts 0; no cluster but its own has rows without label.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    rows = df.select(F.col(row_id).cast("long").alias("id"), F.col(label).cast("long").alias("c"), F.col(features).cast("array<double>").alias("x"))
    n = rows.count()
    # Small tables are still cut for some tasks; larger ones by size.
    down, across = max(1, min(24, -(-n // 1024)), -(-n // left)), max(1, -(-n // right))
    dealt = lambda parts: F.pmod(F.xxhash64("id"), F.lit(parts))
    every = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
    known = rows.where("c is not null")
    mine = known.where("x is not null").select(dealt(down).alias("i"), every(across).alias("j"), F.lit(0).alias("side"), "id", "c", "x")
    theirs = known.select(every(down).alias("i"), dealt(across).alias("j"), F.lit(1).alias("side"), "id", "c", "x")
    cells = mine.unionByName(theirs).select((F.col("i") * across + F.col("j")).cast("int").alias("cell"), "side", "id", "c", "x")

    def matrix(col) -> np.ndarray:
        held = col.drop_null()
        sizes = np.unique(pc.list_value_length(held).to_numpy(zero_copy_only=False))
        if len(sizes) > 1:
            raise ValueError(f"feature vectors of unlike length: {sizes.tolist()}")
        return held.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(held), -1)

    def sums(batches):
        cell, held, done = None, [], {}

        def ended():
            # A cluster's rows come one after the other; one that is complete is told.
            for k in list(done):
                d, seen, count = done.pop(k)
                ids, cs = (np.concatenate([h[c] for h in held]) for c in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(cs), pa.array(np.full(len(ids), k)), pa.array(d, mask=np.full(len(ids), not seen)), pa.array(np.full(len(ids), count))], names=["id", "c", "k", "d", "n"])

        for batch in batches:
            at, side = (batch.column(c).to_numpy() for c in (0, 1))
            cuts = [0, *(np.flatnonzero((np.diff(at) != 0) | (np.diff(side) != 0)) + 1).tolist(), len(at)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if at[lo] != cell:
                    yield from ended()
                    cell, held = at[lo], []
                part = batch.slice(lo, hi - lo)
                if side[lo] == 0:
                    held.append((part.column(2).to_numpy(zero_copy_only=False), part.column(3).to_numpy(), matrix(part.column(4))))
                    continue
                for first in range(0, part.num_rows if held else 0, 1024):
                    own = part.slice(first, 1024)
                    c, valid = own.column(3).to_numpy(), own.column(4).is_valid().to_numpy(zero_copy_only=False)
                    if done and c[0] not in done:
                        yield from ended()
                    kinds, counts = np.unique(c, return_counts=True)
                    y = matrix(own.column(4))
                    seen, starts = np.unique(c[valid], return_index=True)
                    for k, m in zip(kinds.tolist(), counts.tolist(), strict=True):
                        old = done.get(k) or (np.zeros(sum(len(h[0]) for h in held)), False, 0)
                        done[k] = (old[0], old[1] or bool(np.isin(k, seen)), old[2] + m)
                    # Squared distances as one product: of (x, 1, x * x) with (-2 y, y * y, 1).
                    other, base = np.vstack([-2 * y.T, (y**2).sum(1), np.ones(len(y))]), 0
                    for _, _, xs in held if len(y) else ():
                        for at_x in range(0, len(xs), 256):
                            x = xs[at_x : at_x + 256]
                            d = np.column_stack([x, np.ones(len(x)), (x**2).sum(1)]) @ other
                            np.sqrt(np.maximum(d, 0, out=d), out=d)
                            for k, col in zip(seen.tolist(), np.add.reduceat(d, starts, axis=1).T, strict=True):
                                done[k][0][base : base + len(x)] += col
                            base += len(x)
                    last = done.pop(c[-1])
                    yield from ended()
                    done[int(c[-1])] = last
        yield from ended()

    parts = cells.repartitionById(down * across, F.col("cell")).sortWithinPartitions("cell", "side", "c").mapInArrow(sums, "id long, c long, k long, d double, n long")
    parts = parts.unionByName(rows.where("c is null or x is null").select("id", "c", F.lit(None).cast("long").alias("k"), F.lit(None).cast("double").alias("d"), F.lit(0).cast("long").alias("n")))
    per = parts.groupBy("id", "c", "k").agg(F.sum("d").alias("d"), F.sum("n").alias("n"))
    a = F.max(F.when(F.col("c") == F.col("k"), F.col("d") / F.nullif(F.col("n") - 1, F.lit(0))))
    b = F.min(F.when(F.col("c") != F.col("k"), F.col("d") / F.col("n")))
    each = per.groupBy("id").agg(a.alias("a"), b.alias("b"))
    s = F.when(F.col("a").isNull() | F.col("b").isNull(), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return each.agg(F.avg(s).alias("silhouette"))


def importance(df: DataFrame, values: dict[str, str]) -> DataFrame:
    """feature, mean, std of the absolute contributions in named columns."""
    total = df.agg(*(f(F.abs(F.col(c))).alias(f"{n}__{k}") for n, c in values.items() for k, f in (("mean", F.avg), ("std", F.stddev_pop))))
    rows = F.array(*(F.struct(F.lit(n).alias("feature"), F.col(f"{n}__mean").alias("mean"), F.col(f"{n}__std").alias("std")) for n in values))
    return total.select(F.inline(rows))


def gaussian_criteria(log_likelihood: float, parameters: int, n: int) -> dict[str, float]:
    """aic and bic of a fitted mixture."""
    return {"aic": 2 * parameters - 2 * log_likelihood, "bic": parameters * math.log(n) - 2 * log_likelihood}
