"""Trained models on MLlib, and conformal intervals around any of them.

Same families as the usual single-node libraries, not the same bits: boosted trees,
Gaussian mixtures, least squares. State is kept by MLlib's own persistence.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep").transform(df)


def boosted_regressor(df: DataFrame, features: Sequence[str], label: str, rounds: int = 20, depth: int = 5, step: float = 0.1, seed: int = 0) -> Model:
    from pyspark.ml.regression import GBTRegressor

    return GBTRegressor(labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed).fit(assemble(df, features))


def boosted_classifier(df: DataFrame, features: Sequence[str], label: str, rounds: int = 20, depth: int = 5, step: float = 0.1, seed: int = 0) -> Model:
    from pyspark.ml.classification import GBTClassifier

    return GBTClassifier(labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed).fit(assemble(df, features))


def predict(model: Model, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """The frame with ``prediction`` and, for classifiers, ``probability`` as an array."""
    out = model.transform(assemble(df, features)).drop("features", "rawPrediction")
    return out.withColumn("probability", vector_to_array("probability")) if "probability" in out.columns else out


def regressor_chain(df: DataFrame, features: Sequence[str], labels: Sequence[str], **how) -> list[tuple[str, list[str], Model]]:
    """One regressor per label, each seeing the labels before it."""
    chain, seen = [], list(features)
    for label in labels:
        chain.append((label, list(seen), boosted_regressor(df, seen, label, **how)))
        seen.append(label)
    return chain


def predict_chain(chain: list[tuple[str, list[str], Model]], df: DataFrame) -> DataFrame:
    for label, features, model in chain:
        df = predict(model, df.drop(label), features).withColumnRenamed("prediction", label)
    return df


def mixture(df: DataFrame, features: Sequence[str], components: int, seed: int = 0, iterations: int = 100) -> Model:
    from pyspark.ml.clustering import GaussianMixture

    return GaussianMixture(k=components, seed=seed, maxIter=iterations).fit(assemble(df, features))


def mixture_criteria(model: Model, features: int, n: int) -> dict[str, float]:
    """aic and bic of a full-covariance mixture."""
    from tessella.operators.metrics import gaussian_criteria

    k = model.getK()
    return gaussian_criteria(model.summary.logLikelihood, k * (features + features * (features + 1) // 2) + k - 1, n)


def mixture_scores(model: Model, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """The frame with ``score``, the log-likelihood of each row, in closed form."""
    import math

    import numpy as np

    terms = []
    for weight, g in zip(model.weights, model.gaussians, strict=True):
        cov = np.array(g.cov.toArray())
        inverse, mean = np.linalg.inv(cov), g.mean.toArray()
        shift = [F.col(c) - float(m) for c, m in zip(features, mean, strict=True)]
        square = sum((shift[i] * float(inverse[i, j]) * shift[j] for i in range(len(features)) for j in range(len(features))), F.lit(0.0))
        terms.append(math.log(weight) - (len(features) * math.log(2 * math.pi) + float(np.linalg.slogdet(cov)[1])) / 2 - square / 2)
    top = F.greatest(*terms) if len(terms) > 1 else terms[0]
    return df.withColumn("score", top + F.ln(sum((F.exp(t - top) for t in terms), F.lit(0.0))))


def mixture_sample(spark, model: Model, n: int, features: Sequence[str], seed: int = 0) -> DataFrame:
    """n draws of a mixture."""
    import numpy as np

    roots = [np.linalg.cholesky(np.array(g.cov.toArray())) for g in model.gaussians]
    upto = np.cumsum(model.weights)[:-1]
    base = spark.range(n).withColumn("__u", F.rand(seed)).withColumns({f"__z{k}": F.randn(seed + 1 + k) for k in range(len(features))})
    which = sum(((F.col("__u") >= float(c)).cast("int") for c in upto), F.lit(0))
    base = base.withColumn("component", which)

    def value(i: int):
        out = F.lit(None).cast("double")
        for k, (g, r) in enumerate(zip(model.gaussians, roots, strict=True)):
            drawn = float(g.mean[i]) + sum((float(r[i, j]) * F.col(f"__z{j}") for j in range(i + 1)), F.lit(0.0))
            out = F.when(F.col("component") == k, drawn).otherwise(out)
        return out

    return base.select("component", *(value(i).alias(c) for i, c in enumerate(features)))


def _calibrated(rows: DataFrame, score: Column, confidence: float) -> float | None:
    """The ceil((n + 1) * confidence)-th smallest score, the largest at most: exact, by passes that narrow its range."""
    from tessella.operators.statistics import SMALL, nth

    values = rows.select(score.cast("double").alias("v")).where("v is not null")
    n = values.count()
    return nth(values, n, min(n, math.ceil(round((n + 1) * confidence, 6))) - 1, SMALL) if n else None


def conformal_width(calibration: DataFrame, label: str, confidence: float) -> float:
    """Half width of a split-conformal interval: the (n + 1) * confidence / n quantile of absolute residuals."""
    return _calibrated(calibration, F.abs(F.col(label) - F.col("prediction")), confidence)


def conformal_interval(predicted: DataFrame, width: float) -> DataFrame:
    """lower, prediction, upper."""
    return predicted.withColumns({"lower": F.col("prediction") - width, "upper": F.col("prediction") + width})


def conformal_sets(predicted: DataFrame, calibration: DataFrame, label: str, confidence: float) -> DataFrame:
    """``set``: classes whose probability is at least 1 - the quantile of calibration scores."""
    cut = _calibrated(calibration, 1 - F.get("probability", F.col(label).cast("int")), confidence)
    picked = F.filter(F.transform("probability", lambda p, i: F.when(p >= 1 - cut, i.cast("long"))), lambda i: i.isNotNull())
    return predicted.withColumn("set", picked)


def least_squares(df: DataFrame, features: Sequence[str], label: str) -> dict[str, float]:
    """Coefficients and intercept from sums of products: one aggregate, solved on the driver."""
    import numpy as np

    names = [*features, label]
    x = [F.lit(1.0), *(F.col(c).cast("double") for c in names)]
    row = df.agg(*(F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i in range(len(x)) for j in range(i, len(x)))).first()
    s = np.array([[row[f"s{min(i, j)}_{max(i, j)}"] for j in range(len(x))] for i in range(len(x))], float)
    k = len(x) - 1
    beta = np.linalg.lstsq(s[:k, :k], s[:k, k], rcond=None)[0]
    return {"intercept": float(beta[0]), **dict(zip(features, map(float, beta[1:]), strict=True))}


def quantile_fit(df: DataFrame, features: Sequence[str], label: str, q: float, rounds: int = 25, floor: float = 1e-3) -> dict[str, float]:
    """Linear quantile regression by iterated weighted least squares: each round one aggregate of sums of products.

    A residual e weighs q / |e| above the line and (1 - q) / |e| below, |e| being at
    least ``floor`` times the labels' spread. Gives coefficients and intercept.
    """
    import numpy as np

    x = [F.lit(1.0), *(F.col(c).cast("double") for c in features)]
    y = F.col(label).cast("double")
    n = len(x)
    beta = least_squares(df, features, label)
    beta = np.array([beta["intercept"], *(beta[c] for c in features)])
    least = floor * (df.agg(F.stddev_pop(y).alias("s")).first()["s"] or 1.0)
    for _ in range(rounds):
        error = y - sum((float(b) * c for b, c in zip(beta, x, strict=True)), F.lit(0.0))
        w = F.when(error >= 0, F.lit(q)).otherwise(1 - q) / F.greatest(F.abs(error), F.lit(least))
        parts = [F.sum(w * x[i] * x[j]) for i in range(n) for j in range(i, n)] + [F.sum(w * c * y) for c in x]
        got = df.agg(*(p.alias(f"c{k}") for k, p in enumerate(parts))).first()
        if got[0] is None:
            break
        square = np.zeros((n, n))
        square[np.triu_indices(n)] = got[: n * (n + 1) // 2]
        new = np.linalg.lstsq(np.triu(square) + np.triu(square, 1).T, np.array(got[n * (n + 1) // 2 :], float), rcond=None)[0]
        moved, beta = np.abs(new - beta).max(), new
        if moved < 1e-9 * (1 + np.abs(beta).max()):
            break
    return {"intercept": float(beta[0]), **dict(zip(features, map(float, beta[1:]), strict=True))}


def quantile_predict(df: DataFrame, fitted: dict[float, dict[str, float]]) -> DataFrame:
    """``quantiles``: the predicted value at each fitted q, in the order of q."""
    line = lambda c: sum((v * F.col(k) for k, v in c.items() if k != "intercept"), F.lit(c["intercept"]))
    return df.withColumn("quantiles", F.array(*(line(fitted[q]) for q in sorted(fitted))))


def conformal_quantile_fit(trained: DataFrame, calibration: DataFrame, features: Sequence[str], label: str, confidence: float) -> tuple[dict[float, dict[str, float]], float]:
    """Quantile lines on both sides, and how far calibration rows lie outside them at the (n + 1) * confidence / n quantile."""
    fitted = {q: quantile_fit(trained, features, label, q) for q in ((1 - confidence) / 2, 0.5, (1 + confidence) / 2)}
    rows = quantile_predict(calibration, fitted)
    outside = F.greatest(F.get("quantiles", F.lit(0)) - F.col(label), F.col(label) - F.get("quantiles", F.lit(2)))
    return fitted, _calibrated(rows, outside, confidence)


def conformal_quantile_interval(df: DataFrame, fitted: dict[float, dict[str, float]], width: float) -> DataFrame:
    """lower, prediction, upper: the outer quantile lines moved by the calibrated width, and the median line."""
    at = lambda k: F.get("quantiles", F.lit(k))
    return quantile_predict(df, fitted).withColumns({"lower": at(0) - width, "prediction": at(1), "upper": at(2) + width}).drop("quantiles")


def interval_uncertainty(predicted: DataFrame) -> DataFrame:
    """``uncertainty`` of rows with lower and upper: the width between them."""
    return predicted.withColumn("uncertainty", F.col("upper") - F.col("lower"))


def class_uncertainty(predicted: DataFrame) -> DataFrame:
    """``uncertainty`` of rows with class probabilities: their entropy over its most, 0 to 1."""
    entropy = F.aggregate("probability", F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.ln(p)).otherwise(0.0))
    return predicted.withColumn("uncertainty", F.when(F.size("probability") > 1, entropy / F.ln(F.size("probability"))).otherwise(0.0))


#: Curve families in their usual parameters.
CURVES = {
    "exponential_decay": lambda x, a, b: a * F.exp(-b * x),
    "exponential_with_offset": lambda x, a, b, c: a * F.exp(-b * x) + c,
    "exponential_growth": lambda x, a, b: a * F.exp(b * x),
    "logistic": lambda x, top, k, mid: top / (1 + F.exp(-k * (x - mid))),
    "gompertz": lambda x, a, b, c: a * F.exp(-b * F.exp(-c * x)),
    "power_law": lambda x, a, b: a * F.pow(x, b),
    "linear": lambda x, a, b: a * x + b,
    "quadratic": lambda x, a, b, c: a * x * x + b * x + c,
    "cubic": lambda x, a, b, c, d: a * x * x * x + b * x * x + c * x + d,
}


def curve_fit(df: DataFrame, x: str, y: str, family: str, start: Sequence[float], rounds: int = 50) -> dict:
    """Levenberg-Marquardt with each round's normal equations as one aggregate over the rows.

    Only sums of products reach the driver. Gives params, r_squared and success.
    """
    import numpy as np

    curve = CURVES[family]
    col = F.col(x).cast("double")
    p, damp, rows = np.array(start, float), 1e-3, df.select(x, y)

    def at(q):
        return curve(col, *(F.lit(float(v)) for v in q))

    def sums(q):
        steps = [max(1e-6, abs(v) * 1e-6) for v in q]
        base = at(q)
        slopes = [(at(q + np.eye(len(q))[k] * h) - base) / h for k, h in enumerate(steps)]
        error = F.col(y).cast("double") - base
        parts = [F.sum(error * error)] + [F.sum(g * error) for g in slopes] + [F.sum(a * b) for i, a in enumerate(slopes) for b in slopes[i:]]
        got = rows.agg(*(c.alias(f"c{k}") for k, c in enumerate(parts))).first()
        n = len(q)
        jtj = np.zeros((n, n))
        jtj[np.triu_indices(n)] = [got[k] for k in range(1 + n, len(parts))]
        return got[0], np.array([got[1 + k] for k in range(n)], float), np.triu(jtj) + np.triu(jtj, 1).T

    try:
        loss, gradient, jtj = sums(p)
        for _ in range(rounds):
            move = np.linalg.solve(jtj + damp * np.diag(np.diag(jtj) + 1e-12), gradient)
            fresh = sums(p + move)
            if fresh[0] is not None and fresh[0] < loss:
                done = loss - fresh[0] <= 1e-12 * max(loss, 1e-30)
                p, damp, (loss, gradient, jtj) = p + move, damp / 5, fresh
                if done:
                    break
            else:
                damp *= 5
                if damp > 1e12:
                    break
        spread = rows.agg((F.var_pop(y) * F.count(y)).alias("s")).first()["s"]
        return {"params": p.tolist(), "r_squared": max(-10.0, min(10.0, 1 - loss / spread)) if spread else 0.0, "success": bool(np.isfinite(p).all())}
    except Exception as error:  # a fit that fails is a value
        return {"params": [], "r_squared": 0.0, "success": False, "message": str(error)[:200]}
