"""Random columns. A seed makes a plan's draws repeat for the same partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int | None = None) -> Column:
    return F.rand(seed)


def normal(seed: int | None = None) -> Column:
    return F.randn(seed)


def range_(low: int, high: int, seed: int | None = None) -> Column:
    """A whole number from low to high, both included."""
    return (F.floor(F.rand(seed) * (high - low + 1)) + low).cast("long")


def exponential(rate: float, seed: int | None = None) -> Column:
    return -F.ln(1 - F.rand(seed)) / rate


def weibull(shape: float, seed: int | None = None) -> Column:
    return F.pow(-F.ln(1 - F.rand(seed)), F.lit(1 / shape))


def bernoulli(p: float, seed: int | None = None) -> Column:
    return (F.rand(seed) < p).cast("long")


def _uniforms(n: int, seed: int | None) -> list[Column]:
    return [F.rand(None if seed is None else seed + k) for k in range(n)]


def binomial(n: int, p: float, seed: int | None = None) -> Column:
    return sum(((u < p).cast("long") for u in _uniforms(n, seed)), F.lit(0).cast("long"))


def geometric(p: float, seed: int | None = None) -> Column:
    """Trials up to the first success."""
    if not 0 < p <= 1:
        raise ValueError("a probability above 0 is needed")
    return F.lit(1).cast("long") if p == 1 else F.greatest(F.ceil(F.ln(1 - F.rand(seed)) / F.ln(F.lit(1 - p))), F.lit(1)).cast("long")


def poisson(mean: float, seed: int | None = None) -> Column:
    """By inversion of the distribution below 30, by a rounded normal from 30."""
    if mean >= 30:
        return F.greatest(F.round(mean + F.sqrt(F.lit(mean)) * F.randn(seed)), F.lit(0)).cast("long")
    import math

    steps, term, total = [], math.exp(-mean), 0.0
    for k in range(200):
        total += term
        steps.append(total)
        term *= mean / (k + 1)
        if 1 - total < 1e-15:
            break
    return _bucket(F.rand(seed), steps)


def _bucket(u: Column, steps: list[float]) -> Column:
    return F.aggregate(F.array(*map(F.lit, steps)), F.struct(u.alias("u"), F.lit(0).cast("long").alias("n")), lambda s, x: F.struct(s["u"].alias("u"), (s["n"] + (s["u"] >= x).cast("long")).alias("n")))["n"]


def pareto(alpha: float, seed: int | None = None) -> Column:
    return F.pow(1 - F.rand(seed), F.lit(-1 / alpha))


def log_normal(mu: float, sigma: float, seed: int | None = None) -> Column:
    return F.exp(mu + sigma * F.randn(seed))


def irwin_hall(n: int, seed: int | None = None) -> Column:
    """Sum of n uniform numbers."""
    return sum(_uniforms(n, seed), F.lit(0.0))


def bates(n: int, seed: int | None = None) -> Column:
    """Mean of n uniform numbers."""
    return irwin_hall(n, seed) / n
