"""Student-t tail probabilities and quantiles as column expressions.

``t_tail`` and ``incomplete_beta`` are the same in NumPy.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _log_beta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    return lgamma(a) + lgamma(b) - lgamma(a + b)


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    guard = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c = np.ones_like(x)
    d = 1.0 / guard(1.0 - (a + b) * x / (a + 1.0))
    h = d.copy()
    for m in range(1, rounds):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1.0 / guard(1.0 + even * d)
        c = guard(1.0 + even / c)
        h = h * d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / guard(1.0 + odd * d)
        c = guard(1.0 + odd / c)
        step = d * c
        h = h * step
        if np.all(np.abs(step - 1.0) < 1e-15):
            break
    return h


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    out = np.zeros_like(x)
    inner = (x > 0) & (x < 1)
    out[x >= 1] = 1.0
    if inner.any():
        p, q, z = a[inner], b[inner], x[inner]
        front = np.exp(p * np.log(z) + q * np.log1p(-z) - _log_beta(p, q))
        direct = z < (p + 1) / (p + q + 2)
        res = np.empty_like(z)
        if direct.any():
            res[direct] = front[direct] * _beta_fraction(p[direct], q[direct], z[direct]) / p[direct]
        if (~direct).any():
            o = ~direct
            res[o] = 1.0 - front[o] * _beta_fraction(q[o], p[o], 1.0 - z[o]) / q[o]
        out[inner] = res
    return out


def t_tail(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided Student-t probability."""
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    return incomplete_beta(df / 2.0, np.full_like(df, 0.5), df / (df + t * t))


def _let(what: Column, then) -> Column:
    """``then`` of a value that is named once, so that expressions don't repeat it wherever they use it."""
    return F.get(F.transform(F.array(what), then), F.lit(0))


def _gamma_ratio(a: Column) -> Column:
    """Gamma(a + 1/2) / Gamma(a): its asymptotic series at a + 40, brought down step by step."""
    up = a + 40.0
    series = F.lit(0.0)
    for c in (39325 / 33554432, 869 / 4194304, -399 / 262144, -21 / 32768, 5 / 1024, 1 / 128, -1 / 8):
        series = (series + F.lit(c)) / up
    steps = F.aggregate(F.sequence(F.lit(0), F.lit(39)), F.lit(1.0), lambda p, i: p * (a + i) / (a + i + 0.5))
    return F.sqrt(up) * (series + 1.0) * steps


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function; its steps grow with the root of the larger parameter."""
    def guard(v: Column) -> Column:
        return F.when(F.abs(v) < 1e-300, 1e-300).otherwise(v)

    def half(top: Column, s: Column) -> Column:
        new = F.struct(guard(1.0 + top * s["d"]).alias("v"), guard(1.0 + top / s["c"]).alias("w"), s["h"].alias("h"))
        return _let(new, lambda n: F.struct((1.0 / n["v"]).alias("d"), n["w"].alias("c"), (n["h"] / n["v"] * n["w"]).alias("h")))

    def step(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + m * 2 - 1) * (a + m * 2))
        odd = -(a + m) * (a + b + m) * x / ((a + m * 2) * (a + m * 2 + 1))
        return _let(half(even, s), lambda t: half(odd, t))

    rounds = F.least(F.lit(20_000), (F.sqrt(F.greatest(a, b)) * 3 + 40).cast("int"))
    start = _let(1.0 / guard(1.0 - (a + b) * x / (a + 1.0)), lambda d: F.struct(d.alias("d"), F.lit(1.0).alias("c"), d.alias("h")))
    return F.aggregate(F.sequence(F.lit(1), rounds), start, step)["h"]


def _tail(t: Column, df: Column) -> Column:
    """Two-sided tail of finite t and positive df."""
    half = F.lit(0.5)

    def named(z: Column) -> Column:
        a, square = z["a"], z["square"]
        x, y = 1.0 / (square + 1.0), square / (square + 1.0)
        front = F.exp(-a * F.log1p(square)) * F.sqrt(y) * _gamma_ratio(a) / F.lit(math.sqrt(math.pi))
        direct = front * _fraction(a, half, x) / a
        other = F.lit(1.0) - front * _fraction(half, a, y) / 0.5
        return F.when(square == 0, 1.0).when(square == float("inf"), 0.0).when(x < (a + 1.0) / (a + 2.5), direct).otherwise(other)

    return _let(F.struct((df / 2.0).alias("a"), (t * t / df).alias("square")), named)


def _column(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def student_t_p(t: Column | str, df: Column | str) -> Column:
    """Two-sided p value of Student's t as a column; NULL for missing or impossible input."""
    def named(z: Column) -> Column:
        fine = z["t"].isNotNull() & ~F.isnan(z["t"]) & (z["df"] > 0) & ~F.isnan(z["df"])
        return F.when(fine & (F.abs(z["t"]) == float("inf")), 0.0).when(fine, _tail(z["t"], z["df"]))

    return _let(F.struct(_column(t).alias("t"), _column(df).alias("df")), named)


def student_t_quantile(p: Column | str, df: Column | str) -> Column:
    """Upper quantile q with P(|T| > q) = 1 - p, by Newton steps from below (the tail is convex, so they don't overshoot)."""
    def named(z: Column) -> Column:
        a = z["df"] / 2.0

        def step(q: Column, _: Column) -> Column:
            density = z["height"] * F.exp(-(a + 0.5) * F.log1p(q * q / z["df"]))
            return q + (_tail(q, z["df"]) - (1.0 - z["p"])) / (density * 2.0)

        fine = z["p"].isNotNull() & (z["p"] >= 0) & (z["p"] < 1) & (z["df"] > 0)
        return F.when(fine, F.aggregate(F.sequence(F.lit(1), F.lit(40)), F.lit(0.0), step))

    df = _column(df)
    height = F.when(df > 0, _gamma_ratio(df / 2.0) / F.sqrt(df * math.pi))
    return _let(F.struct(_column(p).alias("p"), df.alias("df"), height.alias("height")), named)
