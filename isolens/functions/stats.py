"""Exact-test kernels as column expressions, plus the chi-square tail."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import col

_SMALL = [math.lgamma(i + 1.0) for i in range(16)]
_HALF_LOG_2PI = 0.5 * math.log(2 * math.pi)
TIE_TOLERANCE = 1e-7


def log_factorial(n: Column | str) -> Column:
    """ln(n!) without a table that grows with n: exact values below 16, Stirling's series above."""
    n = col(n)
    x = n.cast("double") + 1.0
    x2 = x * x
    series = (
        (x - 0.5) * F.ln(x) - x + F.lit(_HALF_LOG_2PI)
        + (1.0 / 12.0 - (1.0 / 360.0 - (1.0 / 1260.0 - (1.0 / 1680.0) / x2) / x2) / x2) / x
    )
    small = F.element_at(F.array(*[F.lit(v) for v in _SMALL]), (n + 1).cast("int"))
    return F.when(n < 16, small).otherwise(series)


def log_choose(n, k) -> Column:
    n, k = col(n), col(k)
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def hypergeom_logpmf(x, population, successes, draws) -> Column:
    x, m, k, n = col(x), col(population), col(successes), col(draws)
    return log_choose(k, x) + log_choose(m - k, n - x) - log_choose(m, n)


def _up(i, m, k, n):
    """ln pmf(i) - ln pmf(i-1)."""
    return F.ln((k - i + 1.0) * (n - i + 1.0) / (i * (m - k - n + i)))


def _down(i, m, k, n):
    """ln pmf(i) - ln pmf(i+1)."""
    return F.ln((i + 1.0) * (m - k - n + i + 1.0) / ((k - i) * (n - i)))


def _walk(start: Column, stop: Column, step: int, ratio, keep_limit: float | None) -> Column:
    """Sum of pmf(i)/pmf(origin) from ``start`` to ``stop``; terms above the limit are left out."""
    ok = start <= stop if step > 0 else start >= stop
    seq = F.when(ok, F.sequence(start, stop, F.lit(step).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))

    def merge(acc, i):
        t = acc["t"] + ratio(i.cast("double"))
        term = F.exp(t)
        if keep_limit is not None:
            term = F.when(t <= keep_limit, term).otherwise(F.lit(0.0))
        return F.struct(t.alias("t"), (acc["s"] + term).alias("s"))

    return F.aggregate(seq, F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("s")), merge, lambda acc: acc["s"])


def _support(population, successes, draws):
    m, k, n = (col(c).cast("bigint") for c in (population, successes, draws))
    lo = F.greatest(n + k - m, F.lit(0).cast("bigint"))
    hi = F.when(k.isNotNull() & n.isNotNull(), F.least(k, n))
    md, kd, nd = (c.cast("double") for c in (m, k, n))
    mean = nd * kd / md
    sd = F.sqrt(mean * (md - kd) / md * (md - nd) / F.greatest(md - 1.0, F.lit(1.0)))
    return m, k, n, lo, hi, md, kd, nd, mean, sd


def hypergeom_log_sf(observed, population, successes, draws) -> Column:
    """ln P(X >= observed) for a hypergeometric count; a tail far below the smallest double keeps its value.

    Only the terms on the short side of the mean are summed, and only while they can change a
    double: 10 standard deviations plus 50 terms past the start are below 1e-17 of the sum.
    """
    x = col(observed).cast("bigint")
    m, k, n, lo, hi, md, kd, nd, mean, sd = _support(population, successes, draws)
    reach = (10.0 * sd + 50.0).cast("bigint")
    above = hypergeom_logpmf(x, m, k, n) + F.log1p(_walk(x + 1, F.least(hi, x + reach), 1, lambda i: _up(i, md, kd, nd), None))
    y = x - 1
    below = F.exp(hypergeom_logpmf(y, m, k, n)) * (
        1.0 + _walk(y - 1, F.greatest(lo, y - reach), -1, lambda i: _down(i, md, kd, nd), None)
    )
    return (
        F.when(x.isNull() | hi.isNull() | m.isNull(), F.lit(None).cast("double"))
        .when(x <= lo, F.lit(0.0)).when(x > hi, F.lit(float("-inf")))
        .when(x.cast("double") > mean, F.least(F.lit(0.0), above))
        .otherwise(F.log1p(-F.least(below, F.lit(1.0))))
    )


def hypergeom_sf(observed, population, successes, draws) -> Column:
    """P(X >= observed) for a hypergeometric count."""
    return F.exp(hypergeom_log_sf(observed, population, successes, draws))


def fisher_log_p(a, b, c, d) -> Column:
    """ln of the two-sided Fisher exact p of the table [[a, b], [c, d]]: all tables no likelier than it."""
    a, b, c, d = (col(v).cast("bigint") for v in (a, b, c, d))
    m, k, n, lo, hi, md, kd, nd, mean, sd = _support(a + b + c + d, a + c, a + b)
    reach = (F.abs(a.cast("double") - mean) * 2.0 + 10.0 * sd + 50.0).cast("bigint")
    up = _walk(a + 1, F.least(hi, a + reach), 1, lambda i: _up(i, md, kd, nd), TIE_TOLERANCE)
    down = _walk(a - 1, F.greatest(lo, a - reach), -1, lambda i: _down(i, md, kd, nd), TIE_TOLERANCE)
    p = hypergeom_logpmf(a, m, k, n) + F.log1p(up + down)
    return F.when((a + b + c + d).isNull(), F.lit(None).cast("double")).when(lo == hi, F.lit(0.0)).otherwise(F.least(F.lit(0.0), p))


def fisher_two_sided(a, b, c, d) -> Column:
    """Two-sided Fisher exact p of the table [[a, b], [c, d]]."""
    return F.exp(fisher_log_p(a, b, c, d))


def odds_ratio(a, b, c, d, add: float = 0.5) -> Column:
    a, b, c, d = (col(v) for v in (a, b, c, d))
    return ((a + add) / (b + add)) / ((c + add) / (d + add))


def rate(x, n) -> Column:
    """Percent x of n, null without a denominator."""
    return F.when(col(n) > 0, 100.0 * col(x) / col(n))


def rate_ci(x, n, clamp_hi: bool = True, z: float = 1.96) -> dict[str, Column]:
    """Percent with its normal-approximation interval, lower bound clamped to 0."""
    x, n = col(x), col(n)
    p = F.when(n > 0, x / n)
    half = z * F.sqrt(F.greatest(p * (1 - p), F.lit(0.0)) / n)
    # greatest/least skip nulls, so the null of an empty denominator is kept by hand
    lo = F.when(p.isNotNull(), F.greatest(F.lit(0.0), 100.0 * (p - half)))
    hi = 100.0 * (p + half)
    if clamp_hi:
        hi = F.when(p.isNotNull(), F.least(F.lit(100.0), hi))
    return {"pct": 100.0 * p, "lo": lo, "hi": hi}


@F.pandas_udf(T.DoubleType())
def chi2_sf(x: pd.Series, dof: pd.Series) -> pd.Series:
    """Upper tail of the chi-square distribution for whole degrees of freedom.

    The tail is a finite series in x / 2 (plus an error function for odd degrees), summed in logs for
    all rows with the same degrees at once, so a huge statistic gives 0 and never overflows.
    """
    v, k = x.to_numpy(dtype=float), dof.to_numpy(dtype=float)
    out = np.full(len(v), np.nan)
    for d in np.unique(k[(k >= 1) & ~np.isnan(v)]):
        at = np.flatnonzero((k == d) & ~np.isnan(v))
        h, odd = np.maximum(v[at], 0) / 2.0, int(d) % 2
        steps = np.arange(int(d) // 2) + odd / 2
        # log gamma of each step + 1, from the recurrence
        log_gamma = np.concatenate([[math.lgamma(1 + odd / 2)], math.lgamma(1 + odd / 2) + np.cumsum(np.log(steps[1:]))]) if len(steps) else np.zeros(0)
        with np.errstate(divide="ignore", invalid="ignore"):
            terms = np.where(steps == 0, 0.0, steps * np.log(h)[:, None]) - log_gamma - h[:, None]
        tail = np.exp(terms).sum(axis=1) + (np.array([math.erfc(math.sqrt(y)) for y in h]) if odd else 0.0)
        out[at] = np.minimum(1.0, tail)
    return pd.Series(out)


def draw_seed(*parts: int) -> np.random.Generator:
    return np.random.default_rng([p & 0xFFFFFFFF for p in parts])


def monte_carlo_chi2(n_tables: int = 5000, seed: int = 12345):
    """pandas UDF (present[], size[], key) → p by resampling R x 2 tables with both margins fixed."""

    @F.pandas_udf(T.DoubleType())
    def run(present: pd.Series, size: pd.Series, key: pd.Series) -> pd.Series:
        out = []
        for obs, tot, k in zip(present, size, key):
            obs, tot = np.asarray(obs, dtype=np.int64), np.asarray(tot, dtype=np.int64)
            hits, total = obs.sum(), tot.sum()
            if len(obs) < 2 or hits == 0 or hits == total:
                out.append(None)
                continue
            expect = tot * (hits / total)
            scale = expect * (1 - hits / total)

            def stat(t):
                return ((t - expect) ** 2 / scale).sum(axis=-1)

            rng = draw_seed(seed, int(k), int(k) >> 32)
            draws = rng.multivariate_hypergeometric(tot, hits, size=n_tables, method="marginals")
            exceed = (stat(draws) >= stat(obs) * (1 - 1e-12)).sum()
            out.append((exceed + 1) / (n_tables + 1))
        return pd.Series(out, dtype="float64")

    return run
