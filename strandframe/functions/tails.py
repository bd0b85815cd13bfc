"""Tails of distributions and the functions they need, as columns and in numpy.

Columns return natural logarithms where a tail may be too small for a double. Sums run
from the tail's largest term and hold terms relative to it, whose logarithm is taken.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: digamma and trigamma go this far up before their series are taken.
_UP = 12
#: Below this, ln x! less Stirling's formula comes from a table.
_TABLED = 16


def digamma(x: float) -> float:
    """The derivative of ln gamma, for x > 0."""
    y = x + _UP
    r = 1 / (y * y)
    series = math.log(y) - 0.5 / y - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))
    return series - sum(1 / (x + k) for k in range(_UP))


def trigamma(x: float) -> float:
    """The second derivative of ln gamma, for x > 0."""
    y = x + _UP
    r = 1 / (y * y)
    series = 1 / y + r / 2 + r / y * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r * (1 / 30 - r * 5 / 66))))
    return series + sum(1 / (x + k) ** 2 for k in range(_UP))


def trigamma_inverse(v: float) -> float:
    """The x > 0 with trigamma(x) = v > 0: halvings of the logarithm's range, as it falls throughout."""
    low, high = -40.0, 40.0
    for _ in range(200):
        middle = (low + high) / 2
        if trigamma(math.exp(middle)) > v:
            low = middle
        else:
            high = middle
    return math.exp((low + high) / 2)


def beta_share(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function of 0 <= x <= 1, by its continued fraction (modified Lentz)."""
    a, b, x = (np.array(v, np.float64) for v in np.broadcast_arrays(a, b, x))
    swap = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    lg = np.vectorize(math.lgamma, otypes=[float])
    tiny = 1e-300
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(lg(a + b) - lg(a) - lg(b) + a * np.log(x) + b * np.log1p(-x)) / a
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    c, f = np.ones_like(x), d.copy()
    for m in range(1, 100_000):
        for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + up * d, 1 + up / c
            d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            f = f * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    share = np.where(x <= 0, 0.0, front * f)
    return np.where(swap, 1 - share, share)


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|) for Student's t; an infinite df gives the normal distribution."""
    t, df = np.asarray(t, np.float64), np.asarray(df, np.float64)
    out = np.full(len(t), np.nan)
    known = ~np.isnan(t) & ~np.isnan(df)
    finite = known & np.isfinite(df) & np.isfinite(t)
    if finite.any():
        x = df[finite] / (df[finite] + t[finite] ** 2)
        out[finite] = beta_share(df[finite] / 2, np.full(finite.sum(), 0.5), x)
    out[known & np.isinf(t)] = 0.0
    normal = known & np.isinf(df) & np.isfinite(t)
    out[normal] = [math.erfc(abs(v) / math.sqrt(2)) for v in t[normal]]
    return out


def _t_batch(t: pd.Series, df: pd.Series) -> pd.Series:
    p = pd.Series(t_two_sided(t.to_numpy(np.float64), df.to_numpy(np.float64)))
    return p.where(p.notna(), None)


def t_tail(t: str, df: str) -> Column:
    """``t_two_sided`` of two columns, in batches; null where either is."""
    return F.pandas_udf(_t_batch, T.DoubleType())(t, df)


def ln_factorial(x: Column) -> Column:
    """ln x! of whole x >= 0: Stirling's formula with its series, exact for small x."""
    exact = F.array(*(F.lit(math.lgamma(i + 1)) for i in range(_TABLED)))
    x = x.cast("double")
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / (x * x)) / (x * x)) / (x * x)) / x
    return F.when(x < _TABLED, F.get(exact, x.cast("int"))).otherwise((x + 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + series)


def _summed(ratio, terms: Column) -> Column:
    """1 + r(1) + r(1) * r(2) + ... over so many ratios."""
    steps = F.when(terms > 0, F.sequence(F.lit(1).cast("long"), terms.cast("long"))).otherwise(F.array().cast("array<bigint>"))

    def step(acc: Column, j: Column) -> Column:
        t = acc["t"] * ratio(j)
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

    return F.aggregate(steps, F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), step)["s"]


_ln_gamma = np.vectorize(math.lgamma, otypes=[float])


def poisson_ln_tails(k: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """ln P(X >= k) for X ~ Poisson(rate), rate > 0, from the term at k up, or 1 less those from k - 1 down.

    All rows take a step at a time; those whose terms no longer count leave.
    """
    k, rate = np.asarray(k, np.float64), np.asarray(rate, np.float64)
    up = k > rate
    at = np.where(up, k, np.maximum(k - 1, 0))
    total = np.ones(len(k))
    left = np.flatnonzero((k > 0) & (rate > 0))
    first, by, term, rising, j = at[left], rate[left], np.ones(len(left)), up[left], 0
    while len(left):
        j += 1
        term = term * np.where(rising, by / (first + j), np.maximum(first - j + 1, 0) / by)
        total[left] += term
        # Terms fall ever faster: below this, what is left of them is below a double's precision.
        keep = term > 1e-18 * total[left]
        if not keep.all():
            left, first, by, term, rising = (v[keep] for v in (left, first, by, term, rising))
    with np.errstate(divide="ignore", invalid="ignore"):
        levels, place = np.unique(at, return_inverse=True)
        side = at * np.log(rate) - rate - _ln_gamma(levels + 1)[place] + np.log(total)
        tail = np.where(up, np.minimum(side, 0.0), np.log(np.maximum(1 - np.exp(side), 0.0)))
    return np.where(k <= 0, 0.0, tail)


def _poisson_batch(k: pd.Series, rate: pd.Series) -> pd.Series:
    k, rate = k.to_numpy(np.float64), rate.to_numpy(np.float64)
    known = ~np.isnan(k) & ~np.isnan(rate)
    out = np.full(len(k), np.nan)
    out[known] = poisson_ln_tails(k[known], rate[known])
    p = pd.Series(out)
    return p.where(p.notna(), None)


def poisson_ln_tail(k: Column, rate: Column) -> Column:
    """``poisson_ln_tails`` of two columns, in batches; null where either is."""
    return F.pandas_udf(_poisson_batch, T.DoubleType())(k.cast("double"), rate)


def hypergeometric_ln_tail(k: Column, held: Column, drawn: Column, every: Column) -> Column:
    """ln P(X >= k) where X of ``drawn`` out of ``every`` are among ``held`` ones."""
    k, held, drawn, every = (c.cast("double") for c in (k, held, drawn, every))
    least, most = F.greatest(F.lit(0.0), held + drawn - every), F.least(held, drawn)
    mean = held * drawn / every
    up = k > mean
    at = F.when(up, k).otherwise(k - 1)
    far = (F.ceil(12 * F.sqrt(mean)) + 60).cast("double")
    terms = F.least(F.when(up, most - at).otherwise(at - least), far)
    more = lambda i: (held - i) * (drawn - i) / ((i + 1) * (every - held - drawn + i + 1))  # noqa: E731 - of the term at i + 1 to that at i
    total = _summed(lambda j: F.when(up, more(at + j - 1)).otherwise(1 / more(at - j)), terms)
    choose = lambda n, r: ln_factorial(n) - ln_factorial(r) - ln_factorial(n - r)
    side = choose(held, at) + choose(every - held, drawn - at) - choose(every, drawn) + F.ln(total)
    inner = F.when(up, F.least(side, F.lit(0.0))).otherwise(F.ln(F.greatest(1 - F.exp(side), F.lit(0.0))))
    return F.when(k <= least, 0.0).when(k > most, F.lit(float("-inf"))).otherwise(inner)
