"""Tails against sums, integrals and known values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.functions import tails


def test_digamma_and_trigamma():
    assert tails.digamma(1.0) == pytest.approx(-0.5772156649015329, abs=1e-13)
    assert tails.trigamma(1.0) == pytest.approx(math.pi**2 / 6, rel=1e-13)
    assert tails.trigamma(0.5) == pytest.approx(math.pi**2 / 2, rel=1e-13)
    for x in (1e-3, 0.3, 2.5, 40.0, 1e6):
        assert tails.digamma(x + 1) == pytest.approx(tails.digamma(x) + 1 / x, rel=1e-12)
        assert tails.trigamma_inverse(tails.trigamma(x)) == pytest.approx(x, rel=1e-9)


def test_student_tails():
    df = np.array([1.0, 2.0, 4.0, 7.3, 30.0, 1e6, np.inf, 3.0, 3.0, np.nan])
    t = np.array([1.0, 1.0, -2.5, 3.1, 0.0, 1.96, 1.96, np.inf, np.nan, 1.0])
    got = tails.t_two_sided(t, df)
    assert got[0] == pytest.approx(0.5, rel=1e-13)  # Cauchy
    assert got[1] == pytest.approx(1 - 1 / math.sqrt(3), rel=1e-13)

    def simpson(t, df, n=20_000):
        phi = math.asin(math.sqrt(df / (df + t * t)))
        y = np.sin(np.linspace(0, phi, n + 1)) ** (df - 1)
        area = phi / n / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum())
        return 2 * area * math.exp(math.lgamma(df / 2 + 0.5) - math.lgamma(df / 2) - math.lgamma(0.5))

    for i in (2, 3, 4):
        assert got[i] == pytest.approx(simpson(abs(t[i]), df[i]), rel=1e-10)
    assert got[5] == pytest.approx(got[6], rel=1e-5) and got[6] == pytest.approx(math.erfc(1.96 / math.sqrt(2)), rel=1e-14)
    assert got[7] == 0 and np.isnan(got[8]) and np.isnan(got[9])
    assert tails.t_two_sided(np.array([40.0]), np.array([50.0]))[0] == pytest.approx(simpson(40.0, 50.0), rel=1e-8)  # far out


def test_poisson_tails(spark):
    cases = [(k, r) for r in (0.01, 0.7, 3.0, 25.5, 400.0) for k in (0, 1, 2, 5, 15, 16, 17, 40, 300, 500, 900)]
    rows = spark.createDataFrame(cases, "k long, r double").select("k", "r", tails.poisson_ln_tail(F.col("k"), F.col("r")).alias("p")).collect()

    def brute(k, r):
        terms = [i * math.log(r) - r - math.lgamma(i + 1) for i in range(k, k + 4000)]
        top = max(terms)
        return min(top + math.log(math.fsum(math.exp(x - top) for x in terms)), 0.0)

    for r in rows:
        assert r.p == pytest.approx(brute(r.k, r.r), rel=1e-9, abs=1e-12), r
    assert min(r.p for r in rows) < -4000


def test_hypergeometric_tails(spark):
    cases = [(k, h, d, n) for h, d, n in ((5, 10, 30), (40, 60, 90), (300, 500, 20_000), (7, 7, 7), (1, 1, 2)) for k in (0, 1, 3, 5, 7, 10, 25, 40, 300)]
    e = [F.col(c) for c in ("k", "h", "d", "n")]
    rows = spark.createDataFrame(cases, "k long, h long, d long, n long").select("*", tails.hypergeometric_ln_tail(*e).alias("p")).collect()
    for r in rows:
        ways = sum(math.comb(r.h, i) * math.comb(r.n - r.h, r.d - i) for i in range(r.k, min(r.h, r.d) + 1) if r.d - i <= r.n - r.h)
        if not ways:
            assert r.p == float("-inf")
        else:
            assert r.p == pytest.approx(math.log(ways) - math.log(math.comb(r.n, r.d)), rel=1e-8, abs=1e-9), r
