"""Binomial enrichment over all orders, and tails of many trials."""

import os
from fractions import Fraction
from math import comb

import pytest
from pyspark.sql import functions as F

from strandframe.operators import stats as st
from strandframe.plans import catalogue


def exact(k, n, p):
    """With whole numbers: p is tenths."""
    lo = sum(comb(n, i) * p**i * (10 - p) ** (n - i) for i in range(k))
    return float(1 - Fraction(lo, 10**n))


def test_tails_of_many_trials_are_exact(spark):
    cases = [(k, n, p) for n, p in ((3000, 2), (4000, 5), (6000, 1), (2000, 9)) for m in [n * p // 10] for k in (1, m // 2, m - 60, m - 1, m, m + 1, m + 60, m + 190, n)]
    df = spark.createDataFrame([(k, n, p, p / 10) for k, n, p in cases], "k long, n long, i int, p double")
    for r in df.withColumn("t", st.binomial_tail("k", "n", "p")).collect():
        assert r.t == pytest.approx(exact(r.k, r.n, r.i), rel=1e-9, abs=1e-300), r


def test_tail_far_below_the_mean_is_one(spark):
    t = spark.createDataFrame([(100_000, 10_000_000, 0.2), (2_000_000, 10_000_000, 0.2)], "k long, n long, p double").withColumn("t", st.binomial_tail("k", "n", "p")).collect()
    assert t[0].t == pytest.approx(1.0, abs=1e-12) and t[1].t == pytest.approx(0.5, abs=1e-3)


SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.exists(f"{SF}/orders.parquet"), reason="no test tables here")
def test_all_orders_are_counted(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    got = catalogue.queries()["M22_binomial_enrichment"](spark, SF).agg(F.sum("successes")).first()[0]
    assert orders.count() > 4001 and got == orders.join(spark.read.parquet(f"{SF}/customer.parquet"), F.expr("o_custkey = c_custkey")).count()
