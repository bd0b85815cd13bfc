"""Searches run with the reference's effort: K = 2..12, 10 starts of either kind, 1000 restarts."""

import os

import pytest

from strandframe.operators import cluster as cl
from strandframe.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(f"{SF}/nation.parquet"), reason="no test tables here")


@pytest.mark.parametrize("name", ["M11_k_sweep", "C1_random_starts", "C2_C5_local_search", "C7_parallel_restarts", "C10_k_sweep", "C11_best_fit", "E2_biclusters"])
def test_starts_of_every_k(spark, monkeypatch, name):
    asked = []
    for kind in ("random_starts", "smart_starts", "fits"):
        def held(s, tree, table=None, ks=(), n=None, *a, kind=kind, **o):
            asked.append((kind, ks if kind == "fits" else list(ks), n))
            return s if kind == "fits" else s.range(0).selectExpr("0 as k", "0 as residual")

        monkeypatch.setattr(cl, kind, held)
    monkeypatch.setattr(cl, "best_fits", lambda d: d)
    catalogue.queries()[name](spark, SF)
    starts = [x for x in asked if x[0] != "fits"]
    assert starts and all(x[1:] == (list(range(2, 13)), 10) for x in starts)


def test_restarts(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(cl, "large_averages", lambda cells, n, restarts: asked.append(restarts))
    catalogue.queries()["M23_large_averages"](spark, SF)
    assert asked == [1000]
