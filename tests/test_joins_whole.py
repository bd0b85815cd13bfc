"""Joins over whole tables, against brute force."""

import os
from collections import defaultdict

import pytest

from strandframe.plans import catalogue
from strandframe.plans import standins as S

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(f"{SF}/nation.parquet"), reason="no test tables here")


def test_presence_of_every_window(spark):
    by = defaultdict(list)
    for p in S.peaks(spark, SF).collect():
        by[p.chr].append(p)
    want = {}
    for ps in by.values():
        for w in ps:
            near = {p.sample for p in ps if p.start < w.stop and w.start < p.stop}
            want[w.ord] = tuple(int(s in near) for s in range(10))
    got = catalogue.queries()["J10_presence"](spark, SF).collect()
    assert len(got) == len(want) and {r.ord: tuple(r[f"s{s}"] for s in range(10)) for r in got} == want


def test_dense_ids_of_every_edge(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_partkey", "l_suppkey").distinct().collect()
    edges = {(r.l_partkey, r.l_suppkey + 1000000) for r in li}
    n = {x: i for i, x in enumerate(sorted({x for e in edges for x in e}))}
    got = [tuple(r) for r in catalogue.queries()["J3_densify_ids"](spark, SF).select("e1", "e2").collect()]
    assert len(got) == len(edges) and set(got) == {(n[a], n[b]) for a, b in edges}
