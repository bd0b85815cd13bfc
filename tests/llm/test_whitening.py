"""Whitening against numpy over the distinct vectors, in whole numbers of any size."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from strandframe.llm.whitening import whiten

SCHEMA = "vec_id long, embedding array<float>, x string, component string"


def brute(rows, scale=256, components=4):
    """{(id, component): (n, deviation, |whitened|, explained)} in double precision and whole numbers."""
    held = [(i, tuple(math.floor(scale * float(np.float32(c))) for c in v)) for i, v in rows if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    once = sorted({x for _, x in held})
    n = len(once)
    sums = [sum(x[j] for x in once) for j in range(len(once[0]))]
    deviation = {x: sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)) for x in once}
    centred = {x: np.array([float(Fraction(n * c - s, n)) for c, s in zip(x, sums, strict=True)]) for x in once}
    rows_of = np.array([centred[x] for x in once])
    values, vectors = np.linalg.eigh(rows_of.T @ rows_of / n)
    order = np.argsort(-values)
    values, vectors = values[order], vectors[:, order]
    k = min(components, int((values > 1e-12 * values[0]).sum()))
    trace = float(Fraction(sum(deviation.values()), n**3))
    return [(i, c + 1, n, deviation[x], abs(float(centred[x] @ vectors[:, c])) / math.sqrt(values[c]), values[c] / trace) for i, x in held for c in range(k)]


def check(spark, rows, tolerance=1e-9):
    df = spark.createDataFrame([(i, v, "a", "b") for i, v in rows], SCHEMA)
    got = sorted(((r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained, r.identity_error) for r in whiten(df).collect()), key=str)
    want = sorted(brute(rows), key=str)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    key = lambda r: (str(r[:4]), r[4])
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[4:6] == pytest.approx(b[4:6], rel=tolerance, abs=tolerance)
    assert len({r[6] for r in got}) <= 1 and all(r[6] < 1e-4 for r in got)
    return got


def vectors(n, d, seed=0):
    r = np.random.default_rng(seed)
    mix = r.normal(size=(d, d)) * np.linspace(1, 0.1, d)
    return [(i, [float(c) for c in v]) for i, v in enumerate(r.normal(size=(n, d)) @ mix)]


def test_equals_numpy_with_bad_rows_copies_and_clashing_columns(spark):
    rows = vectors(300, 12)
    odd = [None, [], [None] * 12, [1.0] * 11 + [float("nan")], [float("inf")] + [0.0] * 11, [1.0] * 11 + [None]]
    rows += [(1000 + i, v) for i, v in enumerate(odd)]
    rows += [(2000 + i, rows[5][1]) for i in range(200)] + [(5, rows[7][1]), (None, rows[8][1])]  # a hot vector, a repeated id, no id
    got = check(spark, rows)
    assert got and len({r[0] for r in got if r[0] is not None}) == 500


def test_more_rows_or_fewer_than_components(spark):
    check(spark, vectors(3, 8))  # two components at most
    check(spark, vectors(50, 2))
    check(spark, vectors(4, 1))
    check(spark, vectors(400, 40, 3))


def test_offset_far_from_the_origin_loses_no_digits(spark):
    rows = [(i, [c + 4096.0 for c in v]) for i, v in vectors(200, 6, 5)]
    check(spark, rows, 1e-7)


def test_negative_zero_and_floors(spark):
    rnd = random.Random(2)
    check(spark, [(i, [rnd.choice([-0.0, 0.0, -1 / 512, 1 / 512, 0.999 / 256, -1.0]) for _ in range(5)]) for i in range(80)])


def test_lengths_that_differ_and_huge_entries(spark):
    rows = vectors(60, 5, 6)
    df = spark.createDataFrame([(i, v, "", "") for i, v in [*rows, (900, [1.0] * 4), (901, [1.0] * 6)]], SCHEMA)
    assert {r.vec_id for r in whiten(df).collect()} == set(range(60))
    huge = spark.createDataFrame([(i, [1e30 * (-1) ** i, float(i)], "", "") for i in range(10)], SCHEMA)
    got = whiten(huge).collect()
    assert len(got) >= 10 and all(r.deviation is None for r in got)


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None, "", "")], [(1, [1.0, 2.0], "", ""), (2, [1.0, 2.0], "", "")]):
        df = whiten(spark.createDataFrame(rows, SCHEMA))
        assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and df.count() == 0
