"""Coverage and peaks against counts place by place; reproducibility against plain numpy."""

import math
import random

import numpy as np
import pytest

from strandframe.operators import peaks as pk

READS = "chr string, start long, stop long, strand string, depth int"


def planted_reads(seed=1):
    rnd = random.Random(seed)
    rows = []
    for c in ("a", "b"):
        for _ in range(150):
            at = rnd.randrange(3000)
            rows.append((c, at, at + 30, rnd.choice(["+", "-", None]), 0))
        for _ in range(80):
            at = int(rnd.gauss(1500, 40))
            rows.append((c, at, at + 30, rnd.choice("+-"), 0))
    rows += [("a", 5, 8, "-", 0)] * 3 + [("c", 10, 40, "+", 0), (None, 1, 2, "+", 0), ("c", None, 5, "+", 0)]
    rows += [("hot", 700, 730, "+", 0)] * 500
    return rows


def fragments(rows, extent, shift):
    for c, start, stop, strand, _ in rows:
        if c is not None and start is not None and stop is not None:
            yield c, (start + shift if strand == "+" else stop - shift - extent)


def by_place(rows, extent, shift, windows, length=5000):
    """{chr: (depth, near, ...)}: arrays over all places."""
    out = {}
    for c, f in fragments(rows, extent, shift):
        arrays = out.setdefault(c, [np.zeros(length, int) for _ in range(1 + len(windows))])
        middle = f + extent // 2
        for array, (a, b) in zip(arrays, [(f, f + extent), *((middle - w // 2, middle - w // 2 + w) for w in windows)], strict=True):
            array[max(a, 0) : max(b, 0)] += 1
    return out


@pytest.mark.parametrize("segment", [64, 1 << 22])
def test_pileup_equals_counting_each_place(spark, segment):
    rows = planted_reads()
    got = pk.pileup(spark.createDataFrame(rows, READS), 50, 10, (200, 801), segment).collect()
    want = by_place(rows, 50, 10, (200, 801))
    seen = {c: [np.zeros(5000, int) for _ in range(3)] for c in want}
    for r in got:
        for array, v in zip(seen[r.chr], (r.depth, r.near0, r.near1), strict=True):
            assert not array[r.start : r.stop].any()
            array[r.start : r.stop] = v
    for c, arrays in want.items():
        for a, b in zip(arrays, seen[c], strict=True):
            assert (a == b).all()


def ln_tail(k, rate):
    terms = [i * math.log(rate) - rate - math.lgamma(i + 1) for i in range(k, k + 1500)]
    top = max(terms)
    return min(top + math.log(math.fsum(math.exp(x - top) for x in terms)), 0.0)


def plain_peaks(rows, extent, genome, least, shift, windows, gap, shortest):
    total = sum(1 for _ in fragments(rows, extent, shift))
    out = []
    for c, (depth, *near) in by_place(rows, extent, shift, windows).items():
        rate = np.full(len(depth), total * extent / genome)
        for array, w in zip(near, windows, strict=True):
            rate = np.maximum(rate, array * extent / w)
        score = np.array([-ln_tail(int(d), float(r)) / math.log(10) if d else -1.0 for d, r in zip(depth, rate, strict=True)])
        at = np.flatnonzero(score >= least)
        # Places of a run of gap or fewer places between them are one peak.
        for run in np.split(at, np.flatnonzero(np.diff(at) > gap + 1) + 1) if len(at) else []:
            if run[-1] + 1 - run[0] >= shortest:
                top = [p for p in run if depth[p] == depth[run].max()]
                out.append((c, int(run[0]), int(run[-1]) + 1, int(depth[top[0]]), top[0], float(score[top[0]]), float((depth[top[0]] + 1) / (rate[top[0]] + 1))))
    return sorted(out)


@pytest.mark.parametrize(("segment", "gap", "shortest"), [(100, 0, 0), (1 << 22, 20, 30)])
def test_peaks_equal_calling_each_place(spark, segment, gap, shortest):
    rows = planted_reads(2)
    got = pk.call_peaks(spark.createDataFrame(rows, READS), 50, 40_000, 2.0, 10, (400, 2000), gap, shortest, segment)
    got = sorted((r.chr, r.start, r.stop, r.depth, r.summit, r.score, r.fold) for r in got.collect())
    want = plain_peaks(rows, 50, 40_000, 2.0, 10, (400, 2000), gap, shortest)
    assert [r[:4] for r in got] == [r[:4] for r in want] and len(want) >= 3
    for a, b in zip(got, want, strict=True):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)
        assert a[1] <= a[4] < a[2] and a[4] >= b[4]  # within the peak, from the first of its deepest places on
    assert {"a", "b"} <= {r[0] for r in want if any(1400 < p < 1600 for p in (r[4],))}


def test_no_reads_no_peaks(spark):
    assert pk.call_peaks(spark.createDataFrame([], READS), 50, 1000, 1.0, 0, (100,)).count() == 0
    assert pk.call_peaks(spark.createDataFrame([(None, 1, 2, "+", 1)], READS), 50, 1000, 1.0).count() == 0


def replicates(seed=3, n=1500, share=0.4):
    r = np.random.default_rng(seed)
    good = r.random(n) < share
    z = r.normal(size=(n, 2))
    z[good, 1] = 0.9 * z[good, 0] + math.sqrt(1 - 0.81) * z[good, 1]
    z[good] = z[good] + 2.5
    return good, [(i, float(math.exp(a)), float(3 * b + 100)) for i, (a, b) in enumerate(z)]  # only ranks count


def plain_em(rows, rounds=200, close=1e-3):
    n = len(rows)
    u = []
    for k in (1, 2):
        order = sorted(range(n), key=lambda i: (rows[i][k], rows[i][0]))
        v = np.empty(n)
        v[order] = np.arange(1, n + 1) / (n + 1)
        u.append(v)
    cdf = np.vectorize(lambda v: 0.5 * math.erfc(-v / math.sqrt(2)))
    mu, sigma, rho, p = pk.START
    for step in range(rounds + 1):
        z = np.linspace(min(-8.0, mu - 8 * sigma), max(8.0, mu + 8 * sigma), 8001)
        g = p * cdf((z - mu) / sigma) + (1 - p) * cdf(z)
        x, y = (np.interp(v, g, z) for v in u)
        a, b = (x - mu) / sigma, (y - mu) / sigma
        f1 = np.exp(-(a**2 - 2 * rho * a * b + b**2) / (2 * (1 - rho**2))) / (2 * math.pi * sigma**2 * math.sqrt(1 - rho**2))
        f0 = np.exp(-(x**2 + y**2) / 2) / (2 * math.pi)
        w = p * f1 / (p * f1 + (1 - p) * f0)
        if step == rounds or (step and moved <= close):
            return (mu, sigma, rho, p), 1 - w
        m = (w * (x + y)).sum() / (2 * w.sum())
        v = (w * ((x - m) ** 2 + (y - m) ** 2)).sum() / (2 * w.sum())
        new = (m, math.sqrt(v), (w * (x - m) * (y - m)).sum() / (v * w.sum()), w.mean())
        new = tuple(min(max(q, lo), hi) for q, (lo, hi) in zip(new, pk.BOUNDS, strict=True))
        moved = max(abs(q - o) for q, o in zip(new, (mu, sigma, rho, p), strict=True))
        mu, sigma, rho, p = new
    return None


def test_rates_equal_the_plain_fit_and_find_what_reproduces(spark):
    good, rows = replicates()
    got = {r.peak: r for r in pk.irreproducible_rate(spark.createDataFrame(rows, "peak long, s1 double, s2 double"), "peak").collect()}
    theta, local = plain_em(rows)
    assert theta[3] == pytest.approx(0.4, abs=0.08) and theta[2] > 0.75
    assert set(got) == set(range(1500))
    for i in range(1500):
        assert got[i].local_idr == pytest.approx(local[i], abs=1e-6)
    order = np.argsort(local)
    running = np.cumsum(local[order]) / np.arange(1, 1501)
    for i, want in zip(order[::50].tolist(), running[::50].tolist(), strict=True):
        assert got[i].idr == pytest.approx(want, abs=1e-6)
    called = [i for i in range(1500) if got[i].idr <= 0.05]
    assert sum(good[i] for i in called) >= 0.9 * len(called) and len(called) >= 0.5 * good.sum()


def test_matching_takes_the_best_peak_of_each(spark):
    t = lambda rows: spark.createDataFrame(rows, "chr string, start long, stop long, score double")
    pooled = spark.createDataFrame([("p", "a", 100, 200), ("q", "a", 900, 950), ("r", "b", 5, 9)], "id string, chr string, start long, stop long")
    first = t([("a", 90, 110, 1.0), ("a", 150, 160, 4.0), ("a", 200, 210, 9.0), ("a", 940, 990, 2.0), ("b", 8, 9, None)])
    second = t([("a", 199, 300, 3.0), ("b", 0, 6, 2.0)])
    assert [tuple(r) for r in pk.matched(pooled, first, second, "id").collect()] == [("p", 4.0, 3.0)]


def test_no_pairs_no_rates(spark):
    empty = spark.createDataFrame([], "peak string, s1 double, s2 double")
    assert pk.irreproducible_rate(empty, "peak").count() == 0
    one = pk.irreproducible_rate(spark.createDataFrame([("x", 1.0, 2.0)], empty.schema), "peak").collect()
    assert len(one) == 1 and 0 <= one[0].idr <= 1
