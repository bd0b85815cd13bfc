"""Moderated tests, variance stabilising and terms against plain Python and numpy."""

import math
import random
import statistics

import numpy as np
import pytest

from strandframe.functions import tails
from strandframe.operators import expression as ex

SAMPLES = [(f"s{i}", int(i < 4)) for i in range(9)]


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def step_up(ps):
    order = sorted(range(len(ps)), key=lambda i: ps[i])
    out, least = [0.0] * len(ps), 1.0
    for rank in range(len(ps), 0, -1):
        i = order[rank - 1]
        least = min(least, ps[i] * len(ps) / rank)
        out[i] = least
    return out


def test_step_up_with_ties_nulls_and_clashing_names(spark):
    rnd = random.Random(1)
    ps = [rnd.choice([0.0, 1.0, 0.04, rnd.random(), rnd.random() ** 4]) for _ in range(900)]
    rows = [(i, p, 1, 2) for i, p in enumerate(ps)] + [(-1, None, 1, 2), (-2, None, 1, 2)]
    got = ex.step_up(table(spark, rows, "i int, p double, _m int, bucket int"), "p", "adj")
    assert got.columns == ["i", "p", "_m", "bucket", "adj"]
    by = {r.i: r.adj for r in got.collect()}
    assert len(by) == 902 and by[-1] is None
    for i, want in enumerate(step_up(ps)):
        assert by[i] == pytest.approx(want, rel=1e-12)
    assert ex.step_up(table(spark, [], "p double"), "p", "adj").count() == 0


def brute_test(dense, groups):
    """The published moderated t test over {gene: values}, in plain Python."""
    n1, n0 = sum(groups), len(groups) - sum(groups)
    df = n1 + n0 - 2
    stats = {}
    for g, v in dense.items():
        a, b = [x for x, k in zip(v, groups, strict=True) if k], [x for x, k in zip(v, groups, strict=True) if not k]
        ss = statistics.pvariance(a) * n1 + statistics.pvariance(b) * n0
        stats[g] = (statistics.fmean(a) - statistics.fmean(b), ss / df)
    z = [math.log(s) - tails.digamma(df / 2) + math.log(df / 2) for _, s in stats.values() if s > 0]
    excess = statistics.variance(z) - tails.trigamma(df / 2)
    mean = statistics.fmean(z)
    d0 = 2 * tails.trigamma_inverse(excess) if excess > 0 else math.inf
    s0 = math.exp(mean + tails.digamma(d0 / 2) - math.log(d0 / 2)) if excess > 0 else math.exp(mean)
    out = {}
    for g, (change, s) in stats.items():
        post = (d0 * s0 + df * s) / (d0 + df) if excess > 0 else s0
        t = change / math.sqrt(post * (1 / n1 + 1 / n0))
        dof = min(df + d0, df * len(dense))
        out[g] = (change, t, dof, float(tails.t_two_sided(np.array([t]), np.array([dof]))[0]))
    return out


def dense_values(seed, spread, genes=300):
    r = np.random.default_rng(seed)
    out = {}
    for g in range(genes):
        v = r.normal(0, math.exp(r.normal(0, spread)), len(SAMPLES)) + (3 if g < 20 else 0) * np.array([k for _, k in SAMPLES])
        v[r.random(len(v)) < 0.2] = 0.0
        out[g] = v.tolist()
    out[genes] = [0.0] * len(SAMPLES)
    return out


@pytest.mark.parametrize("spread", [1.0, 0.0])
def test_moderated_test_equals_the_plain_one(spark, spread):
    dense = dense_values(2, spread)
    rows = [(g, s, x) for g, v in dense.items() for (s, _), x in zip(SAMPLES, v, strict=True) if x or (g == 300 and s == "s0")]
    got = {r.gene: r for r in ex.moderated_test(table(spark, rows, "gene int, sample string, v double"), table(spark, SAMPLES, "sample string, grp int")).collect()}
    want = brute_test(dense, [k for _, k in SAMPLES])
    assert set(got) == set(want)
    for g, (change, t, df, p) in want.items():
        assert (got[g].logFC, got[g].t, got[g].df, got[g].p) == pytest.approx((change, t, df, p), rel=1e-8, abs=1e-10)
    for g, adj in zip(got, step_up([want[g][3] for g in got]), strict=True):
        assert got[g].adj == pytest.approx(adj, rel=1e-7)
    assert sum(got[g].adj < 0.05 for g in range(20)) > sum(got[g].adj < 0.05 for g in range(20, 300))


def test_prior_is_that_of_planted_variances(spark):
    r = np.random.default_rng(3)
    d0, s0, df = 8.0, 0.5, 10
    s2 = d0 * s0 / r.chisquare(d0, 20_000) * r.chisquare(df, 20_000) / df
    found = ex.variance_prior(table(spark, [(float(v), float(df)) for v in s2] + [(0.0, 10.0), (None, 10.0)], "s2 double, df double"))
    assert found == pytest.approx((d0, s0), rel=0.08)


def test_groups_too_small_or_missing(spark):
    values = table(spark, [(1, "a", 2.0), (1, "b", 1.0), (2, "a", 1.0), (None, "a", 1.0)], "gene int, sample string, v double")
    two = ex.moderated_test(values, table(spark, [("a", 1), ("b", 0)], "sample string, grp int")).collect()
    assert {r.gene for r in two} == {1, 2, None} and all(r.t is None and r.p is None and r.adj is None for r in two)
    one = ex.moderated_test(values, table(spark, [("a", 1), ("b", 1), ("c", 1)], "sample string, grp int")).collect()
    assert len(one) == 3 and all(r.logFC is None and r.t is None for r in one)
    assert ex.moderated_test(values.where("false"), table(spark, [("a", 1), ("b", 0)], "sample string, grp int")).count() == 0


def negative_binomial(seed, dispersion, genes=400, samples=12):
    r = np.random.default_rng(seed)
    mean = np.exp(r.uniform(math.log(5), math.log(5000), genes))[:, None]
    depth = np.linspace(0.5, 2.0, samples)[None]
    return r.poisson(mean * depth * r.gamma(1 / dispersion, dispersion, (genes, samples)))


def plain_scores(counts, logs):
    size = counts.sum(axis=0)
    x = counts * size.mean() / size
    out = []
    for v in logs:
        y = ex.stabilised(x.astype(float), math.exp(v))
        sd = y.std(axis=1, ddof=1)
        out.append(sd.std() / sd.mean())
    return out


def test_dispersion_is_found_and_variance_is_flat(spark):
    planted = 0.15
    counts = negative_binomial(4, planted)
    rows = [(g, s, int(n)) for g, row in enumerate(counts) for s, n in enumerate(row) if n]
    df, samples = table(spark, rows, "gene int, sample int, n long"), table(spark, [(s,) for s in range(12)], "sample int")
    found = ex.find_dispersion(df, samples)
    # What makes deviations alike over all means lies somewhat below the planted value (0.10 to 0.12 of 0.15 in plain numpy too).
    assert planted / 2 < found < planted
    logs = np.linspace(math.log(1e-4), 0, 200)
    assert plain_scores(counts, [math.log(found)])[0] <= min(plain_scores(counts, logs)) * 1.001
    y = {(r.gene, r.sample): r.y for r in ex.stabilise(df, samples).collect()}
    assert len(y) == counts.size
    size = counts.sum(axis=0)
    want = ex.stabilised(counts * size.mean() / size, found)
    assert all(y[g, s] == pytest.approx(want[g, s], rel=1e-9) for g in range(0, 400, 37) for s in range(12))
    sd, mean = want.std(axis=1), counts.mean(axis=1)
    low, high = sd[mean < np.median(mean)].mean(), sd[mean >= np.median(mean)].mean()
    assert 0.85 < low / high < 1.15


def test_stabilising_odd_tables(spark):
    samples = table(spark, [("a",), ("b",)], "sample string")
    none = table(spark, [], "gene int, sample string, n long")
    assert ex.find_dispersion(none, samples) == pytest.approx(ex.LEAST_DISPERSION) and ex.stabilise(none, samples).count() == 0
    some = ex.stabilise(table(spark, [(1, "a", 3)], none.schema), samples, 0.2).collect()
    assert {r.sample for r in some} == {"a", "b"}


EDGES = [("leaf", "p1"), ("leaf", "p2"), ("p1", "top"), ("p2", "top"), ("p2", "side"), ("top", "root"), ("x", "y"), ("y", "x"), ("leaf", "p1"), (None, "root"), ("p1", None)]


def closure(edges):
    above = {}
    for t, p in edges:
        if t is not None and p is not None:
            above.setdefault(t, set()).add(p)
            above.setdefault(p, set())
    out = {t: {t} | ps for t, ps in above.items()}
    while True:
        new = {t: set().union(*(out[p] for p in ps)) for t, ps in out.items()}
        if new == out:
            return out
        out = new


def test_ancestors_by_many_ways_and_in_cycles(spark):
    got = [tuple(r) for r in ex.ancestors(table(spark, EDGES, "term string, parent string")).collect()]
    assert len(got) == len(set(got)) and set(got) == {(t, p) for t, ps in closure(EDGES).items() for p in ps}
    chain = [(str(i), str(i + 1)) for i in range(40)]
    assert ex.ancestors(table(spark, chain, "term string, parent string")).count() == 41 * 42 // 2


def test_terms_equal_sums_over_a_planted_hierarchy(spark):
    rnd = random.Random(6)
    edges = EDGES + [(f"t{i}", f"t{rnd.randrange(i)}") for i in range(1, 30)] + [(f"t{i}", f"t{rnd.randrange(i)}") for i in range(1, 30)]
    notes = [(g, rnd.choice(["leaf", "p1", "x", "loose", *(f"t{i}" for i in range(30))])) for g in range(200) for _ in range(rnd.randint(1, 3))]
    chosen = [g for g in range(200) if any(a == g and t in ("t7", "t8") for a, t in notes) or rnd.random() < 0.1] + [999]
    got = ex.over_representation(
        table(spark, [(g,) for g in chosen], "gene int"), table(spark, [*notes, (None, "leaf"), (3, None)], "gene int, term string"), table(spark, edges, "term string, parent string")
    ).collect()
    up, held = closure(edges), {}
    for g, t in notes:
        for x in up.get(t, {t}):
            held.setdefault(x, set()).add(g)
    picked = set(chosen) - {999}
    want = {}
    for t, genes in held.items():
        k = len(genes & picked)
        if len(genes) >= 2 and k:
            ways = sum(math.comb(len(genes), i) * math.comb(200 - len(genes), len(picked) - i) for i in range(k, min(len(genes), len(picked)) + 1) if len(picked) - i <= 200 - len(genes))
            want[t] = (k, len(genes), len(picked), 200, ways / math.comb(200, len(picked)))
    assert {r.term for r in got} == set(want)
    for r in got:
        assert (r.intersection_size, r.term_size, r.query_size, r.universe) == want[r.term][:4]
        assert r.p == pytest.approx(want[r.term][4], rel=1e-8) and r.recall == r.intersection_size / r.term_size
    for r, adj in zip(got, step_up([r.p for r in got]), strict=True):
        assert r.adj == pytest.approx(adj, rel=1e-9)
    assert min(got, key=lambda r: r.p).term in ("t7", "t8")
