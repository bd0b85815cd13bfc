import itertools
import math

import numpy as np
import pytest

from strandframe.operators import cluster as cl
from strandframe.operators import graph as gr
from strandframe.operators import matrix as mx
from strandframe.operators import stats as st


def null(spark, m, **o):
    return {(r.n1, r.n2, r.d): r.p for r in st.null_distances(spark, m, **o).collect()}


def test_null_distances_golden(spark):
    p = null(spark, 78)
    assert p[1, 1, 0] == pytest.approx(0.012820512820512822, rel=1e-12)
    assert p[1, 1, 2] == pytest.approx(0.9871794871794858, rel=1e-12)
    assert p[2, 2, 0] == pytest.approx(0.0003330003330003338, rel=1e-11)
    assert p[2, 2, 2] == pytest.approx(0.05061605061605061, rel=1e-11)
    assert p[40, 5, 35] == pytest.approx(0.031168831168831283, rel=1e-11)
    assert p[40, 5, 37] == pytest.approx(0.16450216450216512, rel=1e-11)
    assert (0, 0, 0) in p and (0, 0, 0) not in null(spark, 5, all_k=False)


def test_fdr_edges_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2, (6, 14))
    m = np.concatenate([np.where(rng.random((12, 14)) < 0.06, 1 - base[i], base[i]) for i in range(6)])
    cells = spark.createDataFrame([(i, j, int(x)) for i, r in enumerate(m) for j, x in enumerate(r)], "row_id long, col_id int, x int")
    got = {tuple(r) for r in st.fdr_edges(mx.pack(cells, 14), 14, 0.1).collect()}
    p = null(spark, 14)
    ones, want, nc = m.sum(axis=1), set(), 14
    for n1 in range(3, nc - 3):
        for n2 in (n1, n1 + 1):
            if n2 > nc - 2:
                continue
            left, right = np.flatnonzero(ones == n1), np.flatnonzero(ones == n2)
            f0 = len(right) * np.cumsum([p.get((n1, n2, d), 0.0) for d in range(nc + 1)])
            for i in left:
                d = np.asarray([nc if i == j else int((m[i] != m[j]).sum()) for j in right], int)
                seen = np.cumsum(np.bincount(d, minlength=nc + 1))
                ok = np.flatnonzero((f0 <= 0.1 * seen) & (seen > 0))
                want |= {(int(i), int(j)) for j, x in zip(right, d, strict=True) if len(ok) and x <= ok.max() and (n1 != n2 or i < j)}
    assert len(want) > 20 and got == want


def test_decomposition_adds_up_and_sse(spark):
    rng = np.random.default_rng(2)
    m = rng.integers(0, 2, (40, 12))
    cells = spark.createDataFrame([(i, j, int(x), i % 2) for i, r in enumerate(m) for j, x in enumerate(r)], "row_id long, col_id int, x int, cluster int")
    k = np.arange(12) // 4
    assign = spark.createDataFrame([(i, int(c)) for i, c in enumerate(k)], "col_id int, k int")
    stats = mx.column_stats(cells)
    assert all(abs(r.check - 1) < 1e-9 for r in st.full_decomposition(stats, assign).collect())
    want = sum(((m[i::2][:, k == c] - m[i::2][:, k == c].mean()) ** 2).sum() for i in (0, 1) for c in range(3))
    assert mx.sse(mx.block_stats(stats, assign)).first().sse == pytest.approx(want)
    assert cl.Table.collect(stats).sse(k) == pytest.approx(want)


def test_on_off_split_is_the_best_one(spark):
    rng = np.random.default_rng(3)
    vals = [rng.random(n).round(2).tolist() for n in (2, 5, 9)] + [[0.7, 0.7, 0.7], [0.2, 0.2]]
    df = spark.createDataFrame([(g, i, float(v)) for g, vs in enumerate(vals) for i, v in enumerate(vs)], "g int, i int, v double")
    got = mx.on_off_split(df, ["g"], "v", ["i"]).toPandas()
    for g, vs in enumerate(vals):
        on = got[got.g == g].sort_values("i")["on"].to_numpy()
        v = np.asarray(vs)
        if len(set(vs)) == 1:
            assert set(on) == {int(vs[0] > 0.5)}
            continue
        loss = lambda b: sum(((v[b == s] - v[b == s].mean()) ** 2).sum() for s in (0, 1) if (b == s).any())  # noqa: E731, B023
        s = np.sort(v)
        best = min(((s[:i] - s[:i].mean()) ** 2).sum() + ((s[i:] - s[i:].mean()) ** 2).sum() for i in range(1, len(s)))
        assert loss(on) == pytest.approx(best, abs=1e-8) and v[on == 1].min() >= v[on == 0].max()


def test_binomial_tail(spark):
    cases = [(k, n, p) for n in (1, 5, 30) for k in range(n + 1) for p in (0.0, 0.2, 0.9, 1.0)]
    got = spark.createDataFrame(cases, "k long, n long, p double").withColumn("t", st.binomial_tail("k", "n", "p")).collect()
    for r in got:
        want = sum(math.comb(r.n, i) * r.p**i * (1 - r.p) ** (r.n - i) for i in range(r.k, r.n + 1))
        assert r.t == pytest.approx(min(want, 1.0), abs=1e-9)


def test_permutations_keep_group_sizes_and_find_a_planted_motif(spark):
    x = spark.createDataFrame([(i, int(i < 60), 1) for i in range(200)], "row_id long, grp int, w int")
    hits = spark.createDataFrame([(i, "on") for i in range(60)] + [(i, "any") for i in range(0, 200, 2)], "row_id long, tf string")
    z = {r.tf: r.z for r in st.enrichment(hits, x).collect()}
    top = {r.tf: r.null_max for r in st.permutation_max(hits, x, 20, 1).collect()}
    assert z["on"] > top["on"] and z["any"] < top["any"]


def test_components_and_cuts_agree_with_the_definition(spark):
    rng = np.random.default_rng(4)
    for _ in range(3):
        n = 12
        parent = [-1] + [int(rng.integers(0, v)) for v in range(1, n)]
        tree = cl.Tree(parent)
        groups, used = [], set()
        for v in rng.permutation(tree.internal)[:3]:
            kids = [c for c in tree.children[int(v)] if c not in used]
            take = kids[: int(rng.integers(1, len(kids) + 1))]
            used |= set(take)
            groups.append(frozenset(take))
        labels = tree.labels(groups)
        link = {v: v for v in range(n)}

        def root(v, link=link):
            while link[v] != v:
                v = link[v]
            return v

        for v in range(1, n):
            if v not in used:
                link[root(v)] = root(parent[v])
        for g in groups:
            for a, b in itertools.combinations(sorted(g), 2):
                link[root(a)] = root(b)
        assert all((labels[a] == labels[b]) == (root(a) == root(b)) for a in range(n) for b in range(n))
        assert sorted(map(sorted, tree.cuts(labels))) == sorted(map(sorted, groups))
        edges = spark.createDataFrame([(p, v) for v, p in enumerate(parent) if p >= 0], "parent int, child int")
        cuts = spark.createDataFrame([(i, c) for i, g in enumerate(groups) for c in g], "grp int, child int")
        verts = spark.createDataFrame([(v,) for v in range(n)], "v int")
        got = {r.v: r.component for r in gr.components_under_cuts(gr.closure(spark, edges), cuts, verts).collect()}
        assert [got[v] for v in range(n)] == labels.tolist()


def test_search_finds_planted_components(spark):
    parent = [-1, 0, 0, 1, 1, 2, 2, 3, 3]
    tree = cl.Tree(parent)
    truth = tree.labels([frozenset([1]), frozenset([6])])
    rng = np.random.default_rng(5)
    m = np.concatenate([(rng.random((60, 9)) < np.where(truth == c, 0.9, 0.1)) for c in range(3)]).astype(int)
    cells = spark.createDataFrame([(i, j, int(x), i // 60) for i, r in enumerate(m) for j, x in enumerate(r)], "row_id long, col_id int, x int, cluster int")
    table = cl.Table.collect(mx.column_stats(cells))
    starts = cl.random_starts(spark, tree, table, [3], 6).unionByName(cl.smart_starts(spark, tree, table, [3], 2))
    fits = cl.fits(starts, tree, table).collect()
    assert all(f.residual <= s.residual + 1e-9 for s in starts.collect() for f in fits if (f.start_id, f.generated) == (s.start_id, s.generated))
    best = cl.best_fits(cl.fits(starts, tree, table)).first()
    assert list(best.assignment) == truth.tolist()
    assert all(len(set(f.assignment)) == 3 for f in fits)


def test_louvain_parts_two_cliques_and_is_as_good_as_any_bipartition(spark):
    e = [(a, b) for a, b in itertools.combinations(range(5), 2)] + [(a, b) for a, b in itertools.combinations(range(5, 10), 2)] + [(0, 5), (20, 21)]
    edges = spark.createDataFrame(e, "e1 long, e2 long")
    spark.sparkContext.setCheckpointDir("/tmp/strandframe-tests")
    got = {r.v: r.cluster for r in gr.louvain(edges).collect()}
    assert len({got[v] for v in range(5)}) == 1 and len({got[v] for v in range(5, 10)}) == 1 and len(set(got.values())) == 3
    labels = spark.createDataFrame(list(got.items()), "v long, cluster long")
    assert gr.modularity(edges, labels).first().modularity > 0.4


def test_roots_and_depth_guard(spark):
    two = spark.createDataFrame([(0, 1), (2, 3)], "parent int, child int")
    with pytest.raises(ValueError, match="more than one"):
        gr.the_root(two)
    with pytest.raises(ValueError, match="cycle"):
        gr.closure(spark, spark.createDataFrame([(0, 1), (1, 0)], "parent int, child int"), limit=8)
