"""What searches without SQL return, against the cells and a plain recount."""

import numpy as np
import pytest

from strandframe.operators import intervals as iv
from strandframe.plans import catalogue
from strandframe.plans import standins as S

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def by_cluster(spark):
    """Of each row cluster: its cells as an array."""
    cells = S.cells(spark, SF).toPandas().pivot(index="row_id", columns="col_id", values="x").sort_index().sort_index(axis=1)
    return [cells[cells.index % 3 == c].to_numpy(float) for c in range(3)]


def residual(by_cluster, assignment):
    """Squared distance of every cell from the mean of its block, block by block."""
    a = np.asarray(assignment)
    return sum(((m[:, a == k] - m[:, a == k].mean()) ** 2).sum() for m in by_cluster for k in set(a.tolist()))


@pytest.mark.parametrize("name", ["C1_random_starts", "C2_C5_local_search", "C11_best_fit"])
def test_assignments_have_k_clusters_and_their_residual(spark, by_cluster, name):
    rows = catalogue.queries()[name](spark, SF).collect()
    assert {r.k for r in rows} == set(range(2, 13))
    for r in rows:
        assert len(set(r.assignment)) == r.k
        if "residual" in r.asDict() and r.residual is not None:
            assert r.residual == pytest.approx(residual(by_cluster, r.assignment), rel=1e-9, abs=1e-6)
    if name == "C11_best_fit":
        assert len(rows) == 11


def test_hierarchical_and_k_means_labels(spark, by_cluster):
    for name in ("C8b_hierarchical", "C9_scalar_kmeans"):
        found = {r.col_id: r.k for r in catalogue.queries()[name](spark, SF).collect()}
        assert sorted(found) == list(range(25)) and 1 <= len(set(found.values())) <= 5
    linked, moved = ([r.k for r in sorted(catalogue.queries()[n](spark, SF).collect())] for n in ("C8b_hierarchical", "C9_scalar_kmeans"))
    assert residual(by_cluster, moved) <= residual(by_cluster, linked) + 1e-9


def test_submatrices_are_denser_than_the_whole(spark, monkeypatch):
    from strandframe.plans import statistics

    monkeypatch.setattr(statistics, "RESTARTS", 20)
    got = catalogue.queries()["M23_large_averages"](spark, SF).toPandas()
    cells = S.bits(spark, SF).toPandas().pivot(index="row_id", columns="col_id", values="x")
    rows = []
    for _, part in got.groupby("bicluster"):
        r, c = sorted(set(part["row_id"])), sorted(set(part["col_id"]))
        assert len(part) == len(r) * len(c)
        assert cells.loc[r, c].to_numpy().mean() > cells.to_numpy().mean()
        rows += r
    assert len(rows) == len(set(rows)) > 0


def plain_greedy(rows, rule):
    """The rule by its definition, over one chr's rows in order."""
    kept, left = [], sorted(rows)
    while left:
        anchor = left[0]
        group = [r for r in left if r[0] <= anchor[1]]
        best = anchor if rule == "first" else max(group, key=lambda r: (r[3], -left.index(r)))
        kept.append(best)
        left = [r for r in left[left.index(best) + 1 :] if r[0] > best[1]] if rule == "pick" else left[len(group) :]
    return kept


@pytest.mark.parametrize("rule", ["pick", "group", "first"])
def test_greedy_rules_equal_their_definition(spark, rule):
    rng = np.random.default_rng(3)
    rows = []
    for c, spread in (("dense", 300), ("sparse", 20_000), ("wide", 2000)):
        for i in range(150):
            start = int(rng.integers(0, spread))
            rows.append((c, start, start + int(rng.integers(1, 60)), i, float(rng.integers(0, 6))))
    df = spark.createDataFrame(rows, "chr string, start long, stop long, ord long, q double").repartition(3)
    got = sorted((r.chr, r.start, r.stop, r.ord, r.q) for r in iv.greedy(df, rule, ["ord"]).collect())
    want = sorted((c, *r) for c in ("dense", "sparse", "wide") for r in plain_greedy([x[1:] for x in rows if x[0] == c], rule))
    assert got == want


def test_nearest_equals_all_pairs(spark):
    rng = np.random.default_rng(4)
    def some(n, chrs):
        out = []
        for i in range(n):
            start = int(rng.integers(0, 3000))
            out.append((i, str(rng.choice(chrs)), start, start + int(rng.integers(1, 400 if i % 9 == 0 else 40))))
        return out

    a, b = some(200, ["x", "y", "z"]), some(90, ["x", "y"])
    schema = "chr string, start long, stop long"
    got = {r.a: (r.b, r.distance) for r in iv.nearest(spark.createDataFrame(a, f"a long, {schema}"), spark.createDataFrame(b, f"b long, {schema}"), "a", "b", segment=256).collect()}
    for i, c, s, e in a:
        near = [(0 if bs < e and s < be else (s - be if be <= s else bs - e) + 1, bs, be, j) for j, d, bs, be in b if d == c]
        if not near:
            assert got[i] == (None, None)
            continue
        least = min(near)[0]
        assert got[i][1] == least and got[i][0] in {n[3] for n in near if n[0] == least}
        if least == 0:
            assert got[i][0] == min(n for n in near if n[0] == 0)[3]
