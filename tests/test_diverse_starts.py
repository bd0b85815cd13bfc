"""Starts of least residual that share no cut, against all choices of cuts."""

import itertools
import math

import numpy as np
import pytest

from strandframe.operators import cluster as cl
from strandframe.plans import catalogue
from strandframe.plans import trees

SF = "/root/testdata/sf0.001"


def all_choices(tree, table, size):
    score = lambda c: table.sse(tree.labels([frozenset([v]) for v in c]))
    return sorted((score(c), c) for c in itertools.combinations(tree.qualified(), size))


def picked(tree, table, size, n):
    """The rule by its definition, over all choices in order."""
    taken, others = [], []
    for r, c in all_choices(tree, table, size):
        if len(taken) < n and not any(set(c) & set(d) for _, d in taken):
            taken.append((r, c))
        else:
            others.append((r, c))
    return taken + others[: n - len(taken)]


def some_tree(seed, size, ties=False):
    rng = np.random.default_rng(seed)
    tree = cl.Tree([-1] + [int(rng.integers(max(0, (v - 1) // 3 - 1), max(1, v // 2))) for v in range(1, size)])
    n = np.asarray([40.0, 25.0, 60.0])
    s = np.full((3, size), 10.0) if ties else np.floor(rng.random((3, size)) * n[:, None])
    return tree, cl.Table(n, s)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("ties", [False, True])
def test_picks_equal_full_enumeration(seed, ties):
    tree, table = some_tree(seed, 26, ties)
    q = len(tree.qualified())
    assert q >= 6
    for k in range(2, 13):
        assert cl.diverse_cuts(tree, table, k - 1, 5) == picked(tree, table, k - 1, 5)
    assert cl.diverse_cuts(tree, table, q + 1, 5) == []
    assert list(cl.ranked_cuts(tree, table, tree.qualified(), 3)) == all_choices(tree, table, 3)


def test_the_first_choices_are_found_without_scoring_all(monkeypatch):
    """Cuts that matter are decided first, so a planted best choice takes few looks."""
    rng = np.random.default_rng(5)
    # A root with 18 limbs of three vertices each; six limbs differ from all else.
    parent = [-1] + [0] * 18 + [1 + i // 2 for i in range(36)]
    tree = cl.Tree(parent)
    level = np.full((3, len(parent)), 20.0)
    for limb in range(6):
        below = [1 + limb, *(v for v in range(len(parent)) if parent[v] == 1 + limb)]
        level[:, below] = (rng.random((3, 1)) < 0.5) * 60.0 + 10 + limb
    table, looks = cl.Table(np.full(3, 100.0), level), []
    plain = cl.Table.sse
    monkeypatch.setattr(cl.Table, "sse", lambda self, labels: looks.append(1) or plain(self, labels))
    assert len(tree.qualified()) == 18
    best = next(cl.ranked_cuts(tree, table, tree.qualified(), 6))
    assert best[1] == tuple(range(1, 7))
    assert len(looks) < math.comb(18, 6) / 20


def test_registered_starts_equal_full_enumeration(spark):
    tree, table = trees.nation_tree(spark, SF), trees.nation_table(spark, SF)
    got = catalogue.queries()["C6_diverse_starts"](spark, SF).collect()
    for k in range(2, 13):
        want = [(i, r, tree.labels([frozenset([v]) for v in c]).tolist()) for i, (r, c) in enumerate(picked(tree, table, k - 1, trees.STARTS))]
        assert sorted((x.start_id, x.residual, x.assignment) for x in got if x.k == k) == want
