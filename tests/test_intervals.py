import random

import pytest

from strandframe.operators import intervals as iv
from strandframe.operators.intervals import _walk

SCHEMA = "ord long, chr string, start long, stop long, q double"


def some(spark, n, seed, chroms="AB", width=40, span=900):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        a = rnd.randrange(span)
        rows.append((i, rnd.choice(chroms), a, a + rnd.randint(1, width), float(rnd.randint(0, 5))))
    return rows, spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("width", [7, 50, 5000])
def test_overlap_joins_equal_brute_force(spark, width):
    a, da = some(spark, 120, 1, "ABC")
    b, db = some(spark, 90, 2)
    db = db.withColumnRenamed("ord", "b")
    hit = {(x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] < y[3] and y[2] < x[3]}
    assert {tuple(r) for r in iv.overlap_pairs(da, db, "ord", "b", width).collect()} == hit
    assert iv.overlap_pairs(da, db, "ord", "b", width).count() == len(hit)
    semi = {r.ord for r in iv.overlap_semi(da, db, "ord", width).collect()}
    anti = {r.ord for r in iv.overlap_anti(da, db, "ord", width).collect()}
    assert semi == {x for x, _ in hit} and semi | anti == {x[0] for x in a} and not semi & anti
    counts = {r.ord: r.n for r in iv.overlap_count(da, db, "ord", "b", width).collect()}
    assert counts == {x[0]: sum(h[0] == x[0] for h in hit) for x in a}


def test_touching_intervals_do_not_overlap_in_joins_but_do_in_greedy(spark):
    a = spark.createDataFrame([(0, "A", 0, 10, 1.0)], SCHEMA)
    b = spark.createDataFrame([(1, "A", 10, 20, 2.0)], SCHEMA)
    assert iv.overlap_semi(a, b, "ord").count() == 0
    assert [r.ord for r in iv.greedy(a.union(b), "pick", ["ord"]).collect()] == [1]


@pytest.mark.parametrize("segment", [16, 128, 1 << 22])
def test_nearest_equals_brute_force(spark, segment):
    a, da = some(spark, 150, 3, "ABC")
    b, db = some(spark, 40, 4)
    got = {r.ord: (r.b, r.distance) for r in iv.nearest(da, db.withColumnRenamed("ord", "b"), "ord", "b", segment).collect()}

    def dist(x, y):
        return 0 if x[2] < y[3] and y[2] < x[3] else y[2] - x[3] + 1 if y[2] >= x[3] else x[2] - y[3] + 1

    for x in a:
        near = [(dist(x, y), y[2], y[3], y[0]) for y in b if y[1] == x[1]]
        assert got[x[0]] == ((min(near)[3], min(near)[0]) if near else (None, None))


@pytest.mark.parametrize("rule", ["pick", "group", "first"])
@pytest.mark.parametrize("segment", [32, 1 << 22])
def test_greedy_by_islands_equals_the_walk_over_a_chromosome(spark, rule, segment, monkeypatch):
    rows, df = some(spark, 160, 5, span=3000)
    monkeypatch.setattr(iv.islands, "__defaults__", (segment,))
    got = {r.ord for r in iv.greedy(df, rule, ["ord"]).collect()}
    want = set()
    for c in "AB":
        r = sorted((x for x in rows if x[1] == c), key=lambda x: (x[2], x[3], x[0]))
        want |= {r[i][0] for i in _walk([x[2] for x in r], [x[3] for x in r], [x[4] for x in r], rule)}
    assert got == want
    if rule != "group":
        kept = sorted((x for x in rows if x[0] in got), key=lambda x: (x[1], x[2]))
        assert all(p[1] != n[1] or p[3] < n[2] for p, n in zip(kept, kept[1:], strict=False))


def test_greedy_rules_differ_on_a_chain():
    starts, stops, q = [0, 8, 16, 24], [10, 18, 26, 34], [1.0, 2.0, 3.0, 3.0]
    assert _walk(starts, stops, q, "pick") == [1, 3]
    assert _walk(starts, stops, q, "group") == [1, 2]
    assert _walk(starts, stops, q, "first") == [0, 2]


def test_empty_tables(spark):
    e = spark.createDataFrame([], SCHEMA)
    assert iv.greedy(e, "pick", ["ord"]).count() == 0
    assert iv.overlap_anti(e, e, "ord").count() == 0
    assert iv.nearest(e, e.withColumnRenamed("ord", "b"), "ord", "b").count() == 0
