"""Steps whose time, memory or disk used to grow faster than their input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.operators import expression as ex
from strandframe.operators import intervals as iv


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_no_window_frame_ends_at_the_last_row(spark):
    """Spark works such a frame out anew for each row: the square of a stretch's rows."""
    a = spark.range(5).select(F.col("id").alias("a"), F.lit("x").alias("chr"), F.col("id").alias("start"), (F.col("id") + 2).alias("stop"))
    assert "unboundedfollowing" not in plan(iv.nearest(a, a.withColumnRenamed("a", "b"), "a", "b"))
    p = spark.range(9).select((F.col("id") / 9).alias("p"))
    adjusted = ex.step_up(p, "p", "adj")
    assert "unboundedfollowing" not in plan(adjusted)
    want = np.minimum.accumulate((np.arange(9) / 9 * 9 / np.arange(1, 10))[::-1])[::-1]
    assert [r.adj for r in adjusted.orderBy("p").collect()] == pytest.approx(np.minimum(want, 1).tolist())


def test_poisson_tails_are_worked_out_in_batches_once_for_each_row(spark, monkeypatch):
    """A list of terms for each row took most of the calls' time, three times over."""
    from strandframe.functions import tails
    from strandframe.operators import peaks as pk

    reads = spark.range(60).select(F.lit("x").alias("chr"), (F.col("id") * 7).alias("start"), (F.col("id") * 7 + 30).alias("stop"), F.lit("+").alias("strand"))
    assert "lambda" not in plan(pk.scored_pileup(reads, 50, 10_000))
    tables = []
    monkeypatch.setattr(pk, "written", lambda df, purpose: tables.append(plan(df)) or df.localCheckpoint())
    called = pk.call_peaks(reads, 50, 10_000, 1.0)
    assert len(tables) == 1 and "poisson" in tables[0] and "poisson" not in plan(called)
    k = np.array([0.0, 1, 5, 40, 3, 2000, 900])
    rate = np.array([2.0, 1e-3, 5, 3, 50, 900, 900])
    want = [np.log(sum(np.exp(i * np.log(r) - r - np.vectorize(__import__("math").lgamma)(i + 1.0)) for i in np.arange(x, x + 3000))) for x, r in zip(k, rate, strict=True)]
    assert tails.poisson_ln_tails(k, rate) == pytest.approx(want, rel=1e-8, abs=1e-8)


def test_pairs_are_counted_where_they_meet(spark, monkeypatch):
    """A row for each pair used to be made, and shuffled to find cutoffs."""
    from strandframe.operators import matrix as mx
    from strandframe.operators import stats as st

    monkeypatch.setattr(st, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(8)
    bits = rng.random((60, 80)) < np.repeat([0.03, 0.5], 30)[:, None]
    cells = spark.createDataFrame([(i, j, int(bits[i, j])) for i in range(60) for j in range(80)], "row_id long, col_id int, x int")
    packed = mx.pack(cells, 80)
    ones, d = bits.sum(axis=1), (bits[:, None] != bits[None]).sum(axis=2)
    want = {}
    for i in range(60):
        for j in range(60):
            if i != j and ones[j] - ones[i] in (0, 1):
                key = (i, int(ones[i]), int(ones[j]), int(d[i, j]))
                want[key] = want.get(key, 0) + 1
    counts = st.distance_histogram(packed, 80)
    assert {(r.r1, r.n1, r.n2, r.d): r.n for r in counts.collect()} == want
    cuts = spark.createDataFrame([(i, int(ones[i]) + s, 50 if i < 40 else 2) for i in range(60) for s in (0, 1)], "r1 long, n2 int, cut int")
    pairs = {(i, j) for i in range(60) for j in range(60) if ones[j] - ones[i] in (0, 1) and d[i, j] <= (50 if i < 40 else 2) and (ones[i] != ones[j] or i < j)}
    got = [tuple(r) for r in st.near_pairs(packed, cuts).collect()]
    assert set(got) == pairs and len(got) == len(pairs) > 0


def test_kmers_travel_together_and_are_counted_exactly(spark):
    """A row of k letters for each letter used to be shuffled."""
    from collections import Counter

    from strandframe.functions import sequence as sq

    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("ACGT"), n)) for n in (0, 33, 34, 35, 500, (1 << 20) + 300)]
    texts += [texts[4], "A" * 200, "ACGT" * 30, "grün€😀" * 12, None]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, seq string")
    for k in (34, 5):
        want = Counter(t[i : i + k] for t in texts if t for i in range(len(t) - k + 1))
        counted = sq.kmer_counts(df, k)
        assert {r.kmer: r.n for r in counted.collect()} == want
    rows = [r for r in sq.kmer_counts(df, 34)._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in r]
    assert len(rows) == 1 and "hashpartitioning(m#" in rows[0]  # strings by their least word, and no k-mers after them


def test_only_kmers_that_a_word_may_be_become_rows(spark):
    from strandframe.functions import sequence as sq

    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("ACGT"), n)) for n in (4, 5, 700, (1 << 20) + 9)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, seq string")
    words = ["ACGTA", "GATTC", "ACG"]
    found = sq.scan(df, spark.createDataFrame([(w,) for w in words], "word string"), 5)
    back = lambda w: w[::-1].translate(str.maketrans("ACGT", "TGCA"))
    kmers = {(w if s == "+" else back(w), w, s) for w in words[:2] for s in "+-"}
    want = sorted((i, at, at + 5, w, s) for i, t in enumerate(texts) if t for at in range(len(t) - 4) for k, w, s in kmers if t.startswith(k, at))
    assert sorted(tuple(r) for r in found.collect()) == want
    assert "explode" not in plan(found)


def test_letters_are_shuffled_by_hashes_in_batches(spark):
    """A list of hash strings for each letter took seconds a megabyte."""
    from hashlib import md5

    from strandframe.functions import sequence as sq

    rows = [("7", "ACGT" * 3000), ("x" * 60, "GATTACA"), ("8", "é€😀a"), (None, "ACGTACGTACGT"), ("9", ""), ("10", None)]
    df = spark.createDataFrame(rows, "row_id string, seq string")
    mixed = df.select("row_id", "seq", sq.shuffled(F.col("row_id"), F.col("seq"), 5).alias("m"))
    assert "lambda" not in plan(mixed)
    for r in mixed.collect():
        key = lambda i: (md5("_".join([*([r.row_id] if r.row_id is not None else []), str(i), "5"]).encode()).hexdigest(), i)  # noqa: B023, E731
        assert r.m == (r.seq and "".join(r.seq[i - 1] for i in sorted(range(1, len(r.seq) + 1), key=key)))


def test_edges_of_classes_add_up_to_those_of_rows(spark, monkeypatch):
    """Equal rows used to be met, and linked, one by one."""
    from collections import Counter

    from strandframe.operators import stats as st

    monkeypatch.setattr(st, "BLOCK_ROWS", 5)
    rng = np.random.default_rng(4)
    kinds = rng.random((25, 16)) < np.repeat([0.25, 0.4, 0.5, 0.6, 0.7], 5)[:, None]
    kinds[5:8] = kinds[8]
    kinds[5, 0], kinds[6, 1], kinds[7, 2] = ~kinds[5, 0], ~kinds[6, 1], ~kinds[7, 2]
    bits = kinds[rng.choice(25, 300, p=np.r_[[0.3, 0.1], np.full(23, 0.6 / 23)])]
    bits = np.r_[bits, rng.random((60, 16)) < 0.5]
    rows = [(int(i), int(b.sum()), [int(sum(1 << int(c) for c in np.flatnonzero(b)))]) for i, b in zip(rng.permutation(len(bits)), bits, strict=True)]
    packed = spark.createDataFrame(rows, "row_id long, ones int, bits array<long>")
    undecided = []
    for fdr in (0.3, 0.01):
        edges, members = st.fdr_class_edges(packed, 16, fdr)
        of = {r.row_id: r.v for r in members.collect()}
        want = Counter(tuple(sorted((of[r.e1], of[r.e2]))) for r in st.fdr_edges(packed, 16, fdr).collect())
        got = Counter()
        for r in edges.collect():
            got[tuple(sorted((r.e1, r.e2)))] += r.w
        assert got == want and want
        sizes = Counter(of.values())
        undecided += [k for k, n in want.items() if k[0] != k[1] and n not in (1, sizes[k[0]] * sizes[k[1]])]
    assert undecided and max(sizes.values()) > 20  # rows that come first decide in some


def test_large_parts_move_in_rounds(spark, monkeypatch):
    """A connected part used to be one task, whatever its size."""
    import pandas as pd

    from strandframe.operators import graph as gr

    rng = np.random.default_rng(6)
    group = np.arange(240) // 24
    edges = [(i, j) for i in range(240) for j in range(i + 1, 240) if rng.random() < (0.6 if group[i] == group[j] else 0.01)]
    edges += [(1000, 1001), (1001, 1002)]
    df = spark.createDataFrame([(j, i) for i, j in edges], "e1 long, e2 long")
    value = lambda d: gr.modularity(df, d).first().modularity
    labels = {r.v: r.cluster for r in gr.louvain(df).collect()}
    plain = gr._louvain
    by_part = plain(np.asarray(edges[:-2]), 2.0 * len(edges))  # small parts go together, and get what they get alone
    same = lambda d: {frozenset(v for v in by_part if d[v] == d[u]) for u in by_part}
    assert same(labels) == same(by_part)
    alone = value(spark.createDataFrame(list(labels.items()), "v long, cluster long"))
    tasks = []
    monkeypatch.setattr(gr, "PART_EDGES", 300)
    moved = gr._moves
    monkeypatch.setattr(gr, "_moves", lambda graph, total: tasks.append(graph.count()) or moved(graph, total))
    labels = gr.louvain(df)
    assert tasks and tasks[0] == len(edges) - 2
    assert value(labels) > 0.99 * alone
    got = {r.v: r.cluster for r in labels.collect()}
    assert set(got) == {*range(240), 1000, 1001, 1002} and got[1000] == got[1001] == got[1002]
    # Weights and loops stand for the edges of merged vertices.
    half = pd.DataFrame(edges, columns=["a", "b"]) // 2
    pairs = half.groupby(["a", "b"]).size()
    whole = np.asarray([p for p, n in pairs.items() for _ in range(n)])
    merged = plain(np.asarray(list(pairs.index)), 2.0 * len(edges), pairs.to_numpy(float))
    assert merged == plain(whole, 2.0 * len(edges))
    members = spark.range(240).union(spark.range(1000, 1003)).selectExpr("id div 2 as v", "id as row_id")
    weighted = spark.createDataFrame([(int(a), int(b), int(n)) for (a, b), n in pairs.items()], "e1 long, e2 long, w long")
    assert value(gr.louvain(weighted, "w", members)) > 0.95 * alone


def test_rows_of_bits_are_what_the_driver_takes(spark, monkeypatch):
    """Every cell used to be taken to the driver, as a row of its own."""
    from pyspark.sql.classic.dataframe import DataFrame

    from strandframe.operators import cluster as cl

    rng = np.random.default_rng(1)
    x = (rng.random((90, 70)) < rng.uniform(0.2, 0.8, 70)).astype(float)
    x[10:40, 5:30] = rng.random((30, 25)) < 0.9
    cells = spark.createDataFrame([(i * 3, j + 2, int(x[i, j])) for i in range(90) for j in range(70)], "row_id long, col_id int, x int")

    def no(*a):
        raise AssertionError("cells on the driver")

    monkeypatch.setattr(DataFrame, "toPandas", no)
    got = cl.large_averages(cells, 2, 30).collect()

    def standard(m):
        sd = m.std(axis=0, ddof=1)
        return (m - m.mean(axis=0)) / np.where(sd > 0, sd, 1.0)

    def search(z, rng):
        k, width = int(rng.integers(1, max(2, len(z) // 2 + 1))), int(rng.integers(1, z.shape[1] + 1))
        c, r = np.sort(rng.choice(z.shape[1], width, replace=False)), np.empty(0, int)
        while True:
            new_r = np.sort(np.argsort(-z[:, c].sum(axis=1), kind="stable")[:k])
            new_c = np.sort(np.argsort(-z[new_r].sum(axis=0), kind="stable")[:width])
            done = np.array_equal(new_r, r) or np.array_equal(new_c, c)
            r, c = new_r, new_c
            if done:
                break
        lg = np.vectorize(__import__("math").lgamma)
        t = -z[np.ix_(r, c)].mean() * (k * width) ** 0.5
        choose = lambda a, b: lg(a + 1) - lg(b + 1) - lg(a - b + 1)
        return -choose(len(z), k) - choose(z.shape[1], width) - (np.log(0.5) - 0.717 * t - 0.416 * t * t), r, c

    z, alive, want = standard(x), np.arange(90), set()
    z = np.sign(z) * np.log1p(np.abs(z))
    for b in range(2):
        _, _, r, c = max((s, -i, r, c) for i in range(30) for s, r, c in [search(z, np.random.default_rng([0, b, i]))])
        want |= {(b, int(alive[i]) * 3, int(j) + 2) for i in r for j in c}
        keep = np.setdiff1d(np.arange(len(alive)), r)
        alive, z = alive[keep], standard(z[keep])
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_equal_places_meet_once(spark):
    """Each copy of a peak used to meet each copy of a window."""
    a = spark.range(400).selectExpr("id as ord", "'x' as chr", "id % 4 * 100 as start", "id % 4 * 100 + 150 as stop", "id % 3 as sample")
    out = iv.presence(a.where("ord < 200"), a.where("sample < 2"), "ord", [0, 1, 2])
    assert {tuple(r)[1:] for r in out.collect()} == {(1, 1, 0)} and out.count() == 200
    pairs = []
    met = iv.overlap_pairs
    try:
        iv.overlap_pairs = lambda *x: pairs.append(met(*x)) or pairs[0]
        iv.presence(a, a, "ord", [0, 1, 2])
    finally:
        iv.overlap_pairs = met
    assert pairs[0].count() == 10


def test_genes_of_the_same_terms_go_together(spark, monkeypatch):
    """A row for each gene and each term above it used to be made in one task."""
    tables = []
    kept = ex.written
    monkeypatch.setattr(ex, "written", lambda df, purpose: tables.append(kept(df, purpose)) or tables[-1])
    genes = spark.range(600).selectExpr("id as gene", "concat('t', id % 3) as term").unionByName(spark.range(100).selectExpr("id as gene", "'lone' as term"))
    edges = spark.createDataFrame([("t0", "a"), ("t1", "a"), ("t1", "b"), ("a", "top"), ("b", "top")], "term string, parent string")
    got = {r.term: (r.term_size, r.intersection_size, r.query_size, r.universe) for r in ex.over_representation(spark.range(40, 900, 4).toDF("gene"), genes, edges).collect()}
    of = {i: {f"t{i % 3}", *((), ("lone",))[i < 100], *(("a", "top"), ("a", "b", "top"), ())[i % 3]} for i in range(600)}
    picked = {i for i in range(40, 600, 4)}
    want = {t: (sum(t in v for v in of.values()), sum(t in of[i] for i in picked), len(picked), 600) for t in {t for v in of.values() for t in v}}
    assert got == want and max(t.count() for t in tables) < 10


def test_peaks_are_no_rows_of_their_own_for_each_background(spark, monkeypatch):
    """A row for each run, motif and peak used to be made, and shuffled twice."""
    import math
    from hashlib import md5

    from strandframe.operators import stats as st

    monkeypatch.setattr(st, "BLOCK_ROWS", 7)
    monkeypatch.setattr(st, "HELD_CELLS", 60, raising=False)
    rng = np.random.default_rng(12)
    n = rng.integers(0, 5, (90, 6)) * (rng.random((90, 6)) < 0.7)
    n[:, 5] += 1
    gc, motifs = rng.random(90), [f"m{i}" for i in range(5)]
    hits = [(p, m) for p in range(90) for m in motifs if rng.random() < 0.4]
    cells = [(p, f"s{c}", int(n[p, c])) for p in range(90) for c in range(6) if n[p, c]]
    # Counts of a peak in two rows add up, a motif named twice counts once, and unknown peaks don't.
    cells = [(p, s, v - 1) for p, s, v in cells if v > 1] + [(p, s, 1) for p, s, v in cells]
    tables = (spark.createDataFrame(cells, "peak long, sample string, n long"), spark.createDataFrame([*hits, *hits[:9], (999, "m0")], "peak long, tf string"), spark.createDataFrame([(i, float(g)) for i, g in enumerate(gc)], "peak long, gc double"))
    offsets = [1, 5, 9_000_001, 2**23 + 3]
    laid_out = []
    monkeypatch.setattr(st, "written", lambda df, purpose: laid_out.append(df.localCheckpoint()) or laid_out[-1])
    found = st.deviations(*tables, offsets, 3, 2)
    assert "generate" not in plan(found)
    assert laid_out and max(df.count() for df in laid_out) <= max(len(cells), (1 + len(offsets)) * len(motifs) * 6)
    got = {(r.tf, r.sample): (r.deviation, r.z) for r in found.collect()}

    total, share = n.sum(axis=1), n.sum(axis=0) / n.sum()
    bins, place = {}, {}
    for p in sorted(range(90), key=lambda p: (int(md5(f"{p}_3".encode()).hexdigest()[:15], 16), p)):
        held = bins.setdefault((min(math.floor(gc[p] * 2), 1), math.floor(math.log2(1 + total[p]))), [])
        place[p] = (held, len(held))
        held.append(p)
    for m in motifs:
        own = [p for p, w in hits if w == m]
        d = []
        for off in [0, *offsets]:
            at = [place[p][0][(place[p][1] + off) % len(place[p][0])] for p in own]
            expected = share * total[at].sum()
            d.append((n[at].sum(axis=0) - expected) / expected)
        change, sd = d[0] - np.mean(d[1:], axis=0), np.std(d[1:], axis=0, ddof=1)
        for c in range(6):
            assert got.pop((m, f"s{c}")) == pytest.approx((change[c], change[c] / sd[c]), rel=1e-9)
    assert not got


def test_deviations_of_odd_tables(spark):
    from strandframe.operators import stats as st

    counts, hits, gc = "peak long, sample string, n {}", "peak long, tf string", "peak long, gc double"
    make = spark.createDataFrame
    none = st.deviations(make([], counts.format("long")), make([(1, "a")], hits), make([(1, 0.5)], gc), [1], 3)
    assert none.count() == 0
    assert st.deviations(make([(1, "x", 2)], counts.format("long")), make([], hits), make([(1, 0.5)], gc), [1], 3).count() == 0
    rows = [(1, "x", 2.5), (1, "y", 1.5), (2, "x", 3.0), (2, None, 1.0), (None, "x", 1.0), (3, "x", None)]
    some = st.deviations(make(rows, counts.format("double")), make([(1, "a"), (1, None), (3, "a")], hits), make([(1, 0.5), (2, 0.5), (3, 0.5)], gc), [1, 2], 3)
    got = {(r.tf, r.sample): r.deviation for r in some.collect()}
    assert set(got) == {(t, s) for t in ("a", None) for s in ("x", "y", None)}
    # Runs are peaks 1, 2, 1: shares of all counts are 6.5, 1.5 and 1 of 9; what has no name is never seen.
    assert got["a", "x"] == pytest.approx((2.5 / 4 - 3 / 4) / 2 / (6.5 / 9)) and got["a", "y"] == pytest.approx(1.5 / 4 / 2 / (1.5 / 9))
    assert all(got[k] == 0 for k in got if None in k)


def test_counts_get_more_tasks_as_line_items_grow(spark, monkeypatch):
    """The session's number of partitions used to be all, whatever the input: a task's rows grew with it."""
    from strandframe import runtime
    from strandframe.plans import standins as S

    few = S.counts(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(runtime, "TASK_ROWS", 500, raising=False)
    many = S.counts(spark, "/root/testdata/sf0.001")
    assert many.rdd.getNumPartitions() == 12 > few.rdd.getNumPartitions()  # 6000 line items
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect()))


def test_edges_are_not_sent_to_the_driver(spark, monkeypatch):
    """Compressed edges passed for small: 135 MB of them were broadcast where a part's size was looked up."""
    from strandframe.operators import graph as gr
    from strandframe.operators import matrix as mx
    from strandframe.operators import stats as st

    plans, kind = [], type(spark.range(1))
    noted = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df
    for module, name in ((gr, "written"), (st, "written"), (kind, "checkpoint")):
        monkeypatch.setattr(module, name, lambda df, *a, f=getattr(module, name), **b: f(noted(df), *a, **b))
    rng = np.random.default_rng(4)
    bits = np.repeat(rng.random((20, 64)) < 0.3, 3, axis=0)
    cells = spark.createDataFrame([(i, int(j), 1) for i in range(60) for j in np.flatnonzero(bits[i])], "row_id long, col_id int, x int")
    edges, members = st.fdr_class_edges(mx.pack(cells, 64), 64, 0.05)
    found = noted(gr.louvain(edges, "w", members))
    of = {r.v: r.cluster for r in found.collect()}
    assert of and all(of[i] == of[i - i % 3] for i in of)
    joins = [line for p in plans for line in p.splitlines() if "Join " in line]
    assert len(joins) > 9 and not any("BroadcastHashJoin" in line and ("part" in line or "e1" in line or "row_id" in line) for line in joins)


def test_chunks_travel_to_a_few_groups_only(spark, monkeypatch):
    """Each pair of chunks used to be laid out and shuffled: the square of a block's rows."""
    from strandframe.operators import matrix as mx
    from strandframe.operators import stats as st

    for name, v in (("BLOCK_ROWS", 5), ("GROUPS", 2), ("GROUP_CHUNKS", 3)):
        monkeypatch.setattr(st, name, v)
    rng = np.random.default_rng(5)
    rows = []
    for i in range(90):
        rows += [(i, int(j), 1) for j in rng.choice(16, 5 if i < 75 else 6, replace=False)]
    packed = mx.pack(spark.createDataFrame(rows, "row_id long, col_id int, x int"), 16).cache()
    right = packed.select("row_id", F.col("ones").alias("n2"), "bits")
    left = packed.select("row_id", F.col("ones").alias("n1"), F.col("ones").alias("n2"), "bits")
    met = st._met(left, right).collect()
    chunks = {side: sorted(len(r.ids) for r in met if r.n1 == 5 and r.right == side) for side in (False, True)}
    groups = {r.grp for r in met if r.n1 == 5}
    assert sum(chunks[False]) == 75 and len(chunks[False]) <= 15 and len(groups) <= 5
    assert sum(chunks[True]) == 75 * len(groups) and len(met) < 15 * 15
    # Every row still meets all others, whatever the group it is in.
    bits = np.zeros((90, 16), bool)
    for i, j, _ in rows:
        bits[i, j] = True
    d, ones = (bits[:, None] != bits[None]).sum(axis=2), bits.sum(axis=1)
    want = {(i, int(ones[i]), int(ones[i]), int(x), n) for i in range(90) for x, n in zip(*np.unique(d[i][(ones == ones[i]) & (np.arange(90) != i)], return_counts=True), strict=True)}
    assert {tuple(map(int, r)) for r in st.distance_histogram(packed, 16, (0,)).collect()} == {tuple(map(int, w)) for w in want}
    cuts = packed.select(F.col("row_id").alias("r1"), F.col("ones").alias("n2"), F.lit(4).alias("cut"))
    assert {tuple(r) for r in st.near_pairs(packed, cuts).collect()} == {(i, j) for i in range(90) for j in range(i + 1, 90) if ones[i] == ones[j] and d[i, j] <= 4}


@pytest.mark.parametrize("bits", [5, 9])
def test_large_blocks_of_few_columns_are_counted_on_a_grid(spark, monkeypatch, bits):
    """All pairs of rows used to be looked at, however few columns they have."""
    from strandframe.operators import matrix as mx
    from strandframe.operators import stats as st

    rng = np.random.default_rng(6)
    rows = [(i, int(j), 1) for i in range(300) for j in np.flatnonzero(rng.random(9) < 0.5)]
    packed = mx.pack(spark.createDataFrame(rows, "row_id long, col_id int, x int"), 9).withColumn("n", F.col("row_id") % 4 + 1).cache()
    for weight in (None, "n"):
        seen = lambda: sorted((r.r1, r.n1, r.n2, *r.counts) for r in st.distance_counts(packed, 9, 1, 8, weight=weight).collect())  # noqa: B023, E731
        monkeypatch.setattr(st, "GRID_COLS", 0)
        want = seen()
        monkeypatch.setattr(st, "GRID_COLS", 9)
        monkeypatch.setattr(st, "GRID_BITS", bits)
        monkeypatch.setattr(st, "GRID_PAIR", 4)
        assert 0 < len(st._grid_blocks(packed, 9, (0, 1))) < 9
        assert seen() == want


def test_searches_take_no_longer_for_many_row_clusters(spark, monkeypatch):
    """Each look at a choice of cuts went over all row clusters, which all were on the driver."""
    from strandframe.operators import cluster as cl
    from strandframe.operators import matrix as mx
    from strandframe.plans.workflow import Workflow

    rng = np.random.default_rng(3)
    n = rng.integers(1, 50, 400)
    s = rng.integers(0, n[:, None] + 1, (400, 7))
    table = cl.Table(n.astype(float), s.astype(float))
    stats = spark.createDataFrame([(r, c, int(n[r]), int(s[r, c])) for r in range(400) for c in range(7)], "cluster int, col_id int, n long, s long")
    for sums in (table.sums(), cl.Sums.collect(stats, 5)):
        assert isinstance(sums, cl.Sums) and sums.products.shape == (7, 7)
        for labels in ([0, 0, 1, 1, 2, 0, 2], [0] * 7, list(range(7))):
            assert sums.sse(np.array(labels)) == pytest.approx(table.sse(np.array(labels)))
    # Statistics of the workflow, now from rows of bits, are those of the cells.
    cells = spark.createDataFrame([(i, j, int((i % 4 + 1) * (j + 1) % 3 == 0)) for i in range(40) for j in range(7)], "row_id long, col_id int, x int")
    flow = Workflow(spark, str(__import__("tempfile").mkdtemp(prefix="run-")), cells, cl.Tree([-1, 0, 0, 1, 1, 2, 2]))
    labels = spark.range(40).select(F.col("id").alias("row"), (F.col("id") % 2).cast("int").alias("cluster"))
    monkeypatch.setattr(flow, "clusters", lambda: labels)
    flow.cluster_sizes = lambda least: labels.select("cluster").distinct()
    want = mx.column_stats(cells.join(labels.withColumnRenamed("row", "row_id"), "row_id"))
    assert sorted(map(tuple, flow.stats().collect())) == sorted(map(tuple, want.collect()))
    monkeypatch.setattr(cl.Table, "collect", lambda stats: pytest.fail("all row clusters on the driver"))
    assert flow.fits().count() > 0


def test_kmers_get_more_tasks_as_letters_grow(spark, monkeypatch):
    """The session's number of tasks held all k-mers, however many: they were spilled and sorted."""
    from strandframe import runtime
    from strandframe.functions import sequence as sq

    seqs = spark.createDataFrame([("ACGTTGCA" * 40,), ("GATTACA" * 30,), (None,), ("AC",)], "seq string")
    asked = []
    monkeypatch.setattr(sq, "tasks_for", lambda s, rows: asked.append(rows) or runtime.tasks_for(s, rows))
    few = {r.kmer: r.n for r in sq.kmer_counts(seqs, 5).collect()}
    monkeypatch.setattr(runtime, "TASK_ROWS", 50)
    many = sq.kmer_counts(seqs, 5)
    assert asked == [316 + 206] * 2 and many.rdd.getNumPartitions() == 11
    assert {r.kmer: r.n for r in many.collect()} == few and sum(few.values()) == 316 + 206
    assert sq.kmer_counts(seqs.where("seq is null"), 5).count() == 0
