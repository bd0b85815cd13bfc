"""HyperMinHash sketches against true similarities, and whole results against brute force."""

import random

import numpy as np
import pytest

from strandframe.llm import hyperminhash
from strandframe.llm.hyperminhash import BANDS, MANTISSA, REGISTERS, band_keys, collisions, estimates, near_duplicates_of, sketches

SCHEMA = "doc_id long, text string, n int, key string, label string, cid long"


def shingles(text, k=2):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").translate({c: 32 for c in range(9, 14)}).split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + k]) for i in range(max(len(words) - k + 1, min(len(words), 1)))}


def brute(docs):
    """{(doc_id, n_shingles)}, and the least id reachable of each id that is not null."""
    sets = [(i, shingles(t)) for i, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (i, s) in enumerate(sets):
        for y, (j, t) in enumerate(sets[:x]):
            if (i is not None and i == j) or (s and t and 100 * len(s & t) >= 80 * len(s | t)):
                parent[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(sets):
        if i is not None:
            least[find(x)] = min(least.get(find(x), i), i)
    return sorted(((i, len(s), least.get(find(x)), least.get(find(x)) == i) for x, (i, s) in enumerate(sets)), key=repr)


def result(spark, docs):
    df = near_duplicates_of(spark.createDataFrame([(i, t, 1, "k", "l", 2) for i, t in docs], SCHEMA))
    assert df.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def pair(rnd, n, m, both):
    x = rnd.integers(0, 2**64, n + m - both, dtype=np.uint64)
    return np.sort(x[:n]), np.sort(x[n - both :])


@pytest.mark.parametrize("n", [1, 3, 20, 47, 50, 300, 5000])
def test_registers_agree_as_often_as_sets_are_alike(n):
    rnd = np.random.default_rng(n)
    both = n - n // 4
    pairs = [pair(rnd, n, n, both) for _ in range(60)]
    a, b = sketches([p[0] for p in pairs]), sketches([p[1] for p in pairs])
    assert (a > 0).all() and a.shape == (60, REGISTERS)
    size = np.full(60, n)
    got, true = estimates(a, size, b, size), both / (2 * n - both)
    assert abs(got.mean() - true) < 0.04


def test_collisions_are_expected_at_the_rate_worked_out():
    rnd = np.random.default_rng(1)
    # Some 100 chance collisions of each kind of pair, so that their number is known to a tenth.
    for n, m in ((400, 400), (4000, 4000), (400, 8000), (30, 30)):
        pairs = [pair(rnd, n, m, 0) for _ in range(4000)]
        a, b = sketches([p[0] for p in pairs]), sketches([p[1] for p in pairs])
        want = float(collisions(np.asarray([n]), np.asarray([m]))[0])
        assert 0 < want < 4 / (1 << MANTISSA) and (a == b).mean() == pytest.approx(want, rel=0.35)


def test_sketches_do_not_depend_on_their_batch():
    rnd = np.random.default_rng(2)
    sets = [np.sort(rnd.integers(0, 2**64, n, dtype=np.uint64)) for n in (1, 2, 40, 49, 100, 400, 3000, 30000)]
    together = sketches(sets)
    assert all((sketches([s])[0] == t).all() for s, t in zip(sets, together, strict=True))
    assert len(np.unique(band_keys(together))) == len(sets) * BANDS  # no chance meetings, places told apart


def test_pairs_at_the_threshold_share_a_band():
    rnd = np.random.default_rng(3)
    for n in (8, 40, 400):
        both = -(-80 * 2 * n // 180)  # the least overlap of two sets of n that links them
        pairs = [pair(rnd, n, n, both) for _ in range(300)]
        a, b = band_keys(sketches([p[0] for p in pairs])), band_keys(sketches([p[1] for p in pairs]))
        assert (a == b).any(axis=1).all()


def family(seed=5, n=90, words=60):
    """Texts that drift away from the first, unlike ones with a common passage, tiny and odd ones."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    base, docs = [word() for _ in range(words)], []
    for i in range(n):
        base = list(base)
        if i % 2 == 0:
            base[rnd.randrange(words)] = word()
        docs.append((i + 10, " ".join([*base, word()])))
    passage = " ".join(word() for _ in range(40))
    docs += [(500 + i, passage + " " + " ".join(word() for _ in range(rnd.randint(8, 30)))) for i in range(60)]
    docs += [(700 + i, " ".join(rnd.choice(["x", "y", "z"]) for _ in range(rnd.randint(1, 12)))) for i in range(60)]
    docs += [(1, "A b  C\td\n e"), (2, "a B c D E"), (3, "One"), (4, "one"), (5, "two"), (6, ""), (7, None), (8, " \t"), (9, "é É"), (9, "é É")]
    return docs


def test_equals_brute_force(spark):
    docs = family()
    got = result(spark, docs)
    assert got == brute(docs) and len({r[2] for r in got}) < len(docs) - 80


@pytest.mark.parametrize("rounds", [0, 2])
def test_equals_brute_force_when_blocks_do_the_work(spark, monkeypatch, rounds):
    # Whole groups of many blocks are compared within tasks, a leader's classes go to many.
    for name, value in (("STAR_ROUNDS", rounds), ("BLOCK", 7), ("CHUNK", 3)):
        monkeypatch.setattr(hyperminhash, name, value)
    docs = family(8, 60)
    assert result(spark, docs) == brute(docs)


def test_hot_copies_and_repeated_or_null_ids(spark):
    text = "many copies of this one text are here"
    docs = [(i, text) for i in range(3000)] + [(5000, text + " too")] + [(6000, "left side of it"), (6000, "quite another thing"), (None, "left side of it"), (None, "alone here now"), (None, None)]
    got = result(spark, docs)
    assert sum(r[3] for r in got if r[0] is not None) == 3  # 0 and both rows of 6000
    assert (None, 3, 6000, False) in got and (None, 2, None, True) in got and (None, 0, None, True) in got
    assert (5000, 8, 0, False) in got


def test_empty_table_and_string_ids(spark):
    assert result(spark, []) == []
    df = near_duplicates_of(spark.createDataFrame([("b", "x y z"), ("a", "x y z"), ("c", None)], "doc_id string, text string"))
    assert sorted(tuple(r) for r in df.collect()) == [("a", 2, "a", True), ("b", 2, "a", False), ("c", 0, "c", True)]


def test_a_very_long_text(spark):
    rnd = random.Random(9)
    words = [str(rnd.random()) for _ in range(120_000)]
    docs = [(1, " ".join(words)), (2, " ".join(words[:110_000])), (3, " ".join(words[:90_000]))]
    got = result(spark, docs)
    assert [r[2] for r in got] == [1, 1, 1]  # 2 links 1 (0.92) and 3 (0.82)
