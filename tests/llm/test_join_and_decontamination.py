import random

import pytest

from strandframe.llm.components import components
from strandframe.llm.decontamination import contamination, decontaminate, split_words
from strandframe.llm.fingerprints import MinHash, edit_check, fingerprint, likeness, near_duplicates
from strandframe.llm.jaccard_join import SetTrie, jaccard_components, jaccard_links, keep_one
from strandframe.llm.shingles import shingle_sets


def brute_set(text):
    w = [x for x in (text or "").encode().lower().split()]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(docs):
    """Union of all pairs that link, by trying all pairs."""
    sets = [brute_set(t) for _, t in docs]
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    links = set()
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
                links.add((min(docs[i][0], docs[j][0]), max(docs[i][0], docs[j][0])))
    least = {}
    for i, (d, _) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), d), d)
    return {d: (len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(docs)}, links


def corpus(seed, n_base=12, copies=14):
    """Families of near copies at all distances, common passages, short and odd texts."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(3))
    passage = [word() for _ in range(30)]
    docs = []
    for _ in range(n_base):
        base = [word() for _ in range(rnd.randint(8, 70))]
        for _ in range(rnd.randint(1, copies)):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(w) // 12))):
                w[rnd.randrange(len(w))] = word()
            if rnd.random() < 0.3:
                w = w + passage
            if rnd.random() < 0.2:
                w = passage + [word() for _ in range(rnd.randint(1, 12))]
            docs.append((rnd.choice([" ", "\n", " \t "])).join(w))
    docs += ["", None, "one", "One", "one two", "a b c d", "A B  C D", "a b c d e", "É b c d e", "é b c d e", "x " * 50, "x " * 60, docs[0], docs[0].upper()]
    ids = rnd.sample(range(1000), len(docs))
    return list(zip(ids, docs, strict=True))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_equal_brute_force(spark, seed):
    docs = corpus(seed)
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, component_id int").repartition(6)
    want, links = brute_components(docs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df).collect()}
    assert got == want and len(links) > 40
    if seed == 1:
        pairs, members = jaccard_links(df)
        rep = {r.doc_id: r.rep for r in members.collect()}
        found = {(r.a, r.b) for r in pairs.collect()}
        assert found == {tuple(sorted((rep[a], rep[b]))) for a, b in links if rep[a] != rep[b]}
        kept = sorted(r.doc_id for r in keep_one(df).collect())
        assert kept == sorted(d for d, (_, c) in want.items() if d == c)


def test_a_large_group_of_near_copies_is_one_component(spark):
    rnd = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(400):
        w = list(base)
        for j in rnd.sample(range(120), 2):
            w[j] = f"e{i}_{j}"
        docs.append((i + 5, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = jaccard_components(df).select("component_id").distinct().collect()
    assert [r.component_id for r in got] == [5]


def test_join_repeated_ids_null_ids_and_empty(spark):
    t = "a b c d e f g h i j"
    df = spark.createDataFrame([(1, t), (1, t), (2, t), (None, t), (3, None), (None, None), (4, "z " * 40_000)], "doc_id long, text string")
    got = sorted(((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in jaccard_components(df).collect()))
    assert got == [(-1, 0, -1), (-1, 6, 1), (1, 6, 1), (1, 6, 1), (2, 6, 1), (3, 0, 3), (4, 1, 4)]
    assert jaccard_components(df.limit(0)).count() == 0
    # The null id with the text of 1 goes; texts without words stay.
    assert sorted(r.doc_id or -1 for r in keep_one(df).collect()) == [-1, 1, 3, 4]


def test_keep_one_judges_rows_by_their_own_texts(spark):
    t, u = "a b c d e f g h i j", "k l m n o p q r s t"
    rows = [(1, t, 77, 5), (1, u, 88, 6), (2, u, 9, 7), (None, "v w x y z v w x", 1, 8), (None, "v w x y z v w x", 2, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row int, _key int")
    got = keep_one(df)
    assert got.columns == df.columns
    kept = [tuple(r) for r in got.collect()]
    assert len(kept) == 3 and set(kept) <= set(rows) and {(r[0], r[1]) for r in kept} == {(1, t), (1, u), (None, "v w x y z v w x")}
    named = spark.createDataFrame([("b", t), ("a", t), (None, u)], "doc_id string, text string")
    assert sorted((r.doc_id or "", r.component_id or "") for r in jaccard_components(named).collect()) == [("", ""), ("a", "a"), ("b", "a")]


def test_regular_words_do_not_collide(spark):
    """Thue-Morse words and their mirror have one hash under any polynomial modulo 2**64."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    mirror = word.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, word), (2, mirror), (3, f"{word} x {word} y {word}"), (4, f"{mirror} x {mirror} y {mirror}")], "doc_id long, text string")
    assert sorted(r.component_id for r in jaccard_components(df).collect()) == [1, 2, 3, 4]
    assert len({r.fingerprint for r in fingerprint(df).collect()}) == 4


def test_flushes_ranges_and_groups_do_not_change_the_join(spark, monkeypatch):
    """Small flushes and ranges, and a shingle that most texts have."""
    from strandframe.llm import jaccard_join

    rnd = random.Random(21)
    docs = [(i, f"all of us say so {t}") for i, t in corpus(21) if t and len(t) < 4000]
    docs += [(2000 + i, f"all of us say so {rnd.random()} {rnd.random()} {rnd.random()}") for i in range(150)]
    for name, value in (("FLUSH", 700), ("RANGE", 500), ("WALK_BYTES", 3000)):
        monkeypatch.setattr(jaccard_join, name, value)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want, _ = brute_components(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df).collect()} == want


def test_trie_links_equal_set_overlaps():
    import numpy as np

    rnd = random.Random(5)
    place = list(range(60))
    rnd.shuffle(place)
    ordered = lambda xs: np.array(sorted(xs, key=place.__getitem__), np.uint64)
    base = [rnd.sample(range(60), 40) for _ in range(4)]
    sets = [ordered(rnd.sample(b := rnd.choice(base), rnd.randint(1, 40))) for _ in range(120)] + [ordered(base[0])] * 2 + [np.empty(0, np.uint64)]
    sizes = [len(s) + rnd.randint(0, 2) for s in sets]
    trie = SetTrie(sets, sizes)
    links = 0
    for probe in [*map(ordered, base), ordered(base[1][:30]), ordered([]), ordered(range(60))]:
        size = len(probe)
        both = [len(set(s.tolist()) & set(probe.tolist())) for s in sets]
        want = [i for i, (o, n) in enumerate(zip(both, sizes, strict=True)) if 100 * o >= 75 * (size + n - o)]
        assert sorted(trie.linked(probe, size)) == want
        links += len(want)
    assert links > 20


def test_connected_components(spark):
    rnd = random.Random(6)
    e = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(200, 260)] + [(rnd.randrange(300, 360), rnd.randrange(300, 360)) for _ in range(40)]
    link = {}

    def root(x):
        while link.get(x, x) != x:
            x = link[x]
        return x

    for a, b in e:
        x, y = sorted((root(a), root(b)))
        link[y] = x
    nodes = {x for p in e if p[0] != p[1] for x in p}
    got = {r.node: r.label for r in components(spark.createDataFrame(e, "a long, b long").repartition(7)).collect()}
    assert got == {x: root(x) for x in nodes}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


ITEMS = [(1, "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "short item"), (10, "ünï cödé 9 x"), (None, "nobody knows this one"), (3, None), (4, "..."), (5, "short item")]


def brute_hits(text, items, n=10):
    w = split_words((text or "").encode())
    hit, found = set(), set()
    for i, t in items:
        v = split_words((t or "").encode())
        size = min(len(v), n)
        for a in range(len(v) - size + 1 if size else 0):
            for p in range(len(w) - size + 1):
                if w[p : p + size] == v[a : a + size]:
                    hit |= set(range(p, p + size))
                    found.add("null" if i is None else str(i))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [8 << 20, 40])
def test_contamination_equals_brute_force(spark, block):
    rnd = random.Random(7)
    words = " ".join(t for _, t in ITEMS if t).split()
    some = lambda: words[(a := rnd.randrange(len(words))) : a + rnd.randint(1, 14)]
    docs = [(i, " ".join(x for _ in range(rnd.randint(0, 6)) for x in some())) for i in range(150)]
    docs += [(900, None), (901, ""), (902, ITEMS[0][1].upper()), (902, ITEMS[0][1].upper()), (903, "pad " * 50_000 + "short,item"), (904, "short\nitem" + "\x00" + "short item")]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.items, r.contaminated, r.n_items) for r in contamination(df, bench, block_bytes=block).collect())
    want = sorted((i, a, b, c, b > 0, len(c)) for i, t in docs for a, b, c in [brute_hits(t, ITEMS)])
    assert got == want
    clean = decontaminate(df, bench, block_bytes=block)
    assert clean.columns == df.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, t in docs if brute_hits(t, ITEMS)[1] == 0)
    for r in decontaminate(df, bench, mode="span", block_bytes=block).collect():
        assert brute_hits(r.text, ITEMS)[1] == 0
        if brute_hits(dict(docs).get(r.doc_id), ITEMS)[1] == 0:
            assert r.text == dict(docs)[r.doc_id]


def test_spans_are_cut_until_no_block_finds_any(spark):
    """An item that stands around another one comes together when that is cut."""
    a = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([(1, "x " + a[:13] + " p q r " + a[14:] + " y"), (2, "p q"), (3, None)], "doc_id long, text string")
    items = [(1, a), (2, "p q r")]
    for block in (8 << 20, 5):
        got = {r.doc_id: r.text for r in decontaminate(df, spark.createDataFrame(items, "item_id long, text string").coalesce(1), mode="span", block_bytes=block).collect()}
        assert got[1].split() == ["x", "y"] and got[2] == "p q" and got[3] is None


def test_decontamination_with_nothing_to_find(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(df, none).first().n_hit == 0
    assert contamination(df.limit(0), none).count() == 0


def test_shingles_equal_words():
    t = ["a b c d e f", "A  b\nc\td e f", "a b", "", " \n ", "é " * 9, "a b c", "x"]
    sets = shingle_sets([x.encode() for x in t])
    assert [len(s) for s in sets] == [len(brute_set(x)) for x in t]
    assert sets[0].tolist() == sets[1].tolist() and len({s.tobytes() for s in sets}) == 6


def test_fingerprints_estimate_jaccard_and_follow_equality(spark):
    rnd = random.Random(8)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(300)]
    errors = []
    for cut in (0, 10, 40, 100, 200):
        a, b = " ".join(base), " ".join(base[cut:] + [f"v{i}" for i in range(cut)])
        x, y = brute_set(a), brute_set(b)
        s = MinHash(256).signatures([a.encode(), b.encode()])
        errors.append(abs(likeness(s[:1], s[1:])[0] - len(x & y) / len(x | y)))
    assert max(errors) < 0.12
    df = spark.createDataFrame([(1, "Same text here"), (2, "Same text here"), (3, None), (4, ""), (4, "x")], "doc_id long, text string")
    f = sorted((r.doc_id, r.fingerprint) for r in fingerprint(df).collect())
    assert f[0][1] == f[1][1] and f[2][1] in (f[3][1], f[4][1]) and f[3][1] != f[4][1]


@pytest.mark.parametrize("n", [1, 2, 57])
def test_edit_check_equals_brute_force(spark, n):
    import hashlib

    rnd = random.Random(9)
    docs = [(rnd.randrange(-50, 10**6), "".join(rnd.choice("ab é🙂\n") for _ in range(rnd.randint(0, 300)))) for _ in range(n)]
    df = spark.createDataFrame([(i, t or None, 1) for i, t in docs], "doc_id long, text string, n_chars int").repartition(3)
    got = {r.doc_id: r for r in edit_check(df).collect()}
    order = sorted(docs)
    assert len(got) == n
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % n][1]
        h = len(t) // 2
        edited = t[: len(t) - h] + after[:h]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        s = MinHash().signatures([t.encode(), edited.encode(), after.encode()])
        assert r.near_edited == likeness(s[:1], s[1:2])[0] and r.near_next == likeness(s[:1], s[2:])[0]


def test_edit_check_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "doc_id long, text string")
    assert edit_check(df).count() == 3
    assert edit_check(df.limit(0)).count() == 0


def test_near_duplicates_find_close_pairs(spark):
    docs = corpus(11)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {(r.a, r.b) for r in near_duplicates(df).collect()}
    _, links = brute_components(docs)
    assert found and found <= links


@pytest.mark.parametrize("ranges", [1, 2, 3, 51, 211, 65536, 70_001])
def test_ranges_of_hashes_lie_in_order(ranges):
    import numpy as np

    from strandframe.llm.jaccard_join import _cells, _values, range_of

    h = np.random.default_rng(ranges).integers(0, 2**64, 2000, dtype=np.uint64)
    h[:3] = [0, 2**64 - 1, 2**63]
    assert [int(x) * ranges >> 64 for x in h] == range_of(h, ranges).tolist()
    cuts = np.array([0, 5, 5, 2000])
    assert np.concatenate([_values(c, np.uint64) for c in _cells(h, cuts)]).tolist() == h.tolist()
