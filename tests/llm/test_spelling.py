"""Spelling variants against brute force over all words and all pairs."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from strandframe.llm.queries import oracle_sql
from strandframe.llm.spelling import counted_words, near_words, spelling_variants, trie_pairs


def one_apart(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    if len(u) > len(v):
        u, v = v, u
    return len(v) - len(u) == 1 and any(u == v[:i] + v[i + 1 :] for i in range(len(v)))


def brute_words(docs, least=5):
    found = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= least}


def brute_variants(words):
    out = {}
    for w, n in words.items():
        near = sorted((-m, v) for v, m in words.items() if one_apart(w, v))
        form, m = (near[0][1], -near[0][0]) if near and -near[0][0] >= 5 * n else (None, None)
        out[w] = [form, n, len(near), m]

    def last(w):
        return w if out[w][0] is None else last(out[w][0])

    return {(w, form, last(w), n, k, m) for w, (form, n, k, m) in out.items()}


def variants(df):
    return [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]


def some_words(seed, n, letters="ab", least=6, most=9):
    rnd = random.Random(seed)
    return sorted({"".join(rnd.choice(letters) for _ in range(rnd.randint(least, most))) for _ in range(n)})


def test_trie_pairs_are_all_pairs_at_distance_one():
    bodies = ["", *some_words(1, 120, "abé", 1, 5)]
    want = {frozenset((u, v)) for u in bodies for v in bodies if u != v and one_apart(u, v)}
    got = [frozenset((bodies[i], bodies[j])) for i, j in trie_pairs(bodies)]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 150


@pytest.mark.parametrize("limit", [1, 3, 20, 20_000])
def test_near_words_in_blocks_of_any_size(spark, limit):
    # All words of two letters begin and end alike, so blocks are hot and divided to the last code point.
    words = some_words(2, 250)
    want = {(u, v) for u in words for v in words if u < v and one_apart(u, v)}
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    got = [(r.a, r.b) for r in near_words(df, limit).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 200


def test_forms_and_roots_follow_chains_and_break_ties(spark):
    words = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "zzzzzz": 5, "zzzzzy": 25, "zzzzzx": 25, "zzzzzé": 25, "mmmmmm": 5, "mmmmmn": 24, "oooooooo": 7}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = variants(spelling_variants(df))
    assert set(got) == brute_variants(words) and len(got) == len(words)
    by = {r[0]: r for r in got}
    assert by["aaaaaa"][2] == "aaabbb" and by["zzzzzz"][1] == "zzzzzx" and by["mmmmmm"][1] is None and by["oooooooo"][4] == 0


def planted(seed=3):
    rnd = random.Random(seed)
    base = ["Letter", "LETTERS", "çanneau", "anneaux", "Éclairé", "wordwordword", "short", "ÿÿÿÿÿÿ", "interim"]
    docs = []
    for i in range(400):
        text = " ".join(rnd.choice(base) + rnd.choice(["", ".", "1", "-x", "×y"]) for _ in range(rnd.randint(0, 30)))
        docs.append((i, text))
    return [*docs, (None, "Letter letter nothing"), (7, None), (8, ""), (9, "lettre " * 6000), (9, "lettre"), (9, "lettre")]


def test_counts_and_deletions_equal_brute_force(spark):
    docs = planted()
    df = spark.createDataFrame([(d, t, "x", 0, 0.0) for d, t in docs], "doc_id long, text string, run string, n int, h double")
    words = {r.word: r.n for r in counted_words(df).collect()}
    assert words == brute_words(docs) and any(w in words for w in ("letter", "lettre"))
    some = {r.word: r.n for r in counted_words(df, least_count=1).collect()}
    assert some == brute_words(docs, 1) and len(some) > len(words)  # words with a deleted letter


def test_the_whole_and_its_sql_equal_brute_force(spark, tmp_path):
    docs = [(i, t) for i, t in planted(4) if i is not None]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = variants(spelling_variants(counted_words(df)))
    want = brute_variants(brute_words(docs))
    assert set(got) == want and len(got) == len(want)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    cur = con.execute(oracle_sql()["op11_spelling_variants"])
    names = [d[0] for d in cur.description]
    assert {tuple(dict(zip(names, r, strict=True))[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in cur.fetchall()} == want


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert variants(spelling_variants(counted_words(df))) == []
    assert variants(spelling_variants(counted_words(spark.createDataFrame([(1, None), (None, None)], df.schema)))) == []
