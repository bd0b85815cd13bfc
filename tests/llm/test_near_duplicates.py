"""All links that a band holds, against brute force over all pairs."""

import random

from strandframe.llm import fingerprints
from strandframe.llm.fingerprints import MinHash, near_duplicates
from test_join_and_decontamination import brute_components


def family():
    """Texts that drift from the first, with a least id that shares a passage only."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(120)]
    docs = [(0, " ".join(base[:60] + [word() for _ in range(60)]))]
    for i in range(1, 60):
        base = list(base)
        if i % 3 == 0:
            base[rnd.randrange(120)] = word()
        docs.append((i, " ".join([*base, word()])))
    return docs


def check(spark):
    docs = family()
    got = [(r.a, r.b) for r in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()]
    _, links = brute_components(docs)
    bands = MinHash().signatures([t.encode() for _, t in docs]).reshape(len(docs), 16, 4)
    held = {(a, b) for a, b in links if (bands[a] == bands[b]).all(axis=1).any()}
    assert len(got) == len(set(got)) and set(got) == held
    assert len(held) >= 0.99 * len(links) and len(links) > 500


def test_every_link_of_a_band_is_listed(spark):
    check(spark)


def test_every_link_is_listed_once_when_a_group_has_many_parts(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BLOCK", 7, raising=False)
    check(spark)
