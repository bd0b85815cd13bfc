import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strandframe.llm.packing import encoder, pack_sequences, ranks_agree
from strandframe.llm.token_counts import MergeTransducer, TokenCounter, count_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
BITS = ["a", "b", "s", "re", "'", "'s", "'ll", "'re'", " ", "  ", "\n", "\t", "1", "22", "!", "é", "日本", "٣", " ", "　", "<|endoftext|>", "the", " ing", "aaaaaaaa", "🙂", "́", "Ⅷ", "½", "\x00", "_", "-", "\r\n", "\u0085", "​", "ß", "﻿"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts(n, seed, most=25):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(BITS) for _ in range(rnd.randint(0, most))) for _ in range(n)]


def test_counts_equal_the_library(library):
    own = TokenCounter(PATH)
    t = texts(8000, 1) + ["a" * 5000, " " * 3000, "ab" * 4000 + "!", "é" * 999]
    assert own.count(t).tolist() == [len(e.ids) for e in library.encode_batch(t, add_special_tokens=False)]


def test_the_table_may_start_anew_at_any_slice(library, monkeypatch):
    import strandframe.llm.token_counts as tc

    monkeypatch.setattr(tc, "MAX_STATES", 50)
    own = TokenCounter(PATH)
    t = texts(400, 2)
    got = [int(x) for i in range(0, 400, 40) for x in own.count(t[i : i + 40])]
    assert got == [len(e.ids) for e in library.encode_batch(t, add_special_tokens=False)]


def test_merges_of_small_vocabularies_equal_plain_merging():
    from strandframe.llm.token_counts import byte_letters

    rnd = random.Random(3)
    letters = list(byte_letters())
    for _ in range(20):
        vocab, merges = {c: i for i, c in enumerate(letters)}, []
        pool = ["a", "b", "c"]
        while len(merges) < 14:
            x, y = rnd.choice(pool), rnd.choice(pool)
            if x + y not in vocab:
                vocab[x + y] = len(vocab)
                merges.append((x, y))
                pool.append(x + y)
        rank = {m: i for i, m in enumerate(merges)}
        t = MergeTransducer(vocab, merges)
        for _ in range(200):
            word = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 14)))
            parts = list(word)
            while True:
                best = min(((rank[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in rank), default=None)
                if best is None:
                    break
                i = best[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            raw = np.frombuffer(word.encode(), np.uint8).astype(np.int32)
            inside = np.ones(len(raw), np.int32)
            inside[0] = 0
            assert t.run(raw, inside, np.array([0]))[0] == len(parts), (merges, word)


def test_count_query_rows(spark, library):
    rows = [(1, None), (2, ""), (3, "x " * 30_000), (3, "x " * 30_000), (None, "a b"), (5, "<|endoftext|>a")]
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, n_tokens int")
    got = sorted(((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(df, PATH).collect()))
    want = sorted((i or 0, len(t or ""), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in rows)
    assert got == want
    assert count_tokens(df.limit(0), PATH).count() == 0


def test_encoder_equals_the_library(library):
    t = texts(6000, 4) + ["word " * 100, "a" * 3000]
    want = [np.asarray(e.ids, "<u4").tobytes() for e in library.encode_batch(t, add_special_tokens=False)]
    assert ranks_agree(PATH)
    assert encoder(PATH, True).fast is not None and encoder(PATH, False).fast is None
    assert encoder(PATH, True).encode(t) == encoder(PATH, False).encode(t) == want


def test_ranks_that_listed_merges_do_not_follow_are_refused(tmp_path):
    """abc is listed as a + bc only, but ab comes first: other neighbours of those bytes would merge."""
    import json

    from strandframe.llm.token_counts import byte_letters

    with open(PATH, encoding="utf-8") as f:
        d = json.load(f)
    vocab = {c: i for i, c in enumerate(byte_letters())}
    for t in ("ab", "bc", "abc"):
        vocab[t] = len(vocab)
    d["model"]["vocab"], d["added_tokens"] = vocab, []
    for merges, agree in (([["a", "b"], ["b", "c"], ["a", "bc"]], False), ([["a", "b"], ["b", "c"], ["ab", "c"]], True)):
        d["model"]["merges"] = merges
        path = tmp_path / f"{agree}.json"
        path.write_text(json.dumps(d))
        assert ranks_agree(str(path)) is agree


def test_long_pieces_are_cut_into_chunks(library, monkeypatch):
    """Runs without a piece start within reach: chunk maps are composed, also where a guess was wrong
    and where the table starts anew while chunks advance."""
    import strandframe.llm.token_counts as tc

    rnd = random.Random(8)
    t = ["a" * 100_000, "x" + "ab" * 30_000, " " * 5000 + "b", "!?" * 9000, "日本語" * 3000, "".join(rnd.choice("abcdefghij") for _ in range(20_000)), "", "short one"]
    want = [len(e.ids) for e in library.encode_batch(t, add_special_tokens=False)]
    own = TokenCounter(PATH)
    assert own.count(t).tolist() == want
    for lead, states in ((0, 1 << 16), (3, 1 << 16), (64, 3000)):
        monkeypatch.setattr(tc, "LEAD", lead)
        monkeypatch.setattr(tc, "MAX_STATES", states)
        again = TokenCounter(PATH)
        assert again.count(t).tolist() == want
        assert len(again.merger.keys) < 2 * states


def test_a_gain_that_does_not_fit_is_refused():
    from strandframe.llm.token_counts import byte_letters

    vocab, merges = {c: i for i, c in enumerate(byte_letters())}, []
    word = "a"
    for c in "bcdefghijklm":  # suffixes only, so that ten tokens become one at the last letter
        vocab[c + "z"] = len(vocab)
        merges.append((c, "z"))
    t = MergeTransducer(vocab, merges)
    t.keys[0] = ((0, -1, 12),)
    with pytest.raises(ValueError, match="gains"):
        t.step(0, ord(word))


def test_pieces_tile_documents_and_windows(spark, library):
    rnd = random.Random(5)
    rows = [(i, t) for i, t in enumerate(texts(60, 6, 200))] + [(100, None), (101, ""), (102, "long " * 5000), (7, "again"), (None, "no id")]
    rnd.shuffle(rows)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, part int").repartition(5)
    got = pack_sequences(df, PATH, with_ids=True).collect()
    total = sum(r.length for r in got)
    by_seq = {}
    for r in got:
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert sorted(by_seq) == list(range(-(-total // 1024)))
    for s, pieces in by_seq.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at == 1024 or s == max(by_seq)
    docs = {}
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        docs.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    want = {}
    for i, t in rows:
        ids = np.asarray([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.setdefault((i, len(ids)), []).append(ids.tobytes())
    assert set(docs) == set(want)
    for key, pieces in docs.items():
        if len(want[key]) == 1:
            assert b"".join(p.ids for p in sorted(pieces, key=lambda p: p.start)) == want[key][0]
            assert [p.start for p in sorted(pieces, key=lambda p: p.start)] == np.cumsum([0, *[p.length for p in sorted(pieces, key=lambda p: p.start)][:-1]]).tolist()
    assert pack_sequences(df.limit(0), PATH).count() == 0
