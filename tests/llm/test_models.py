import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.llm import queries as Q
from strandframe.llm.language_id import ByteConvNet, fold, has_letter, identify, train
from strandframe.llm.quality import FEATURES, Discriminant, fit, scored, scored_texts, statistics, with_features

SF = "/root/testdata/sf0.01"


def held(i, n, r):
    return zlib.crc32(str(i).encode()) % n == r


def test_language_accuracy_on_held_out_documents(spark):
    got = {r.doc_id: r for r in Q.op6_language_id(spark, SF).collect()}
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    assert set(got) == set(truth)
    assert all(got[i].held_out == held(i, 5, 0) and 0 <= got[i].score <= 1 for i in truth)
    out = [i for i in truth if got[i].held_out]
    assert np.mean([got[i].lang_pred == truth[i] for i in out]) > 0.97


def test_language_edges(spark):
    rows = [(i, "the and of with " * 20, "en", "x") for i in range(40)] + [(100 + i, "der und die nicht " * 20, "de", "x") for i in range(40)]
    net = train(spark.createDataFrame(rows, "doc_id long, text string, lang string, _lang_pred string").drop("_lang_pred"))
    assert net.langs == ["de", "en"]
    odd = [(1, None), (2, ""), (3, "123 !!"), (4, "½ Ⅷ ²"), (5, "日本"), (6, "the with " * 60_000), (6, "the with"), (None, "und die")]
    df = spark.createDataFrame([(i, t, 5) for i, t in odd], "doc_id long, text string, score int")
    got = identify(df, net).collect()
    assert len(got) == len(odd)
    by = {(r.doc_id, r.text): (r._lang_pred, r._lang_score) for r in got}
    assert [by[o][0] for o in odd[:4]] == ["und"] * 4 and all(by[o][1] == 0 for o in odd[:4])
    assert by[odd[4]][0] in net.langs and by[odd[5]][0] == "en" and by[odd[7]][0] == "de"
    assert identify(df.limit(0), net).count() == 0
    none = train(spark.createDataFrame([(1, "a", None)], "doc_id long, text string, lang string"))
    assert identify(df, none).where("_lang_pred <> 'und' or _lang_score <> 0").count() == 0


def test_letters_are_unicode_letters():
    assert [has_letter(t) for t in ("a", "é", "日", "٣", "Ⅷ", "_", "½x", "")] == [True, True, True, False, False, False, True, False]
    assert fold("Ab1!É\n\n x") == "ab é x".encode()


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    net = ByteConvNet.start(["a", "b", "c"], 1)
    for k in ("embed", "conv", "bias", "out", "out_bias"):
        setattr(net, k, getattr(net, k).astype(np.float64))
    x, y = rng.integers(97, 122, (4, 256)).astype(np.uint8), np.array([0, 1, 2, 1])

    def loss():
        z = net.logits(x)
        z = z - z.max(axis=1, keepdims=True)
        return -(z[np.arange(4), y] - np.log(np.exp(z).sum(axis=1))).mean()

    grads = net._grads(x, y)
    mask = net.mask()
    for name, at in (("out", (3, 1)), ("out_bias", (2,)), ("bias", (5,)), ("conv", (2, 9)), ("embed", (100, 3))):
        w = getattr(net, name)
        if name == "conv" and not mask[at]:
            continue
        old, eps = w[at], 1e-5
        w[at] = old + eps
        up = loss()
        w[at] = old - eps
        down = loss()
        w[at] = old
        assert grads[name][at] == pytest.approx((up - down) / (2 * eps), abs=1e-5)


def test_quality_accuracy_on_held_out_documents(spark):
    got = {r.doc_id: r for r in Q.op8_quality_classifier(spark, SF).collect()}
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(got[i].held_out == held(i, 3, 1) and got[i].predicted == int(got[i].score >= 0.5) and 0 <= got[i].score <= 1 for i in got)
    assert np.mean([got[i].predicted == q for i, q in truth.items() if got[i].held_out]) > 0.97


def density_shares(x, part):
    """The share of class 1 in two normal densities, written out: no factor, no product sums."""
    n = [len(p) for p in part]
    mean = [p.mean(axis=0) for p in part]
    own = [np.cov(p.T, bias=True) for p in part]
    pooled = (n[0] * own[0] + n[1] * own[1]) / sum(n)
    out = []
    for v in x:
        density = []
        for k in (0, 1):
            c = 0.95 * (0.9 * own[k] + 0.1 * pooled) + 0.05 * np.diag(np.diag(pooled)) + (1e-6 + 1e-3 * np.diag(pooled).max()) * np.eye(len(v))
            gap = v - mean[k]
            density.append(np.log(n[k] / sum(n)) - 0.5 * (np.linalg.slogdet(c)[1] + gap @ np.linalg.inv(c) @ gap))
        out.append(1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700))))
    return np.array(out)


def test_a_tie_of_classes_is_half():
    model = Discriminant.from_moments([5, 5], [np.zeros(3), np.zeros(3)], [np.eye(3), np.eye(3)])
    assert model.score(np.array([[1.0, 2.0, 3.0]])).tolist() == [0.5]


def test_prediction_equals_plain_loops():
    """Windows, pooling, softmax and the weighted mean by loops over letters and filters."""
    net = ByteConvNet.start(["a", "b", "c"], 3)
    rng = np.random.default_rng(4)
    net.bias, net.out_bias = rng.normal(0, 0.2, net.bias.shape).astype(np.float32), rng.normal(0, 0.2, 3).astype(np.float32)
    texts = ["The quick 1 brown fox!", "ab " * 150 + "Zürich", "x"]
    label, score = net.predict(texts)
    for text, got, s in zip(texts, label, score, strict=True):
        raw = b" ".join("".join(c if c.isalpha() or ord(c) > 127 else " " for c in text.lower()).encode().split())
        total, weight = np.zeros(3), 0
        for a in range(0, len(raw), 256):
            part = raw[a : a + 256]
            e = [net.embed[c] for c in part.ljust(256, b"\0") + b"\0\0\0"]
            top = []
            for f in range(net.conv.shape[1]):
                width = (2, 3, 4)[f // 8]
                reply = [sum(float(e[i + j] @ net.conv[8 * j : 8 * j + 8, f]) for j in range(width)) for i in range(256)]
                top.append(max(0.0, max(reply) + float(net.bias[f])))
            total += len(part) * (np.array(top) @ net.out + net.out_bias)
            weight += len(part)
        p = np.exp(total / weight - (total / weight).max())
        p /= p.sum()
        assert got == net.langs[int(p.argmax())] and s == pytest.approx(p.max(), abs=1e-4)
    net.out[:], net.out_bias[:] = 0, 0
    assert net.predict(["tie"])[0] == ["a"] and net.predict(["tie"])[1][0] == pytest.approx(1 / 3)


def test_moments_in_spark_equal_numpy(spark):
    rnd = random.Random(2)
    docs = [(i, " ".join(rnd.choice(["ab", "cd!", "$$$", "XY", "q\n"]) for _ in range(rnd.randint(0, 40)))) for i in range(60)]
    labels = [(i, i % 2) for i in range(0, 60, 2)] + [(i, i % 2) for i in range(1, 60, 3)] + [(4, 0), (7, None), (None, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    rows = with_features(df)
    model = fit(rows, lab)
    y = [(i, q) for i, q in labels if i is not None and q is not None]
    x = {i: statistics(t.encode()) for i, t in docs}
    part = [np.array([x[i] for i, q in y if q == k]) for k in (0, 1)]
    allx = np.array([x[i] for i, _ in docs])
    want = density_shares(allx, part)
    assert np.allclose(model.score(allx), want, atol=1e-9)
    a = {r.doc_id: r._score for r in scored(rows.select("doc_id", "_features"), model).collect()}
    b = {r.doc_id: r._score for r in scored_texts(df, model).collect()}
    assert a == b and np.allclose([a[i] for i, _ in docs], want, atol=1e-9)


def test_quality_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x"), (3, "x"), (None, "é" * 100_000), (5, "a\n" * 500)], "doc_id long, text string")
    rows = with_features(df)
    assert rows.where(F.size("_features") == len(FEATURES)).count() == 6
    none = fit(rows, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r._score for r in scored(rows, none).collect()} == {0.5}
    one = fit(rows, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert {r._score for r in scored(rows, one).collect()} == {1.0}
    assert scored_texts(df.limit(0), none).count() == 0
