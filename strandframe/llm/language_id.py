"""Language ID: a small byte convolutional network, trained and applied in numpy.

A window of WINDOW bytes is embedded, convolved by filters of several widths,
rectified, max-pooled over its positions and scored by a softmax over languages.
A document is all of its windows: their logits are averaged, weighted by the bytes
they hold, so every byte of a text counts and none is cut away. Text is lower-cased
and digits and ASCII marks are read as spaces first, as they belong to no language.

Training uses at most SAMPLE labelled documents with a letter (those of least
xxhash64 of the id, so the choice is stable) and of each the first, the last and up
to TRAIN_WINDOWS - 2 windows between. It runs on the driver: the sample is bounded.
The weights (about 20 KB) are broadcast.

Null texts and texts without a letter (Unicode) are ``und`` with score 0, as is
everything when nothing could be learned. Very long texts are scored window by
window in batches of BATCH windows. Repeated rows are scored each for itself; an
empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandframe.llm.token_counts import slices
from strandframe.runtime import ship

WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 8, 8
SAMPLE, TRAIN_WINDOWS, EPOCHS, BATCH = 1500, 4, 6, 256
UNDETERMINED = "und"

_FOLD = bytearray(range(256))
for _c in range(128):
    _FOLD[_c] = _c if 97 <= _c <= 122 else _c + 32 if 65 <= _c <= 90 else 32
_FOLD[0] = 0
_FOLD = bytes(_FOLD)
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    m = _LETTER.search(text)
    while m and not m.group().isalpha():
        m = _LETTER.search(text, m.end())
    return m is not None


def windows(text: bytes) -> np.ndarray:
    """The windows of a folded text, one row each; the last is filled up with zeros."""
    n = -(-len(text) // WINDOW)
    return np.frombuffer(text.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


def fold(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_FOLD).split())


@dataclass
class ByteConvNet:
    """Weights and passes; all widths share one matrix of the greatest width."""

    langs: list[str]
    embed: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def start(cls, langs: list[str], seed: int) -> ByteConvNet:
        rng = np.random.default_rng(seed)
        widest, n = max(WIDTHS), FILTERS * len(WIDTHS)
        conv = rng.normal(0, 0.3, (widest * EMBED, n)).astype(np.float32)
        conv *= cls.mask()
        embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        embed[0] = 0
        return cls(langs, embed, conv, np.zeros(n, np.float32), rng.normal(0, 0.3, (n, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32))

    @staticmethod
    def mask() -> np.ndarray:
        """Which rows of the matrix a filter of each width may use."""
        m = np.zeros((max(WIDTHS) * EMBED, FILTERS * len(WIDTHS)), np.float32)
        for i, w in enumerate(WIDTHS):
            m[: w * EMBED, i * FILTERS : (i + 1) * FILTERS] = 1
        return m

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greatest response of each filter in each window, where, and the unrolled input."""
        widest = max(WIDTHS)
        e = self.embed[np.pad(x, ((0, 0), (0, widest - 1)))]
        n = x.shape[0]
        s = e.strides
        rolled = np.lib.stride_tricks.as_strided(e, (n, WINDOW, widest * EMBED), (s[0], s[1], s[2]))
        flat = np.ascontiguousarray(rolled).reshape(n * WINDOW, widest * EMBED)
        y = (flat @ self.conv).reshape(n, WINDOW, -1)
        return y.max(axis=1), y, flat

    def logits(self, x: np.ndarray) -> np.ndarray:
        top, _, _ = self.pooled(x)
        return np.maximum(top + self.bias, 0) @ self.out + self.out_bias

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int, epochs: int = EPOCHS, rate: float = 0.01, batch: int = 64) -> None:
        """Adam on the cross-entropy, with weight decay."""
        rng = np.random.default_rng(seed)
        names = ("embed", "conv", "bias", "out", "out_bias")
        first = {k: np.zeros_like(getattr(self, k)) for k in names}
        second = {k: np.zeros_like(getattr(self, k)) for k in names}
        mask, step, total = self.mask(), 0, max(1, epochs * -(-len(x) // batch))
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(x), batch):
                at = order[a : a + batch]
                grads = self._grads(x[at], y[at])
                grads["conv"] *= mask
                grads["embed"][0] = 0
                step += 1
                lr = rate * (1 - step / (total + 1))
                for k in names:
                    g, w = grads[k], getattr(self, k)
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    w -= lr * (first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-7) + 1e-3 * w)

    def _grads(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        n, widest = len(x), max(WIDTHS)
        top, response, flat = self.pooled(x)
        where = response.argmax(axis=1)
        pre = top + self.bias
        act = np.maximum(pre, 0)
        z = act @ self.out + self.out_bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n), y] -= 1
        p /= n
        d = (p @ self.out.T) * (pre > 0)
        rows = np.arange(n)[:, None] * WINDOW + where
        seen = flat[rows]  # window, filter, unrolled input
        g_conv = np.einsum("wf,wfi->if", d, seen)
        back = (d[:, :, None] * self.conv.T[None]).reshape(n, -1, widest, EMBED)
        padded = np.pad(x, ((0, 0), (0, widest - 1)))
        letters = padded[np.arange(n)[:, None, None], where[:, :, None] + np.arange(widest)]
        g_embed = np.zeros_like(self.embed)
        np.add.at(g_embed, letters.ravel(), back.reshape(-1, EMBED))
        return {"embed": g_embed, "conv": g_conv, "bias": d.sum(axis=0), "out": act.T @ p, "out_bias": p.sum(axis=0)}

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and probability of each text."""
        label, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        rows = [i for i, t in enumerate(texts) if t and has_letter(t)]
        folded = [fold(texts[i]) for i in rows]
        kept = [(i, f) for i, f in zip(rows, folded, strict=True) if f]
        parts = [windows(f) for _, f in kept]
        if parts and self.langs:
            x = np.concatenate(parts)
            z = np.concatenate([self.logits(x[a : a + BATCH]) for a in range(0, len(x), BATCH)])
            held = (x != 0).sum(axis=1)[:, None]
            first = np.cumsum([0, *(len(p) for p in parts[:-1])])
            mean = np.add.reduceat(z * held, first) / np.add.reduceat(held, first)
            p = np.exp(mean - mean.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            best = p.argmax(axis=1)
            for (i, _), k, v in zip(kept, best, p.max(axis=1), strict=True):
                label[i], score[i] = self.langs[k], v
        for i in rows:  # letters that folding takes away: the least certain answer there is
            if label[i] == UNDETERMINED and self.langs:
                label[i], score[i] = self.langs[0], 1 / len(self.langs)
        return label, score


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, seed: int = 11) -> ByteConvNet:
    """Fit on at most ``sample`` rows of ``labelled`` with a text and a language."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    # Ids and languages alone are ordered first; texts are fetched for the chosen ids.
    chosen = rows.select(F.col(id_col).alias("_i"), F.xxhash64(F.col(id_col)).alias("_h")).orderBy("_h", "_i").limit(sample).select("_i").distinct()
    picked = rows.join(F.broadcast(chosen), rows[id_col] == chosen["_i"], "left_semi").select(F.col(lang_col).cast("string").alias("lang"), _cut(F.col(text_col)).alias("parts"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("_h")).orderBy("_h").limit(sample).collect()
    langs = sorted({r.lang for r in picked})
    x, y = [], []
    for r in picked:
        for part in r.parts:
            if has_letter(part):
                w = windows(fold(part))[:1]
                x.append(w)
                y += [langs.index(r.lang)] * len(w)
    net = ByteConvNet.start(langs if x else [], seed)
    if x and len(langs) > 1:
        net.fit(np.concatenate(x), np.asarray(y), seed)
    return net


def _cut(text: Column) -> Column:
    """Pieces of a training text, spread over its length, long enough to fill a window."""
    n, size = F.length(text), 2 * WINDOW
    starts = F.transform(F.sequence(F.lit(0), F.lit(TRAIN_WINDOWS - 1)), lambda i: F.floor(i * F.greatest(n - size, F.lit(0)) / (TRAIN_WINDOWS - 1)) + 1)
    return F.transform(F.array_distinct(starts), lambda s: F.substring(text, s.cast("int"), F.lit(size)))


def identify(docs: DataFrame, net: ByteConvNet, text_col: str = "text", pred: str = "_lang_pred", score_col: str = "_lang_score") -> DataFrame:
    """``docs`` with columns ``pred`` and ``score_col``, names that it must not have."""
    if {pred.lower(), score_col.lower()} & {c.lower() for c in docs.columns}:
        raise ValueError(f"{pred} or {score_col} is a column already; name others")
    spark = docs.sparkSession
    ship(spark)
    sent, at = spark.sparkContext.broadcast(net), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for b in batches:
            sizes = [len(t) if t else 0 for t in b.column(at).to_pylist()]
            for i, j in slices(sizes, 1 << 20):
                part = b.slice(i, j - i)
                label, score = own.predict(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(label, pa.string()), pa.array(score, pa.float64())], [*part.schema.names, pred, score_col])

    schema = T.StructType([*docs.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score_col, T.DoubleType())])
    return docs.mapInArrow(run, schema)
