"""Quality classifier: a regularised quadratic discriminant over text statistics.

Each text is reduced to a few transformed statistics (FEATURES). Per class, counts and
sums of all labelled rows are added up in Spark, then the products of their distances
from the means, so the driver sees some hundred numbers however many rows there are.
Covariances are shrunk towards
the pooled one and its diagonal, then factored once (Cholesky); a score is the
logistic of the log-density difference, each density by the squared Mahalanobis
distance that the cached factor gives, plus the log of the class shares.

Null texts count as empty and have a score like any other. With one class among the
labels that class's probability is 1; without any labels all scores are 0.5. Rows
of ``labels`` with null label or id are not learned from; a document with several
label rows counts once for each. Very long texts are read whole, one at a time;
repeated rows are scored each for itself; an empty table gives an empty result;
extra columns are not read by the classifier and pass through ``scored``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandframe.runtime import ship, written

FEATURES = ("words", "word_length", "letters", "upper", "digits", "symbols", "shouts", "bars", "variety", "repeated_lines", "commonest", "stutter", "stops", "lines", "word_length_spread")
SHRINK_POOLED, SHRINK_DIAGONAL, FLOOR = 0.1, 0.05, 0.005

_UPPER, _DIGIT = slice(65, 91), slice(48, 58)
_SYMBOLS = [ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]


def statistics(text: bytes) -> list[float]:
    """The FEATURES of a text; fractions on a log scale that FLOOR keeps finite."""
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    n, size = len(words), max(1, len(text))
    upper, digits = int(count[_UPPER].sum()), int(count[_DIGIT].sum())
    letters = upper + int(count[97:123].sum()) + int(count[128:].sum())
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in text.split(b"\n") if x]
    again = sum(len(x) * (c - 1) for x, c in Counter(lines).items()) if len(lines) > 1 else 0
    part = lambda x, of: float(np.log(FLOOR + x / max(1, of)))
    kinds = Counter(words) if n else {}
    return [
        float(np.log1p(n)),
        float(np.log1p(lengths.mean())) if n else 0.0,
        letters / size,
        part(upper, letters),
        part(digits, size),
        part(int(count[_SYMBOLS].sum()), size),
        part(int(count[33]) + int(count[63]), n),
        part(int(count[124]), n),
        float(np.log1p(len(kinds)) / np.log1p(n)) if n else 1.0,
        part(again, size),
        part(max(kinds.values()) if n else 0, n),
        part(sum(map(eq, words, words[1:])), n),
        part(int(count[46]), n),
        part(len(lines), n),
        float(np.log1p(lengths.std())) if n else 0.0,
    ]


@dataclass
class Discriminant:
    """Means, Cholesky factors and log constants of classes 0 and 1."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    const: list[float]
    only: float | None = None

    @classmethod
    def from_moments(cls, n: list[float], means: list[np.ndarray], scatter: list[np.ndarray]) -> Discriminant:
        """From counts, means and sums of products of distances from the means, by class."""
        total = sum(n)
        if min(n) == 0:
            return cls([], [], [], 0.5 if total == 0 else float(n[1] > 0))
        d = len(means[0])
        own = [scatter[k] / n[k] for k in (0, 1)]
        pooled = (n[0] * own[0] + n[1] * own[1]) / total
        floor = 1e-6 + 1e-3 * np.diag(pooled).max()
        factors, const = [], []
        for k in (0, 1):
            c = (1 - SHRINK_POOLED) * own[k] + SHRINK_POOLED * pooled
            c = (1 - SHRINK_DIAGONAL) * c + SHRINK_DIAGONAL * np.diag(np.diag(pooled)) + floor * np.eye(d)
            factor = np.linalg.cholesky(c)
            factors.append(factor)
            const.append(float(np.log(n[k] / total) - np.log(np.diag(factor)).sum()))
        return cls(means, factors, const)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 of each row of features."""
        if self.only is not None:
            return np.full(len(x), self.only)
        log = [self.const[k] - 0.5 * (np.linalg.solve(self.factors[k], (x - self.means[k]).T) ** 2).sum(axis=0) for k in (0, 1)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def with_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with _features, an array of doubles."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [statistics(t or b"") for t in b.column(at).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.list_(pa.float64()))], [*b.schema.names, "_features"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_features", T.ArrayType(T.DoubleType()))]))


def fit(features: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Discriminant:
    """Learn from all rows of ``features`` (id, _features) that ``labels`` (id, label) marks 0 or 1."""
    d = len(FEATURES)
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_lid"), F.col(label_col).cast("int").alias("_y"))
    rows = features.select(F.col(id_col).alias("_fid"), "_features").join(known, F.col("_fid") == F.col("_lid")).select("_y", "_features")
    rows = written(rows, "labelled")  # read twice

    def added(means: np.ndarray | None) -> np.ndarray:
        """By class: counts and sums, or the products of distances from ``means``."""

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, 1 + d if means is None else d * d))
            for b in batches:
                y = b.column(0).to_numpy()
                x = b.column(1).flatten().to_numpy().reshape(-1, d)
                for k in (0, 1):
                    v = x[y == k]
                    total[k] += np.concatenate(([len(v)], v.sum(axis=0))) if means is None else ((v - means[k]).T @ (v - means[k])).ravel()
            k, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(k.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], ["k", "j", "v"])

        out = np.zeros((2, 1 + d if means is None else d * d))
        for r in rows.mapInArrow(add, "k int, j int, v double").groupBy("k", "j").agg(F.sum("v").alias("v")).collect():
            out[r.k, r.j] = r.v
        return out

    first = added(None)
    n = first[:, 0]
    means = first[:, 1:] / np.maximum(n, 1)[:, None]
    return Discriminant.from_moments(n.tolist(), list(means), list(added(means).reshape(2, d, d)))


def scored(features: DataFrame, model: Discriminant) -> DataFrame:
    """``features`` with _score in place of _features."""
    spark = features.sparkSession
    ship(spark)
    sent, at = spark.sparkContext.broadcast(model), features.columns.index("_features")
    d = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = sent.value.score(b.column(at).flatten().to_numpy().reshape(-1, d))
            cols = b.columns
            cols[at] = pa.array(s)
            names = b.schema.names
            names[at] = "_score"
            yield pa.RecordBatch.from_arrays(cols, names)

    fields = [T.StructField("_score", T.DoubleType()) if f.name == "_features" else f for f in features.schema.fields]
    return features.mapInArrow(run, T.StructType(fields))


def scored_texts(docs: DataFrame, model: Discriminant, text_col: str = "text", score_col: str = "_score") -> DataFrame:
    """``docs`` with ``score_col``, a name that it must not have: statistics and score in one pass over the texts."""
    if score_col.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"{score_col} is a column already; name another")
    spark = docs.sparkSession
    ship(spark)
    sent, at = spark.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.asarray([statistics(t or b"") for t in b.column(at).cast(pa.binary()).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sent.value.score(got))], [*b.schema.names, score_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))
