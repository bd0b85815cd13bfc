"""Whitening of embeddings: principal components by MLlib's ``computeSVD``.

Entries are made whole numbers (floor of ``scale`` times the entry), so that counts,
sums and deviations are exact. The steps:

1. ``quantised``: rows whose vector is null, empty or has a null or non-finite entry go.
   Of vectors of several lengths those of the most frequent one stay (ties: the
   longest), as no others can be compared with them.
2. The fit list is each distinct vector once, a written table: copies have no weight.
   A vector that a third of all rows share is one group of a partial aggregation.
3. n and the sums S of each dimension, exact.
4. ``RowMatrix.computeSVD`` of the centred rows (n * x - S) / n gives the right singular
   vectors; a singular value s of n rows is the eigenvalue s * s / n of the covariance
   of divisor n. More than half of all components are asked for, so MLlib decomposes
   the dense Gramian (dimension squared on the driver) to double precision.
5. The trace of the covariance is no sum of eigenvalues: it is the exact sum of
   all deviations (n * x - S)**2, divided by n**3.

Fewer than the asked-for components are returned where the rest of the eigenvalues
vanish (relative to the first); with one distinct vector there are none, and no rows.
An entry beyond a long's range counts as the range's end. A deviation that
exceeds a long is null. Repeated ids are rows like others; a null id passes through.
Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandframe.runtime import ship, written

SCALE = 256
#: A singular value below this share of the first is no component.
LEAST_SINGULAR = 1e-6
_LIMIT = 2**63 - 1


@dataclass(frozen=True)
class Whitening:
    """What rows are whitened with: dimensions and components only, no rows."""

    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # dimensions x components
    trace: float

    def deviations(self, x: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Centred rows (as doubles, rounded once) and their exact sums of (n * x - S)**2."""
        s = np.array(self.sums, object)
        reach = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if reach * reach * max(x.shape[1], 1) <= _LIMIT:
            c = self.n * x - s.astype(np.int64)
            return c / self.n, (c * c).sum(axis=1).tolist()
        c = x.astype(object) * self.n - s
        return (c / self.n).astype(np.float64), [sum(v * v for v in row) for row in c]

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return centred @ self.vectors / np.sqrt(self.values)


def quantised(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, x) with x = floor(scale * c) of each entry c, as longs."""
    c = F.col("c")
    x = F.transform(c, lambda v: F.floor(F.lit(float(scale)) * v).cast("long"))
    held = rows.select(F.col(id_col).alias(id_col), F.transform(F.col(vector_col), lambda v: v.cast("double")).alias("c"))
    bad = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    held = held.where(c.isNotNull() & (F.size(c) > 0)).where(~bad).select(id_col, x.alias("x"))
    sizes = held.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return held.where(F.size("x") == (sizes["d"] if sizes else 0))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _sums(d: int):
    """(dimension, sum) of a batch's rows, as decimals of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * d
        for b in batches:
            x = _matrix(b.column(0), d)
            if int(np.abs(x.astype(np.float64)).max(initial=0)) * len(x) < _LIMIT // 2:
                part = x.sum(axis=0).tolist()
            else:
                part = x.astype(object).sum(axis=0).tolist()
            total = [a + int(p) for a, p in zip(total, part, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(list(map(Decimal, total)), pa.decimal128(38, 0))], ["d", "s"])

    return run


def _spread(model: Whitening):
    """A task's exact sum of deviations as text: it may exceed any number type."""
    d = len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(sum(model.deviations(_matrix(b.column(0), d))[1]) for b in batches)
        yield pa.RecordBatch.from_arrays([pa.array([str(total)])], ["v"])

    return run


def _centred(model: Whitening):
    d = len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = model.deviations(_matrix(b.column(0), d))[0]
            cells = pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1, dtype=np.int32) * d), pa.array(c.ravel()))
            yield pa.RecordBatch.from_arrays([cells], ["v"])

    return run


def fit(x: DataFrame, components: int = 4) -> tuple[Whitening | None, DataFrame | None]:
    """A whitening of the distinct vectors of column ``x``, and these vectors as a table."""
    ship(x.sparkSession)
    once = written(x.select("x").distinct(), "whitening")
    n, d = once.count(), F.size("x")
    first = once.select(d.alias("d")).first()
    if first is None:
        return None, None
    d = first["d"]
    per = {r["d"]: int(r["s"]) for r in once.mapInArrow(_sums(d), "d int, s decimal(38,0)").groupBy("d").agg(F.sum("s").alias("s")).collect()}
    sums = [per[i] for i in range(d)]
    bare = Whitening(n, sums, np.empty(0), np.empty((d, 0)), 0.0)
    # One number a task; Python's whole numbers have no bound.
    spread = sum(int(r["v"]) for r in once.mapInArrow(_spread(bare), "v string").toLocalIterator())
    if not spread:
        return None, once
    with localcontext() as c:
        c.prec = 60
        trace = float(Decimal(spread) / Decimal(n) ** 3)
    centred = once.mapInArrow(_centred(bare), "v array<double>")
    vectors = MLUtils.convertVectorColumnsFromML(centred.select(array_to_vector("v").alias("v")), "v")
    svd = RowMatrix(vectors, n, d).computeSVD(min(d, max(components, d // 2 + 1)), False, LEAST_SINGULAR)
    values = np.asarray(svd.s.toArray())[:components] ** 2 / n
    return Whitening(n, sums, values, svd.V.toArray()[:, :components], trace), once


def _moments(model: Whitening):
    """A task's count, sums and centred products of whitened rows."""
    d, k = len(model.sums), len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = model.whitened(model.deviations(_matrix(b.column(0), d))[0])
            if not len(w):
                continue
            m = w.mean(axis=0)
            products = ((w - m).T @ (w - m) + len(w) * np.outer(m, m)).ravel()
            i = np.arange(k * k + k, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(np.concatenate((products, m * len(w))))], ["i", "v"])

    return run


def identity_error(model: Whitening, once: DataFrame) -> float:
    """The largest entry of the whitened fit list's covariance minus the identity."""
    k = len(model.values)
    rows = once.mapInArrow(_moments(model), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    v = np.zeros(k * k + k)
    for r in rows:
        v[r["i"]] = r["v"]
    mean = v[k * k :] / model.n
    return float(np.abs(v[: k * k].reshape(k, k) / model.n - np.outer(mean, mean) - np.eye(k)).max())


def _applied(model: Whitening, error: float, schema: pa.Schema):
    d, k = len(model.sums), len(model.values)
    explained = model.values / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            centred, deviations = model.deviations(_matrix(b.column(1), d))
            rows = b.num_rows
            ids = b.column(0).take(pa.array(np.repeat(np.arange(rows), k)))
            deviation = pa.array([v if v <= _LIMIT else None for v in deviations for _ in range(k)], pa.int64())
            cells = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, model.n)), deviation]
            cells += [pa.array(model.whitened(centred).ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cells, schema, strict=True)], schema=schema)

    return run


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4, scale: int = SCALE) -> DataFrame:
    """A row for each kept row and component: id, component, n, deviation, whitened, explained, identity_error."""
    from pyspark.sql.pandas.types import to_arrow_schema

    held = quantised(rows, id_col, vector_col, scale)
    fields = [held.schema[id_col], T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType())]
    schema = T.StructType([*fields, *(T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error"))])
    model, once = fit(held.select("x"), components)
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    return held.mapInArrow(_applied(model, identity_error(model, once), to_arrow_schema(schema)), schema)
