"""Document fingerprints: MinHash over word shingles, banded and verified.

``signatures`` applies universal permutations a*x+b (a odd) of 64-bit shingle
hashes to whole batches in numpy and keeps 16 bits of each minimum. A fingerprint
is the signature in hex, the likeness of two the share of equal components, which
estimates the Jaccard similarity of the shingle sets. Equal texts have equal
fingerprints; texts without words share the fingerprint of the empty set.

Null texts count as empty; texts are read whole, batches in slices of about
SLICE_BYTES; repeated rows and ids stay; extra columns are not read; an empty table
gives an empty result. Rows with a null id come first in the order of ids. Ids may be
of any type; those that are no whole numbers are ordered as strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from strandframe.llm.shingles import mix, shingle_hashes, shingle_sets
from strandframe.llm.token_counts import slices
from strandframe.runtime import ship, written

SLICE_BYTES = 1 << 20
#: So many texts of a band's group are in a part of it.
BLOCK = 256
_LEAST = -(2**63)


class MinHash:
    def __init__(self, components: int = 64, k: int = 5, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.k = k
        self.a = rng.integers(0, 2**63, components, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**64, components, dtype=np.uint64)

    def signatures(self, texts: list[bytes]) -> np.ndarray:
        """One row of 16-bit components for each text."""
        out = np.full((len(texts), len(self.a)), 0xFFFF, np.uint16)
        hashes, counts = shingle_hashes(texts, self.k)
        some = np.flatnonzero(counts)
        if len(some):
            first = (np.cumsum(counts) - counts)[some]
            v = np.empty_like(hashes)
            for p in range(len(self.a)):
                np.multiply(hashes, self.a[p], out=v)
                v += self.b[p]
                out[some, p] = mix(np.minimum.reduceat(v, first)) >> np.uint64(48)
        return out


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x == y).mean(axis=1)


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))


def _numbered(base: DataFrame) -> DataFrame:
    """``base`` with _sort, what ids are ordered by, and _x, a number that never falls along it.

    Whole numbers are ordered as such, all other ids as strings, of which _x has the first 7 bytes.
    """
    if isinstance(base.schema["_id"].dataType, T.IntegralType):
        return base.withColumn("_sort", F.col("_id").cast("long")).withColumn("_x", F.col("_sort"))
    name = F.col("_id").cast("string")
    head = F.rpad(F.hex(F.substring(name.cast("binary"), 1, 7)), 14, "0")
    return base.withColumn("_sort", name).withColumn("_x", F.conv(head, 16, 10).cast("long"))


def with_next(base: DataFrame, parts: int) -> DataFrame:
    """Rows (_id, _text) dealt to ``parts`` ranges of ids, sorted, as (pid, kind, _id, _text).

    kind 0 are all rows once. Each range ends with rows of kind 1: the first of the
    next range that has rows (the last range gets the first of all), so that every
    row's follower stands after it. Only ids are read to find the ranges; texts are
    shuffled once. The driver holds two numbers for each range.
    """
    base = _numbered(base)
    id_type = base.schema["_id"].dataType
    schema = T.StructType([T.StructField("pid", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("_id", id_type), T.StructField("_text", T.StringType()), T.StructField("_sort", base.schema["_sort"].dataType)])
    ids = base.select("_x")
    probs = [i / parts for i in range(1, parts)]
    cuts = ids.agg(F.percentile_approx("_x", F.lit(probs), F.lit(max(1000, 20 * parts))).alias("q")).first().q if probs else []
    bounds = np.unique(np.asarray(cuts or [], np.int64))

    def numbers(column: pa.Array) -> np.ndarray:
        return column.fill_null(_LEAST).to_numpy(zero_copy_only=False)

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, int] = {}
        for b in batches:
            x = numbers(b.column(0))
            pid = np.searchsorted(bounds, x, side="right")
            order = np.lexsort((x, pid))
            p, at = np.unique(pid[order], return_index=True)
            for i, j in zip(p.tolist(), x[order][at].tolist(), strict=True):
                best[i] = min(best.get(i, j), j)
        yield pa.RecordBatch.from_pydict({"pid": pa.array(list(best), pa.int64()), "first": pa.array(list(best.values()), pa.int64())})

    found = sorted(map(tuple, ids.mapInArrow(least, "pid long, first long").groupBy("pid").agg(F.min("first")).collect()))
    first = np.asarray([f for _, f in found], np.int64)
    used = [p for p, _ in found]
    goes_to = dict(zip(first.tolist(), [used[i - 1] for i in range(len(used))], strict=True))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["pid", "kind", "_id", "_text", "_sort"]
        for b in batches:
            x, rows = numbers(b.column(3)), b.columns[:3]
            pid = np.searchsorted(bounds, x, side="right")
            yield pa.RecordBatch.from_arrays([pa.array(pid.astype(np.int32)), pa.array(np.zeros(len(x), np.int32)), *rows], names)
            again = np.flatnonzero(np.isin(x, first))
            if len(again):
                to = np.asarray([goes_to[v] for v in x[again].tolist()], np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(np.ones(len(again), np.int32)), *(c.take(pa.array(again)) for c in rows)], names)

    # A range is a partition; its number is the partition's, so no two meet in one task.
    return base.mapInArrow(deal, schema).repartitionById(parts, "pid").sortWithinPartitions("pid", "kind", "_sort", "_text").drop("_sort")


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", components: int = 64, k: int = 5) -> DataFrame:
    """Id and fingerprint of every row."""
    hashed = MinHash(components, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(1).cast(pa.binary()).to_pylist()
            for i, j in slices([len(t) for t in raw], SLICE_BYTES):
                sig = hashed.signatures(raw[i:j])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([s.astype(">u2").tobytes().hex() for s in sig], pa.string())], ["_id", "fingerprint"])

    base = _base(docs, id_col, text_col)
    return base.mapInArrow(run, T.StructType([base.schema["_id"], T.StructField("fingerprint", T.StringType())])).withColumnRenamed("_id", id_col)


def edit_check(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", components: int = 64, k: int = 5) -> DataFrame:
    """How fingerprints follow an edit: each text against itself with its second half
    replaced by the next document's beginning, and against the next document.

    Columns: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. The next document is the one of the next id (ties: text), after the
    last the first.
    """
    spark = docs.sparkSession
    hashed = MinHash(components, k)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for b in batches:
            pid, kind, ids, texts = (c.to_pylist() for c in b.columns)
            if held:
                pid, kind, ids, texts = [held[0], *pid], [held[1], *kind], [held[2], *ids], [held[3], *texts]
            for i, j in slices([len(t) for t in texts[:-1]], SLICE_BYTES):
                yield judge(pid[i : j + 1], kind[i : j + 1], ids[i : j + 1], texts[i : j + 1])
            held = (pid[-1], kind[-1], ids[-1], texts[-1])

    base = _base(docs, id_col, text_col)
    id_type = base.schema["_id"].dataType
    id_kind = to_arrow_type(id_type)

    def judge(pid: list, kind: list, ids: list, texts: list) -> pa.RecordBatch:
        rows = [i for i in range(len(pid) - 1) if kind[i] == 0 and pid[i + 1] == pid[i]]
        own = hashed.signatures([t.encode() for t in texts])
        edited = []
        for i in rows:
            n = len(texts[i])
            edited.append((texts[i][: n - n // 2] + texts[i + 1][: n // 2]).encode())
        new = hashed.signatures(edited)
        mine, after = own[rows], own[[i + 1 for i in rows]]
        hexed = lambda m: pa.array([s.astype(">u2").tobytes().hex() for s in m], pa.string())
        return pa.RecordBatch.from_pydict(
            {
                "_id": pa.array([ids[i] for i in rows], id_kind),
                "n_chars": pa.array([len(texts[i]) for i in rows], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
                "fingerprint": hexed(mine),
                "edited_fingerprint": hexed(new),
                "near_edited": pa.array(likeness(mine, new), pa.float64()),
                "near_next": pa.array(likeness(mine, after), pa.float64()),
            }
        )

    kinds = {"n_chars": T.LongType(), "edited_sha256": T.StringType(), "fingerprint": T.StringType(), "edited_fingerprint": T.StringType(), "near_edited": T.DoubleType(), "near_next": T.DoubleType()}
    schema = T.StructType([T.StructField("_id", id_type), *(T.StructField(n, t) for n, t in kinds.items())])
    return with_next(base, parts).mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.75, components: int = 64, rows: int = 4, k: int = 5) -> DataFrame:
    """Links (a, b, similarity) between distinct texts, each named by its least id.

    Exact copies share a text and are not expanded. Signatures are cut into bands of
    ``rows`` components; all pairs of texts that agree in a band are candidates, and each
    is verified by the exact Jaccard similarity. A band's group is dealt by salts to parts
    of about BLOCK texts and pairs are made between two parts at a time, so no task makes
    all pairs of a group; n texts give n (n - 1) / 2 candidates, as many as it can have links.
    What is missed is what no band holds; for all links without exception use the n-gram
    Jaccard join.
    """
    hashed = MinHash(components, k)
    base = _base(docs, id_col, text_col)
    id_type = base.schema["_id"].dataType
    id_kind = to_arrow_type(id_type)
    distinct = base.where("_text <> '' and _id is not null").groupBy(F.sha2("_text", 256).alias("_key")).agg(F.min("_id").alias("_id"), F.min("_text").alias("_text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(1).cast(pa.binary()).to_pylist()
            for i, j in slices([len(t) for t in raw], SLICE_BYTES):
                flat = np.ascontiguousarray(hashed.signatures(raw[i:j])).reshape(j - i, components // rows, rows).astype(">u2")
                ids = b.column(0).slice(i, j - i).to_pylist()
                at = [(d, n, band.tobytes()) for d, bands in zip(ids, flat, strict=True) for n, band in enumerate(bands)]
                d, n, v = zip(*at, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(d, id_kind), pa.array(n, pa.int32()), pa.array(v, pa.binary())], ["_id", "band", "value"])

    bands = written(distinct.select("_id", "_text").mapInArrow(sign, T.StructType([T.StructField("_id", id_type), T.StructField("band", T.IntegerType()), T.StructField("value", T.BinaryType())])), "bands")
    whole = bands.groupBy("band", "value").agg(F.count("*").alias("_n")).where("_n > 1")
    parts = F.ceil(F.col("_n") / BLOCK)
    held = bands.join(whole, ["band", "value"]).withColumn("_parts", parts).withColumn("_own", F.pmod(F.xxhash64("_id", "band"), F.col("_parts")))
    met = held.select("band", "value", "_id", "_own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_to"))
    met = met.select("band", "value", "_id", "_own", F.least("_own", "_to").alias("_i"), F.greatest("_own", "_to").alias("_j"))
    x, y = (met.select("band", "value", "_i", "_j", F.col("_id").alias(n), F.col("_own").alias(o)) for n, o in (("a", "_oa"), ("b", "_ob")))
    pairs = x.join(y, ["band", "value", "_i", "_j"]).where("a < b and (_i = _j or _oa <> _ob)").select("a", "b").distinct()
    texts = distinct.select(F.col("_id").alias("a"), F.col("_text").alias("_ta"))
    joined = pairs.join(texts, "a").join(texts.select(F.col("a").alias("b"), F.col("_ta").alias("_tb")), "b").select("a", "b", "_ta", "_tb")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (b.column(c).cast(pa.binary()).to_pylist() for c in (2, 3))
            sim = []
            for t, u in zip(x, y, strict=True):
                s, v = shingle_sets([t, u], k)
                both = len(np.intersect1d(s, v, assume_unique=True))
                sim.append(both / max(1, len(s) + len(v) - both))
            keep = pa.array([v >= threshold for v in sim])
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in (b.column(0), b.column(1), pa.array(sim, pa.float64()))], ["a", "b", "similarity"])

    return joined.mapInArrow(verify, T.StructType([T.StructField("a", id_type), T.StructField("b", id_type), T.StructField("similarity", T.DoubleType())]))
