"""Near duplicates by HyperMinHash: compressed registers, banded, estimated, verified.

Documents are sets of word shingles (two words; fewer words, but not none: all of them
as one). Equal sets are one class, so copies are never expanded. The steps:

1. Sketch. A set's shingle hashes fall into REGISTERS buckets. A register holds its
   bucket's least hash as the number of its leading zeros and the MANTISSA bits behind
   them, 16 bits in all. The register of an empty bucket takes over that of the first
   bucket with a value in an order of its own, so small sets fill all registers as well,
   and two registers agree as often as the sets are alike (J, plus chance collisions).
2. Bands of ROWS registers each are hashed. A pair of similarity 0.8 shares none of 40
   bands of 5 with a chance of 1.3e-7; one of 0.1 shares one with a chance of 4e-4.
3. Candidates. First by stars: each class of a band's group is tried with one leader (that
   which meets most others in all bands), n - 1 for n, never all pairs, and what is
   linked goes together. A last step compares
   the sketches of what is left of a group, if of different components, in blocks within
   tasks: pairs that pass the estimate are verified there, and fewer links than classes
   leave a block.
4. Estimate. The share of equal registers, corrected by the expected share of chance
   collisions of two sets of these sizes, must not lie DEVIATIONS standard deviations
   under the least similarity. For sets of few shingles this rules nothing out.
5. Verification on the full sets of 64-bit shingle hashes (two different shingles of
   a pair agree by chance once in 2**64), and components by star rounds. The sets are
   no table: those that a round needs are made anew from one text of each class.

Null and empty texts (no words) have size 0 and are linked with nothing. Rows that
repeat an id are one document: it is linked by any of its texts. A null id is never a
component's name, but where all its ids are null; such rows are all kept. Texts are read
whole, extra columns are not read, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandframe.llm.components import components
from strandframe.llm.jaccard_join import SLICE_BYTES, class_key
from strandframe.llm.shingles import mix, shingle_sets
from strandframe.llm.token_counts import slices
from strandframe.runtime import delete_folder, fixed_order, shared_dir, ship, written

BANDS, ROWS, MANTISSA = 40, 5, 10
REGISTERS = BANDS * ROWS
LEAST, OF = 80, 100  # links have OF * intersection >= LEAST * union
DEVIATIONS = 5
STAR_ROUNDS, CHUNK, BLOCK, BLOCK_SHINGLES = 1, 256, 2048, 4_000_000
_FEW = 48  # sets of so few values fill their empty registers one by one
_SALT = np.uint64(0x5851F42D4C957F2D)

_RANDOM = np.random.default_rng(20250101)
#: In which order an empty register looks at the buckets, and the place of each bucket in it.
_ORDER = np.argsort(_RANDOM.random((REGISTERS, REGISTERS)), axis=1)
_PLACE_OF = np.argsort(_ORDER, axis=1)
_ODD = _RANDOM.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Registers (set x REGISTERS, 16 bits) of sets that are not empty."""
    sizes = [len(s) for s in sets]
    h = np.concatenate(sets)
    bucket = (((h >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)).astype(np.int64)
    v = mix(h ^ _SALT) >> np.uint64(11)  # 53 bits, exact as a double
    zeros = 53 - np.frexp(v.astype(np.float64))[1].astype(np.int64)
    mantissa = ((v << zeros.astype(np.uint64)) >> np.uint64(52 - MANTISSA)).astype(np.int64) & ((1 << MANTISSA) - 1)
    # Of two hashes the lesser one has the greater code; 0 is an empty bucket.
    code = ((zeros << MANTISSA) | ((1 << MANTISSA) - 1 - mantissa)) + 1
    out = np.zeros(len(sets) * REGISTERS, np.uint16)
    np.maximum.at(out, np.repeat(np.arange(len(sets)), sizes) * REGISTERS + bucket, code.astype(np.uint16))
    out = out.reshape(len(sets), REGISTERS)
    full = out > 0
    occupied = full.sum(axis=1)
    for i in np.flatnonzero(occupied <= _FEW):
        held = np.flatnonzero(full[i])
        first = held[np.argmin(_PLACE_OF[:, held], axis=1)]
        out[i] = np.where(full[i], out[i], out[i][first])
    rest = np.flatnonzero((occupied > _FEW) & (occupied < REGISTERS))
    if len(rest):
        values = out[rest]
        filled = values.copy()
        row, at = np.nonzero(values == 0)
        for step in range(REGISTERS):
            found = values[row, _ORDER[at, step]]
            filled[row, at] = found
            row, at = row[found == 0], at[found == 0]
            if not len(row):
                break
        out[rest] = filled
    return out


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A hash of each band of each sketch; bands of different places have different hashes."""
    r = registers.reshape(-1, BANDS, ROWS).astype(np.uint64)
    return mix((mix(r + _ODD[None]) * _ODD[None]).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)[None] * _SALT)


_LEVELS = np.arange(54)


def _level_shares(n: np.ndarray) -> np.ndarray:
    """How often a register of a set of n shingles has each number of leading zeros."""
    n = np.asarray(n, np.float64)
    load = n / REGISTERS / -np.expm1(-n / REGISTERS)  # shingles in a bucket that has any
    above = np.power(1 - 2.0 ** -_LEVELS[None].astype(np.float64), load[:, None])
    return np.diff(above, axis=1, append=1.0)


def collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The expected share of equal registers of two sets of n and m shingles without a common one."""
    return (_level_shares(n) * _level_shares(m)).sum(axis=1) / (1 << MANTISSA)


def estimates(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Similarities of sketches a[i] of n[i] shingles and b[i] of m[i], corrected for collisions."""
    return _corrected(_equal(a, b), n, m)


def _equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.count_nonzero(a == b, axis=1) / REGISTERS


def _corrected(equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    chance = collisions(n, m)
    return (equal - chance) / (1 - chance)


def _worth(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether the estimate leaves it open that the least similarity is reached."""
    t = LEAST / OF
    independent = REGISTERS * -np.expm1(-np.minimum(n, m) / REGISTERS)
    least = t - DEVIATIONS * np.sqrt(t * (1 - t) / independent)
    equal = _equal(a, b)
    # The correction only lowers a share: where the share itself is too low it is not worked out.
    worth = equal >= least
    some = np.flatnonzero(worth)
    if len(some):
        worth[some] = _corrected(equal[some], n[some], m[some]) >= least[some]
    return worth


def _sized(n, m):
    return OF * np.minimum(n, m) >= LEAST * np.maximum(n, m)


def _sets(k: int, id_type: pa.DataType):
    """(rid, _id, h, n, key, registers) of each text; h, a hash of the text, comes with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 36
        for b in batches:
            raw = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            for i, j in slices([len(t) for t in raw], SLICE_BYTES):
                sets = shingle_sets(raw[i:j], k)
                some = [s for s in sets if len(s)]
                made = iter(sketches(some)) if some else iter(())
                cells = [
                    pa.array(range(rid, rid + j - i), pa.int64()),
                    b.column(0).slice(i, j - i).cast(id_type),
                    b.column(2).slice(i, j - i),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([class_key(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(made).tobytes() if len(s) else None for s in sets], pa.binary()),
                ]
                rid += j - i
                yield pa.RecordBatch.from_arrays(cells, ["rid", "_id", "h", "n", "key", "registers"])

    return run


def _tokens(k: int):
    """(cid, n, data) of rows (cid, key, text): the sets of a task's classes, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            cids, keys, raw = (c.to_pylist() for c in (b.column(0), b.column(1), b.column(2).cast(pa.binary())))
            for i, j in slices([len(t) for t in raw], SLICE_BYTES):
                rows = []
                for cid, key, s in zip(cids[i:j], keys[i:j], shingle_sets(raw[i:j], k), strict=True):
                    # Another text may have the same hash, but no other set the same key.
                    if cid not in seen and class_key(s) == key:
                        seen.add(cid)
                        rows.append((cid, len(s), s.tobytes()))
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["cid", "n", "data"])

    return run


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band, cid, n): BANDS rows of each class (cid, n, registers)."""
    for b in batches:
        if b.num_rows:
            keys = band_keys(_registers(b.column(2)))
            cid, n = (np.repeat(b.column(i).to_numpy(zero_copy_only=False), BANDS) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(cid), pa.array(n)], ["band", "cid", "n"])


PAIR = "a long, b long"


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["a", "b"])


def _led(test):
    """Pairs of a leader (kind 0) and each class behind it (kind 1) that pass ``test``.

    Rows (lead, salt, kind, cid, n, data) come sorted by the first three.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, n, data = None, 0, b""
        for b in batches:
            found: list[tuple[int, int]] = []
            rows = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
            at = 0
            while at < len(rows):
                if rows[at][2] == 0:
                    lead, n, data = rows[at][3:]
                    at += 1
                    continue
                end = at
                while end < len(rows) and rows[end][2] == 1:
                    end += 1
                for r, good in zip(rows[at:end], test(n, data, [r[4] for r in rows[at:end]], [r[5] for r in rows[at:end]]), strict=True):
                    if good:
                        found.append((lead, r[3]))
                at = end
            if found:
                yield _pairs(found)

    return run


def _likely(n: int, data: bytes, ms: list[int], others: list[bytes]) -> np.ndarray:
    b = np.frombuffer(b"".join(others), np.uint16).reshape(-1, REGISTERS)
    a = np.broadcast_to(np.frombuffer(data, np.uint16), b.shape)
    return _worth(a, np.full(len(ms), n), b, np.asarray(ms))


def _alike(n: int, data: bytes, ms: list[int], others: list[bytes]) -> Iterator[bool]:
    s = np.frombuffer(data, np.uint64)
    for m, other in zip(ms, others, strict=True):
        t = np.frombuffer(other, np.uint64)
        at = np.searchsorted(s, t)
        at[at == n] = 0
        both = int((s[at] == t).sum())
        yield OF * both >= LEAST * (n + m - both)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within a group's block, or across two: rows (band, x, y, side, cid, n, label, registers, data), sorted.

    Classes of side 0 are held (about BLOCK); those of side 1 are compared with them one by
    one, and where x = y also the held ones with each other. Pairs that pass the estimate
    are verified here, unless links of this block join them already; so a block gives fewer
    links than it has classes, however many of its pairs are alike.
    """
    now = None
    held: list[tuple] = []
    arrays: tuple[np.ndarray, ...] = ()
    parent: dict[int, int] = {}

    def root(i: int) -> int:
        while (up := parent.get(i, i)) != i:
            parent[i] = i = parent.get(up, up)
        return i

    for b in batches:
        found: list[tuple[int, int]] = []
        for band, x, y, side, cid, n, label, registers, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (band, x, y) != now:
                now, held, arrays, parent = (band, x, y), [], (), {}
            mine = np.frombuffer(registers, np.uint16)
            if held and (x == y or side == 1):
                if side == 0 or not arrays:
                    # Grown by doubling within a block; across blocks it is made once.
                    arrays = _held(held, arrays)
                ids, sizes, labels, regs = (c[: len(held)] for c in arrays)
                some = np.flatnonzero((labels != label) & _sized(sizes, n))
                for i in range(0, len(some), 512):
                    part = some[i : i + 512]
                    good = part[_worth(regs[part], sizes[part], np.broadcast_to(mine, (len(part), REGISTERS)), np.full(len(part), n))]
                    for j in good.tolist():
                        other = int(ids[j])
                        if root(cid) != root(other) and next(_alike(n, data, [int(sizes[j])], [held[j][4]])):
                            parent[root(cid)] = root(other)
                            found.append((min(cid, other), max(cid, other)))
            if side == 0:
                held.append((cid, n, label, mine, data))
        if found:
            yield _pairs(found)


def _held(rows: list[tuple], arrays: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """The rows' first four fields as columns with room for as many again; what is there already is only added to."""
    if not arrays or len(arrays[0]) < len(rows):
        room = 2 * len(rows)
        new = tuple(np.zeros(room, np.int64) for _ in range(3)) + (np.zeros((room, REGISTERS), np.uint16),)
        start = 0
    else:
        new, start = arrays, len(rows) - 1
    for i in range(start, len(rows)):
        for column, x in zip(new, rows[i][:4], strict=True):
            column[i] = x
    return new


class NearDuplicates:
    """The near duplicates of one table: ``component_of`` has a row for each document."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 2) -> None:
        from pyspark.sql.pandas.types import to_arrow_type

        self.spark, self.id_col = docs.sparkSession, id_col
        ship(self.spark)
        self.parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self._folders: dict[str, str] = {}
        self.k = k
        base = fixed_order(docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")), "hyperminhash-texts")
        self.base = base.withColumn("h", F.xxhash64("_text"))
        kind = base.schema["_id"].dataType
        names = [("rid", T.LongType()), ("_id", kind), ("h", T.LongType()), ("n", T.LongType()), *((c, T.BinaryType()) for c in ("key", "registers"))]
        self.sets = self._kept(self.base.mapInArrow(_sets(k, to_arrow_type(kind)), T.StructType([T.StructField(*x) for x in names])), "sets")
        # The text of a class is that of its least id (null comes last).
        first = F.min(F.struct(F.col("_id").isNull().alias("no"), "_id", "h"))
        one = self.sets.where("n > 0").groupBy("key").agg(first.alias("f"), F.min("rid").alias("cid"))
        self.classes = self._kept(one.select("key", F.col("f._id").alias("least"), "f.h", "cid"), "classes")
        self.reps = self._kept(self.sets.select(F.col("rid").alias("cid"), "n", "registers").join(self.classes.select("cid"), "cid"), "reps")

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        folder = shared_dir(self.spark, f"hyperminhash-{name}")
        out = written(df, name, folder)
        self._drop(name)
        self._folders[name] = folder
        return out

    def _drop(self, name: str) -> None:
        if name in self._folders:
            delete_folder(self.spark, self._folders.pop(name))

    def _tested(self, pairs: DataFrame, data: DataFrame, test) -> DataFrame:
        """Of distinct pairs (a, b) those that pass; a leader of many goes to several tasks."""
        sized = pairs.groupBy("a").agg(F.count("*").alias("c")).select("a", F.ceil(F.col("c") / CHUNK).cast("int").alias("salts"))
        members = pairs.join(sized, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.col("b").alias("cid"))
        members = members.join(data, "cid").select("a", "salt", F.lit(1).alias("kind"), "cid", "n", "data")
        leads = sized.join(data.withColumnRenamed("cid", "a"), "a")
        leads = leads.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("a").alias("cid"), "n", "data")
        rows = leads.unionByName(members).repartition(self.parts, "a", "salt").sortWithinPartitions("a", "salt", "kind")
        return rows.mapInArrow(_led(test), PAIR)

    def _tokens(self, named: DataFrame) -> DataFrame:
        """(cid, n, data): the sets of the classes ``named`` (cid), a written table."""
        named = named.join(self.classes, "cid").select("cid", "key", "least", F.col("h").alias("of"))
        texts = self.base.join(named, (F.col("h") == F.col("of")) & F.col("_id").eqNullSafe(F.col("least"))).select("cid", "key", "_text")
        return self._kept(texts.mapInArrow(_tokens(self.k), "cid long, n long, data binary").dropDuplicates(["cid"]), "tokens")

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """Of distinct pairs (a, b) the links: first by the estimate, then on the sets."""
        likely = self._kept(self._tested(pairs, self.reps.withColumnRenamed("registers", "data"), _likely), "likely")
        tokens = self._tokens(likely.select(F.explode(F.array("a", "b")).alias("cid")).distinct())
        return self._tested(likely, tokens, _alike)

    def _open(self, entries: DataFrame, step: int) -> DataFrame:
        """Entries of the bands whose classes are not all of one label, with a leader ``l`` and their number.

        The first leader of a group is the class that meets most others in all its bands: of
        copies that were changed here and there it is what they were made from, to which
        they are all nearer than to each other. Later ones are any.
        """
        groups = entries.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("c"), F.sum("n").alias("mass")).where("lo <> hi")
        held = self._kept(entries.join(self._kept(groups.select("band", "c", "mass"), "groups"), "band"), "held")
        row = F.struct("cid", "n", "label")
        if step == 0:
            weight = held.groupBy("cid").agg(F.sum("c").alias("w"))
            leaders = held.join(weight, "cid").groupBy("band").agg(F.max_by(row, F.struct("w", -F.col("cid"))).alias("l"))
        else:
            leaders = held.groupBy("band").agg(F.min_by(row, F.xxhash64("cid", F.lit(step))).alias("l"))
        return held.join(self._kept(leaders, "leaders"), "band")

    @staticmethod
    def _stars(entries: DataFrame) -> DataFrame:
        fits = f"{OF} * least(n, l.n) >= {LEAST} * greatest(n, l.n)"
        met = entries.where("label <> l.label").where(fits)
        return met.select(F.least("cid", F.col("l.cid")).alias("a"), F.greatest("cid", F.col("l.cid")).alias("b")).distinct()

    def _rest(self, entries: DataFrame) -> DataFrame:
        """Links between different labels in each band's group, met block by block within tasks."""
        # What a task holds of a block is bounded by its classes and by their shingles (32 MB).
        blocks = F.ceil(F.greatest(F.col("c") / BLOCK, F.col("mass") / BLOCK_SHINGLES)).cast("int")
        own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
        rows = entries.withColumn("blocks", blocks).withColumn("own", own)
        meet = F.transform(
            F.sequence(F.lit(0), F.col("blocks") - 1),
            lambda i: F.struct(F.least("own", i).alias("x"), F.greatest("own", i).alias("y"), (F.col("own") > i).cast("int").alias("side")),
        )
        tokens = self._tokens(entries.select("cid").distinct()).select("cid", "data")
        rows = rows.select("band", F.explode(meet).alias("m"), "cid", "label").join(self.reps.join(tokens, "cid"), "cid")
        rows = rows.select("band", "m.x", "m.y", "m.side", "cid", "n", "label", "registers", "data")
        return rows.repartition(self.parts, "band", "x", "y").sortWithinPartitions("band", "x", "y", "side").mapInArrow(_blocks, PAIR).distinct()

    def labels(self) -> DataFrame:
        """(cid, label) of all classes that are linked with others."""
        labels = None
        entries = self.reps.select("cid", "n", "registers").mapInArrow(_banded, "band long, cid long, n long").withColumn("label", F.col("cid"))
        for step in range(STAR_ROUNDS + 1):
            entries = self._kept(self._open(entries, step), "open")
            if entries.isEmpty():
                break
            new = self._kept(self._rest(entries) if step == STAR_ROUNDS else self._verified(self._stars(entries)), "links")
            if not new.isEmpty():
                labels = self._merged(labels, new)
            entries = entries.drop("l", "c", "mass")
            if labels is not None:
                entries = entries.drop("label").join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
        for name in ("open", "held", "groups", "leaders", "links", "likely", "tokens"):
            self._drop(name)
        return self.spark.createDataFrame([], "cid long, label long") if labels is None else labels

    def _merged(self, labels: DataFrame | None, links: DataFrame) -> DataFrame:
        """The components of former labels and further links: a class's label is one more link of it."""
        all_links = links if labels is None else links.unionByName(labels.where("cid <> label").toDF("a", "b"))
        return self._kept(components(all_links).withColumnRenamed("node", "cid"), "labels")

    def _same_ids(self) -> DataFrame:
        """Links (a, b) between the classes of an id that occurs with several texts."""
        some = self.sets.where("n > 0 and _id is not null").select("_id", "key", F.xxhash64("key").alias("h"))
        several = some.groupBy("_id").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("_id")
        of = some.join(several, "_id").select("_id", "key").join(self.classes.select("key", "cid"), "key")
        return of.join(of.groupBy("_id").agg(F.min("cid").alias("b")), "_id").where("cid <> b").select(F.col("cid").alias("a"), "b").distinct()

    def component_of(self) -> DataFrame:
        """One row for each document: id, n_shingles, component_id (its least id), kept (whether it is that one)."""
        labels, same = self.labels(), self._kept(self._same_ids(), "same")
        if not same.isEmpty():
            labels = self._merged(labels if "labels" in self._folders else None, same)
        named = self.classes.join(labels, "cid", "left").select("key", "least", F.coalesce("label", "cid").alias("label"))
        least = self._kept(named.groupBy("label").agg(F.min("least").alias("component")), "least")
        named = named.select("key", "label").join(least, "label").select("key", "component")
        out = self.sets.select("_id", "n", "key").join(named, "key", "left").select("_id", "n", F.coalesce("component", "_id").alias("component"))
        return out.select(F.col("_id").alias(self.id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("_id").eqNullSafe(F.col("component")).alias("kept"))


def near_duplicates_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 2) -> DataFrame:
    return NearDuplicates(docs, id_col, text_col, k).component_of()
