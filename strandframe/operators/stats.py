"""Statistics: null distributions, FDR edges, variance shares, permutation and binomial tests."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strandframe.runtime import ship, tasks_for, written

#: So many rows of a block meet so many others at a time.
BLOCK_ROWS = 4096
#: Chunks of so many rows stay together in up to GROUPS groups, of up to GROUP_CHUNKS chunks each, that the others of a block come to.
GROUPS, GROUP_CHUNKS = 8, 32
#: Rows of up to GRID_COLS columns may be counted on the grid of all rows there can be, which is cut into pieces of
#: 2**GRID_BITS places; a pair of rows takes as long as GRID_PAIR additions there.
GRID_COLS, GRID_BITS, GRID_PAIR = 26, 19, 4


def hashed(*parts) -> Column:
    """A number below 2**60 that md5 of the parts, joined by underscores, gives: the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("_", *(F.col(p) if isinstance(p, str) else F.lit(p) if isinstance(p, int) else p for p in parts))), 1, 15), 16, 10).cast("long")


def log_factorials(spark, top: int) -> DataFrame:
    """(i, lf): ln i! for i = 0..top; a few numbers for any matrix width."""
    lf, rows = 0.0, [(0, 0.0)]
    for i in range(1, top + 1):
        lf += math.log(i)
        rows.append((i, lf))
    return spark.createDataFrame(rows, "i int, lf double")


def null_distances(spark, m: int, all_k: bool = True) -> DataFrame:
    """(n2, n1, d, p): chance of Hamming distance d between rows of n1 and n2 ones of m.

    Shared ones are hypergeometric; d = n1 + n2 - 2k. ``all_k`` False leaves the last
    k out, as older tables of this distribution do: (0, 0) then has no mass.
    """
    pmf = []
    lf = [math.lgamma(i + 1) for i in range(m + 1)]
    choose = lambda a, b: lf[a] - lf[b] - lf[a - b]
    for n2 in range(m + 1):
        for n1 in range(m + 1):
            for k in range(max(0, n1 + n2 - m), min(n1, n2) + 1):
                if all_k or k < min(m, n1 + n2):
                    pmf.append((n2, n1, n1 + n2 - 2 * k, math.exp(choose(n1, k) + choose(m - n1, n2 - k) - choose(m, n2))))
    return spark.createDataFrame(pmf, "n2 int, n1 int, d int, p double")


def _sizes(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, parts, width): chunks of some BLOCK_ROWS rows of the same ``by``, and how many make a group; a row for each number of ones."""
    parts = rows.groupBy(*by).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("long").alias("_parts"))
    return parts.withColumn("_width", F.least(F.ceil(F.col("_parts") / GROUPS), F.lit(GROUP_CHUNKS)).cast("long"))


def _chunks(rows: DataFrame, by: list[str], carried: tuple[str, ...] = ()) -> DataFrame:
    """(by, grp, ids, words, carried) of rows (row_id, bits, by, carried): some BLOCK_ROWS rows of the same ``by`` in each."""
    dealt = rows.join(F.broadcast(_sizes(rows, by)), by).withColumn("_part", F.pmod(F.xxhash64("row_id"), F.col("_parts")))
    held = dealt.groupBy(*by, "_part", F.expr("_part div _width").alias("grp")).agg(F.collect_list(F.struct("row_id", "bits", *carried)).alias("_r"))
    return held.select(*by, "grp", F.col("_r.row_id").alias("ids"), F.flatten("_r.bits").alias("words"), *(F.col(f"_r.{c}").alias(c) for c in carried))


def _met(left: DataFrame, right: DataFrame, more: tuple[str, ...] = (), right_more: tuple[str, ...] = ()) -> DataFrame:
    """Groups of chunks of left rows (row_id, n1, n2, bits, more), each with every chunk of the right ones (row_id, n2,
    bits, right_more) behind it in the same task: n1, n2, grp, right, ids, words, more, right_more. The names of both
    are distinct.

    A chunk of left rows travels once, one of right rows to each group: up to GROUPS times, and more often only
    where a group has GROUP_CHUNKS chunks. A task holds the chunks of one group and one chunk of right rows.
    """
    a = _chunks(left, ["n1", "n2"], more).withColumn("right", F.lit(False))
    groups = _sizes(left, ["n1", "n2"]).select("n1", "n2", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(_parts - 1) div _width"))).alias("grp"))
    b = _chunks(right, ["n2"], right_more).drop("grp").join(F.broadcast(groups), "n2").withColumn("right", F.lit(True))
    names = ["n1", "n2", "grp", "right", "ids", "words", *more, *right_more]
    met = a.unionByName(b, allowMissingColumns=True).select(*names)
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A given number of tasks, by a key of its own so that no shuffle of before stands in for it:
    # the rows are few, the work on them is not.
    return met.repartition(tasks, F.xxhash64("n1", "n2", "grp")).sortWithinPartitions("n1", "n2", "grp", "right")


def _sides(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[tuple[bool, list]]]]:
    """(n1, n2, grp) with the rows of each group of ``_met``: whether a chunk is of right rows, and its columns' values."""

    def rows() -> Iterator[tuple]:
        for b in batches:
            for i in range(b.num_rows):
                yield tuple(b.column(c)[i].as_py() for c in range(3)), b.column(3)[i].as_py(), [b.column(c)[i].values for c in range(4, b.num_columns)]

    for key, found in groupby(rows(), key=lambda r: r[0]):
        yield key, ((right, chunk) for _, right, chunk in found)


def _words(words: pa.Array, ids: pa.Array) -> np.ndarray:
    return words.to_numpy(zero_copy_only=False).reshape(len(ids), -1)


def _distances(row: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Hamming distances of a bit-packed row from others."""
    d = np.bitwise_count(others[:, 0] ^ row[0])
    if len(row) == 1:
        return d
    d = d.astype(np.int32)
    for w in range(1, len(row)):
        d += np.bitwise_count(others[:, w] ^ row[w])
    return d


def _counted(n_cols: int, schema: pa.Schema, weighted: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (n1, n2, _), chunks in _sides(batches):
            held, met = [], False
            for is_right, (ids, words, *more) in chunks:
                if not is_right:
                    held.append((ids, _words(words, ids), np.zeros((len(ids), n_cols + 1), np.int64)))
                    continue
                met, right = True, _words(words, ids)
                weights = more[0].to_numpy(zero_copy_only=False).astype(float) if weighted else None  # exact below 2**53
                for _, left, counts in held:
                    for j, row in enumerate(left):
                        counts[j] += np.bincount(_distances(row, right), weights, n_cols + 1).astype(np.int64, copy=False)
            for ids, _, counts in held if met else ():
                if n1 == n2:
                    counts[:, 0] -= 1  # a row is no pair with itself
                offsets = pa.array(np.arange(0, counts.size + 1, n_cols + 1, dtype=np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(counts.ravel()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(np.full(len(ids), n, np.int32)) for n in (n1, n2)), lists], schema=schema)

    return run


def _grid_blocks(rows: DataFrame, n_cols: int, steps: tuple[int, ...]) -> list[int]:
    """Numbers of ones whose block has more pairs to look at than the grid takes."""
    if n_cols > GRID_COLS:
        return []
    size = {r.ones: r.n for r in rows.groupBy("ones").agg(F.count("*").alias("n")).collect()}  # a row for each number of ones
    return [n2 for n2, n in size.items() if GRID_PAIR * n * sum(size.get(n2 - s, 0) for s in steps) > n_cols * (n_cols + 1) // 2 << n_cols]


def _flip_each(counts: np.ndarray, known: int) -> None:
    """Each place takes over what the place that differs in a column has, one further away; column by column, in
    place. Before, nothing is further away than ``known``."""
    places = np.arange(counts.shape[1])
    for i in range(len(places).bit_length() - 1):
        other = places ^ (1 << i)
        for d in range(min(len(counts) - 1, known + i + 1), 0, -1):
            if i < 4:
                counts[d] += counts[d - 1][other]
            else:
                to, by = (counts[x].reshape(-1, 2, 1 << i) for x in (d, d - 1))
                to[:, 0] += by[:, 1]
                to[:, 1] += by[:, 0]


def _counted_on_grid(n_cols: int, cut: int, schema: pa.Schema, weighted: bool):
    """A right row lies at the place of its columns below ``cut``, as far away as its others differ from the piece's;
    then those columns are seen to, and a left row finds its counts at its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (n2, piece, _), chunks in _sides(batches):
            counts, met, done = np.zeros((n_cols + 1, 1 << cut), np.int64), False, False
            for is_left, (n1, ids, words, *more) in chunks:
                words = words.to_numpy(zero_copy_only=False)
                places = words & ((1 << cut) - 1)
                if not is_left:
                    met = True
                    np.add.at(counts, (np.bitwise_count((words >> cut) ^ piece), places), more[0].to_numpy(zero_copy_only=False) if weighted else 1)
                    continue
                if not met:
                    break
                if not done:
                    _flip_each(counts, n_cols - cut)
                    done = True
                own, n = counts[:, places].T.copy(), n1[0].as_py()
                if n == n2:
                    own[:, 0] -= 1  # a row is no pair with itself
                offsets = pa.array(np.arange(0, own.size + 1, n_cols + 1, dtype=np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(own.ravel()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(np.full(len(ids), x, np.int32)) for x in (n, n2)), lists], schema=schema)

    return run


def _on_grid(left: DataFrame, right: DataFrame, n_cols: int, cut: int, right_more: tuple[str, ...]) -> DataFrame:
    """Chunks of right rows ahead of the left ones of each piece of a block's grid: n2, piece, 0, left, n1, ids, words, right_more."""
    pieces = F.explode(F.sequence(F.lit(0).cast("long"), F.lit((1 << (n_cols - cut)) - 1).cast("long"))).alias("piece")
    b = _chunks(right, ["n2"], right_more).select("n2", pieces, F.lit(False).alias("left"), "words", *right_more)
    a = _chunks(left.withColumn("piece", F.shiftright(F.col("bits")[0], cut)), ["n1", "n2", "piece"])
    a = a.select("n2", "piece", F.lit(True).alias("left"), F.array("n1").alias("n1"), "ids", "words")
    met = b.unionByName(a, allowMissingColumns=True).select("n2", "piece", F.lit(0).alias("grp"), "left", "n1", "ids", "words", *right_more)
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return met.repartition(tasks, F.xxhash64("n2", "piece")).sortWithinPartitions("n2", "piece", "left")


def distance_counts(packed: DataFrame, n_cols: int, low: int, high: int, steps: tuple[int, ...] = (0, 1), weight: str | None = None) -> DataFrame:
    """(r1, n1, n2, counts) of each row of ``low`` ones or more and each block of rows of n2 = n1 + step ones, up to
    ``high``: how many other rows of the block are d apart, at place d of counts.

    Pairs never leave a task: chunks of some BLOCK_ROWS rows meet there, and what a left chunk
    counts is added up over the right ones. All pairs are looked at, so time is quadratic in
    a block's rows; what is held and shuffled is chunks, and that is not. Large blocks of rows of
    few columns are counted on a grid of all 2**n_cols rows there can be, whose time is bounded. Row ids are distinct. A row counts as
    ``weight`` (a column) equal ones.
    """
    ship(packed.sparkSession)
    rows = packed.where(F.col("ones").between(low, high))
    more = () if weight is None else (weight,)
    right = rows.select("row_id", F.col("ones").alias("n2"), "bits", *more)
    left = rows.select("row_id", F.col("ones").alias("n1"), F.explode(F.array(*(F.col("ones") + s for s in steps))).alias("n2"), "bits")
    kind = T.StructType([T.StructField("r1", packed.schema["row_id"].dataType), *(T.StructField(c, T.IntegerType()) for c in ("n1", "n2")), T.StructField("counts", T.ArrayType(T.LongType()))])
    schema, weighted = to_arrow_schema(kind), weight is not None
    broad = _grid_blocks(rows, n_cols, steps)
    if not broad:
        return _met(left, right, (), more).mapInArrow(_counted(n_cols, schema, weighted), kind)
    here = F.col("n2").isin(broad)
    pairs = _met(left.where(~here), right.where(~here), (), more).mapInArrow(_counted(n_cols, schema, weighted), kind)
    cut = min(n_cols, GRID_BITS)
    return pairs.unionByName(_on_grid(left.where(here), right.where(here), n_cols, cut, more).mapInArrow(_counted_on_grid(n_cols, cut, schema, weighted), kind))


def distance_histogram(packed: DataFrame, n_cols: int, steps: tuple[int, ...] = (0, 1)) -> DataFrame:
    """(r1, n1, n2, d, n): the counts of ``distance_counts`` that are not 0, for rows of any number of ones."""
    counts = distance_counts(written(packed, "packed"), n_cols, 0, n_cols, steps)
    return counts.select("r1", "n1", "n2", F.posexplode("counts").alias("d", "n")).where("n > 0")


def _near(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (n1, n2, _), chunks in _sides(batches):
            held = []
            for is_right, (ids, words, cuts) in chunks:
                if not is_right:
                    held.append((ids, _words(words, ids), cuts.to_numpy(zero_copy_only=False)))
                    continue
                names, right = ids.to_numpy(zero_copy_only=False), _words(words, ids)
                for own, left, cut in held:
                    found, n = ([], []), 0
                    for j, row in enumerate(left):
                        at = np.flatnonzero(_distances(row, right) <= cut[j])
                        if n1 == n2:
                            at = at[names[at] > own[j].as_py()]
                        found[0].append(np.full(len(at), j))
                        found[1].append(at)
                        n += len(at)
                        if n > 1 << 18 or j == len(left) - 1:
                            yield pa.RecordBatch.from_arrays([x.take(pa.array(np.concatenate(f))) for x, f in zip((own, ids), found, strict=True)], schema=schema)
                            found, n = ([], []), 0

    return run


def near_pairs(packed: DataFrame, cuts: DataFrame) -> DataFrame:
    """(e1, e2): rows e1 with those of the block of n2 ones that are at most ``cut`` apart, by cuts (r1, n2, cut);
    of a pair within a block the row of lesser id decides."""
    ship(packed.sparkSession)
    left = packed.select("row_id", F.col("ones").alias("n1"), "bits").hint("merge").join(cuts.select(F.col("r1").alias("row_id"), "n2", "cut"), "row_id")
    right = packed.select("row_id", F.col("ones").alias("n2"), "bits")
    kind = T.StructType([T.StructField(c, packed.schema["row_id"].dataType) for c in ("e1", "e2")])
    return _met(left, right, ("cut",)).mapInArrow(_near(to_arrow_schema(kind)), kind)


def fdr_edges(packed: DataFrame, n_cols: int, fdr: float, cutoffs: DataFrame | None = None) -> DataFrame:
    """(e1, e2): rows nearer than chance allows, each pair of rows once.

    For row e1 and the block of rows with n2 ones: the largest d for which the number
    expected by chance up to d is at most fdr times the number seen up to d. Blocks run
    over n1 = 3..n_cols-4 and n2 = n1, n1+1 up to n_cols-2. Within a block the row of
    lesser id decides. Pairs are counted where they meet, and met again once each row's
    cutoffs are known: only pairs under their cutoff ever leave a task.
    """
    rows = written(packed.where(F.col("ones").between(3, n_cols - 3)), "packed")
    seen = distance_counts(rows, n_cols, 3, n_cols - 3)
    return near_pairs(rows, written(_cutoffs(seen, rows, n_cols, fdr), "cutoffs"))


def _cutoffs(seen: DataFrame, rows: DataFrame, n_cols: int, fdr: float) -> DataFrame:
    """(r1, n2, cut) of ``fdr_edges`` by what was seen (r1, n1, n2, counts) of all rows."""
    spark = rows.sparkSession
    seen = seen.where(F.col("n1") <= n_cols - 4)
    block = rows.groupBy(F.col("ones").alias("n2")).agg(F.count("*").alias("size"))
    # The null is (n_cols + 1) ** 2 cumulative sums; d at which nothing is seen can pass too,
    # so every d is laid out for each row and block.
    null = null_distances(spark, n_cols).where("n2 - n1 in (0, 1)")
    grid = null.select("n1", "n2").distinct().withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(n_cols))))
    run = Window.partitionBy("n1", "n2").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    null = grid.join(null, ["n1", "n2", "d"], "left").withColumn("f0", F.sum(F.coalesce("p", F.lit(0.0))).over(run)).drop("p")
    null = null.join(block, "n2").groupBy("n1", "n2").agg(F.array_sort(F.collect_list(F.struct("d", (F.col("f0") * F.col("size")).alias("e")))).alias("expected"))
    # A row's own distance counts at d = n_cols; a block in which it meets no other row has no cutoff.
    self_count = F.when(F.col("n1") == F.col("n2"), 1).otherwise(0)
    start = F.struct(F.lit(0).cast("long").alias("s"), F.lit(-1).alias("cut"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["s"] + F.get("counts", x["d"]) + F.when(x["d"] == n_cols, self_count).otherwise(0)
        return F.struct(s.alias("s"), F.when((s > 0) & (x["e"] <= s * F.lit(fdr)), x["d"]).otherwise(acc["cut"]).alias("cut"))

    met = F.exists("counts", lambda c: c > 0)
    return seen.where(met).join(F.broadcast(null), ["n1", "n2"]).select("r1", "n2", F.aggregate("expected", start, step)["cut"].alias("cut")).where("cut >= 0")


def _near_classes(schema: pa.Schema):
    """Pairs of left vertices (ids, n, cut) and right ones (ids, m, cut2) with an edge: e1, e2, w, and whether w is still to be counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (n1, n2, _), chunks in _sides(batches):
            held = []
            for is_right, (ids, words, *more) in chunks:
                bits = _words(words, ids)
                names, n, cuts, m, cuts2 = (None if v is None else v.to_numpy(zero_copy_only=False) for v in (ids, *more))
                if not is_right:
                    held.append((ids, names, bits, n, cuts))
                    continue
                for own, own_names, left, n, cuts in held:
                    found, many = [], 0
                    for j, row in enumerate(left):
                        d = _distances(row, bits)
                        at = np.flatnonzero(d <= cuts[j])
                        w, part = n[j] * m[at], np.zeros(len(at), bool)
                        if n1 == n2:
                            after, one = names[at] > own_names[j], w == 1
                            both = d[at] <= cuts2[at]
                            # Where either decides alike, each pair is met once; else rows that come first decide.
                            part = ~both & ~one
                            keep = (after | part) & (names[at] != own_names[j])
                            at, w, part = at[keep], w[keep], part[keep]
                        found.append((np.full(len(at), j), at, w, part))
                        many += len(at)
                        if many > 1 << 18 or j == len(left) - 1:
                            x, y, w, part = (np.concatenate(c) for c in zip(*found, strict=True))
                            yield pa.RecordBatch.from_arrays([own.take(pa.array(x)), ids.take(pa.array(y)), pa.array(w), pa.array(part)], schema=schema)
                            found, many = [], 0

    return run


def _earlier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(e1, e2, w): pairs of an id of a and a greater one of b, by sorted lists (e1, e2, a, b)."""
    for b in batches:
        lists = lambda c: [b.column(c)[i].values.to_numpy(zero_copy_only=False) for i in range(b.num_rows)]  # noqa: B023, E731
        w = [int(len(x) * len(y) - np.searchsorted(y, x, "right").sum()) for x, y in zip(lists(2), lists(3), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(w, pa.int64())], ["e1", "e2", "w"])


def fdr_class_edges(packed: DataFrame, n_cols: int, fdr: float) -> tuple[DataFrame, DataFrame]:
    """The edges of ``fdr_edges`` between classes of equal rows: (e1, e2, w), and (v, row_id), the rows of each class.

    Equal rows have equal cutoffs. A class is named by its least row; w is the number of
    edges between the rows of two classes, or within one (e1 = e2). Equal rows that are too
    common by chance to be linked are classes of one row each. All pairs of classes are
    looked at in place of all pairs of rows, and no edge is lost.
    """
    rows = written(packed.where(F.col("ones").between(3, n_cols - 3)), "packed")
    classes = written(rows.groupBy("ones", "bits").agg(F.min("row_id").alias("row_id"), F.count("*").alias("n")), "classes")
    cut = written(_cutoffs(distance_counts(classes, n_cols, 3, n_cols - 3, weight="n"), rows, n_cols, fdr), "cutoffs")
    own = cut.select(F.col("r1").alias("row_id"), F.col("n2").alias("ones"), F.col("cut").alias("own"))
    known = classes.hint("merge").join(own, ["row_id", "ones"], "left").withColumnRenamed("row_id", "least")
    named = rows.select("row_id", "ones", "bits").hint("merge").join(known, ["ones", "bits"])
    alone = F.col("own").isNull()
    named = written(named.select("row_id", F.when(alone, F.col("row_id")).otherwise(F.col("least")).alias("v"), F.when(alone, 1).otherwise(F.col("n")).alias("n"), "least", "ones", "bits", F.coalesce("own", F.lit(-1)).alias("own")), "members")
    verts = named.where("row_id = v")
    left = verts.select("row_id", F.col("ones").alias("n1"), "bits", "n", "least").hint("merge").join(cut.withColumnRenamed("r1", "least"), "least").drop("least")
    right = verts.select("row_id", F.col("ones").alias("n2"), "bits", F.col("n").alias("m"), F.col("own").alias("cut2"))
    kind = T.StructType([*(T.StructField(c, packed.schema["row_id"].dataType) for c in ("e1", "e2")), T.StructField("w", T.LongType()), T.StructField("part", T.BooleanType())])
    pairs = written(_met(left, right, ("n", "cut"), ("m", "cut2")).mapInArrow(_near_classes(to_arrow_schema(kind)), kind), "pairs")
    some = pairs.where("part").select("e1", "e2")
    # Ids of a class in lists of some BLOCK_ROWS, of those classes alone that are asked for.
    asked = some.select(F.col("e1").alias("v")).unionByName(some.select(F.col("e2").alias("v"))).distinct()
    lists = named.hint("merge").join(asked, "v", "left_semi").groupBy("v", F.pmod(F.xxhash64("row_id"), F.ceil(F.col("n") / BLOCK_ROWS)).alias("_p")).agg(F.array_sort(F.collect_list("row_id")).alias("ids"))
    side = lambda e, c: lists.select(F.col("v").alias(e), F.col("ids").alias(c))
    met = some.hint("merge").join(side("e1", "a"), "e1").hint("merge").join(side("e2", "b"), "e2").select("e1", "e2", "a", "b")
    counted = met.mapInArrow(_earlier, T.StructType(kind.fields[:3])).groupBy("e1", "e2").agg(F.sum("w").alias("w")).where("w > 0")
    within = verts.where("n > 1").select(F.col("v").alias("e1"), F.col("v").alias("e2"), F.expr("n * (n - 1) div 2").alias("w"))
    edges = pairs.where("not part").select("e1", "e2", "w").unionByName(counted).unionByName(within)
    return edges, named.select("v", "row_id")


def assemble_clusters(ones: DataFrame, communities: DataFrame, n_cols: int, margin: int = 2) -> DataFrame:
    """(row, cluster): 0 for rows that are nearly all ones, communities from 1 on."""
    open_rows = ones.where(F.col("ones") >= n_cols - margin).select(F.col("row_id").alias("row"), F.lit(0).alias("cluster"))
    rest = communities.select(F.col("v").alias("row"), (F.col("cluster") + 1).cast("int").alias("cluster"))
    return open_rows.unionByName(rest.join(open_rows, "row", "left_anti"))


def variance_shares(stats: DataFrame, assignment: DataFrame) -> DataFrame:
    """Per row cluster: total variance of its column means, that between column
    clusters, and running shares in the order of clusters.

    stats (cluster, col_id, n, s); assignment (col_id, k). Weighted by columns.
    """
    means = stats.select("cluster", "col_id", (F.col("s") / F.col("n")).alias("mean")).join(assignment, "col_id")
    k = means.groupBy("cluster", "k").agg(F.count("*").alias("nk"), F.avg("mean").alias("mk"))
    r = means.groupBy("cluster").agg(F.count("*").alias("nc"), F.avg("mean").alias("mr"), F.var_pop("mean").alias("var"))
    across = k.join(r, "cluster").groupBy("cluster").agg(F.sum(F.col("nk") / F.col("nc") * (F.col("mk") - F.col("mr")) * (F.col("mk") - F.col("mr"))).alias("across"))
    out = r.select("cluster", "var").join(across, "cluster")
    # One row for each row cluster (tens): a single ordered window.
    run = Window.orderBy("cluster").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("running_share", 100 * F.col("var") / F.sum("var").over(run))


def retained(stats: DataFrame, assignment: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row: percent of the column means' variance kept by each block's ``value``."""
    means = stats.select("cluster", "col_id", (F.col("s") / F.col("n")).alias("mean"))
    n = means.groupBy("cluster").agg(F.count("*").alias("nc"), F.var_pop("mean").alias("var"))
    lost = means.join(assignment, "col_id").join(blocks.select("cluster", "k", "value"), ["cluster", "k"]).join(n, "cluster")
    lost = lost.groupBy("cluster").agg((F.sum((F.col("mean") - F.col("value")) * (F.col("mean") - F.col("value"))) / F.first("nc")).alias("lost"), F.first("var").alias("var"))
    return lost.agg((100 * (1 - F.sum("lost") / F.sum("var"))).alias("retained"))


def binary_levels(low: Column, high: Column, value: Column) -> Column:
    """A block as 0 or 1 from its row cluster's two centres: both high, both low, or split."""
    return F.when(F.least(low, high) > 0.8, 1.0).when(F.greatest(low, high) < 0.2, 0.0).otherwise((value == high).cast("double"))


def two_centres(blocks: DataFrame) -> DataFrame:
    """Blocks with the centres of the exact 2-means of their row cluster's block means:
    low, high, and ``value``, the centre a block belongs to."""
    from strandframe.operators.matrix import on_off_split

    split = on_off_split(blocks.select("cluster", "k", "mean"), ["cluster"], "mean", ["k"])
    by = Window.partitionBy("cluster")
    low = F.avg(F.when(F.col("on") == 0, F.col("mean"))).over(by)
    high = F.avg(F.when(F.col("on") == 1, F.col("mean"))).over(by)
    out = split.withColumn("low", F.coalesce(low, high)).withColumn("high", F.coalesce(high, low))
    return out.withColumn("value", F.when(F.col("on") == 1, F.col("high")).otherwise(F.col("low"))).select("cluster", "k", "mean", "low", "high", "value")


def full_decomposition(stats: DataFrame, assignment: DataFrame) -> DataFrame:
    """Per row cluster, of the variance of all its 0/1 cells: between column clusters
    (cc), between columns within them (wc), within columns (wr), and check = their sum
    over the total, which is 1."""
    s = stats.select("cluster", "col_id", F.col("n").cast("double").alias("n"), F.col("s").cast("double").alias("s")).join(assignment, "col_id")
    k = s.groupBy("cluster", "k").agg(F.sum("n").alias("nk"), F.sum("s").alias("sk"))
    r = s.groupBy("cluster").agg(F.sum("n").alias("nr"), F.sum("s").alias("sr"), F.sum(F.col("s") - F.col("s") * F.col("s") / F.col("n")).alias("_wr"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("_cols"))
    b = k.groupBy("cluster").agg(F.sum(F.col("sk") * F.col("sk") / F.col("nk")).alias("_blocks"))
    m = F.col("sr") / F.col("nr")
    out = r.join(b, "cluster").select("cluster", (m * (1 - m)).alias("var"), (F.col("_blocks") / F.col("nr") - m * m).alias("cc"), ((F.col("_cols") - F.col("_blocks")) / F.col("nr")).alias("wc"), (F.col("_wr") / F.col("nr")).alias("wr"))
    return out.withColumn("check", (F.col("cc") + F.col("wc") + F.col("wr")) / F.col("var"))


def enrichment(hits: DataFrame, x: DataFrame) -> DataFrame:
    """(tf, r_frac, c_frac, t_frac, z): how much more often a motif's loci are open in the
    response than in the control.

    hits (row_id, tf), one for each locus with the motif; x (row_id, grp, w): the
    number of open cells of a locus in the response (grp 1) or control (grp 0).
    """
    total = x.agg(F.sum(F.when(F.col("grp") == 1, F.col("w"))).alias("rn"), F.sum(F.when(F.col("grp") == 0, F.col("w"))).alias("cn"))
    by = hits.join(x, "row_id").groupBy("tf").agg(F.sum(F.when(F.col("grp") == 1, F.col("w")).otherwise(0)).alias("r"), F.sum(F.when(F.col("grp") == 0, F.col("w")).otherwise(0)).alias("c"))
    r, c, rn, cn = (F.col(n).cast("double") for n in ("r", "c", "rn", "cn"))
    return by.crossJoin(F.broadcast(total)).select("tf", (r / rn).alias("r_frac"), (c / cn).alias("c_frac"), ((r + c) / (rn + cn)).alias("t_frac"), ((r / rn - c / cn) / ((r + c) / (rn + cn))).alias("z"))


def permutation_max(hits: DataFrame, x: DataFrame, nperm: int, seed: int) -> DataFrame:
    """(tf, null_max): the greatest z of each motif when loci are dealt anew to response
    and control, ``nperm`` times, in groups of the same sizes.

    Each permutation orders loci by a hash of locus, permutation and seed. The rank
    comes from counts of hash buckets and ranks within buckets, so no task sorts all
    loci of a permutation.
    """
    buckets = 64
    size = x.agg(F.count_if(F.col("grp") == 1).alias("n1"))
    p = x.select("row_id", "w", F.explode(F.sequence(F.lit(1), F.lit(nperm))).alias("perm"))
    p = p.withColumn("h", hashed("row_id", "perm", seed)).withColumn("b", F.shiftrightunsigned("h", 54))
    held = p.groupBy("perm", "b").agg(F.count("*").alias("n"))
    held = held.select("perm", "b", F.coalesce(F.sum("n").over(Window.partitionBy("perm").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    assert buckets == 1 << (60 - 54)
    rank = F.row_number().over(Window.partitionBy("perm", "b").orderBy("h", "row_id")) + F.col("before")
    dealt = p.join(held, ["perm", "b"]).withColumn("rank", rank).crossJoin(F.broadcast(size)).select("row_id", "w", "perm", (F.col("rank") <= F.col("n1")).cast("int").alias("grp"))
    total = dealt.groupBy("perm").agg(F.sum(F.when(F.col("grp") == 1, F.col("w"))).alias("rn"), F.sum(F.when(F.col("grp") == 0, F.col("w"))).alias("cn"))
    by = hits.join(dealt, "row_id").groupBy("perm", "tf").agg(F.sum(F.when(F.col("grp") == 1, F.col("w")).otherwise(0)).alias("r"), F.sum(F.when(F.col("grp") == 0, F.col("w")).otherwise(0)).alias("c"))
    seen = enrichment(hits, x).select("tf", "t_frac")
    z = (F.col("r") / F.col("rn") - F.col("c") / F.col("cn")) / F.col("t_frac")
    return by.join(total, "perm").join(seen, "tf").groupBy("tf").agg(F.max(z).alias("null_max"))


def binomial_table(pairs: DataFrame, n_a: int, n_b: int, alpha: float = 0.05, sum_across: bool = True) -> DataFrame:
    """(a, b, successes, trials, p, pval, sig) of every cell of an n_a x n_b table.

    pairs (gene, a, b): one-sided binomial tests of a cell's count. With ``sum_across``
    trials are b's rows and p is a's share of distinct genes, else trials are a's rows
    and p is b's share of rows; the level is divided by n_a or n_b. Empty cells have
    pval 1.
    """
    genes = pairs.groupBy("a").agg(F.count_distinct("gene").alias("ng"), F.count("*").alias("na"))
    rows = pairs.groupBy("b").agg(F.count("*").alias("nb"))
    spark = pairs.sparkSession
    grid = spark.range(n_a).select(F.col("id").cast("int").alias("a")).crossJoin(spark.range(n_b).select(F.col("id").cast("int").alias("b")))
    cell = pairs.groupBy("a", "b").agg(F.count("*").alias("successes"))
    tot = pairs.groupBy("a").agg(F.count_distinct("gene").alias("ng")).agg(F.sum("ng").alias("tg")).crossJoin(pairs.agg(F.count("*").alias("tb")))
    t = grid.join(cell, ["a", "b"], "left").join(genes, "a", "left").join(rows, "b", "left").crossJoin(tot).na.fill(0)
    trials, p = (F.col("nb"), F.col("ng") / F.col("tg")) if sum_across else (F.col("na"), F.col("nb") / F.col("tb"))
    t = t.select("a", "b", "successes", trials.alias("trials"), p.alias("p"))
    return t.withColumn("pval", F.when(F.col("successes") == 0, 1.0).otherwise(binomial_tail("successes", "trials", "p"))).withColumn("sig", (F.col("pval") < alpha / (n_a if sum_across else n_b)).cast("int"))


def _log_pmf(i: Column, n: Column, p: Column) -> Column:
    """ln P(X = i) for X ~ Bin(n, p), 0 < p < 1, by Stirling's series with its exact error for small counts."""
    exact = F.array(*(F.lit(math.lgamma(x + 1) - (x + 0.5) * math.log(x) + x - 0.5 * math.log(2 * math.pi) if x else 0.0) for x in range(16)))

    def error(x: Column) -> Column:
        series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / (x * x)) / (x * x)) / (x * x)) / x
        return F.when(x < 16, F.get(exact, x.cast("int"))).otherwise(series)

    rest = n - i
    inner = error(n) - error(i) - error(rest) - i * F.ln(i / (n * p)) - rest * F.ln(rest / (n * (1 - p))) + 0.5 * F.ln(n / (2 * math.pi * i * rest))
    return F.when(i <= 0, n * F.log1p(-p)).when(rest <= 0, n * F.ln(p)).otherwise(inner)


def binomial_tail(k: str, n: str, p: str) -> Column:
    """P(X >= k) for X ~ Bin(n, p), summed from its largest term.

    Above the mean that is the term at k, and terms go up from it; else 1 less the terms
    from k - 1 down. Terms are relative to the first, whose logarithm is taken, so none
    is lost to underflow. Past 12 standard deviations and 60 places from the first, what
    is left is below a double's precision of the sum.
    """
    kk, nn, pp = F.col(k).cast("double"), F.col(n).cast("double"), F.col(p)
    odds = pp / (1 - pp)
    up = kk > nn * pp
    at = F.when(up, kk).otherwise(kk - 1)
    far = F.ceil(12 * F.sqrt(nn * pp * (1 - pp))) + 60
    many = F.least(F.when(up, nn - kk).otherwise(at), far.cast("double")).cast("long")
    steps = F.when(many > 0, F.sequence(F.lit(0).cast("long"), many - 1)).otherwise(F.array().cast("array<bigint>"))

    def step(acc: Column, j: Column) -> Column:
        ratio = F.when(up, (nn - at - j) / (at + j + 1) * odds).otherwise((at - j) / (nn - at + j + 1) / odds)
        t = acc["t"] * ratio
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

    total = F.aggregate(steps, F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), step)["s"]
    side = F.least(F.exp(_log_pmf(at, nn, pp) + F.ln(total)), F.lit(1.0))
    tail = F.when(up, side).otherwise(1 - side)
    return F.when(F.col(k) <= 0, 1.0).when(F.col(k) > F.col(n), 0.0).when(pp >= 1, 1.0).when(pp <= 0, 0.0).otherwise(tail)


def ranks(values: DataFrame, group: list[str], value: str, ties: list[str], name: str = "rank", buckets: int = 128) -> DataFrame:
    """Rows with their rank 1, 2, ... by value and ties within a group.

    A group may hold a large part of all rows: its values are cut into buckets at
    approximate quantiles, rows are ranked within buckets, and the rows of earlier
    buckets are added. No task sorts a whole group.
    """
    probs = F.lit([i / buckets for i in range(1, buckets)])
    cuts = values.groupBy(*group).agg(F.array_distinct(F.percentile_approx(value, probs, F.lit(20 * buckets))).alias("_cuts"))
    held = values.join(cuts, group).withColumn("_b", F.size(F.filter("_cuts", lambda c: c <= F.col(value)))).drop("_cuts")
    sizes = held.groupBy(*group, "_b").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*group, "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(*group, "_b").orderBy(value, *ties))
    return held.join(sizes, [*group, "_b"]).withColumn(name, own + F.col("_before")).select(*values.columns, name)


def standing(values: DataFrame, value: str, buckets: int = 128) -> DataFrame:
    """(value, n, bucket, upto, sum_upto) of each distinct value: its number of rows, how many rows
    have it or a lesser one, and the sum of the values of these. Nulls are left out.

    Values are cut into buckets at approximate quantiles; sums run within buckets and go on
    from one row for each earlier bucket, so no task sorts all values. The counts are a
    written table.
    """
    distinct = written(values.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n")), "standing")
    probs = F.lit([i / buckets for i in range(1, buckets)])
    cuts = distinct.agg(F.array_distinct(F.percentile_approx(value, probs, F.lit(20 * buckets))).alias("_cuts"))
    held = distinct.crossJoin(F.broadcast(cuts)).withColumn("bucket", F.size(F.filter("_cuts", lambda c: c <= F.col(value)))).drop("_cuts")  # one row
    mass = F.col("n") * F.col(value).cast("double")
    sizes = held.groupBy("bucket").agg(F.sum("n").alias("_n"), F.sum(mass).alias("_s"))
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    sizes = sizes.select("bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n"), F.coalesce(F.sum("_s").over(earlier), F.lit(0.0)).alias("_s"))
    own = Window.partitionBy("bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = held.withColumn("_on", F.sum("n").over(own)).withColumn("_os", F.sum(mass).over(own)).join(sizes, "bucket")
    return run.select(value, "n", "bucket", (F.col("_on") + F.col("_n")).alias("upto"), (F.col("_os") + F.col("_s")).alias("sum_upto"))


def quantile_normalise(values: DataFrame) -> DataFrame:
    """(row_id, col_id, q): each column's values replaced by the mean over columns of the
    values of the same rank; tied values get the mean of their ranks' means."""
    logged = values.select("row_id", "col_id", F.log2(1 + F.col("v")).alias("v"))
    ranked = ranks(logged, ["col_id"], "v", ["row_id"], "r")
    mean = ranked.groupBy("r").agg(F.avg("v").alias("m"))
    met = ranked.join(mean, "r")
    tied = met.groupBy("col_id", "v").agg(F.avg("m").alias("q"))
    return met.select("row_id", "col_id", "v").join(tied, ["col_id", "v"]).select("row_id", "col_id", "q")


def separation(values: DataFrame) -> DataFrame:
    """(gene, sep): lower quartile of the response minus upper quartile of the control."""
    q = lambda g, p: F.percentile(F.when(F.col("grp") == g, F.col("v")), F.lit(p))
    return values.groupBy("gene").agg((q(1, 0.25) - q(0, 0.75)).alias("sep"))


#: Cells of a stretch of peaks by samples, and of sums, that a task holds at once.
HELD_CELLS = 1 << 20


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays), kind))


def _stretches(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """(key, rows) of sorted rows, the first ``n_keys`` columns being the key."""
    now, held = None, []
    for b in batches:
        keys = list(zip(*(b.column(i).to_pylist() for i in range(n_keys)), strict=True))
        cuts = [i for i in range(b.num_rows) if i == 0 or keys[i] != keys[i - 1]]
        for i, j in zip(cuts, [*cuts[1:], b.num_rows], strict=True):
            if held and keys[i] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = keys[i]
            held.append(b.slice(i, j - i))
    if held:
        yield now, pa.Table.from_batches(held)


def _moved(offsets: list[int], length: int, schema: pa.Schema):
    """Of stretches of ``length`` places of bins (bin, size, stretch, place, tfs, cols, n): their cells as
    run -1, and for each run the places, within the stretch where they come to lie, of each motif's peaks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, many = [], 0

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            lists = [_lists(c, f.type.value_type) for c, f in zip(cols[3:], list(schema)[3:], strict=True)]
            return pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(cols[:3], schema, strict=False)), *lists], schema=schema)

        for (bin_, size, stretch), rows in _stretches(batches, 3):
            rows = rows.combine_chunks()
            place = rows.column("place").to_numpy()
            flat = lambda c: (c.flatten().to_numpy(zero_copy_only=False), np.diff(c.offsets.to_numpy()))
            (tf, hits), (col, cells), (n, _) = (flat(pa.concat_arrays(rows.column(c).chunks)) for c in ("tfs", "cols", "n"))
            none = np.zeros(0, np.int32)
            out.append((bin_, stretch, -1, col, none, np.repeat(place % length, cells).astype(np.int16), n))
            many += 2 * len(n)
            order = np.argsort(tf, kind="stable")
            tf, of = tf[order], np.repeat(place, hits)[order]
            for r, off in enumerate(offsets):
                to = (of + off % size) % size
                where = to // length
                for k in np.unique(where).tolist():
                    mine = where == k
                    who, at = tf[mine], (to[mine] - k * length).astype(np.int16)
                    # Of bounded length: sums of a motif that is cut add up later.
                    for i in range(0, len(who), length):
                        some = who[i : i + length]
                        first = np.flatnonzero(np.r_[True, some[1:] != some[:-1]])
                        out.append((bin_, k, r, some[first], np.diff(np.r_[first, len(some)]).astype(np.int32), at[i : i + length], n[:0]))
                        many += len(some)
                        if many > HELD_CELLS:
                            yield batch()
                            out, many = [], 0
        if out:
            yield batch()

    return run


def _summed(length: int, n_cols: int, schema: pa.Schema):
    """(run, tf, sums of each column) of what ``_moved`` gives, sorted by bin, stretch and run."""
    number = schema.field("y").type.value_type.to_pandas_dtype()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, key, pending, many = np.zeros((length, n_cols), number), None, [], 0

        def added() -> tuple[np.ndarray, np.ndarray]:
            keys = np.concatenate([k for k, _ in pending])
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            return keys[first], np.add.reduceat(np.concatenate([s for _, s in pending])[order], first, axis=0)

        def batch(keys: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, sums.size + 1, n_cols, dtype=np.int32)), pa.array(sums.ravel()))
            return pa.RecordBatch.from_arrays([pa.array((keys >> 32).astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32)), lists], schema=schema)

        for b in batches:
            array = lambda c, i: b.column(c)[i].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
            for i in range(b.num_rows):
                bin_, stretch, r = (b.column(c)[i].as_py() for c in range(3))
                who, at = array(3, i), array(5, i)
                if r < 0:
                    key = (bin_, stretch)
                    cells[:] = 0
                    np.add.at(cells, (at, who), array(6, i))
                    continue
                if key != (bin_, stretch):
                    raise RuntimeError("places without their stretch")
                sizes = array(4, i)
                sums = np.add.reduceat(cells[at], np.cumsum(sizes) - sizes, axis=0)
                pending.append(((r << 32) + who.astype(np.int64), sums))
                many += sums.size
                if many > HELD_CELLS:
                    pending = [added()]
                    many = pending[0][1].size
                    if 2 * many > HELD_CELLS:
                        yield batch(*pending[0])
                        pending, many = [], 0
        if pending:
            yield batch(*added())

    return run


def _numbered(names: DataFrame, name: str, number: str) -> DataFrame:
    """(name, number from 0) of the few names of a matrix's rows or columns."""
    return names.select(name, (F.row_number().over(Window.orderBy(name)) - 1).alias(number))


def deviations(counts: DataFrame, hits: DataFrame, gc: DataFrame, offsets: list[int], seed: int, gc_bins: int = 10) -> DataFrame:
    """(tf, sample, deviation, z): how far a motif's peaks are from what their totals lead to
    expect in a sample, against background peaks of like GC share and accessibility.

    counts (peak, sample, n) sparse; hits (peak, tf); gc (peak, gc in 0..1). The raw deviation
    of a motif in a sample is (seen - expected) / expected, expected being the sample's
    share of all counts times the counts of the motif's peaks. Peaks are binned by GC share
    and by the log2 of their counts; for each of ``offsets`` every peak is replaced by the
    one so many places further in its bin, in an order of hashes. ``deviation`` is the raw
    one less the backgrounds' mean, ``z`` that over their standard deviation.

    A bin is cut into stretches of some BLOCK_ROWS places. For each run the places of a
    motif's peaks, two bytes each, go to the stretches where they come to lie and are
    added up there, so no peak is a row of its own for each run. Tasks are as many as
    counts and places need.
    """
    spark = counts.sparkSession
    ship(spark)
    number = T.LongType() if isinstance(counts.schema["n"].dataType, T.IntegralType) else T.DoubleType()
    counts = written(counts.select("peak", "sample", "n"), "deviations")
    every = counts.agg(F.sum("n").alias("all"))
    share = counts.groupBy("sample").agg(F.sum("n").alias("c")).crossJoin(F.broadcast(every)).select("sample", (F.col("c") / F.col("all")).alias("share"))
    columns, motifs = written(_numbered(share, "sample", "col"), "samples"), written(_numbered(hits.select("tf").distinct(), "tf", "motif"), "motifs")
    n_cells, n_cols = counts.count(), max(columns.count(), 1)
    named = counts.join(F.broadcast(columns.withColumnRenamed("sample", "_s")), F.col("sample").eqNullSafe(F.col("_s")))
    cell = F.struct("col", F.coalesce(F.col("n").cast(number), F.lit(0).cast(number)).alias("n"))
    by_peak = tasks_for(spark, n_cells)
    wide = named.repartition(by_peak, "peak").groupBy("peak").agg(F.sum("n").alias("s"), F.collect_list(cell).alias("cells"))
    wide = written(wide, "deviations")
    level = F.least(F.floor(F.col("gc") * gc_bins), F.lit(gc_bins - 1)) * 100 + F.floor(F.log2(1 + F.col("s")))
    binned = written(wide.select("peak", "s").join(gc, "peak").select("peak", level.cast("long").alias("bin"), hashed("peak", seed).alias("h")), "bins")
    binned = written(ranks(binned, ["bin"], "h", ["peak"]), "places")
    sizes = binned.groupBy("bin").agg(F.count("*").alias("size"))
    sized = binned.join(F.broadcast(sizes), "bin").select("peak", "bin", "size", (F.col("rank") - 1).cast("long").alias("place"))  # a row a bin
    of = hits.join(F.broadcast(motifs.withColumnRenamed("tf", "_t")), F.col("tf").eqNullSafe(F.col("_t"))).select("peak", "motif")
    of = of.repartition(by_peak, "peak").groupBy("peak").agg(F.collect_set("motif").alias("tfs"))

    length = max(1, min(BLOCK_ROWS, HELD_CELLS // n_cols, 1 << 15))
    runs = [0, *offsets]  # run 0 has the peaks themselves
    tasks = tasks_for(spark, n_cells + hits.count() * len(runs) // 4)
    laid = sized.repartition(by_peak, "peak").join(wide.select("peak", "cells").repartition(by_peak, "peak"), "peak").join(of, "peak", "left")
    laid = laid.select("bin", "size", F.expr(f"place div {length}").alias("stretch"), "place", F.coalesce("tfs", F.array().cast("array<int>")).alias("tfs"), F.col("cells.col").alias("cols"), F.col("cells.n").alias("n"))
    laid = laid.repartition(tasks, "bin", "stretch").sortWithinPartitions("bin", "size", "stretch", "place")
    kind = T.StructType().add("bin", T.LongType()).add("stretch", T.LongType()).add("run", T.IntegerType())
    for name, element in (("who", T.IntegerType()), ("sizes", T.IntegerType()), ("at", T.ShortType()), ("n", number)):
        kind = kind.add(name, T.ArrayType(element))
    moved = laid.mapInArrow(_moved(runs, length, to_arrow_schema(kind)), kind)
    moved = moved.repartition(tasks, "bin", "stretch").sortWithinPartitions("bin", "stretch", "run")
    kind = T.StructType().add("run", T.IntegerType()).add("motif", T.IntegerType()).add("y", T.ArrayType(number))
    sums = moved.mapInArrow(_summed(length, n_cols, to_arrow_schema(kind)), kind).select("run", "motif", F.posexplode("y").alias("col", "y"))
    sums = written(sums.groupBy("run", "motif", "col").agg(F.sum("y").alias("y")), "deviations")
    seen = sums.join(F.broadcast(motifs), "motif").join(F.broadcast(columns), "col").select("run", "tf", "sample", "y")
    held = sums.groupBy("run", "motif").agg(F.sum("y").alias("held")).join(F.broadcast(motifs), "motif").select("run", "tf", "held")
    grid = held.crossJoin(F.broadcast(share)).join(seen, ["run", "tf", "sample"], "left")  # samples are columns of the matrix
    expected = F.col("share") * F.col("held")
    raw = grid.select("run", "tf", "sample", ((F.coalesce("y", F.lit(0)) - expected) / expected).alias("d"))
    own, back = F.max(F.when(F.col("run") == 0, F.col("d"))), F.when(F.col("run") > 0, F.col("d"))
    both = raw.groupBy("tf", "sample").agg(own.alias("own"), F.avg(back).alias("mean"), F.stddev_samp(back).alias("sd"))
    return both.select("tf", "sample", (F.col("own") - F.col("mean")).alias("deviation"), F.when(F.col("sd") > 0, (F.col("own") - F.col("mean")) / F.col("sd")).alias("z"))
