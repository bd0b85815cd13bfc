"""Searches for column clusters on sufficient statistics (row cluster x column).

A search sees one small table: n and sum for each row cluster and column (tens by
some hundred), collected once and sent to tasks. What is parallel are the starts and
the numbers of clusters; each is one row of a work table, seeded by its own key, so
a lost task gives the same result when it runs again.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.operators import matrix as mx
from strandframe.runtime import ship, written

#: The statistics table may have so many cells at most (16 bytes each).
MAX_CELLS = 4_000_000


@dataclass
class Table:
    """n (row clusters) and s (row clusters x columns)."""

    n: np.ndarray
    s: np.ndarray

    @classmethod
    def collect(cls, stats: DataFrame) -> Table:
        size = stats.agg(F.count_distinct("cluster").alias("r"), F.count_distinct("col_id").alias("c")).first()
        if size.r * size.c > MAX_CELLS:
            raise ValueError(f"{size.r} x {size.c} statistics are too many for a search on one machine")
        p = stats.select("cluster", "col_id", "n", "s").toPandas()
        s = p.pivot(index="cluster", columns="col_id", values="s").sort_index().sort_index(axis=1)
        return cls(p.groupby("cluster")["n"].first().sort_index().to_numpy(float), s.to_numpy(float))

    def sse(self, labels: np.ndarray) -> float:
        """Residual of 0/1 data around block means: sum of s - s*s/n over blocks."""
        k = int(labels.max()) + 1
        member = np.zeros((len(labels), k))
        member[np.arange(len(labels)), labels] = 1
        block = self.s @ member
        cells = np.outer(self.n, member.sum(axis=0))
        return float(self.s.sum() - (block * block / np.maximum(cells, 1)).sum())


    def sums(self) -> Table | Sums:
        """What ``sse`` needs: the table, or where it has more rows than columns its products of columns."""
        return self if len(self.n) <= self.s.shape[1] else Sums(float(self.s.sum()), self.s.T @ (self.s / self.n[:, None]))


@dataclass
class Sums:
    """The sum of all s, and sums over row clusters of s_a * s_b / n for columns a and b: the residual of any column
    clusters comes from these, so a search takes as long for many row clusters as for a few."""

    total: float
    products: np.ndarray

    @classmethod
    def collect(cls, stats: DataFrame, tasks: int = 64) -> Sums:
        """Of (cluster, col_id, n, s), which has every column of each cluster; only sums of tasks reach the driver."""
        wide = stats.groupBy("cluster").agg(F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("col_id", "s"))), lambda x: x["s"].cast("double")).alias("s"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, products = 0.0, 0.0
            for b in batches:
                if b.num_rows:
                    s = b.column(2).flatten().to_numpy().reshape(b.num_rows, -1)
                    total, products = total + s.sum(), products + s.T @ (s / b.column(1).to_numpy().astype(float)[:, None])
            if np.ndim(products):
                yield pa.RecordBatch.from_arrays([b.column(0)[:1].cast(pa.int64()), pa.array([total]), pa.array([products.ravel().tolist()])], ["first", "total", "products"])

        ship(stats.sparkSession)
        # Sums are added up in one order whichever task ends first.
        found = wide.repartition(tasks, "cluster").sortWithinPartitions("cluster").mapInArrow(run, "first long, total double, products array<double>").collect()
        found.sort(key=lambda r: r.first)
        if not found:
            raise ValueError("no row clusters")
        n = math.isqrt(len(found[0].products))
        return cls(sum(r.total for r in found), np.sum([r.products for r in found], axis=0).reshape(n, n))

    def sums(self) -> Sums:
        return self

    def sse(self, labels: np.ndarray) -> float:
        """Residual of 0/1 data around block means."""
        member = np.zeros((len(labels), int(labels.max()) + 1))
        member[np.arange(len(labels)), labels] = 1
        inside = ((self.products @ member) * member).sum(axis=0)
        return float(self.total - (inside / np.maximum(member.sum(axis=0), 1)).sum())


@dataclass
class Tree:
    """parent[v] (-1 at the root); vertices are columns."""

    parent: list[int]
    children: list[list[int]] = field(init=False)
    order: list[int] = field(init=False)

    def __post_init__(self) -> None:
        self.children = [[] for _ in self.parent]
        for v, p in enumerate(self.parent):
            if p >= 0:
                self.children[p].append(v)
        root = [v for v, p in enumerate(self.parent) if p < 0]
        if len(root) != 1:
            raise ValueError("the tree needs one root")
        self.order = root[:]
        for v in self.order:
            self.order.extend(self.children[v])

    @property
    def internal(self) -> list[int]:
        return [v for v in range(len(self.parent)) if self.children[v]]

    def qualified(self) -> list[int]:
        """Non-root vertices with over one vertex below and a sibling."""
        below = [0] * len(self.parent)
        for v in reversed(self.order[1:]):
            below[self.parent[v]] += 1 + below[v]
        return [v for v in self.order[1:] if below[v] > 1 and len(self.children[self.parent[v]]) > 1]

    def labels(self, cuts: list[frozenset[int]]) -> np.ndarray:
        """Components when the edges above each group's children are cut and the group is
        joined; numbered by least vertex."""
        group = {c: g for g, cut in enumerate(cuts) for c in cut}
        own = [-1] * len(self.parent)
        for v in self.order:
            own[v] = group.get(v, own[self.parent[v]] if self.parent[v] >= 0 else -1)
        names: dict[int, int] = {}
        return np.asarray([names.setdefault(g, len(names)) for g in own])

    def cuts(self, labels: np.ndarray) -> list[frozenset[int]]:
        """The groups of cut children that give ``labels`` (cluster of the root left out)."""
        base = labels[self.order[0]]
        found: dict[int, set[int]] = {}
        for v in self.order[1:]:
            if labels[v] != labels[self.parent[v]] and labels[v] != base:
                found.setdefault(int(labels[v]), set()).add(v)
        return [frozenset(found[k]) for k in sorted(found)]


class TreeSearch:
    """Local search for K components of a tree with least residual.

    A state is K - 1 groups of children, each group below one vertex. Moves regroup
    the children of one vertex (add, remove, hand over: the best one that helps), or
    take a whole group to another vertex (the first in random order that helps).
    """

    def __init__(self, tree: Tree, table: Table, rng: np.random.Generator) -> None:
        self.tree, self.table, self.rng = tree, table, rng

    def loss(self, cuts: list[frozenset[int]]) -> float:
        return self.table.sse(self.tree.labels(cuts))

    def random_start(self, k: int) -> list[frozenset[int]]:
        """K - 1 internal vertices, uniformly; all edges below each are one group."""
        at = self.rng.choice(self.tree.internal, k - 1, replace=False)
        return [frozenset(self.tree.children[v]) for v in at]

    def _at(self, cuts: list[frozenset[int]], v: int) -> list[int]:
        return [i for i, c in enumerate(cuts) if self.tree.parent[next(iter(c))] == v]

    def _regroupings(self, cuts: list[frozenset[int]], v: int) -> Iterator[list[frozenset[int]]]:
        mine = self._at(cuts, v)
        if len(self.tree.children[v]) < 2:
            return
        free = [c for c in self.tree.children[v] if not any(c in cuts[i] for i in mine)]

        def swap(**new: frozenset[int]) -> list[frozenset[int]]:
            return [new.get(f"g{i}", c) for i, c in enumerate(cuts)]

        for c, i in itertools.product(free, mine):
            yield swap(**{f"g{i}": cuts[i] | {c}})
        for i in mine:
            if len(cuts[i]) > 1:
                for c in sorted(cuts[i]):
                    yield swap(**{f"g{i}": cuts[i] - {c}})
                    for j in mine:
                        if j != i:
                            yield swap(**{f"g{i}": cuts[i] - {c}, f"g{j}": cuts[j] | {c}})

    def regroup(self, cuts: list[frozenset[int]], v: int, loss: float) -> tuple[list[frozenset[int]], float]:
        """The best regrouping at v, again and again while it helps."""
        while True:
            tried = [(self.loss(c), n, c) for n, c in enumerate(self._regroupings(cuts, v))]
            if not tried or min(tried)[0] >= loss - 1e-9:
                return cuts, loss
            loss, _, cuts = min(tried)

    def carry(self, cuts: list[frozenset[int]], i: int, v: int, loss: float) -> tuple[list[frozenset[int]], float] | None:
        """Group i begun anew below v, if the residual then falls."""
        mine = self._at(cuts, v)
        free = [c for c in self.tree.children[v] if not any(c in cuts[j] for j in mine)]
        new = list(cuts)
        if free:
            new[i] = frozenset([int(self.rng.choice(free))])
        else:
            spare = [(j, c) for j in mine if len(cuts[j]) > 1 for c in sorted(cuts[j])]
            if not spare:
                return None
            j, c = spare[int(self.rng.integers(len(spare)))]
            new[j], new[i] = cuts[j] - {c}, frozenset([c])
        new, got = self.regroup(new, v, self.loss(new))
        return (new, got) if got < loss - 1e-9 else None

    def optimise(self, cuts: list[frozenset[int]]) -> tuple[list[frozenset[int]], float]:
        """Carry groups about, each in turn, until a round changes nothing."""
        loss = self.loss(cuts)
        while True:
            before = loss
            for i in self.rng.permutation(len(cuts)):
                at = self.tree.parent[next(iter(cuts[i]))]
                for v in self.rng.permutation([u for u in self.tree.internal if u != at]):
                    moved = self.carry(cuts, int(i), int(v), loss)
                    if moved:
                        cuts, loss = self.regroup(*(moved[0], at, moved[1]))
                        break
            if loss >= before - 1e-9:
                return cuts, loss


FIT = "k int, start_id int, generated string, residual double, assignment array<int>"


def _spread(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Work items, one in each partition as far as the cluster's slots go."""
    return spark.createDataFrame(rows, schema).repartition(max(1, min(len(rows), 4 * spark.sparkContext.defaultParallelism)))


def random_starts(spark: SparkSession, tree: Tree, table: Table | Sums, ks: list[int], n: int, seed: int = 0) -> DataFrame:
    sent = spark.sparkContext.broadcast((tree, table.sums()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, i in zip(b["k"], b["start_id"], strict=True):
                search = TreeSearch(*sent.value, np.random.default_rng([seed, k, i]))
                cuts = search.random_start(int(k))
                out.append((k, i, "random", search.loss(cuts), search.tree.labels(cuts).tolist()))
            yield pd.DataFrame(out, columns=["k", "start_id", "generated", "residual", "assignment"])

    return _spread(spark, [(k, i) for k in ks for i in range(n)], "k int, start_id int").mapInPandas(run, FIT)


def scored_cuts(spark: SparkSession, tree: Tree, table: Table | Sums, k: int) -> DataFrame:
    """(combo, residual) of every choice of k - 1 qualified vertices; the choices are
    named by number and made in the tasks."""
    spots = tree.qualified()
    total = math.comb(len(spots), k - 1)
    sent = spark.sparkContext.broadcast((tree, table.sums(), spots))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, table, spots = sent.value
        for b in batches:
            combos = [_nth(spots, k - 1, int(i)) for i in b["id"]]
            yield pd.DataFrame({"combo": combos, "residual": [table.sse(tree.labels([frozenset([v]) for v in c])) for c in combos]})

    return spark.range(total).mapInPandas(run, "combo array<int>, residual double")


def _nth(items: list[int], size: int, i: int) -> list[int]:
    """The i-th combination in lexicographic order."""
    out, a = [], 0
    while size:
        c = math.comb(len(items) - a - 1, size - 1)
        if i < c:
            out.append(items[a])
            size -= 1
        else:
            i -= c
        a += 1
    return out


def ranked_cuts(tree: Tree, table: Table, spots: list[int], size: int) -> Iterator[tuple[float, tuple[int, ...]]]:
    """(residual, choice) of the choices of ``size`` spots, in this order, as far as they are asked for.

    Best first: a node has taken some spots and passed over others; its bound is the
    residual with all spots cut that it has not passed over. That parts the columns
    finer than any of its choices, so none of them has less. Spots whose cut is worth most
    are decided first, as passing over one of them raises the bound at once.
    """

    def residual(mask: int) -> float:
        return table.sse(tree.labels([frozenset([v]) for i, v in enumerate(spots) if mask >> i & 1]))

    if size > len(spots):
        return
    every = (1 << len(spots)) - 1
    turn = sorted(range(len(spots)), key=lambda i: -residual(every & ~(1 << i)))
    undecided = [0] * (len(spots) + 1)
    for j in range(len(spots) - 1, -1, -1):
        undecided[j] = undecided[j + 1] | 1 << turn[j]
    # (bound, leaf or not, choice, taken, first undecided): at equal numbers nodes go first,
    # so that all choices of a residual are there before the first of them is given.
    heap: list[tuple] = [(-math.inf, 0, (), 0, 0)]
    while heap:
        low, leaf, choice, taken, at = heapq.heappop(heap)
        if leaf:
            yield low, choice
            continue
        lacking = size - taken.bit_count() - 1
        if lacking < 0:  # no spot is asked for
            heapq.heappush(heap, (residual(0), 1, (), 0, at))
            continue
        for j in range(at, len(spots) - lacking):
            mask = taken | 1 << turn[j]
            if lacking:
                bound = residual(mask | undecided[j + 1])
                heapq.heappush(heap, (bound - 1e-9 * abs(bound), 0, (), mask, j + 1))
            else:
                picked = tuple(v for i, v in enumerate(spots) if mask >> i & 1)
                heapq.heappush(heap, (residual(mask), 1, picked, mask, j + 1))


def diverse_cuts(tree: Tree, table: Table, size: int, n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The best choice, then again and again the best of those without a spot taken before;
    where none is left, filled up to n by residual."""
    spots = tree.qualified()
    taken: list[tuple[float, tuple[int, ...]]] = []
    used: set[int] = set()
    while len(taken) < n:
        best = next(ranked_cuts(tree, table, [v for v in spots if v not in used], size), None)
        if best is None:
            break
        taken.append(best)
        if not size:
            break
        used |= set(best[1])
    if len(taken) < n:
        others = (x for x in ranked_cuts(tree, table, spots, size) if x not in taken)
        taken += list(itertools.islice(others, n - len(taken)))
    return taken


def smart_starts(spark: SparkSession, tree: Tree, table: Table | Sums, ks: list[int], n: int) -> DataFrame:
    """Per k the n cut choices of ``diverse_cuts``, each k in a task of its own; none for a k
    that asks for more cuts than there are qualified vertices."""
    sent = spark.sparkContext.broadcast((tree, table.sums()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, table = sent.value
        for b in batches:
            out = []
            for k in b["k"]:
                for i, (r, choice) in enumerate(diverse_cuts(tree, table, int(k) - 1, n)):
                    out.append((k, i, "cut", r, tree.labels([frozenset([v]) for v in choice]).tolist()))
            yield pd.DataFrame(out, columns=["k", "start_id", "generated", "residual", "assignment"])

    return _spread(spark, [(k,) for k in ks], "k int").mapInPandas(run, FIT)


def fits(starts: DataFrame, tree: Tree, table: Table | Sums, seed: int = 0) -> DataFrame:
    """Every start brought to a local optimum, one task for each as slots allow."""
    spark = starts.sparkSession
    sent = spark.sparkContext.broadcast((tree, table.sums()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                search = TreeSearch(*sent.value, np.random.default_rng([seed, r.k, r.start_id]))
                cuts, loss = search.optimise(search.tree.cuts(np.asarray(r.assignment)))
                out.append((r.k, r.start_id, r.generated, loss, search.tree.labels(cuts).tolist()))
            yield pd.DataFrame(out, columns=["k", "start_id", "generated", "residual", "assignment"])

    return starts.repartition(max(1, 4 * spark.sparkContext.defaultParallelism), "k", "start_id", "generated").mapInPandas(run, FIT)


def best_fits(found: DataFrame) -> DataFrame:
    """(k, residual, assignment) of least residual; ties by assignment."""
    return found.groupBy("k").agg(F.min(F.struct("residual", "assignment")).alias("b")).select("k", "b.residual", "b.assignment")


def complete_linkage(gram: np.ndarray, k: int) -> np.ndarray:
    """k clusters of columns from inner products, by complete linkage; numbered by least column."""
    sq = np.diag(gram)
    d = np.maximum(sq[:, None] + sq[None] - 2 * gram, 0.0)
    groups = [[i] for i in range(len(d))]
    far = d.copy()
    np.fill_diagonal(far, np.inf)
    alive = list(range(len(d)))
    while len(alive) > k:
        sub = far[np.ix_(alive, alive)]
        i, j = np.unravel_index(int(np.argmin(sub)), sub.shape)
        a, b = sorted((alive[i], alive[j]))
        groups[a] += groups[b]
        far[a] = np.maximum(far[a], far[b])
        far[:, a] = far[a]
        far[a, a] = np.inf
        alive.remove(b)
    labels = np.empty(len(d), int)
    for n, a in enumerate(sorted(alive, key=lambda a: min(groups[a]))):
        labels[groups[a]] = n
    return labels


def gram_table(cells: DataFrame) -> DataFrame:
    """(c1, c2, n): rows with a 1 in both columns, from one list of ones for each row."""
    rows = cells.where("x = 1").groupBy("row_id").agg(F.array_sort(F.collect_list("col_id")).alias("on"))
    pairs = rows.select(F.explode("on").alias("c1"), "on").select("c1", F.explode("on").alias("c2"))
    return pairs.groupBy("c1", "c2").agg(F.count("*").alias("n"))


#: Tables with more cells than this are not taken to the driver.
DRIVER_CELLS = 50_000_000


def gram_matrix(cells: DataFrame, n_cols: int) -> np.ndarray:
    """``gram_table`` as a matrix on the driver: its size is known from the columns alone."""
    if n_cols * n_cols > DRIVER_CELLS:
        raise ValueError(f"{n_cols} columns: the products of all pairs are too many for the driver")
    g = gram_table(cells).toPandas()
    gram = np.zeros((n_cols, n_cols))
    gram[g["c1"], g["c2"]] = g["n"]
    return gram


def scalar_kmeans(table: Table, labels: np.ndarray, rounds: int = 1000) -> tuple[np.ndarray, float]:
    """Columns go to the block means nearest to them until the residual stays."""
    labels, loss = labels.copy(), table.sse(labels)
    for _ in range(rounds):
        k = int(labels.max()) + 1
        mean = np.stack([table.s[:, labels == c].sum(axis=1) / np.maximum(table.n * (labels == c).sum(), 1) for c in range(k)], axis=1)
        cost = table.s.sum(axis=0)[:, None] - 2 * table.s.T @ mean + (table.n[:, None] * mean**2).sum(axis=0)[None]
        new = cost.argmin(axis=1)
        new = np.unique(new, return_inverse=True)[1]
        got = table.sse(new)
        if got >= loss - 1e-9:
            return labels, loss
        labels, loss = new, got
    return labels, loss


#: So many bytes of bit-packed rows go to the driver and the tasks at most.
PACKED_BYTES = 1 << 29


def large_averages(cells: DataFrame, n_biclusters: int, restarts: int, seed: int = 0) -> DataFrame:
    """(bicluster, row_id, col_id): submatrices of 0/1 cells of large average, one after the other.

    Restarts run in tasks on the standardised matrix. A column of it has two values, so what is
    collected and sent to the tasks are rows of bits, a few bytes each: above PACKED_BYTES it
    raises. A task returns scores; the best restart is run again for its rows. Rows of a
    bicluster leave before the next one is looked for.
    """
    spark = cells.sparkSession
    ship(spark)
    ids = sorted(r.col_id for r in cells.select("col_id").distinct().collect())
    index = F.array_position(F.array(*map(F.lit, ids)), F.col("col_id")) - 1
    packed = written(mx.pack(cells.select("row_id", index.alias("col_id"), "x"), len(ids)), "packed")
    size = packed.agg(F.count("*").alias("n")).first().n * 8 * -(-len(ids) // 63)
    if size > PACKED_BYTES:
        raise ValueError(f"{size} bytes of rows: too many to send to each task")
    table = packed.select("row_id", "bits").toArrow().combine_chunks()
    rows = table.column("row_id").to_numpy()
    order = np.argsort(rows)
    words = table.column("bits").combine_chunks().flatten().to_numpy().reshape(len(rows), -1)[order]
    rows, held = rows[order], np.ascontiguousarray(words.astype("<i8")).view(np.uint8).reshape(len(rows), -1)
    m = Signs(held, np.zeros(len(ids)), np.ones(len(ids)), [64 * (c // 63) + c % 63 for c in range(len(ids))])
    m.standardise()
    m.low, m.high = (np.sign(v) * np.log1p(np.abs(v)) for v in (m.low, m.high))
    out: DataFrame | None = None
    for b in range(n_biclusters):
        if len(rows) < 2:
            break
        sent = spark.sparkContext.broadcast(m)

        def run(batches: Iterator[pd.DataFrame], b: int = b) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"id": batch["id"], "score": [_search(sent.value, np.random.default_rng([seed, b, int(i)]))[0] for i in batch["id"]]})  # noqa: B023

        work = spark.range(0, restarts, 1, max(1, min(restarts, 4 * spark.sparkContext.defaultParallelism))).mapInPandas(run, "id long, score double")
        best = work.orderBy(F.desc("score"), "id").limit(1).first()
        _, r, c = _search(m, np.random.default_rng([seed, b, best.id]))
        sent.unpersist()
        some = spark.createDataFrame(pa.table({"row_id": pa.array(rows[r])}))
        found = some.select(F.lit(b).alias("bicluster"), "row_id", F.explode(F.array(*(F.lit(ids[i]) for i in c))).alias("col_id"))
        out = found if out is None else out.unionByName(found)
        rows, m.bits = rows[~r], m.bits[~r]
        if len(rows):
            m.standardise()
    kinds = [(f, cells.schema[f].dataType.simpleString()) for f in ("row_id", "col_id")]
    if out is None:
        return spark.createDataFrame([], "bicluster int, " + ", ".join(f"{f} {k}" for f, k in kinds))
    return out.select("bicluster", *(F.col(f).cast(k).alias(f) for f, k in kinds))


@dataclass
class Signs:
    """A matrix whose column c is low[c] or high[c], as bit place[c] of a row's bytes says."""

    bits: np.ndarray
    low: np.ndarray
    high: np.ndarray
    place: list[int]

    def ones(self, some: np.ndarray | None = None) -> np.ndarray:
        """Ones of each column, in all rows or those of a mask."""
        total = np.zeros(8 * self.bits.shape[1], np.int64)
        for a in range(0, len(self.bits), 1 << 16):
            part = self.bits[a : a + (1 << 16)]
            part = part if some is None else part[some[a : a + (1 << 16)]]
            total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        return total[self.place]

    def standardise(self) -> None:
        n, ones = len(self.bits), self.ones()
        mean = self.low + (self.high - self.low) * ones / n
        sd = np.abs(self.high - self.low) * np.sqrt(ones / n * (n - ones) / max(n - 1, 1)) if n > 1 else np.ones(len(ones))
        sd = np.where(sd > 0, sd, 1.0)
        self.low, self.high = (self.low - mean) / sd, (self.high - mean) / sd

    def row_sums(self, c: np.ndarray) -> np.ndarray:
        """Of the columns c, by a table for each byte."""
        gain = np.zeros(8 * self.bits.shape[1])
        gain[np.asarray(self.place)[c]] = (self.high - self.low)[c]
        out = np.full(len(self.bits), self.low[c].sum())
        every = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
        for i, g in enumerate(gain.reshape(-1, 8)):
            if g.any():
                out += (every * g).sum(axis=1)[self.bits[:, i]]
        return out


def _search(z: Signs, rng: np.random.Generator) -> tuple[float, np.ndarray, np.ndarray]:
    """From random columns: best rows for the columns, best columns for the rows, until
    either stays as it was. Score, mask of rows, columns."""
    m, n = len(z.bits), len(z.low)
    k, width = int(rng.integers(1, max(2, m // 2 + 1))), int(rng.integers(1, n + 1))
    c = np.sort(rng.choice(n, width, replace=False))
    r = np.zeros(m, bool)
    while True:
        sums = z.row_sums(c)
        least = np.partition(sums, m - k)[m - k]
        new_r = sums > least
        new_r[np.flatnonzero(sums == least)[: k - int(new_r.sum())]] = True  # of equal rows the first
        columns = z.low * k + (z.high - z.low) * z.ones(new_r)
        new_c = np.sort(np.argsort(-columns, kind="stable")[:width])
        done = np.array_equal(new_r, r) or np.array_equal(new_c, c)
        r, c = new_r, new_c
        if done:
            break
    t = -columns[c].sum() / (k * width) * math.sqrt(k * width)
    choose = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    # 0.717 and 0.416 of an approximation to the normal tail.
    return -choose(m, k) - choose(n, width) - (math.log(0.5) - 0.717 * t - 0.416 * t * t), r, c
