"""N-gram Jaccard join: all links of similarity t or more, by a prefix tree of sets.

Documents are sets of word shingles (five words; fewer words, but not none: all of
them as one). Equal sets are one class with a number of its own, so copies are never
expanded. Classes are joined in these steps:

1. Counts. Each task sends the 64-bit shingle hashes of its classes, in flushes of
   FLUSH shingles, cut by ranges of hashes. A range is counted at a time (about
   RANGE shingles; a shingle of many classes of a flush is sent once for all of them);
   of each shingle of more than one class, the number of times that it was sent, df,
   comes back to its flush. A class that s tasks have sent shares the shingles of
   df > s with other classes; with fewer than t * size of them it has no links.
2. Global order. The shared shingles of each class are ordered by (df, hash). Two
   linked classes share a shingle among the first of each (those that lie before
   the last t * size), and from the first shared one on, enough must be left in both.
3. Candidates. Classes meet by these prefix shingles. For components, rounds of
   stars come first: each class of a shingle is tried with one leader, so a group of
   n gives n - 1 candidates. What is linked by then need not be compared again;
   a last step tries all remaining pairs of different components that share a prefix
   shingle and pass the length bounds. For ``links`` all such pairs are tried at once.
4. Trie. The candidates of a class are stored as a prefix tree over their ordered
   shingles (most frequent first, so that near copies share long paths); the class
   walks it once: overlaps of shared paths are counted once, and a subtree is left
   whole when what remains in it and in the class can't reach the least overlap that
   any of its members needs.
5. Components by large-star and small-star rounds.

Overlaps are counted on 64-bit hashes, of which two different shingles of a pair agree
by chance alone (once in 2**64). What a task holds is bounded: a flush, a range, or
candidates of WALK_BYTES. Written tables in the shared folder cut the lineage; those
that are no longer read are deleted.

Null and empty texts (no words) have size 0 and are linked with nothing. Rows that
repeat an id are one document: it is linked by any of its texts. A null id is never a
component's name, but where all its ids are null. Ids are of any type that can be
ordered. Texts are read whole; extra columns are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandframe.llm.components import as_numpy, components
from strandframe.llm.shingles import mix, shingle_sets
from strandframe.llm.token_counts import slices
from strandframe.runtime import delete_folder, fixed_order, fresh_names, shared_dir, ship, written

SLICE_BYTES, FLUSH, RANGE, CHUNK, WALK_BYTES, STAR_ROUNDS = 1 << 20, 1_000_000, 1_000_000, 256, 8 << 20, 3
NUM, DEN = 3, 4  # t = NUM / DEN


def class_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ship(docs.sparkSession)
    return fixed_order(docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")), "jaccard-texts")


def _keyed(at: int, k: int, sized: bool):
    """Batches with the class key of the text in column ``at``, and in its place the size of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [t or b"" for t in b.column(at).cast(pa.binary()).to_pylist()]
            for i, j in slices([len(t) for t in raw], SLICE_BYTES):
                sets = shingle_sets(raw[i:j], k)
                cols = b.slice(i, j - i).columns
                names = [f"c{n}" for n in range(len(cols) + 1)]
                if sized:
                    cols[at] = pa.array([len(s) for s in sets], pa.int64())
                keys = pa.array([class_key(s) if len(s) else None for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([*cols, keys], names)

    return run


def range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    """floor(h * ranges / 2**64), for fewer than 2**32 ranges."""
    n, low, top = np.uint64(ranges), h & np.uint64(0xFFFFFFFF), h >> np.uint64(32)
    return ((top * n + ((low * n) >> np.uint64(32))) >> np.uint64(32)).astype(np.int64)


def _starts(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where a new combination of values begins in columns sorted together."""
    fresh = np.zeros(len(sorted_columns[0]), bool)
    fresh[:1] = True
    for c in sorted_columns:
        fresh[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(fresh)


def _cells(values: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    """values[cuts[i]:cuts[i+1]] as bytes, all first bytes before all second ones: of
    sorted or small numbers the upper bytes then compress to almost nothing."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize)
    return [raw[a:b].T.tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def _values(cell: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(cell, np.uint8).reshape(size, -1).T).view(kind).ravel()


#: Rows between tasks. ``part`` is the task that gets the row, ``flush`` what it is about, and ``range``
#: LISTED: the flush's classes (owners: their keys, counts: the sizes of their sets);
#: GROUPED: its shingles of LEAST_GROUP classes or more (tokens, counts) with all their owners in turn;
#: else a range of hashes: shingles with their owner (a place in the flush), in order of the hashes.
#: A grouped shingle is there once with owner GROUP, and in ``counts`` in how many classes it is,
#: so a shingle of a third of all classes is counted from one entry a flush.
SENT = "part int, range long, flush long, owners binary, counts binary, tokens binary, dfs binary"
_SCHEMA = pa.schema([("part", pa.int32()), ("range", pa.int64()), ("flush", pa.int64()), *((c, pa.binary()) for c in ("owners", "counts", "tokens", "dfs"))])
LISTED, GROUPED, GROUP, LEAST_GROUP = -2, -1, 65535, 4


def _home(flush: int, parts: int) -> int:
    """The task that puts a flush's classes together again."""
    return int(mix(np.asarray([flush], np.uint64))[0] % np.uint64(parts))


def _scatter(k: int, parts: int, ranges: int):
    """Shingles of each class of a task, once, in flushes."""

    def out(flush: int, keys: list[bytes], held: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.asarray([len(s) for s in held], np.uint32)
        tokens = np.concatenate(held)
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], np.repeat(np.arange(len(held), dtype=np.uint16), sizes)[order]
        at = _starts(tokens)
        n = np.diff(np.append(at, len(tokens)))
        many = np.repeat(n >= LEAST_GROUP, n)
        home, some = _home(flush, parts), at[n >= LEAST_GROUP]
        rows = [(home, LISTED, flush, b"".join(keys), sizes.tobytes(), b"", b"")]
        if len(some):
            rows.append((home, GROUPED, flush, owner[many].tobytes(), n[n >= LEAST_GROUP].astype(np.uint32).tobytes(), tokens[some].tobytes(), b""))
        owner[some], many[some] = GROUP, False
        tokens, owner = tokens[~many], owner[~many]
        where = range_of(tokens, ranges)
        row_at = _starts(where)
        cuts = np.append(row_at, len(tokens))
        grouped = owner == GROUP
        of = np.concatenate(([0], np.cumsum(grouped)))[cuts]
        cells = (_cells(owner, cuts), _cells(n[n >= LEAST_GROUP].astype(np.uint32), of), _cells(tokens, cuts))
        rows += [(r % parts, r, flush, o, c, t, b"") for r, o, c, t in zip(where[row_at].tolist(), *cells, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        keys: list[bytes] = []
        held: list[np.ndarray] = []
        size, flush = 0, TaskContext.get().partitionId() << 32
        for b in batches:
            raw = b.column(0).cast(pa.binary()).to_pylist()
            for i, j in slices([len(t) for t in raw], SLICE_BYTES):
                for s in shingle_sets(raw[i:j], k):
                    if not len(s) or (key := class_key(s)) in seen:
                        continue
                    seen.add(key)
                    keys.append(key)
                    held.append(s)
                    size += len(s)
                    if size > FLUSH or len(held) == GROUP:
                        yield out(flush, keys, held)
                        keys, held, size, flush = [], [], 0, flush + 1
        if held:
            yield out(flush, keys, held)

    return run


def _counted(parts: int):
    """Of the rows of a task, sorted by range: what is about flushes as it is, and the shingles sent more than once."""

    def one(rows: list[tuple]) -> list[tuple]:
        flushes, owners, counts, tokens = zip(*rows, strict=True)
        token, owner = np.concatenate(tokens), np.concatenate(owners)
        weight = np.ones(len(token), np.int64)
        weight[owner == GROUP] = np.concatenate(counts)
        order = np.argsort(token, kind="stable")
        s = token[order]
        at = _starts(s)
        df = np.empty(len(s), np.uint32)
        df[order] = np.repeat(np.add.reduceat(weight[order], at), np.diff(np.append(at, len(s))))
        many = df > 1
        cuts = np.concatenate(([0], np.cumsum(many)))[np.cumsum([0, *map(len, tokens)])]
        cells = (_cells(owner[many], cuts), _cells(token[many], cuts), _cells(df[many], cuts))
        return [(_home(f, parts), 0, f, o, b"", t, d) for f, o, t, d in zip(flushes, *cells, strict=True) if o]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = LISTED, []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                r = row[1]
                if r < 0:
                    yield batch([row])
                    continue
                if r != now and held:
                    if made := one(held):
                        yield batch(made)
                    held = []
                now = r
                held.append((row[2], _values(row[3], np.uint16), _values(row[4], np.uint32), _values(row[5], np.uint64)))
        if held and (made := one(held)):
            yield batch(made)

    return run


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes that may have links: key, shingles sent more than once in global order, their df.

    Rows are sorted by flush, then by range: its classes, its groups, the counts.
    """
    now, keys, sizes, groups = None, b"", np.empty(0, np.uint32), None
    held: list[tuple] = []

    def out() -> Iterator[pa.RecordBatch]:
        owner, token, df = (np.concatenate(c) for c in zip(*held, strict=True))
        if groups is not None:
            g_owner, g_n, g_token = groups
            g_df = np.empty(len(g_token), np.uint32)
            told = owner == GROUP
            g_df[np.searchsorted(g_token, token[told])] = df[told]
            owner = np.concatenate((owner[~told], g_owner))
            token = np.concatenate((token[~told], np.repeat(g_token, g_n)))
            df = np.concatenate((df[~told], np.repeat(g_df, g_n)))
        able = DEN * np.bincount(owner, minlength=len(sizes)) >= NUM * sizes.astype(np.int64)
        keep = able[owner]
        owner, token, df = owner[keep], token[keep], df[keep]
        if not len(owner):
            return
        order = np.lexsort((token, df, owner))
        owner, token, df = owner[order], token[order], df[order]
        at = _starts(owner)
        cuts = np.append(at, len(owner)).tolist()
        table = np.frombuffer(keys, "V16")[owner[at]]
        for i in range(0, len(at), 2000):
            spans = list(zip(cuts[i : i + 2000], cuts[i + 1 : i + 2001], strict=False))
            cells = ([x.tobytes() for x in table[i : i + 2000]], [token[a:b].tobytes() for a, b in spans], [df[a:b].tobytes() for a, b in spans])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in cells], ["key", "tokens", "dfs"])

    for b in batches:
        for r, f, o, c, t, d in zip(*(b.column(i).to_pylist() for i in range(1, 7)), strict=True):
            if f != now:
                if held:
                    yield from out()
                now, held, groups = f, [], None
            if r == LISTED:
                keys, sizes = o, np.frombuffer(c, np.uint32)
            elif r == GROUPED:
                groups = np.frombuffer(o, np.uint16), np.frombuffer(c, np.uint32), np.frombuffer(t, np.uint64)
            else:
                held.append((_values(o, np.uint16), _values(t, np.uint64), _values(d, np.uint32)))
    if held:
        yield from out()


def _able(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes with t * n shingles that other classes have too: cid, n, m, shingles in global order."""
    for b in batches:
        rows: tuple[list, ...] = ([], [], [], [])
        for cid, n, s, t, d in zip(*(c.to_pylist() for c in b.columns), strict=True):
            token = np.frombuffer(t, np.uint64)[np.frombuffer(d, np.uint32) > s]
            if DEN * len(token) >= NUM * n:
                for column, x in zip(rows, (cid, n, len(token), token.tobytes()), strict=True):
                    column.append(x)
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in rows[:3]), pa.array(rows[3], pa.binary())], ["cid", "n", "m", "tokens"])


def _prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, cid, n, left): prefix shingles and how many shared ones are left from each on."""
    for b in batches:
        cid, n, m = (as_numpy(b.column(i)) for i in range(3))
        count = m - -(-NUM * n // DEN) + 1
        for i, j in slices(count.tolist(), 200_000):
            c = count[i:j]
            token = [np.frombuffer(t, np.int64, k) for t, k in zip(b.column(3).slice(i, j - i).to_pylist(), c.tolist(), strict=True)]
            place = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token)), pa.array(np.repeat(cid[i:j], c)), pa.array(np.repeat(n[i:j], c)), pa.array(np.repeat(m[i:j], c) - place)], ["token", "cid", "n", "left"])


class _Node:
    """A stretch start..end of the paths of all members below it; ``of`` is one of them."""

    __slots__ = ("children", "end", "here", "least", "longest", "of", "start")

    def __init__(self, start: int, end: int, of: int) -> None:
        self.start, self.end, self.of = start, end, of
        self.children: list[_Node] = []
        self.here: list[int] = []  # members whose path ends with this node
        self.least, self.longest = 1 << 62, 0  # size of the smallest set, length of the longest path


class SetTrie:
    """Sets in one order as a prefix tree whose nodes are the stretches between branches.

    ``sizes`` are the sizes that similarity counts (sets may lack what nothing shares).
    """

    def __init__(self, sets: list[np.ndarray], sizes: list[int]) -> None:
        self.sets, self.sizes = sets, sizes
        paths = [s.astype(">u8").tobytes() for s in sets]
        self.root = _Node(0, 0, -1)
        spine, before = [self.root], np.empty(0, np.uint64)
        for i in sorted(range(len(sets)), key=paths.__getitem__):
            s = sets[i]
            k = min(len(s), len(before))
            differ = s[:k] != before[:k]
            shared = int(np.argmax(differ)) if differ.any() else k
            last = None
            while spine[-1].end > shared:
                last = self._closed(spine.pop())
            if spine[-1].end < shared:  # the path leaves within ``last``
                middle = _Node(spine[-1].end, shared, last.of)
                middle.children, last.start = [last], shared
                spine[-1].children[-1] = middle
                spine.append(middle)
            if len(s) > shared:
                leaf = _Node(shared, len(s), i)
                spine[-1].children.append(leaf)
                spine.append(leaf)
            spine[-1].here.append(i)
            before = s
        while spine:
            self._closed(spine.pop())

    def _closed(self, node: _Node) -> _Node:
        for i in node.here:
            node.least, node.longest = min(node.least, self.sizes[i]), max(node.longest, len(self.sets[i]))
        for c in node.children:
            node.least, node.longest = min(node.least, c.least), max(node.longest, c.longest)
        return node

    def linked(self, probe: np.ndarray, size: int) -> Iterator[int]:
        """Members whose similarity to ``probe`` (in the same order, of ``size``) is t or more."""
        order = np.argsort(probe)
        ranked = probe[order]
        need = lambda n: -(-NUM * (size + n) // (NUM + DEN))
        todo = [(self.root, 0, 0)]  # a node, the overlap above it, how much of the probe lies behind
        while todo:
            node, met, behind = todo.pop()
            # At most the rest of the longest path is met, and the rest of the probe.
            if met + min(node.longest - node.start, len(probe) - behind) < need(node.least):
                continue
            if node.end > node.start and len(probe):
                stretch = self.sets[node.of][node.start : node.end]
                at = np.searchsorted(ranked, stretch)
                at[at == len(probe)] = 0
                hit = at[ranked[at] == stretch]
                if len(hit):
                    met, behind = met + len(hit), int(order[hit[-1]]) + 1
            for i in node.here:
                if met >= need(self.sizes[i]):
                    yield i
            todo += [(c, met, behind) for c in node.children]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lead, salt, kind, cid, n, tokens), sorted: a class, then its candidates' rows."""
    lead, probe, size = None, np.empty(0, np.uint64), 0
    held: tuple[list[int], list[int], list[np.ndarray]] = ([], [], [])
    weight = 0
    found: list[tuple[int, int]] = []

    def close() -> None:
        if held[0]:
            found.extend(tuple(sorted((lead[0], held[0][i]))) for i in SetTrie(held[2], held[1]).linked(probe, size))

    def pairs() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[n] for x in found], pa.int64()) for n in (0, 1)], ["a", "b"])

    for b in batches:
        for a, salt, kind, cid, n, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if lead != (a, salt) or weight > WALK_BYTES:
                close()
                held, weight, lead = ([], [], []), 0, (a, salt)
            tokens = np.frombuffer(t, np.uint64)[::-1]
            if kind == 0:
                probe, size = tokens, n
            else:
                for column, x in zip(held, (cid, n, tokens), strict=True):
                    column.append(x)
                weight += len(t) + 200
        if found:
            yield pairs()
            found = []
    close()
    if found:
        yield pairs()


class JaccardJoin:
    """The join of one table; results by ``links``, ``component_of`` and ``alike``."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5) -> None:
        self.spark, self.id_col = docs.sparkSession, id_col
        self.parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self._folders: dict[str, str] = {}
        base = _texts(docs, id_col, text_col)
        id_type = base.schema["_id"].dataType
        fields = T.StructType([T.StructField("_id", id_type), T.StructField("n", T.LongType()), T.StructField("key", T.BinaryType())])
        self.sets = self._kept(base.mapInArrow(_keyed(1, k, True), fields), "sets")
        # Classes are numbered in order of their least ids: an original mostly comes before its copies.
        classes = self.sets.where("n > 0").groupBy("key").agg(F.min("_id").alias("least"), F.first("n").alias("n")).orderBy(F.asc_nulls_last("least"), "key")
        self.classes = self._kept(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
        # Ranges follow the data, so that one is counted in the same memory at any size.
        total = self.classes.agg(F.sum("n")).first()[0] or 0
        ranges = self.parts * max(1, -(-total // (self.parts * RANGE)))
        sent = base.select("_text").where("_text <> ''").mapInArrow(_scatter(k, self.parts, ranges), SENT)
        counted = sent.repartitionById(self.parts, "part").sortWithinPartitions("range").mapInArrow(_counted(self.parts), SENT)
        back = counted.repartitionById(self.parts, "part").sortWithinPartitions("flush", "range").mapInArrow(_assembled, "key binary, tokens binary, dfs binary")
        # A class has a row for each task that sent it.
        each = back.groupBy("key").agg(F.count("*").alias("s"), F.first("tokens").alias("tokens"), F.first("dfs").alias("dfs"))
        rows = each.join(self.classes.select("key", "cid", "n"), "key").select("cid", "n", "s", "tokens", "dfs")
        self.near = self._kept(rows.mapInArrow(_able, "cid long, n long, m long, tokens binary"), "near")
        self.prefix = self.near.mapInArrow(_prefix, "token long, cid long, n long, left long")

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        folder = shared_dir(self.spark, f"jaccard-{name}")
        out = written(df, name, folder)
        self._drop(name)
        self._folders[name] = folder
        return out

    def _drop(self, name: str) -> None:
        if name in self._folders:
            delete_folder(self.spark, self._folders.pop(name))

    @staticmethod
    def _fits(n1: str, n2: str, left1: str, left2: str):
        """The bound at the first shared shingle: enough must be left in both."""
        return F.expr(f"{NUM + DEN} * least({left1}, {left2}) >= {NUM} * ({n1} + {n2}) and {DEN} * least({n1}, {n2}) >= {NUM} * greatest({n1}, {n2})")

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """Of distinct pairs (lead, cid): the links, by walking each lead's candidate tries."""
        sized = pairs.groupBy("lead").agg(F.count("*").alias("c")).select("lead", F.ceil(F.col("c") / CHUNK).cast("int").alias("salts"))
        members = pairs.join(sized, "lead").select("lead", F.pmod(F.hash("cid"), F.col("salts")).alias("salt"), "cid")
        members = members.join(self.near.select("cid", "n", "tokens"), "cid").select("lead", "salt", F.lit(1).alias("kind"), "cid", "n", "tokens")
        leads = sized.join(self.near.select(F.col("cid").alias("lead"), "n", "tokens"), "lead")
        leads = leads.select("lead", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("lead").alias("cid"), "n", "tokens")
        rows = leads.unionByName(members).repartition(self.parts, "lead", "salt").sortWithinPartitions("lead", "salt", "kind")
        return rows.mapInArrow(_walk, "a long, b long")

    def _all_links(self) -> DataFrame:
        other = self.prefix.select("token", F.col("cid").alias("cid2"), F.col("n").alias("n2"), F.col("left").alias("left2"))
        pairs = self.prefix.join(other, "token").where("cid < cid2").where(self._fits("n", "n2", "left", "left2"))
        return self._verified(pairs.select(F.col("cid").alias("lead"), F.col("cid2").alias("cid")).distinct())

    def links(self) -> DataFrame:
        """All links (a, b), a < b, between classes named by their least ids; a hot group of n
        near copies has up to n**2 / 2. Classes of null ids alone have no name and are left out."""
        named = self.classes.select("cid", "least").where("least is not null")
        x, y = named.toDF("a", "x"), named.toDF("b", "y")
        out = self._all_links().join(x, "a").join(y, "b").where("x <> y")
        return out.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    def _open(self, entries: DataFrame, seed: int) -> DataFrame:
        """Entries of the shingles whose classes are not all of one label, with a leader ``l``.

        The leaders are a written table, so the join with the entries has plain exchanges
        on both sides and a hot shingle's entries can be split.
        """
        row = F.struct("cid", "n", "left", "label")
        # The first of its group; the one with most left for its size, so the widest bound; any one.
        pick = (F.min(row), F.max_by(row, F.struct(F.col("left") / F.col("n"), -F.col("cid"))))[seed] if seed < 2 else F.min_by(row, F.xxhash64("cid", F.lit(seed)))
        groups = entries.groupBy("token").agg(pick.alias("l"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
        return entries.join(self._kept(groups.select("token", "l"), "leaders"), "token")

    def _stars(self, entries: DataFrame) -> DataFrame:
        """(lead, cid) of each class and its shingles' leaders: n - 1 for n, never all pairs."""
        met = entries.where("label <> l.label").where(self._fits("n", "l.n", "left", "l.left"))
        return met.select(F.least("cid", F.col("l.cid")).alias("lead"), F.greatest("cid", F.col("l.cid")).alias("cid")).distinct()

    def _rest(self, entries: DataFrame) -> DataFrame:
        """(lead, cid): all pairs of different components that share a prefix shingle."""
        other = entries.select("token", F.col("cid").alias("cid2"), F.col("n").alias("n2"), F.col("left").alias("left2"), F.col("label").alias("label2"))
        pairs = entries.join(other, "token").where("cid < cid2 and label <> label2").where(self._fits("n", "n2", "left", "left2"))
        return pairs.select(F.col("cid").alias("lead"), F.col("cid2").alias("cid")).distinct()

    def labels(self) -> DataFrame:
        """(cid, label) of all classes that are linked with others."""
        labels = None
        entries = self.prefix.withColumn("label", F.col("cid"))
        for step in range(STAR_ROUNDS + 1):
            # Only shingles whose classes are not yet all in one component go on.
            entries = self._kept(self._open(entries, step), "open")
            if entries.isEmpty():
                break
            pairs = self._stars(entries) if step < STAR_ROUNDS else self._rest(entries)
            new = self._kept(self._verified(pairs), "links")
            if not new.isEmpty():
                labels = self._merged(labels, new)
            entries = entries.drop("l")
            if labels is not None:
                entries = entries.drop("label").join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
        self._drop("open"), self._drop("leaders"), self._drop("links")
        return self.spark.createDataFrame([], "cid long, label long") if labels is None else labels

    def _merged(self, labels: DataFrame | None, links: DataFrame) -> DataFrame:
        """The components of former labels and further links: links are drawn between labels."""
        if labels is None:
            return self._kept(components(links).withColumnRenamed("node", "cid"), "labels")
        x, y = labels.toDF("a", "x"), labels.toDF("b", "y")
        drawn = links.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
        above = self._kept(components(drawn), "above")
        old = labels.join(above.withColumnRenamed("label", "top"), F.col("label") == F.col("node"), "left").select("cid", F.coalesce("top", "label").alias("label"))
        alone = above.join(labels.select("cid"), F.col("node") == F.col("cid"), "left_anti").select(F.col("node").alias("cid"), "label")
        out = self._kept(old.unionByName(alone), "labels")
        self._drop("above")
        return out

    def _same_ids(self) -> DataFrame:
        """Links (a, b) between the classes of an id that occurs with several texts."""
        some = self.sets.where("n > 0 and _id is not null").select("_id", "key", F.xxhash64("key").alias("h"))
        several = some.groupBy("_id").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("_id")
        of = some.join(several, "_id").select("_id", "key").join(self.classes.select("key", "cid"), "key")
        return of.join(of.groupBy("_id").agg(F.min("cid").alias("b")), "_id").where("cid <> b").select(F.col("cid").alias("a"), "b").distinct()

    def component_of(self) -> DataFrame:
        """One row for each document: id, n_shingles, component_id (its least id)."""
        labels, same = self.labels(), self._kept(self._same_ids(), "same")
        if not same.isEmpty():
            labels = self._merged(labels if "labels" in self._folders else None, same)
        named = self.classes.join(labels, "cid", "left").select("key", "least", F.coalesce("label", "cid").alias("label"))
        least = self._kept(named.groupBy("label").agg(F.min("least").alias("component")), "least")
        named = named.select("key", "label").join(least, "label").select("key", "component")
        out = self.sets.join(named, "key", "left")
        return out.select(F.col("_id").alias(self.id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "_id").alias("component_id"))

    def keepers(self) -> DataFrame:
        """(key, least) of one class of each component, by links alone: the one of its least id
        (null after all others; ties: the least key)."""
        named = self.classes.join(self.labels(), "cid", "left")
        order = F.struct(F.col("least").isNull(), "least", "key")
        return named.groupBy(F.coalesce("label", "cid").alias("label")).agg(F.min(order).alias("k")).select("k.key", "k.least")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5) -> DataFrame:
    return JaccardJoin(docs, id_col, text_col, k).component_of()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5) -> DataFrame:
    """``docs`` with one row of each group of linked or equal texts: that of its least id.

    A row goes only if its own text is linked with the text of a row that stays, by way
    of others at most; so rows that repeat an id with unlike texts all stay, and a row
    with a null id goes like any other (null comes after all ids). Texts without words
    are linked with nothing and all stay.
    """
    docs = fixed_order(docs, "jaccard-docs")
    keepers = JaccardJoin(docs.select(id_col, text_col), id_col, text_col, k).keepers()
    key, name, alone, row = fresh_names(docs, "_key", "_name", "_alone", "_row")
    place = docs.columns.index(text_col)
    own = docs.mapInArrow(_named(docs.columns, key, place, k), T.StructType([*docs.schema.fields, T.StructField(key, T.BinaryType())]))
    # Null has a name that no id has; each text without words is alone.
    said = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    own = own.withColumn(name, said(id_col)).withColumn(alone, F.when(F.col(key).isNull(), F.monotonically_increasing_id()).otherwise(F.lit(-1).cast("long")))
    own = own.withColumn(key, F.coalesce(F.col(key), F.lit(b"")))
    first = Window.partitionBy(key, name, alone).orderBy(F.xxhash64(text_col))
    one = own.withColumn(row, F.row_number().over(first)).where(F.col(row) == 1)
    stay = keepers.select(F.col("key").alias(key), said("least").alias(name), F.lit(-1).cast("long").alias(alone), F.lit(True).alias(row))
    kept = one.drop(row).join(stay, [key, name, alone], "left").where(F.col(row).isNotNull() | (F.col(alone) >= 0))
    return kept.select(*docs.columns)


def _named(columns: list[str], key: str, at: int, k: int):
    keyed = _keyed(at, k, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in keyed(batches):
            yield pa.RecordBatch.from_arrays(b.columns, [*columns, key])

    return run


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5) -> tuple[DataFrame, DataFrame]:
    """All links between class representatives, and the membership (id, rep) of documents."""
    join = JaccardJoin(docs, id_col, text_col, k)
    members = join.sets.join(join.classes.select("key", "least"), "key", "left").select(F.col("_id").alias(id_col), F.coalesce("least", "_id").alias("rep"))
    return join.links(), members
