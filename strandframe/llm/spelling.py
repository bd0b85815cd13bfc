"""Spelling variants: words at edit distance one, joined by tries and active-node sets.

Words are counted in the JVM (``counted_words``). ``near_words`` finds all pairs of
distance one (one inserted, deleted or replaced code point) in these steps:

1. Blocks. Either the edit lies behind the first HEAD code points of a pair, which
   are then equal, or within them, and then the last HEAD code points are equal. So
   each word goes to two blocks, of its head and of its tail, and each pair meets in
   one of them at least; what is left of a word in a block is its body. A block of
   more than ``limit`` words is divided again in the same way by one code point of
   its bodies, as often as it takes. Bodies of at most one code point, of which a
   block has no more than the alphabet, also meet in a block of their own.
2. Tries. A task builds the prefix tree of one block's bodies at a time and walks it
   from the root. Each node hands its active nodes, those at distance one, to its
   children: a child's are its parent, its siblings, its own children, and what its
   letter leads to from the parent's active nodes. Two words that end in a node and
   in one of its active nodes are a pair.

``spelling_variants`` gives each word the near word that is far more frequent (its
form) and follows forms to the last (its root) by doubling pointers.

Null and empty texts have no words; in rows with a null id no letter is deleted.
Repeated rows count as often as they occur. An empty table gives an empty result.
Only the two named columns are read, so extra ones of any name do no harm.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.runtime import delete_folder, shared_dir, ship, written

RUN = "[A-Za-zÀ-ÿ]+"
HEAD, BLOCK_WORDS = 3, 20_000
PAIR = "a string, an long, b string, bn long"


def counted_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 2 * HEAD, least_count: int = 5, odds: int = 199) -> DataFrame:
    """(word, n) of runs of letters, A-Z lower-cased.

    Where ``odds`` divides h, the crc32 of ``<id>:<run>``, the run lacks its code point h % length.
    """
    lowered = F.translate(F.col(text_col).cast("string"), string.ascii_uppercase, string.ascii_lowercase)
    runs = docs.select(F.col(id_col).cast("string").alias("id"), F.explode(F.regexp_extract_all(lowered, F.lit(RUN), F.lit(0))).alias("run"))
    # Only these can have enough letters with or without a deletion.
    runs = runs.where(F.length("run") >= least_length).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % odds == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


class _Node:
    __slots__ = ("children", "ends")

    def __init__(self) -> None:
        self.children: dict[str, _Node] = {}
        self.ends = -1


def trie_pairs(bodies: list[str]) -> Iterator[tuple[int, int]]:
    """(i, j) of all different bodies at distance one, each pair once; bodies are distinct."""
    root = _Node()
    for i, body in enumerate(bodies):
        node = root
        for c in body:
            following = node.children.get(c)
            if following is None:
                following = node.children[c] = _Node()
            node = following
        node.ends = i
    todo = [(root, list(root.children.values()))]
    while todo:
        node, active = todo.pop()
        i = node.ends
        if i >= 0:
            for m in active:
                if m.ends > i:
                    yield i, m.ends
        children = node.children
        for c, child in children.items():
            near = {node, *children.values(), *child.children.values()}
            for m in active:
                if (x := m.children.get(c)) is not None:
                    near.add(x)
            near.discard(child)
            todo.append((child, list(near)))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each block; rows (key, word, n, body) come sorted by key."""
    now, words, counts, bodies = None, [], [], []

    def out() -> Iterator[pa.RecordBatch]:
        pairs: list[tuple] = []
        for i, j in trie_pairs(bodies):
            x, y = (i, j) if words[i] < words[j] else (j, i)
            pairs.append((words[x], counts[x], words[y], counts[y]))
            if len(pairs) == 10_000:
                yield batch(pairs)
                pairs = []
        if pairs:
            yield batch(pairs)

    def batch(pairs: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*pairs, strict=True), kinds, strict=True)], ["a", "an", "b", "bn"])

    for b in batches:
        for key, word, n, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if key != now:
                if len(words) > 1:
                    yield from out()
                now, words, counts, bodies = key, [], [], []
            words.append(word)
            counts.append(n)
            bodies.append(body)
    if len(words) > 1:
        yield from out()


def _both(key, body, size: int):
    """Array of (key, body) by the first and by the last ``size`` code points of ``body``."""
    n = F.length(body)
    return [
        F.struct(F.concat(key, F.lit("<"), F.substring(body, F.lit(1), F.lit(size))).alias("key"), F.substring(body, F.lit(size + 1), n).alias("body")),
        F.struct(F.concat(key, F.lit(">"), F.substring(body, n - size + 1, F.lit(size))).alias("key"), F.substring(body, F.lit(1), n - size).alias("body")),
    ]


def _blocks(words: DataFrame, limit: int) -> tuple[DataFrame, list[str]]:
    """(key, word, n, body) in blocks of at most ``limit`` words, and the folders they lie in."""
    spark = words.sparkSession
    folders: list[str] = []
    kept = lambda df: written(df, "spelling", folders.append(shared_dir(spark, "spelling")) or folders[-1])
    level = words.select(F.explode(F.array(*_both(F.lit(""), F.col("word"), HEAD))).alias("k"), "word", "n").select("k.key", "word", "n", "k.body")
    level, ready = kept(level), None
    while True:
        # A block whose bodies are all short can't be large, nor be divided.
        large = level.groupBy("key").agg(F.count("*").alias("c"), F.max(F.length("body")).alias("longest")).where((F.col("c") > limit) & (F.col("longest") > 1)).select("key")
        large = kept(large)
        if large.isEmpty():
            return (level if ready is None else ready.unionByName(level)), folders
        small = level.join(large, "key", "left_anti")
        ready = small if ready is None else ready.unionByName(small)
        divided = level.join(large, "key")
        empty, short = F.length("body") == 0, F.length("body") <= 1
        own = F.struct(F.concat("key", F.lit("=")).alias("key"), F.col("body").alias("body"))
        cells = F.when(empty, F.array(own)).when(short, F.array(*_both(F.col("key"), F.col("body"), 1), own)).otherwise(F.array(*_both(F.col("key"), F.col("body"), 1)))
        level = kept(divided.select(F.explode(cells).alias("k"), "word", "n").select("k.key", "word", "n", "k.body"))


def near_words(words: DataFrame, limit: int = BLOCK_WORDS) -> DataFrame:
    """(a, an, b, bn): all pairs a < b at distance one of distinct ``words`` (word, n) of 2 * HEAD code points or more.

    The result is a written table.
    """
    ship(words.sparkSession)
    spark = words.sparkSession
    rows, folders = _blocks(words, limit)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = rows.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_joined, PAIR).distinct()
    out = written(found, "spelling-pairs")
    for folder in folders:
        delete_folder(spark, folder)
    return out


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of all words with a form: pointers are doubled until none moves.

    A form is at least so many times as frequent as its word that a chain is short.
    """
    spark = forms.sparkSession
    at, folder = forms.select("word", F.col("form").alias("root")), None
    while True:
        to = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = at.join(to, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        before, folder = folder, shared_dir(spark, "spelling-roots")
        new = written(new, "spelling-roots", folder)
        if before:
            delete_folder(spark, before)
        at = new.select("word", "root")
        if new.where("moved").isEmpty():
            return at


def spelling_variants(words: DataFrame, factor: int = 5, limit: int = BLOCK_WORDS) -> DataFrame:
    """Of each of the distinct ``words`` (word, n): form, root, n, n_near, form_n.

    A word's form is its near word of largest n (ties: the least in code-point order),
    if that n is ``factor`` times the word's or more, else null; its root is the last of
    its forms, or the word itself.
    """
    words = written(words.select("word", "n"), "spelling-words")
    pairs = near_words(words, limit)
    each = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("bn").alias("m"))
    each = each.unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("an").alias("m")))
    best = each.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    fits = -F.col("best.m") >= factor * F.col("n")
    out = words.join(best, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(fits, F.col("best.near")).alias("form"),
        F.when(fits, -F.col("best.m")).alias("form_n"),
    )
    out = written(out, "spelling-forms")
    roots = _roots(out.where("form is not null").select("word", "form"))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
