"""Benchmark decontamination by a broadcast set of normalised test n-grams.

Words are runs of ``[0-9a-z]`` and non-ASCII characters after A-Z are lower-cased.
An item's windows are its runs of ``n`` words; an item of fewer words, but not none,
is one window. Documents are scanned with a rolling hash, whose hits are verified
word for word; a word inside any occurrence of a window is hit.

The n-gram set is broadcast in blocks of at most ``block_bytes`` of benchmark text.
A benchmark within one block (the usual case) takes one pass without a shuffle; a
larger one takes a pass for each block, each writing its findings to the shared
folder, so that memory stays bounded by a block whatever the benchmark's size.

Null texts have no words and are never hit; a null item is ignored; a null item id
counts as the string ``null``. An item id that occurs twice is one item. An empty
benchmark hits nothing, an empty table gives an empty result; very long texts are
scanned whole; repeated rows are judged each for itself; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandframe.llm.shingles import mix, words_of
from strandframe.llm.token_counts import slices
from strandframe.runtime import fresh_names, ship, written

BLOCK_BYTES, SLICE_BYTES = 8 << 20, 1 << 20
_FACTOR = np.uint64(0xC2B2AE3D27D4EB4F)
_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False


def split_words(text: bytes) -> list[bytes]:
    _, _, begin, end, buf = words_of([text], _BETWEEN)
    return [buf[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]


class NgramSet:
    """The windows of some items: for each length, sorted hashes and what they stand for."""

    def __init__(self, items: list[tuple[str, bytes]], n: int) -> None:
        self.n = n
        self.names = [i for i, _ in items]
        hashes, counts, begin, end, buf = words_of([t for _, t in items], _BETWEEN)
        words = [buf[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        first = np.cumsum(counts) - counts
        made: dict[int, list[tuple[int, int]]] = {}
        for k, (a, c) in enumerate(zip(first.tolist(), counts.tolist(), strict=True)):
            size = min(c, n)
            if size:
                made.setdefault(size, []).extend((a + i, k) for i in range(c - size + 1))
        self.lengths = sorted(made)
        self.tables = {}
        for size, windows in made.items():
            at = np.asarray([a for a, _ in windows], np.int64)
            h = rolling(hashes, [size])[size][at]
            order = np.argsort(h, kind="stable")
            bits = np.zeros(1 << 20, bool)
            bits[h >> np.uint64(44)] = True
            self.tables[size] = (h[order], at[order], np.asarray([k for _, k in windows])[order], bits)
        self.words = words

    def find(self, texts: list[bytes]) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[int]], tuple]:
        """Words of each text, its merged hit spans (in words), its items, and the words' places."""
        hashes, counts, begin, end, buf = words_of(texts, _BETWEEN)
        first = np.cumsum(counts) - counts
        owner = np.repeat(np.arange(len(texts)), counts)
        cover = np.zeros(len(hashes) + 1, np.int64)
        items: list[set[int]] = [set() for _ in texts]
        rolled = rolling(hashes, self.lengths)
        for size in self.lengths:
            table, at, item, bits = self.tables[size]
            h = rolled[size]
            maybe = np.flatnonzero(bits[h >> np.uint64(44)])
            maybe = maybe[owner[maybe] == owner[maybe + size - 1]] if len(maybe) else maybe
            lo, hi = np.searchsorted(table, h[maybe], "left"), np.searchsorted(table, h[maybe], "right")
            some = hi > lo
            for p, a, b in zip(maybe[some].tolist(), lo[some].tolist(), hi[some].tolist(), strict=True):
                said = [buf[x:y] for x, y in zip(begin[p : p + size].tolist(), end[p : p + size].tolist(), strict=True)]
                for j in range(a, b):
                    if self.words[at[j] : at[j] + size] == said:
                        cover[p] += 1
                        cover[p + size] -= 1
                        items[owner[p]].add(int(item[j]))
        hit = np.cumsum(cover[:-1]) > 0
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        # A span ends where the hits end or the text does.
        change = np.flatnonzero(hit & (~np.concatenate(([False], hit[:-1])) | np.concatenate(([True], owner[1:] != owner[:-1])))) if len(hit) else []
        for s in change:
            d = int(owner[s])
            stop = int(first[d] + counts[d])
            run = hit[s:stop]
            e = s + (len(run) if run.all() else int(np.argmin(run)))
            spans[d].append((int(s - first[d]), int(e - first[d])))
        return counts, spans, items, (begin, end, first)


def rolling(hashes: np.ndarray, lengths: list[int]) -> dict[int, np.ndarray]:
    """Hashes of all windows of each length, from one pass over the lengths."""
    out, acc = {}, np.zeros(len(hashes), np.uint64)
    factor = np.uint64(1)
    for i in range(max(lengths, default=0)):
        m = max(len(hashes) - i, 0)
        acc = acc[:m] + hashes[i:] * factor
        factor = np.uint64(int(factor) * int(_FACTOR) % 2**64)
        if i + 1 in lengths:
            out[i + 1] = mix(acc)
    return out


def merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of two lists of spans."""
    out: list[tuple[int, int]] = []
    for s, e in sorted([*a, *b]):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def found_fields(names: list[str]) -> list[T.StructField]:
    spans = T.ArrayType(T.StructType([T.StructField("s", T.LongType()), T.StructField("e", T.LongType())]))
    return [T.StructField(n, t) for n, t in zip(names, (T.LongType(), spans, T.ArrayType(T.StringType())), strict=True)]


_SPANS = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """Items in blocks of at most block_bytes (or one item), read one block at a time."""
    rows = benchmark.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("i"), F.col(text_col).cast("string").alias("t"))
    block: list[tuple[str, bytes]] = []
    size = 0
    for r in rows.toLocalIterator():
        t = r.t.encode()
        if block and size + len(t) > block_bytes:
            yield block
            block, size = [], 0
        block.append((r.i, t))
        size += len(t)
    if block:
        yield block


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", n: int = 10, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, list[str]]:
    """``docs`` with three columns, and their names (none that ``docs`` has): the number of
    words, the hit words as merged spans, the items. One block is on the driver and broadcast
    at a time."""
    spark = docs.sparkSession
    ship(spark)
    names = fresh_names(docs, "_dc_words", "_dc_spans", "_dc_items")
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, *found_fields(names)])
    blocks = _blocks(benchmark, item_id_col, item_text_col, block_bytes)
    block, found, more = next(blocks, []), docs, False
    while True:
        sent = spark.sparkContext.broadcast(NgramSet(block, n))
        found = found.mapInArrow(_scanner(sent, at, names, more), schema)
        block, more = next(blocks, None), True
        if block is None:
            return found, names
        found = written(found, "decontamination")
        sent.destroy()


def _scanner(sent, at: int, names: list[str], more: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for b in batches:
            raw = [t or b"" for t in b.column(at).cast(pa.binary()).to_pylist()]
            for i, j in slices([len(t) for t in raw], SLICE_BYTES):
                counts, spans, items, _ = own.find(raw[i:j])
                named = [sorted({own.names[k] for k in s}) for s in items]
                part = b.slice(i, j - i)
                cols = part.columns
                if more:
                    old = [[(x["s"], x["e"]) for x in v] for v in cols[-2].to_pylist()]
                    spans = [merged(x, y) for x, y in zip(old, spans, strict=True)]
                    named = [sorted({*x, *y}) for x, y in zip(cols[-1].to_pylist(), named, strict=True)]
                    cols = cols[:-3]
                made = [pa.array(counts, pa.int64()), pa.array([[{"s": x, "e": y} for x, y in v] for v in spans], _SPANS), pa.array(named, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*cols, *made], [*part.schema.names[: len(cols)], *names])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Id, n_words, n_hit, n_items, items (ids, sorted as strings), contaminated."""
    text_col = options.pop("text_col", "text")
    found, (words, spans, items) = scan(docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")), benchmark, text_col="_text", **options)
    n_hit = F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["e"] - s["s"])
    return found.select(
        F.col("_id").alias(id_col),
        F.col(words).alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.array_sort(items).alias("items"),
        (n_hit > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "document", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without contamination, with their own columns.

    mode "document" removes every document with a hit word; "span" keeps the document
    and cuts the hit words out of its text (with what stands between them), again
    until nothing is left to cut: with several blocks, until all of them in turn have
    found nothing. One block is on the driver and broadcast at a time.
    """
    if mode == "document":
        found, (_, spans, _) = scan(docs, benchmark, text_col=text_col, **options)
        return found.where(F.size(spans) == 0).select(*docs.columns)
    if mode != "span":
        raise ValueError(f"mode {mode!r}")
    spark = docs.sparkSession
    ship(spark)
    n, at = options.get("n", 10), docs.columns.index(text_col)
    (flag,) = fresh_names(docs, "_dc_cut")
    schema = T.StructType([*docs.schema.fields, T.StructField(flag, T.BooleanType())])
    several, quiet, out = False, False, docs
    while not quiet:
        blocks = _blocks(benchmark, options.get("item_id_col", "item_id"), options.get("item_text_col", "text"), options.get("block_bytes", BLOCK_BYTES))
        quiet, block = True, next(blocks, [])
        while block is not None:
            sent = spark.sparkContext.broadcast(NgramSet(block, n))
            cut = out.select(*docs.columns).mapInArrow(_cutter(sent, at, [*docs.columns, flag]), schema)
            block = next(blocks, None)
            several = several or block is not None
            if not several:  # one block is done when it is scanned
                return cut.select(*docs.columns)
            out = written(cut, "decontamination")
            sent.destroy()
            quiet = quiet and out.where(F.col(flag)).isEmpty()
    return out.select(*docs.columns)


def _cutter(sent, at: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for b in batches:
            raw = b.column(at).cast(pa.binary()).to_pylist()
            for i, j in slices([len(t or b"") for t in raw], SLICE_BYTES):
                texts = raw[i:j]
                todo, cut = [k for k, t in enumerate(texts) if t], [False] * len(texts)
                while todo:
                    _, spans, _, (begin, end, first) = own.find([texts[k] for k in todo])
                    start = np.cumsum([0, *(len(texts[k]) + 1 for k in todo[:-1])])
                    left = []
                    for m, k in enumerate(todo):
                        if spans[m]:
                            kept, done = [], 0
                            for s, e in spans[m]:
                                kept.append(texts[k][done : int(begin[first[m] + s] - start[m])])
                                done = int(end[first[m] + e - 1] - start[m])
                            texts[k] = b" ".join([*kept, texts[k][done:]])
                            left.append(k)
                            cut[k] = True
                    todo = left
                part = b.slice(i, j - i)
                cols = part.columns
                cols[at] = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*cols, pa.array(cut, pa.bool_())], names)

    return run
