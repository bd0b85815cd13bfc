"""Packing: concatenate token ids and cut them into fixed windows.

Pass 1 tokenizes every text once and writes ids with, for each document, its
partition and the tokens before it in that partition. Exclusive prefix sums over
the partitions' totals give each partition's global offset. Pass 2 reads the ids,
adds the offset and cuts at multiples of the window. No row is shuffled and none
depends on an order that a rerun could change: the written table is the order.

Every window is full but the last one, so padding is less than one window for the
whole corpus. A piece is a boundary record (document, start, length, sequence,
offset) with the crc32 of its ids.

Null texts count as empty and give the end token alone. A text of any length is
tokenized whole; pass 1 slices batches to about SLICE_BYTES. Rows with repeated
or null ids are packed each for itself; an empty table gives an empty result.
Extra columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandframe.llm.token_counts import MergeTransducer, byte_letters, slices
from strandframe.runtime import shared_dir, ship

SLICE_BYTES = 1 << 20
#: Characters below this number are compared when a file is opened.
CHECKED = 0x250
#: Fixed value: the pattern of byte-level splitters.
SPLITTER = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Up to so many partitions their offsets (16 bytes each) are broadcast, beyond that joined.
BROADCAST_PARTS = 1_000_000


class IdEncoder:
    """Ids of whole texts, as the ``tokenizers`` library gives them for its file.

    The file's ranks are also given to ``tiktoken``, which merges several times faster.
    It takes only texts whose ids are sure to be the same: ``ranks_agree`` must have been
    shown for the file, and every character must be one of which both were compared in
    all contexts of its class when the file was opened. All other texts, and those that
    hold special strings, go to the library.
    """

    def __init__(self, path: str, agree: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            self.fast = self._ranked(json.load(f)) if agree else None
        self.unsafe = self._unsafe() if self.fast else re.compile("(?s).")

    def _ranked(self, d: dict):
        import tiktoken

        letters, m = byte_letters(), d["model"]
        ranks = {bytes(letters[c] for c in t): i for t, i in m["vocab"].items() if i < 256 + len(m["merges"])}
        return tiktoken.Encoding("ranked", pat_str=SPLITTER, mergeable_ranks=ranks, special_tokens={})

    def _unsafe(self) -> re.Pattern:
        """Characters that the splitters may see differently: all beyond CHECKED, and what differs below."""
        texts = ["".join(x + chr(c) + y for x in ("a", "1", "!", " ", "\n", "'") for y in ("a", "1", "!", " ", "\n")) for c in range(CHECKED)]
        differ = [c for c, t, e in zip(range(CHECKED), texts, self.library.encode_batch(texts, add_special_tokens=False), strict=True) if e.ids != self.fast.encode_ordinary(t)]
        return re.compile("[" + "".join(re.escape(chr(c)) for c in differ) + f"{chr(CHECKED)}-{chr(0x10FFFF)}]")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian uint32 ids of each text."""
        out, rest = [], []
        for i, t in enumerate(texts):
            if self.fast is None or self.unsafe.search(t) or any(s in t for s in self.special):
                rest.append(i)
                out.append(b"")
            else:
                out.append(self.fast.encode_to_numpy(t, disallowed_special=()).astype("<u4").tobytes())
        if rest:
            for i, e in zip(rest, self.library.encode_batch([texts[i] for i in rest], add_special_tokens=False), strict=True):
                out[i] = np.asarray(e.ids, "<u4").tobytes()
        return out


def ranks_agree(path: str) -> bool:
    """Whether merging any two neighbours of least rank gives what the file's merges give.

    ``tiktoken`` merges neighbours whose bytes together are an entry, the library only the
    pairs that the file lists. Let the listed pairs make the entries in the order of their
    ids, and each entry's bytes, merged by themselves, that entry. When two neighbours x, y
    with the bytes of entry z come to be merged, nothing has been merged across the ends of
    z's bytes, and within them the same merges as for z alone, all of lower rank; those
    leave just the listed pair of z. So x, y is that pair, and both merge alike.
    """
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    m, pre = d["model"], d["pre_tokenizer"] or {}
    plain = m["type"] == "BPE" and not d["normalizer"] and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
    if not plain or any(m.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")):
        return False
    pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in m["merges"]]
    order = [m["vocab"][c] for c in byte_letters()] + [m["vocab"][x + y] for x, y in pairs]
    if sorted(order[:256]) + order[256:] != list(range(len(order))):
        return False
    try:
        merger = MergeTransducer(m["vocab"], pairs)
    except ValueError:
        return False
    return all(merger.stands(t) for t in merger.bytes_of)


_ENCODERS: dict[tuple[str, bool], IdEncoder] = {}
_AGREE: dict[str, bool] = {}


def encoder(path: str, agree: bool) -> IdEncoder:
    if (path, agree) not in _ENCODERS:
        _ENCODERS[path, agree] = IdEncoder(path, agree)
    return _ENCODERS[path, agree]


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str, id_col: str, text_col: str) -> T.DataType:
    """Pass 1: (_id, part, before, n, ids) of every row, written below ``folder``."""
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"), F.coalesce(F.octet_length(text_col), F.lit(0)).alias("_size"))
    id_type = base.schema["_id"].dataType
    end = np.asarray([end_id], "<u4").tobytes()
    if tokenizer_path not in _AGREE:
        _AGREE[tokenizer_path] = ranks_agree(tokenizer_path)
    agree = _AGREE[tokenizer_path]

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, before = encoder(tokenizer_path, agree), TaskContext.get().partitionId(), 0
        for b in batches:
            for i, j in slices(b.column(2).to_pylist(), SLICE_BYTES):
                ids = [x + end for x in own.encode(b.column(1).slice(i, j - i).to_pylist())]
                n = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
                at = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.full(len(ids), part)), pa.array(at), pa.array(n), pa.array([pack(x) for x in ids], pa.binary())], ["_id", "part", "before", "n", "ids"])

    made = base.mapInArrow(tokenize, f"_id {id_type.simpleString()}, part long, before long, n long, ids binary")
    made.write.option("compression", "zstd").parquet(folder)
    return id_type


def pack(ids: bytes) -> bytes:
    """Ids below 65536 as uint16, after a byte that says so."""
    a = np.frombuffer(ids, "<u4")
    return b"\x02" + a.astype("<u2").tobytes() if len(a) == 0 or a.max() < 65536 else b"\x04" + ids


def unpack(packed: bytes) -> bytes:
    return np.frombuffer(packed, "<u2" if packed[0] == 2 else "<u4", offset=1).astype("<u4").tobytes()


def pack_sequences(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = 1024, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents in sequences of ``window`` ids.

    Columns: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with
    ``with_ids`` the ids themselves (little-endian uint32).
    """
    spark = docs.sparkSession
    ship(spark)
    folder = shared_dir(spark, "tokens")
    id_type = write_tokens(docs, tokenizer_path, end_id, folder, id_col, text_col)
    schema = T.StructType([T.StructField("_id", id_type), *(T.StructField(c, T.LongType()) for c in ("part", "before", "n")), T.StructField("ids", T.BinaryType())])
    tokens = spark.read.schema(schema).parquet(folder)
    totals = tokens.groupBy("part").agg(F.sum("n").alias("n"))
    # One number for each partition of the input: the driver adds them up, as it schedules them.
    base, offsets = 0, []
    for r in sorted(totals.collect()):
        offsets.append((r.part, base))
        base += r.n
    offset = spark.createDataFrame(offsets, "part long, base long")
    if len(offsets) <= BROADCAST_PARTS:
        offset = F.broadcast(offset)
    placed = tokens.join(offset, "part").select("_id", (F.col("base") + F.col("before")).alias("at"), "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for k, (at, packed) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                ids = unpack(packed)
                n, start = len(ids) // 4, 0
                while start < n:
                    seq, off = divmod(at + start, window)
                    m = min(n - start, window - off)
                    piece = ids[4 * start : 4 * (start + m)]
                    rows.append((k, start, m, zlib.crc32(piece), n, seq, off, piece if with_ids else None))
                    start += m
            cols = list(zip(*rows, strict=True)) if rows else [()] * 8
            arrays = [b.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, pa.int64()) for c in cols[1:7])]
            names = ["_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                arrays.append(pa.array(cols[7], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    out = f"_id {id_type.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return placed.mapInArrow(cut, out).withColumnRenamed("_id", id_col)
