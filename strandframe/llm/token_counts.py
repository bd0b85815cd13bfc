"""Token counts by finite-state transducers compiled from a byte-level BPE file.

Two deterministic transducers stand for the tokenizer:

1. The splitter. Where a piece (pretoken) starts depends on the classes of one
   character before and three after, so it is a sliding-window transducer; here
   it is evaluated for all characters of a batch at once. Classes of characters
   are taken from the library itself, once for each character that occurs.
2. The merger. Reading a piece byte by byte, its state holds all that later bytes
   can ask for: for each place from which a vocabulary entry may still run on, the
   trie node reached, the last token before that place, and how many tokens were
   made since. Each transition is annotated with the number of tokens that the best
   reading gains (possibly none or less), so the sum along a text is its token
   count. States are made when first met (lazy determinization) and interned; the
   table is bounded and starts anew when full.

Text is cut into chunks that advance in lock-step in numpy. A chunk's map takes the
state in which it is entered to the state in which it is left and the tokens made
between. Where a chunk begins with a piece, its map is constant, as a piece start
sends every state to the initial one. Where it begins within a piece (no piece start
is near), the map is worked out at the state that LEAD bytes before the chunk lead
to, which is nearly always the one asked for, as states soon forget what lies behind.
A scan along the chunks then composes the maps: each chunk must be entered in the
state in which the one before was left; a map that was not worked out there is, and
the scan goes on until all agree. Counts are exact whatever was guessed.

Null texts count as empty. Texts may be of any length: memory follows the batch
(sliced to about SLICE_BYTES), except that a single text is never cut; when the table
holds MAX_STATES states it starts anew from those in use. Repeated
rows are counted each for itself; an empty table gives an empty result; extra
columns are not read. Unsupported files (normalizers, other pre-tokenizers,
dropout, unknown tokens) raise ValueError when compiled.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.runtime import ship

CHUNK, LEAD, SLICE_BYTES, MAX_STATES = 256, 64, 2 << 20, 1 << 17
#: States that the table grows by.
GROWTH = 1 << 14
LETTER, NUMBER, SPACE, WHITE, OTHER, UNKNOWN = 0, 1, 2, 3, 4, 255
#: The contractions that the splitter takes as pieces of their own.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: letter to byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeTransducer:
    """The merger: ``table[state * 256 + byte]`` is next state * 16 + gain + 8, or -1."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]) -> None:
        letters = byte_letters()
        self.bytes_of: dict[int, bytes] = {}
        self.rank: dict[int, int] = {}
        self.split: dict[int, tuple[int, int]] = {}
        self.pair: dict[tuple[int, int], int] = {}
        for letter, b in letters.items():
            self.bytes_of[vocab[letter]] = bytes([b])
            self.rank[vocab[letter]] = -1
        for r, (a, b) in enumerate(merges):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            if max(self.rank.get(x, r), self.rank.get(y, r)) >= r:
                raise ValueError(f"merge {r} takes a token that comes after it")
            self.pair.setdefault((x, y), r)
            if z not in self.rank:
                self.rank[z], self.split[z] = r, (x, y)
                self.bytes_of[z] = self.bytes_of[x] + self.bytes_of[y]
        self.child: dict[int, int] = {}  # node * 256 + byte
        self.token: list[int] = [-1]
        self.inner: list[bool] = [False]
        for t, raw in self.bytes_of.items():
            node = 0
            for b in raw:
                self.inner[node] = True
                nxt = self.child.get(node << 8 | b)
                if nxt is None:
                    nxt = self.child[node << 8 | b] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
                node = nxt
            self.token[node] = t
        self._fit: dict[tuple[int, int], bool] = {}
        self._own: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        self.keys: list[tuple] = [((0, -1, 0),)]
        self.ids: dict[tuple, int] = {self.keys[0]: 0}
        self.table = np.full(1024 * 256, -1, np.int32)

    def _intern(self, key: tuple) -> int:
        """The number of a state."""
        s = self.ids.get(key)
        if s is None:
            s = self.ids[key] = len(self.keys)
            self.keys.append(key)
            if len(self.keys) * 256 > len(self.table):
                self.table = np.concatenate([self.table, np.full(GROWTH * 256, -1, np.int32)])
        return s

    def _restart(self, live: list[np.ndarray]) -> None:
        """Forget all states but those in ``live``, whose numbers change in place."""
        used = np.unique(np.concatenate(live))
        keys = [self.keys[s] for s in used.tolist()]
        self.reset()
        new = np.asarray([self._intern(k) for k in keys], np.int32)
        for a in live:
            a[:] = new[np.searchsorted(used, a)]

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens together leaves just these two.

        Undo the merges of both, latest first: a merge across the border must never
        have come before the next merge on either side.
        """
        known = self._fit.get((left, right))
        if known is not None:
            return known
        a, b, before, ok = left, right, len(self.pair) + 2, True
        while True:
            r = self.pair.get((a, b))
            if r is not None and r < before:
                ok = False
                break
            ra, rb = self.rank[a], self.rank[b]
            if ra > rb:
                before, a = ra, self.split[a][1]
            elif rb >= 0:
                before, b = rb + 1, self.split[b][0]
            else:
                break
        if len(self._fit) > 1 << 18:
            self._fit.clear()
        self._fit[left, right] = ok
        return ok

    def stands(self, token: int) -> bool:
        """Whether merging the token's own bytes makes the token."""
        known = self._own.get(token)
        if known is None:
            known = True
            if token in self.split:
                a, b = self.split[token]
                at = self.rank[token]
                known = self.stands(a) and self.stands(b) and self._meets(a, b, at)
            self._own[token] = known
        return known

    def _meets(self, a: int, b: int, at: int) -> bool:
        """Whether both come to stand side by side, untouched, until merge ``at``."""
        first = True
        before = len(self.pair) + 2
        while True:
            r = self.pair.get((a, b))
            if r is not None and r < before and not (first and r == at):
                return False
            first = False
            ra, rb = self.rank[a], self.rank[b]
            if ra > rb:
                before, a = ra, self.split[a][1]
            elif rb >= 0:
                before, b = rb + 1, self.split[b][0]
            else:
                return True

    def step(self, state: int, byte: int) -> int:
        """Make the transition; the packed entry."""
        live, met = [], None
        for node, last, since in self.keys[state]:
            nxt = self.child.get(node << 8 | byte)
            if nxt is None:
                continue
            t = self.token[nxt]
            if met is None and t >= 0 and self.stands(t) and (last < 0 or self.fits(last, t)):
                met = (t, since)
            if self.inner[nxt]:
                live.append((nxt, last, since))
        gain = 1 - met[1]
        if not -8 <= gain <= 7:
            raise ValueError(f"a transition gains {gain} tokens, which the table can't hold")
        s = self._intern(tuple(sorted([*((n, last, since + gain) for n, last, since in live), (0, met[0], 0)])))
        packed = s * 16 + gain + 8
        self.table[state << 8 | byte] = packed
        return packed

    def _advance(self, data: np.ndarray, inside: np.ndarray, starts: np.ndarray, lengths: np.ndarray, entry: np.ndarray, live: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The maps of data[start:start+length] at the states ``entry``: states left in, tokens made.

        ``live`` are arrays of states in use elsewhere, which a restart renumbers.
        """
        order = np.argsort(-lengths, kind="stable")
        at, left = starts[order].astype(np.int64), lengths[order]
        state, count = entry[order], np.zeros(len(at), np.int64)
        active = np.searchsorted(-left, -np.arange(1, (left[0] if len(left) else 0) + 1), side="right")
        for s, n in enumerate(active):
            if len(self.keys) > MAX_STATES:
                self._restart([state, *live])
            pos = at[:n] + s
            k = state[:n] * inside[pos] * 256 + data[pos]
            got = self.table[k]
            if got.min() < 0:
                for x in np.unique(k[got < 0]):
                    if self.table[x] < 0:
                        self.step(int(x) >> 8, int(x) & 255)
                got = self.table[k]
            state[:n] = got >> 4
            count[:n] += (got & 15) - 8
        out, total = np.empty(len(at), np.int32), np.empty(len(at), np.int64)
        out[order], total[order] = state, count
        return out, total

    def run(self, data: np.ndarray, inside: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Token counts of the chunks data[starts[i]:starts[i+1]]; inside: 0 at piece starts."""
        lengths = np.diff(np.append(starts, len(data)))
        entry = np.zeros(len(starts), np.int32)
        within = np.flatnonzero(inside[starts])  # never the first: data begin with a piece
        if len(within):
            begin = np.flatnonzero(inside == 0)
            lead = np.maximum(starts[within] - LEAD, begin[np.searchsorted(begin, starts[within], side="right") - 1])
            entry[within], _ = self._advance(data, inside, lead, starts[within] - lead, entry[within], [entry])
        left, count = self._advance(data, inside, starts, lengths, entry, [entry])
        while len(wrong := within[entry[within] != left[within - 1]]):
            entry[wrong] = left[wrong - 1]
            left[wrong], count[wrong] = self._advance(data, inside, starts[wrong], lengths[wrong], entry[wrong], [entry, left])
        return count


class TokenCounter:
    """Both transducers of a tokenizer file, and the library for what they ask of it."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        m, pre = d["model"], d["pre_tokenizer"]
        if d["normalizer"] or m["type"] != "BPE" or pre["type"] != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError(f"{path}: only byte-level BPE without a normalizer is compiled")
        if m.get("dropout") or m.get("ignore_merges") or m.get("continuing_subword_prefix") or m.get("end_of_word_suffix"):
            raise ValueError(f"{path}: unsupported options of the BPE model")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in d["added_tokens"]):
            raise ValueError(f"{path}: unsupported options of added tokens")
        self.special = sorted((t["content"] for t in d["added_tokens"]), key=len, reverse=True)
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in m["merges"]]
        self.merger = MergeTransducer(m["vocab"], merges)
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)

    def learn(self, points: np.ndarray) -> None:
        """Classes of characters not met before, as the library's splitter sees them."""
        split = self.library.pre_tokenizer.pre_tokenize_str
        for c in points:
            ch = chr(c)
            if c == 32:
                kind = SPACE
            elif len(split("a" + ch)) == 1:
                kind = LETTER
            elif len(split("1" + ch)) == 1:
                kind = NUMBER
            else:
                kind = OTHER if len(split("!" + ch)) == 1 else WHITE
            self.classes[c] = kind

    def starts(self, points: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """True where a piece starts; the texts lie one after another, none is empty."""
        kind = self.classes[points]
        if (kind == UNKNOWN).any():
            self.learn(np.unique(points[kind == UNKNOWN]))
            kind = self.classes[points]
        n = len(points)
        ends = np.cumsum(lengths)
        first, last = np.zeros(n, bool), np.zeros(n, bool)
        first[ends - lengths] = True
        last[ends - 1] = True
        before = np.empty(n, np.uint8)
        before[1:] = kind[:-1]
        before[first] = UNKNOWN
        after = np.empty(n, np.uint8)
        after[:-1] = kind[1:]
        after[last] = UNKNOWN
        white = lambda k: (k == SPACE) | (k == WHITE)
        is_white = white(kind)
        start = np.where(is_white, ~white(before) | ~(white(after) | (after == UNKNOWN)), (before != kind) & (before != SPACE))
        start |= first
        for i in np.flatnonzero(start & (points == 39) & ~last):
            end = ends[np.searchsorted(ends, i, side="right")]
            ahead = "".join(map(chr, points[i : min(i + 3, end)]))
            hit = next((c for c in CONTRACTIONS if ahead.startswith(c)), None)
            if hit:
                start[i + 1 : i + len(hit)] = False
                j = i + len(hit)
                if j < end and not is_white[j]:
                    start[j] = True
        return start

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        pieces, owner = [], []
        for i, t in enumerate(texts):
            for s in self.special:
                if s in t:
                    for part in self._apart(t):
                        if part in self.special:
                            out[i] += 1
                        elif part:
                            pieces.append(part)
                            owner.append(i)
                    break
            else:
                if t:
                    pieces.append(t)
                    owner.append(i)
        if not pieces:
            return out
        whole = "".join(pieces)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        raw = np.frombuffer(whole.encode("utf-8", "surrogatepass"), np.uint8)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        start = self.starts(points, lengths)
        at = np.flatnonzero((raw & 0xC0) != 0x80)  # where each character's bytes begin
        inside = np.ones(len(raw), np.int32)
        inside[at[start]] = 0
        begin = at[np.cumsum(lengths) - lengths]
        where = at[start]
        # A cut goes on to the next piece start, but not over another chunk's length.
        even = np.arange(0, len(raw), CHUNK)
        after = np.append(where, len(raw))[np.searchsorted(where, even)]
        chunks = np.unique(np.concatenate([np.where(after - even < CHUNK, after, even), begin]))
        chunks = chunks[chunks < len(raw)]
        counts = self.merger.run(raw.astype(np.int32), inside, chunks)
        text_of = np.searchsorted(begin, chunks, side="right") - 1
        np.add.at(out, np.asarray(owner)[text_of], counts)
        return out

    def _apart(self, text: str) -> list[str]:
        """The text cut around special strings, which are kept."""
        parts = [text]
        for s in self.special:
            cut = []
            for p in parts:
                if p in self.special:
                    cut.append(p)
                    continue
                bits = p.split(s)
                for i, b in enumerate(bits):
                    cut += [s] * (i > 0) + [b]
            parts = cut
        return parts


_COUNTERS: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """The compiled tokenizer of this process."""
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(path)
    return _COUNTERS[path]


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes."""
    a, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield a, i
            a, held = i, 0
        held += n
    if a < len(sizes):
        yield a, len(sizes)


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """Id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every row.

    Special strings inside texts count as the library's default has them: one token.
    """
    ship(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    id_type = base.schema["_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer_path)
        for b in batches:
            sizes = b.column(2).to_pylist()
            n = np.zeros(len(sizes), np.int64)
            for i, j in slices(sizes, SLICE_BYTES):
                n[i:j] = own.count(b.column(1).slice(i, j - i).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n), pa.array(n > limit)], ["_id", "n_bytes", "n_tokens", "over_limit"])

    out = base.mapInArrow(count, f"_id {id_type}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("_id", id_col)
