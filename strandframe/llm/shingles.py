"""Hashes of words and word shingles for many texts at once, in numpy.

A word is a run of bytes other than white space (0x20, 0x09-0x0D) after A-Z are
lower-cased. Words and shingles are hashed to 64 bits from their bytes alone, so
hashes are the same in every process.
"""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.default_rng(20240229)
_LETTER = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_PLACE, _SIZE = np.uint64(_BASE), np.uint64(0xA0761D6478BD642F)
_SHORT = np.uint64(0xD6E8FEB86659FD93)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads each bit over all others."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


#: So many places in a word have their values in a table; later ones are worked out.
_TABLED = 64
_VALUES = mix(_LETTER[None, :] + np.arange(_TABLED, dtype=np.uint64)[:, None] * _PLACE).ravel()


def _hashed(letters: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of each word, whose bytes lie one after another in ``letters``.

    Each byte at each place has a value of its own and a word is their sum, so no
    regular change of a word keeps its hash, as one of a polynomial modulo 2**64 may.
    """
    if not len(lengths):
        return np.empty(0, np.uint64)
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(letters)) - np.repeat(first, lengths)
    values = _VALUES[(np.minimum(place, _TABLED - 1) << 8) | letters]
    late = np.flatnonzero(place >= _TABLED)
    if len(late):
        values[late] = mix(_LETTER[letters[late]] + place[late].astype(np.uint64) * _PLACE)
    return mix(np.add.reduceat(values, first) + lengths.astype(np.uint64) * _SIZE)


def words_of(texts: list[bytes], between: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Hashes of all words, text after text, the number of words of each text, where
    each word begins and ends, and the lower-cased bytes that these places refer to.

    ``between`` marks the bytes that are not part of a word; it must hold the newline.
    """
    buf = b"\n".join(texts).lower() + b"\n"
    data = np.frombuffer(buf, np.uint8)
    white = between[data]
    edge = np.flatnonzero(np.diff(white, prepend=True))  # words begin and end in turn
    begin, end = edge[0::2], edge[1::2]
    words = _hashed(data[~white], end - begin)
    until = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    counts = np.diff(np.searchsorted(begin, until), prepend=0)
    return words, counts, begin, end, buf


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of words between white space."""
    return words_of(texts, _WHITE)[:2]


def shingle_hashes(texts: list[bytes], k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles (with repeats), text after text, and their counts.

    A text of fewer words, but not none, has one shingle: all its words.
    """
    words, counts = word_hashes(texts)
    n = max(len(words) - k + 1, 0)  # windows, those over the end of a text included
    acc = np.zeros(n, np.uint64)
    factor = np.uint64(1)
    for i in range(k):
        acc += words[i : n + i] * factor
        factor = np.uint64(int(factor) * _BASE % 2**64)
    first = np.cumsum(counts) - counts
    short = np.flatnonzero((counts > 0) & (counts < k))
    full = np.ones(len(acc), bool)
    # Windows that begin in the last k - 1 words of a text run into the next one.
    for i in range(1, k):
        at = first + counts - i
        at = at[(counts >= i) & (at < len(acc))]
        full[at] = False
    made = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    out = np.empty(int(made.sum()), np.uint64)
    place = np.cumsum(made) - made
    is_short = np.zeros(len(out), bool)
    is_short[place[short]] = True
    out[~is_short] = mix(acc[full])
    for j in short:
        h, f = int(_SHORT) * int(counts[j]), 1
        for w in words[first[j] : first[j] + counts[j]]:
            h, f = h + int(w) * f, f * _BASE
        out[place[j]] = np.uint64(h % 2**64)
    if len(short):
        out[is_short] = mix(out[is_short])
    return out, made


def shingle_sets(texts: list[bytes], k: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, counts = shingle_hashes(texts, k)
    ends = np.cumsum(counts).tolist()
    sets, a = [], 0
    for b in ends:
        s = np.sort(hashes[a:b])
        sets.append(s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) > 1 else s)
        a = b
    return sets
