"""Vectorised words and word n-gram hashes of UTF-8 text.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``; in UTF-8 those are the
same runs as over code points.  Texts are handled in slices of bounded size,
so that a very long document costs eight bytes a word and not more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 19
_POW_N, _BASE = 1 << 12, 0x9E3779B97F4A7C15
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
with np.errstate(over="ignore"):
    _POW = np.multiply.accumulate(np.full(_POW_N, _BASE, np.uint64))
    _UP = np.multiply.accumulate(np.full(3 * SLICE // 2, _BASE, np.uint64))
    # the base is odd and so has an inverse modulo 2 ** 64
    _DOWN = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(_UP) - 1, pow(_BASE, -1, 1 << 64), np.uint64)]))
IS_BLANK = np.zeros(256, bool)
IS_BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def as_bytes(column: pa.Array) -> list[bytes]:
    """Texts of an Arrow column; null is empty."""
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def slices(texts: list[bytes], size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts of about ``size`` bytes together."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t) + 1
        if total >= size:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def spans(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the words in a byte array."""
    word = np.empty(len(b) + 2, bool)
    word[0] = word[-1] = False
    np.logical_not(IS_BLANK[b], out=word[1:-1])
    edge = np.flatnonzero(word[1:] != word[:-1])
    return edge[::2], edge[1::2] - edge[::2]


def hash_spans(b: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """64-bit hash of each span's bytes; spans are in order and don't overlap.

    A span's hash is a polynomial in its bytes, taken from running sums over the
    whole array; arrays and spans too long for the tables go byte by byte.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    if len(b) <= len(_UP) and lens.max() <= _POW_N:
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_BYTE[b] * _UP[: len(b)], out=sums[1:])
        v = (sums[starts + lens] - sums[starts]) * _DOWN[starts]
        return mix(v + lens.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    first = np.concatenate([[0], np.cumsum(lens)[:-1]])
    at = np.arange(int(lens.sum())) - np.repeat(first, lens)
    taken = b[at + np.repeat(starts, lens)]
    v = _BYTE[taken] * _POW[at & (_POW_N - 1)]
    if lens.max() > _POW_N:
        v = v * ((at // _POW_N).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    return mix(np.add.reduceat(v, first) + lens.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(text: bytes, lower: bool = True) -> np.ndarray:
    """Hashes of the words of one text of any length, cut at blanks."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + SLICE)
        while end < len(text) and not IS_BLANK[text[end]]:
            end += 1
        b = np.frombuffer(text, np.uint8, end - at, at)
        b = LOWER[b] if lower else b
        out.append(hash_spans(b, *spans(b)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def texts_words(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, words of each text) for a list of texts."""
    hashes, counts = [], np.zeros(len(texts), np.int64)
    for i, j in slices(texts):
        if j == i + 1:
            h = word_hashes(texts[i], lower)
            counts[i] = len(h)
        else:
            b = np.frombuffer(b"\n".join(texts[i:j]), np.uint8)
            b = LOWER[b] if lower else b
            starts, lens = spans(b)
            h = hash_spans(b, starts, lens)
            ends = np.cumsum([len(t) + 1 for t in texts[i:j]])
            counts[i:j] = np.diff(np.searchsorted(starts, ends), prepend=0)
        hashes.append(h)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word windows of one text."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    h = words[: len(words) - n + 1]
    for k in range(1, n):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - n + 1 + k])
    return h


def ngrams(words: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n-word window hashes over many texts, and the index of their text."""
    owner = np.repeat(np.arange(len(counts)), counts)
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = owner[: len(owner) - n + 1] == owner[n - 1 :]
    return shingle_hashes(words, n)[inside], owner[: len(owner) - n + 1][inside]
