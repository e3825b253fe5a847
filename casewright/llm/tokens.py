"""Token ids of whole texts by a tokenizers file, word by word from a cache.

For the word-end BPE files white space always separates tokens, so that a text
is the chain of its words' ids.  Each distinct word of a worker is encoded
once; ids are then gathered with numpy.  Words are told apart by a 64-bit hash.
"""

from __future__ import annotations

import os
import re
from itertools import chain

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np

from casewright.llm.resident import only
from casewright.llm.words import LOWER, SLICE, hash_spans, slices, spans

SLOTS, RECENT = 1 << 19, 1 << 16
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:!?"]] = True
#: "<", and what the combining marks U+0300 to U+036F begin with.
_OWN_CASE = np.zeros(256, bool)
_OWN_CASE[[0x3C, 0xCC, 0xCD]] = True
#: Letters, then ASCII signs but for "'" and "<", which the files treat by their surroundings.
_SIMPLE = re.compile(r"([^\W\d_]*)([!-&(-/:;=>?@\[\\\]^_`{|}~]*)\Z")


def _byte_chars() -> dict[int, int]:
    """The character that stands for each byte in a byte-level file."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + k for k, b in enumerate(hidden)}


_BYTES = _byte_chars()


class WordEncoder:
    """Cache of word ids; it starts anew beyond ``max_words`` distinct words."""

    def __init__(self, path: str, max_words: int = 2_000_000):
        from tokenizers import Tokenizer

        self.tok, self.max_words = Tokenizer.from_file(path), max_words
        self.tokenize = self.tok.model.tokenize
        self.clear()

    def clear(self) -> None:
        # hashes ascending and the words' rows: the bulk, and the words of late
        self.known = [(np.zeros(0, np.uint64), np.zeros(0, np.int32)) for _ in range(2)]
        self.slot_key, self.slot_row = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32)  # the last word of each hash slot
        self.start, self.len, self.ids, self.used, self.rows = np.zeros(1024, np.int32), np.zeros(1024, np.int32), np.zeros(4096, np.uint32), 0, 0
        self.signs: dict[str, list[int]] = {"": []}

    def _plain(self, word: str) -> list[int] | None:
        """Ids of lower-case Latin letters and signs after them; None for other words."""
        if word.isascii() and word.isalpha() and word.islower():
            return [t.id for t in self.tokenize(word)]
        m = _SIMPLE.match(word)
        if not m:
            return None
        letters, signs = m.groups()
        out = []
        if letters:
            if not letters.isascii():
                if not letters.isalpha() or letters.lower() != letters or max(letters) >= "\u0250":
                    return None
                letters = letters.encode().decode("latin-1").translate(_BYTES)
            elif not letters.islower():
                return None
            out = [t.id for t in self.tokenize(letters)]
        if signs:
            if signs not in self.signs:
                if len(self.signs) > 50_000:
                    self.signs = {"": []}
                self.signs[signs] = [t.id for t in self.tokenize(signs)]
            out += self.signs[signs]
        return out

    def _add(self, hashes: np.ndarray, words: list[str]) -> None:
        """Ids of new words; hashes ascend."""
        got = [self._plain(w) for w in words]
        other = [i for i, g in enumerate(got) if g is None]
        for i, e in zip(other, self.tok.encode_batch([words[i] for i in other], add_special_tokens=False), strict=True):
            got[i] = e.ids
        flat = np.fromiter(chain.from_iterable(got), np.uint32)
        n, k = self.rows, len(got)
        while n + k > len(self.start):
            self.start, self.len = np.concatenate([self.start, np.zeros_like(self.start)]), np.concatenate([self.len, np.zeros_like(self.len)])
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        lens = np.fromiter(map(len, got), np.int32, k)
        self.len[n : n + k], self.start[n : n + k] = lens, self.used + np.cumsum(lens) - lens
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.rows += k
        bulk, (keys, rows) = self.known
        at = np.searchsorted(keys, hashes)
        late = np.insert(keys, at, hashes), np.insert(rows, at, np.arange(n, n + k))
        if len(late[0]) > RECENT:
            at = np.searchsorted(bulk[0], late[0])
            bulk, late = (np.insert(bulk[0], at, late[0]), np.insert(bulk[1], at, late[1])), (np.zeros(0, np.uint64), np.zeros(0, np.int32))
        self.known = [bulk, late]

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each word, -1 for new ones."""
        out = np.full(len(hashes), -1, np.int32)
        for keys, rows in self.known:
            if len(keys):
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                out = np.where(keys[at] == hashes, rows[at], out)
        return out

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text)."""
        out, counts = [], np.zeros(len(texts), np.int64)
        for i, j in slices(texts):
            part = texts[i:j]
            if j == i + 1 and len(part[0]) > 2 * SLICE:
                part = _pieces(part[0])
                ids, n = zip(*(self._slice([p]) for p in part), strict=True)
                counts[i] = sum(int(x[0]) for x in n)
                out.extend(ids)
            else:
                ids, counts[i:j] = self._slice(part)
                out.append(ids)
        return (np.concatenate(out) if out else np.zeros(0, np.uint32)), counts

    def _slice(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(b"\n".join(texts), np.uint8)
        starts, lens = spans(raw)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        b = LOWER[raw]
        # the files compose marks, then lower-case: words with a special token's "<" or with a combining mark keep their own case
        if (kept := _OWN_CASE[raw]).any():
            own = np.logical_or.reduceat(kept, starts)
            at = np.arange(int(lens[own].sum())) + np.repeat(starts[own] - np.cumsum(lens[own]) + lens[own], lens[own])
            b[at] = raw[at]
        # a full stop or the like right after a letter or digit is a token of its own
        last = starts + lens - 1
        cut = (lens > 1) & _STOP[b[last]] & _ALNUM[b[np.maximum(last - 1, 0)]]
        n = len(starts) + int(cut.sum())
        at = np.arange(len(starts)) + np.cumsum(cut) - cut
        s, m = np.zeros(n, np.int64), np.ones(n, np.int64)
        s[at], m[at] = starts, lens - cut
        s[at[cut] + 1] = last[cut]
        h = hash_spans(b, s, m)
        slot = (h >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)
        rows = self.slot_row[slot]
        miss = np.flatnonzero(self.slot_key[slot] != h)
        if len(miss):
            distinct, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
            if self.rows and self.rows + len(distinct) > self.max_words:
                self.clear()
                return self._slice(texts)
            found = self._find(distinct)
            new = np.flatnonzero(found < 0)
            if len(new):
                data, began = b.tobytes(), self.rows
                self._add(distinct[new], [data[s[f] : s[f] + m[f]].decode() for f in miss[first[new]].tolist()])
                found[new] = np.arange(began, self.rows)
            rows[miss] = found[back]
            self.slot_key[slot[miss]], self.slot_row[slot[miss]] = h[miss], rows[miss]
        width = self.len[rows].astype(np.int64)
        ends = np.cumsum(width)
        total = int(ends[-1])
        ids = self.ids[np.arange(total) + np.repeat(self.start[rows] - ends + width, width)]
        bounds = np.searchsorted(s, np.cumsum([len(t) + 1 for t in texts]))
        return ids, np.diff(np.concatenate([[0], ends])[bounds], prepend=0)


def _pieces(text: bytes) -> list[bytes]:
    """A very long text cut at blanks."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + SLICE)
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        out.append(text[at:end])
        at = end
    return out


def encoder(path: str, max_words: int = 2_000_000) -> WordEncoder:
    """The worker's encoder for this file, kept until the worker needs another model."""
    return only(f"tokens {path} {max_words}", lambda: WordEncoder(path, max_words))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def crc_rows(ids: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> list[int]:
    """Unsigned crc32 of id ranges as little-endian unsigned 32-bit integers."""
    import zlib

    data = memoryview(np.ascontiguousarray(ids, "<u4").tobytes())
    return [zlib.crc32(data[4 * s : 4 * (s + n)]) for s, n in zip(starts.tolist(), lens.tolist(), strict=True)]


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids with ``end_id`` after each document, and each document's new count."""
    ends = np.cumsum(counts)
    return np.insert(ids, ends, end_id).astype(np.uint32), counts + 1
