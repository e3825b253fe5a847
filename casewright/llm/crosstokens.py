"""Alignment of the token sequences of two tokenizers over the bytes of a text.

Each byte of a text gets a label: no token ends here, one of A, one of B, or
one of both.  A regular expression scans the labels for spans up to each
both-label; such a span is a token group, and the labels inside count its
tokens of A and of B.  All pairs of a group's tokens are links.

Both tokenizers part texts at a lone space, at a lone line feed and before a
stop at the end of a word: A by its pattern, B as no piece of its file holds
such a place (looked up in the file; a file with one is not cut there).  So a
label is "both" there, and the labels, groups and links of what lies between
depend on nothing else.  Every worker aligns each such part once and keeps it,
up to a bound.

A block is what one task reads, up to ``BLOCK`` bytes of text.  Of it one table
is written: its documents with their distinct links, packed, and its distinct
links with the number of documents of the block that hold them.  Only the latter
meet, block by block; each block gets back the corpus-wide counts of its own
links.

Defined cases: null and empty texts, and texts whose bytes either tokenizer
does not give back (such as one with U+2581), have no tokens and no links;
rows that repeat an id are documents of their own, and so are rows with a null
id; very long texts are cut at lone spaces; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Callable, Iterator

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm.resident import only
from casewright.llm.storage import materialize
from casewright.llm.tokens import _BYTES
from casewright.llm.words import IS_BLANK, SLICE, as_bytes, hash_spans, slices

BLOCK, SLOTS, RECENT, MOST_ROWS, MOST_BYTES = 24 << 20, 1 << 18, 1 << 15, 500_000, 64 << 20
A_END, B_END, BOTH = 1, 2, 3
SPAN = re.compile(b"[^\x03]*\x03")
#: Groups of more links than this are counted by distinct ids instead of link by link.
WIDE = 4096
STOPS = ".,;:!?"
#: White space beyond ASCII, as the pattern of byte-level files has it.
FAR_BLANK = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
LONE = re.compile(rb"(?<=[!-~]) (?=[!-~])")
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_LATIN = re.compile(r"( ?)([^\W\d_]+)\Z")
DOCS = "block bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, links binary, pairs array<int>, held array<int>"


def expand(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (n[0] of them), start[1], ..."""
    return np.arange(int(n.sum())) + np.repeat(start - np.cumsum(n) + n, n)


class Aligner:
    """Aligned parts of texts, kept by a hash of their bytes; it starts anew beyond its bounds."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        shown = {c: b for b, c in self._byte_chars().items()}
        entries = sorted(self.a.get_vocab(with_added_tokens=True).items(), key=lambda x: x[1])
        self.bytes_a = [b""] * (entries[-1][1] + 1)
        for text, i in entries:
            self.bytes_a[i] = bytes(shown[c] for c in text) if all(c in shown for c in text) else text.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.len_a, self.len_b = (np.fromiter(map(len, x), np.int64) for x in (self.bytes_a, self.bytes_b))
        self.width = len(pieces)
        if len(self.bytes_a) * self.width >= 1 << 31:
            raise ValueError("pairs of ids need more than 31 bits")
        self.names = [str(i) for i in range(max(len(self.bytes_a), len(pieces)))]
        normal = [p for i, p in enumerate(pieces) if not self.b.is_byte(i)]
        self.cuts_spaces, self.cuts_lines = not any("▁" in p.lstrip("▁") for p in normal), not any("\n" in p for p in normal)
        glued = {s for p in normal for x, s in zip(p, p[1:], strict=False) if s in STOPS and x.isascii() and x.isalnum()}
        self.stop = np.zeros(256, bool)
        self.stop[[ord(s) for s in STOPS if s not in glued]] = True
        self.clear()

    @staticmethod
    def _byte_chars() -> dict[int, str]:
        return {b: chr(_BYTES.get(b, b)) for b in range(256)}

    def clear(self) -> None:
        self.known = [(np.zeros(0, np.uint64), np.zeros(0, np.int32)) for _ in range(2)]  # hashes ascending and their rows: the bulk, and those of late
        self.slot_key, self.slot_row = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32)
        self.rows, self.kept = 0, 0
        self.count = np.zeros((1024, 4), np.int64)  # tokens of A, of B, groups, links
        self.odd = np.zeros(1024, bool)
        self.first, self.n = np.zeros(1024, np.int64), np.zeros(1024, np.int64)  # a row's distinct links
        self.pair, self.times, self.used = np.zeros(4096, np.int32), np.zeros(4096, np.int32), 0
        self.said: list[bytes] = []

    # tokens of parts

    def _ids_a(self, parts: list[str]) -> list[list[int]]:
        out: list[list[int] | None] = []
        for p in parts:
            m = _LATIN.match(p) if len(p) < 64 else None
            if m and (p.isascii() or (m[2].isalpha() and max(p) < "ɐ")):
                out.append([t.id for t in self.a.model.tokenize(p.encode().decode("latin-1").translate(_BYTES))])
            else:
                out.append(None)
        other = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(other, self.a.encode_batch([parts[i] for i in other], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def _ids_b(self, parts: list[str]) -> list[list[int]]:
        """B puts a space before a text; a part that begins without one follows a line feed instead."""
        spaced = [p[0] == " " for p in parts]
        got = self.b.encode([p[1:] if s else "\n" + p for p, s in zip(parts, spaced, strict=True)], num_threads=1)
        return [ids if s else ids[2:] for ids, s in zip(got, spaced, strict=True)]

    def _align(self, parts: list[bytes]) -> None:
        """Rows for new parts."""
        k = len(parts)
        texts = [p.decode("utf-8", "replace") for p in parts]
        a, b = self._ids_a(texts), self._ids_b(texts)
        odd = np.zeros(k, bool)
        size = np.fromiter(map(len, parts), np.int64, k)
        flat = [np.fromiter((i for x in ids for i in x), np.int64) for ids in (a, b)]
        n = [np.fromiter(map(len, ids), np.int64, k) for ids in (a, b)]
        for ids, lens, names, many in ((flat[0], self.len_a, self.bytes_a, n[0]), (flat[1], self.len_b, self.bytes_b, n[1])):
            ends = np.cumsum(many)
            sums = np.concatenate([[0], np.cumsum(lens[ids])])
            differ = sums[ends] - sums[ends - many] != size
            whole = ids.tolist()
            for i, (e, m) in enumerate(zip(ends.tolist(), many.tolist(), strict=True)):
                if differ[i] or b"".join([names[x] for x in whole[e - m : e]]) != parts[i]:
                    odd[i] = True
        # odd parts have no tokens: their documents have none either
        if odd.any():
            a, b = ([[] if o else x for x, o in zip(ids, odd.tolist(), strict=True)] for ids in (a, b))
            flat = [np.fromiter((i for x in ids for i in x), np.int64) for ids in (a, b)]
            n = [np.fromiter(map(len, ids), np.int64, k) for ids in (a, b)]
            size = np.where(odd, 0, size)
        labels = np.zeros(int(size.sum()), np.uint8)
        labels[np.cumsum(self.len_a[flat[0]]) - 1] |= A_END
        labels[np.cumsum(self.len_b[flat[1]]) - 1] |= B_END
        spans = SPAN.findall(labels.tobytes())
        na = np.fromiter((s.count(b"\x01") + 1 for s in spans), np.int64, len(spans))
        nb = np.fromiter((s.count(b"\x02") + 1 for s in spans), np.int64, len(spans))
        owner = np.searchsorted(np.cumsum(size), np.cumsum(np.fromiter(map(len, spans), np.int64, len(spans))) - 1, "right")
        self._store(k, odd, n, flat, na, nb, owner)

    def _store(self, k: int, odd: np.ndarray, n: list[np.ndarray], flat: list[np.ndarray], na: np.ndarray, nb: np.ndarray, owner: np.ndarray) -> None:
        a0, b0 = np.cumsum(na) - na, np.cumsum(nb) - nb
        links = na * nb
        narrow = links <= WIDE
        la, lb, g = links[narrow], nb[narrow], np.flatnonzero(narrow)
        step = expand(np.zeros(len(g), np.int64), la)
        wide_b = np.repeat(lb, la)
        pair = flat[0][np.repeat(a0[g], la) + step // np.maximum(wide_b, 1)] * self.width + flat[1][np.repeat(b0[g], la) + step % np.maximum(wide_b, 1)]
        keys, times = [(np.repeat(owner[g], la) << 31) | pair], [np.ones(int(la.sum()), np.int64)]
        for i in np.flatnonzero(~narrow).tolist():
            xa, ta = np.unique(flat[0][a0[i] : a0[i] + na[i]], return_counts=True)
            xb, tb = np.unique(flat[1][b0[i] : b0[i] + nb[i]], return_counts=True)
            keys.append((owner[i] << 31) | (xa[:, None] * self.width + xb).ravel())
            times.append((ta[:, None] * tb).ravel())
        keys, times = np.concatenate(keys), np.concatenate(times)
        keys, back = np.unique(keys, return_inverse=True)
        times = np.bincount(back, times, len(keys)).astype(np.int64)
        of = keys >> 31
        r = self.rows
        while r + k > len(self.odd):
            self.count, self.odd, self.first, self.n = (np.concatenate([x, np.zeros_like(x)]) for x in (self.count, self.odd, self.first, self.n))
        while self.used + len(keys) > len(self.pair):
            self.pair, self.times = (np.concatenate([x, np.zeros_like(x)]) for x in (self.pair, self.times))
        self.odd[r : r + k] = odd
        self.count[r : r + k] = np.stack([*n, np.bincount(owner, minlength=k), np.bincount(owner, links, k).astype(np.int64)], 1)
        self.n[r : r + k] = np.bincount(of, minlength=k)
        self.first[r : r + k] = self.used + np.cumsum(self.n[r : r + k]) - self.n[r : r + k]
        self.pair[self.used : self.used + len(keys)], self.times[self.used : self.used + len(keys)] = keys & 0x7FFFFFFF, np.minimum(times, 0x7FFFFFFF)
        self.used += len(keys)
        names_a, names_b = ([self.names[i] for i in x.tolist()] for x in flat)
        said = [f"{','.join(names_a[i : i + p])}|{','.join(names_b[j : j + q])}" for i, p, j, q in zip(a0.tolist(), na.tolist(), b0.tolist(), nb.tolist(), strict=True)]
        ends = np.cumsum(np.bincount(owner, minlength=k)).tolist()
        at = 0
        for e in ends:
            text = ";".join(said[at:e]).encode()
            self.said.append(text)
            self.kept += len(text) + 48
            at = e
        self.rows += k

    # parts of texts

    def _starts(self, raw: np.ndarray, begins: np.ndarray, data: bytes) -> np.ndarray:
        """Where parts begin: at texts, lone spaces, lone line feeds, what follows those, and stops that end a word."""
        blank = np.ones(len(raw) + 2, bool)
        blank[1:-1] = IS_BLANK[raw]
        for m in FAR_BLANK.finditer(data):
            blank[m.start() + 1 : m.end() + 1] = True
        before, after = blank[:-2], blank[2:]
        lone = ~before & ~after
        at = np.zeros(len(raw) + 1, bool)
        at[begins] = True
        if self.cuts_spaces:
            at[:-1] |= lone & (raw == 32)
        if self.cuts_lines:
            line = lone & (raw == 10)
            at[:-1] |= line
            at[1:] |= line
        at[1:-1] |= self.stop[raw[1:]] & _ALNUM[raw[:-1]] & after[1:]
        return np.flatnonzero(at[:-1])

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int32)
        for keys, rows in self.known:
            if len(keys):
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                out = np.where(keys[at] == hashes, rows[at], out)
        return out

    def _rows_of(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of all parts of these pieces of texts, and the number of parts of each piece."""
        data = b"".join(pieces)
        raw = np.frombuffer(data, np.uint8)
        begins = np.cumsum([0, *map(len, pieces)])
        s = self._starts(raw, begins[:-1], data)
        m = np.diff(s, append=len(raw))
        h = hash_spans(raw, s, m)
        slot = (h >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)
        rows = self.slot_row[slot]
        miss = np.flatnonzero((self.slot_key[slot] != h) | (self.rows == 0))
        if len(miss):
            kinds, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
            found = self._find(kinds)
            new = np.flatnonzero(found < 0)
            if len(new):
                began = self.rows
                self._align([data[s[f] : s[f] + m[f]] for f in miss[first[new]].tolist()])
                found[new] = np.arange(began, self.rows)
                self._remember(kinds[new], found[new])
            rows[miss] = found[back]
            self.slot_key[slot[miss]], self.slot_row[slot[miss]] = h[miss], rows[miss]
        return rows, np.diff(np.searchsorted(s, begins))

    def _remember(self, hashes: np.ndarray, rows: np.ndarray) -> None:
        bulk, (keys, old) = self.known
        at = np.searchsorted(keys, hashes)
        late = np.insert(keys, at, hashes), np.insert(old, at, rows)
        if len(late[0]) > RECENT:
            at = np.searchsorted(bulk[0], late[0])
            bulk, late = (np.insert(bulk[0], at, late[0]), np.insert(bulk[1], at, late[1])), (np.zeros(0, np.uint64), np.zeros(0, np.int32))
        self.known = [bulk, late]

    def texts(self, texts: list[bytes]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(counts of each text, digests, owner / pair / times of the distinct links, by owner and pair)."""
        if self.rows > MOST_ROWS or self.kept > MOST_BYTES:
            self.clear()
        owner = [i for i, t in enumerate(texts) if t for _ in _pieces(t)]
        pieces = [p for t in texts if t for p in _pieces(t)]
        rows, n = [np.zeros(0, np.int32)], np.zeros(len(pieces), np.int64)
        for i, j in slices(pieces):
            got, n[i:j] = self._rows_of(pieces[i:j])
            rows.append(got)
        rows = np.concatenate(rows)
        of = np.repeat(np.array(owner, np.int64), n)
        odd = np.zeros(len(texts), bool)
        odd[of[self.odd[rows]]] = True
        count = np.zeros((len(texts), 4), np.int64)
        ends = np.searchsorted(of, np.arange(len(texts) + 1))
        full = np.flatnonzero((np.diff(ends) > 0) & ~odd)
        if len(rows):
            sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(self.count[rows], 0)])
            count[full] = sums[ends[full + 1]] - sums[ends[full]]
        digests = [""] * len(texts)
        said, flat = self.said, rows.tolist()
        for i in full.tolist():
            digests[i] = hashlib.sha256(b";".join([said[r] for r in flat[ends[i] : ends[i + 1]]])).hexdigest()
        use = ~odd[of]
        seen, often = np.unique((of[use] << 31) | rows[use], return_counts=True)
        row = seen & 0x7FFFFFFF
        m = self.n[row]
        at = expand(self.first[row], m)
        keys = (np.repeat(seen >> 31, m) << 31) | self.pair[at]
        weight = np.repeat(often, m) * self.times[at]
        order = np.argsort(keys)
        keys, weight = keys[order], weight[order]
        begin = np.flatnonzero(np.diff(keys, prepend=-1))
        return count, digests, keys[begin] >> 31, keys[begin] & 0x7FFFFFFF, np.add.reduceat(weight, begin) if len(begin) else weight


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text behind its space, cut at lone spaces if it is very long."""
    text, at = b" " + text, 0
    while len(text) - at > 3 * SLICE // 2:
        m = LONE.search(text, at + SLICE)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def pack(pairs: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending pairs as steps, and how often each occurs, bytes of like weight together, deflated."""
    both = np.concatenate([np.diff(pairs, prepend=0), times]).astype("<u4")
    return zlib.compress(both.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
    half = len(both) // 2
    return np.cumsum(both[:half]), both[half:]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    pair, back = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
    return [(pair, np.bincount(back, np.concatenate([n for _, n in parts]), len(pair)).astype(np.int64))]


def _scanner(path_a: str, path_b: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From documents to blocks: a row for each document, and one with the block's links and their documents."""
    names = [x.split()[0] for x in DOCS.split(", ")]

    def closed(block: int, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        pair, n = _merged(held)[0]
        none = [pa.nulls(1, t) for t in (*[pa.int64()] * 5, pa.string(), pa.binary())]
        lists = [pa.array([x.astype(np.int32)], pa.list_(pa.int32())) for x in (pair, n)]
        return pa.RecordBatch.from_arrays([pa.array([block]), *none, *lists], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = only(f"align {path_a} {path_b}", lambda: Aligner(path_a, path_b))
        block, size, held = TaskContext.get().partitionId() << 32, 0, []
        for batch in batches:
            texts = as_bytes(batch.column(1))
            for i, j in slices(texts, 4 * SLICE):
                count, digests, owner, pair, times = aligner.texts(texts[i:j])
                ends = np.searchsorted(owner, np.arange(j - i + 1)).tolist()
                links = [pack(pair[a:b], times[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                lists = [pa.nulls(j - i, pa.list_(pa.int32()))] * 2
                yield pa.RecordBatch.from_arrays([pa.array(np.full(j - i, block)), batch.column(0).slice(i, j - i), *(pa.array(count[:, k]) for k in range(4)), pa.array(digests), pa.array(links, pa.binary()), *lists], names=names)
                held.append(np.unique(pair, return_counts=True))
                held = _merged(held) if len(held) >= 4 else held
                size += sum(map(len, texts[i:j]))
                if size >= BLOCK:
                    yield closed(block, held)
                    block, size, held = block + 1, 0, []
        if held:
            yield closed(block, held)

    return run


def _summed(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """Sums over the links of each document of a block."""
    pair, n, best = (np.asarray(counts.column(c).combine_chunks()) for c in ("pair", "n", "best"))
    order = np.argsort(pair)
    pair, n, best = pair[order], n[order], best[order]
    sums, tops = [], []
    for packed in docs.column("links").to_pylist():
        own, times = unpack(packed)
        at = np.searchsorted(pair, own)
        sums.append(int((n[at] * times).sum()))
        tops.append(int(times[n[at] == best[at]].sum()))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    return pa.table([*(docs.column(c) for c in names), pa.array(tops, pa.int64()), pa.array(sums, pa.int64()), docs.column("groups_sha256")], names=[*names, "n_best", "count_sum", "groups_sha256"])


def pair_counts(scanned: DataFrame, width: int) -> DataFrame:
    """(pair, n, best): documents that hold the linked ids, and the greatest such number of the pair's id of A."""
    held = scanned.where("pairs is not null").select(F.explode(F.arrays_zip("pairs", "held")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.held").alias("n"))
    counted = materialize(held.groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    a = F.expr(f"pair div {width}")
    # a row an id of A: bounded by its vocabulary
    best = F.broadcast(counted.groupBy(a.alias("a")).agg(F.max("n").alias("best")))
    return counted.withColumn("a", a).join(best, "a").select("pair", "n", "best")


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row."""
    path_a, path_b = path_a or default_path("byte_bpe_50k.json"), path_b or default_path("piece_bpe_32k.model")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    scanned = materialize(rows.mapInArrow(_scanner(path_a, path_b), DOCS), "aligned")
    own = scanned.where("pairs is not null").select(F.col("block").alias("of_block"), F.explode("pairs").alias("pair"))
    counts = own.join(pair_counts(scanned, _width(path_b)), "pair")
    texts = scanned.where("pairs is null").drop("pairs", "held")
    return texts.groupBy("block").cogroup(counts.groupBy("of_block")).applyInArrow(_summed, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")


def _width(path_b: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def groups(text: str | None, path_a: str | None = None, path_b: str | None = None) -> list[tuple[list[int], list[int]]]:
    """The token groups of one text, for looking at."""
    aligner = only("align one", lambda: Aligner(path_a or default_path("byte_bpe_50k.json"), path_b or default_path("piece_bpe_32k.model")))
    pieces = list(_pieces(text.encode())) if text else []
    rows = [r for p in pieces for r in aligner._rows_of([p])[0].tolist()]
    if any(aligner.odd[r] for r in rows):
        return []
    said = b";".join(aligner.said[r] for r in rows).decode()
    return [tuple([int(x) for x in side.split(",")] for side in g.split("|")) for g in said.split(";")] if said else []
