"""Token ids as files: an adaptive context-mixing range coder.

A file holds the ids of consecutive documents in blocks of ``BLOCK`` ids.  In
its head each id has a class, of ids that follow like ids, and a context, of ids
that like ids follow, with the shares of the classes after each context (order
1) and of the ids in their class (order 0), counted over the whole file.  In
each block the coder starts anew.  The ids that last followed the same two ids
(order 2) and the same id (order 1) are kept with a trust; the better of them is
the guess.  Its chance is mixed in the logistic domain, with weights that learn,
from what order 2, order 1 and the block's share of hits (order 0) promise.  An
id that is not the guess is coded by the head: its class after the context of
the id before, then its place in the class.  All arithmetic of the coder is in
integers, so that a file decodes alike on every machine, and all blocks of a
file advance together, one id a step, as lanes of numpy arrays.

File: ``TKR3``, vocabulary, documents, ids, blocks, bytes of the document table
and of the head's tables (little-endian u32, ids u64), the document table (zlib:
int64 ids, u32 counts), the head's tables (zlib: u16 widths of classes by
context, u32 steps of ids, u16 shares, u8 classes, u8 contexts), then for each
block ids, 16-bit words, crc32 of the ids, and after all heads the words.

Defined cases: null or empty text is the end id alone; repeated rows are
written as often as they occur; rows of one id lie together, by a hash of
their text; null ids come first and read back as null; an empty table makes no
file; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm.storage import materialize
from casewright.llm.tokens import crc_rows, default_path, encoder, with_end
from casewright.llm.words import as_bytes, slices

BLOCK, LANES = 768, 2730
SLOTS, TRUST_BITS = 128, 4
CLASSES, CONTEXTS, CLASS_BITS, SHARE_BITS, LEAST, RENEW = 16, 64, 14, 14, 4, 32
#: Ids of a class at most, kinds of neighbours, and the most frequent ids by which groups are made.
MEMBERS, FEATURES, TAUGHT = 8192, 256, 2048
#: Pairs of neighbours by which ids are grouped; all shares are counted over all ids.
SAMPLE = 1 << 19
#: Chances of 4096 at the start of a block: of the guess of order 2 and of order 1 by their trust, and of hits at all.
CHANCE = np.array([[60, 700, 1300, 1800, 2100, 2400, 2600, 2800, 2900, 3000, 3100, 3200, 3250, 3300, 3350, 3400], [60, 400, 800, 1200, 1500, 1800, 2000, 2200, 2400, 2500, 2600, 2700, 2800, 2900, 3000, 3100]], np.int32)
BASE = 500
_HEAD = struct.Struct("<4sIIQIII")
_U = np.uint64
_16, _48 = _U(16), _U(48)
_FULL, _SMALL, _LOW16 = _U((1 << 64) - 1), _U(1 << 48), _U((1 << 16) - 1)
_NULL_ID = -(1 << 63)


def _squash_table() -> np.ndarray:
    x = np.arange(-2047, 2049) / 256.0
    return np.clip(np.rint(4096 / (1 + np.exp(-x))), 1, 4095).astype(np.int32)


def _stretch_table(squash: np.ndarray) -> np.ndarray:
    return (np.searchsorted(squash, np.arange(4096)) - 2047).clip(-2047, 2047).astype(np.int32)


SQUASH = _squash_table()
STRETCH = _stretch_table(SQUASH)


class _Prior:
    """What the head of a file says of its ids: class and context of each, its place in the class, and the classes after each context.

    In each class the shares sum to 2 ** SHARE_BITS, after each context those of
    the classes to 2 ** CLASS_BITS.  The last context is that before a block.
    """

    def __init__(self, vocab: int, ids: np.ndarray, kinds: np.ndarray, contexts: np.ndarray, shares: np.ndarray, widths: np.ndarray):
        self.ids, self.kinds, self.contexts, self.shares, self.widths = ids, kinds, contexts, shares, widths
        if vocab > CLASSES * MEMBERS:
            raise ValueError(f"a vocabulary of {vocab} is too large")
        total = 1 << SHARE_BITS
        self.kind, self.context = np.zeros(vocab, np.uint8), np.zeros(vocab, np.uint8)
        self.kind[ids], self.context[ids] = kinds, contexts
        order = np.argsort(kinds, kind="stable")
        own, n = ids[order], shares[order]
        ends = np.cumsum(n)
        self.place = np.zeros(vocab, np.uint32)  # where an id begins in its class, and its share
        self.place[own] = ((ends - n) % total) << 16 | n
        self.symbol = np.zeros(CLASSES * total, np.int32)
        have = np.unique(kinds)
        if len(have):
            self.symbol[(have[:, None] * total + np.arange(total)).reshape(-1)] = np.repeat(own, n)
        ends = np.cumsum(widths, axis=1)
        self.packed = ((ends - widths) << 16 | widths).astype(np.uint32).reshape(-1)
        self.class_at = np.repeat(np.tile(np.arange(CLASSES), CONTEXTS + 1), widths.reshape(-1)).astype(np.uint8)

    @staticmethod
    def of(vocab: int, ids: np.ndarray) -> _Prior:
        count = np.bincount(ids, minlength=1)
        have = np.flatnonzero(count)
        number = np.cumsum(count > 0) - 1
        x, count = number[ids], count[have]
        before = np.concatenate([np.full(min(1, len(x)), -1), x[:-1]])
        before[::BLOCK] = -1
        kinds, contexts = _grouped(x, before, count)
        shares = np.ones(len(have), np.int64)
        for c in np.unique(kinds):
            own = np.flatnonzero(kinds == c)
            n = count[own]
            shares[own] += n * ((1 << SHARE_BITS) - len(own)) // n.sum()
            shares[own[n.argmax()]] += (1 << SHARE_BITS) - shares[own].sum()
        told = np.concatenate([contexts, np.full(1, CONTEXTS)])[before]
        seen = np.bincount(told * CLASSES + kinds[x], minlength=(CONTEXTS + 1) * CLASSES).reshape(-1, CLASSES)
        widths = LEAST + seen * ((1 << CLASS_BITS) - CLASSES * LEAST) // np.maximum(1, seen.sum(1, keepdims=True))
        widths[np.arange(len(widths)), widths.argmax(1)] += (1 << CLASS_BITS) - widths.sum(1)
        return _Prior(vocab, have, kinds, contexts, shares, widths)

    def pack(self) -> bytes:
        parts = [self.widths.astype("<u2"), np.diff(self.ids, prepend=0).astype("<u4"), self.shares.astype("<u2"), self.kinds.astype(np.uint8), self.contexts.astype(np.uint8)]
        return zlib.compress(b"".join(x.tobytes() for x in parts), 6)

    @staticmethod
    def unpack(vocab: int, data: bytes) -> _Prior:
        raw = zlib.decompress(data)
        head = 2 * (CONTEXTS + 1) * CLASSES
        n = (len(raw) - head) // 8
        read = lambda kind, at: np.frombuffer(raw, kind, n, at).astype(np.int64)
        return _Prior(vocab, np.cumsum(read("<u4", head)), read(np.uint8, head + 6 * n), read(np.uint8, head + 7 * n), read("<u2", head + 4 * n), np.frombuffer(raw, "<u2", head // 2).astype(np.int64).reshape(-1, CLASSES))


def _alike(rows: np.ndarray, weight: np.ndarray, k: int, rounds: int = 5) -> np.ndarray:
    """Groups 0 to k - 1 of rows of counts with like shares; the most frequent rows make the groups."""
    share = np.sqrt(rows / np.maximum(rows.sum(1, keepdims=True), 1)).astype(np.float32)
    top = np.argsort(-weight, kind="stable")[:TAUGHT]
    own, centres = share[top], share[top[np.linspace(0, len(top) - 1, k).astype(int)]].copy()

    def nearest(x: np.ndarray) -> np.ndarray:
        return ((centres**2).sum(1) - 2 * (x @ centres.T)).argmin(1)

    for _ in range(rounds):
        at = nearest(own)
        load = np.zeros((k, len(top)), np.float32)
        load[at, np.arange(len(top))] = weight[top]
        sums = load.sum(1, keepdims=True)
        centres = np.where(sums > 0, (load @ own) / np.maximum(sums, 1), centres)
    return np.concatenate([nearest(share[i : i + 4096]) for i in range(0, len(share), 4096)])


def _grouped(x: np.ndarray, before: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class and context of each distinct id: ids after like ids, and ids before like ids.

    Neighbours are told apart up to FEATURES kinds: the most frequent by
    themselves, all others by a remainder.
    """
    n = len(count)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rank = np.empty(n, np.int64)
    rank[np.argsort(-count, kind="stable")] = np.arange(n)
    told = np.where(rank < FEATURES // 2, rank, FEATURES // 2 + rank % (FEATURES // 2))
    step = max(1, len(x) // SAMPLE)
    a, b = before[::step], x[::step]
    a, b = a[a >= 0], b[a >= 0]
    left = np.bincount(b * FEATURES + told[a], minlength=n * FEATURES).reshape(n, FEATURES)
    right = np.bincount(a * FEATURES + told[b], minlength=n * FEATURES).reshape(n, FEATURES)
    kinds, contexts = _alike(left, count, CLASSES), _alike(right, count, CONTEXTS)
    for _ in range(CLASSES):  # a class has places for MEMBERS ids; the rarest of more go where most is free
        size = np.bincount(kinds, minlength=CLASSES)
        full, free = int(size.argmax()), int(size.argmin())
        if size[full] <= MEMBERS:
            break
        own = np.flatnonzero(kinds == full)
        kinds[own[np.argsort(count[own], kind="stable")[: min(size[full] - MEMBERS, MEMBERS - size[free])]]] = free
    return kinds, contexts


class _Out:
    """Range encoder of each lane: 64-bit states, 16 bits out at a time, with carries.

    The three decisions of an id narrow the range by 40 bits at most and so need
    one renormalisation, mostly by a single word.
    """

    def __init__(self, lanes: int, steps: int):
        self.low, self.range = np.zeros(lanes, _U), np.full(lanes, _FULL, _U)
        self.width = 3 * steps + 8
        self.words, self.pos = np.zeros(lanes * self.width, np.uint16), np.arange(lanes) * self.width

    def first(self, k: int) -> _Out:
        part = object.__new__(_Out)
        part.low, part.range, part.pos, part.words, part.width = self.low[:k], self.range[:k], self.pos[:k], self.words, self.width
        return part

    def put(self, chance: np.ndarray, hit: np.ndarray, of_class: np.ndarray, of_place: np.ndarray) -> None:
        """One id: the guess's bit, else also its class and its place in the class."""
        start, width, place, share = of_class >> _16, of_class & _LOW16, of_place >> _16, of_place & _LOW16
        guess = (self.range >> _U(12)) * chance
        by_class = (self.range - guess) >> _U(CLASS_BITS)
        by_place = (by_class * width) >> _U(SHARE_BITS)
        add = np.where(hit, _U(0), guess + by_class * start + by_place * place)
        self.range[...] = np.where(hit, guess, by_place * share)
        self.low += add
        over = self.low < add
        if over.any():
            at = self.pos[over] - 1
            while len(at):
                self.words[at] += np.uint16(1)
                at = at[self.words[at] == 0] - 1
        self.words[self.pos] = self.low >> _48
        out = self.range < _SMALL
        self.pos += out
        by = out.astype(_U) << _U(4)
        self.low <<= by
        self.range <<= by
        more = np.flatnonzero(self.range < _SMALL)
        while len(more):
            self.words[self.pos[more]] = self.low[more] >> _48
            self.pos[more] += 1
            self.low[more] <<= _16
            self.range[more] <<= _16
            more = more[self.range[more] < _SMALL]

    def payloads(self) -> list[bytes]:
        for shift in (48, 32, 16, 0):
            self.words[self.pos] = (self.low >> _U(shift)) & _U(0xFFFF)
            self.pos += 1
        return [self.words[k * self.width : e].astype("<u2").tobytes() for k, e in enumerate(self.pos.tolist())]


class _In:
    """The decoder to :class:`_Out`."""

    def __init__(self, payloads: list[bytes]):
        n = np.array([len(p) // 2 for p in payloads])
        self.words = np.concatenate([np.frombuffer(b"".join(payloads), "<u2"), np.zeros(4, np.uint16)]).astype(_U)
        self.pos, self.end = np.cumsum(n) - n, len(self.words) - 1
        self.code, self.range = np.zeros(len(n), _U), np.full(len(n), _FULL, _U)
        for _ in range(4):
            self.code = (self.code << _16) | self.words[np.minimum(self.pos, self.end)]
            self.pos = self.pos + 1

    def first(self, k: int) -> _In:
        part = object.__new__(_In)
        part.code, part.range, part.pos, part.words, part.end = self.code[:k], self.range[:k], self.pos[:k], self.words, self.end
        return part

    def hits(self, chance: np.ndarray) -> np.ndarray:
        self.guess = (self.range >> _U(12)) * chance
        self.hit = self.code < self.guess
        return self.hit

    def classes(self) -> np.ndarray:
        self.by_class = (self.range - self.guess) >> _U(CLASS_BITS)
        self.rest = self.code - np.where(self.hit, _U(0), self.guess)
        return np.minimum(self.rest // self.by_class, _U((1 << CLASS_BITS) - 1)).astype(np.int64)

    def places(self, of_class: np.ndarray) -> np.ndarray:
        self.rest -= np.where(self.hit, _U(0), self.by_class * (of_class >> _16))
        self.by_place = (self.by_class * (of_class & _LOW16)) >> _U(SHARE_BITS)
        return np.minimum(self.rest // self.by_place, _U((1 << SHARE_BITS) - 1)).astype(np.int64)

    def take(self, of_place: np.ndarray) -> None:
        self.rest -= np.where(self.hit, _U(0), self.by_place * (of_place >> _16))
        self.range[...] = np.where(self.hit, self.guess, self.by_place * (of_place & _LOW16))
        out = self.range < _SMALL
        by = out.astype(_U) << _U(4)
        self.code[...] = np.where(out, (self.rest << _16) | np.take(self.words, self.pos, mode="clip"), self.rest)
        self.pos += out
        self.range <<= by
        more = np.flatnonzero(self.range < _SMALL)
        while len(more):
            self.code[more] = (self.code[more] << _16) | np.take(self.words, self.pos[more], mode="clip")
            self.pos[more] += 1
            self.range[more] <<= _16
            more = more[self.range[more] < _SMALL]


def _run(coder: _Out | _In, grid: np.ndarray, sizes: list[int], prior: _Prior, known: bool) -> None:
    """Codes ``grid`` (steps, lanes), or fills it in; only the last lane may be shorter."""
    n = len(sizes)
    state = [np.zeros(n * SLOTS, np.int32), np.zeros(n * SLOTS, np.int32), np.repeat(CHANCE[:, None], n, axis=1).reshape(-1)]
    lane = [np.full(n, BASE, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32)]
    weight = np.full((3, n), 22000, np.int32)
    for k, begin, end in ((n, 0, sizes[-1]), (n - 1, sizes[-1], sizes[0])):
        if k and begin < end:
            _steps(coder.first(k), grid[:, :k], begin, end, prior, known, *state, weight[:, :k], n, *(x[:k] for x in lane))


def _steps(coder, grid, begin, end, prior, known, two_ids, one_id, chance, weight, n, base, last, before) -> None:
    """One id of each lane a step; ``last`` and ``before`` are scrambled forms of the two ids before."""
    k, top = grid.shape[1], (1 << TRUST_BITS) - 1
    lanes = np.arange(k)
    slots, bases = lanes * SLOTS, np.arange(2)[:, None] * (n << TRUST_BITS) + (lanes << TRUST_BITS)
    context, s = np.empty((2, k), np.int64), np.empty((3, k), np.int32)
    told = prior.context[grid[begin - 1]] if begin else np.full(k, CONTEXTS, np.uint8)
    for t in range(begin, end):
        if known and (t == begin or t % RENEW == 0):  # what is known of the next ids
            since = t
            ahead = grid[t : min(end, t - t % RENEW + RENEW)]
            after = prior.context[ahead]
            behind = np.concatenate([told[None], after[:-1]]).astype(np.int32)
            told = after[-1]
            class_of, place_of = prior.packed[behind * CLASSES + prior.kind[ahead]].astype(_U), prior.place[ahead].astype(_U)
        slot2 = slots + (((last + (before >> 3)) >> 7) & (SLOTS - 1))
        slot1 = slots + ((last >> 9) & (SLOTS - 1))
        two, one = two_ids[slot2], one_id[slot1]
        trust2, trust1, id2, id1 = two & top, one & top, two >> TRUST_BITS, one >> TRUST_BITS
        guess = np.where(trust2 > 0, id2, id1)
        np.add(bases[0], trust2, out=context[0])
        np.add(bases[1], trust1, out=context[1])
        p = chance[context]
        STRETCH.take(p, out=s[:2], mode="clip")
        STRETCH.take(base, out=s[2], mode="clip")
        dot = weight * s
        mixed = SQUASH.take(((dot[0] + dot[1] + dot[2]) >> 16) + 2047, mode="clip")
        if known:
            got = grid[t]
            hit = got == guess
            coder.put(mixed.astype(_U), hit, class_of[t - since], place_of[t - since])
        else:
            hit = coder.hits(mixed.astype(_U))
            told = told.astype(np.int64)
            kind = prior.class_at[(told << CLASS_BITS) + coder.classes()].astype(np.int64)
            other = prior.symbol[(kind << SHARE_BITS) + coder.places(prior.packed[told * CLASSES + kind].astype(_U))]
            coder.take(prior.place[other].astype(_U))
            got = np.where(hit, guess, other)
            grid[t] = got
            told = prior.context[got]
        goal = hit * np.int32(4095)
        chance[context] = p + ((goal - p) >> 4)
        base += (goal - base) >> 5
        if t % 8 == 0:
            np.clip(weight + ((s * ((goal - mixed) * 32) + 512) >> 10), -(1 << 18), 1 << 18, out=weight)
        fresh = (got << TRUST_BITS) + 1
        two_ids[slot2] = np.where(id2 == got, two + (trust2 < top), fresh)
        one_id[slot1] = np.where(id1 == got, one + (trust1 < top), fresh)
        before[...] = last
        np.multiply(got, 40503, out=last)


def encode_blocks(ids: np.ndarray, prior: _Prior) -> tuple[list[int], list[bytes]]:
    """(ids in each block, coded block); at most LANES blocks at a time."""
    n = max(1, -(-len(ids) // BLOCK))
    sizes, coded = [min(BLOCK, len(ids) - k * BLOCK) for k in range(n)], []
    for k in range(0, n, LANES):
        own = sizes[k : k + LANES]
        grid = np.zeros(len(own) * BLOCK, np.int32)
        part = ids[k * BLOCK : (k + LANES) * BLOCK]
        grid[: len(part)] = part
        out = _Out(len(own), own[0])
        _run(out, np.ascontiguousarray(grid.reshape(-1, BLOCK).T), own, prior, True)
        coded += out.payloads()
    return sizes, coded


def decode_blocks(sizes: list[int], coded: list[bytes], prior: _Prior) -> np.ndarray:
    parts = [np.zeros(0, np.uint32)]
    for k in range(0, len(sizes), LANES):
        own = sizes[k : k + LANES]
        grid = np.zeros((BLOCK, len(own)), np.int32)
        _run(_In(coded[k : k + LANES]), grid, own, prior, False)
        parts.append(grid.T.reshape(-1)[: sum(own)].astype(np.uint32))
    return np.concatenate(parts)


def encode_file(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, vocab: int) -> bytes:
    if len(ids) and int(ids.max()) >= vocab:
        raise ValueError(f"id {int(ids.max())} is not below the vocabulary {vocab}")
    prior = _Prior.of(vocab, ids)
    sizes, coded = encode_blocks(ids, prior)
    docs = zlib.compress(doc_ids.astype("<i8").tobytes() + counts.astype("<u4").tobytes(), 6)
    shares = prior.pack()
    ends = np.cumsum(sizes)
    crcs = crc_rows(ids, ends - sizes, np.array(sizes))
    heads = np.array([sizes, [len(c) // 2 for c in coded], crcs], np.int64).T.astype("<u4").tobytes()
    return _HEAD.pack(b"TKR3", vocab, len(doc_ids), len(ids), len(sizes), len(docs), len(shares)) + docs + shares + heads + b"".join(coded)


def decode_file(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, counts, token ids); raises ValueError for a damaged file."""
    magic, vocab, n_docs, n_ids, n_blocks, table, shares = _HEAD.unpack_from(data)
    if magic != b"TKR3":
        raise ValueError("not a token file")
    at = _HEAD.size
    raw = zlib.decompress(data[at : at + table])
    doc_ids, counts = np.frombuffer(raw, "<i8", n_docs), np.frombuffer(raw, "<u4", n_docs, 8 * n_docs)
    at += table
    prior = _Prior.unpack(vocab, data[at : at + shares])
    at += shares
    heads = np.frombuffer(data, "<u4", 3 * n_blocks, at).reshape(-1, 3).astype(np.int64)
    ends = at + 12 * n_blocks + np.cumsum(2 * heads[:, 1])
    coded = [data[e - 2 * w : e] for e, w in zip(ends.tolist(), heads[:, 1].tolist(), strict=True)]
    ids = decode_blocks(heads[:, 0].tolist(), coded, prior)
    stops = np.cumsum(heads[:, 0])
    for k, (found, wanted) in enumerate(zip(crc_rows(ids, stops - heads[:, 0], heads[:, 0]), heads[:, 2].tolist(), strict=True)):
        if found != wanted:
            raise ValueError(f"block {k} has checksum {found}, not {wanted}")
    if len(ids) != n_ids or int(counts.sum()) != n_ids:
        raise ValueError("the document table does not match the ids")
    return doc_ids, counts, ids


FILE = "part int, seq int, before bigint, n_docs bigint, n_tokens bigint, data binary"


def write_files(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, vocab: int = 49_408) -> DataFrame:
    """A table of files in ascending id order by (part, seq), in the shared folder."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(path), TaskContext.get().partitionId()
        held, size, seq, before = [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            doc, counts, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            data = encode_file(doc, counts, ids, vocab)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([before]), pa.array([len(doc)]), pa.array([len(ids)]), pa.array([data], pa.binary())], names=["part", "seq", "before", "n_docs", "n_tokens", "data"])

        for batch in batches:
            texts, doc = as_bytes(batch.column(1)), batch.column(0).fill_null(_NULL_ID).to_numpy()
            for i, j in slices(texts):
                ids, counts = with_end(*enc.encode(texts[i:j]), end_id)
                held.append((doc[i:j], counts, ids))
                size += len(ids)
                if size >= BLOCK * LANES:
                    yield flush()
                    seq, before, size = seq + 1, before + size, 0
                    held.clear()
        if held:
            yield flush()

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
    order = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc", "tie").sortWithinPartitions("doc", "tie")
    return materialize(order.mapInArrow(run, FILE), "tokens")


def read_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    spark = files.sparkSession
    total, bases = 0, []
    for r in files.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").toLocalIterator():
        bases.append((r["part"], total))  # one row for each partition that wrote
        total += r["n"]
    base = spark.createDataFrame(bases, "part int, base bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc, counts, ids = decode_file(data.as_py())
                starts = np.cumsum(counts, dtype=np.int64) - counts
                yield pa.RecordBatch.from_arrays([pa.array(doc, mask=doc == _NULL_ID), pa.array(starts + at), pa.array(counts.astype(np.int64)), pa.array(crc_rows(ids, starts, counts), pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = files.join(F.broadcast(base), "part").select((F.col("base") + F.col("before")).alias("at"), "data")
    return placed.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
