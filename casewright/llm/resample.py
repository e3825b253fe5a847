"""Importance resampling towards a target text collection.

Texts are bags of hashed word n-grams.  Inside a task the words of a bounded
block of documents become numbers, and the suffixes of the block, cut off after
``order`` words, are sorted: neighbours with a common prefix (LCP) of n words or
more form a run, which is one distinct n-gram.  Each run is hashed once and its
bucket scattered back to its occurrences.  A task keeps a document's buckets as
packed sorted numbers and counts all buckets of its block; the block counts
meet in one sum of at most ``buckets`` rows.  The gains of the buckets, as many
numbers, then score the packed documents without reading a text again.

The draw is a Gumbel top-k: a range-partitioned sort with the ranks counted
from the sizes of the ranges before, never a sort in one task.

Defined cases: null or blank texts have no features and weight 0; documents of
fewer than ``min_words`` words are scored and never drawn; equal scores go to
the smaller id, rows that repeat an id and a text have neighbouring ranks; a
null id is the word 'null' in the seed and comes last among ties; very long
texts are hashed in slices; an empty target makes gains of the corpus alone; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.llm.resident import forget
from casewright.llm.storage import materialize
from casewright.llm.words import LOWER, SLICE, as_bytes, hash_spans, slices

BLOCK = 4 << 20
PACKED = "doc_id bigint, n_words bigint, n_features bigint, packed binary, sums array<bigint>"
#: Bytes of words after lower-casing: digits, letters and all of characters beyond ASCII.
IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
#: Beyond this many bytes a word goes to zlib on its own.
SHORT = 48


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


CRC = _crc_table()


def _zeros(x: np.ndarray) -> np.ndarray:
    """A crc32 moved on by one zero byte; crc(a + b) is crc(a) moved on by len(b), xor crc(b)."""
    return CRC[x & 255] ^ (x >> np.uint32(8))


def _moves() -> np.ndarray:
    """[n, k, v]: the value v of byte k of a crc32, moved on by n bytes."""
    out = np.empty((SHORT + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(SHORT):
        out[n + 1] = _zeros(out[n])
    return out


MOVES = _moves()


def _moved(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each crc32 moved on by its number of bytes."""
    crc = crc.copy()
    while (far := n > SHORT).any():  # a very long word, SHORT bytes at a time, then in powers of it
        at = np.flatnonzero(far)
        for i in at.tolist():
            crc[i] = _moved_far(int(crc[i]), int(n[i]) // SHORT)
        n = np.where(far, n % SHORT, n)
    flat, row = MOVES.reshape(-1), n.astype(np.int64) * 1024
    out = flat[row + (crc & 255)]
    for k in (1, 2, 3):
        out ^= flat[row + (256 * k) + ((crc >> np.uint32(8 * k)) & 255)]
    return out


def _moved_far(crc: int, times: int) -> int:
    """A crc32 moved on by ``times`` times SHORT bytes, by squaring the move."""
    move = MOVES[SHORT]
    while times:
        if times & 1:
            crc = int(np.bitwise_xor.reduce([move[k, (crc >> (8 * k)) & 255] for k in range(4)]))
        square = np.zeros_like(move)
        for k in range(4):
            square ^= move[k, (move >> np.uint32(8 * k)) & 255]
        move, times = square, times >> 1
    return crc


def _word_crcs(b: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """crc32 of each span of a byte array."""
    c = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-lens, kind="stable")
    s, n = starts[order], lens[order]
    for j in range(min(SHORT, int(n[0])) if len(n) else 0):
        k = np.searchsorted(-n, -j, "left")  # spans of more than j bytes come first
        c[:k] = CRC[(c[:k] ^ b[s[:k] + j]) & 255] ^ (c[:k] >> np.uint32(8))
    out = np.empty_like(c)
    out[order] = c ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(lens > SHORT).tolist():
        out[i] = zlib.crc32(b[starts[i] : starts[i] + lens[i]].tobytes())
    return out


def _spans(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(b) + 2, bool)
    inside[1:-1] = IN_WORD[b]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2] - edge[::2]


def _cut(text: bytes) -> Iterator[bytes]:
    """A text in slices that end outside of words."""
    at = 0
    while at < len(text):
        end = min(len(text), at + SLICE)
        while end < len(text) and IN_WORD[LOWER[text[end]]]:
            end += 1
        yield text[at:end]
        at = end


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words in a row: number, by distinct word its crc32 and bytes; and the number of words of each text."""
    hashes, crcs, sizes, counts = [], [], [], np.zeros(len(texts), np.int64)
    for i, j in slices(texts):
        for part in _cut(texts[i]) if j == i + 1 else [b" ".join(texts[i:j])]:
            b = LOWER[np.frombuffer(part, np.uint8)]
            starts, lens = _spans(b)
            h = hash_spans(b, starts, lens)
            if j == i + 1:
                counts[i] += len(h)
            else:
                counts[i:j] = np.diff(np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts[i:j]])), prepend=0)
            kinds, first, back = np.unique(h, return_index=True, return_inverse=True)
            hashes.append(h)
            crcs.append(_word_crcs(b, starts[first], lens[first])[back])
            sizes.append(lens)
    none = np.zeros(0, np.uint64)
    _, first, number = np.unique(np.concatenate([none, *hashes]), return_index=True, return_inverse=True)
    crc, size = np.concatenate([none.astype(np.uint32), *crcs]), np.concatenate([none.astype(np.int64), *sizes])
    return number, crc[first], size[first], counts


def buckets_of(texts: list[bytes], order: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of every n-gram occurrence, its text, words of each text)."""
    number, crc, size, counts = words(texts)
    n, kinds = len(number), len(crc) + 1
    if kinds.bit_length() * order > 63:
        raise ValueError("a block holds too many different words for this order")
    owner = np.repeat(np.arange(len(texts)), counts)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(n)  # words from here to the end of the text
    padded = np.concatenate([number + 1, np.zeros(order, np.int64)])
    suffix = np.zeros(n, np.int64)
    for k in range(order):
        suffix = suffix * kinds + np.where(left > k, padded[k : k + n], 0)
    sa = np.argsort(suffix, kind="stable")
    ordered, out, owners = suffix[sa], [], []
    space = np.uint32(zlib.crc32(b" "))
    one = np.ones(1, np.int64)
    for k in range(1, order + 1):
        # neighbours whose prefixes of k words differ, that is with an LCP below k, part the runs
        prefix = ordered // kinds ** (order - k)
        starts_run = np.empty(n, bool)
        starts_run[:1] = True
        np.not_equal(prefix[1:], prefix[:-1], out=starts_run[1:])
        run = np.cumsum(starts_run) - 1
        first = sa[starts_run]
        whole = left[first] >= k  # shorter suffixes have no n-gram of k words
        at = first[whole]
        hashed = crc[number[at]]
        for m in range(1, k):
            w = number[at + m]
            hashed = _moved(_moved(hashed, np.broadcast_to(one, len(at))) ^ space, size[w]) ^ crc[w]
        of_run = np.zeros(len(first), np.int32)
        of_run[whole] = hashed % np.uint32(buckets)
        scattered = np.empty(n, np.int32)
        scattered[sa] = of_run[run]
        real = left >= k
        out.append(scattered[real])
        owners.append(owner[real])
    return np.concatenate(out), np.concatenate(owners), counts


def pack(sorted_numbers: np.ndarray) -> bytes:
    """Ascending numbers below 65536 as steps, low bytes apart from high bytes, deflated."""
    return zlib.compress(np.diff(sorted_numbers, prepend=0).astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(2, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u2").ravel().astype(np.int64))


def _featurizer(order: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packed documents, and one row of bucket counts a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            texts = as_bytes(batch.column(1))
            for i, j in slices(texts, BLOCK):
                bucket, owner, counts = buckets_of(texts[i:j], order, buckets)
                sums += np.bincount(bucket, minlength=buckets)
                keys = np.sort(owner * buckets + bucket)
                ends = np.searchsorted(keys, np.arange(j - i + 1) * buckets)
                packed = [pack(keys[a:b] - k * buckets) for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))]
                own = [batch.column(0).slice(i, j - i), pa.array(counts), pa.array(np.diff(ends)), pa.array(packed, pa.binary()), pa.nulls(j - i, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(own, names=["doc_id", "n_words", "n_features", "packed", "sums"])
        if sums.any():
            none = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*none, pa.array([sums.tolist()], pa.list_(pa.int64()))], names=["doc_id", "n_words", "n_features", "packed", "sums"])

    return run


def featurized(rows: DataFrame, order: int, buckets: int) -> DataFrame:
    """Rows (id, text) as packed documents (sums null) and counts of buckets (packed null), written."""
    if buckets > 1 << 16:
        raise ValueError("packed steps have two bytes")
    return materialize(rows.mapInArrow(_featurizer(order, buckets), PACKED), "features")


def _totals(features: DataFrame, buckets: int) -> np.ndarray:
    """Occurrences of each bucket; at most ``buckets`` rows reach the driver."""
    counted = features.where("sums is not null").select(F.posexplode("sums").alias("bucket", "n")).where("n > 0").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in counted.toLocalIterator():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(target share / corpus share)) of each bucket, each count plus one."""
    s, t, b = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((y + 1) * (s + b) / ((x + 1) * (t + b)))) for x, y in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def _weigher(gain: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = [int(gain[unpack(x)].sum()) for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    return run


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)) with u from the first 32 bits of sha256('seed:id')."""
    digits = F.substr(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256), F.lit(1), F.lit(8))
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("bigint")


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    """Rank 1 to k by score, then smaller id; null beyond."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    dealt = materialize(scored.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranked")
    sizes = {r["part"]: r["count"] for r in dealt.groupBy("part").count().toLocalIterator()}  # one row a range
    before, total = [], 0
    for part in sorted(sizes):
        before += [F.lit(part), F.lit(total)]
        total += sizes[part]
    if not before:
        return dealt.withColumn("rank", F.lit(None).cast("bigint")).drop("part")
    rank = F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.try_element_at(F.create_map(*before), F.col("part"))
    return dealt.withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= k, F.col("rank").cast("bigint"))).drop("part")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", order: int = 3, buckets: int = 10_000, share: tuple[int, int] = (5, 100), min_words: int = 20, seed: int = 42) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document; rank is null unless drawn.

    Of the N documents with ``min_words`` words, ``floor(share[0] * N / share[1])``
    are drawn.
    """
    features = featurized(docs.select(F.col(id_col).cast("bigint"), F.col(text_col)), order, buckets)
    wanted = featurized(target.select(F.lit(None).cast("bigint"), F.col(target_col)), order, buckets)
    gain = gains(_totals(features, buckets), _totals(wanted, buckets))
    weighed = features.where("packed is not null").select("doc_id", "n_words", "n_features", "packed").mapInArrow(_weigher(gain), "doc_id bigint, n_words bigint, n_features bigint, weight bigint")
    scored = materialize(weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "scored")
    able = scored.where(F.col("n_words") >= min_words)
    drawn = _ranked(able, share[0] * able.count() // share[1])
    return drawn.unionByName(scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("bigint")))
