"""Best-fit packing of documents into fixed-length sequences.

Every partition packs its pieces by best fit, longest first.  Bins that are
nearly full leave at once; the underfull ones become items of the next round,
in which fewer partitions pack the bins of several.  Best fit leaves no more
than one bin of at most half the capacity in a partition, and any further merge
takes such a bin.  So of the larger bins only the roomiest go on, as many as
there are small ones, and none that even the smallest bin does not fit into; a
histogram of fills, at most ``capacity`` rows, tells which.  What reaches the
last, single round is at most two bins for each partition of the first.

Defined cases: null or empty text is one end id; documents longer than the
capacity alone are cut; repeated rows are packed as often as they occur; an
empty table gives no sequence; other columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.llm.storage import materialize
from casewright.llm.tokens import crc_rows, default_path, encoder, with_end
from casewright.llm.words import as_bytes, slices

#: Words that a worker keeps: packing runs after other stages, in executors that these have filled.
WORDS = 700_000
PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PLACED = f"{PIECE}, offset bigint"
BIN = f"fill int, full boolean, items array<struct<{PLACED.replace(' ', ':').replace(',:', ',')}>>"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indexes of the items in each bin; longest first, ties by index."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (room left, bin), ascending
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        k = bisect_left(room, (sizes[i], -1))
        if k < len(room):
            left, b = room.pop(k)
            bins[b].append(i)
            if left > sizes[i]:
                insort(room, (left - sizes[i], b))
        else:
            bins.append([i])
            if sizes[i] < capacity:
                insort(room, (capacity - sizes[i], len(bins) - 1))
    return bins


def _cut(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, piece number and length of the pieces of documents of these lengths."""
    n = -(-counts // capacity)
    owner = np.repeat(np.arange(len(counts)), n)
    piece = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    return owner, piece, np.minimum(capacity, counts[owner] - piece * capacity)


def _cutter(path: str, capacity: int, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From documents to bins of one piece each."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, WORDS)
        for batch in batches:
            texts, doc = as_bytes(batch.column(1)), batch.column(0)
            for i, j in slices(texts):
                ids, counts = with_end(*enc.encode(texts[i:j]), end_id)
                owner, piece, length = _cut(counts, capacity)
                start = piece * capacity
                crc = crc_rows(ids, (np.cumsum(counts) - counts)[owner] + start, length)
                own = [doc.take(pa.array(owner + i)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.zeros(len(owner), np.int64))]
                items = pa.StructArray.from_arrays(own, names=["doc_id", "piece", "start", "length", "ids_crc32", "offset"])
                yield pa.RecordBatch.from_arrays([pa.array(length, pa.int32()), pa.array(length >= capacity), pa.ListArray.from_arrays(pa.array(np.arange(len(owner) + 1), pa.int32()), items)], names=["fill", "full", "items"])

    return cut


def _packer(capacity: int, nearly: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Best fit over all bins of a partition; members of merged bins are chained."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows).combine_chunks()
        sizes = table.column("fill").to_pylist()
        order, fills = [], []
        for members in best_fit(sizes, capacity):
            order.append(members)
            fills.append(sum(sizes[i] for i in members))
        items = table.column("items").combine_chunks()
        offsets = np.asarray(items.offsets)
        width = np.diff(offsets)
        for k in range(0, len(order), 2000):
            part = order[k : k + 2000]
            flat = np.fromiter((i for m in part for i in m), np.int64)
            n = width[flat]
            take = np.arange(int(n.sum())) + np.repeat(offsets[flat] - np.cumsum(n) + n, n)
            ends = np.concatenate([[0], np.cumsum([int(sum(width[i] for i in m)) for m in part])])
            taken = items.values.take(pa.array(take))
            length = taken.field("length").to_numpy()
            before = np.concatenate([[0], np.cumsum(length)])
            offset = before[:-1] - np.repeat(before[ends[:-1]], np.diff(ends))
            placed = pa.StructArray.from_arrays([*taken.flatten()[:-1], pa.array(offset)], names=[f.name for f in taken.type])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), placed)
            fill = np.array(fills[k : k + 2000], np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(fill), pa.array(fill >= nearly), lists], names=["fill", "full", "items"])

    return run


def _goes_on(rest: DataFrame, capacity: int) -> Column | None:
    """Which underfull bins can still be merged; None if no two fit together."""
    fills = sorted((r["fill"], r["count"]) for r in rest.groupBy("fill").count().toLocalIterator())
    small = sum(n for fill, n in fills if 2 * fill <= capacity)
    large = [(fill, n) for fill, n in fills if 2 * fill > capacity and fill + fills[0][0] <= capacity]
    if small + len(large) < 2:
        return None
    stays, left = 2 * F.col("fill") <= capacity, small
    for fill, n in large:
        if left <= 0:
            break
        # of equal fills a share, drawn by a hash of the first piece
        drawn = F.lit(True) if n <= left else F.pmod(F.xxhash64(F.col("items")[0]), F.lit(1_000_000)) < math.ceil(1_000_000 * left / n)
        stays, left = stays | ((F.col("fill") == fill) & drawn), left - n
    return stays


def pack(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1, slack: int = 2, fan_in: int = 8) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Bins with at most ``slack`` free places leave early; the others meet again
    in rounds of ``fan_in`` partitions each.
    """
    spark = docs.sparkSession
    cut, pack_all = _cutter(path or default_path(), capacity, end_id), _packer(capacity, capacity - slack)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    # one Python worker a task, which cuts and packs
    now = materialize(rows.mapInArrow(lambda batches: pack_all(cut(batches)), BIN), "bins")
    done, rest, parts = now.where("full"), now.where("not full"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    while True:
        stays = _goes_on(rest, capacity)
        if stays is None:
            break
        parts = max(1, -(-parts // fan_in))
        done = done.unionByName(rest.where(~stays))
        now = materialize(rest.where(stays).repartition(parts).mapInArrow(pack_all, BIN), "bins")
        done, rest = done.unionByName(now.where("full")), now.where("not full")
        if parts == 1:
            break
    numbered = done.unionByName(rest).select(F.monotonically_increasing_id().alias("sequence_id"), "items")
    return numbered.select("sequence_id", F.explode("items").alias("p")).select("p.doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32", "sequence_id", "p.offset")
