"""Benchmark passages in training documents, copied, edited or paraphrased.

Items are a stated query set: they are read in blocks of bounded size and each
block is held against every document.  Every word 3-gram of an item seeds the
search, however often it occurs: a passage copied into many documents makes its
own seeds common.  Documents that share at least two seeds with an item near
one place are aligned there by Smith-Waterman over whole words, unless the
place holds too few of the item's words for the score.  The scan works on one
document at a time and shuffles nothing.

Defined cases: null or blank texts match nothing; items with fewer words than
a seed match nothing; repeated rows give repeated results; an empty table on
either side gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm.resident import forget
from casewright.llm.words import as_bytes, ngrams, shingle_hashes, slices, texts_words, word_hashes

SEED = 3
HIT = "doc bigint, item_id bigint, score double, matched int, item_words int, start bigint, stop bigint"


class Items:
    """A block of items: their words, and their seeds as one sorted array."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        self.ids = [r[0] for r in rows]
        self.words = [word_hashes((r[1] or "").encode()) for r in rows]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        grams = [shingle_hashes(w, SEED) for w in self.words]
        flat = np.concatenate([*grams, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(rows)), [len(g) for g in grams])
        self.seeds, back = np.unique(flat, return_inverse=True)
        pairs = np.unique(np.stack([back, owner], 1), axis=0) if len(flat) else np.zeros((0, 2), np.int64)
        self.owners, self.first = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.seeds) + 1))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions that hold a seed, and the seeds' numbers."""
        if not len(self.seeds):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.seeds, hashes), len(self.seeds) - 1)
        hit = np.flatnonzero(self.seeds[at] == hashes)
        return hit, at[hit]


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """Best local alignment: (score, end in window); match 2, other steps -1."""
    step = np.arange(len(window) + 1)
    above, best, end = np.zeros(len(window) + 1, np.int64), 0, 0
    for w in item:
        t = np.zeros(len(window) + 1, np.int64)
        t[1:] = np.maximum(above[:-1] + np.where(window == w, 2, -1), above[1:] - 1)
        np.maximum(t, 0, out=t)
        above = np.maximum.accumulate(t + step) - step
        k = int(above.argmax())
        if above[k] > best:
            best, end = int(above[k]), k
    return best, end


def matches(words: np.ndarray, pos: np.ndarray, seeds: np.ndarray, items: Items, min_seeds: int, min_score: float) -> list[tuple]:
    """Items found in one document: (item, score, matched words, start, stop)."""
    n = items.first[seeds + 1] - items.first[seeds]
    k = np.arange(int(n.sum())) + np.repeat(items.first[seeds] - np.cumsum(n) + n, n)
    owner, at, seed = items.owners[k], np.repeat(pos, n), np.repeat(seeds, n)
    # items of which the whole document holds too few different seeds go first
    several, kinds = np.unique(np.unique(owner * len(items.seeds) + seed) // len(items.seeds), return_counts=True)
    several = several[kinds >= np.where(items.sizes[several] >= SEED + min_seeds, min_seeds, 1)]
    use = np.isin(owner, several)
    owner, at, seed = owner[use], at[use], seed[use]
    order = np.lexsort((at, owner))
    owner, at, seed = owner[order], at[order], seed[order]
    found = []
    for i in several.tolist():
        lo, hi = np.searchsorted(owner, [i, i + 1])
        item, best = items.words[i], None
        m, places = len(item), at[lo:hi]
        for part in np.split(np.arange(lo, hi), np.flatnonzero(np.diff(places) > 2 * m) + 1):
            few = min_seeds if m >= SEED + min_seeds else 1
            if len(np.unique(seed[part])) < few:
                continue
            # seeds crowded over a long stretch are aligned in overlapping windows
            a, z = max(0, int(at[part[0]]) - m), int(at[part[-1]]) + SEED + m
            for s in range(a, z, 6 * m):
                window = words[s : min(z, s + 8 * m)]
                # each matched word gives 2, so fewer than this can't reach the least score
                if np.isin(item, window).sum() < min_score * m or np.isin(window, item).sum() < min_score * m:
                    continue
                score, end = align(item, window)
                if best is None or score > best[0]:
                    back, begin = align(item[::-1], window[:end][::-1])
                    best = (score, s + end - begin, s + end)
        if best and best[0] >= min_score * 2 * m:
            found.append((items.ids[i], best[0] / (2 * m), int(np.isin(item, words[best[1] : best[2]]).sum()), m, best[1], best[2]))
    return found


def _search(docs: DataFrame, items: Items, min_seeds: int, min_score: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            texts, ids = as_bytes(batch.column(1)), batch.column(0).to_pylist()
            out = []
            for i, j in slices(texts):
                words, counts = texts_words(texts[i:j])
                h, owner = ngrams(words, counts, SEED)
                hit, seed = items.find(h)
                ends, grams = np.cumsum(counts), np.bincount(owner, minlength=j - i)
                before = np.cumsum(grams) - grams
                for k in np.unique(owner[hit]).tolist():
                    own = owner[hit] == k
                    text = words[ends[k] - counts[k] : ends[k]]
                    out += [(ids[i + k], *x) for x in matches(text, hit[own] - before[k], seed[own], items, min_seeds, min_score)]
            if out:
                names = ["doc", "item_id", "score", "matched", "item_words", "start", "stop"]
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return docs.mapInArrow(run, HIT)


def _blocks(benchmark: DataFrame, max_chars: int) -> Iterator[list[tuple[int, str | None]]]:
    block, chars = [], 0
    for r in benchmark.toLocalIterator():
        block.append((r[0], r[1]))
        chars += len(r[1] or "")
        if chars >= max_chars:
            yield block
            block, chars = [], 0
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_seeds: int = 2, min_score: float = 0.5, block_chars: int = 8_000_000) -> DataFrame:
    """(doc, item_id, score, matched, item_words, start, stop) for every item found in a document.

    ``block_chars`` bounds the items that a task holds at once; each block of
    items costs one scan of the documents.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
    out = spark.createDataFrame([], HIT)
    for rows in _blocks(benchmark.select(F.col(item_col).cast("bigint"), F.col(item_text)), block_chars):
        out = out.unionByName(_search(texts, Items(rows), min_seeds, min_score))
    return out
