"""Chunks of texts that end where neighbouring sentences are about different things.

Sentences come in order with their vectors; a chunk ends where two neighbours
are less alike than a threshold, or where the next sentence no longer fits.
Rows of a text stream through a task in order, so that no text is held whole;
only the chunk at hand is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

APART, CHARS = 0.3, 2048
CHUNKS = "doc bigint, chunk int, first int, sentences int, content string"
SCHEMA = pa.schema([("doc", pa.int64()), ("chunk", pa.int32()), ("first", pa.int32()), ("sentences", pa.int32()), ("content", pa.string())])


def sentences(docs: DataFrame, text: Column) -> DataFrame:
    """(doc, k, sentence): trimmed sentences of texts (doc, ...), from 0; empty ones are none."""
    parts = F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return docs.select("doc", F.posexplode(F.filter(parts, lambda s: s != "")).alias("k", "sentence"))


def _parted(vectors: pa.ListArray, threshold: float) -> np.ndarray:
    """Of each vector but the first: is it less like the one before than the threshold; unknown ones part nothing.

    Products are added in the order of the parts, as a sum in SQL does.
    """
    flat, offsets = pc.cast(vectors.values, pa.float64()).to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
    size = np.where(vectors.is_null().to_numpy(zero_copy_only=False), -1, np.diff(offsets))
    both, out = np.where(size[1:] == size[:-1], size[1:], -1), np.zeros(max(0, len(size) - 1), bool)
    for n in np.unique(both[both >= 0]):
        at = np.flatnonzero(both == n)
        ab, aa, bb = np.zeros((3, len(at)))
        for k in range(n):
            x, y = flat[offsets[at] + k], flat[offsets[at + 1] + k]
            ab, aa, bb = ab + x * y, aa + x * x, bb + y * y
        norm = np.sqrt(aa) * np.sqrt(bb)
        out[at] = np.where(norm == 0, 0.0, ab / np.where(norm == 0, 1.0, norm)) < threshold
    return out


def _chunker(threshold: float, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, chunk, first, held, size, last = None, 0, 0, [], 0, None

        def closed() -> dict:
            return {"doc": doc, "chunk": chunk, "first": first, "sentences": len(held), "content": " ".join(held)}

        for b in batches:
            if not b.num_rows:
                continue
            vectors, out = b.column(3), []
            cuts = _parted(pa.concat_arrays([vectors[:1] if last is None else last, vectors]), threshold)
            last = vectors[-1:]
            for d, k, sentence, cut in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), cuts.tolist(), strict=True):
                if d != doc:
                    if held:
                        out.append(closed())
                    doc, chunk, first, held, size = d, 0, k, [], 0
                elif held and (cut or size + len(sentence) > most):
                    out.append(closed())
                    chunk, first, held, size = chunk + 1, k, [], 0
                held.append(sentence)
                size += len(sentence) + 1
            yield pa.RecordBatch.from_pylist(out, SCHEMA)
        if held:
            yield pa.RecordBatch.from_pylist([closed()], SCHEMA)

    return run


def chunked(rows: DataFrame, threshold: float = APART, most: int = CHARS) -> DataFrame:
    """(doc, chunk, first, sentences, content) of sentences (doc, k, sentence, vec); doc is not null."""
    return rows.select("doc", "k", "sentence", "vec").repartition("doc").sortWithinPartitions("doc", "k").mapInArrow(_chunker(threshold, most), CHUNKS)
