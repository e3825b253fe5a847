"""Quality rules: document statistics scored by boosted trees.

The trees are grown here from labelled documents with a second-order loss and
histogram splits; on chosen statistics a split may only lower the score as the
statistic grows.  The fitted trees lie in flat numpy node arrays, and a batch
of documents walks all trees level by level.

Defined cases: null or blank text has no words and fails the base rules;
repeated rows give equal rows; labels that are null count for nothing, several
for one id count by their mean; without labels of both kinds the base rules
alone decide; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.llm.storage import materialize
from casewright.llm.words import IS_BLANK, SLICE, as_bytes, hash_spans, mix, ngrams, slices, texts_words, word_hashes

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bytes", "n_digits", "n_upper", "n_stops", "n_marks", "n_distinct"]
#: Statistics of the trees, and the direction that they are held to.
FEATURES = {"log_words": 0, "mean_word": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "words_per_line": 0, "digit_share": 0, "upper_share": 0, "stop_share": 0, "mark_share": -1, "distinct_share": 0}
_SYMBOL, _DIGIT, _UPPER, _STOP, _MARK, _HEAD = (np.zeros(256, bool) for _ in range(6))
for _table, _chars in ((_SYMBOL, b"#*$%&|<>"), (_DIGIT, b"0123456789"), (_UPPER, bytes(range(65, 91))), (_STOP, b".,;:"), (_MARK, b"!?")):
    _table[list(_chars)] = True
_HEAD[:] = (np.arange(256) & 0xC0) != 0x80


def _line_hashes(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the lines of a byte array that hold a word."""
    ends = np.concatenate([np.flatnonzero(b == 10), [len(b)]])
    starts = np.concatenate([[0], ends[:-1] + 1])
    inked = np.concatenate([[0], np.cumsum(~IS_BLANK[b])])
    use = inked[ends] > inked[starts]
    return starts[use], hash_spans(b, starts[use], (ends - starts)[use])


def _distinct(owner: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct hashes of each owner."""
    key = mix(h + owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    first = np.unique(key, return_index=True)[1]
    return np.bincount(owner[first], minlength=n)


def statistics(texts: list[bytes]) -> np.ndarray:
    """(texts, COUNTS) for texts that fit a slice together, or one longer text."""
    n, out = len(texts), np.zeros((len(texts), len(COUNTS)), np.int64)
    if n == 1 and len(texts[0]) > 2 * SLICE:
        words, counts = word_hashes(texts[0], lower=False), np.zeros(1, np.int64)
        counts[0] = len(words)
        lines, line_owner, plain = [], [], np.zeros((1, 6), np.int64)
        at = 0
        while at < len(texts[0]):  # whole lines, as many as fill a slice
            end = texts[0].find(b"\n", at + SLICE)
            end = len(texts[0]) if end < 0 else end + 1
            b = np.frombuffer(texts[0], np.uint8, end - at, at)
            lines.append(_line_hashes(b)[1])
            plain += _plain(b, np.array([0]))
            at = end
        h = np.concatenate(lines)
        line_owner = np.zeros(len(h), np.int64)
        breaks = np.array([texts[0].count(b"\n")])
    else:
        words, counts = texts_words(texts, lower=False)
        b = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts])
        starts, h = _line_hashes(b)
        line_owner = np.searchsorted(ends, starts, side="right")
        plain = _plain(b, ends - np.diff(ends, prepend=0))
        breaks = np.add.reduceat(b == 10, ends - np.diff(ends, prepend=0), dtype=np.int64) - 1
    out[:, 0] = counts
    out[:, [1, 2, 7, 8, 9, 10]] = plain
    out[:, 3] = np.bincount(line_owner, minlength=n) - _distinct(line_owner, h, n)
    out[:, 5], out[:, 6] = breaks + 1, [len(t) for t in texts]
    owner = np.repeat(np.arange(n), counts)
    out[:, 11] = _distinct(owner, words, n)
    g, own = ngrams(words, counts, 3)
    if len(g):
        key = mix(g + own.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        _, back, found = np.unique(key, return_inverse=True, return_counts=True)
        before = np.cumsum(counts) - counts
        place = np.arange(len(g)) - np.searchsorted(own, own) + before[own]
        again = place[found[back] > 1]
        covered = np.zeros(len(words) + 1, bool)
        for k in range(3):
            covered[again + k] = True
        out[:, 4] = np.bincount(owner, covered[: len(owner)], n).astype(np.int64)
    return out


def _plain(b: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums over bytes: code points in words, symbols, digits, capitals, stops, marks."""
    kinds = (_HEAD[b] & ~IS_BLANK[b], _SYMBOL[b], _DIGIT[b], _UPPER[b], _STOP[b], _MARK[b])
    return np.stack([np.add.reduceat(k, starts, dtype=np.int64) for k in kinds], 1)


def features(counts: np.ndarray) -> np.ndarray:
    c = {name: counts[:, k].astype(float) for k, name in enumerate(COUNTS)}
    words, size = np.maximum(c["n_words"], 1), np.maximum(c["n_bytes"], 1)
    return np.stack([np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / words, c["n_dup_lines"] / c["n_lines"], c["n_repeat_words"] / words, c["n_words"] / c["n_lines"], c["n_digits"] / size, c["n_upper"] / size, c["n_stops"] / words, c["n_marks"] / words, c["n_distinct"] / words], 1)


class Trees:
    """Boosted trees as node arrays; a leaf's children are itself."""

    def __init__(self) -> None:
        self.feature, self.cut, self.left, self.right, self.value = ([] for _ in range(5))
        self.roots: list[int] = []
        self.depth, self.start = 0, 0.0

    def _node(self, value: float) -> int:
        k = len(self.feature)
        self.feature.append(0), self.cut.append(np.inf), self.left.append(k), self.right.append(k), self.value.append(value)
        return k

    def freeze(self) -> Trees:
        for name, kind in (("feature", np.int32), ("cut", float), ("left", np.int32), ("right", np.int32), ("value", float), ("roots", np.int32)):
            setattr(self, name, np.array(getattr(self, name), kind))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sum over trees for each row of ``x``, all trees at once."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[row, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
        return self.start + self.value[at].sum(axis=1)


def boost(x: np.ndarray, y: np.ndarray, monotone: list[int], rounds: int = 60, depth: int = 4, bins: int = 48, rate: float = 0.2, ridge: float = 1.0, least: int = 20) -> Trees:
    """Logistic boosting; ``monotone`` has -1, 0 or 1 for each column."""
    trees = Trees()
    trees.depth = depth
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    trees.start = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)
    margin = np.full(len(y), trees.start)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)

        def grow(rows: np.ndarray, level: int, low: float, high: float, g: np.ndarray = g, h: np.ndarray = h) -> int:
            gs, hs = g[rows].sum(), h[rows].sum()
            node = trees._node(rate * float(np.clip(-gs / (hs + ridge), low, high)))
            if level == depth or len(rows) < 2 * least:
                margin[rows] += trees.value[node]
                return node
            best = (1e-6, None)
            for f in range(x.shape[1]):
                b = binned[rows, f]
                width = len(edges[f]) + 1
                gl, hl, nl = (np.cumsum(np.bincount(b, w, width))[:-1] for w in (g[rows], h[rows], None))
                wl = np.clip(-gl / (hl + ridge), low, high)
                wr = np.clip(-(gs - gl) / (hs - hl + ridge), low, high)
                gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                bad = (nl < least) | (len(rows) - nl < least) | (monotone[f] * (wr - wl) < 0)
                gain = np.where(bad, 0, gain)
                if len(gain) and gain.max() > best[0]:
                    k = int(gain.argmax())
                    best = (gain[k], (f, k, (wl[k] + wr[k]) / 2))
            if best[1] is None:
                margin[rows] += trees.value[node]
                return node
            f, k, middle = best[1]
            go = binned[rows, f] <= k
            bounds = ((low, high), (low, high)) if monotone[f] == 0 else ((middle, high), (low, middle)) if monotone[f] < 0 else ((low, middle), (middle, high))
            trees.feature[node], trees.cut[node] = f, float(edges[f][k])
            trees.left[node] = grow(rows[go], level + 1, *bounds[0])
            trees.right[node] = grow(rows[~go], level + 1, *bounds[1])
            return node

        trees.roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf))
    return trees.freeze()


def document_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, COUNTS) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(1))
            for i, j in slices(texts):
                c = statistics(texts[i:j])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(c[:, k]) for k in range(len(COUNTS)))], names=["doc", *COUNTS])

    return docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text")).mapInArrow(run, ", ".join(["doc bigint", *(f"{c} bigint" for c in COUNTS)]))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def fit(counts: DataFrame, labels: DataFrame, sample_rows: int = 20_000, label_id: str = "doc_id", label_col: str = "quality") -> Trees | None:
    """Trees from about ``sample_rows`` labelled documents, drawn by a hash of the id."""
    known = labels.select(F.col(label_id).cast("bigint").alias("doc"), F.col(label_col).alias("y")).where("doc is not null and y is not null").groupBy("doc").agg(F.avg("y").alias("y"))
    share = min(1.0, sample_rows / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("doc"), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = counts.join(drawn, "doc").select(*COUNTS, "y").toPandas()
    y = (rows["y"].to_numpy() >= 0.5).astype(float)
    if len(rows) < 50 or y.min() == y.max():
        return None
    return boost(features(rows[COUNTS].to_numpy(np.int64)), y, list(FEATURES.values()))


def judge(docs: DataFrame, labels: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 20_000) -> DataFrame:
    """(doc, COUNTS, base_failed, score, kept)."""
    counts = materialize(document_counts(docs, id_col, text_col), "counts")
    trees = fit(counts, labels, sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = np.stack([batch.column(k).to_numpy() for k in range(1, len(COUNTS) + 1)], 1)
            score = 1 / (1 + np.exp(-trees.margin(features(c)))) if trees else np.ones(len(c))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, "score"])

    scored = counts.mapInArrow(run, counts.schema.simpleString()[7:-1].replace(":", " ") + ", score double")
    return scored.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= least))
