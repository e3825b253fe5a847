"""Language identification by interpolated Kneser-Ney character models.

Texts become lower-case letters with one blank for each other run.  Counts of
the 4-grams of each language over all training documents make a model of
orders 4 to 1 with absolute discounts and continuation counts.  Probabilities
of all languages lie beside one sorted array of n-gram hashes for each order;
an n-gram that is missing falls back by the weight of its context.  The answer
is the language of the lowest cross-entropy per character; a text of one letter
is scored after blanks, by the lower orders.  A text is rejected if that entropy
lies above what training texts of the language show.

Defined cases: null text or text without a letter is ``und`` with score 0 and
is rejected; ties go to the first language in binary order; with no training
text every answer is ``und``; empty tables give empty results; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.llm.resident import only
from casewright.llm.words import mix

ORDER = 4
CHARS = 1 << 17
UND = "und"


@cache
def _letters() -> np.ndarray:
    """Symbol of each code point: itself for letters, 1 beyond 16 bits, 0 for others."""
    out = np.zeros(0x110000, np.uint16)
    for i in range(0x110000):
        if chr(i).isalpha():
            out[i] = i if i < 1 << 16 else 1
    return out


def symbols(text: str) -> np.ndarray:
    """Letters of a text, each run of others as one 0; a 0 at both ends."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    s = np.concatenate([[0], _letters()[raw], [0]]).astype(np.uint64)
    keep = (s != 0) | np.concatenate([[True], s[:-1] != 0])
    return s[keep]


def grams(s: np.ndarray, n: int) -> np.ndarray:
    """n-grams as packed 16-bit symbols; the last symbol is lowest."""
    if len(s) < n:
        return np.zeros(0, np.uint64)
    g = s[: len(s) - n + 1]
    for k in range(1, n):
        g = (g << np.uint64(16)) | s[k : len(s) - n + 1 + k]
    return g


def _parts(text: str) -> Iterator[str]:
    for at in range(0, len(text), CHARS):
        yield text[max(0, at - ORDER + 1) : at + CHARS] if at else text[:CHARS]


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over documents (text, lang), summed within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, part in held.items():
                g, n = np.unique(np.concatenate(part), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.view(np.int64)), pa.array(n, pa.int64())], names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for part in _parts(text or ""):
                    g = grams(symbols(part), ORDER)
                    held.setdefault(lang, []).append(g)
                    size += len(g)
                    if size > 4_000_000:
                        yield from flush()
                        size = 0
        yield from flush()

    return docs.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _tables(counts: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """All 4-grams of each language, ascending, and their counts; 16 bytes each on their way here."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang in pc.unique(b.column(0)).to_pylist():
                own = b.filter(pc.equal(b.column(0), lang))
                g, n = (own.column(k).to_numpy().astype("<i8").tobytes() for k in (1, 2))
                yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([g], pa.binary()), pa.array([n], pa.binary())], names=["lang", "grams", "counts"])

    held: dict[str, list[tuple[bytes, bytes]]] = {}
    for r in counts.mapInArrow(pack, "lang string, grams binary, counts binary").collect():
        held.setdefault(r["lang"], []).append((r["grams"], r["counts"]))
    out = {}
    for lang in sorted(held):
        g = np.frombuffer(b"".join(x[0] for x in held[lang]), np.uint64)
        order = np.argsort(g)
        out[lang] = g[order], np.frombuffer(b"".join(x[1] for x in held.pop(lang)), np.int64)[order]
    return out


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k, back = np.unique(keys, return_inverse=True)
    return k, np.bincount(back, values, len(k))


class Model:
    """Sorted n-gram hashes with a log2 probability for each language beside them."""

    def __init__(self, langs: list[str], tables: list[tuple[np.ndarray, np.ndarray]]):
        """tables: for each language its 4-grams, ascending, and their counts."""
        self.langs, self.keys, self.logp, self.context, self.weight = langs, [], [], [], []
        counted = []
        for g, c in tables:  # from order 4 down: counts, then numbers of left contexts
            levels = [(g, c.astype(float))]
            for n in range(ORDER - 1, 0, -1):
                longer = levels[-1][0]
                levels.append(_sums(longer & np.uint64((1 << 16 * n) - 1), np.ones(len(longer))))
            counted.append(levels[::-1])
        alphabet = np.unique(np.concatenate([c[0][0] for c in counted] or [np.zeros(0, np.uint64)]))
        below = [np.full(1, 1 / (len(alphabet) + 1)) for _ in langs]
        self.floor = np.log2(np.array([b[0] for b in below])) if langs else np.zeros(0)
        known = np.zeros(0, np.uint64)
        for n in range(1, ORDER + 1):
            keys = np.unique(np.concatenate([c[n - 1][0] for c in counted] or [np.zeros(0, np.uint64)]))
            heads = np.unique(keys >> np.uint64(16))
            p, w, rest = np.zeros((len(keys), len(langs))), np.ones((len(heads), len(langs))), []
            for k in range(len(langs)):
                g, c = counted[k][n - 1]
                once, twice = (c == 1).sum(), (c == 2).sum()
                d = once / (once + 2 * twice) if once and twice else 0.5
                ctx, total = _sums(g >> np.uint64(16), c)
                kinds = _sums(g >> np.uint64(16), np.ones(len(g)))[1]
                own = np.searchsorted(heads, ctx)
                w[own, k] = d * kinds / total
                mass = np.zeros(len(keys))
                mass[np.searchsorted(keys, g)] = np.maximum(c - d, 0) / total[np.searchsorted(ctx, g >> np.uint64(16))]
                lower = below[k][np.searchsorted(known, keys & np.uint64((1 << 16 * (n - 1)) - 1))] if n > 1 else below[k][0]
                p[:, k] = mass + w[np.searchsorted(heads, keys >> np.uint64(16)), k] * lower
                rest.append(p[:, k])
            known, below = keys, rest
            for at, what, value in ((self.keys, keys, None), (self.context, heads, None)):
                at.append(what)
            self.logp.append(np.log2(np.maximum(p, 1e-30)).astype(np.float32))
            self.weight.append(np.log2(np.maximum(w, 1e-30)).astype(np.float32))
        for n in range(ORDER):  # from packed symbols to hashes in ascending order
            for names, values in ((self.keys, self.logp), (self.context, self.weight)):
                h = mix(names[n] + np.uint64(n))
                order = np.argsort(h)
                names[n], values[n] = h[order], values[n][order]
        self.limit = np.full(len(langs), np.inf)

    def scores(self, g: np.ndarray) -> np.ndarray:
        """log2 probability of the last symbol of each 4-gram in each language."""
        out = np.zeros((len(g), len(self.langs)), np.float32)
        left = np.arange(len(g))
        for n in range(ORDER, 0, -1):
            now = g[left] & np.uint64((1 << 16 * n) - 1 if n < 4 else 0xFFFFFFFFFFFFFFFF)
            h = mix(now + np.uint64(n - 1))
            at = np.minimum(np.searchsorted(self.keys[n - 1], h), len(self.keys[n - 1]) - 1)
            hit = self.keys[n - 1][at] == h
            out[left[hit]] += self.logp[n - 1][at[hit]]
            left, now = left[~hit], now[~hit]
            if not len(left):
                return out
            h = mix((now >> np.uint64(16)) + np.uint64(n - 1))
            at = np.minimum(np.searchsorted(self.context[n - 1], h), len(self.context[n - 1]) - 1)
            seen = self.context[n - 1][at] == h
            out[left[seen]] += self.weight[n - 1][at[seen]]
        out[left] += self.floor.astype(np.float32)
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(bits per character in each language, characters) of each text."""
        total, n = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        batch, owner, size = [], [], 0
        if not self.langs:
            return total, n

        def flush() -> None:
            if batch:
                widths = np.array([len(b) for b in batch])
                got = self.scores(np.concatenate(batch))
                sums = np.add.reduceat(got, np.cumsum(widths) - widths, axis=0, dtype=np.float64)
                np.add.at(total, owner, sums)
                np.add.at(n, owner, widths)
            batch.clear(), owner.clear()

        for i, text in enumerate(texts):
            for part in _parts(text or ""):
                s = symbols(part)
                if 1 < len(s) < ORDER:  # one letter: the unseen contexts fall back to the lower orders
                    s = np.concatenate([np.zeros(ORDER - 2, np.uint64), s])
                g = grams(s, ORDER)
                if len(g):
                    batch.append(g)
                    owner.append(i)
                    size += len(g)
                if size > CHARS:
                    flush()
                    size = 0
        flush()
        return -total / np.maximum(n, 1)[:, None], n


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", quantile: float = 0.999, slack: float = 0.5) -> Model:
    """A model from all labelled documents.

    It has every counted n-gram of every language, so that no language and no
    singleton is lost; the driver and each task hold it whole.  The rejection limit of a
    language is the ``quantile`` of its entropies over all labelled documents, plus ``slack`` bits.
    """
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    counted = _tables(count_grams(rows))
    langs = list(counted)
    model = Model(langs, [counted.pop(lang) for lang in langs])
    if langs:
        get = _sent(docs, model)

        def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = get()
            for b in batches:
                e, n = model.entropies(b.column(0).to_pylist())
                own = np.array([langs.index(x) if x in langs else 0 for x in b.column(1).to_pylist()], np.int64)
                use = n >= 20
                yield pa.RecordBatch.from_arrays([pa.array(own[use]), pa.array(e[np.arange(len(own)), own][use])], names=["k", "bits"])

        for r in rows.mapInArrow(bits, "k bigint, bits double").groupBy("k").agg(F.percentile_approx("bits", quantile, 10000).alias("q")).collect():
            model.limit[r["k"]] = r["q"] + slack
    return model


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20) -> DataFrame:
    """(doc, lang_pred, score, bits, rejected); texts under ``min_chars`` characters pass for lack of evidence."""

    get = _sent(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = get()
        langs = [*model.langs, UND]
        for b in batches:
            e, n = model.entropies(b.column(1).to_pylist())
            rejected = _rejects(model, e, n, min_chars)
            if not model.langs:
                e, n = np.zeros((len(n), 1)), np.zeros(len(n), np.int64)
            best = e.argmin(axis=1)
            low = e[np.arange(len(e)), best]
            chance = np.exp2(-(e - low[:, None]) * np.minimum(n, 50)[:, None]).sum(axis=1)
            none = n == 0
            names = [langs[-1 if z else k] for k, z in zip(best.tolist(), none.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(np.where(none, 0, 1 / chance)), pa.array(np.where(none, np.nan, low), mask=none), pa.array(rejected)], names=["doc", "lang_pred", "score", "bits", "rejected"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text")).mapInArrow(run, "doc bigint, lang_pred string, score double, bits double, rejected boolean")


def accepted(docs: DataFrame, model: Model, text_col: str = "text", min_chars: int = 20) -> DataFrame:
    """The rows of ``docs``, all columns, whose text the model doesn't reject."""
    at, get = docs.columns.index(text_col), _sent(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = get()
        for b in batches:
            yield b.filter(pa.array(~_rejects(model, *model.entropies(b.column(at).to_pylist()), min_chars)))

    return docs.mapInArrow(run, docs.schema)


def _sent(docs: DataFrame, model: Model) -> Callable[[], Model]:
    """The model for tasks: sent once to each executor, loaded once by each worker."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    name = f"langid {sent._jbroadcast.id()}"
    return lambda: only(name, lambda: sent.value)


def _rejects(model: Model, bits: np.ndarray, n: np.ndarray, min_chars: int) -> np.ndarray:
    if not model.langs:
        return np.ones(len(n), bool)
    best = bits.argmin(axis=1)
    return (n == 0) | ((bits[np.arange(len(n)), best] > model.limit[best]) & (n >= min_chars))


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5
