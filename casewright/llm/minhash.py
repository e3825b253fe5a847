"""Near-duplicate documents by min-max hashing.

Each permutation of a document's shingles gives two signature values, its
minimum and its maximum, so that 256 hash evaluations fill 512 slots.  Bands of
eight slots bring candidates together: at a similarity of 0.8 a band agrees
with chance 0.17 and all 64 bands miss with chance 8e-6 in large sets (3e-5 at
a union of 10 shingles and 1.5e-4 at 5, where the minimum and the maximum of a
permutation depend on each other); at 0.4, 4 % of pairs meet at all.  One bit of each slot makes a sketch of 512 bits, from whose
agreement the similarity is estimated before a pair becomes a row: pairs whose
estimate lies 5.5 deviations below the limit (0.66 for 0.8) are left out.

Equal shingle sets collapse to a class first.  Within a bucket classes are
held against one member, the bucket's centre, on full sets; links make
components; while that goes well, buckets that still hold several components
get other centres.  From its comparison with a bucket's first centre each class
has two maps of 512 bits: which shingles of the centre it lacks, by their rank,
and a hash of those that it adds.  For two classes of one bucket the maps give an
upper bound of their intersection, exact to a few shingles.  What remains apart
is paired, the classes outside of a bucket's largest component with all others,
under the conditions of sketch and bound, both inside the join, and every pair
that passes is confirmed or refuted on full sets.
Buckets of more than ``SPLIT`` classes are dealt over several tasks.

Defined cases: null or blank text has an empty set and is linked with nothing;
fewer words than the shingle size make one shingle of the whole sequence;
repeated rows of one id are one document, whose largest set counts (ties by its
fingerprint); rows with a null id come back once each, with a null component, and
are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.llm.components import extended
from casewright.llm.resident import forget
from casewright.llm.storage import materialize, release
from casewright.llm.words import as_bytes, mix, shingle_hashes, slices, texts_words

PERMUTATIONS, ROWS, SKETCH = 256, 8, 8
SPLIT, SHARES = 2000, 16
_rng = np.random.default_rng(77)
_MUL = _rng.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one text."""
    if not len(words):
        return words
    if len(words) < n:
        h = words[:1]
        for w in words[1:]:
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w)
        return mix(h + np.uint64(len(words)))
    return np.unique(shingle_hashes(words, n))


def _sets(texts: list[bytes], n: int) -> tuple[list[np.ndarray], np.ndarray]:
    words, counts = texts_words(texts)
    ends = np.cumsum(counts)
    sets = [shingle_set(words[e - c : e], n) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
    return sets, np.array([len(s) for s in sets], np.int64)


def signature(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(slots, texts) minima and maxima of non-empty sets that lie one after another."""
    sig = np.empty((2 * PERMUTATIONS, len(starts)), np.uint64)
    v, high = np.empty_like(values), np.empty_like(values)
    for p in range(PERMUTATIONS):
        np.multiply(values, _MUL[p], out=v)
        v += _ADD[p]
        np.right_shift(v, np.uint64(32), out=high)
        v ^= high
        sig[2 * p], sig[2 * p + 1] = np.minimum.reduceat(v, starts), np.maximum.reduceat(v, starts)
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(texts, bands) keys of a signature."""
    keys = np.zeros((len(sig) // ROWS, sig.shape[1]), np.uint64)
    for r in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + sig[r::ROWS])
    return (keys + np.arange(len(keys), dtype=np.uint64)[:, None]).T


def sketches(sig: np.ndarray) -> np.ndarray:
    """(SKETCH, texts) words of one bit for each slot."""
    bits = (sig & np.uint64(1)).astype(np.uint8)
    return np.ascontiguousarray(np.packbits(bits, axis=0).T).view(np.uint64).T


def least_agreement(percent: int, deviations: float = 5.5) -> int:
    """Sketch bits that sets at the limit agree in, less some standard deviations."""
    bits, p = 64 * SKETCH, (1 + percent / 100) / 2
    return math.floor(bits * p - deviations * math.sqrt(bits * p * (1 - p)))


_WORDS = [f"s{k}" for k in range(SKETCH)]
SIGNATURE = f"doc bigint, n bigint, f1 bigint, f2 bigint, {' bigint, '.join(_WORDS)} bigint, bands array<bigint>"


def signatures(docs: DataFrame, n: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Set size, 128-bit set fingerprint, sketch and band keys of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        width = 2 * PERMUTATIONS // ROWS
        for batch in batches:
            texts = as_bytes(batch.column(1))
            for i, j in slices(texts):
                sets, sizes = _sets(texts[i:j], n)
                f1, f2 = np.zeros(j - i, np.uint64), np.zeros(j - i, np.uint64)
                bands, sketch = np.zeros((j - i, width), np.uint64), np.zeros((SKETCH, j - i), np.uint64)
                full = np.flatnonzero(sizes)
                if len(full):
                    values = np.concatenate([sets[k] for k in full.tolist()])
                    starts = np.cumsum(sizes[full]) - sizes[full]
                    f1[full], f2[full] = np.add.reduceat(values, starts), np.add.reduceat(mix(values), starts)
                    sig = signature(values, starts)
                    bands[full], sketch[:, full] = band_keys(sig), sketches(sig)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, width), pa.int32()), pa.array(bands.reshape(-1).view(np.int64)))
                own = [f1, f2, *sketch]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(sizes), *(pa.array(np.ascontiguousarray(x).view(np.int64)) for x in own), lists], names=["doc", "n", "f1", "f2", *_WORDS, "bands"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text")).mapInArrow(run, SIGNATURE)


def full_sets(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(doc, f1, f2, set): every distinct shingle hash of each text, and the set's fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            texts = as_bytes(batch.column(1))
            for i, j in slices(texts):
                sets, sizes = _sets(texts[i:j], n)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
                f = [np.array([h(x).sum(dtype=np.uint64) for x in sets], np.uint64).view(np.int64) for h in (lambda x: x, mix)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *map(pa.array, f), lists], names=["doc", "f1", "f2", "set"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text")).mapInArrow(run, "doc bigint, f1 bigint, f2 bigint, set array<bigint>")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets reach the similarity."""
    one = pairs.join(sets.select(F.col("doc").alias("b"), F.col("set").alias("sb")), "b")
    two = one.join(sets.select(F.col("doc").alias("a"), F.col("set").alias("sa")), "a")
    both = F.size(F.array_intersect("sa", "sb"))
    return two.select("a", "b", both.alias("i"), (F.size("sa") + F.size("sb") - both).alias("u")).transform(_reaching, percent)


def _reaching(compared: DataFrame, percent: int) -> DataFrame:
    return compared.where(100 * F.col("i") >= percent * F.col("u")).select("a", "b")


_LACKS, _ADDS = ([f"{w}{k}" for k in range(SKETCH)] for w in "la")
SEEN = f"a bigint, b bigint, i bigint, u bigint, {' bigint, '.join([*_LACKS, *_ADDS])} bigint"


def _bits(at: np.ndarray) -> list[int]:
    out = np.zeros(64 * SKETCH, np.uint8)
    out[at] = 1
    return np.packbits(out).view(np.int64).tolist()


def _held_against(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (centre a, class b) with intersection, union and the maps of what b lacks and adds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        size = np.uint64(64 * SKETCH)
        for batch in batches:
            rows = []
            for sa, sb in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (v.values.to_numpy().view(np.uint64) for v in (sa, sb))
                lacks, adds = (~np.isin(p, q, assume_unique=True) for p, q in ((x, y), (y, x)))
                rank = np.flatnonzero(lacks)
                both = len(x) - len(rank)
                if len(x) > size:
                    rank = rank * int(size) // len(x)
                rows.append([both, len(x) + len(y) - both, *_bits(rank), *_bits((y[adds] % size).astype(np.int64))])
            columns = np.array(rows, np.int64).reshape(-1, 2 + 2 * SKETCH).T
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, np.ascontiguousarray(columns))], names=["a", "b", "i", "u", *_LACKS, *_ADDS])

    one = pairs.join(sets.select(F.col("doc").alias("b"), F.col("set").alias("sb")), "b")
    two = one.join(sets.select(F.col("doc").alias("a"), F.col("set").alias("sa")), "a")
    return two.select("a", "b", "sa", "sb").mapInArrow(run, SEEN)


def _may_reach(percent: int) -> Column:
    """False only if the maps of two classes against one centre prove them apart.

    With the centre c, x and y share at most ``|c| - |(c - x) or (c - y)|``
    shingles of c, and outside of c none whose bit the other lacks.
    """

    def count(make) -> Column:
        out = F.lit(0)
        for k in range(SKETCH):
            out = out + F.bit_count(make(k))
        return out

    inside = F.col("nc") - count(lambda k: F.col(f"xl{k}").bitwiseOR(F.col(f"yl{k}")))
    left = F.col("na") - F.col("xi") - count(lambda k: F.col(f"xa{k}").bitwiseAND(F.bitwise_not(F.col(f"ya{k}"))))
    right = F.col("nb") - F.col("yi") - count(lambda k: F.col(f"ya{k}").bitwiseAND(F.bitwise_not(F.col(f"xa{k}"))))
    most = F.least(inside, "xi", "yi") + F.least(left, right)
    return F.coalesce((100 + percent) * most >= percent * (F.col("na") + F.col("nb")), F.lit(True))


def _alike_in_size(percent: int) -> Column:
    return 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")


def _alike_in_sketch(percent: int) -> Column:
    apart = F.lit(0)
    for w in _WORDS:
        apart = apart + F.bit_count(F.col(f"x{w}").bitwiseXOR(F.col(f"y{w}")))
    return apart <= 64 * SKETCH - least_agreement(percent)


def _share() -> Column:
    """Which part of a large bucket a class is dealt to."""
    return F.pmod(F.col("doc"), F.floor(F.col("c") / SPLIT) + 1)


def _every_share() -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("c") / SPLIT)))


def _centres(now: DataFrame, turn: int) -> DataFrame:
    """(bucket, c, m): the hub of each bucket, later four members drawn by ``turn``."""
    orders = [F.struct(F.xxhash64(F.lit(4 * turn + j), "doc"), F.col("doc")) for j in range(4)] if turn else [F.struct(F.col("hub"), -F.col("doc"))]
    drawn = now.groupBy("bucket", "c").agg(F.array_distinct(F.array(*(F.max_by(F.struct("doc", "n", "component"), o) for o in orders))).alias("cs"))
    return drawn.select("bucket", "c", F.explode("cs").alias("m"))


def _centre_pairs(now: DataFrame, centres: DataFrame, percent: int) -> DataFrame:
    """Pairs (centre a, class b) of each bucket."""
    met = now.withColumn("share", _share()).join(centres.select("bucket", "m", _every_share().alias("share")), ["bucket", "share"])
    met = met.where(F.col("m.component") != F.col("component")).select(F.col("m.doc").alias("a"), F.col("m.n").alias("na"), F.col("doc").alias("b"), F.col("n").alias("nb"))
    return met.where(_alike_in_size(percent)).select("a", "b").distinct()


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _remaining_pairs(now: DataFrame, sketch: DataFrame, first: DataFrame, seen: DataFrame, percent: int) -> DataFrame:
    """Classes of one bucket and different components that may reach the similarity."""
    told = seen.select(F.col("a").alias("centre"), F.col("b").alias("doc"), "i", *_LACKS, *_ADDS)
    parts = now.groupBy("bucket", "component").agg(F.count("*").alias("k"))
    major = parts.groupBy("bucket").agg(F.max(F.struct("k", "component"))["component"].alias("major"))
    own = now.join(major, "bucket").join(sketch, "doc").join(first, "bucket").join(told, ["centre", "doc"], "left").withColumn("minor", F.col("component") != F.col("major"))

    def side(x: str, n: str, rows: DataFrame, share: Column) -> DataFrame:
        return rows.select("bucket", "nc", share.alias("share"), F.col("doc").alias(x), F.col("n").alias(n), F.col("component").alias(f"{x}c"), F.col("minor").alias(f"{x}minor"), F.col("i").alias(f"{x}i"), *(F.col(w).alias(f"{x}{w}") for w in [*_WORDS, *_LACKS, *_ADDS]))

    # members of the largest component need no comparison with each other
    left, right = side("x", "na", own.where("minor"), _share()), side("y", "nb", own, _every_share()).drop("nc")
    fits = (F.col("xc") != F.col("yc")) & (~F.col("yminor") | (F.col("x") < F.col("y"))) & _alike_in_size(percent) & _alike_in_sketch(percent) & _may_reach(percent)
    met = left.join(right, (left["bucket"] == right["bucket"]) & (left["share"] == right["share"]) & fits)
    return _ordered(met.select(F.col("x").alias("a"), F.col("y").alias("b")))


def near_duplicates(docs: DataFrame, n: int = 2, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", gain: float = 0.8) -> DataFrame:
    """(doc, n, component, keep): the component is the least id reachable.

    Further centres are drawn as long as a round leaves at most ``gain`` of the open entries.
    """
    spark = docs.sparkSession
    sig = materialize(signatures(docs, n, id_col, text_col), "signatures")
    whole = sig.where("doc is not null").groupBy("doc").agg(F.max(F.struct("n", "f1", "f2")).alias("s")).select("doc", "s.*")
    whole = materialize(whole, "documents")
    classes = materialize(whole.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("doc").alias("rep"), F.count("*").alias("copies")), "classes")
    alone = classes.select(F.col("rep").alias("doc"), "n", "f1", "f2")
    reps = materialize(sig.join(alone, ["doc", "n", "f1", "f2"], "left_semi").dropDuplicates(["doc"]), "representatives")
    nameless = sig.where("doc is null").select("doc", "n", F.lit(None).cast("bigint").alias("component"), F.lit(True).alias("keep"))
    # only buckets with company matter
    entries = reps.select("doc", "n", F.explode("bands").alias("bucket")).distinct()
    shared = entries.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1")
    in_bucket = materialize(entries.join(shared, "bucket"), "buckets")
    # a class in many and large buckets is near the middle of its group
    hubs = in_bucket.groupBy("doc").agg(F.sum("c").alias("hub"))
    in_bucket = materialize(in_bucket.join(hubs, "doc"), "hubs")
    wanted = alone.join(hubs.select("doc"), "doc", "left_semi").select(F.col("doc").alias("__w"), F.col("f1").alias("__f1"), F.col("f2").alias("__f2"))
    texts = docs.select(F.col(id_col).cast("bigint").alias("__d"), F.col(text_col).alias("__t")).join(wanted, F.col("__d") == F.col("__w"), "left_semi")
    found = full_sets(texts, n, "__d", "__t")
    sets = materialize(found.join(wanted, (found["doc"] == wanted["__w"]) & (found["f1"] == wanted["__f1"]) & (found["f2"] == wanted["__f2"]), "left_semi").dropDuplicates(["doc"]), "sets")

    now, left = in_bucket.withColumn("component", F.col("doc")), in_bucket.count()
    labels, tried, first, seen, turn = None, None, None, None, 0
    while left:
        before, last = left, turn < 0
        if last:
            pairs = _remaining_pairs(now, reps.select("doc", *_WORDS), first, seen, percent)
        else:
            centres = materialize(_centres(now, turn), "centres")
            pairs = _centre_pairs(now, centres, percent)
        if turn == 0:
            first = centres.select("bucket", F.col("m.doc").alias("centre"), F.col("m.n").alias("nc"))
            seen = materialize(_held_against(pairs, sets), "seen")
            links, tried = _reaching(seen, percent), _ordered(seen)
        else:
            pairs = materialize(_ordered(pairs).join(tried, ["a", "b"], "left_anti"), "pairs")
            links, tried = materialize(_linked(pairs, sets, percent), "links"), tried.unionByName(pairs)
        labels = extended(labels, links)
        if last:
            break
        labelled = in_bucket.join(labels.select(F.col("id").alias("doc"), "component"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
        # a bucket of two was settled by its one pair
        spread = labelled.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("bucket")
        now = materialize(labelled.where("c > 2").join(spread, "bucket", "left_semi"), "open")
        left = now.count()
        turn = turn + 1 if turn == 0 or left <= gain * before else -1
    labels = labels if labels is not None else spark.createDataFrame([], "id bigint, component bigint")
    # copies take the label of their class; a class may hold a third of all rows and so meets them in several shares
    shared = classes.where("copies > 1").join(labels, F.col("rep") == F.col("id"), "left").select("n", "f1", "f2", F.coalesce("component", "rep").alias("of_class"), F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share"))
    own = whole.withColumn("share", F.pmod(F.xxhash64("doc"), F.lit(SHARES)).cast("int")).join(shared, ["n", "f1", "f2", "share"], "left")
    out = own.join(labels.select(F.col("id").alias("doc"), "component"), "doc", "left").select("doc", "n", F.coalesce("of_class", "component", "doc").alias("component"))
    out = materialize(out.withColumn("keep", F.col("doc") == F.col("component")).unionByName(nameless), "near")
    for done in (sig, reps, sets):
        release(spark, done)
    return out
