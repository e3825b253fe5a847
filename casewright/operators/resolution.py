"""Names of new graph nodes brought together with known names, in their order.

A name takes the known name that is equal but for case, else the most similar
one that is similar enough, else it becomes a known name itself.  So each name
depends on those before it.  Only names that are similar enough can meet, and
no name depends on one outside of its component of that similarity graph:
components are replayed side by side, each in its order.

Equal names are one entry of a replay, however often they occur: which names
become known is settled by first occurrences, and a name that did not may later
find a better one, which a short list of (from, name) says for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.functions.text import jaccard, whole_trigrams
from casewright.operators.components import components
from casewright.operators.search import trigram_join
from casewright.shared import shares, written

BOOST = 0.85
#: Longer names meet by their trigrams, since each of their spans would carry the whole name.
LONGEST = 300
#: Lengths of names that are joined as one.
WIDE = 8
#: Rows of a batch, about.
ROWS = 50_000


def bare(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), r"^\s+|\s+$", ""))


def similarity(name: str, known: str) -> float:
    """By matching blocks; at least BOOST where one holds the other."""
    r = SequenceMatcher(None, name, known).ratio()
    return max(r, BOOST) if name in known or known in name else r


def _similar(least: float):
    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x: str, y: str) -> float:
            m = SequenceMatcher(None, x, y)
            inside = least <= BOOST and (x in y or y in x)
            return similarity(x, y) if inside or (m.real_quick_ratio() >= least and m.quick_ratio() >= least) else 0.0

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return score


def spans(n: int, least: float) -> list[tuple[int, int]]:
    """A name of ``n`` characters in one span more than a name no longer than it can differ in, if they agree by ``least``."""
    k = int(2 * (1 - least) * n + 1e-6) + 1
    return [(n * i // k, n * (i + 1) // k) for i in range(k)]


def differ(n: int, m: int, least: float) -> int:
    """Characters of names of ``n`` and ``m`` outside of matching blocks, at most, if they agree by ``least``."""
    return int((n + m) * (1 - least) + 1e-6)


def _bits(name: str) -> list[int]:
    """256 bits, 8 for as many characters of each of 32 classes; to take or add a character changes one at most."""
    seen, found = [0] * 32, 0
    for c in map(ord, name):
        k = c % 32
        if seen[k] < 8:
            found |= 1 << (k * 8 + seen[k])
            seen[k] += 1
    return [(found >> 64 * k) % 2**64 - 2**63 for k in range(4)]


def _signed(least: float, cut: bool):
    """Spans of names at the places where shorter names may hold them; or all that longer names may look for in these.

    Lengths of shorter names that a span may meet go with it, ``WIDE`` of them in one.
    """
    known: dict[int, np.ndarray] = {}

    def of_longer(n: int) -> list[tuple[int, ...]]:
        rows, m_least = [], next(m for m in range(n + 1) if int(m * (2 - least) / least + 1e-6) >= n)
        for i, (lo, hi) in enumerate(spans(n, least)):
            for s in range(-i, i + 1, 2):
                shorter = [m for m in range(max(m_least, hi + s), n + 1) if lo + s >= 0 and abs(s - (m - n)) <= differ(n, m, least) - i]
                rows += [(lo, hi, lo + s, wide, i, s) for wide in sorted({m // WIDE for m in shorter}) if hi > lo]
        return rows

    def of_shorter(m: int) -> list[tuple[int, ...]]:
        asked = set()
        for n in range(m, int(m * (2 - least) / least + 1e-6) + 1):
            for i, (lo, hi) in enumerate(spans(n, least)):
                asked |= {(lo + s, hi + s) for s in range(-i, i + 1, 2) if hi > lo and lo + s >= 0 and hi + s <= m and abs(s - (m - n)) <= differ(n, m, least) - i}
        return [(lo, hi, lo, m // WIDE, 0, 0) for lo, hi in sorted(asked)]

    def rows(n: int) -> np.ndarray:
        if n not in known:
            known[n] = np.array((of_longer if cut else of_shorter)(n), np.int32).reshape(-1, 6)
        return known[n]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_pylist()
            number = np.array([len(rows(len(key))) for key in keys], np.int64)
            for part in np.split(np.arange(len(keys)), np.flatnonzero(np.diff(np.cumsum(number) // ROWS)) + 1):
                own = np.repeat(part, number[part])
                if not len(own):
                    continue
                made = np.concatenate([rows(len(keys[k])) for k in part])
                gram = [keys[k][lo:hi] for k in part for lo, hi in rows(len(keys[k]))[:, :2].tolist()]
                size, bits = np.array([len(keys[k]) for k in part], np.int32), np.array([_bits(keys[k]) for k in part], np.int64)
                at, wide, i, s = np.ascontiguousarray(made[:, 2:].T)
                columns = [pa.array(gram, pa.string()), pa.array(at), pa.array(wide), b.column(0).take(pa.array(own)), *(pa.array(c[own - part[0]]) for c in (size, *bits.T))]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(i), pa.array(s)] if cut else []), names=["gram", "at", "wide", *(["x", "n", "x0", "x1", "x2", "x3", "i", "s"] if cut else ["y", "m", "y0", "y1", "y2", "y3"])])

    return run


def alike(names: DataFrame, least: float) -> DataFrame:
    """(x, y): all pairs of ``names`` (key) that may agree by ``least`` in order, the longer one first, and some that do not.

    Of T characters of both names at most D = (1 - least) T lie outside of
    matching blocks.  The longer name is cut into more than D spans.  For the
    first i such that spans 0 to i have no more than i of these characters, span
    i has none, and if i > 0 those before it have exactly i: so the other name
    holds span i, moved by some s of the parity of i between -i and i, and what
    follows differs by at most D - i.  Spans at places are joined for lengths that
    may agree, and most of what meets falls in the join itself, by the bits that
    count characters, the rest by its edit distance.
    """
    dealt = names.select("key").repartition(shares(names.sparkSession, 0), "key")
    longer = dealt.mapInArrow(_signed(least, True), "gram string, at int, wide int, x string, n int, x0 bigint, x1 bigint, x2 bigint, x3 bigint, i int, s int")
    shorter = dealt.mapInArrow(_signed(least, False), "gram string, at int, wide int, y string, m int, y0 bigint, y1 bigint, y2 bigint, y3 bigint")
    d = F.floor((F.col("n") + F.col("m")) * (1 - least) + 1e-6).cast("int")
    order = (F.col("n") > F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("x") < F.col("y")))
    unlike = reduce(lambda u, v: u + v, (F.bit_count(F.col(f"x{k}").bitwiseXOR(F.col(f"y{k}"))) for k in range(4)))
    met = longer.hint("merge").join(shorter.hint("merge"), ["gram", "at", "wide"]).where((F.abs(F.col("s") - (F.col("m") - F.col("n"))) <= d - F.col("i")) & (unlike <= d) & order)
    return met.withColumn("d", d).where(F.expr("levenshtein(x, y, d) >= 0")).select("x", "y").distinct()


def candidates(asked: DataFrame, named: DataFrame, least: float, cutoff: float) -> DataFrame:
    """(a, b): names of ``asked`` and ``named`` (id, name) that share ``cutoff`` of their trigrams and may be similar enough."""
    # of two names of lengths m < n at most 2m / (m + n) agrees
    shortest = least / (2 - least)
    if least <= BOOST:  # a name may lie inside of any longer one
        return trigram_join(asked, named, cutoff, grams=whole_trigrams, inclusive=True).where("a <> b").select("a", "b")
    # few bytes and much work again; shares of trigrams are columns of what is written, since a filter would move into the join of spans
    agreed = jaccard(whole_trigrams(F.col("x")), whole_trigrams(F.col("y")))
    met = alike(named.where(F.length("name") <= LONGEST).select(F.col("name").alias("key")), least)
    short = written(met.repartition(shares(named.sparkSession, 0), "x", "y").withColumn("agreed", agreed), "alike").where(F.col("agreed") >= cutoff)
    both = short.select(F.col("x").alias("a"), F.col("y").alias("b")).union(short.select(F.col("y").alias("a"), F.col("x").alias("b")))
    own = both.hint("merge").join(asked.select(F.col("id").alias("a")).hint("merge"), "a", "left_semi")
    long = F.length("name") >= LONGEST * shortest
    pairs = trigram_join(asked.where(long), named.where(long), cutoff, grams=whole_trigrams, inclusive=True, shortest=shortest).where("a <> b")
    return own.unionByName(pairs.where(F.greatest(F.length("a"), F.length("b")) > LONGEST).select("a", "b"))


def replayed(rows: list[tuple[str, str, int, bool, list[tuple[str, float]]]]) -> Iterator[tuple[str, list[tuple[int, str]]]]:
    """(key, [(from, name)]) of the names of one component; rows: key, name, at, known, [(other key, similarity)].

    Known names come first, by name; equal similarities go to the earlier.
    """
    order = sorted(rows, key=lambda r: (not r[3], r[2], r[1]))
    place: dict[str, tuple[int, int, str]] = {}
    for k, (key, name, at, known, near) in enumerate(order):
        if known or not any(other in place for other, _ in near):
            place[key] = (k, -1 if known else at, name)
    for key, name, at, known, near in order:
        if key in place:
            yield key, [(at, name)]
            continue
        steps, best = [], 0.0
        for _, since, found, r in sorted((*place[other], r) for other, r in near if other in place):
            if r > best:
                best = r
                steps.append((since, found))
        yield key, steps


def consolidated(new: DataFrame, known: DataFrame, least: float = 0.90, cutoff: float = 0.3) -> DataFrame:
    """``new`` (at, name, ...) with ``resolved``; known: (name).

    ``at`` is the order of the batch and is unique.  Names that share less than
    ``cutoff`` of their trigrams never meet.  A null name is the empty name.
    """
    rows = written(new.withColumn("__key", bare(F.col("name"))), "names")
    there = known.groupBy(bare(F.col("name")).alias("key")).agg(F.max("name").alias("name"))
    first = rows.groupBy(F.col("__key").alias("key")).agg(F.min_by("name", "at").alias("name"), F.min("at").alias("at")).join(there.select("key"), "key", "left_anti")
    entries = written(there.select("key", "name", F.lit(-1).cast("bigint").alias("at"), F.lit(True).alias("known")).unionByName(first.select("key", "name", F.col("at").cast("bigint"), F.lit(False).alias("known"))), "entries")
    named = entries.select(F.col("key").alias("id"), F.col("key").alias("name"))
    asked = entries.where("not known").select(F.col("key").alias("id"), F.col("key").alias("name"))
    pairs = candidates(asked, named, least, cutoff)
    tasks = shares(new.sparkSession, 0)
    # pairs and components are few bytes and much work, so that tasks are not to be merged by the size of what they read
    near = written(pairs.repartition(tasks, "a", "b").withColumn("r", _similar(least)("a", "b")).where(F.col("r") >= least), "near")
    grouped = near.groupBy(F.col("a").alias("key")).agg(F.collect_list(F.struct("b", "r")).alias("near"))
    parts = shares(new.sparkSession, near.count(), 20_000)
    members = components(near).withColumnRenamed("node", "key").join(entries, "key").join(grouped, "key", "left").withColumn("part", F.pmod(F.xxhash64("component"), F.lit(parts)))

    def replay(batch: pd.DataFrame) -> pd.DataFrame:
        groups: dict[str, list[tuple]] = {}
        for r in batch.rename(columns={"name": "name_"}).itertuples():
            groups.setdefault(r.component, []).append((r.key, r.name_, r.at, r.known, [(n["b"], n["r"]) for n in (r.near if r.near is not None else [])]))
        return pd.DataFrame([(key, [{"since": s, "name": n} for s, n in steps]) for group in groups.values() for key, steps in replayed(group)], columns=["key", "steps"])

    steps = written(members.repartition(parts, "part").groupBy("part").applyInPandas(replay, "key string, steps array<struct<since:bigint,name:string>>"), "steps")
    own = entries.select("key", F.col("name").alias("__own")).join(steps, "key", "left").withColumnRenamed("key", "__key")
    earlier = F.filter("steps", lambda s: s["since"] < F.col("at"))
    resolved = F.when(F.size("steps") > 0, F.coalesce(F.try_element_at(earlier, F.lit(-1))["name"], F.col("steps")[0]["name"])).otherwise(F.col("__own"))
    return rows.join(own, "__key", "left").withColumn("resolved", resolved).drop("__key", "__own", "steps")
