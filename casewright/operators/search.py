"""Vector, lexical and trigram search, and the fusion of their hits."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from casewright.functions.text import bound, case_scope, scopes_match, terms, trigrams
from casewright.shared import shares, small, written

# Boosts of wiki sources and graph paths by question profile.
BOOSTS = {"doctrine": (0.18, 0.12), "officer_lesson": (0.22, 0.12), "precedent_trace": (0.12, 0.20), "pattern_analysis": (0.12, 0.16), "comparison": (0.10, 0.14)}
OTHER_BOOST = (0.08, 0.08)
#: Similarities of one matrix product.
CELLS = 4_000_000
#: Bits that stand for the trigrams of a name.
BITS = 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """0 for a vector of zeros."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def unit(v: Column) -> Column:
    """The vector at length 1; a vector of zeros stays as it is."""
    return bound(F.sqrt(dot(v, v)), lambda norm: F.transform(v, lambda x: F.when(norm == 0, 0.0).otherwise(x.cast("double") / norm)))


def _best_of_part(queries: list[tuple], kind: pa.DataType, k: int, least: float | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The k best rows of each query among those that a task has read so far (and those that nearly tie with the last).

    One product of single precision leaves out what can't be among them, by a
    bound of its error; the others are compared in doubles.  Of equal rows of
    a batch, those with the k smallest ids stay.
    """
    names, asked = pa.array([q for q, _ in queries], kind), np.array([v for _, v in queries], np.float64).reshape(len(queries), -1)
    size = asked.shape[1]
    short, error = asked.astype(np.float32), (size + 8) * 2.0**-22

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.full((len(asked), k), -np.inf)  # the best similarities so far, in no order
        for b in batches:
            own = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, size)
            norm = np.sqrt(np.einsum("ij,ij->i", own, own))
            ids = b.column(0).filter(pa.array(np.isfinite(norm)))
            own, norm = own[np.isfinite(norm)], norm[np.isfinite(norm)]
            if not len(own):
                continue
            own /= np.where(norm == 0, 1, norm)[:, None]
            place = np.empty(len(own), np.int64)
            place[pc.sort_indices(ids).to_numpy()] = np.arange(len(own))
            columns = np.ascontiguousarray(own.astype(np.float32).T)
            step = max(1, CELLS // len(own))
            for at in range(0, len(asked), step):
                like, held = short[at : at + step] @ columns, top[at : at + step]
                floor = held.min(axis=1)
                if k < len(own) and np.isneginf(floor).any():
                    floor = np.maximum(floor, np.partition(like, -k, axis=1)[:, -k] - error)
                if least is not None:
                    floor = np.maximum(floor, least)
                q, row = np.nonzero(like >= (floor - error)[:, None].astype(np.float32))
                value = np.einsum("ij,ij->i", asked[at + q], own[row])
                order = np.lexsort((place[row], -value, q))
                q, row, value = q[order], row[order], value[order]
                first = np.searchsorted(q, np.arange(len(held)))
                rank = np.arange(len(q)) - first[q]
                best = np.full(held.shape, -np.inf)
                best[q[rank < k], rank[rank < k]] = value[rank < k]
                held[:] = np.partition(np.hstack([held, best]), k, axis=1)[:, k:]
                begins = np.flatnonzero(np.r_[True, (q[1:] != q[:-1]) | (value[1:] != value[:-1])][: len(q)])
                equal = np.arange(len(q)) - np.repeat(begins, np.diff(np.r_[begins, len(q)]))
                keep = (value >= held.min(axis=1)[q] - 1e-12) & (equal < k)
                if least is not None:
                    keep &= value >= least - 1e-12
                yield pa.RecordBatch.from_arrays([names.take(pa.array(at + q[keep])), ids.take(pa.array(row[keep])), pa.array(value[keep])], names=["q", "id", "similarity"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int, block: int = 5_000, least: float | None = None) -> DataFrame:
    """(q, id, similarity): the k nearest of each query, exact, or those of them that reach ``least``.

    ``queries`` (q, v) is a stated set; it goes out in blocks of about
    ``block`` rows, and a task leaves little more than the k best rows a query
    that it meets.  Every pair is compared, which grows with the product of
    both; null vectors, those with a part that is no number and those of
    another length than the queries' are left out.
    """
    asked = written(queries.select("q", unit(F.col("v")).alias("w")).where("w is not null and not exists(w, x -> x is null or isnan(x))"), "asked")
    size = asked.agg(F.max(F.size("w")).alias("n"), F.count("*").alias("c")).first()
    own = vectors.where(F.size("vec") == F.lit(size["n"] or 0)).select("id", "vec")
    schema = f"q {queries.schema['q'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, similarity double"
    blocks, out = max(1, -(-size["c"] // block)), None
    for n in range(blocks):
        rows = [(r["q"], r["w"]) for r in asked.where((F.size("w") == F.lit(size["n"] or 0)) & (F.pmod(F.xxhash64("q"), F.lit(blocks)) == n)).collect()]
        part = own.mapInArrow(_best_of_part(rows, to_arrow_type(queries.schema["q"].dataType), k, least), schema) if rows else own.select(F.lit(None).cast(queries.schema["q"].dataType).alias("q"), "id", F.lit(0.0).alias("similarity")).where("false")
        out = part if out is None else out.unionByName(part)
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc(F.round("similarity", 12)), "id"))
    return out.withColumn("k", best).where(F.col("k") <= k).drop("k")


def postings(docs: DataFrame, text: Column, wanted: DataFrame | None = None) -> DataFrame:
    """(term, id, tf, len) of the words of more than one character, or only of the ``wanted`` (term) ones.

    The words are split and counted below the explode, which else would carry
    all words of a text beside each, and terms that nobody asks for leave
    before the shuffle.
    """
    split = docs.select("id", F.filter(F.split(F.lower(text), "[^0-9a-z]+"), lambda w: F.length(w) > 1).alias("words")).select("id", F.size("words").alias("len"), "words")
    words = split.select("id", "len", F.explode_outer("words").alias("term")).where("term is not null")
    if wanted is not None:
        words = words.join(small(wanted.select("term").distinct()), "term", "left_semi")
    return words.groupBy("term", "id").agg(F.count("*").alias("tf"), F.first("len").alias("len"))


def lexical(docs: DataFrame, text: Column, queries: DataFrame, k: int) -> DataFrame:
    """(q, id, rank): documents that hold any term, by the sum of 1 + ln(tf), over length; ties by id."""
    wanted = written(queries.select("q", F.explode(terms(F.col("text"))).alias("term")), "wanted")
    hits = postings(docs, text, wanted).join(small(wanted), "term").groupBy("q", "id").agg((F.sum(1 + F.log("tf")) / (1 + F.log(F.first("len").cast("double")))).alias("rank"))
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc(F.round("rank", 9)), "id"))
    return hits.withColumn("k", best).where(F.col("k") <= k).drop("k")


def _sum(parts: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def trigram_join(left: DataFrame, right: DataFrame, least: float, cells: int = 1000, grams: Callable[[Column], Column] = trigrams, inclusive: bool = False, shortest: float = 0.0) -> DataFrame:
    """(a, b, similarity): names whose trigram sets pass ``least``, or reach it if ``inclusive``.

    Names whose lengths differ by more than the factor ``shortest`` are left out.

    Of n and m trigrams, such a pair shares o = least / (1 + least) x (n + m) at
    least.  In one order of all trigrams, it shares one among all but the last
    o - 1 of each set (prefix filtering), with o for the smallest set there is
    on the other side.  The order is by the pairs that a trigram would bring
    together: those that only one side has come first, and bring none; those
    that many names share come last, and hold no candidates together.  What a
    trigram does hold together is dealt over shares of ``cells`` names.  Most of what meets falls in the join
    itself: what is left behind the shared trigram of either set is less than
    o, or the bits that stand for their trigrams agree in too few (of n
    trigrams on k bits, n - k more than the bits may agree).  Sets are never
    broadcast: files that compress well would pass for small tables.
    """
    tasks = shares(left.sparkSession, 0)
    # one small file may hold all names, and one task would make all sets
    lt = written(left.select("id", "name").repartition(tasks, "id").select(F.col("id").alias("a"), grams(F.col("name")).alias("ta"), F.length("name").alias("la")), "left")
    rt = written(right.select("id", "name").repartition(tasks, "id").select(F.col("id").alias("b"), grams(F.col("name")).alias("tb"), F.length("name").alias("lb")), "right")
    each = lt.select(F.explode("ta").alias("g"), F.lit(1).alias("l")).union(rt.select(F.explode("tb").alias("g"), F.lit(0).alias("l")))
    counts = each.groupBy("g").agg(F.sum("l").alias("l"), F.count("*").alias("df")).where("l > 0 and df > l")
    seen = small(written(counts.select("g", "df", (F.col("l").cast("double") * (F.col("df") - F.col("l"))).alias("weight")), "seen"))
    needed = lambda n, m: F.ceil((n + m) * (least / (1 + least)) - 1e-9)
    words = range(BITS // 64)

    def prefix(sets: DataFrame, key: str, value: str, length: str, others: DataFrame, other: str) -> DataFrame:
        smallest = others.agg(F.min(F.when(F.size(other) > 0, F.size(other))).alias("smallest"))  # one row
        one = sets.select(key, length, F.size(value).alias("n"), F.explode(value).alias("g")).hint("merge").join(seen, "g").withColumn("bit", F.pmod(F.xxhash64("g"), F.lit(BITS)))
        own = Window.partitionBy(key)
        bits = {f"w{k}": F.bit_or(F.when(F.floor(F.col("bit") / 64) == k, F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("bit", F.lit(64)).cast("int"))).otherwise(F.lit(0).cast("bigint"))).over(own) for k in words}
        placed = one.withColumns({"place": F.row_number().over(own.orderBy("weight", "g")), "both": F.count("*").over(own)} | bits).withColumn("behind", F.col("both") - F.col("place"))
        placed = placed.withColumn("lost", F.col("both") - _sum(F.bit_count(f"w{k}") for k in words)).crossJoin(F.broadcast(smallest))
        return placed.where(F.col("behind") + 1 >= needed(F.col("n"), F.greatest(F.col("smallest"), F.ceil(F.col("n") * least - 1e-9))))

    parts = F.floor(F.col("df") / cells)
    pa = prefix(lt, "a", "ta", "la", rt, "tb").select("a", "la", "g", *(F.col(c).alias(f"{c}a") for c in ("n", "behind", "lost")), *(F.col(f"w{k}").alias(f"wa{k}") for k in words), F.pmod(F.xxhash64("a"), parts + 1).alias("share"))
    pb = prefix(rt, "b", "tb", "lb", lt, "ta").select("b", "lb", "g", *(F.col(c).alias(f"{c}b") for c in ("n", "behind", "lost")), *(F.col(f"w{k}").alias(f"wb{k}") for k in words), F.explode(F.sequence(F.lit(0).cast("bigint"), parts)).alias("share"))
    agree = _sum(F.bit_count(F.col(f"wa{k}").bitwiseAND(F.col(f"wb{k}"))) for k in words) + F.least("losta", "lostb")
    near = (F.least("behinda", "behindb") + 1 >= needed(F.col("na"), F.col("nb"))) & (agree >= needed(F.col("na"), F.col("nb"))) & (F.least("la", "lb") >= F.greatest("la", "lb") * shortest)
    pairs = pa.hint("merge").join(pb.hint("merge"), ["g", "share"]).where(near).select("a", "b").distinct()
    both = pairs.join(lt.hint("merge"), "a").join(rt.hint("merge"), "b").withColumn("i", F.size(F.array_intersect("ta", "tb")))
    return both.select("a", "b", (F.col("i") / (F.size("ta") + F.size("tb") - F.col("i"))).alias("similarity")).where(F.col("similarity") >= least if inclusive else F.col("similarity") > least)


def fuse(vector: DataFrame, lexical_hits: DataFrame, graph: DataFrame, n: int, weights: tuple[float, float, float] = (0.4, 0.2, 0.2), paths: DataFrame | None = None, wiki: DataFrame | None = None, profile: str | None = None) -> DataFrame:
    """Weighted sum of similarity, rank over the greatest rank, and boosts for hits that are there already.

    vector (id, similarity), lexical (id, rank), graph, paths and wiki (id).
    """
    top = lexical_hits.agg(F.greatest(F.max("rank"), F.lit(0.001)).alias("top"))
    lex = lexical_hits.crossJoin(F.broadcast(top)).select("id", (F.col("rank") / F.col("top") * weights[1]).alias("l"))
    out = vector.select("id", (F.col("similarity") * weights[0]).alias("v")).join(lex, "id", "full")
    wiki_boost, path_boost = BOOSTS.get(profile or "", OTHER_BOOST)
    parts, names = [F.coalesce("v", F.lit(0.0)), F.coalesce("l", F.lit(0.0))], [F.when(F.col("v").isNotNull(), "vector"), F.when(F.col("l").isNotNull(), "lexical")]
    for name, frame, boost in (("graph", graph, weights[2]), ("graph_path", paths, path_boost), ("wiki", wiki, wiki_boost)):
        if frame is not None:
            out = out.join(frame.select("id").distinct().withColumn(name, F.lit(True)), "id", "left")
            parts.append(F.when(F.col(name), boost).otherwise(0.0))
            names.append(F.when(F.col(name), name))
    score = parts[0]
    for p in parts[1:]:
        score = score + p
    return out.select("id", F.round(score, 9).alias("score"), F.array_compact(F.array(*names)).alias("sources")).orderBy(F.desc("score"), "id").limit(n)


def balance(hits: DataFrame, scopes: int, n: int) -> DataFrame:
    """At least n / scopes hits of each scope first, then the best of the rest. hits: (id, scope, score)."""
    quota = max(1, n // max(1, scopes))
    place = F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("score"), "id"))
    ranked = hits.withColumn("extra", place > quota)
    return ranked.orderBy("extra", F.desc("score"), "id").limit(n).drop("extra")


def cached(entries: DataFrame, question: Column, preset: str, as_of: Column, least: float = 0.8) -> DataFrame:
    """The most similar live entry of a preset, if similar enough. entries: (id, vec, preset, expires)."""
    near = entries.where((F.col("preset") == preset) & (F.col("expires") > as_of)).select("id", cosine(F.col("vec"), question).alias("similarity"))
    return near.where(F.col("similarity") >= least).orderBy(F.desc("similarity"), "id").limit(1)


def cached_answers(entries: DataFrame, questions: DataFrame, preset: str, as_of: Column, least: float = 0.8) -> DataFrame:
    """(q, id, similarity): for each question (q, v) the most similar live entry of a preset other than itself, if similar enough.

    entries: (id, vec, preset, expires); a stated set of questions.
    """
    live = entries.where((F.col("preset") == preset) & (F.col("expires") > as_of)).select("id", "vec")
    near = nearest(live, questions, 2, least=least).where(F.col("q") != F.col("id"))
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc(F.round("similarity", 12)), "id"))
    return near.withColumn("k", place).where("k = 1").drop("k")


def scoped(hits: DataFrame, scope: str) -> DataFrame:
    """(doc, chunk, status): hits that name the case, and hits of their documents that name none.

    hits: (doc, chunk, signal).  Hits that name another case go; without any match all that name none stay.
    """
    signal = F.when(F.col("signal").isNotNull(), case_scope(F.col("signal")))
    own = hits.withColumn("__hit", scopes_match(signal, F.lit(scope)))
    match = own.where("__hit").select("doc", "chunk", F.lit("MATCH").alias("status"))
    docs = match.select("doc").distinct()
    silent = own.where("signal is null").select("doc", "chunk", F.lit("UNKNOWN").alias("status"))
    some = match.agg(F.count("*").alias("__n"))  # one row
    kept = silent.crossJoin(F.broadcast(some)).join(docs.withColumn("__own", F.lit(True)), "doc", "left")
    return match.unionByName(kept.where((F.col("__n") == 0) | F.col("__own").isNotNull()).select("doc", "chunk", "status"))


def canonical(asked: Column, single: list[str]) -> Column:
    """A map of lists as JSON with sorted keys and values; empty ones drop out, ``single`` keys hold one value."""
    clean = F.transform_values(asked, lambda k, v: F.array_sort(F.filter(F.transform(v, lambda x: F.btrim(x)), lambda x: x != "")))
    full = F.array_sort(F.map_entries(F.map_filter(clean, lambda k, v: F.size(v) > 0)))
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    value = lambda e: F.when(e["key"].isin(single), quoted(e["value"][0])).otherwise(F.concat(F.lit("["), F.array_join(F.transform(e["value"], quoted), ","), F.lit("]")))
    return F.concat(F.lit("{"), F.array_join(F.transform(full, lambda e: F.concat(quoted(e["key"]), F.lit(":"), value(e))), ","), F.lit("}"))
