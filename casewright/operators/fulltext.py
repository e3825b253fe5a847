"""English full-text search: stems, stop words, positions, phrases and ranks.

An index is a table of postings (term, id, places, len), written in folders by
a hash of the term, so that a query reads the folders of its terms alone.
``places`` are (pos, weight) in order: positions count stop words, and weights
are those of the field that a word stands in.

Queries in web style are clauses joined by OR, each of them words and quoted
phrases that must all occur, or must not after a minus.  They are the user's
own text, read on the driver; their evaluation is joins and windows over the
postings, in which common words meet no common words of other documents.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions.stems import CHANGED, STOP_WORDS, stem, stemmed
from casewright.shared import small, written

#: Default weights of the fields A to D.
A, B, C, D = 1.0, 0.4, 0.2, 0.1
BUCKETS = 64
#: The sum of 1 / k squared, to which the weights of a term's places are scaled.
LIMIT = 1.64493406685


def words(c: Column) -> Column:
    """Lower-case words in order: runs of letters and digits of any script."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def postings(docs: DataFrame, fields: list[tuple[Column, float]], only: DataFrame | None = None) -> DataFrame:
    """(term, id, places, len) over the fields of ``docs`` (id, ...), one after the other; of all terms, or ``only`` (term) those.

    With ``only`` the different words that may lead to its terms are stemmed
    first, and all others leave before the shuffle of places.
    """
    if only is None:
        each = _each_word(docs, fields)
        # words first, so that Python sees each of a document's words once
        by_word = each.groupBy("word", "id").agg(F.collect_list("place").alias("places"), F.first("len").alias("len"))
        by_term = by_word.withColumn("term", stemmed(F.col("word"))).groupBy("term", "id")
        return by_term.agg(F.array_sort(F.flatten(F.collect_list("places"))).alias("places"), F.first("len").alias("len"))
    terms = written(only.select("term").distinct(), "only")
    said = docs.select(F.explode_outer(F.array_distinct(F.concat(*(words(c) for c, _ in fields)))).alias("word"))
    # a stem but for its last CHANGED letters opens its word, and its first letter always does
    opening = F.substr("term", F.lit(1), F.greatest(F.lit(1), F.length("term") - CHANGED))
    openings = terms.select(opening.alias("opening"), F.left("term", F.lit(1)).alias("first")).distinct()
    may = said.withColumn("first", F.left("word", F.lit(1))).join(small(openings), "first").where(F.startswith("word", "opening"))
    # written, else the filter that Spark infers for the join stems every word of every text
    vocabulary = written(may.select("word").distinct().where(~F.col("word").isin(STOP_WORDS)), "vocabulary")
    asked = written(vocabulary.withColumn("term", stemmed(F.col("word"))).join(small(terms), "term", "left_semi"), "asked")
    each = _each_word(docs, fields).join(small(asked), "word").select("term", "id", "place", "len")
    return each.groupBy("term", "id").agg(F.array_sort(F.collect_list("place")).alias("places"), F.first("len").alias("len"))


def _each_word(docs: DataFrame, fields: list[tuple[Column, float]]) -> DataFrame:
    """(id, len, word, place): all words but stop words, and len of a text with these.

    Words are counted below the explode, which else would carry all words of a
    text beside each; the outer one infers no filter that splits a text again.
    """
    weighed = lambda c, x: F.transform(words(c), lambda w: F.struct(w.alias("word"), F.lit(x).alias("weight")))
    all_words = docs.select("id", F.concat(*(weighed(c, x) for c, x in fields)).alias("words")).select("id", F.size("words").alias("len"), "words")
    each = all_words.select("id", "len", F.posexplode_outer("words").alias("pos", "w")).where(~F.col("w.word").isin(STOP_WORDS))
    place = F.struct((F.col("pos") + 1).alias("pos"), F.col("w.weight").alias("weight"))
    return each.select("id", "len", F.col("w.word").alias("word"), place.alias("place"))


def index(docs: DataFrame, fields: list[tuple[Column, float]], buckets: int = BUCKETS, only: DataFrame | None = None) -> DataFrame:
    """The postings as a written table, in folders by term; of ``only`` (term) those terms that a run asks for."""
    return written(postings(docs, fields, only).withColumn("bucket", F.pmod(F.crc32("term"), F.lit(buckets)).cast("int")), "postings", by=["bucket"])


def lookup(table: DataFrame, terms: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Postings of these terms; only their folders are read."""
    folders = sorted({zlib.crc32(t.encode()) % buckets for t in terms})
    return table.where(F.col("bucket").isin(folders) & F.col("term").isin(sorted(set(terms)))).drop("bucket")


@dataclass(frozen=True)
class Item:
    """A word or a phrase: stems and their distances from the first."""

    terms: tuple[tuple[str, int], ...]
    wanted: bool = True


def parse(query: str) -> list[list[Item]]:
    """Clauses, of which one has to hold; stop words leave their distance behind and nothing else."""
    clauses: list[list[Item]] = [[]]
    for part in re.findall(r'-?"[^"]*"?|\S+', query.lower()):
        if part == "or":
            clauses.append([])
            continue
        spoken = re.findall(r"[^\W_]+", part)
        terms = [(stem(w), k) for k, w in enumerate(spoken) if w not in STOP_WORDS]
        if terms:
            clauses[-1].append(Item(tuple((t, k - terms[0][1]) for t, k in terms), not part.startswith("-")))
    return [c for c in clauses if c]


def _holders(table: DataFrame, item: Item) -> DataFrame:
    """Ids that hold a word, or the words of a phrase at its distances."""
    found = lookup(table, [t for t, _ in item.terms])
    if len(item.terms) == 1:
        return found.select("id").distinct()
    steps = F.create_map(*(F.lit(x) for t in dict(item.terms) for x in (t, sorted({k for s, k in item.terms if s == t}))))
    starts = found.withColumn("step", F.explode(F.try_element_at(steps, F.col("term")))).select("id", "step", F.explode("places.pos").alias("pos"))
    return starts.groupBy("id", (F.col("pos") - F.col("step")).alias("start")).agg(F.count_distinct("step").alias("n")).where(F.col("n") == len({k for _, k in item.terms})).select("id").distinct()


def matches(table: DataFrame, docs: DataFrame, query: str) -> DataFrame:
    """Ids of ``docs`` (id) that a web-style query finds; an empty query finds none."""
    found = None
    for clause in parse(query):
        wanted = [_holders(table, i) for i in clause if i.wanted]
        ids = reduce(lambda a, b: a.join(b, "id", "left_semi"), wanted) if wanted else docs.select("id").distinct()
        for i in clause:
            ids = ids if i.wanted else ids.join(_holders(table, i), "id", "left_anti")
        found = ids if found is None else found.unionByName(ids)
    return docs.select("id").where("false") if found is None else found.distinct()


def term_rank(places: Column) -> Column:
    """Weight of one term in one document: the k-th place counts 1 / k squared, the best place whole."""
    scaled = F.aggregate(F.transform(places, lambda p, k: p["weight"] / ((k + 1) * (k + 1))), F.lit(0.0), lambda s, x: s + x)
    best = F.array_max(F.transform(places, lambda p, k: F.struct(p["weight"].alias("w"), (-k).alias("k"))))
    lost = best["w"] - best["w"] / ((1 - best["k"]) * (1 - best["k"]))
    return (scaled + lost) / LIMIT


def wanted_terms(queries: DataFrame) -> DataFrame:
    """(q, term, n): the distinct stems of each query (q, text), and their number."""
    each = queries.select("q", F.explode(F.array_distinct(words(F.col("text")))).alias("word")).where(~F.col("word").isin(STOP_WORDS))
    terms = each.select("q", stemmed(F.col("word")).alias("term")).distinct()
    return terms.join(terms.groupBy("q").agg(F.count("*").alias("n")), "q")


def any_term(table: DataFrame, queries: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(q, id, rank): documents with any word of a query, by the mean of its terms' weights."""
    terms = written(wanted_terms(queries), "wanted")
    asked = terms.withColumn("bucket", F.pmod(F.crc32("term"), F.lit(buckets)).cast("int"))
    hits = table.join(small(asked), ["bucket", "term"])
    return hits.groupBy("q", "id").agg((F.sum(term_rank(F.col("places"))) / F.first("n")).alias("rank"))


def best(hits: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query; ties by id."""
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc(F.round("rank", 9)), "id"))
    return hits.withColumn("__k", place).where(F.col("__k") <= k).drop("__k")


def cover_density(table: DataFrame, ids: DataFrame, terms: list[str], weight: float = D) -> DataFrame:
    """(id, density): the shortest stretches of each document that hold all terms, each by its other words.

    A place ends a shortest stretch if the last places of all terms up to it
    begin later than they did before it.
    """
    hits = lookup(table, terms).join(ids.select("id"), "id", "left_semi").select("id", "term", F.explode("places.pos").alias("pos"))
    so_far = Window.partitionBy("id").orderBy("pos")
    ranked = hits.withColumn("k", F.row_number().over(so_far))
    last = [F.max(F.when(F.col("term") == t, F.struct("pos", "k"))).over(so_far) for t in sorted(set(terms))]
    begins = ranked.withColumn("all", F.array(*last)).withColumn("begin", F.when(F.forall("all", lambda x: x.isNotNull()), F.array_min("all")))
    covers = begins.withColumn("before", F.lag("begin.pos").over(so_far)).where(F.col("begin").isNotNull() & (F.col("before").isNull() | (F.col("before") < F.col("begin.pos"))))
    noise = (F.col("pos") - F.col("begin.pos")) - (F.col("k") - F.col("begin.k"))
    return covers.groupBy("id").agg(F.sum(weight / (1 + noise)).alias("density"))


def websearch(table: DataFrame, docs: DataFrame, query: str) -> DataFrame:
    """(id, density) of what a web-style query finds: the sum of its clauses' cover densities."""
    found = written(matches(table, docs, query), "found")
    parts = [cover_density(table, found, [t for i in clause if i.wanted for t, _ in i.terms]) for clause in parse(query) if any(i.wanted for i in clause)]
    if not parts:
        return found.withColumn("density", F.lit(0.0))
    dense = reduce(lambda a, b: a.unionByName(b), parts).groupBy("id").agg(F.sum("density").alias("density"))
    return found.join(dense, "id", "left").select("id", F.coalesce("density", F.lit(0.0)).alias("density"))

