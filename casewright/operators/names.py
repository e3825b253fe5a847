"""Many names in many texts: one automaton a worker, one pass over each text.

Names are a user's list or the nodes of a graph.  They are read in blocks of a
bounded number of characters; each block is one pass, and its automaton is
built once a worker.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.functions.text import mask

#: Characters of a block of names.
BLOCK = 16 << 20
# Words between the ends of a relation.
VERBS = ["issued", "works at", "related to", "applies to", "measures", "produces", "requires", "regulates", "depends on", "causes", "member of", "part of", "located in", "reports to", "funded by"]
_held: dict[int, object] = {}


def _automaton(names: list[tuple[str, str]]):
    """Of lower-case names, each with those that are so written; kept until another block comes."""
    import ahocorasick

    key = hash(tuple(names))
    if key not in _held:
        _held.clear()
        a, by = ahocorasick.Automaton(), {}
        for low, name in names:
            by.setdefault(low, []).append(name)
        for low, spelled in by.items():
            a.add_word(low, spelled)
        a.make_automaton()
        _held[key] = a
    return _held[key]


def _finder(names: list[tuple[str, str]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = _automaton(names)
        for b in batches:
            found = [sorted({n for _, spelled in a.iter(t) for n in spelled}) if t else [] for t in b["low"]]
            yield pd.DataFrame({"id": b["id"], "names": found})

    return run


def found_names(docs: DataFrame, names: DataFrame, block: int = BLOCK) -> DataFrame:
    """(id, names): the names (name) that a text (id, text) contains, case aside, sorted; ids are unique.

    Null and empty names are none, a null text holds none.
    """
    clean = names.select("name", F.lower("name").alias("low")).where("name <> ''").distinct()
    size = clean.agg(F.sum(F.length("name") + 1)).first()[0] or 0
    blocks = -(-size // block)
    low = docs.select("id", F.lower("text").alias("low"))
    schema = f"id {docs.schema['id'].dataType.simpleString()}, names array<string>"
    if not blocks:
        return low.select("id", F.array().cast("array<string>").alias("names"))
    parts = []
    for k in range(blocks):  # a block of names at a time reaches the driver
        own = [(r["low"], r["name"]) for r in clean.where(F.pmod(F.xxhash64("name"), F.lit(blocks)) == k).orderBy("name").toLocalIterator()]
        if own:
            parts.append(low.mapInPandas(_finder(own), schema))
    if len(parts) == 1:
        return parts[0]
    every = reduce(lambda a, b: a.unionByName(b), parts)
    return every.groupBy("id").agg(F.array_sort(F.flatten(F.collect_list("names"))).alias("names"))


def masked(docs: DataFrame, names: DataFrame) -> DataFrame:
    """(id, masked): texts (id, text) without personal data and without these names; longer names go first."""
    found = found_names(docs, names)
    longest = F.array_sort("names", lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    return docs.join(found.withColumn("names", longest), "id").select("id", mask(F.col("text"), F.col("names")).alias("masked"))


def known_name(fragment: str, names: list[str]) -> str | None:
    """The name most like a fragment, if 0.6 of it agrees; a name that holds it, or is held, and agrees by half wins over earlier ones."""
    low, best, found = fragment.strip(), 0.0, None
    for name in names:
        other = name.lower()
        r = SequenceMatcher(None, low, other).ratio()
        held = r > 0.5 and (low in other or other in low)
        if r > best or held:
            best, found = max(best, r, 0.85 if held else 0.0), name
    return found if best >= 0.6 else None


def relation(worded: str, kind: str, names: list[str]) -> tuple[str | None, str | None]:
    """Source and target of a worded relation among the names of its text.

    The relation's type parts the words, else the first of VERBS that does and
    leaves two different names; else the first two names that occur.
    """
    low = worded.lower()
    for by in (kind.replace("_", " "), *VERBS):
        if by and by in low:
            left, _, right = low.partition(by)
            source, target = known_name(left, names), known_name(right, names)
            if source and target and source != target:
                return source, target
    there = [n for n in names if n.lower() in low]
    return (there[0], there[1]) if len(there) >= 2 else (None, None)


def relations(worded: Column, kind: Column, names: Column) -> Column:
    """struct(source, target) of each worded relation, in Arrow batches."""

    @F.pandas_udf("source string, target string")
    def ends(text: pd.Series, given: pd.Series, known: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([relation(t, k or "", list(n)) if t is not None and n is not None else (None, None) for t, k, n in zip(text, given, known, strict=True)], columns=["source", "target"])

    return ends(worded, kind, names)
