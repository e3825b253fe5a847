"""Tables and lists inside texts.

A table is a block of piped rows between two marks, a list a run of lines with
bullets or numbers.  Each text is worked on by itself; tables stay inside
generated code, lists and similar strings go through Arrow batches.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import groupby, pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.functions.text import bound

# The marks of tables, of their JSON form, and of pages.
BLOCK = r"(?s)<!-- TABLE_START -->\n(.*?)\n<!-- TABLE_END -->"
JSON_BLOCK = r"(?s)\s*\[TABLE_JSON\].*?\[/TABLE_JSON\]\s*"
PAGE = r"<!-- PAGE (\d+) -->"
ITEM = re.compile(r"(\s*)(?:[-*+]|\d+[.)]) (.+)")
DEPTH = 5


def rows_of(block: Column) -> Column:
    """Cells of each row of a block; empty cells are left out, so that columns can shift."""
    lines = F.filter(F.transform(F.split(block, "\n"), lambda x: F.btrim(x)), lambda x: x != "")
    return F.transform(lines, lambda x: F.filter(F.transform(F.split(x, r"\|"), lambda c: F.btrim(c)), lambda c: c != ""))


def parsed(text: Column) -> Column:
    """array<struct<headers, rows>> of the tables with at least two rows."""
    each = F.transform(F.regexp_extract_all(text, F.lit(BLOCK), 1), rows_of)
    return F.transform(F.filter(each, lambda t: F.size(t) >= 2), lambda t: F.struct(t[0].alias("headers"), F.slice(t, 2, F.size(t)).alias("rows")))


def pages_of(text: Column) -> Column:
    """Page of each table: that of the last page mark before it, null before the first."""
    before = F.slice(F.split(text, "<!-- TABLE_START -->\n"), 1, F.size(F.split(text, "<!-- TABLE_START -->\n")) - 1)
    each = F.transform(before, lambda part: F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.regexp_extract_all(part, F.lit(PAGE), 1)), -1))
    return bound(each, lambda marks: F.transform(marks, lambda m, i: F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.filter(F.slice(marks, 1, i + 1), lambda x: x.isNotNull())), -1).cast("int")))


def header_keys(labels: Column) -> Column:
    """A key for each label: lower case with underscores, a number after repeats."""
    key = lambda x, i: F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit("")), F.concat(F.lit("column_"), (i + 1).cast("string")))

    def numbered(base: Column) -> Column:
        before = lambda k, i: F.size(F.filter(F.slice(base, 1, i + 1), lambda x: x == k))
        return F.transform(base, lambda k, i: bound(before(k, i), lambda n: F.when(n == 1, k).otherwise(F.concat(k, F.lit("_"), n.cast("string")))))

    return bound(F.transform(labels, key), numbered)


def labelled(table: Column) -> Column:
    """Header of each column up to the widest row; unnamed ones by their place."""

    def named(t: Column) -> Column:
        widest = F.greatest(F.size(t["headers"]), F.coalesce(F.array_max(F.transform(t["rows"], lambda r: F.size(r))), F.lit(0)))
        name = lambda i: F.coalesce(F.nullif(F.get(t["headers"], i - 1), F.lit("")), F.concat(F.lit("Column "), i.cast("string")))
        return bound(widest, lambda width: F.when(width > 0, F.transform(F.sequence(F.lit(1), F.greatest(width, F.lit(1))), name)).otherwise(F.array().cast("array<string>")))

    return bound(table, named)


def sentences(table: Column) -> Column:
    """"Row n. Header is value." for each row with a value."""

    def told(t: Column, labels: Column) -> Column:
        facts = lambda r: F.filter(F.transform(r, lambda v, k: F.when(v != "", F.concat(F.get(labels, k), F.lit(" is "), v))), lambda x: x.isNotNull())
        sentence = lambda r, i: bound(facts(r), lambda f: F.when(F.size(f) > 0, F.concat(F.lit("Row "), (i + 1).cast("string"), F.lit(". "), F.array_join(f, ". "), F.lit("."))))
        return F.filter(F.transform(t["rows"], sentence), lambda x: x.isNotNull())

    return bound(table, lambda t: bound(labelled(t), lambda labels: told(t, labels)))


def heading(table: Column, number: Column) -> Column:
    columns = bound(labelled(table), lambda labels: F.when(F.size(labels) > 0, F.concat(F.lit("Columns: "), F.array_join(labels, "; "), F.lit("."))).otherwise("Columns were not detected."))
    return F.concat(F.lit("Table "), number.cast("string"), F.lit("\n\n"), columns)


def worded(table: Column, number: Column) -> Column:
    """The whole table as text: heading, columns, then a sentence a row."""
    body = lambda t: bound(sentences(t), lambda s: F.when(F.size(s) > 0, F.array_join(s, "\n\n")).otherwise("No populated rows were extracted from this table."))
    return bound(table, lambda t: F.concat(heading(t, number), F.lit("\n\n"), body(t)))


def chunked(head: Column, lines: Column, max_chars: int, max_rows: int) -> Column:
    """Texts of a heading and as many sentences as fit, one at least."""
    empty = F.array().cast("array<array<string>>")

    def packed(head: Column) -> Column:
        def put(groups: Column, line: Column) -> Column:
            def placed(last: Column) -> Column:
                size = F.length(head) + F.aggregate(last, F.length(line) + 2, lambda n, x: n + F.length(x) + 2)
                fits = (F.size(last) > 0) & (F.size(last) < max_rows) & (size <= max_chars)
                return F.when(fits, F.array_append(F.slice(groups, 1, F.size(groups) - 1), F.array_append(last, line))).otherwise(F.array_append(groups, F.array(line)))

            return bound(F.element_at(F.concat(F.array(F.array().cast("array<string>")), groups), -1), placed)

        return F.transform(F.aggregate(lines, empty, put), lambda g: F.concat(head, F.lit("\n\n"), F.array_join(g, "\n\n")))

    return bound(head, packed)


def without_tables(text: Column) -> Column:
    """JSON blocks of tables taken out, empty lines squeezed."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, JSON_BLOCK, "\n\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def depths(indents: list[int], most: int) -> list[int]:
    """How many of the indents that still enclose each line are smaller than its own; ``most`` - 1 at the deepest."""
    enclosing: list[int] = []
    out = []
    for indent in indents:
        k = bisect_left(enclosing, indent)
        enclosing = [*enclosing[:k], indent]
        out.append(min(k, most - 1))
    return out


def tree(items: list[tuple[int, str]], depth: int = 0) -> list[dict]:
    """Items (depth, text) as nested mappings: what is deeper than an item and follows it stands below it."""
    heads = [k for k, (d, _) in enumerate(items) if d == depth]
    below = [tree(items[a + 1 : b], depth + 1) for a, b in pairwise([*heads, len(items)])]
    return [{"text": items[k][1], **({"children": under} if under else {})} for k, under in zip(heads, below, strict=True)]


def listed(text: str) -> str:
    """Runs of list lines with two items or more at their first level as indented JSON; all else as it is."""
    out = []
    for is_list, lines in groupby(text.split("\n"), key=lambda x: ITEM.match(x) is not None):
        run = list(lines)
        found = [ITEM.match(x) for x in run] if is_list else []
        items = tree(list(zip(depths([len(m[1]) for m in found], DEPTH), (m[2].strip() for m in found), strict=True)))
        out += [json.dumps(items, ensure_ascii=False, indent=2)] if len(items) >= 2 else run
    return "\n".join(out)


def lists(docs: DataFrame) -> DataFrame:
    """(id, text) with lists as JSON; null stays null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(text=[None if t is None else listed(t) for t in b["text"]])

    return docs.select("id", "text").mapInPandas(run, docs.select("id", "text").schema)


def ratio(a: str, b: str) -> float:
    """Similarity of two names by matching blocks; at least 0.85 where one holds the other and half agrees."""
    a, b = a.lower().strip(), b.lower()
    r = SequenceMatcher(None, a, b).ratio()
    return max(r, 0.85) if r > 0.5 and (a in b or b in a) else r


def best_matches(pairs: DataFrame, least: float = 0.6) -> DataFrame:
    """(fragment, name, score): the best name of each fragment among its candidates (fragment, name); ties by name."""

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)])

    scored = pairs.withColumn("score", score("fragment", "name")).where(F.col("score") >= least)
    best = scored.groupBy("fragment").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("name"))).alias("b"))
    return best.select("fragment", "b.name", (-F.col("b.s")).alias("score"))


def segments(text: Column, most: int) -> Column:
    """Parts of at most ``most`` characters, cut at blank lines and form feeds where that is possible."""
    # a separator stays with the part before it
    parts = F.filter(F.split(F.regexp_replace(text, r"(\n{2,}|\f)", "$1\u0000"), "\u0000"), lambda p: p != "")
    cut = F.flatten(F.transform(parts, lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / most).cast("int")), lambda k: F.substr(p, k * most + 1, F.lit(most)))))

    def put(out: Column, p: Column) -> Column:
        last = F.element_at(F.concat(F.array(F.lit("")), out), -1)
        fits = (F.size(out) > 0) & (F.length(last) + F.length(p) <= most)
        return F.when(fits, F.array_append(F.slice(out, 1, F.size(out) - 1), F.concat(last, p))).otherwise(F.array_append(out, p))

    return F.when(F.length(text) <= most, F.array(text)).otherwise(F.aggregate(cut, F.array().cast("array<string>"), put))
