"""Names and types of extracted entities and relations, as Columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from casewright.functions.text import bound

# Field names that extraction leaks as relation types, and where a sentence's first clause ends.
LEAKED = ["source_entity", "target_entity", "source", "target", "relationship_type", "relationship", "type", "description", "evidence"]
CLAUSE_ENDS = [". ", "; ", ", ", " — ", " - ", ": "]
WORDS = 8


def token(c: Column) -> Column:
    """Lower-case letters and digits alone."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]", "")


def _by_token(names: list[str]) -> Column:
    plain = {"".join(ch for ch in n.lower() if ch.isalnum()): n for n in names}
    return F.create_map(*(F.lit(x) for pair in plain.items() for x in pair))


def mapped_type(text: Column, given: Column, valid: list[str], keywords: dict[str, list[str]]) -> Column:
    """A type of the ontology: the given one by its letters, the longest keyword that occurs, Concept, or the first."""
    seen = F.lower(F.concat_ws(" ", text, given))
    words = sorted(((w, t) for t, ws in keywords.items() if t in valid for w in ws), key=lambda x: -len(x[0]))
    by_word = [F.when(F.contains(seen, F.lit(w)), F.lit(t)) for w, t in words]
    last = next((v for v in valid if v.lower() == "concept"), sorted(valid)[0] if valid else "concept")
    return F.coalesce(F.try_element_at(_by_token(valid), token(given)), *by_word, F.lit(last))


def edge_type(given: Column, valid: list[str], closed: bool) -> Column:
    """A relation type of the ontology; null for leaked names, and for unknown types of a closed one."""
    leaked = F.array(*(F.lit(x.replace("_", "")) for x in LEAKED))
    other = F.lit(None).cast("string") if closed else F.lit("related_to") if "related_to" in valid else F.btrim(given)
    return F.when((token(given) == "") | F.array_contains(leaked, token(given)), None).otherwise(F.coalesce(F.try_element_at(_by_token(valid), token(given)), other))


def short_name(given: Column) -> Column:
    """A phrase of at most eight words; of a sentence its first clause."""
    n = lambda c: F.size(F.split(c, r"\s+"))

    def clause(t: Column) -> Column:
        found = t
        for end in reversed(CLAUSE_ENDS):  # the first of the list that occurs decides
            found = F.when(F.contains(t, F.lit(end)), F.split_part(t, F.lit(end), F.lit(1))).otherwise(found)
        return F.regexp_replace(found, r"[.!?]+$|\s+$", "")

    def few(c: Column) -> Column:
        return bound(F.split(c, r"\s+"), lambda words: F.when(F.size(words) > WORDS, F.array_join(F.slice(words, 1, WORDS), " ")).otherwise(c))

    def short(t: Column) -> Column:
        return F.when(t.rlike(r"[.!?]$") | (n(t) > WORDS), F.coalesce(F.nullif(bound(clause(t), few), F.lit("")), F.left(t, F.lit(120)))).otherwise(t)

    return bound(F.regexp_replace(given, r"^\s+|\s+$", ""), short)


def composed(c: Column) -> Column:
    """Unicode NFC, in Arrow batches; Spark has no function for it."""

    @F.pandas_udf("string")
    def nfc(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))

    return nfc(c)
