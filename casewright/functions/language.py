"""Language names, glossaries, translation checks and page confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of languages and the language that a script hints at.
ALIASES = {"eng": "en", "english": "en", "hin": "hi", "hindi": "hi", "mar": "mr", "marathi": "mr", "kan": "kn", "kannada": "kn", "tam": "ta", "tamil": "ta", "unknown": "", "und": ""}
HINTS = {"latin": "en", "devanagari": "hi", "kannada": "kn", "tamil": "ta"}


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def normalized(language: Column) -> Column:
    """Lower case without region, by its usual name; unknown is empty."""
    bare = F.split_part(F.replace(F.lower(F.btrim(F.coalesce(language, F.lit("")))), F.lit("_"), F.lit("-")), F.lit("-"), F.lit(1))
    return F.coalesce(_map(ALIASES)[bare], bare)


def source_language(language: Column, script: Column) -> Column:
    """The stated language; another script overrides English; without one the script's, else English."""
    name, hint = normalized(language), _map(HINTS)[F.lower(script)]
    return F.when((name == "en") & hint.isNotNull() & (hint != "en"), hint).when(name != "", name).otherwise(F.coalesce(hint, F.lit("en")))


def translation_status(source: Column, target: Column, provider: Column, confidence: Column, least: float = 0.70, auto: bool = False) -> Column:
    """approved, needs_review or pending."""
    same = (source == target) | provider.isin("passthrough", "identity")
    return F.when(same, "approved").when(confidence < least, "needs_review").otherwise("approved" if auto else "pending")


def page_confidence(c: Column) -> Column:
    """Share of printable characters, less for pages under 200; 0 under 10."""
    core = F.regexp_replace(c, r"^[\s\x1c-\x1f\x85\xa0]+|[\s\x1c-\x1f\x85\xa0]+$", "")
    bad = F.length(F.regexp_replace(c, r"[^\p{C}\p{Zl}\p{Zp}\p{Zs}&&[^ \t\n]]", ""))
    n = F.length(c)
    return F.when(F.length(core) < 10, 0.0).otherwise((n - bad) / n * F.least(F.lit(1.0), F.length(core) / 200))
