"""Case references of questions and how they carry over a conversation, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casewright.functions.text import case_scope

# Where a case reference stands, and words that tell follow-ups apart.
REFERENCES = (
    (r"(?i)(?:\bcase\b|\bcr(?:ime)?\b|\bcr\.\b|\bfir\b)\s*(?:no\.?|number)?\s*[:#-]?\s*([A-Z0-9]+(?:[/-][A-Z0-9]+)+|\d{1,8})", 1),
    (r"(?i)\b([A-Z0-9]+(?:/[A-Z0-9]+)+)\b", 1),
    (r"(?i)\b(\d{3,8}\s*(?:/|-|\bOF\b)\s*\d{2,4})\b", 1),
)
GROUPED, SEVERAL, ITEM = r"(?i)\bcases?\b([^?.!\n]{0,120})", r"(?i)\b(and|vs\.?|versus|,|&)\b", r"(?i)\b\d{1,8}(?:\s*(?:/|-|\bOF\b)\s*\d{2,4})?\b"
COMPARATIVE = r"(?i)\b(which one|which case|the other case|both cases|both of them|either case|either one|difference|differences|compare|comparison|versus|vs\.?|contrast|similarit(?:y|ies))\b"
GLOBAL = r"(?i)\b(which (?:are )?(?:the )?cases?|what cases?|list (?:the )?cases?|show (?:me )?(?:the )?cases?|available cases?|cases? about which you have information|what information (?:is )?available|which information (?:is )?available|which documents?|what documents?|across (?:all |different )?cases?|across cases|all cases|overall|in general)\b"
POINTING = r"(?i)\b(this case|that case|the case|this matter|that matter|the matter|the accused|the victim|the complainant|the incident|the offence|the offense|the witness(?:es)?|the charge(?:s)?|the motive|the weapon|what happened|who|why|when|where|how)\b"


def extracted(question: Column) -> Column:
    """References of a text in canonical form, each once, by pattern and then by place."""
    found = [F.regexp_extract_all(question, F.lit(p), g) for p, g in REFERENCES]
    groups = F.filter(F.regexp_extract_all(question, F.lit(GROUPED), 1), lambda s: s.rlike(SEVERAL))
    found.append(F.flatten(F.transform(groups, lambda s: F.regexp_extract_all(s, F.lit(ITEM), 0))))
    return F.array_distinct(F.filter(F.transform(F.concat(*found), case_scope), lambda s: s != ""))


def key(scope: Column) -> Column:
    return F.split_part(scope, F.lit("/"), F.lit(1))


def merged(scopes: Column) -> Column:
    """One scope for each key, the most specific, in the order in which keys appear."""
    known = F.filter(F.transform(scopes, case_scope), lambda s: s != "")
    weight = lambda s: F.when(F.contains(s, F.lit("/")), 100).otherwise(0) + F.length(s)

    def best(k: Column) -> Column:
        own = F.filter(known, lambda s: key(s) == k)
        return F.aggregate(own, F.lit(""), lambda kept, s: F.when(weight(s) > weight(kept), s).otherwise(kept))

    return F.transform(F.array_distinct(F.transform(known, key)), best)


def points_back(question: Column) -> Column:
    """A follow-up about one case: neither global nor comparative, and pointing or short."""
    short = F.size(F.split(F.regexp_replace(question, r"^\s+|\s+$", ""), r"\s+")) <= 12
    return ~question.rlike(GLOBAL) & ~question.rlike(COMPARATIVE) & (question.rlike(POINTING) | short)


def resolved(question: Column, explicit: Column, pinned: Column, last_multi: Column, last_mode: Column) -> Column:
    """struct(scopes, mode, source, clarify) of a question, given what the conversation has pinned."""
    own, several = merged(explicit), (last_mode == "multi") & (F.size(last_multi) > 1)
    none = F.array().cast("array<string>")

    def answer(scopes: Column, mode: str, source: str, clarify: bool = False) -> Column:
        return F.struct(scopes.alias("scopes"), F.lit(mode).alias("mode"), F.lit(source).alias("source"), F.lit(clarify).alias("clarify"))

    back = points_back(question)
    return (
        F.when(F.size(own) > 1, answer(own, "multi", "explicit_multi"))
        .when(F.size(own) == 1, answer(own, "single", "explicit_single"))
        .when(question.rlike(COMPARATIVE) & several, answer(merged(last_multi), "multi", "follow_up_multi"))
        .when(several & back, answer(none, "global", "global", True))
        .when(pinned.isNotNull() & (pinned != "") & back, answer(merged(F.array(pinned)), "single", "follow_up_single"))
        .otherwise(answer(none, "global", "global"))
    )


def next_pin(pinned: Column, last_multi: Column, scope: Column) -> Column:
    """struct(case_reference, last_multi, last_mode, last_source) after a turn."""
    single, multi = scope["source"] == "explicit_single", scope["source"] == "explicit_multi"
    return F.struct(
        F.when(single, F.get(scope["scopes"], F.lit(0))).otherwise(pinned).alias("case_reference"),
        F.when(single, F.lit(None)).when(multi, scope["scopes"]).otherwise(last_multi).alias("last_multi"),
        scope["mode"].alias("last_mode"),
        scope["source"].alias("last_source"),
    )
