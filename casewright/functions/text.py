"""Text functions as Columns; all of them stay inside generated code."""

from __future__ import annotations

import html
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What is redacted, in this order, and what is masked, in this order.
REDACTIONS = {
    "email": r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b",
    "phone_number": r"(?<!\d)(?:\+?91[-\s]?)?[6-9]\d{9}(?!\d)",
    "aadhaar": r"(?<!\d)\d{4}[\s-]?\d{4}[\s-]?\d{4}(?!\d)",
    "pan": r"\b[A-Z]{5}\d{4}[A-Z]\b",
    "date_of_birth": r"(?i)\b(?:DOB|Date of Birth)\s*[:\-]?\s*\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b",
    "victim_name_label": r"(?i)\b(?:victim|prosecutrix|minor girl|child victim)\s+name\s*[:\-]\s*[A-Za-z][A-Za-z .]{1,80}",
    "address_label": r"(?i)\baddress\s*[:\-]\s*[A-Za-z0-9][A-Za-z0-9, ./#-]{8,120}",
}
MASKS = {
    "[MASKED_PHONE]": r"(?:\+91[\s-]?|0)?[6-9]\d{9}",
    "[MASKED_AADHAAR]": r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}\b",
    "[MASKED_EMAIL]": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "[MASKED_ID]": r"\b[A-Z]{2,4}[/-]\d{3,8}\b",
    "[MASKED_PAN]": r"\b[A-Z]{5}\d{4}[A-Z]\b",
}
# Words of an offence category and the flags that they imply.
PROTECTED = (
    (("child_sexual_offence", "pocso", "child victim", "minor"), ("minor_identity", "sexual_offence_detail")),
    (("rape", "sexual_assault", "sexual_offence", "prosecutrix", "molest"), ("victim_identity", "sexual_offence_detail")),
    (("juvenile", "juvenile_justice", "jj act"), ("minor_identity",)),
    (("sealed", "in_camera", "in camera"), ("sealed_record",)),
)
# Markdown that is taken out, in this order, and what stays of it.
MARKDOWN = ((r"(?m)^#{1,6}\s+", ""), (r"\*{1,3}([^*]+)\*{1,3}", "$1"), (r"_{1,3}([^_]+)_{1,3}", "$1"), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"!\[([^\]]*)\]\([^)]+\)", "$1"), (r"```[\s\S]*?```", ""), (r"`([^`]+)`", "$1"), (r"(?m)^[-*_]{3,}\s*$", ""))
SCRIPTS = {"latin": "[^A-Za-z]", "devanagari": "[^ऀ-ॿ]", "tamil": "[^஀-௿]", "kannada": "[^ಀ-೿]"}


def redact(c: Column) -> tuple[Column, Column]:
    """(redacted text, map of the rules that hit and how often); each rule sees the work of those before it."""
    counts, text = [], c
    for rule, pattern in REDACTIONS.items():
        counts.append(F.struct(F.lit(rule).alias("key"), F.regexp_count(text, F.lit(pattern)).alias("value")))
        text = F.regexp_replace(text, pattern, f"[REDACTED:{rule}]")
    return text, F.map_from_entries(F.filter(F.array(*counts), lambda x: x["value"] > 0))


def _gates(c: Column) -> dict[str, Column]:
    """What a text must hold for a rule to hit, by plain search; no rule's marker holds any of it."""
    low = F.lower(c)
    has = lambda *words: reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words))
    run = c.rlike("[0-9]{4}")
    return {"email": F.contains(c, F.lit("@")), "phone_number": run, "aadhaar": run, "pan": run, "date_of_birth": has("dob", "date of birth"), "victim_name_label": has("name"), "address_label": has("address")}


def _found(c: Column, word: str) -> Column:
    """How often a word stands in a text."""
    return F.length(F.replace(c, F.lit(word), F.lit(word + " "))) - F.length(c)


def redacted(df: DataFrame, name: str) -> DataFrame:
    """``df`` with ``name`` redacted and ``hits`` added.

    The same as :func:`redact`.  Rules run only on texts that may hold what
    they look for, once each; what they put in is then counted by its marker.
    """
    counts, gates = [], _gates(F.col(name))
    df = df.withColumns({f"__{rule}": gate for rule, gate in gates.items()})
    for rule, pattern in REDACTIONS.items():
        marker = f"[REDACTED:{rule}]"
        counts.append(F.struct(F.lit(rule).alias("key"), F.col(f"__{rule}").alias("value")))
        df = df.withColumn("__after", F.when(F.col(f"__{rule}"), F.regexp_replace(name, pattern, marker)).otherwise(F.col(name)))
        changed = F.col("__after") != F.col(name)
        df = df.withColumns({f"__{rule}": F.when(changed, _found(F.col("__after"), marker) - _found(F.col(name), marker)).otherwise(F.when(F.col(name).isNotNull(), 0)), name: F.col("__after")}).drop("__after")
    hits = F.map_from_entries(F.filter(F.array(*counts), lambda x: x["value"] > 0))
    return df.withColumn("hits", hits).drop(*(f"__{rule}" for rule in REDACTIONS))


def protected_flags(categories: Column) -> Column:
    """Sorted flags whose keywords any category contains."""

    def hit(flag: str) -> Column:
        words = [w for some, flags in PROTECTED if flag in flags for w in some]
        return F.exists(categories, lambda x: reduce(lambda a, b: a | b, (F.contains(F.lower(x), F.lit(w)) for w in words)))

    every = sorted({f for _, flags in PROTECTED for f in flags})
    return F.array_sort(F.array_compact(F.array(*(F.when(hit(f), F.lit(f)) for f in every))))


def sensitive_flags(*payloads: Column) -> Column:
    """Sorted flags of JSON payloads: those they name, at the top or under judgment or district, and those of their offences."""

    def gathered(name: str) -> Column:
        paths = [f"$.{at}{name}" for at in ("", "judgment.", "district.")]
        lists = [F.from_json(F.get_json_object(p, path), "array<string>") for p in payloads for path in paths]
        return F.flatten(F.array(*(F.coalesce(x, F.array().cast("array<string>")) for x in lists)))

    both = F.array_union(gathered("sensitive_data_flags"), protected_flags(gathered("offence_categories")))
    return F.array_sort(F.filter(both, lambda f: f != ""))


def redaction_status(flags: Column, hits: Column) -> Column:
    return F.when((F.size(flags) > 0) & (F.size(hits) == 0), "needs_review").when(F.size(hits) > 0, "redacted").otherwise("not_required")


def mask(c: Column, names: Column | None = None) -> Column:
    for label, pattern in MASKS.items():
        c = F.regexp_replace(c, pattern, label)
    if names is None:
        return c
    return F.aggregate(names, c, lambda text, n: F.regexp_replace(text, F.concat(F.lit("(?i)\\Q"), n, F.lit("\\E")), F.lit("[MASKED_NAME]")))


def script(c: Column, chars: int = 5000) -> Column:
    """The script with most letters in the first characters; ties in the order of SCRIPTS."""
    head = F.substring(c, 1, chars)
    n = {k: F.length(F.regexp_replace(head, p, "")) for k, p in SCRIPTS.items()}
    most = F.greatest(*n.values())
    out = F.when(most == 0, "unknown")
    for k, v in n.items():
        out = out.when(v == most, k)
    return out.otherwise("unknown")


def strip_markdown(c: Column) -> Column:
    for pattern, by in MARKDOWN:
        c = F.regexp_replace(c, pattern, by)
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def html_text(c: Column) -> Column:
    """Line breaks for br and p, tags gone, all character references decoded, white space squeezed.

    References are decoded in Arrow batches; Spark has no function for them.
    """

    @F.pandas_udf("string")
    def decoded(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None or "&" not in x else html.unescape(x))

    c = F.regexp_replace(F.regexp_replace(c, r"(?i)<br\s*/?>", "\n"), r"(?i)</p>", "\n\n")
    c = F.regexp_replace(F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</\1>", ""), r"<[^>]+>", " ")
    return F.btrim(F.regexp_replace(F.regexp_replace(decoded(c), r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def search_words(c: Column) -> Column:
    """The OR query of a search text: words of more than one character, then stripped to ASCII word characters."""
    words = F.filter(F.split(c, r"\s+"), lambda w: F.length(w) > 1)
    return F.array_join(F.filter(F.transform(words, lambda w: F.regexp_replace(w, "[^0-9A-Za-z_]", "")), lambda w: w != ""), " | ")


def terms(c: Column, least: int = 2) -> Column:
    """Distinct lower-case words of a search text, ASCII word characters only."""
    words = F.transform(F.split(F.lower(c), r"\s+"), lambda w: F.regexp_replace(w, "[^0-9A-Za-z_]", ""))
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= least))


def trigrams(c: Column) -> Column:
    """Distinct trigrams of each lower-case word, two blanks before and one after."""
    words = F.filter(F.split(F.lower(c), "[^0-9a-z]+"), lambda w: w != "")
    each = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(each))


def whole_trigrams(c: Column) -> Column:
    """Distinct trigrams of the whole lower-case string, padded; blanks inside count."""
    padded = F.concat(F.lit("  "), F.lower(c), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3))))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def is_table(c: Column) -> Column:
    lines = F.split(F.btrim(c), "\n")
    piped = F.size(F.filter(lines, lambda x: F.regexp_count(x, F.lit("[|]")) >= 2))
    return (F.size(lines) >= 2) & (piped / F.size(lines) > 0.5)


def trimmed(c: Column, most: int = 280) -> Column:
    c = F.btrim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def csv_cell(c: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(c.rlike('[",\\n\\r]'), quoted).otherwise(F.coalesce(c, F.lit("")))


def citations(answer: Column, n: Column, most: int = 20) -> Column:
    """Distinct ``[k]`` in the order of first use, 1 to n."""
    found = F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,6})\]"), 1), lambda x: x.cast("int"))
    return F.slice(F.filter(F.array_distinct(found), lambda x: (x >= 1) & (x <= n)), 1, most)


def follow_ups(answer: Column) -> Column:
    tail = F.split(F.split_part(answer, F.lit("FOLLOW_UP_QUESTIONS:"), F.lit(2)), "\n")
    clean = F.transform(tail, lambda x: F.btrim(F.regexp_replace(x, r"^\s*(?:[-*]|\d+[.)])\s*", "")))
    return F.slice(F.filter(clean, lambda x: (F.length(x) > 5) & (F.length(x) < 200)), 1, 3)


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once a row, however often ``f`` names it: lambdas would compute it at each use."""
    return F.transform(F.array(value), f)[0]


def case_scope(c: Column) -> Column:
    """A case reference in canonical form, e.g. ``FIR No. 12 of 2020`` as ``12/2020``."""
    c = F.regexp_replace(F.regexp_replace(F.upper(c), r"\b(CASE|CRIME|CR|FIR|NO|NUMBER)\b", " "), r"\bOF\b|-", "/")
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[^A-Z0-9/]+", " "), r"\s*/\s*", "/"), r"\s+", " ")
    compound = F.regexp_extract(c, "[A-Z0-9]+(?:/[A-Z0-9]+)+", 0)
    return F.when(compound != "", compound).otherwise(F.btrim(c))


def scopes_match(a: Column, b: Column) -> Column:
    bare = ~F.contains(a, F.lit("/")) | ~F.contains(b, F.lit("/"))
    return (a == b) | (bare & (F.split_part(a, F.lit("/"), F.lit(1)) == F.split_part(b, F.lit("/"), F.lit(1))))


def cnr(prefix: Column, serial: Column, year: Column) -> Column:
    return F.concat(prefix, F.lpad(serial.cast("string"), 6, "0"), year.cast("string"))


def content_hash(c: Column) -> Column:
    return F.left(F.sha2(c, 256), F.lit(16))


def quality(c: Column) -> Column:
    """Share of printable characters less penalties; formatting and unassigned characters aren't printable."""
    blanks = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"

    def share(s: Column) -> Column:
        bad = F.length(F.regexp_replace(s, r"[^\p{C}&&[^\t\n\r\f\x0b\x1c-\x1f\x85]]", ""))
        lost, control = F.regexp_count(s, F.lit("�")), F.regexp_count(s, F.lit(r"[\x00-\x08\x0b\x0e-\x1f]"))
        n = F.length(s)
        return F.when(n == 0, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (n - bad - lost * 5 - control * 3) / n)), 4))

    return bound(F.regexp_replace(c, f"^{blanks}|{blanks}$", ""), share)
