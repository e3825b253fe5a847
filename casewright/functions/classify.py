"""Rule systems as ordered conditions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wording that decides a question's profile, in this order, with the confidence.
PROFILES = [
    ("comparison", 0.8, "compare|versus|vs\\.?|difference|between supreme court and|high court and"),
    ("pattern_analysis", 0.8, "most common|trend|pattern|how often|success rate|failure rate|why .* cases|how many"),
    ("officer_lesson", 0.8, "officer|police should|checklist|lesson|best practice|investigating officer|improve"),
    ("precedent_trace", 0.78, "precedent|followed|distinguished|overruled|binding|persuasive|later treatment"),
    ("doctrine", 0.72, "doctrine|principle|what is the law|section 50|legal test|requirement|applies to"),
]
# Wording of questions about district data, of counts, of source texts, and of rankings.
DISTRICT = "district court|district-court|trial court|sessions court|magistrate|cnr|ecourts|e-courts|ddl|hldc|indian kanoon|metadata|district metadata|text coverage|translation coverage|ocr coverage|redaction coverage|source performance|case volume"
ANALYTICS = "how many|count|counts|volume|trend|dashboard|coverage|rate|percentage|distribution|by district|by state|by court|hit rate|miss rate|queue|quota|pending|disposed|disposition|delay|analytics|cnr list"
SOURCE_TEXT = "cite|sample judgment|sample translated|find cases|which cases|source text|what did courts|why did|explain"
AGGREGATE = "which sources|which districts|which court levels|which source|which district|which court level"
# Wording that decides the intent of a count, in this order.
INTENTS = [("source_performance", "source|hit rate|miss rate|queue|quota|indian kanoon|ecourts|e-courts|hldc|ddl"), ("outcomes", "outcome|disposition|conviction|acquittal|bail|disposed|pending"), ("volume", "volume|trend|year|month|filing|registration|decision|delay")]


def question_plan(question: Column) -> Column:
    """struct(profile, route, confidence, intent) of a question without explicit filters."""
    q = F.lower(question)
    district = q.rlike(ANALYTICS) & q.rlike(DISTRICT) & (~q.rlike(SOURCE_TEXT) | q.rlike(AGGREGATE))
    profile, confidence = F.when(district, "district_analytics"), F.when(district, 0.86)
    for name, sure, words in PROFILES:
        profile, confidence = profile.when(q.rlike(words), name), confidence.when(q.rlike(words), sure)
    intent = F.when(~district, F.lit(None))
    for name, words in INTENTS:
        intent = intent.when(q.rlike(words), name)
    return F.struct(profile.otherwise("case_specific").alias("profile"), F.when(district, "district_analytics").otherwise("triad_retrieval").alias("route"), confidence.otherwise(0.55).alias("confidence"), intent.otherwise("coverage").alias("intent"))


# What parts a list text, and what a section number looks like.
SEPARATORS, SECTION = r"[;,|]\s*|\n+", r"\b\d{2,4}[A-Z]?(?:-[A-Z])?\b"


def tokens(c: Column) -> Column:
    """Items of a list text; none, nan and null drop out."""
    parts = F.transform(F.split(c, SEPARATORS), lambda x: F.btrim(x))
    return F.filter(parts, lambda x: (x != "") & ~F.lower(x).isin("none", "nan", "null"))


def sections(c: Column) -> Column:
    """Section numbers of a list text, or the items as they are; each once."""
    found = F.transform(tokens(c), lambda x: F.when(F.upper(x).rlike(SECTION), F.regexp_extract_all(F.upper(x), F.lit(SECTION), 0)).otherwise(F.array(F.upper(x))))
    return F.array_distinct(F.flatten(found))


def offences(section_list: Column, act: Column, text: Column, rules: list[dict]) -> Column:
    """Categories in the order of the rules; sections decide alone where a rule names any."""

    def hit(rule: dict) -> Column:
        acts = F.lit(True)
        if rule.get("acts"):
            acts = F.exists(F.array(*(F.lit(a.lower()) for a in rule["acts"])), lambda a: F.contains(F.lower(act), a))
        if rule.get("sections"):
            return acts & F.arrays_overlap(section_list, F.array(*(F.lit(s) for s in rule["sections"])))
        if rule.get("acts"):
            return acts
        return F.exists(F.array(*(F.lit(k.lower()) for k in rule.get("keywords", [""]))), lambda k: F.contains(F.lower(text), k))

    return F.array_compact(F.array(*(F.when(hit(r), F.lit(r["category"])) for r in rules)))


def court_level(position: Column, kind: Column) -> Column:
    t = F.lower(F.concat_ws(" ", F.nullif(position, F.lit("")), F.nullif(kind, F.lit(""))))
    return F.when(t == "", None).when(F.contains(t, F.lit("pocso")), "special_pocso").when(F.contains(t, F.lit("session")), "sessions").when(F.contains(t, F.lit("magistrate")) | t.rlike(r"\bjmfc\b|\bcjm\b|\bmm\b"), "magistrate").when(F.contains(t, F.lit("family")), "family").otherwise("district")


def loose_date(c: Column) -> Column:
    """The first ten characters in one of four formats."""
    head = F.substring(F.btrim(c), 1, 10)
    return F.coalesce(*(F.try_to_timestamp(head, F.lit(f)).cast("date") for f in ("yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy", "yyyy/MM/dd")))


def loose_bool(c: Column) -> Column:
    t = F.lower(F.btrim(c))
    return F.when(t.isin("true", "t", "1", "yes", "y"), True).when(t.isin("false", "f", "0", "no", "n"), False)


def loose_int(c: Column) -> Column:
    """Integers through doubles, so that "9.0" is 9."""
    return c.try_cast("double").try_cast("int")


# What a question's wording implies; the first that occurs counts, tags all do.
STATUTES = [("ndps", "NDPS"), ("pocso", "POCSO"), ("ipc", "IPC"), ("bns", "BNS"), ("crpc", "CrPC"), ("bnss", "BNSS")]
COURTS = [(("sessions court",), "sessions"), (("magistrate",), "magistrate"), (("trial court", "district court"), "district")]
SOURCES = [(("indian kanoon",), "indian_kanoon"), (("ecourts", "e-courts"), "ecourts"), (("hldc",), "hldc"), (("ddl",), "ddl")]
TAGS = [(("section 50",), "section_50_ndps"), (("search", "seizure"), "search_and_seizure"), (("chain of custody", "seal"), "chain_of_custody"), (("independent witness",), "independent_witness"), (("fsl", "forensic"), "forensic_evidence"), (("hostile witness",), "hostile_witness")]


def _any_of(c: Column, words: tuple[str, ...] | str) -> Column:
    out = F.lit(False)
    for w in (words,) if isinstance(words, str) else words:
        out = out | F.contains(c, F.lit(w))
    return out


def _first_of(c: Column, table: list) -> Column:
    return F.coalesce(*(F.when(_any_of(c, words), F.lit(name)) for words, name in table))


def inferred(question: Column) -> Column:
    """struct(statute, section, court_level, source_name, tags) that a question's wording implies."""
    q = F.lower(question)
    return F.struct(
        _first_of(q, STATUTES).alias("statute"),
        F.nullif(F.regexp_extract(q, r"section\s+([0-9]{1,4}[a-z]?)", 1), F.lit("")).alias("section"),
        _first_of(q, COURTS).alias("court_level"),
        _first_of(q, SOURCES).alias("source_name"),
        F.array_compact(F.array(*(F.when(_any_of(q, words), F.lit(tag)) for words, tag in TAGS))).alias("tags"),
    )


def sensitivity(categories: Column, flags: Column, restricted: list[str]) -> Column:
    return F.when(F.arrays_overlap(categories, F.array(*(F.lit(c) for c in restricted))) | (F.size(flags) > 0), "RESTRICTED").otherwise("INTERNAL")


# Case status by outcome of an attempt; pairs of source and outcome come first.
BY_SOURCE = {("ecourts", "hit"): "ecourts_hit", ("indian_kanoon", "hit"): "ik_hit", ("indian_kanoon", "miss"): "ik_miss", ("ecourts", "rate_limited"): "ecourts_pending"}
BY_OUTCOME = {"hit": "text_ready", "rate_limited": "ik_pending", "captcha_required": "ecourts_pending", "blocked_by_policy": "blocked", "captcha_failed": "blocked", "http_error": "dead", "ocr_failed": "dead"}


def case_status(source: Column, outcome: Column) -> Column:
    both = F.create_map(*(F.lit(x) for (s, o), status in BY_SOURCE.items() for x in (f"{s} {o}", status)))
    one = F.create_map(*(F.lit(x) for pair in BY_OUTCOME.items() for x in pair))
    return F.coalesce(both[F.concat_ws(" ", source, outcome)], one[outcome], F.lit("targeted"))


def candidate(body: Column, number: Column, least: float = 0.90) -> Column:
    """struct(confidence, accepted): 0.98 where the case number stands in the body, else 0.50."""
    sure = F.when(F.contains(F.upper(body), F.upper(number)), 0.98).otherwise(0.50)
    return F.struct(sure.alias("confidence"), (sure >= least).alias("accepted"))
