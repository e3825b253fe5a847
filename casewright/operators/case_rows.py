"""Raw metadata rows as canonical cases, and metadata of chunks and judgments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.functions import classify
from casewright.functions.text import bound

# States by their code, and texts that stand for nothing.
STATES = {1: "Maharashtra", 3: "Karnataka", 9: "Uttar Pradesh", 10: "Tamil Nadu", 26: "Delhi"}
NOTHING = ["none", "nan", "null"]


def first_text(row: Column, *keys: str) -> Column:
    """The first of these entries that says something, trimmed."""

    def said(k: str) -> Column:
        return bound(F.regexp_replace(F.try_element_at(row, F.lit(k)), r"^\s+|\s+$", ""), lambda t: F.when((t != "") & ~F.lower(t).isin(NOTHING), t))

    return F.coalesce(*map(said, keys))


def court_code(*parts: Column) -> Column:
    known = F.array_compact(F.array(*(p.cast("string") for p in parts)))
    return F.when(F.size(known) > 0, F.concat(F.lit("DC-"), F.array_join(known, "-")))


def canonical(row: Column, rules: list[dict], flags: dict[str, list[str]], version: str = "unknown") -> Column:
    """A struct of case fields from a raw row (map of texts).

    ``rules`` name offence categories as in :func:`classify.offences`; ``flags``
    names the sensitive flags of categories.
    """
    names = F.create_map(*(F.lit(x) for pair in STATES.items() for x in pair))
    of = F.create_map(*(x for k, v in flags.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))

    def parts(row: Column) -> Column:
        """What several fields are made of."""
        raw = lambda *keys: F.coalesce(*(F.nullif(F.try_element_at(row, F.lit(k)), F.lit("")) for k in keys))
        listed = lambda *keys: F.coalesce(raw(*keys), F.lit(""))
        state, district, court = (classify.loose_int(x) for x in (raw("state_code"), raw("district_code", "dist_code"), raw("court_no")))
        return F.struct(state.alias("state"), district.alias("district"), court.alias("court"), listed("act", "acts_cited").alias("act"), classify.sections(listed("section", "sections_cited")).alias("sections"), F.concat_ws(" ", F.map_values(row)).alias("said"), first_text(row, "case_type", "type_name_s", "type_name").alias("kind"), first_text(row, "judge_position").alias("position"))

    def fields(row: Column, p: Column, found: Column) -> Column:
        t = lambda *keys: first_text(row, *keys)
        raw = lambda *keys: F.coalesce(*(F.nullif(F.try_element_at(row, F.lit(k)), F.lit("")) for k in keys))
        state, district, court = p["state"], p["district"], p["court"]
        categories = F.array_distinct(F.concat(found, classify.tokens(F.coalesce(raw("offence_category_override"), F.lit("")))))
        sensitive = F.array_distinct(F.flatten(F.transform(found, lambda c: F.coalesce(F.try_element_at(of, c), F.array().cast("array<string>")))))
        stable = F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(row)))), 256)
        return F.struct(
            F.coalesce(t("ddl_case_id", "case_id", "cino", "cnr"), stable).alias("source_case_id"), t("cino", "cnr").alias("cnr"), F.lit(version).alias("dataset_version"), state.alias("state_code"), F.coalesce(t("state_name"), F.try_element_at(names, state)).alias("state_name"),
            district.alias("district_code"), t("district_name").alias("district_name"), court.alias("court_no"), court_code(state, district, court).alias("court_code"), t("court_name").alias("court_name"), classify.court_level(p["position"], p["kind"]).alias("court_level"), p["kind"].alias("case_type"),
            classify.loose_date(raw("filing_date", "date_of_filing")).alias("filing_date"), classify.loose_date(raw("registration_date")).alias("registration_date"), classify.loose_date(raw("decision_date", "date_of_decision")).alias("decision_date"), t("disp_name_s", "disp_name", "disposition").alias("disposition"),
            t("purpose_name_s", "purpose_name").alias("purpose_name"), p["position"].alias("judge_position"), classify.loose_bool(raw("bailable")).alias("bailable"), classify.loose_bool(raw("under_trial")).alias("under_trial"), classify.tokens(p["act"]).alias("acts_cited"), p["sections"].alias("sections_cited"),
            categories.alias("offence_categories"), ((F.size(found) > 0) | F.coalesce(classify.loose_bool(raw("force_criminal_target")), F.lit(False))).alias("is_target"), F.lit(True).alias("commercial_safe"), F.lit("commercial_safe").alias("license"), sensitive.alias("sensitive_flags"),
        )

    hits = lambda p: classify.offences(p["sections"], p["act"], p["said"], rules)
    return bound(row, lambda row: bound(parts(row), lambda p: bound(hits(p), lambda found: fields(row, p, found))))


# Metadata of a chunk; where each value is looked for, first to last.
CHUNK_KEYS = {
    "text_artifact_type": ["text_artifact_type"], "cnr": ["district.cnr", "cnr"], "state_code": ["district.state_code", "state_code"], "state": ["district.state", "state"], "district_code": ["district.district_code", "district_code"], "district": ["district.district", "district_name"],
    "court_level": ["district.court_level", "court_level"], "court_name": ["district.court_name", "court_name"], "statutes": ["district.statutes", "statutes"], "sections": ["district.sections", "sections"], "disposition": ["district.disposition", "disposition"], "source_name": ["district.source_name", "source_name"],
    "license_classification": ["district.license_classification", "license_classification"], "commercial_safe": ["district.commercial_safe", "commercial_safe"], "source_language": ["translation.source_language", "source_language"], "target_language": ["translation.target_language"],
    "translation_status": ["translation.qa_status", "translation.translation_status"], "translation_provider": ["translation.provider"], "translation_confidence": ["translation.translation_confidence"], "glossary_version": ["translation.glossary_version"], "redaction_status": ["redaction.redaction_status", "redaction_status"],
}
#: Values that say nothing, so that the next place is asked; of commercial_safe only what is absent.
EMPTY = ["", "0", "false", "[]", "{}", "null"]


def chunk_metadata(document: Column, extraction: Column) -> Column:
    """map<string, string> of up to 21 entries from JSON metadata of a document and of its extraction; absent ones drop out.

    A translation is the extraction's, else the document's.
    """

    def entries(document: Column, extraction: Column, from_extraction: Column) -> Column:
        def at(path: str) -> Column:
            if path.startswith("translation."):
                return F.when(from_extraction, F.get_json_object(extraction, f"$.{path}")).otherwise(F.get_json_object(document, f"$.{path}"))
            return F.get_json_object(document, f"$.{path}")

        def value(key: str, paths: list[str]) -> Column:
            told = [at(p) for p in paths]
            if key == "commercial_safe":
                return F.coalesce(*told)
            return F.coalesce(*(bound(t, lambda t: F.when(~t.isin(EMPTY), t)) for t in told[:-1]), told[-1])

        pairs = F.array(*(F.struct(F.lit(k).alias("key"), value(k, paths).alias("value")) for k, paths in CHUNK_KEYS.items()))
        return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))

    translated = lambda x: bound(F.get_json_object(x, "$.translation"), lambda own: own.isNotNull() & ~own.isin(EMPTY))
    return bound(document, lambda d: bound(extraction, lambda x: bound(translated(x), lambda found: entries(d, x, found))))


def judgment_id(row: Column) -> Column:
    """The id of a judgment (map of texts): its own, neutral citation, CNR, or court, case number and date."""
    made = F.array_compact(F.array(*(first_text(row, k) for k in ("court", "case_number", "decision_date"))))
    return F.coalesce(first_text(row, "judgment_id"), first_text(row, "neutral_citation"), first_text(row, "cnr"), F.when(F.size(made) > 1, F.array_join(made, ":")))


def merged_payload(old: Column, new: Column) -> Column:
    """A judgment's payload (maps of texts) after another extraction: new entries that say something win, all others stay."""
    said = F.map_filter(new, lambda k, v: F.coalesce(F.btrim(v), F.lit("")) != "")
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.coalesce(F.map_contains_key(said, k), F.lit(False))), said)


def code_maps(tables: dict[str, tuple[DataFrame, list[str], str]]) -> DataFrame:
    """(map, key, value): code tables as one table of composite keys; keys are trimmed, "9.0" is "9", empty values drop out.

    tables: name to (rows, key columns, value column).  The first value by text of a key counts.
    """
    out = None
    for name, (rows, keys, value) in tables.items():
        key = F.concat_ws("|", *(F.regexp_replace(F.btrim(F.col(k).cast("string")), r"\.0+$", "") for k in keys))
        part = rows.select(F.lit(name).alias("map"), key.alias("key"), F.btrim(F.col(value).cast("string")).alias("value")).where("value <> ''")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("map", "key").agg(F.min("value").alias("value"))
