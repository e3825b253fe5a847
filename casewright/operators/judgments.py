"""Search filters over judgments: one predicate for each field that is asked.

A judgment row has columns of its own and two JSON strings, ``legal_metadata``
of the chunk and ``metadata`` of the document; many fields are the first
non-null of several JSON paths.  Filters on statutes and outcomes are semi-joins,
one a filter, so that different child rows may satisfy them.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.operators.filters import all_of

TRUE, FALSE = ("true", "t", "1", "yes", "y"), ("false", "f", "0", "no", "n")


def chain(chunk: str | None, *document: str) -> Column:
    """First non-null of a path of the chunk's JSON and paths of the document's."""
    own = [F.get_json_object("legal_metadata", f"$.{chunk}")] if chunk else []
    return F.coalesce(*own, *(F.get_json_object("metadata", f"$.{p}") for p in document))


def _district(name: str) -> Column:
    return chain(name, f"district.{name}", name)


#: Where a field of a search is read from; all but the codes compare without case.
FIELDS = {
    "state_code": lambda: _district("state_code"),
    "state": lambda: chain("state", "district.state_name", "district.state", "state"),
    "district_code": lambda: _district("district_code"),
    "district": lambda: chain("district", "district.district_name", "district.district", "district_name"),
    "disposition": lambda: _district("disposition"),
    "source_name": lambda: _district("source_name"),
    "license_classification": lambda: _district("license_classification"),
    "court_level": lambda: F.coalesce("court_level", _district("court_level")),
    "redaction_status": lambda: F.coalesce("redaction_status", chain("redaction_status", "redaction.redaction_status", "redaction_status"), F.lit("not_required")),
    "language": lambda: F.coalesce(F.get_json_object("legal_metadata", "$.source_language"), F.col("language")),
    "target_language": lambda: F.get_json_object("legal_metadata", "$.target_language"),
    "translation_status": lambda: F.get_json_object("legal_metadata", "$.translation_status"),
    "court": lambda: F.coalesce("court_code", "court_name"),
    "legal_regime": lambda: F.col("applicable_legal_regime"),
}
EXACT = {"state_code", "district_code"}


def values(asked: object) -> list[str]:
    """Texts of a value or a list of them, blanks dropped."""
    many = asked if isinstance(asked, (list, tuple, set)) else [asked]
    return [str(v).strip() for v in many if v not in (None, "", False) and str(v).strip()]


def member(field: str, asked: object) -> Column | None:
    found = values(asked)
    if not found:
        return None
    value = F.coalesce(FIELDS[field](), F.lit(""))
    return value.isin(found) if field in EXACT else F.lower(value).isin([v.lower() for v in found])


def any_element(column: str, asked: object) -> Column | None:
    found = [v.lower() for v in values(asked)]
    return F.exists(column, lambda x: F.lower(x).isin(found)) if found else None


def cites(text: str | None) -> Column | None:
    """The neutral citation or any reporter's, case aside; wildcards keep their meaning."""
    return F.col("neutral_citation").ilike(f"%{text}%") | F.exists("reporter_citations", lambda x: x.ilike(f"%{text}%")) if text else None


def under(path: str | None) -> Column | None:
    """Source paths by prefix, the first of three that is known."""
    return F.startswith(F.coalesce("source_path", "document_path", "file_path"), F.lit(path)) if path else None


def commercial(asked: bool | str | None, enforced: bool = False) -> Column | None:
    """Rows of the asked commercial safety; unknown ones are safe; nothing asked filters only where it is enforced."""
    word = str(asked).strip().lower() if asked is not None else ""
    want = True if word in TRUE else False if word in FALSE else None
    if want is None and not enforced:
        return None
    return F.lower(F.coalesce(_district("commercial_safe"), F.lit("true"))).isin(list(TRUE if want in (True, None) else FALSE))


def years(asked: object) -> Column | None:
    found = sorted({int(v) for v in values(asked) if v.lstrip("-").isdigit()})
    return F.col("judgment_year").isin(found) if found else None


def predicate(asked: Mapping[str, object], enforced: bool = False) -> Column:
    """All filters on the row itself."""
    day = lambda v: F.lit(v).cast("date")
    parts = [member(f, asked.get(f)) for f in FIELDS]
    parts += [any_element("offence_categories", asked.get("offence_category")), any_element("judges", asked.get("judge"))]
    parts += [cites(asked.get("citation")), under(asked.get("source_path")), years(asked.get("year")), commercial(asked.get("commercial_safe"), enforced)]
    parts += [F.col("judgment_id").isin(values(asked["judgment_id"])) if values(asked.get("judgment_id")) else None, F.col("cnr") == asked["cnr"] if asked.get("cnr") else None]
    parts += [F.col("decision_date") >= day(asked["date_from"]) if asked.get("date_from") else None, F.col("decision_date") <= day(asked["date_to"]) if asked.get("date_to") else None]
    return all_of(*parts)


def with_child(rows: DataFrame, children: DataFrame, column: str, asked: Iterable[str] | str | None) -> DataFrame:
    """Rows with a child (document_id) whose column is among the asked values."""
    found = [v.lower() for v in values(asked)]
    if not found:
        return rows
    hit = children.where(F.lower(F.coalesce(column, F.lit(""))).isin(found)).select("document_id")
    return rows.join(hit, "document_id", "left_semi")


def search(rows: DataFrame, sections: DataFrame, outcomes: DataFrame, asked: Mapping[str, object], enforced: bool = False) -> DataFrame:
    """All filters: those on the row reach its scan, those on children are semi-joins.

    sections (document_id, statute, section); outcomes (document_id, final_outcome, state_or_police_result).
    """
    out = rows.where(predicate(asked, enforced))
    for children, column, name in ((sections, "statute", "statute"), (sections, "section", "section"), (outcomes, "final_outcome", "outcome"), (outcomes, "state_or_police_result", "state_or_police_result")):
        out = with_child(out, children, column, asked.get(name))
    return out


def projection(rows: DataFrame) -> DataFrame:
    """The fields of a search hit: those of the judgment, seven that are read from JSON, and the chunk's anchors."""
    return rows.select(
        "judgment_id", "court_code", "court_name", "decision_date", "judgment_year", "neutral_citation", "reporter_citations", "cnr", "case_number", "appeal_posture", "applicable_legal_regime", "source_uri", "source_path", "source_bucket",
        F.col("ocr_confidence").alias("judgment_ocr_confidence"), "paragraph_anchor_confidence", F.col("metadata_confidence").alias("judgment_metadata_confidence"), "sensitive_data_flags", "redaction_status",
        *(FIELDS[f]().alias(n) for f, n in (("state_code", "district_state_code"), ("state", "district_state_name"), ("district_code", "district_code"), ("district", "district_name"), ("source_name", "district_source_name"), ("license_classification", "district_license_classification"))),
        _district("commercial_safe").alias("district_commercial_safe"), "paragraph_number", "section_label", "anchor_confidence", F.col("legal_metadata").alias("chunk_legal_metadata"),
    )
