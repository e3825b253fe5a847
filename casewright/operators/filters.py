"""Optional predicates of dashboards and searches as Columns.

Every builder returns None where its input is absent, and :func:`all_of` joins
what is left, so that filters reach the scan as one conjunction.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sensitivity levels in rising order (fixed values).
LEVELS = ["PUBLIC", "INTERNAL", "RESTRICTED", "CONFIDENTIAL", "SECRET"]
TRUE_WORDS = ["true", "t", "1", "yes", "y"]
SEARCHABLE = ["SEARCHABLE", "KG_EXTRACTING", "ACTIVE"]


def all_of(*parts: Column | None) -> Column:
    return reduce(lambda a, b: a & b, (p for p in parts if p is not None), F.lit(True))


def in_lower(column: str, values: Iterable[str] | None) -> Column | None:
    """Case-insensitive membership; null counts as the empty string."""
    values = [v.strip().lower() for v in values or [] if v.strip()]
    return F.lower(F.coalesce(F.col(column), F.lit(""))).isin(values) if values else None


def in_int(column: str, values: Iterable[str | int] | None) -> Column | None:
    """Integer membership; tokens that aren't integers drop out."""
    found = [int(v) for v in values or [] if str(v).strip().lstrip("-").isdigit()]
    return F.col(column).isin(found) if found else None


def array_any(column: str, values: Iterable[str] | None) -> Column | None:
    values = [v.strip().lower() for v in values or [] if v.strip()]
    return F.exists(column, lambda x: F.lower(x).isin(values)) if values else None


def pair_or(first: str, second: str, pairs: Iterable[str] | None) -> Column | None:
    """``"9:101"`` pairs joined by OR."""
    split = [p.split(":", 1) for p in pairs or [] if p.count(":") == 1]
    known = [(int(a), int(b)) for a, b in split if a.strip().isdigit() and b.strip().isdigit()]
    return reduce(lambda x, y: x | y, ((F.col(first) == a) & (F.col(second) == b) for a, b in known)) if known else None


def date_range(column: str, start: str | None, end: str | None) -> Column | None:
    """Both ends included."""
    parts = [F.col(column) >= F.lit(start).cast("date") if start else None, F.col(column) <= F.lit(end).cast("date") if end else None]
    return all_of(*parts) if any(p is not None for p in parts) else None


def before_next_day(column: str, start: str | None, end: str | None) -> Column | None:
    """The end's whole day counts, whatever the time in it."""
    parts = [F.col(column) >= F.lit(start).cast("timestamp") if start else None, F.col(column) < F.date_add(F.lit(end).cast("date"), 1) if end else None]
    return all_of(*parts) if any(p is not None for p in parts) else None


def recent(column: str, as_of: dt.datetime | Column, days: int) -> Column:
    """Later than ``as_of`` less 1 to 90 days."""
    n = max(1, min(90, int(days)))
    return F.col(column) > (as_of if isinstance(as_of, Column) else F.lit(as_of)) - F.expr(f"INTERVAL {n} DAYS")


def commercial_default(column: str, asked: str | None) -> Column | None:
    """Only commercially safe rows unless literally "false" is asked."""
    return None if asked is not None and asked.lower() == "false" else F.col(column)


def like_any(columns: list[str], text: str | None, exact: str | None = None) -> Column | None:
    """Substring in any column, case aside; wildcards in the text keep their meaning; or an exact id."""
    if not text or not text.strip():
        return None
    hit = [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).like(f"%{text.strip().lower()}%") for c in columns]
    if exact:
        hit.append(F.col(exact).cast("string") == text.strip())
    return reduce(lambda a, b: a | b, hit)


def json_first(paths: list[tuple[str, str]]) -> Column:
    """First value that is not empty among JSON paths of string columns."""
    return F.coalesce(*(F.nullif(F.get_json_object(c, p), F.lit("")) for c, p in paths))


def truthy(c: Column, default: str = "true") -> Column:
    return F.lower(F.coalesce(F.nullif(c, F.lit("")), F.lit(default))).isin(TRUE_WORDS)


def equal_columns(df: DataFrame, asked: dict[str, object]) -> Column:
    """Equality on named columns; unknown names are refused."""
    unknown = set(asked) - set(df.columns)
    if unknown:
        raise ValueError(f"no such column: {sorted(unknown)}")
    return all_of(*(F.col(k) == F.lit(v) for k, v in asked.items() if v not in (None, "")))


def rank_of(level: Column) -> Column:
    """Position among LEVELS, 1 for unknown levels."""
    return F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(x) for x in LEVELS)), F.upper(level)) - 1, F.lit(-1)), F.lit(1))


def accessible(docs: DataFrame, grants: DataFrame, user: int, clearance: str, as_of: Column) -> DataFrame:
    """Documents up to a user's clearance, or granted by id or by level and not expired.

    docs: doc_id, level, status; grants: user_id, g_doc_id, g_level, expires_at.
    """
    own = grants.where((F.col("user_id") == user) & (F.col("expires_at").isNull() | (F.col("expires_at") > as_of)))
    by_rank = docs.where(rank_of(F.col("level")) <= rank_of(F.lit(clearance)))
    by_id = docs.join(own.where("g_doc_id is not null"), docs["doc_id"] == own["g_doc_id"], "left_semi")
    by_level = docs.join(own.where("g_level is not null"), docs["level"] == own["g_level"], "left_semi")
    return by_rank.union(by_id).union(by_level).where("status <> 'DELETED'").distinct()


def read_only_sql(text: str) -> bool:
    """One SELECT or WITH statement without words that write."""
    import re

    body = text.strip().rstrip(";").strip()
    if not re.match(r"(?is)^(select|with)\b", body) or ";" in body:
        return False
    return not re.search(r"(?is)\b(insert|update|delete|drop|alter|create|truncate|grant|revoke|merge|copy|call|do|execute)\b|\bselect\b.*\binto\b", body)


def read_only(sql: Column) -> Column:
    """:func:`read_only_sql` for a column of statements."""
    body = F.btrim(F.regexp_replace(F.btrim(sql), r"[;\s]+$", ""))
    writes = body.rlike(r"(?is)\b(insert|update|delete|drop|alter|create|truncate|grant|revoke|merge|copy|call|do|execute)\b|\bselect\b.*\binto\b")
    return body.rlike(r"(?is)^(select|with)\b") & ~F.contains(body, F.lit(";")) & ~writes


def unit_or_children(rows: DataFrame, column: str, tree: DataFrame, unit: int) -> DataFrame:
    """Rows of a unit or of its direct children. tree: (unit, parent)."""
    units = tree.where(F.col("parent") == unit).select(F.col("unit").alias("__unit")).union(tree.sparkSession.range(unit, unit + 1).select("id")).distinct()
    return rows.join(units, rows[column] == units["__unit"], "left_semi")


def wiki(asked: dict[str, object]) -> Column:
    """Articles of a status, ``approved`` if none is asked, whose court level is the asked one or none."""
    status = F.col("status").isin(asked["statuses"]) if asked.get("statuses") else F.col("status") == "approved"
    level = F.lower(F.coalesce(F.col("court_level"), F.lit("")))
    return all_of(status, level.isin("", str(asked["court_level"]).lower()) if asked.get("court_level") else None)


def review(asked: dict[str, object]) -> Column:
    """Review rows by equal columns and a least priority."""
    same = [F.col(k) == F.lit(v) for k, v in asked.items() if k != "min_priority" and v not in (None, "")]
    return all_of(*same, F.col("priority") >= asked["min_priority"] if asked.get("min_priority") is not None else None)


def feedback(asked: dict[str, object], user: int, admin: bool) -> Column:
    """Feedback rows; others' rows only for administrators."""
    kinds = [F.col(k) == F.lit(asked[k]) for k in ("feedback_type", "level") if asked.get(k)]
    done = F.col("resolved") == (str(asked["resolved"]).lower() == "true") if asked.get("resolved") is not None else None
    return all_of(None if admin else F.col("user_id") == user, *kinds, done)


def audit(asked: dict[str, object]) -> Column:
    """Audit rows by action, user, entity and both ends of a time span."""
    same = [F.col(k) == F.lit(asked[k]) for k in ("action", "user_id", "entity_type", "entity_id") if asked.get(k) not in (None, "")]
    span = [F.col("created_at") >= F.lit(asked["from"]).cast("timestamp") if asked.get("from") else None, F.col("created_at") <= F.lit(asked["to"]).cast("timestamp") if asked.get("to") else None]
    return all_of(*same, *span)


def echo(asked: Column, integers: list[str]) -> Column:
    """Filters (map of lists of texts) as understood: lower case, sorted, each value once; blanks and non-integers drop out, empty filters too; commercial safety always shows."""
    plain = F.map_filter(asked, lambda k, v: k != "commercial_safe")

    def clean(k: Column, v: Column) -> Column:
        words = F.transform(F.filter(v, lambda x: x.isNotNull()), lambda x: F.lower(F.btrim(x)))
        kept = F.filter(words, lambda w: (w != "") & (~k.isin(integers) | w.rlike("^-?[0-9]+$")))
        return F.array_sort(F.array_distinct(kept))

    understood = F.map_filter(F.transform_values(plain, clean), lambda k, v: F.size(v) > 0)
    said = F.lower(F.element_at(F.coalesce(F.try_element_at(asked, F.lit("commercial_safe")), F.array(F.lit("true"))), 1))
    return F.map_concat(understood, F.create_map(F.lit("commercial_safe"), F.array(F.when(said == "false", "false").otherwise("true"))))
