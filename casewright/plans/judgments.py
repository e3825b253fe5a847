"""Judgment search over orders, customers and places.

An order is a judgment: its priority the court, its status the disposition, its
line items the statute sections (return flag, line number) and outcomes (line
status).  Every third order has JSON of its chunk, every second one of its
document, so that the chains of paths meet all cases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.operators import judgments
from casewright.registry import query, table

JUDGMENTS_SQL = """j AS (SELECT o_orderkey AS document_id, 'J' || o_orderkey AS judgment_id, o_orderpriority AS court_code, r_name || ' court' AS court_name, o_orderdate::DATE AS decision_date, year(o_orderdate)::INT AS judgment_year,
  year(o_orderdate) || ' INSC ' || (o_orderkey % 97) AS neutral_citation, [n_name || ' ' || (o_orderkey % 11), 'SCC ' || (o_orderkey % 7)] AS reporter_citations, 'CN' || lpad(o_orderkey::VARCHAR, 8, '0') AS cnr,
  [c_mktsegment, o_orderstatus] AS offence_categories, [n_name, c_name] AS judges, CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END AS court_level, CASE WHEN o_orderkey % 4 = 0 THEN 'redacted' END AS redaction_status,
  CASE WHEN o_orderkey % 2 = 0 THEN 'data/' || r_name || '/' || o_orderkey END AS source_path, 'data/' || n_name AS document_path, CASE WHEN o_orderkey % 7 = 0 THEN 'BNS' ELSE 'IPC' END AS applicable_legal_regime, 'en' AS language,
  CASE WHEN o_orderkey % 3 = 0 THEN '{"state_code":"' || r_regionkey || '","district":"' || n_name || '","source_language":"hi","translation_status":"pending","disposition":"' || o_orderstatus || '"}' END AS legal_metadata,
  CASE WHEN o_orderkey % 2 = 0 THEN '{"district":{"state_code":"' || r_regionkey || '","state_name":"' || r_name || '","district_name":"' || n_name || '","commercial_safe":"' || CASE WHEN o_orderkey % 6 = 0 THEN 'No' ELSE 'Yes' END || '","source_name":"ecourts"},"license_classification":"open"}' END AS metadata
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
PATH = "coalesce(json_extract_string(legal_metadata, '$.{0}'), json_extract_string(metadata, '$.district.{0}'), json_extract_string(metadata, '$.{0}'))"
STATE = "coalesce(json_extract_string(legal_metadata, '$.state'), json_extract_string(metadata, '$.district.state_name'), json_extract_string(metadata, '$.district.state'), json_extract_string(metadata, '$.state'))"
DISTRICT = "coalesce(json_extract_string(legal_metadata, '$.district'), json_extract_string(metadata, '$.district.district_name'), json_extract_string(metadata, '$.district_name'))"
PREFIX = "starts_with(coalesce(source_path, document_path), 'data/A')"
CITED = "(neutral_citation ILIKE '%insc 1%' OR len(list_filter(reporter_citations, lambda x: x ILIKE '%insc 1%')) > 0)"
ASKED = {"court": ["1-urgent", " 2-HIGH "], "date_from": "1995-03-01", "date_to": "1999-06-30", "year": [1996, "1997", "1998", "x"], "statute": "r", "section": ["1", "2"], "offence_category": ["building", "f", "o"], "outcome": ["F"], "source_path": "data/", "state": ["asia", "Europe", "africa"], "redaction_status": "not_required", "commercial_safe": "yes", "language": ["en", "hi"]}


def judged(spark: SparkSession, d: str) -> DataFrame:
    nation, region = table(spark, d, "nation"), table(spark, d, "region")  # 25 and 5 rows by definition
    places = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    who = table(spark, d, "customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
    key, text = F.col("o_orderkey"), lambda s: F.lit(s)
    rows = table(spark, d, "orders").join(who, F.col("o_custkey") == F.col("c_custkey"))
    own = F.concat(text('{"state_code":"'), "r_regionkey", text('","district":"'), "n_name", text('","source_language":"hi","translation_status":"pending","disposition":"'), "o_orderstatus", text('"}'))
    doc = F.concat(text('{"district":{"state_code":"'), "r_regionkey", text('","state_name":"'), "r_name", text('","district_name":"'), "n_name", text('","commercial_safe":"'), F.when(key % 6 == 0, "No").otherwise("Yes"), text('","source_name":"ecourts"},"license_classification":"open"}'))
    none = F.lit(None).cast("string")
    return rows.select(
        key.alias("document_id"), F.concat(text("J"), key).alias("judgment_id"), F.col("o_orderpriority").alias("court_code"), F.concat("r_name", text(" court")).alias("court_name"), F.col("o_orderdate").cast("date").alias("decision_date"), F.year("o_orderdate").alias("judgment_year"),
        F.concat(F.year("o_orderdate"), text(" INSC "), key % 97).alias("neutral_citation"), F.array(F.concat("n_name", text(" "), key % 11), F.concat(text("SCC "), key % 7)).alias("reporter_citations"), F.concat(text("CN"), F.lpad(key.cast("string"), 8, "0")).alias("cnr"),
        F.array("c_mktsegment", "o_orderstatus").alias("offence_categories"), F.array("n_name", "c_name").alias("judges"), F.when(key % 5 > 0, F.col("o_orderpriority")).alias("court_level"), F.when(key % 4 == 0, "redacted").alias("redaction_status"),
        F.when(key % 2 == 0, F.concat(text("data/"), "r_name", text("/"), key)).alias("source_path"), F.concat(text("data/"), "n_name").alias("document_path"), none.alias("file_path"), F.when(key % 7 == 0, "BNS").otherwise("IPC").alias("applicable_legal_regime"), text("en").alias("language"),
        F.when(key % 3 == 0, own).alias("legal_metadata"), F.when(key % 2 == 0, doc).alias("metadata"),
        *(none.alias(c) for c in ("case_number", "appeal_posture", "source_uri", "source_bucket", "paragraph_number", "section_label")), *(F.lit(None).cast("double").alias(c) for c in ("ocr_confidence", "paragraph_anchor_confidence", "metadata_confidence", "anchor_confidence")), F.array().cast("array<string>").alias("sensitive_data_flags"),
    )


def _children(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, d, "lineitem")
    sections = lines.select(F.col("l_orderkey").alias("document_id"), F.col("l_returnflag").alias("statute"), F.col("l_linenumber").cast("string").alias("section"))
    return sections, lines.select(F.col("l_orderkey").alias("document_id"), F.col("l_linestatus").alias("final_outcome"), F.col("l_returnflag").alias("state_or_police_result"))


@query(f"""WITH {JUDGMENTS_SQL} SELECT document_id, judgment_id FROM j WHERE lower(court_code) IN ('1-urgent', '2-high') AND decision_date BETWEEN DATE '1995-03-01' AND DATE '1999-06-30' AND judgment_year IN (1996, 1997, 1998)
  AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = document_id AND lower(l_returnflag) = 'r') AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = document_id AND l_linenumber IN (1, 2)) AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = document_id AND lower(l_linestatus) = 'f')
  AND (lower(offence_categories[1]) IN ('building', 'f', 'o') OR lower(offence_categories[2]) IN ('building', 'f', 'o')) AND starts_with(coalesce(source_path, document_path), 'data/') AND lower(coalesce({STATE}, '')) IN ('asia', 'europe', 'africa') AND coalesce(redaction_status, 'not_required') = 'not_required'
  AND lower(coalesce({PATH.format('commercial_safe')}, 'true')) IN ('true', 't', '1', 'yes', 'y') AND coalesce(json_extract_string(legal_metadata, '$.source_language'), language) IN ('en', 'hi')""")
def flt_judgment(spark, d):
    """Thirteen filters of a search together."""
    return judgments.search(judged(spark, d), *_children(spark, d), ASKED).select("document_id", "judgment_id")


@query("WITH s AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R'), t AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linenumber = 3), o AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linestatus = 'O') SELECT o_orderkey AS document_id FROM orders WHERE o_orderkey IN (FROM s) AND o_orderkey IN (FROM t) AND o_orderkey IN (FROM o)")
def flt_j_exists(spark, d):
    """Statute and section may lie in different rows of a judgment."""
    return judgments.search(judged(spark, d), *_children(spark, d), {"statute": ["r"], "section": "3", "outcome": "o"}).select("document_id")


@query(f"WITH {JUDGMENTS_SQL} SELECT document_id, neutral_citation FROM j WHERE {CITED}")
def flt_j_citation(spark, d):
    return judged(spark, d).where(judgments.cites("insc 1")).select("document_id", "neutral_citation")


@query(f"WITH {JUDGMENTS_SQL} SELECT document_id, coalesce(source_path, document_path) AS path FROM j WHERE {PREFIX}")
def flt_j_prefix(spark, d):
    return judged(spark, d).where(judgments.under("data/A")).select("document_id", F.coalesce("source_path", "document_path").alias("path"))


@query(f"WITH {JUDGMENTS_SQL} SELECT document_id, {PATH.format('state_code')} AS state_code, {STATE} AS state, {DISTRICT} AS district, {PATH.format('source_name')} AS source FROM j WHERE coalesce({PATH.format('state_code')}, '') IN ('1', '3') AND lower(coalesce({DISTRICT}, '')) IN ('china', 'peru', 'canada', 'nation_3', 'nation_8')")
def flt_j_json_coalesce(spark, d):
    """State and district through the chunk's JSON, then the document's."""
    where = {"state_code": ["1", 3], "district": ["CHINA", "Peru", "canada", "nation_3", "NATION_8"]}
    f = judgments.FIELDS
    return judged(spark, d).where(judgments.predicate(where)).select("document_id", *(f[k]().alias(n) for k, n in (("state_code", "state_code"), ("state", "state"), ("district", "district"), ("source_name", "source"))))


@query(f"WITH {JUDGMENTS_SQL} SELECT document_id FROM j WHERE lower(coalesce({PATH.format('commercial_safe')}, 'true')) IN ('false', 'f', '0', 'no', 'n')")
def flt_j_commercial(spark, d):
    return judged(spark, d).where(judgments.commercial("No")).select("document_id")


@query(f"WITH {JUDGMENTS_SQL} SELECT judgment_id, court_code, court_name, decision_date, judgment_year, neutral_citation, reporter_citations, cnr, NULL AS case_number, NULL AS appeal_posture, applicable_legal_regime, NULL AS source_uri, source_path, NULL AS source_bucket, NULL AS judgment_ocr_confidence, NULL AS paragraph_anchor_confidence, NULL AS judgment_metadata_confidence, [] AS sensitive_data_flags, redaction_status, {PATH.format('state_code')} AS district_state_code, {STATE} AS district_state_name, {PATH.format('district_code')} AS district_code, {DISTRICT} AS district_name, {PATH.format('source_name')} AS district_source_name, {PATH.format('license_classification')} AS district_license_classification, {PATH.format('commercial_safe')} AS district_commercial_safe, NULL AS paragraph_number, NULL AS section_label, NULL AS anchor_confidence, legal_metadata AS chunk_legal_metadata FROM j")
def prj_judgment(spark, d):
    """The thirty fields of a hit."""
    return judgments.projection(judged(spark, d))
