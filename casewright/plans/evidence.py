"""Graph retrieval, entity names and types, fusion, traces, and the remaining sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.operators import entities, search
from casewright.registry import query, table
from casewright.sources import readers

@query("SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN 'LandUseZone' WHEN p_size % 4 = 1 THEN 'Person' WHEN p_size % 4 = 2 AND contains(p_name, 'widget') THEN 'Device' ELSE 'Concept' END AS type FROM part")
def gr_type_map(spark, d):
    """Extracted types by the ontology: as they are, by letters and digits alone, by the longest keyword, or the fallback."""
    n = F.col("p_size") % 4
    given = F.when(n == 0, "land use zone").when(n == 1, "Person").otherwise("thing")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), entities.mapped_type(F.when(n == 2, F.col("p_name")).otherwise(""), given, ["LandUseZone", "Person", "Device", "Concept"], {"Device": ["widget", "gadget"], "Person": ["idg"]}).alias("type"))


@query("SELECT p_partkey AS id, p_name AS name FROM part")
def gr_name(spark, d):
    """Sentences are shortened to a name; short names stay."""
    n = F.col("p_size") % 3
    given = F.when(n == 0, F.concat(F.lit(" "), "p_name")).when(n == 1, F.concat("p_name", F.lit("; it was found later at some place in the city."))).otherwise(F.concat("p_name", F.lit(".")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), entities.short_name(given).alias("name"))


@query("WITH h AS (SELECT l_orderkey AS doc, l_linenumber AS chunk, CASE WHEN l_linenumber = 1 AND l_orderkey % 3 = 0 THEN '12/2020' WHEN l_linenumber = 2 THEN '99/2019' END AS signal FROM lineitem), m AS (SELECT doc, chunk FROM h WHERE signal = '12/2020') SELECT doc, chunk, 'MATCH' AS status FROM m UNION ALL SELECT doc, chunk, 'UNKNOWN' FROM h WHERE signal IS NULL AND doc IN (SELECT doc FROM m)")
def fus_scope_filter(spark, d):
    """Hits of the asked case, then those of the same documents that name no case; others' hits go."""
    n = F.col("l_linenumber")
    h = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), n.alias("chunk"), F.when((n == 1) & (F.col("l_orderkey") % 3 == 0), "FIR 12 of 2020").when(n == 2, "99/2019").alias("signal"))
    return search.scoped(h, "12/2020")


@query("SELECT c_custkey AS id, '{\"city\":[\"' || c_mktsegment || '\",\"x\"],\"state\":\"' || (c_custkey % 3) || '\"}' AS key FROM customer")
def vec_cache_norm(spark, d):
    """Filters in one canonical JSON: trimmed, without empty values, keys and lists sorted."""
    asked = F.create_map(F.lit("state"), F.array((F.col("c_custkey") % 3).cast("string")), F.lit("city"), F.array(F.lit(" x"), F.col("c_mktsegment"), F.lit("")), F.lit("none"), F.array(F.lit(" ")))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), search.canonical(asked, ["state"]).alias("key"))


@query("SELECT p_partkey AS id, p_name AS text FROM part")
def txt_nfc(spark, d):
    """Decomposed accents come to their composed form."""
    split = F.replace("p_name", F.lit("e"), F.lit("e\u0301"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.translate(entities.composed(split), "\u00e9", "e").alias("text"))


@query("SELECT p_partkey AS id, p_name AS title, p_brand AS act, make_date(2018, 1 + p_size % 12, 5) AS filed FROM part")
def src_html_case(spark, d):
    """Label and value fields of a portal's case page."""
    day = F.date_format(F.make_date(F.lit(2018), 1 + F.col("p_size") % 12, F.lit(5)), "dd-MM-yyyy")
    page = F.concat(F.lit("<table><tr><td>Title</td><td> "), "p_name", F.lit("</td></tr><tr><th>Act :</th><td><b>"), "p_brand", F.lit("</b></td></tr><tr><td>Filing Date</td><td>"), day, F.lit("</td></tr></table>"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), readers.case_fields(page).alias("f")).select("id", F.col("f")["title"].alias("title"), F.col("f")["act"].alias("act"), F.to_date(F.col("f")["filing date"], "dd-MM-yyyy").alias("filed"))


@query("SELECT n_nationkey::VARCHAR AS id, n_name AS text FROM nation WHERE n_nationkey % 5 > 0")
def src_hldc(spark, d):
    """JSON records normalised; those without an id are set apart."""
    n = F.col("n_nationkey")
    rows = table(spark, d, "nation").select(F.to_json(F.struct(F.when(n % 5 > 0, n.cast("string")).otherwise("").alias("case_id"), F.col("n_name").alias("body"))).alias("value"))
    good, _ = readers.json_records(spark, readers.text_file(rows))
    return good.select("id", "text")


@query("SELECT n_name || '/x' AS key, n_nationkey AS size FROM nation")
def src_xml(spark, d):
    """Keys and sizes of storage listings."""
    xml = F.concat(F.lit("<L><Contents><Key>"), "n_name", F.lit("/x</Key><Size>"), F.col("n_nationkey").cast("string"), F.lit("</Size></Contents></L>"))
    return readers.xml_listing(table(spark, d, "nation").select(xml.alias("xml")))
