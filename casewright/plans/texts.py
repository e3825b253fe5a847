"""Text functions over documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.functions import classify, text
from casewright.operators import chunking
from casewright.registry import query, table
from casewright.sources import readers


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")


@query()
def txt_redact(spark, d):
    """Redacted text, hits by rule, and both hashes; the lookarounds lie outside of the oracle's regexes."""
    docs = _docs(spark, d).select("doc_id", "text", F.sha2("text", 256).alias("before"))
    return text.redacted(docs, "text").select("doc_id", "hits", "before", F.sha2("text", 256).alias("after"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?:\+91[\s-]?|0)?[6-9]\d{9}', '[MASKED_PHONE]', 'g'), '\b\d{4}[\s-]?\d{4}[\s-]?\d{4}\b', '[MASKED_AADHAAR]', 'g'), '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b', '[MASKED_EMAIL]', 'g'), '\b[A-Z]{2,4}[/-]\d{3,8}\b', '[MASKED_ID]', 'g'), '\b[A-Z]{5}\d{4}[A-Z]\b', '[MASKED_PAN]', 'g') AS masked FROM documents")
def txt_mask(spark, d):
    return _docs(spark, d).select("doc_id", text.mask(F.col("text")).alias("masked"))


@query("WITH n AS (SELECT doc_id, length(regexp_replace(text[1:5000], '[^A-Za-z]', '', 'g')) AS l FROM documents) SELECT doc_id, CASE WHEN l > 0 THEN 'latin' ELSE 'unknown' END AS script FROM n")
def txt_script(spark, d):
    return _docs(spark, d).select("doc_id", text.script(F.col("text")).alias("script"))


@query()
def txt_quality(spark, d):
    return _docs(spark, d).select("doc_id", text.quality(F.col("text")).alias("quality"))


@query(r"SELECT doc_id, array_to_string(list_filter(list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda w: length(w) > 1), lambda w: regexp_replace(w, '[^0-9A-Za-z_]', '', 'g')), lambda w: w <> ''), ' | ') AS query FROM documents")
def txt_ts_terms(spark, d):
    return _docs(spark, d).select("doc_id", text.search_words(F.col("text")).alias("query"))


@query("SELECT doc_id, left(sha256(text), 16) AS hash FROM documents WHERE text IS NOT NULL")
def txt_hash(spark, d):
    return _docs(spark, d).where("text IS NOT NULL").select("doc_id", text.content_hash(F.col("text")).alias("hash"))


@query("SELECT left(sha256(text), 16) AS hash, count(*) AS copies, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def rd_dup_sha(spark, d):
    return _docs(spark, d).where("text IS NOT NULL").groupBy(text.content_hash(F.col("text")).alias("hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first")).where("copies > 1")


@query(r"SELECT conv_id, turn, CASE WHEN length(t) > 280 THEN t[1:280] || '...' ELSE t END AS text FROM (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations)")
def txt_trim(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.trimmed(F.col("text")).alias("text"))


@query("""SELECT conv_id, turn, CASE WHEN contains(text, '"') OR contains(text, ',') OR contains(text, chr(10)) OR contains(text, chr(13)) THEN '"' || replace(text, '"', '""') || '"' ELSE coalesce(text, '') END AS cell FROM conversations""")
def txt_csvcell(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.csv_cell(F.col("text")).alias("cell"))


@query("SELECT s_suppkey AS id, 'ABCD01' || lpad(s_suppkey::VARCHAR, 6, '0') || '2018' AS cnr FROM supplier")
def txt_cnr(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), text.cnr(F.lit("ABCD01"), F.col("s_suppkey"), F.lit(2018)).alias("cnr"))


@query()
def txt_strip_md(spark, d):
    return _docs(spark, d).select("doc_id", text.strip_markdown(F.col("text")).alias("plain"))


@query()
def src_html_text(spark, d):
    return table(spark, d, "pages").select("page_id", text.html_text(F.col("html")).alias("text"))


KEYS_SQL = "k AS (SELECT p_partkey AS id, CASE p_size % 5 WHEN 0 THEN 's3://bucket/data/year=2018/court=9_13/' || p_partkey || '.PDF' WHEN 1 THEN ' /data/court=' || p_size || '/x.pdf' WHEN 2 THEN 'data/../x.pdf' WHEN 3 THEN 'meta/year=2018/x.pdf' ELSE 'data/x.tar' END AS raw, p_size FROM part)"


@query(f"WITH {KEYS_SQL} SELECT id, CASE p_size % 5 WHEN 0 THEN 'data/year=2018/court=9_13/' || id || '.PDF' WHEN 1 THEN 'data/court=' || p_size || '/x.pdf' END AS key, CASE p_size % 5 WHEN 0 THEN 2018 END AS year, CASE p_size % 5 WHEN 0 THEN '9_13' WHEN 1 THEN p_size::VARCHAR END AS court, CASE p_size % 5 WHEN 2 THEN 'invalid key' WHEN 3 THEN 'not under data/' WHEN 4 THEN 'not a PDF' END AS error FROM k")
def src_s3key(spark, d):
    """Object keys: where they come from goes, what may be read, and year and court of their partitions."""
    n, key = F.col("p_size") % 5, F.col("p_partkey").cast("string")
    raw = F.when(n == 0, F.concat(F.lit("s3://bucket/data/year=2018/court=9_13/"), key, F.lit(".PDF"))).when(n == 1, F.concat(F.lit(" /data/court="), F.col("p_size").cast("string"), F.lit("/x.pdf"))).when(n == 2, "data/../x.pdf").when(n == 3, "meta/year=2018/x.pdf").otherwise("data/x.tar")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), readers.object_key(raw, "bucket").alias("k")).select("id", "k.*")


@query()
def txt_chunk(spark, d):
    """Chunks of every whole text."""
    return chunking.chunks(_docs(spark, d))


@query()
def cls_query(spark, d):
    """The plan of every message read as a question."""
    return table(spark, d, "conversations").select("conv_id", "turn", classify.question_plan(F.col("text")).alias("p")).select("conv_id", "turn", "p.*")


@query("SELECT p_partkey AS id, CASE WHEN contains(lower(p_name), 'ring') THEN 'sessions' WHEN p_type = 'ECONOMY' THEN 'family' ELSE 'district' END AS level FROM part")
def cls_court(spark, d):
    """Court levels of labels made from part names and types."""
    position = F.when(F.contains(F.lower("p_name"), F.lit("ring")), "Sessions Judge").when(F.col("p_type") == "ECONOMY", "Family Court").otherwise("Civil Judge")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), classify.court_level(position, F.lit(None).cast("string")).alias("level"))
