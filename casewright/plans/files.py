"""Archives and text files, semantic chunks, and questions as statements."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from casewright.operators import patterns, semantic
from casewright.registry import query, table
from casewright.shared import shared_dir, small
from casewright.sources import archives


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/casewright/{name}-{uuid.uuid4().hex}"


@query("SELECT 'customers.csv' AS member, c_custkey::VARCHAR AS id, c_name AS name, c_mktsegment AS note FROM customer UNION ALL SELECT 'orders.csv', o_orderkey::VARCHAR, o_orderstatus, o_orderpriority FROM orders")
def src_targz(spark, d):
    """Customers and orders as members of archives of about 5000 rows, written and streamed back."""
    c = table(spark, d, "customer").select(F.lit("customers.csv").alias("member"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("note"))
    o = table(spark, d, "orders").select(F.lit("orders.csv").alias("member"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("name"), F.col("o_orderpriority").alias("note"))
    both = c.unionByName(o)
    shares = max(1, both.count() // 5000)
    share = F.pmod(F.xxhash64("id"), F.lit(shares)).cast("string")
    lines = both.select(share.alias("share"), "member", (F.col("id") + 1).alias("place"), F.to_csv(F.struct("id", "name", "note")).alias("line"))
    kept = F.lit("ignored.csv")  # a member that nobody asks for
    heads = lines.select("share", "member").union(lines.select("share", kept)).distinct().select("share", "member", F.lit(0).cast("bigint").alias("place"), F.lit("id,name,note").alias("line"))
    folder = _folder(spark, "archives")
    archives.write_archives(lines.unionByName(heads).withColumn("archive", F.concat(F.lit("part-"), "share")).drop("share"), folder)
    rows, _ = archives.csv_members(spark, f"{folder}/*.tar.gz", ["customers.csv", "orders.csv"])
    return rows.select("member", *(F.col("row")[c].alias(c) for c in ("id", "name", "note")))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN NULL ELSE coalesce(text, '') END AS text, CASE WHEN doc_id % 5 = 4 THEN 'not a text file: pdf' END AS reason FROM documents")
def src_docs(spark, d):
    """Documents as files of several kinds and encodings, read by what they are."""
    text, kind = F.coalesce("text", F.lit("")), F.col("doc_id") % 5
    plain = F.encode(text, "UTF-8")
    marked = F.unhex(F.concat(F.lit("EFBBBF"), F.hex(plain)))
    wide = F.unhex(F.concat(F.lit("FFFE"), F.hex(F.encode(text, "UTF-16LE"))))
    content = F.when(kind == 1, marked).when(kind == 2, wide).otherwise(plain)
    end = F.when(kind == 1, ".csv").when(kind == 2, ".log").when(kind == 4, ".pdf").otherwise(".txt")
    folder = _folder(spark, "texts")
    archives.write_files(table(spark, d, "documents").select(F.concat(F.col("doc_id").cast("string"), end).alias("name"), content.alias("content")), folder)
    doc = F.regexp_extract("path", r"(-?[0-9]+)\.[a-z]+$", 1).cast("bigint").alias("doc_id")
    return archives.told(archives.stored_files(spark, folder)).select(doc, "text", "reason")


CHUNKS = r"""WITH RECURSIVE parts AS (SELECT doc_id AS doc, (list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \t\n\x0b\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$', '', 'g')), lambda s: s <> '')) AS ss FROM documents WHERE text IS NOT NULL),
told AS (SELECT doc, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS k FROM parts),
v AS (SELECT doc, k, sentence, embedding::DOUBLE[] AS vec FROM told JOIN embeddings ON vec_id = (doc * 31 + k // 3 * 7) % 500),
c AS (SELECT doc, k, sentence, coalesce(list_cosine_similarity(vec, lag(vec) OVER (PARTITION BY doc ORDER BY k)) < 0.3, false) AS apart FROM v),
f AS (SELECT doc, k, 0 AS chunk, length(sentence) + 1 AS size FROM c WHERE k = 0
  UNION ALL SELECT c.doc, c.k, CASE WHEN c.apart OR f.size + length(c.sentence) > 600 THEN f.chunk + 1 ELSE f.chunk END, CASE WHEN c.apart OR f.size + length(c.sentence) > 600 THEN 0 ELSE f.size END + length(c.sentence) + 1 FROM f JOIN c ON c.doc = f.doc AND c.k = f.k + 1)
SELECT doc, chunk, min(k)::INT AS first, count(*)::INT AS sentences, string_agg(sentence, ' ' ORDER BY k) AS content FROM f JOIN c USING (doc, k) GROUP BY doc, chunk"""


@query(CHUNKS)
def txt_chunk_sem(spark, d):
    """Chunks of whole texts by the likeness of neighbouring sentences; vectors come from the table of embeddings, three sentences each."""
    docs = table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("doc"), "text")
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").cast("bigint").alias("v"), F.col("embedding").alias("vec")).where("abs(v) < 500")  # no sentence has another
    told = semantic.sentences(docs, F.col("text")).withColumn("v", F.expr("(doc * 31 + k div 3 * 7) % 500"))
    return semantic.chunked(told.join(small(vectors), "v").drop("v"), most=600)


PATTERNS = [
    patterns.Pattern(r"cases? in (?:the )?nation (\d+)", "SELECT count(*) AS n FROM cases WHERE nation = CAST(:g1 AS INT)", "cases of a nation"),
    patterns.Pattern(r"cases? (?:of|with) priority (\d)(?:\D*?worth (?:over|more than) (\d+))?", "SELECT count(*) AS n FROM cases WHERE priority LIKE concat(:g1, '-%') AND amount > CAST(coalesce(:g2, '0') AS DOUBLE)", "cases of a priority"),
    patterns.Pattern(r"delete (.+)", "DELETE FROM cases", "never runs"),
]
QUESTIONS = """asked AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'How many cases in nation ' || (o_custkey % 30) || '?' WHEN 1 THEN 'Cases of priority ' || left(o_orderpriority, 1) || ' worth over ' || (o_custkey * 100) WHEN 2 THEN 'CASE WITH PRIORITY ' || left(o_orderpriority, 1) ELSE 'What is new?' END AS q FROM orders)"""


@query(f"WITH {QUESTIONS} SELECT id, 0 AS pattern, 1 AS place, regexp_extract(q, 'nation (\\d+)', 1) AS value FROM asked WHERE id % 4 = 0 UNION ALL SELECT id, 1, 1, regexp_extract(q, '(?i)priority (\\d)', 1) FROM asked WHERE id % 4 IN (1, 2) UNION ALL SELECT id, 1, 2, nullif(regexp_extract(q, 'over (\\d+)', 1), '') FROM asked WHERE id % 4 IN (1, 2)")
def fn_pattern_groups(spark, d):
    """Groups of the first pattern that each question matches, by a table function in SQL."""
    o = table(spark, d, "orders")
    n, first = F.col("o_orderkey") % 4, F.left("o_orderpriority", F.lit(1))
    q = F.when(n == 0, F.concat(F.lit("How many cases in nation "), (F.col("o_custkey") % 30).cast("string"), F.lit("?"))).when(n == 1, F.concat(F.lit("Cases of priority "), first, F.lit(" worth over "), (F.col("o_custkey") * 100).cast("string"))).when(n == 2, F.concat(F.lit("CASE WITH PRIORITY "), first)).otherwise("What is new?")
    o.select(F.col("o_orderkey").alias("id"), q.alias("q")).createOrReplaceTempView("casewright_asked")
    spark.udtf.register("casewright_groups", patterns.matched_groups(PATTERNS))
    return spark.sql("SELECT id, m.pattern, m.place, m.value FROM casewright_asked, LATERAL casewright_groups(q) m")


@query("SELECT 'cases of a nation' AS found, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 7 UNION ALL SELECT 'cases of a priority', count(*) FROM orders WHERE o_orderpriority LIKE '2-%' AND o_totalprice > 150000")
def fn_question_patterns(spark, d):
    """Questions answered by the statements of their patterns, with groups as parameters."""
    cases = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("nation"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("amount"))
    out = None
    for question in ("Show cases in nation 7", "cases with priority 2, worth more than 150000", "Delete everything", "hello"):
        found = patterns.answer(spark, question, PATTERNS, {"cases": cases})
        if found:
            rows = found[1].select(F.lit(found[0]).alias("found"), "n")
            out = rows if out is None else out.unionByName(rows)
    return out
