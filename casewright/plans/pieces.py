"""Flags, masks, answers, chunk parts, sources and exports over parts, conversations and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.functions import text
from casewright.operators import chunking, search
from casewright.registry import query, table

TEXTS = "list_filter(regexp_split_to_array(text, '\\n\\s*\\n'), lambda p: trim(p) <> '')"


@query("SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN ['minor_identity', 'sexual_offence_detail'] WHEN 1 THEN ['sexual_offence_detail', 'victim_identity'] WHEN 2 THEN ['minor_identity', 'sealed_record'] ELSE []::VARCHAR[] END AS flags FROM part")
def txt_flags(spark, d):
    """Protected flags of offence categories."""
    n = F.col("p_size") % 4
    cats = F.when(n == 0, F.array(F.lit("POCSO act"))).when(n == 1, F.array(F.lit("theft"), F.lit("attempt to Rape"))).when(n == 2, F.array(F.lit("juvenile"), F.lit("in camera"))).otherwise(F.array(F.lit("theft")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.protected_flags(cats).alias("flags"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN ['minor_identity', 'sexual_offence_detail', 'x'] WHEN p_size % 3 = 1 THEN ['sealed_record'] ELSE []::VARCHAR[] END AS flags FROM part")
def txt_sensitive(spark, d):
    """Flags of nested payloads; broken JSON has none."""
    n = F.col("p_size") % 3
    a = F.when(n == 0, '{"judgment": {"sensitive_data_flags": ["x"], "offence_categories": ["POCSO"]}}').when(n == 1, '{"offence_categories": ["sealed file"], "sensitive_data_flags": [""]}').otherwise("{broken")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.sensitive_flags(a, F.lit('{"district": {}}')).alias("flags"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'redacted' WHEN p_size % 3 = 0 THEN 'needs_review' ELSE 'not_required' END AS status FROM part")
def txt_redact_gate(spark, d):
    """A protected text in which no rule hits needs a review."""
    body = F.when(F.col("p_size") % 2 == 0, "mail a.b@c.org").otherwise("nothing here")
    _, hits = text.redact(body)
    flags = text.protected_flags(F.when(F.col("p_size") % 3 == 0, F.array(F.lit("pocso"))).otherwise(F.array(F.lit("theft"))))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.redaction_status(flags, hits).alias("status"))


@query("SELECT p_partkey AS id, p_size % 2 = 0 AS is_table FROM part")
def txt_is_table(spark, d):
    body = F.when(F.col("p_size") % 2 == 0, "a|b|c\n1|2|3\nx").otherwise("a|b|c\nx\ny")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.is_table(body).alias("is_table"))


@query("SELECT conv_id, turn, [2, 1 + turn % 3]::INT[] AS cited FROM conversations WHERE turn % 3 <> 1")
def txt_citations(spark, d):
    """Cited passages in the order of first use, within range."""
    n = F.col("turn") % 3 + 1
    answer = F.concat(F.lit("a [2] b ["), n.cast("string"), F.lit("] c [2][9][0]"))
    return table(spark, d, "conversations").where("turn % 3 <> 1").select("conv_id", "turn", text.citations(answer, F.lit(3)).alias("cited"))


@query("SELECT conv_id, turn, ['Who was there?', 'What is case ' || conv_id || '?'] AS follow_ups FROM conversations")
def txt_followups(spark, d):
    answer = F.concat(F.lit("Text.\nFOLLOW_UP_QUESTIONS:\n- Who was there?\n2. What is case "), F.col("conv_id").cast("string"), F.lit("?\n* no\n"))
    return table(spark, d, "conversations").select("conv_id", "turn", text.follow_ups(answer).alias("follow_ups"))


@query("SELECT p_partkey AS id, [1, 2, 3] AS pages, [0, length(p_name) + 2, length(p_name) + length(p_brand) + 4]::INT[] AS starts FROM part")
def txt_pages(spark, d):
    """Where the pages of a text with form feeds begin."""
    _, starts = chunking.page_starts(F.concat("p_name", F.lit("\f"), "p_brand", F.lit("\f"), "p_type"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), starts.alias("s")).select("id", F.transform("s", lambda b: b["page"]).alias("pages"), F.transform("s", lambda b: b["at"]).alias("starts"))


@query("SELECT p_partkey AS id, ['', 'Facts of ' || p_name, 'Two'] AS headings, [p_brand, p_type, 'end'] AS bodies FROM part")
def txt_headings(spark, d):
    body = F.concat("p_brand", F.lit("\nFacts of "), "p_name", F.lit("\n"), "p_type", F.lit("\n# One\n\n## Two\nend"))
    s = chunking.sections(body)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.transform(s, lambda x: x["heading"]).alias("headings"), F.transform(s, lambda x: x["body"]).alias("bodies"))


@query("SELECT p_partkey AS id, ceil(p_size * 3 / 50.0)::INT AS parts FROM part WHERE p_size * 3 + 1 > 50")
def txt_split_table(spark, d):
    """Long tables in parts of fifty rows under the first line."""
    body = F.concat(F.lit("a|b|c"), F.array_join(F.transform(F.sequence(F.lit(1), F.col("p_size") * 3), lambda k: F.concat(F.lit("\n"), k.cast("string"), F.lit("|x|y"))), ""))
    return table(spark, d, "part").where("p_size * 3 + 1 > 50").select(F.col("p_partkey").alias("id"), F.size(chunking.by_rows(body)).alias("parts"))


@query("SELECT vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.e), 5) AS similarity FROM embeddings a, (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 21) b ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.e) DESC, vec_id LIMIT 15")
def topk_vector(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    one = e.where("id = 21").select(F.lit(21).alias("q"), F.col("vec").alias("v"))
    return search.nearest(e, one, 15).select("id", F.round("similarity", 5).alias("similarity"))


@query("SELECT o_orderkey, n_name AS district, r_name AS state FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 200) LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def jn_left_labels(spark, d):
    """Labels join after the limit."""
    top = table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(200).select("o_orderkey", "o_custkey")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    n, r = table(spark, d, "nation"), table(spark, d, "region")  # 25 and 5 rows by definition
    j = top.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return j.select("o_orderkey", F.col("n_name").alias("district"), F.col("r_name").alias("state"))
