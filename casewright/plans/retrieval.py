"""Vector, lexical, trigram and fused search over embeddings, documents and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.operators import search
from casewright.registry import query, table

COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
TOP = f"nearest AS (SELECT q, id, similarity FROM (SELECT b.vec_id AS q, a.vec_id AS id, {COS} AS similarity, row_number() OVER (PARTITION BY b.vec_id ORDER BY {COS} DESC, a.vec_id) AS k FROM embeddings a, embeddings b WHERE b.vec_id % 50 = 0) WHERE k <= 10)"


def _vectors(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label"), e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"))


@query(f"SELECT a.vec_id AS id, round({COS}, 5) AS similarity FROM embeddings a, (SELECT * FROM embeddings WHERE vec_id = 7) b WHERE a.label <> 3 ORDER BY {COS} DESC, a.vec_id LIMIT 20")
def vec_topk(spark, d):
    v, _ = _vectors(spark, d)
    one = v.where("id = 7").select(F.col("vec").alias("v"))
    return v.where("label <> 3").crossJoin(F.broadcast(one)).select("id", search.cosine(F.col("vec"), F.col("v")).alias("s")).orderBy(F.desc("s"), "id").limit(20).select("id", F.round("s", 5).alias("similarity"))


@query(f"WITH {TOP} SELECT q, id, round(similarity, 5) AS similarity FROM nearest")
def vec_multi(spark, d):
    v, q = _vectors(spark, d)
    return search.nearest(v, q, 10).withColumn("similarity", F.round("similarity", 5))


@query(f"WITH {TOP} SELECT id, min(q) AS first_query FROM nearest GROUP BY 1")
def set_dedupe_first(spark, d):
    """Each hit once, with the first query that found it."""
    v, q = _vectors(spark, d)
    return search.nearest(v, q, 10).groupBy("id").agg(F.min("q").alias("first_query"))


@query(f"SELECT a.vec_id AS id, round({COS}, 5) AS similarity FROM embeddings a, (SELECT * FROM embeddings WHERE vec_id = 11) b WHERE a.label % 2 = 0 AND a.vec_id > 100 AND {COS} >= 0.1 ORDER BY {COS} DESC, a.vec_id LIMIT 1")
def vec_cache(spark, d):
    """The best live cache entry at a low threshold."""
    v, _ = _vectors(spark, d)
    one = v.where("id = 11").select(F.col("vec").alias("v"))
    entries = v.crossJoin(F.broadcast(one)).withColumns({"preset": F.when(F.col("label") % 2 == 0, "balanced").otherwise("concise"), "expires": F.col("id")})
    return search.cached(entries, F.col("v"), "balanced", F.lit(100), 0.1).withColumn("similarity", F.round("similarity", 5))


@query("SELECT vec_id AS id, len(embedding) = 64 AS ok FROM embeddings")
def val_dims(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.size("embedding") == 64).alias("ok"))


POSTINGS = "postings AS (SELECT term, doc_id AS id, count(*) AS tf, any_value(len) AS len FROM (SELECT doc_id, len(ws) AS len, unnest(ws) AS term FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^0-9a-z]+'), lambda x: length(x) > 1) AS ws FROM documents WHERE text IS NOT NULL)) GROUP BY ALL)"
LEXICAL = f"{POSTINGS}, wanted AS (SELECT DISTINCT q, term FROM (SELECT item_id AS q, unnest(list_transform(regexp_split_to_array(lower(text), '\\s+'), lambda w: regexp_replace(w, '[^0-9A-Za-z_]', '', 'g'))) AS term FROM benchmark WHERE item_id % 50 = 0) WHERE length(term) >= 2), ranked AS (SELECT q, id, sum(1 + ln(tf)) / (1 + ln(any_value(len))) AS rank FROM postings JOIN wanted USING (term) GROUP BY ALL), best AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(rank, 9) DESC, id) AS k FROM ranked)"


@query(f"WITH {LEXICAL} SELECT q, id, round(rank, 6) AS rank FROM best WHERE k <= 10")
def topk_lexical(spark, d):
    """The ten best documents for each passage whose id is divisible by 50."""
    q = table(spark, d, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("q"), "text")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return search.lexical(docs, F.col("text"), q, 10).withColumn("rank", F.round("rank", 6))


@query("""WITH g AS (SELECT DISTINCT c_custkey, unnest(list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))) AS g FROM (SELECT c_custkey, unnest(list_filter(regexp_split_to_array(lower(c_name), '[^0-9a-z]+'), lambda x: x <> '')) AS w FROM customer)),
h AS (SELECT DISTINCT s_suppkey, unnest(list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))) AS g FROM (SELECT s_suppkey, unnest(list_filter(regexp_split_to_array(lower(s_name), '[^0-9a-z]+'), lambda x: x <> '')) AS w FROM supplier)),
j AS (SELECT c_custkey AS a, s_suppkey AS b, count(*) AS i FROM g JOIN h USING (g) GROUP BY ALL)
SELECT a, b, round(i / ((SELECT count(*) FROM g WHERE c_custkey = a) + (SELECT count(*) FROM h WHERE s_suppkey = b) - i), 6) AS similarity FROM j WHERE i / ((SELECT count(*) FROM g WHERE c_custkey = a) + (SELECT count(*) FROM h WHERE s_suppkey = b) - i) > 0.3""")
def jn_nested_sim(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return search.trigram_join(c, s, 0.3).withColumn("similarity", F.round("similarity", 6))


FUSE = f"v AS (SELECT a.vec_id AS id, {COS} AS s FROM embeddings a, (SELECT * FROM embeddings WHERE vec_id = 7) b ORDER BY s DESC, id LIMIT 40), l AS (SELECT vec_id AS id, (vec_id % 13 + 1) / 13 AS r FROM embeddings WHERE vec_id % 9 = 0), f AS (SELECT coalesce(v.id, l.id) AS id, coalesce(0.4 * s, 0) + coalesce(0.2 * r / (SELECT greatest(max(r), 0.001) FROM l), 0) + CASE WHEN coalesce(v.id, l.id) % 4 = 0 THEN 0.2 ELSE 0 END AS score FROM v FULL JOIN l ON v.id = l.id)"


@query(f"WITH {FUSE} SELECT id, round(score, 5) AS score FROM f ORDER BY round(score, 9) DESC, id LIMIT 20")
def fus_rerank(spark, d):
    v, _ = _vectors(spark, d)
    one = v.where("id = 7").select(F.col("vec").alias("v"))
    near = v.crossJoin(F.broadcast(one)).select("id", search.cosine(F.col("vec"), F.col("v")).alias("similarity")).orderBy(F.desc("similarity"), "id").limit(40)
    lex = v.where("id % 9 = 0").select("id", ((F.col("id") % 13 + 1) / 13).alias("rank"))
    return search.fuse(near, lex, v.where("id % 4 = 0"), 20).select("id", F.round("score", 5).alias("score"))


@query("WITH h AS (SELECT vec_id AS id, label AS scope, vec_id % 101 / 101.0 AS score FROM embeddings WHERE label < 3), r AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY score DESC, id) > 4 AS extra FROM h) SELECT id, scope FROM (SELECT * FROM r ORDER BY extra, score DESC, id LIMIT 14)")
def fus_balance(spark, d):
    h = table(spark, d, "embeddings").where("label < 3").select(F.col("vec_id").alias("id"), F.col("label").alias("scope"), (F.col("vec_id") % 101 / 101.0).alias("score"))
    return search.balance(h, 3, 14).select("id", "scope")
