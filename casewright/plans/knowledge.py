"""Graph search, claims, names and their resolution: line items are extracted edges between parts and suppliers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from casewright.functions.stems import STOP_WORDS
from casewright.operators import claims, fulltext, graph_search, names, resolution
from casewright.operators.entities import short_name
from casewright.plans.contents import WORD_TRGM
from casewright.plans.fulltexts import STEMS, _in, _words
from casewright.registry import query, table

KINDS = [*claims.CLAIMING, "cites", "related_to"]
EDGES = f"""edges AS (SELECT (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS edge_id, l_partkey AS source, l_suppkey AS target, ([{', '.join(f"'{k}'" for k in KINDS)}])[1 + ((l_orderkey + l_linenumber) % {len(KINDS)})::INT] AS kind,
  CASE WHEN l_returnflag <> 'N' THEN l_returnflag || l_linestatus END AS description, CASE WHEN l_tax < 0.07 THEN round(1 - 2 * l_discount, 2) END AS confidence, l_orderkey * 10 + l_linenumber % 2 AS chunk, l_orderkey AS document, CASE WHEN l_linestatus = 'F' THEN 'approved' END AS review_status, CASE WHEN l_tax > 0.02 THEN 'said' END AS quote FROM lineitem)"""
HIGH = _in(claims.HIGH_IMPACT)
CLAIMS = f"""claims AS (SELECT CASE WHEN kind IN {_in(claims.CLAIM_KINDS['outcome_reason'])} THEN 'outcome_reason' WHEN kind IN {_in(claims.CLAIM_KINDS['procedural_defect'])} THEN 'procedural_defect' WHEN kind = 'later_treated_as' THEN 'authority_treatment' ELSE 'finding_of_law' END AS assertion_type,
  source AS subject, kind AS predicate, target AS object, coalesce(description, '') AS object_value, coalesce(confidence, 1.0) AS confidence, edge_id, chunk, document, coalesce(review_status, 'unreviewed') AS review_status, kind IN {HIGH} AS high_impact FROM edges WHERE kind IN {_in(claims.CLAIMING)})"""


def _edges(spark, d):
    li = table(spark, d, "lineitem")
    kinds = F.array(*(F.lit(k) for k in KINDS))
    kind = F.get(kinds, ((F.col("l_orderkey") + F.col("l_linenumber")) % len(KINDS)).cast("int"))
    return li.select(
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")).alias("edge_id"), F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"), kind.alias("kind"), F.when(F.col("l_returnflag") != "N", F.concat("l_returnflag", "l_linestatus")).alias("description"),
        F.when(F.col("l_tax") < 0.07, F.round(1 - 2 * F.col("l_discount"), 2)).alias("confidence"), (F.col("l_orderkey") * 10 + F.col("l_linenumber") % 2).alias("chunk"), F.col("l_orderkey").alias("document"),
        F.when(F.col("l_linestatus") == "F", "approved").alias("review_status"), F.when(F.col("l_tax") > 0.02, "said").alias("quote"),
    )


@query(f"WITH {EDGES}, {CLAIMS} SELECT * FROM claims")
def gr_assert(spark, d):
    """Claims of ten edge types."""
    return claims.assertions(_edges(spark, d))


@query(f"WITH {EDGES} SELECT edge_id, document, concat_ws('; ', CASE WHEN kind IN {HIGH} THEN 'High-impact legal edge ''' || kind || ''' requires review' END, CASE WHEN coalesce(confidence, 1.0) < 0.85 THEN 'Low-confidence legal edge: ' || printf('%.2f', confidence) END, CASE WHEN kind IN {HIGH} AND quote IS NULL THEN 'Missing quoted source span' END) AS reason, 'legal_kg_high_impact' AS category, CASE WHEN kind IN {HIGH} THEN 90 ELSE 50 END AS priority FROM edges WHERE kind IN {HIGH} OR coalesce(confidence, 1.0) < 0.85")
def gr_review(spark, d):
    """Edges for review with their reasons; grave ones first."""
    return claims.reviews(_edges(spark, d))


@query(f"WITH {EDGES} SELECT 'NODE' AS entity_type, p_partkey AS entity_id, NULL::BIGINT AS chunk, p_size::BIGINT AS document, 1.0::DOUBLE AS confidence, NULL AS claim_type, 'unreviewed' AS review_status FROM part UNION ALL SELECT 'EDGE', edge_id, chunk, document, coalesce(confidence, 1.0), kind, coalesce(review_status, 'unreviewed') FROM edges")
def gr_prov(spark, d):
    """Where every node and edge comes from."""
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.lit(None).cast("bigint").alias("chunk"), F.col("p_size").cast("bigint").alias("document"))
    return claims.provenance(nodes, _edges(spark, d))


@query(f"WITH {EDGES}, {CLAIMS}, nodes AS (SELECT p_partkey AS node FROM part WHERE p_brand = 'Brand#13' AND p_size < 20), c AS (SELECT DISTINCT chunk FROM edges WHERE source IN (SELECT node FROM nodes) OR target IN (SELECT node FROM nodes) ORDER BY chunk LIMIT 100), a AS (SELECT DISTINCT chunk FROM (SELECT chunk FROM claims WHERE subject IN (SELECT node FROM nodes) OR object IN (SELECT node FROM nodes) ORDER BY confidence DESC, edge_id LIMIT 25)) SELECT chunk, 'edge' AS via FROM c UNION ALL SELECT chunk, 'assertion' FROM a")
def gr_chunks(spark, d):
    """Evidence of the edges of some nodes, and of the best claims about them."""
    e = _edges(spark, d)
    nodes = table(spark, d, "part").where("p_brand = 'Brand#13' AND p_size < 20").select(F.col("p_partkey").alias("node"))
    return claims.evidence(e, claims.assertions(e), nodes)


@query(f"""WITH {EDGES}, {CLAIMS},
lines AS (SELECT p_partkey AS q, 0 AS part, 0.0::DOUBLE AS place, '[part/' || p_type || '] ' || p_name || ': ' || CASE WHEN p_size % 3 = 0 THEN 'No description' ELSE p_brand END AS line FROM part
  UNION ALL SELECT source, 1, edge_id, 'Relationship: ' || p_name || ' --[' || kind || ']--> ' || s_name FROM edges JOIN part ON p_partkey = source JOIN supplier ON s_suppkey = target
  UNION ALL SELECT subject, 2, k, line FROM (SELECT subject, row_number() OVER (PARTITION BY subject ORDER BY confidence DESC, edge_id, object, object_value, review_status) AS k, 'Assertion: [' || assertion_type || '] ' || predicate || ': ' || CASE WHEN object_value = '' THEN 'No value' ELSE object_value END || ' (review: ' || review_status || ')' AS line FROM claims) WHERE k <= 25)
SELECT q, string_agg(line, chr(10) ORDER BY part, place, line) AS context FROM lines GROUP BY q""")
def gr_context(spark, d):
    """Each part, its edges and the best claims about it as text."""
    e, p, s = _edges(spark, d), table(spark, d, "part"), table(spark, d, "supplier")
    nodes = p.select(F.col("p_partkey").alias("q"), F.lit(0).alias("place"), claims.node_line(F.lit("part"), F.col("p_type"), F.col("p_name"), F.when(F.col("p_size") % 3 > 0, F.col("p_brand"))).alias("line"))
    named = e.join(p, e["source"] == p["p_partkey"]).join(s, e["target"] == s["s_suppkey"])
    edges = named.select(F.col("source").alias("q"), F.col("edge_id").alias("place"), claims.edge_line(F.col("p_name"), F.col("kind"), F.col("s_name")).alias("line"))
    made = claims.assertions(e).select(F.col("subject").alias("q"), F.row_number().over(Window.partitionBy("subject").orderBy(F.desc("confidence"), "edge_id", "object", "object_value", "review_status")).alias("place"), claims.claim_line(F.col("assertion_type"), F.col("predicate"), F.col("object_value"), F.col("review_status")).alias("line"))
    return claims.context(nodes, edges, made)


@query(f"WITH {EDGES}, w AS (SELECT source * 2 AS src, target * 2 + 1 AS dst, edge_id, coalesce(confidence, 1.0) AS weight FROM edges), ends AS (SELECT edge_id, src AS node, dst AS other, true AS outgoing, weight FROM w UNION ALL SELECT edge_id, dst, src, false, weight FROM w), placed AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY weight DESC, edge_id, outgoing) AS place FROM ends), nodes AS (SELECT p_partkey * 2 AS node, p_name AS name FROM part UNION ALL SELECT s_suppkey * 2 + 1, s_name FROM supplier) SELECT node, name, place::INT AS place, edge_id, other, outgoing, weight FROM nodes LEFT JOIN placed USING (node)")
def gr_node_detail(spark, d):
    """Every node with its edges by weight."""
    e = _edges(spark, d).select("edge_id", (F.col("source") * 2).alias("src"), (F.col("target") * 2 + 1).alias("dst"), F.coalesce("confidence", F.lit(1.0)).alias("weight"))
    p, s = table(spark, d, "part"), table(spark, d, "supplier")
    nodes = p.select((F.col("p_partkey") * 2).alias("node"), F.col("p_name").alias("name")).union(s.select((F.col("s_suppkey") * 2 + 1), F.col("s_name")))
    return claims.detail(nodes, e)


SEARCH = f"""WITH each AS (SELECT p_partkey AS id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM (SELECT p_partkey, list_concat({_words('p_name')}, {_words('p_type')}) AS ws FROM part)),
vocab AS (SELECT DISTINCT word FROM each WHERE word NOT IN {_in(STOP_WORDS)}),{STEMS},
fts AS (SELECT id, 0.1::DOUBLE * count(*) AS density FROM each JOIN stems USING (word) WHERE term = 'ring' GROUP BY id),
g AS (SELECT p_partkey AS id, {WORD_TRGM.format('p_name')} AS a, {WORD_TRGM.format('p_type')} AS b, {WORD_TRGM.format("'rings'")} AS q FROM part),
sims AS (SELECT id, len(list_intersect(a, q)) / len(list_distinct(list_concat(a, q))) AS n, len(list_intersect(b, q)) / len(list_distinct(list_concat(b, q))) AS s FROM g)
SELECT id, round(density, 6) AS density, round(greatest(n, s), 6) AS similarity FROM (SELECT p_partkey AS id, p_name, p_size, density, n, s FROM part JOIN sims ON p_partkey = sims.id LEFT JOIN fts ON p_partkey = fts.id WHERE density IS NOT NULL OR n > 0.2 OR s > 0.2 OR contains(lower(p_brand), 'rings') OR contains('size ' || p_size, 'rings'))
ORDER BY density DESC NULLS LAST, greatest(n, s) DESC, p_size DESC, p_name, id LIMIT 300"""


@query(SEARCH)
def gr_node_search(spark, d):
    """Parts by stems of their words, by likeness of name or type, by alias or property."""
    p = table(spark, d, "part")
    nodes = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("subtype"), F.array("p_brand").alias("aliases"), F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("properties"), F.col("p_size").alias("source_count"))
    index = fulltext.index(nodes, [(F.col("name"), fulltext.A), (F.col("subtype"), fulltext.B)])
    return graph_search.node_search(nodes, index, "Rings ", 300).select("id", F.round("density", 6).alias("density"), F.round("similarity", 6).alias("similarity"))


COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query(f"""WITH v AS (SELECT id, s FROM (SELECT a.vec_id AS id, {COS} AS s FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 7) b ORDER BY s DESC, id LIMIT 10) WHERE s > 0.3),
g AS (SELECT p_partkey AS id, {WORD_TRGM.format('p_name')} AS a FROM part), e AS (SELECT DISTINCT {WORD_TRGM.format("s_name || ' ring'")} AS b FROM supplier WHERE s_nationkey = 3),
n AS (SELECT id, max(s) AS s FROM (SELECT id, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS s FROM g, (SELECT b FROM e UNION ALL SELECT a FROM g WHERE id IN (1, 2))) WHERE s > 0.3 GROUP BY id ORDER BY id LIMIT 25)
SELECT id, 'vector' AS via, round(s, 5) AS similarity FROM v UNION ALL SELECT id, 'name', round(s, 5) FROM n WHERE id NOT IN (SELECT id FROM v)""")
def gr_seed(spark, d):
    """Where a question starts in the graph: near by vector, or named like its entities."""
    e, p, s = table(spark, d, "embeddings"), table(spark, d, "part"), table(spark, d, "supplier")
    named = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    entities = named.where("id IN (1, 2)").unionByName(s.where("s_nationkey = 3").select(F.col("s_suppkey").alias("id"), F.concat("s_name", F.lit(" ring")).alias("name")))
    vectors, question = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), e.where("vec_id = 7").select(F.col("embedding").alias("v"))
    return graph_search.seeds(vectors, question, named, entities).withColumn("similarity", F.round("similarity", 5))


#: "cold" holds "old", which would be a name of its own.
TOLD = """told AS (SELECT p_partkey AS id, replace(p_name, 'cold', 'icy') AS a, replace(lead(p_name, 1, 'hot gear') OVER (ORDER BY p_partkey), 'cold', 'icy') AS b, p_size % 4 AS n FROM part)"""


@query(f"WITH {TOLD} SELECT id, CASE WHEN a = b THEN NULL WHEN n < 3 THEN a ELSE least(a, b) END AS source, CASE WHEN a = b THEN NULL WHEN n < 3 THEN b ELSE greatest(a, b) END AS target FROM told")
def gr_rel_parse(spark, d):
    """The ends of worded relations: split at the type, at a verb, or the names that occur, among the names found in each text."""
    p = table(spark, d, "part").select("p_partkey", F.replace("p_name", F.lit("cold"), F.lit("icy")).alias("p_name"), "p_size")
    after = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("b"))
    n, b = F.col("p_size") % 4, F.coalesce("b", F.lit("hot gear"))
    said = F.when(n == 0, F.concat("p_name", F.lit(" Works For "), b)).when(n == 1, F.concat(F.lit(" "), "p_name", F.lit(" regulates "), F.upper(b))).when(n == 2, F.concat(F.upper("p_name"), F.lit(" applies to "), b)).otherwise(F.concat(F.lit("the "), "p_name", F.lit(" saw the "), b))
    told = p.join(after, "p_partkey", "left").select(F.col("p_partkey").alias("id"), said.alias("text"))
    found = names.found_names(told, p.select(F.col("p_name").alias("name")).distinct())
    return told.join(found, "id").select("id", names.relations(F.col("text"), F.lit("works_for"), F.col("names")).alias("e")).select("id", "e.*")


@query("WITH t AS (SELECT p_partkey AS id, p_name AS a, lead(p_name, 1, 'hot gear') OVER (ORDER BY p_partkey) AS b FROM part) SELECT id, 'Seen: ' || CASE WHEN regexp_matches(a, 'ring|widget') THEN '[MASKED_NAME]' ELSE upper(a) END || ', then ' || CASE WHEN regexp_matches(b, 'ring|widget') THEN '[MASKED_NAME]' ELSE b END || '.' AS masked FROM t")
def txt_mask_names(spark, d):
    """Names of a list, in any case, wherever a text holds them."""
    p = table(spark, d, "part").select("p_partkey", "p_name")
    after = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("b"))
    text = F.concat(F.lit("Seen: "), F.upper("p_name"), F.lit(", then "), F.coalesce("b", F.lit("hot gear")), F.lit("."))
    people = p.where(F.col("p_name").rlike("ring|widget")).select(F.col("p_name").alias("name")).distinct()
    return names.masked(p.join(after, "p_partkey", "left").select(F.col("p_partkey").alias("id"), text.alias("text")), people)


@query()
def gr_consolidate(spark, d):
    """Titles of documents, in order, brought together with the names of parts and with each other; order lies outside of SQL and is tested by a loop."""
    title = short_name(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1))
    new = table(spark, d, "documents").select(F.col("doc_id").alias("at"), title.alias("name"))
    known = table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    return resolution.consolidated(new, known).select(F.col("at").alias("doc_id"), "name", "resolved")


@query(f"WITH r AS (SELECT p_partkey AS id, p_retailprice, ((regexp_matches(p_name, '\\bring\\b')::INT + regexp_matches(p_name, '\\bwidget\\b')::INT) * 0.1::DOUBLE / 1.64493406685) / 2 AS rank FROM part) SELECT id, round(s, 5) AS score FROM (SELECT a.vec_id AS id, 0.65 * {COS} + 0.35 * coalesce(rank, 0) AS s, p_retailprice FROM embeddings a JOIN r ON r.id = a.vec_id, (SELECT embedding FROM embeddings WHERE vec_id = 7) b) ORDER BY round(s, 9) DESC, p_retailprice DESC, id DESC LIMIT 20")
def vec_wiki(spark, d):
    """Articles by 0.65 of their similarity and 0.35 of their rank for the question's words, then confidence and age."""
    e, p = table(spark, d, "embeddings"), table(spark, d, "part")
    rows = e.join(p, e["vec_id"] == p["p_partkey"]).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("p_retailprice").alias("confidence"), F.col("vec_id").alias("updated"))
    index = fulltext.index(p.select(F.col("p_partkey").alias("id"), "p_name"), [(F.col("p_name"), fulltext.D)])
    ranks = fulltext.any_term(index, spark.createDataFrame([(1, "rings and widgets")], "q int, text string"))
    question = e.where("vec_id = 7").select(F.col("embedding").alias("v"))
    return graph_search.articles(rows, question, ranks, 20).withColumn("score", F.round("score", 5))
