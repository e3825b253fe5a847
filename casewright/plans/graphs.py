"""Graph queries: nations, customers and suppliers as nodes, trade as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.operators import graph
from casewright.registry import query, table
from casewright.shared import shares

EDGES_SQL = """edges AS (SELECT row_number() OVER (ORDER BY src, dst) AS edge_id, * FROM (SELECT o_custkey * 2 AS src, l_suppkey * 2 + 1 AS dst, 'trade' AS kind, least(1.0, 0.4 + 0.15 * count(*))::DOUBLE AS weight
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL))"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Customers (even ids) and suppliers (odd ids), numbered by their ends."""
    o, li = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    n = shares(spark, li.count())
    ends = o.repartition(n, "o_orderkey").join(li.repartition(n, "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey")).select((F.col("o_custkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst"))
    e = ends.repartition(n, "src", "dst").groupBy("src", "dst").agg(F.least(F.lit(1.0), 0.4 + 0.15 * F.count("*")).alias("weight"))
    return e.select((F.col("src") * 1_000_000 + F.col("dst")).alias("edge_id"), "src", "dst", F.lit("trade").alias("kind"), "weight")


@query(f"WITH {EDGES_SQL}, ends AS (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) SELECT node, count(*) AS degree FROM ends GROUP BY 1 ORDER BY degree DESC, node LIMIT 10")
def agg_graph_stats(spark, d):
    return graph.degrees(edges(spark, d)).orderBy(F.desc("degree"), "node").limit(10)


@query(f"WITH {EDGES_SQL} SELECT kind, count(*) AS n, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets, round(avg(weight), 4) AS weight FROM edges GROUP BY 1")
def agg_graph_types(spark, d):
    return edges(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets"), F.round(F.avg("weight"), 4).alias("weight"))


@query(f"WITH {EDGES_SQL}, h1 AS (SELECT * FROM edges WHERE weight >= 0.55 AND (src = 2 OR dst = 2) ORDER BY weight DESC, src, dst LIMIT 50), v1 AS (SELECT 2 AS node UNION SELECT src FROM h1 UNION SELECT dst FROM h1), h2 AS (SELECT * FROM edges WHERE weight >= 0.55 AND (src IN (SELECT node FROM v1) OR dst IN (SELECT node FROM v1)) ORDER BY weight DESC, src, dst LIMIT 50) SELECT src * 1000000 + dst AS edge_id, min(hop) AS hop, round(any_value(weight), 4) AS weight FROM (SELECT *, 1 AS hop FROM h1 UNION ALL SELECT *, 2 FROM h2) GROUP BY ALL")
def gr_expand(spark, d):
    """Two hops of heavy edges around one customer."""
    return graph.expand(edges(spark, d), spark.range(2, 3).select(F.col("id").alias("node"))).withColumn("weight", F.round("weight", 4))


@query(f"WITH {EDGES_SQL}, h1 AS (SELECT DISTINCT dst AS n FROM edges WHERE src = 2 ORDER BY n LIMIT 20), h2 AS (SELECT DISTINCT src AS n FROM edges WHERE dst IN (SELECT n FROM h1) AND src <> 2 ORDER BY n LIMIT 20), h3 AS (SELECT DISTINCT dst AS n FROM edges WHERE src IN (SELECT n FROM h2) AND dst NOT IN (SELECT n FROM h1) ORDER BY n LIMIT 20) SELECT 2::BIGINT AS node, 0 AS hop UNION ALL SELECT n, 1 FROM h1 UNION ALL SELECT n, 2 FROM h2 UNION ALL SELECT n, 3 FROM h3")
def gr_explore(spark, d):
    return graph.explore(edges(spark, d), spark.range(2, 3).select(F.col("id").alias("node")), 3, 20)


@query(f"WITH {EDGES_SQL} SELECT src * 1000000 + dst AS edge_id, c_name AS source, s_name AS target, round(weight, 4) AS weight FROM edges JOIN customer ON c_custkey * 2 = src JOIN supplier ON s_suppkey * 2 + 1 = dst WHERE weight >= 0.7")
def jn_self_role(spark, d):
    """Both ends of each edge get their names."""
    c = table(spark, d, "customer").select((F.col("c_custkey") * 2).alias("src"), F.col("c_name").alias("source"))
    s = table(spark, d, "supplier").select((F.col("s_suppkey") * 2 + 1).alias("dst"), F.col("s_name").alias("target"))
    return edges(spark, d).where("weight >= 0.7").join(c, "src").join(s, "dst").select("edge_id", "source", "target", F.round("weight", 4).alias("weight"))


@query(f"WITH {EDGES_SQL} SELECT count(*) AS n FROM edges WHERE src IN (SELECT c_custkey * 2 FROM customer WHERE c_nationkey = 3) OR dst IN (SELECT s_suppkey * 2 + 1 FROM supplier WHERE s_nationkey = 3)")
def jn_theta_or(spark, d):
    c = table(spark, d, "customer").where("c_nationkey = 3").select((F.col("c_custkey") * 2).alias("node"))
    s = table(spark, d, "supplier").where("s_nationkey = 3").select((F.col("s_suppkey") * 2 + 1).alias("node"))
    return graph.touching(edges(spark, d), c.union(s)).agg(F.count("*").alias("n"))


@query(f"WITH {EDGES_SQL} SELECT dst AS doc, count(*) AS mentions, list_sort(list(DISTINCT src)) AS nodes FROM edges GROUP BY 1")
def agg_doc_graph(spark, d):
    return edges(spark, d).groupBy(F.col("dst").alias("doc")).agg(F.count("*").alias("mentions"), F.array_sort(F.collect_set("src")).alias("nodes"))


@query(f"WITH {EDGES_SQL}, q AS (SELECT dst AS doc, count(*) AS n, count(*) FILTER (weight < 0.6) AS weak FROM edges GROUP BY 1), g AS (SELECT c_nationkey AS nation, count(*) AS dangling FROM customer WHERE NOT EXISTS (SELECT 1 FROM edges WHERE src = c_custkey * 2) GROUP BY 1) SELECT doc, n, weak, round(weak / n, 6) AS share, coalesce(dangling, 0) AS dangling, weak / n > 0.25 OR coalesce(dangling, 0) > 3 AS requires_review FROM q JOIN supplier ON s_suppkey * 2 + 1 = doc LEFT JOIN g ON nation = s_nationkey")
def agg_kg_quality(spark, d):
    """Edges of a document, weak ones, and the nodes of its nation that no edge touches."""
    e = edges(spark, d)
    q = e.groupBy(F.col("dst").alias("doc")).agg(F.count("*").alias("n"), F.count_if(F.col("weight") < 0.6).alias("weak"))
    nodes = table(spark, d, "customer").select((F.col("c_custkey") * 2).alias("src"), F.col("c_nationkey").alias("nation"))
    dangling = nodes.join(e.select("src").distinct(), "src", "left_anti").groupBy("nation").agg(F.count("*").alias("dangling"))
    where = table(spark, d, "supplier").select((F.col("s_suppkey") * 2 + 1).alias("doc"), F.col("s_nationkey").alias("nation"))
    j = q.join(where, "doc").join(dangling, "nation", "left").withColumn("dangling", F.coalesce("dangling", F.lit(0).cast("bigint")))
    return j.select("doc", "n", "weak", F.round(F.col("weak") / F.col("n"), 6).alias("share"), "dangling", ((F.col("weak") / F.col("n") > 0.25) | (F.col("dangling") > 3)).alias("requires_review"))


@query("SELECT p_brand AS node, count(DISTINCT l_suppkey) AS docs FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 2")
def agg_node_docs(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy(F.col("p_brand").alias("node")).agg(F.count_distinct("l_suppkey").alias("docs")).where("docs > 2")


@query("WITH old AS (SELECT p_name AS name, p_type AS kind, p_brand AS description, p_retailprice / 10000 AS confidence, 1::BIGINT AS source_count FROM part WHERE p_partkey % 2 = 0), new AS (SELECT p_name AS name, p_type AS kind, p_brand AS description, p_retailprice / 10000 AS confidence FROM part WHERE p_partkey % 3 = 0), o AS (SELECT name, kind, sum(source_count) AS n, max(confidence) AS c, arg_max(description, (length(description), description)) AS d FROM old GROUP BY ALL), b AS (SELECT name, kind, 1 AS n, max(confidence) AS c, arg_max(description, (length(description), description)) AS d FROM new GROUP BY ALL), u AS (SELECT * FROM o UNION ALL SELECT * FROM b) SELECT name, kind, arg_max(d, (length(d), d)) AS description, round(max(c), 6) AS confidence, sum(n)::BIGINT AS source_count FROM u GROUP BY ALL")
def dml_upsert_node(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_brand").alias("description"), (F.col("p_retailprice") / 10000).alias("confidence"))
    return graph.upsert_nodes(p.where("p_partkey % 2 = 0").withColumn("source_count", F.lit(1).cast("bigint")), p.where("p_partkey % 3 = 0")).withColumn("confidence", F.round("confidence", 6))


@query(f"WITH {EDGES_SQL}, old AS (SELECT * FROM edges WHERE src % 3 <> 0), new AS (SELECT * FROM edges WHERE src % 4 = 0) SELECT coalesce(o.src, n.src) AS src, coalesce(o.dst, n.dst) AS dst, coalesce(o.kind, n.kind) AS kind, round(CASE WHEN o.weight IS NULL THEN n.weight ELSE least(1.0, o.weight + CASE WHEN n.src IS NULL THEN 0 ELSE 0.1 END) END, 6) AS weight, CASE WHEN o.src % 10 = 2 THEN 'approved' ELSE 'pending' END AS status FROM old o FULL JOIN new n ON o.src = n.src AND o.dst = n.dst")
def dml_upsert_edge(spark, d):
    e = edges(spark, d)
    old = e.where("src % 3 <> 0").withColumn("status", F.when(F.col("src") % 10 == 2, "approved").otherwise("pending"))
    return graph.upsert_edges(old, e.where("src % 4 = 0").withColumn("status", F.lit("pending")), shares(spark, table(spark, d, "lineitem").count()))
