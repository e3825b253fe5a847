"""Claims, reviews and provenance of extracted graph edges, and their text for an answer.

edges: (edge_id, source, target, kind, description, confidence, chunk, document, review_status, quote).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.operators.graph import touching

# Edge types that make claims, those of high impact among them, and the kinds of claims.
HIGH_IMPACT = ["outcome_caused_by", "supports_acquittal", "supports_conviction", "lapse_caused_doubt", "non_compliance_with", "evidence_rejected_because"]
CLAIMING = [*HIGH_IMPACT, "holding_supported_by", "reason_based_on", "finding_on", "later_treated_as"]
CLAIM_KINDS = {
    "outcome_reason": ["outcome_caused_by", "supports_acquittal", "supports_conviction", "lapse_caused_doubt"],
    "procedural_defect": ["non_compliance_with", "evidence_rejected_because"],
    "authority_treatment": ["later_treated_as"],
}
OTHER_CLAIM, CATEGORY = "finding_of_law", "legal_kg_high_impact"
WEAK = 0.85


def _confidence() -> Column:
    return F.coalesce("confidence", F.lit(1.0))


def assertions(edges: DataFrame) -> DataFrame:
    """A claim for each edge of a claiming type."""
    kind = F.lit(OTHER_CLAIM)
    for name, types in CLAIM_KINDS.items():
        kind = F.when(F.col("kind").isin(types), name).otherwise(kind)
    return edges.where(F.col("kind").isin(CLAIMING)).select(
        kind.alias("assertion_type"), F.col("source").alias("subject"), F.col("kind").alias("predicate"), F.col("target").alias("object"), F.coalesce("description", F.lit("")).alias("object_value"),
        _confidence().alias("confidence"), "edge_id", "chunk", "document", F.coalesce("review_status", F.lit("unreviewed")).alias("review_status"), F.col("kind").isin(HIGH_IMPACT).alias("high_impact"),
    )


def reviews(edges: DataFrame) -> DataFrame:
    """(edge_id, document, reason, category, priority) of edges of high impact or low confidence."""
    high, weak = F.col("kind").isin(HIGH_IMPACT), _confidence() < WEAK
    reasons = [
        F.when(high, F.format_string("High-impact legal edge '%s' requires review", "kind")),
        F.when(weak, F.format_string("Low-confidence legal edge: %.2f", _confidence())),
        F.when(high & (F.coalesce("quote", F.lit("")) == ""), "Missing quoted source span"),
    ]
    return edges.where(high | weak).select("edge_id", "document", F.concat_ws("; ", *reasons).alias("reason"), F.lit(CATEGORY).alias("category"), F.when(high, 90).otherwise(50).alias("priority"))


def provenance(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(entity_type, entity_id, chunk, document, confidence, claim_type, review_status) of all nodes (node, chunk, document) and edges."""
    own = nodes.select(F.lit("NODE").alias("entity_type"), F.col("node").alias("entity_id"), "chunk", "document", F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("claim_type"), F.lit("unreviewed").alias("review_status"))
    return own.unionByName(edges.select(F.lit("EDGE").alias("entity_type"), F.col("edge_id").alias("entity_id"), "chunk", "document", _confidence().alias("confidence"), F.col("kind").alias("claim_type"), F.coalesce("review_status", F.lit("unreviewed")).alias("review_status")))


def evidence(edges: DataFrame, claims: DataFrame, nodes: DataFrame, most: int = 100, best: int = 25) -> DataFrame:
    """(chunk, via): chunks of edges at the nodes (node), the first ``most`` by id, and of the ``best`` claims about them."""
    near = touching(edges.select("edge_id", F.col("source").alias("src"), F.col("target").alias("dst"), "chunk"), nodes)
    chunks = near.where("chunk is not null").select("chunk").distinct().orderBy("chunk").limit(most)
    return chunks.select("chunk", F.lit("edge").alias("via")).unionByName(about(claims, nodes, best).where("chunk is not null").select("chunk", F.lit("assertion").alias("via")).distinct())


def about(claims: DataFrame, nodes: DataFrame, best: int = 25) -> DataFrame:
    """The ``best`` claims with a subject or object among the nodes, by confidence, then edge."""
    ends = claims.withColumns({"src": F.col("subject"), "dst": F.col("object")})
    return touching(ends, nodes).drop("src", "dst").orderBy(F.desc("confidence"), "edge_id").limit(best)


def node_line(kind: Column, subtype: Column, name: Column, description: Column) -> Column:
    label = F.when(F.coalesce(subtype, F.lit("")) != "", F.concat(kind, F.lit("/"), subtype)).otherwise(kind)
    return F.concat(F.lit("["), label, F.lit("] "), name, F.lit(": "), F.coalesce(F.nullif(description, F.lit("")), F.lit("No description")))


def edge_line(source: Column, kind: Column, target: Column) -> Column:
    return F.concat(F.lit("Relationship: "), source, F.lit(" --["), kind, F.lit("]--> "), target)


def claim_line(kind: Column, predicate: Column, value: Column, status: Column) -> Column:
    return F.concat(F.lit("Assertion: ["), kind, F.lit("] "), predicate, F.lit(": "), F.coalesce(F.nullif(value, F.lit("")), F.lit("No value")), F.lit(" (review: "), F.coalesce(status, F.lit("unknown")), F.lit(")"))


def context(nodes: DataFrame, edges: DataFrame, claims: DataFrame, best: int = 25) -> DataFrame:
    """(q, context): lines of nodes, then edges, then the best claims. All three frames: (q, place, line)."""
    first = claims.withColumn("__k", F.row_number().over(Window.partitionBy("q").orderBy("place"))).where(F.col("__k") <= best).drop("__k")
    parts = [f.select("q", F.struct(F.lit(n).alias("part"), F.col("place").cast("double").alias("place"), "line").alias("x")) for n, f in enumerate((nodes, edges, first))]
    lines = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("q").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return lines.select("q", F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("context"))


def detail(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, name, place, edge_id, other, outgoing, weight): a node's edges by weight; one row without an edge for a lone node.

    nodes: node, name; edges: edge_id, src, dst, weight.
    """
    ends = edges.select("edge_id", F.col("src").alias("node"), F.col("dst").alias("other"), F.lit(True).alias("outgoing"), "weight").unionByName(edges.select("edge_id", F.col("dst").alias("node"), F.col("src").alias("other"), F.lit(False).alias("outgoing"), "weight"))
    placed = ends.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("weight"), "edge_id", "outgoing")))
    return nodes.join(placed, "node", "left").select("node", "name", "place", "edge_id", "other", "outgoing", "weight")
