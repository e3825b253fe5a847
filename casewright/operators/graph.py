"""Property graphs as node and edge tables; every hop is a join.

edges: (edge_id, src, dst, kind, weight).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.shared import written


def touching(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end among ``nodes`` (node): two equi-joins and a union, no OR join."""
    return edges.join(nodes, edges["src"] == nodes["node"], "left_semi").union(edges.join(nodes, edges["dst"] == nodes["node"], "left_semi")).dropDuplicates(["edge_id"])


def expand(edges: DataFrame, seeds: DataFrame, hops: int = 2, least: float = 0.55, per_hop: int = 50) -> DataFrame:
    """(edge_id, hop): heavy edges at all visited nodes, the heaviest ``per_hop`` of each hop, each edge once."""
    heavy, visited, out = written(edges.where(F.col("weight") >= least), "heavy"), seeds.select("node").distinct(), None
    for hop in range(1, hops + 1):
        found = written(touching(heavy, visited).orderBy(F.desc("weight"), "edge_id").limit(per_hop), "hop")
        step = found.select("edge_id", "src", "dst", "weight", F.lit(hop).alias("hop"))
        out = step if out is None else out.unionByName(step)
        visited = visited.union(found.select("src")).union(found.select("dst")).distinct()
    return out.groupBy("edge_id").agg(F.min("hop").alias("hop"), F.first("weight").alias("weight"))


def explore(edges: DataFrame, start: DataFrame, hops: int = 3, per_hop: int = 200) -> DataFrame:
    """(node, hop): breadth first, at most ``per_hop`` new nodes a hop in id order."""
    edges, frontier = written(edges.select("src", "dst"), "edges"), start.select("node").distinct()
    seen = frontier.select("node", F.lit(0).alias("hop"))
    for hop in range(1, hops + 1):
        near = edges.join(frontier, edges["src"] == frontier["node"]).select(F.col("dst").alias("n")).union(edges.join(frontier, edges["dst"] == frontier["node"]).select(F.col("src").alias("n"))).distinct()
        frontier = written(near.join(seen, near["n"] == seen["node"], "left_anti").orderBy("n").limit(per_hop).select(F.col("n").alias("node")), "frontier")
        seen = seen.union(frontier.select("node", F.lit(hop).alias("hop")))
    return seen


def degrees(edges: DataFrame) -> DataFrame:
    """Ends of each node; a loop counts twice."""
    return edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).groupBy("node").agg(F.count("*").alias("degree"))


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row a (name, kind): counts rise once a batch, confidence is greatest, the longest description stays.

    Columns: name, kind, description, confidence, source_count.
    """
    batch = new.groupBy("name", "kind").agg(F.max("confidence").alias("confidence"), F.max_by("description", F.struct(F.length("description"), F.col("description"))).alias("description")).withColumn("source_count", F.lit(1).cast("bigint"))
    both = old.select("name", "kind", "description", "confidence", "source_count").unionByName(batch)
    return both.groupBy("name", "kind").agg(F.max_by("description", F.struct(F.length("description"), F.col("description"))).alias("description"), F.max("confidence").alias("confidence"), F.sum("source_count").alias("source_count"))


def upsert_edges(old: DataFrame, new: DataFrame, parts: int | None = None) -> DataFrame:
    """Each repeat adds 0.1 up to 1.0; approved stays approved. Columns: src, dst, kind, weight, status.

    ``parts``: the partitions by ends in which both meet if all are of one kind; else Spark chooses those of the join.
    """
    keys = ["src", "dst", "kind"]
    if parts:
        old, new = old.repartition(parts, "src", "dst"), new.repartition(parts, "src", "dst")
    hits = new.groupBy(*keys).agg(F.count("*").alias("n"), F.max("weight").alias("w"), F.max("status").alias("s"))
    j = old.join(hits, keys, "full")
    weight = F.when(F.col("weight").isNull(), F.least(F.lit(1.0), F.col("w") + 0.1 * (F.col("n") - 1))).otherwise(F.least(F.lit(1.0), F.col("weight") + 0.1 * F.coalesce("n", F.lit(0))))
    status = F.when(F.col("status") == "approved", "approved").otherwise(F.coalesce("s", "status"))
    return j.select("src", "dst", "kind", F.round(weight, 6).alias("weight"), status.alias("status"))
