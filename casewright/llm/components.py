"""Connected components by min-label hooking with pointer jumping.

Every round is joins and aggregations over edge and label tables that are
written to the shared folder; no link or label reaches the driver, only a
count of labels that still move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm.storage import materialize, release


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for each id on an edge (a, b); component is the least id.

    Each round hooks the label of a node to the least label among its
    neighbours, then follows labels once, so that paths halve.
    """
    spark = edges.sparkSession
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).where(F.col("a") != F.col("b")).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        hooked = labels.join(near, "id").select("id", "component", F.least("component", "m").alias("low"))
        # roots take the least label that any of their members saw
        roots = hooked.groupBy(F.col("component").alias("root")).agg(F.min("low").alias("down"))
        moved = hooked.join(roots, hooked["component"] == roots["root"]).select("id", F.col("component").alias("was"), F.least("low", "down").alias("component"))
        moved = materialize(moved, "labels")
        jump = moved.select(F.col("id").alias("up"), F.col("component").alias("top"))
        after = moved.join(jump, moved["component"] == jump["up"]).select("id", "was", F.least("component", "top").alias("component"))
        after = materialize(after, "labels")
        changing = after.where(F.col("was") != F.col("component")).limit(1).count()
        release(spark, moved)
        release(spark, labels)
        labels = after.select("id", "component")
        if not changing:
            release(spark, both)
            return labels
    raise RuntimeError(f"labels still move after {max_rounds} rounds")


def extended(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels after further links (a, b); only links between components are followed."""
    if labels is None:
        return components(links)
    cross = links.select("a", "b")
    for end in "ab":
        own = labels.select(F.col("id").alias(end), F.col("component").alias("__top"))
        cross = cross.join(own, end, "left").withColumn(end, F.coalesce("__top", end)).drop("__top")
    cross = materialize(cross.where("a != b").distinct(), "cross")
    if cross.isEmpty():
        return labels
    merged = components(cross)
    moved = labels.join(merged.select(F.col("id").alias("component"), F.col("component").alias("low")), "component", "left").select("id", F.coalesce("low", "component").alias("component"))
    new = merged.join(labels.select("id"), "id", "left_anti").select("id", "component")
    return materialize(moved.unionByName(new), "labels")
