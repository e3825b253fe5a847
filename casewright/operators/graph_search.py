"""Nodes by words, names, aliases and properties, and the nodes that a question starts from.

nodes: (id, name, subtype, aliases, properties, source_count).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions.text import jaccard, trigrams
from casewright.operators import fulltext
from casewright.operators.search import cosine, trigram_join

LIKE_ENOUGH = 0.2


def node_search(nodes: DataFrame, index: DataFrame, asked: str, most: int = 50, skip: int = 0) -> DataFrame:
    """(id, density, similarity): nodes that the words find, or whose name, subtype, aliases or properties resemble the text.

    By density, then similarity, source_count and name; an empty text lists all by source_count and name.
    """
    low = asked.strip().lower()
    if not low:
        return nodes.select("id", F.lit(None).cast("double").alias("density"), F.lit(0.0).alias("similarity"), "source_count", "name").orderBy(F.desc("source_count"), "name", "id").offset(skip).limit(most).drop("source_count", "name")
    found = fulltext.websearch(index, nodes, low)
    like = lambda c: jaccard(trigrams(F.coalesce(c, F.lit(""))), trigrams(F.lit(low)))
    rows = nodes.join(found, "id", "left").withColumns({"__n": like("name"), "__s": like("subtype")})
    held = F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.contains(F.lower(a), F.lit(low)))
    keep = F.col("density").isNotNull() | (F.col("__n") > LIKE_ENOUGH) | (F.col("__s") > LIKE_ENOUGH) | held | F.contains(F.lower(F.coalesce("properties", F.lit(""))), F.lit(low))
    best = rows.where(keep).withColumn("similarity", F.greatest("__n", "__s"))
    return best.orderBy(F.desc_nulls_last("density"), F.desc("similarity"), F.desc("source_count"), "name", "id").offset(skip).limit(most).select("id", "density", "similarity")


def seeds(vectors: DataFrame, question: DataFrame, names: DataFrame, entities: DataFrame, near: int = 10, named: int = 25, least: float = 0.3) -> DataFrame:
    """(id, via, similarity): the nearest nodes by vector that are near enough, then nodes whose names resemble an entity's.

    vectors: id, vec; question: one row v; names and entities: id, name.
    """
    by_vector = vectors.crossJoin(F.broadcast(question.limit(1))).select("id", cosine(F.col("vec"), F.col("v")).alias("similarity")).orderBy(F.desc("similarity"), "id").limit(near).where(F.col("similarity") > least)
    # many nodes bear one name: names are compared, each once, and then stand for their nodes
    own, asked = names.where("name is not null").groupBy("name").agg(F.min("id").alias("id")), entities.where("name is not null").groupBy("name").agg(F.min("id").alias("id"))
    like = trigram_join(own, asked, least).groupBy(F.col("a").alias("id")).agg(F.max("similarity").alias("similarity"))
    found = like.join(own, "id").select("name", "similarity")
    by_name = names.join(found, "name").groupBy("id").agg(F.max("similarity").alias("similarity")).orderBy("id").limit(named)
    both = by_vector.select("id", F.lit("vector").alias("via"), "similarity").unionByName(by_name.select("id", F.lit("name").alias("via"), "similarity"))
    once = Window.partitionBy("id").orderBy(F.desc("via"))
    return both.withColumn("__k", F.row_number().over(once)).where("__k = 1").drop("__k")


def articles(vectors: DataFrame, question: DataFrame, ranks: DataFrame, most: int = 10, weights: tuple[float, float] = (0.65, 0.35)) -> DataFrame:
    """(id, score): articles by weighted similarity and rank, then confidence, then the newest.

    vectors: id, vec, confidence, updated; question: one row v; ranks: id, rank, absent for no rank.
    """
    near = vectors.crossJoin(F.broadcast(question.limit(1))).join(ranks.select("id", "rank"), "id", "left")
    score = weights[0] * cosine(F.col("vec"), F.col("v")) + weights[1] * F.coalesce("rank", F.lit(0.0))
    return near.withColumn("score", score).orderBy(F.desc(F.round("score", 9)), F.desc("confidence"), F.desc("updated"), "id").limit(most).select("id", "score")
