"""Seeds of searches, fetched evidence, gaps, and traces of what an answer was made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEARCHABLE = ["SEARCHABLE", "KG_EXTRACTING", "ACTIVE"]
FETCHED = 0.75


def _top(articles: DataFrame, most: int) -> DataFrame:
    return articles.withColumn("__k", F.row_number().over(Window.partitionBy("q").orderBy("place"))).where(F.col("__k") <= most)


def _sections(c: Column) -> Column:
    return F.transform(c, lambda s: F.concat(F.lit("Section "), s))


def wiki_seeds(questions: DataFrame, articles: DataFrame, most: int = 3) -> DataFrame:
    """(q, k, seed): the question beside title, statutes, sections and issues of each of its first articles.

    questions: q, text; articles: q, place, title, statutes, sections, issues.
    """
    parts = [F.col("text"), F.col("title"), F.array_join("statutes", " "), F.array_join(_sections(F.col("sections")), " "), F.array_join("issues", " ")]
    said = F.array_join(F.filter(F.array(*(F.coalesce(p, F.lit("")) for p in parts)), lambda p: p != ""), " ")
    return _top(articles, most).join(questions, "q").select("q", F.col("__k").alias("k"), said.alias("seed"))


def graph_seeds(questions: DataFrame, articles: DataFrame, most: int = 3) -> DataFrame:
    """(q, seed): the question and what its first articles name, each once, by line feeds."""
    named = F.concat(F.array("title"), "issues", "statutes", _sections(F.col("sections")))
    own = _top(articles, most).select("q", F.struct("__k", named.alias("names")).alias("x")).groupBy("q").agg(F.array_sort(F.collect_list("x")).alias("x"))
    names = F.coalesce(F.flatten(F.transform("x", lambda x: x["names"])), F.array().cast("array<string>"))
    return questions.join(own, "q", "left").select("q", F.array_join(F.array_distinct(F.concat(F.array("text"), names)), "\n").alias("seed"))


def fetched(chunks: DataFrame, documents: DataFrame, wanted: DataFrame, similarity: float = FETCHED) -> DataFrame:
    """(q, chunk, document, similarity): wanted chunks (q, chunk) of searchable documents as hits of a fixed similarity."""
    live = documents.where(F.col("status").isin(SEARCHABLE)).select("document")
    return wanted.distinct().join(chunks.select("chunk", "document"), "chunk").join(live, "document", "left_semi").select("q", "chunk", "document", F.lit(similarity).alias("similarity"))


def with_gaps(log: DataFrame, asked: DataFrame) -> DataFrame:
    """The gap log (q, text, profile, evidence, approved) with a row for each question that has evidence and no approved article."""
    new = asked.where((F.coalesce("approved", F.lit(0)) == 0) & (F.coalesce("evidence", F.lit(0)) > 0))
    return log.unionByName(new.select(*log.columns))


def recorded(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs, steps): retrieval runs with counts and total time, and their steps numbered from 1.

    runs: run, query, cache_hit, steps array<struct<key, title, status, latency_ms, items>>.
    """
    total = F.aggregate("steps", F.lit(0).cast("bigint"), lambda n, s: n + F.coalesce(s["latency_ms"], F.lit(0).cast("bigint")))
    items = F.map_from_entries(F.transform("steps", lambda s: F.struct(s["key"], s["items"])))
    head = runs.select("run", "query", "cache_hit", *(F.coalesce(F.try_element_at(items, F.lit(k)), F.lit(0).cast("bigint")).alias(f"{k}_results") for k in ("vector", "lexical", "graph")), total.alias("total_latency_ms"))
    steps = runs.select("run", F.posexplode("steps").alias("k", "s")).select("run", (F.col("k") + 1).alias("step"), "s.key", "s.title", "s.status", "s.latency_ms", "s.items")
    return head, steps


def trace(head: DataFrame, steps: DataFrame) -> DataFrame:
    """Runs with ``steps``: their steps as lines in order."""
    line = F.concat_ws(" ", F.concat(F.col("step").cast("string"), F.lit(".")), "title", F.concat(F.lit("["), "status", F.lit("]")), F.concat(F.col("latency_ms").cast("string"), F.lit(" ms")))
    own = steps.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("step", line.alias("line")))).alias("s")).select("run", F.transform("s", lambda s: s["line"]).alias("steps"))
    return head.join(own, "run", "left").withColumn("steps", F.coalesce("steps", F.array().cast("array<string>")))
