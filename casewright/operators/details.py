"""Cases, documents and caches with all that belongs to them, a row for each child."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.shared import shares, small

#: Users of an array, about, documents of one (as many as parquet packs in a run), and pairs of a task, about.
USERS, DOCUMENTS, PAIRS = 250, 504, 200_000_000
#: Rows of a batch.
ROWS = 50_000


def children(key: str, parts: list[tuple[str, DataFrame, Column, list[Column], int | None]]) -> DataFrame:
    """(key, part, place, child) of child frames: name, rows, id, order, and how many of each parent at most."""
    out = None
    for name, rows, child, order, most in parts:
        placed = rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).select(key, F.lit(name).alias("part"), "place", child.cast("bigint").alias("child"))
        placed = placed if most is None else placed.where(F.col("place") <= most)
        out = placed if out is None else out.unionByName(placed)
    return out


def first_available(artifacts: DataFrame, key: str) -> DataFrame:
    """(key, available): the newest artifact with a document that is more than metadata. artifacts: key, artifact, document, kind, created_at."""
    good = artifacts.where(F.col("document").isNotNull() & (F.coalesce("kind", F.lit("")) != "metadata_only"))
    return good.groupBy(key).agg(F.max_by("artifact", F.struct("created_at", (-F.col("artifact")).alias("k"))).alias("available"))


def with_jobs(docs: DataFrame, jobs: DataFrame) -> DataFrame:
    """(document, status, jobs): a document's status and its jobs in order of creation as step:status. jobs: document, step, status, created_at."""
    told = F.concat_ws(":", "step", "status")
    own = jobs.groupBy("document").agg(F.array_sort(F.collect_list(F.struct("created_at", told.alias("told")))).alias("j")).select("document", F.transform("j", lambda x: x["told"]).alias("jobs"))
    return docs.join(own, "document", "left").select("document", "status", F.coalesce("jobs", F.array().cast("array<string>")).alias("jobs"))


def newest_text(extractions: DataFrame) -> DataFrame:
    """(document, text) of the newest extraction of kind TEXT. extractions: document, kind, created_at, text."""
    return extractions.where("kind = 'TEXT'").groupBy("document").agg(F.max_by("text", F.struct("created_at", "text")).alias("text"))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each user and document of arrays of both; Spark's explode would hold all pairs of a row in memory."""
    for b in batches:
        for users, documents in zip(b.column(0), b.column(1), strict=True):
            n = len(documents.values)
            step = max(1, ROWS // n)
            for at in range(0, len(users.values), step):
                some = users.values.slice(at, step)
                rows = np.arange(len(some) * n)
                yield pa.RecordBatch.from_arrays([some.take(pa.array(rows // n)), documents.values.take(pa.array(rows % n))], names=["user", "document"])


def accessible(docs: DataFrame, users: DataFrame, grants: DataFrame, now: Column, ranks: dict[str, int]) -> DataFrame:
    """(user, document): by clearance, by an unexpired grant of the document, or by one of its level.

    docs: document, level; users: user, clearance; grants: user, document, level, expires_at.
    Levels are few: documents are grouped by the levels that they bear, and each user meets each group once, so that
    the pairs themselves, as many as users times documents, are neither compared nor shuffled.  Arrays of users meet
    arrays of documents, and the users of one array follow each other with the same documents in the same order: a
    page of a file holds these many times, and pairs take little of the disk when they are written.
    """
    rank = F.create_map(*(F.lit(x) for pair in ranks.items() for x in pair))
    below = F.array_compact(F.array(*(F.when(F.try_element_at(rank, F.col("clearance")) >= n, F.lit(level)) for level, n in ranks.items())))
    grouped = docs.groupBy("document").agg(F.array_sort(F.collect_set("level")).alias("levels"))
    groups = grouped.select("levels").distinct().select("levels", F.explode("levels").alias("level"))
    live = grants.where(F.col("expires_at").isNull() | (F.col("expires_at") > now)).join(users.select("user"), "user", "left_semi")
    by_rank = users.select("user", F.explode(below).alias("level"))
    open_ = by_rank.unionByName(live.where("document is null").select("user", "level")).join(small(groups), "level").select("user", "levels").distinct()
    by_doc = live.where("document is not null").select("user", "document").distinct().join(grouped, "document").join(open_, ["user", "levels"], "left_anti")
    people, papers = users.count(), docs.count()
    chunks = open_.groupBy("levels", F.pmod(F.xxhash64("user"), F.lit(people // USERS + 1)).alias("chunk")).agg(F.array_sort(F.collect_list("user")).alias("users"))
    block = F.floor((F.row_number().over(Window.partitionBy("levels").orderBy("document")) - 1) / DOCUMENTS)
    blocks = grouped.withColumn("block", block).groupBy("levels", "block").agg(F.array_sort(F.collect_list("document")).alias("documents"))
    # few rows make very many, so that tasks are to hold as many, and not to be merged by the size of what they read
    dealt = chunks.repartition(shares(docs.sparkSession, people * papers, PAIRS))
    met = dealt.join(small(blocks, 10_000), "levels").select("users", "documents")
    kinds = (users.schema["user"].dataType, docs.schema["document"].dataType)
    each = met.mapInArrow(_pairs, f"user {kinds[0].simpleString()}, document {kinds[1].simpleString()}")
    return each.unionByName(by_doc.select("user", "document"))


def invalidated(cache: DataFrame, workspaces: DataFrame | None = None, documents: DataFrame | None = None) -> DataFrame:
    """What stays of a cache (workspace, entry, cited array) after whole workspaces (workspace) or documents (workspace, document) are invalidated."""
    if workspaces is not None:
        cache = cache.join(workspaces.select("workspace").distinct(), "workspace", "left_anti")
    if documents is not None:
        gone = cache.select("workspace", "entry", F.explode("cited").alias("document")).join(documents.distinct(), ["workspace", "document"], "left_semi").select("workspace", "entry").distinct()
        cache = cache.join(gone, ["workspace", "entry"], "left_anti")
    return cache


def history(jobs: DataFrame) -> DataFrame:
    """``jobs`` (document, job, created_at, started_at, completed_at, ...) in order of creation, with their durations; null while they run."""
    ms = (F.unix_micros("completed_at") - F.unix_micros("started_at")) / 1000
    return jobs.withColumns({"place": F.row_number().over(Window.partitionBy("document").orderBy("created_at", "job")), "duration_ms": ms})


def next_versions(known: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``new`` rows with ``version``: one more than the greatest known one of their key, in order of ``at`` within a key."""
    top = known.groupBy(key).agg(F.max("version").alias("__top"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("at"))
    return new.join(top, key, "left").withColumn("version", F.coalesce("__top", F.lit(0)) + place).drop("__top")


def page(rows: DataFrame, order: list[Column], n: int, skip: int = 0) -> DataFrame:
    """A page of rows with ``total``, the number of all rows; they are counted on their own, not in one window."""
    total = rows.agg(F.count("*").alias("total"))  # one row
    return rows.orderBy(*order).offset(skip).limit(n).crossJoin(F.broadcast(total))


def normalized_ranks(hits: DataFrame, least: float = 0.001) -> DataFrame:
    """``hits`` (q, rank, ...) with ``share``: the rank over the greatest of its query, which counts ``least`` at least."""
    top = hits.groupBy("q").agg(F.greatest(F.max("rank"), F.lit(least)).alias("__top"))
    return hits.join(top, "q").withColumn("share", F.col("rank") / F.col("__top")).drop("__top")


def changed(vectors: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (id, hash, ...) that have no vector of this very content yet. known: id, hash."""
    return vectors.join(known.select("id", "hash").distinct(), ["id", "hash"], "left_anti")


def numbered(rows: DataFrame, key: str, place: Column, source: Column, page: Column, text: Column) -> DataFrame:
    """(key, context): the passages of each key in order as numbered evidence with source and page."""
    own = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), source.alias("source"), page.cast("string").alias("page"), F.coalesce(text, F.lit("")).alias("text")))).alias("x"))
    block = lambda x, k: F.concat(F.lit("["), (k + 1).cast("string"), F.lit("] [Source: "), x["source"], F.lit(", Page "), x["page"], F.lit("]:\n"), x["text"])
    return own.select(key, F.array_join(F.transform("x", block), "\n\n").alias("context"))
