"""Training-corpus pipeline over the table documents.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept and returns the columns of documents, the last one its packed pieces.  A
stage's result is written as parquet in the shared folder and read again.

Defined cases, in all stages: rows with a null id stay until packing, which
packs them as well; a null or empty text has no language and goes in the first
stage; rows that repeat an id are judged together by the stages that remove
documents; columns besides those of documents pass through, all but the last;
an empty table stays empty.  Very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.llm import decontaminate, langid, line_dedup, minhash, packing
from casewright.llm.storage import materialize, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models recognise."""
    model = langid.train(docs.where(langid.fold() != 0))
    return langid.accepted(docs, model)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that other documents hold too; n_chars follows."""
    out = line_dedup.dedup_lines(docs).withColumn("text", F.col("__kept_text"))
    return out.withColumn("n_chars", F.char_length("text").cast("bigint")).select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, five-word shingles at 0.8."""
    return _without(docs, minhash.near_duplicates(docs, n=5).where("not keep"))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return _without(docs, decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 4096 tokens."""
    return packing.pack(docs)


def _without(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Rows but those whose id is among ``found.doc``; rows with a null id stay."""
    gone = materialize(found.select(F.col("doc").alias("__doc")).distinct(), "gone")
    return docs.join(gone, docs["doc_id"] == gone["__doc"], "left_anti")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_duplicate_stage),
    ("decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: Stages 1, 3, 4 and 5 lie outside SQL; a brute-force version tests the whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
