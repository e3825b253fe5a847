"""Bounded exports as files: CSV lines, JSON lines, conversations with masks and stale citations."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.functions.text import csv_cell, mask
from casewright.shared import shared_dir

MOST, DEFAULT = 10_000, 5_000
CELL = 5_000


def csv_line(columns: list[Column]) -> Column:
    """Cells by commas; a cell is quoted only where it must be, null is an empty cell."""
    return F.concat_ws(",", *(csv_cell(c.cast("string")) for c in columns))


def json_text(c: Column) -> Column:
    """A text as a JSON string."""
    inside = F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("x")))
    return F.substr(inside, F.lit(6), F.length(inside) - 6)


def export(rows: DataFrame, order: list[Column], line: Column, header: str | None, asked: int | None = None, most: int = MOST) -> str:
    """Write the first rows, at most ``most`` of them, as one text file in their order; its folder."""
    limit = min(most, max(1, asked if asked is not None else most))
    first = rows.orderBy(*order).limit(limit).select(line.alias("value"))
    folder = f"{shared_dir(rows.sparkSession)}/casewright/export-{uuid.uuid4().hex}"
    lines = first.coalesce(1)
    if header is not None:
        lines = lines.agg(F.collect_list("value").alias("v")).select(F.array_join(F.concat(F.array(F.lit(header)), F.col("v")), "\n").alias("value"))
    lines.write.text(folder)
    return folder


def lines_of(spark: SparkSession, folder: str) -> DataFrame:
    """(place, line) of an exported file whose cells hold no line feeds; the header has place 0."""
    whole = spark.read.text(f"{folder}/*.txt", wholetext=True)
    return whole.select(F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("place", "line"))


def stale_warnings(citations: DataFrame, versions: DataFrame) -> DataFrame:
    """(conv, warnings): citations of versions (version, current) that another has superseded, in order of message and index.

    citations: conv, message, index, title, version.
    """
    old = versions.where("not current").select("version")
    said = F.concat(F.lit('Citation "'), "title", F.lit('" references a superseded document version'))
    hits = citations.join(old, "version", "left_semi").select("conv", F.struct("message", "index", said.alias("said")).alias("x"))
    return hits.groupBy("conv").agg(F.array_sort(F.collect_list("x")).alias("x")).select("conv", F.transform("x", lambda x: x["said"]).alias("warnings"))


def conversations(messages: DataFrame, citations: DataFrame, versions: DataFrame, masked: bool = True) -> DataFrame:
    """(conv, csv, warnings): each conversation as CSV of JSON strings, and its stale citations.

    messages: conv, message, role, content, created_at (texts); a conversation is one file.
    """
    cited = citations.groupBy("conv", "message").agg(F.array_sort(F.collect_list(F.struct("index", "title"))).alias("c")).select("conv", "message", F.array_join(F.transform("c", lambda c: c["title"]), "; ").alias("cited"))
    content = F.coalesce("content", F.lit(""))
    cells = [F.col("role"), F.left(mask(content) if masked else content, F.lit(CELL)), F.col("created_at"), F.col("cited")]
    line = F.concat_ws(",", *(json_text(c) for c in cells))
    rows = messages.join(cited, ["conv", "message"], "left").groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("message", line.alias("line")))).alias("rows"))
    csv = F.array_join(F.concat(F.array(F.lit("role,content,created_at,citations")), F.transform("rows", lambda r: r["line"])), "\n")
    none = F.array().cast("array<string>")
    return rows.select("conv", csv.alias("csv")).join(stale_warnings(citations, versions), "conv", "left").withColumn("warnings", F.coalesce("warnings", none))
