"""Line deduplication, DataFrame functions only.

Lines become (128-bit hash, document, position) rows that are range
partitioned on hash and document with a secondary sort on position.  A line
that a third of the corpus shares is therefore cut at document borders over
several ranges; every range streams its runs into one row per (hash,
document), then into one count row per hash, and only those counts meet.
The result is a run-length coded keep bitmap per document, never text.

Defined cases: null or empty text is one empty line; a key shorter than
``min_chars`` is never dropped; rows with a null id stay whole and count as no
document; repeated rows of one id are one document, and each row loses its own
lines only; an empty table gives an empty result; other columns pass through
untouched.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.llm.storage import materialize

BLANK = " \t\n\x0b\x0c\r"


def ascii_lower(c: Column) -> Column:
    """A-Z only; the built-in lower() is right, and fast, where all is ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, string.ascii_uppercase, string.ascii_lowercase))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_occurrences(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(h1, h2, doc, text, pos): one row for each line whose key is long enough; text is a hash."""
    lines = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("text"), F.posexplode(split_lines(ascii_lower(F.col(text_col)))).alias("pos", "line"))
    key = F.btrim(F.col("line"), F.lit(BLANK))
    return lines.select("doc", "text", "pos", key.alias("key")).where(F.char_length("key") >= min_chars).select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(0x5EED), "key").alias("h2"), "doc", "text", "pos")


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Documents that lose lines: (doc, dropped), the dropped (text, pos) of all rows of the id.

    A key found in ``min_docs`` documents stays only in the largest id that
    holds it.
    """
    rows = line_occurrences(docs, id_col, text_col, min_chars)
    held = rows.repartitionByRange(F.col("h1"), F.col("h2"), F.col("doc")).sortWithinPartitions("h1", "h2", "doc", "text", "pos").groupBy("h1", "h2", "doc").agg(F.collect_list(F.struct("text", "pos")).alias("pos"))
    held = materialize(held, "lines")
    # written, so that the join reads two plain exchanges and a hot line's partition can be split
    shared = materialize(held.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc").alias("last")).where(F.col("n") >= min_docs).drop("n"), "shared")
    lost = held.join(shared, ["h1", "h2"]).where(F.col("doc") < F.col("last"))
    return lost.groupBy("doc").agg(F.flatten(F.collect_list("pos")).alias("dropped"))


def keep_runs(dropped: Column, n_lines: Column) -> Column:
    """Run-length keep bitmap: array of (start, len) of the lines that stay."""
    ends = F.concat(F.array(F.lit(-1)), dropped, F.array(n_lines))
    runs = F.transform(F.slice(ends, 1, F.size(ends) - 1), lambda x, i: F.struct((x + 1).alias("start"), (F.get(ends, i + 1) - x - 1).alias("len")))
    return F.filter(runs, lambda r: r["len"] > 0)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with ``__n_lines``, ``__n_dropped``, ``__keep`` and ``__kept_text`` added."""
    maps = keep_bitmaps(docs, id_col, text_col, min_chars, min_docs).select(F.col("doc").alias("__doc"), F.col("dropped").alias("__dropped"))
    own = F.filter("__dropped", lambda x: x["text"] == F.col("__row"))
    hashed = docs.withColumn("__row", F.xxhash64(text_col))  # below the join, so that it is computed once a row
    joined = hashed.join(maps, hashed[id_col] == maps["__doc"], "left").withColumn("__dropped", F.array_sort(F.array_distinct(F.transform(own, lambda x: x["pos"]))))
    lines = split_lines(F.col(text_col))
    n_lines = F.size(lines)
    runs = keep_runs(F.coalesce("__dropped", F.array().cast("array<int>")), n_lines)
    kept = F.array_join(F.flatten(F.transform(runs, lambda r: F.slice(lines, r["start"] + 1, r["len"]))), "\n")
    out = joined.withColumn("__n_lines", n_lines.cast("long")).withColumn("__n_dropped", F.coalesce(F.size("__dropped"), F.lit(0)).cast("long"))
    return out.withColumn("__keep", runs).withColumn("__kept_text", F.when(F.col("__n_dropped") > 0, kept).otherwise(F.coalesce(text_col, F.lit("")))).drop("__doc", "__dropped", "__row")
