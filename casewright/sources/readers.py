"""Sources and sinks by Spark's own readers, with rows that don't parse kept aside."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.shared import shared_dir


def csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; a byte-order mark goes from the first name."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return df.toDF(*(c.lstrip("﻿") for c in df.columns))


def parquet_by_name(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files of differing schemas as one frame; missing columns are null."""
    return spark.read.option("mergeSchema", True).parquet(*paths)


def json_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, quarantine): an id and a text from the first non-empty of several fields; never commercial."""
    raw = spark.read.text(path).where("trim(value) <> ''")

    def first(*names: str):
        return F.coalesce(*(F.nullif(F.btrim(F.get_json_object("value", f"$.{n}")), F.lit("")) for n in names))

    rows = raw.select(first("id", "case_id", "doc_id").alias("id"), first("text", "body", "judgment").alias("text"), F.lit(False).alias("commercial_safe"), F.lit("non_commercial").alias("license"), "value")
    good = F.col("id").isNotNull() & F.col("text").isNotNull()
    return rows.where(good).drop("value"), rows.where(~good).select("value")


def xml_listing(rows: DataFrame, column: str = "xml") -> DataFrame:
    """Keys and sizes of an object listing."""
    keys, sizes = F.xpath(F.col(column), F.lit("//Contents/Key/text()")), F.xpath(F.col(column), F.lit("//Contents/Size/text()"))
    return rows.select(F.explode(F.arrays_zip(keys.alias("key"), sizes.alias("size"))).alias("x")).select("x.key", F.col("x.size").cast("bigint").alias("size"))


def text_file(rows: DataFrame) -> str:
    """Path of a text file in the shared folder with a line for each row (value)."""
    path = f"{shared_dir(rows.sparkSession)}/casewright/text-{uuid.uuid4().hex}"
    rows.write.text(path)
    return path


def case_fields(page: Column) -> Column:
    """map<label, value> of the two-column rows of a page; labels in lower case without colons."""
    rows = F.regexp_extract_all(page, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)
    plain = lambda c: F.btrim(F.regexp_replace(c, "<[^>]+>", ""))
    cells = F.transform(rows, lambda r: F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), 1))
    pairs = F.transform(F.filter(cells, lambda c: F.size(c) == 2), lambda c: F.struct(F.btrim(F.regexp_replace(F.lower(plain(c[0])), r"\s*:$", "")).alias("key"), plain(c[1]).alias("value")))
    return F.map_from_entries(pairs)


def rules(spark: SparkSession, path: str) -> DataFrame:
    """(category, sections) of files with lists of flat mappings, a small subset of YAML; one row a mapping.

    A mapping begins with a dash at the start of a line; comments and unknown names are passed over.
    """
    files = spark.read.text(path, wholetext=True)
    entries = F.slice(F.split(F.concat(F.lit("\n"), F.regexp_replace("value", r"(?m)^\s*#.*$", "")), "\n- "), 2, 1_000_000_000)
    each = files.select(F.explode(entries).alias("e"))
    value = lambda name: F.nullif(F.regexp_extract("e", rf"(?m)^\s*{name}\s*:[ \t]*(.*?)[ \t]*$", 1), F.lit(""))
    bare = lambda c: F.regexp_replace(F.btrim(c), "^['\"]|['\"]$", "")
    items = F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(value("sections"), F.lit("")), r"^\[|\]$", ""), ","), bare), lambda x: x != "")
    return each.select(bare(value("category")).alias("category"), items.alias("sections")).where("category is not null")


def object_key(raw: Column, bucket: str) -> Column:
    """struct(key, year, court, error) of an object's address; the key is null where it may not be read."""
    k = F.btrim(raw)
    for pattern in (r"^https://[^/]+\.s3(?:[.-][^/]+)?\.amazonaws\.com/", r"^s3://[^/]+/", f"^{bucket}/", "^/+"):
        k = F.regexp_replace(k, pattern, "")
    error = F.when((k == "") | k.rlike(r"\.\.|[?#]"), "invalid key").when(~F.startswith(k, F.lit("data/")), "not under data/").when(~F.lower(k).endswith(".pdf"), "not a PDF")
    part = lambda p: F.when(error.isNull(), F.nullif(F.regexp_extract(k, p, 1), F.lit("")))
    court = part(r"(?:^|/)court=([^/]+)(?:/|$)")
    return F.struct(F.when(error.isNull(), k).alias("key"), part(r"(?:^|/)year=(\d{4})(?:/|$)").cast("int").alias("year"), F.url_decode(court).alias("court"), error.alias("error"))


# What a link to a judgment's file looks like, dates, and wording of final orders.
FILES, DATED, FINAL = r"(?i)(?:view_?order|display_pdf|order_?pdf|viewpdf|\.pdf)", r"(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})", r"(?i)judg|final order|disposed|disposal"


def order_links(pages: DataFrame) -> DataFrame:
    """(page_id, place, ref, order_date, label, is_judgment): links to order files of case pages (page_id, html), each once.

    The date and the wording come from the link and its table row.  Links
    outside of rows follow those in rows.
    """
    plain = lambda c: F.btrim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " "))
    anchors = lambda c: F.regexp_extract_all(c, F.lit(r"(?is)<a\s[^>]*>.*?</a>"), 0)
    rows = F.regexp_extract_all("html", F.lit(r"(?is)<tr[^>]*>.*?</tr>"), 0)
    inside = F.flatten(F.transform(rows, lambda r: F.transform(anchors(r), lambda a: F.struct(a.alias("a"), plain(r).alias("row")))))
    outside = F.transform(anchors(F.regexp_replace("html", r"(?is)<tr[^>]*>.*?</tr>", " ")), lambda a: F.struct(a.alias("a"), F.lit("").alias("row")))
    each = pages.select("page_id", F.posexplode(F.concat(inside, outside)).alias("k", "x")).select("page_id", "k", "x.a", "x.row")
    href = F.regexp_extract("a", r"(?is)\shref\s*=\s*[\"']([^\"']*)[\"']", 1)
    click = F.coalesce(F.nullif(F.regexp_extract("a", r'(?is)\sonclick\s*=\s*"([^"]*)"', 1), F.lit("")), F.regexp_extract("a", r"(?is)\sonclick\s*=\s*'([^']*)'", 1))
    quoted = F.filter(F.regexp_extract_all(click, F.lit("['\"]([^'\"]+)['\"]"), 1), lambda v: v.rlike(FILES) | F.contains(v, F.lit("=")))
    ref = F.when(href.rlike(FILES), href).when(click.rlike(FILES), F.get(quoted, F.lit(0)))
    told = each.select("page_id", "k", ref.alias("ref"), plain(F.col("a")).alias("label"), F.concat_ws(" ", plain(F.col("a")), "row").alias("said")).where("ref is not null")
    first = told.groupBy("page_id", "ref").agg(F.min_by(F.struct("k", "label", "said"), "k").alias("x"))
    date = F.nullif(F.regexp_extract("x.said", DATED, 1), F.lit(""))
    return first.select("page_id", F.col("x.k").alias("place"), "ref", date.alias("order_date"), F.coalesce(F.nullif("x.label", F.lit("")), F.lit("order")).alias("label"), F.col("x.said").rlike(FINAL).alias("is_judgment"))


def chosen_orders(links: DataFrame) -> DataFrame:
    """(page_id, ref): of each page the newest link worded as a judgment, else the newest of all; undated ones are oldest."""
    parts = F.transform(F.split("order_date", "[-/]"), lambda p: p.cast("int"))
    year = F.when(parts[2] < 100, parts[2] + 2000).otherwise(parts[2])
    when = F.coalesce(F.struct(year.alias("y"), parts[1].alias("m"), parts[0].alias("d")), F.struct(F.lit(0).alias("y"), F.lit(0).alias("m"), F.lit(0).alias("d")))
    when = F.when(F.col("order_date").isNull(), F.struct(F.lit(0).alias("y"), F.lit(0).alias("m"), F.lit(0).alias("d"))).otherwise(when)
    return links.groupBy("page_id").agg(F.max_by("ref", F.struct("is_judgment", when.alias("w"), (-F.col("place")).alias("p"))).alias("ref"))
