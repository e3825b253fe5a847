"""Tables, lists, page marks, full-text search and names over documents, conversations and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.functions import text
from casewright.operators import search, tables
from casewright.registry import query, table

MARKED_SQL = r"""marked AS (SELECT p_partkey AS id, '<!-- PAGE ' || (1 + p_size % 3) || ' -->' || E'\nx\n<!-- TABLE_START -->\nName|Size||Name\n' || p_name || '|' || p_size || E'\n' || p_brand || E'||7|8|9\n<!-- TABLE_END -->\ntail\n' || CASE WHEN p_size % 2 = 0 THEN '<!-- PAGE 9 -->' ELSE '' END || E'\n<!-- TABLE_START -->\nonly one row\n<!-- TABLE_END -->' AS text FROM part)"""


def _marked(spark, d):
    t = lambda s: F.lit(s)
    body = F.concat(t("<!-- PAGE "), (1 + F.col("p_size") % 3).cast("string"), t(" -->\nx\n<!-- TABLE_START -->\nName|Size||Name\n"), "p_name", t("|"), F.col("p_size").cast("string"), t("\n"), "p_brand", t("||7|8|9\n<!-- TABLE_END -->\ntail\n"), F.when(F.col("p_size") % 2 == 0, "<!-- PAGE 9 -->").otherwise(""), t("\n<!-- TABLE_START -->\nonly one row\n<!-- TABLE_END -->"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_size", "p_brand", body.alias("text"))


@query("SELECT p_partkey AS id, 1 AS tables, ['Name', 'Size', 'Name'] AS headers, [[p_name, p_size::VARCHAR], [p_brand, '7', '8', '9']] AS rows FROM part")
def txt_table_parse(spark, d):
    """Marked tables as headers and rows; a table of one row is none."""
    t = tables.parsed(F.col("text"))
    return _marked(spark, d).select("id", F.size(t).alias("tables"), t[0]["headers"].alias("headers"), t[0]["rows"].alias("rows"))


@query("SELECT p_partkey AS id, [1 + p_size % 3, CASE WHEN p_size % 2 = 0 THEN 9 ELSE 1 + p_size % 3 END] AS pages FROM part")
def txt_table_pages(spark, d):
    return _marked(spark, d).select("id", tables.pages_of(F.col("text")).alias("pages"))


@query(r"""SELECT p_partkey AS id, ['name', 'size', 'name_2', 'column_4'] AS keys, E'Table 1\n\nColumns: Name; Size; Name; Column 4.\n\nRow 1. Name is ' || p_name || '. Size is ' || p_size || E'.\n\nRow 2. Name is ' || p_brand || '. Size is 7. Name is 8. Column 4 is 9.' AS content FROM part""")
def txt_table_sem(spark, d):
    """A table as sentences, with a key for each column."""
    t = F.get(tables.parsed(F.col("text")), F.lit(0))
    told = lambda t: F.struct(tables.header_keys(tables.labelled(t)).alias("keys"), tables.worded(t, F.lit(1)).alias("content"))
    return _marked(spark, d).select("id", text.bound(t, told).alias("told")).select("id", "told.*")


@query("SELECT p_partkey AS id, 2 AS chunks, length(p_name) + length(p_size::VARCHAR) + length('Row 1. Name is . Size is .') + 2 + length('Table 1..Columns: Name; Size; Name; Column 4.') AS first FROM part")
def txt_table_chunks(spark, d):
    """A table in texts of one row each."""
    t = F.get(tables.parsed(F.col("text")), F.lit(0))
    c = text.bound(t, lambda t: tables.chunked(tables.heading(t, F.lit(1)), tables.sentences(t), 2000, 1))
    return _marked(spark, d).select("id", c.alias("c")).select("id", F.size("c").alias("chunks"), F.length(F.col("c")[0]).alias("first"))


@query(r"SELECT p_partkey AS id, p_name || E'\n\n' || p_brand AS text FROM part")
def txt_strip_tjson(spark, d):
    body = F.concat("p_name", F.lit('\n\n\n[TABLE_JSON]\n{"a": 1}\n[/TABLE_JSON]\n\n\n\n'), "p_brand", F.lit("\n[TABLE_JSON]{}[/TABLE_JSON]\n"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), tables.without_tables(body).alias("text"))


@query()
def txt_lists(spark, d):
    """Lists of every whole text as JSON; trees lie outside of SQL and are tested by hand."""
    return tables.lists(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


@query()
def txt_seqmatch(spark, d):
    """The known name most like each shortened one, among those that share enough trigrams; matching blocks lie outside of SQL."""
    names = table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))
    cut = names.select("id", F.substr("name", F.lit(1), F.length("name") - 1).alias("name"))
    near = search.trigram_join(cut, names, 0.3).select("a", "b")
    named = near.join(cut.select(F.col("id").alias("a"), F.col("name").alias("fragment")), "a").join(names.select(F.col("id").alias("b"), "name"), "b")
    return tables.best_matches(named.select("fragment", "name"))


TRGM_SQL = "list_distinct(list_transform(range(1, length('  ' || lower({0}) || ' ') - 1), lambda i: substr('  ' || lower({0}) || ' ', i, 3)))"


@query(f"WITH g AS (SELECT p_partkey, {TRGM_SQL.format('p_name')} AS a, {TRGM_SQL.format('p_type')} AS b FROM part) SELECT p_partkey AS id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS similarity FROM g")
def txt_trgm_py(spark, d):
    """Trigrams of the whole padded string, blanks inside included."""
    g = text.whole_trigrams
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(text.jaccard(g(F.col("p_name")), g(F.col("p_type"))), 6).alias("similarity"))


WORD_TRGM = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^0-9a-z]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query(f"WITH g AS (SELECT p_partkey, {WORD_TRGM.format('p_name')} AS a, {WORD_TRGM.format('p_type')} AS b FROM part) SELECT p_partkey AS id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS similarity FROM g")
def txt_trgm(spark, d):
    """Trigrams of each word."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(text.jaccard(text.trigrams(F.col("p_name")), text.trigrams(F.col("p_type"))), 6).alias("similarity"))


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vec_cos(spark, d):
    """Neighbours by id, compared."""
    e = table(spark, d, "embeddings")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("b"), F.col("embedding").alias("v"))
    return e.join(other, "vec_id").select(F.col("vec_id").alias("a"), "b", F.round(search.cosine(F.col("embedding"), F.col("v")), 5).alias("similarity"))
