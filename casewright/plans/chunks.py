"""Steps of chunking over whole texts of documents; the folds stand in recursive SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.operators import chunking, tables
from casewright.registry import query, table

WS = r"[ \t\n\x0b\f\r]"
TRIM = rf"regexp_replace({{}}, '^{WS}+|{WS}+$', '', 'g')"
SENTENCES = rf"string_split(regexp_replace(text, '([.!?]){WS}+', '\1' || chr(1), 'g'), chr(1))"


def _packed(parts: str, glue: str, size: int, overlap: int) -> str:
    """SQL of the packing of a table parts (id, k, part): (id, place, content)."""
    room = size - (len(glue) if len(glue) > 1 else 0)
    sep = " || ".join({"\n": "chr(10)", " ": "' '"}[c] for c in glue)
    full = f"f.now <> '' AND length(f.now) + length(p.part) > {room}"
    carried = f"CASE WHEN length(f.now) > {overlap} THEN right(f.now, {overlap}) || {sep} || p.part ELSE p.part END" if overlap else "p.part"
    return f"""RECURSIVE {parts},
f AS (SELECT id, k, part AS now, NULL::VARCHAR AS closed FROM parts WHERE k = 1
  UNION ALL SELECT p.id, p.k, CASE WHEN f.now = '' THEN p.part WHEN {full} THEN {carried} ELSE f.now || {sep} || p.part END, CASE WHEN {full} THEN {TRIM.format('f.now')} END FROM f JOIN parts p ON p.id = f.id AND p.k = f.k + 1),
done AS (SELECT id, k, closed AS content FROM f WHERE closed IS NOT NULL UNION ALL SELECT id, k + 0.5, {TRIM.format('now')} FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY k DESC) = 1 AND {TRIM.format('now')} <> ''),
packed AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY k)::INT AS place, content FROM done)"""


def _docs(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL")


def _exploded(rows, column):
    return rows.select("doc_id", F.posexplode(column).alias("place", "content")).withColumn("place", F.col("place") + 1)


PARAS = rf"body AS (SELECT doc_id AS id, string_split(regexp_replace(replace(text, chr(10), chr(10) || ' ' || chr(10)), '\n{WS}*\n', chr(1), 'g'), chr(1)) AS ps FROM documents WHERE text IS NOT NULL), full_ AS (SELECT id, list_filter(list_transform(ps, lambda p: {TRIM.format('p')}), lambda p: p <> '') AS ps FROM body WHERE len(ps) > 1), parts AS (SELECT id, unnest(ps) AS part, generate_subscripts(ps, 1) AS k FROM full_)"


@query(f"WITH {_packed(PARAS, chr(10) * 2, 400, 48)} SELECT id AS doc_id, place, content FROM packed")
def txt_split_para(spark, d):
    """Lines of documents as paragraphs, packed into 400 characters with an overlap of 48."""
    return _exploded(_docs(spark, d), chunking.by_paragraphs(F.replace("text", F.lit("\n"), F.lit("\n \n")), 400, 48))


SENTS = f"parts AS (SELECT id, unnest(ps) AS part, generate_subscripts(ps, 1) AS k FROM (SELECT doc_id AS id, {SENTENCES} AS ps FROM documents WHERE text IS NOT NULL))"


@query(f"WITH {_packed(SENTS, ' ', 600, 72)} SELECT id AS doc_id, place, content FROM packed")
def txt_split_sent(spark, d):
    """Sentences of documents, packed into 600 characters with an overlap of 72."""
    return _exploded(_docs(spark, d), chunking.by_sentences(F.col("text"), 600, 72))


@query(f"WITH {_packed(SENTS.replace('WHERE text IS NOT NULL', 'WHERE length(text) > 900'), ' ', 900, 0)} SELECT id AS doc_id, place, content FROM packed UNION ALL SELECT doc_id, 1, text FROM documents WHERE length(text) <= 900")
def txt_cap(spark, d):
    """Documents of more than 900 characters, cut at sentences; one long sentence stays long."""
    c = F.array(F.struct(F.lit("NARRATIVE").alias("kind"), F.lit("").alias("heading"), F.col("text").alias("content")))
    return _exploded(_docs(spark, d), F.transform(chunking.capped(c, 900), lambda x: x["content"]))


@query("""WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
m AS (SELECT doc_id, k, line, CASE WHEN contains(line, ',') THEN 'LIST' ELSE 'NARRATIVE' END AS kind FROM l), s AS (SELECT *, CASE WHEN length(line) < 80 AND lag(kind) OVER (PARTITION BY doc_id ORDER BY k) = kind THEN 0 ELSE 1 END AS starts FROM m),
g AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY k) AS place FROM s) SELECT doc_id, place::INT AS place, any_value(kind) AS kind, string_agg(line, chr(10) ORDER BY k) AS content FROM g GROUP BY doc_id, place""")
def txt_merge(spark, d):
    """Lines of documents as chunks of two kinds; those under 80 characters join the one before of their kind."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(F.when(F.contains(x, F.lit(",")), "LIST").otherwise("NARRATIVE").alias("kind"), F.lit("").alias("heading"), x.alias("content")))
    out = _docs(spark, d).select("doc_id", F.posexplode(chunking.merged(lines, 80)).alias("place", "c"))
    return out.select("doc_id", (F.col("place") + 1).alias("place"), "c.kind", "c.content")


@query(f"""WITH RECURSIVE b AS (SELECT doc_id AS id, string_split(text, chr(10)) AS ps, replace(text, chr(10), chr(10) || chr(10)) AS clean FROM documents WHERE text IS NOT NULL),
e AS (SELECT id, clean, unnest(ps) AS p, generate_subscripts(ps, 1) AS i, len(ps) AS n FROM b),
starts AS (SELECT id, 0 AS at_, 1 AS page FROM b UNION ALL SELECT id, at_, (i + 1)::INT FROM (SELECT id, i, n, sum(length(p) + 2) OVER (PARTITION BY id ORDER BY i) AS at_ FROM e) WHERE i < n),
c AS (SELECT id, clean, p AS content, row_number() OVER (PARTITION BY id ORDER BY i) AS k FROM e WHERE p <> ''),
f AS (SELECT DISTINCT id, 0::BIGINT AS k, 1::BIGINT AS at_, 0::BIGINT AS pos FROM c
  UNION ALL SELECT c.id, c.k, pos + 1, pos FROM (SELECT c.*, CASE WHEN instr(substr(clean, f.at_), content) > 0 THEN instr(substr(clean, f.at_), content) + f.at_ - 1 ELSE instr(clean, content) END AS pos FROM f JOIN c ON c.id = f.id AND c.k = f.k + 1) c)
SELECT f.id AS doc_id, f.k::INT AS place, (SELECT max(page) FROM starts s WHERE s.id = f.id AND s.at_ < f.pos) AS page_start, (SELECT max(page) FROM starts s WHERE s.id = f.id AND s.at_ < f.pos + length(c.content) - 1) AS page_end FROM f JOIN c ON c.id = f.id AND c.k = f.k""")
def txt_page_assign(spark, d):
    """Lines of documents as chunks, each line on a page of its own by form feeds: the pages where they are found."""
    clean, starts = chunking.page_starts(F.replace("text", F.lit("\n"), F.lit("\f")))
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    c = F.transform(lines, lambda x: F.struct(F.lit("N").alias("kind"), F.lit("").alias("heading"), x.alias("content")))
    rows = _docs(spark, d).select("doc_id", clean.alias("clean"), starts.alias("starts"), c.alias("c"))
    out = rows.select("doc_id", F.posexplode(chunking.located(F.col("c"), F.col("clean"), F.col("starts"))).alias("place", "x"))
    return out.select("doc_id", (F.col("place") + 1).alias("place"), "x.page_start", "x.page_end")


@query(r"""WITH RECURSIVE b AS (SELECT doc_id AS id, replace(text, chr(10), chr(10) || chr(10)) AS body FROM documents WHERE text IS NOT NULL),
cut AS (SELECT id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT id, list_filter(string_split(regexp_replace(body, '(\n{2,}|\f)', '\1' || chr(1), 'g'), chr(1)), lambda p: p <> '') AS ps FROM b WHERE length(body) > 500)),
parts AS (SELECT id, substr(p, k * 500 + 1, 500) AS part, row_number() OVER (PARTITION BY id ORDER BY i, k) AS k FROM (SELECT id, p, i, unnest(range(0, (length(p) - 1) // 500 + 1)) AS k FROM cut)),
f AS (SELECT id, k, part AS now, NULL::VARCHAR AS closed FROM parts WHERE k = 1 UNION ALL SELECT q.id, q.k, CASE WHEN length(f.now) + length(q.part) > 500 THEN q.part ELSE f.now || q.part END, CASE WHEN length(f.now) + length(q.part) > 500 THEN f.now END FROM f JOIN parts q ON q.id = f.id AND q.k = f.k + 1),
done AS (SELECT id, k, closed AS content FROM f WHERE closed IS NOT NULL UNION ALL SELECT id, k + 0.5, now FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY k DESC) = 1)
SELECT id AS doc_id, row_number() OVER (PARTITION BY id ORDER BY k)::INT AS place, content FROM done UNION ALL SELECT id, 1, body FROM b WHERE length(body) <= 500""")
def txt_split_tr(spark, d):
    """Segments for translation of at most 500 characters, cut at blank lines where that is possible; every line break is one here."""
    return _exploded(_docs(spark, d), tables.segments(F.replace("text", F.lit("\n"), F.lit("\n\n")), 500))
