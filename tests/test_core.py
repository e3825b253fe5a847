"""Facts of the text functions, rule systems, fusion, graphs and queues; all queries against their SQL."""

from __future__ import annotations

import json
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from casewright import catalog
from casewright.functions import classify, text
from casewright.operators import chunking, filters, graph, search, tables
from casewright.sources import readers
from casewright.streaming import lifecycle

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def canon(rows) -> list[str]:
    def c(x) -> str:
        if x is None or x != x:
            return "null"
        if isinstance(x, float):
            return f"{x:.6g}"
        return "[" + ",".join(map(c, x)) + "]" if isinstance(x, (list, tuple)) else str(x)

    return sorted("|".join(map(c, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = con.execute(catalog.ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    df = catalog.QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(names)
    assert canon(tuple(r) for r in df.select(*names).toLocalIterator()) == canon(found.fetchall())


def test_redaction(spark):
    raw = "Victim name: Asha Rao; phone 9876543210, mail a.b@c.org, id 1234 5678 9012, PAN ABCDE1234F"
    out, hits = text.redact(F.lit(raw))
    shown, rules = one(spark, out), one(spark, hits)
    assert not any(x in shown for x in ("9876543210", "a.b@c.org", "1234 5678 9012", "ABCDE1234F", "Asha"))
    assert len(rules) >= 5 and one(spark, text.redact(F.lit(shown))[0]) == shown
    assert one(spark, text.protected_flags(F.array(F.lit("POCSO case")))) == ["minor_identity", "sexual_offence_detail"]


def test_redaction_step_by_step(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60)
    out, hits = text.redact(F.col("text"))
    nested = {r.doc_id: (r.t, r.h) for r in docs.select("doc_id", out.alias("t"), hits.alias("h")).toLocalIterator()}
    stepped = {r.doc_id: (r.text, r.hits) for r in text.redacted(docs, "text").toLocalIterator()}
    assert nested == stepped and any(h for _, h in stepped.values())


def test_rules(spark):
    assert one(spark, classify.sections(F.lit("IPC 302; Section 354A; BNS 103"))) == ["302", "354A", "103"]
    assert one(spark, classify.court_level(F.lit("Additional Sessions Judge"), F.lit("SC"))) == "sessions"
    plan = one(spark, classify.question_plan(F.lit("How many cases by district in the eCourts metadata?")))
    assert (plan.profile, plan.route, plan.intent) == ("district_analytics", "district_analytics", "source_performance")
    assert one(spark, classify.question_plan(F.lit("compare A versus B"))).profile == "comparison"
    assert str(one(spark, classify.loose_date(F.lit("05-01-2018 10:00")))) == "2018-01-05"
    rules = [{"category": "murder", "sections": ["302"]}, {"category": "kidnap", "sections": ["363"]}, {"category": "cheque", "keywords": ["cheque"]}]
    assert one(spark, classify.offences(F.array(F.lit("302")), F.lit("IPC"), F.lit("a cheque"), rules)) == ["murder", "cheque"]


def test_small_text_functions(spark):
    assert one(spark, text.case_scope(F.lit("FIR No. 12 of 2020"))) == "12/2020"
    assert one(spark, text.scopes_match(F.lit("12"), F.lit("12/2020"))) and not one(spark, text.scopes_match(F.lit("12/2019"), F.lit("12/2020")))
    assert one(spark, text.citations(F.lit("a [2] b [1][2] c [9]"), F.lit(3))) == [2, 1]
    assert one(spark, text.strip_markdown(F.lit("# T\n**b** ![a](u) [c](v) `d`"))) == "T\nb !a c d"
    assert one(spark, text.script(F.lit("abc कखगघ"))) == "devanagari" and one(spark, text.script(F.lit("12"))) == "unknown"
    assert one(spark, text.csv_cell(F.lit('a"b'))) == '"a""b"'
    assert one(spark, text.is_table(F.lit("a|b|c\n1|2|3\nx")))
    assert one(spark, text.mask(F.lit("Ram met RAM"), F.array(F.lit("ram")))) == "[MASKED_NAME] met [MASKED_NAME]"
    assert one(spark, text.quality(F.lit("ok�"))) == 0.0 and one(spark, text.quality(F.lit("fine text"))) == 1.0


def test_fusion(spark):
    vec = spark.createDataFrame([("c1", 0.9), ("c2", 0.7)], "id string, similarity double")
    lex = spark.createDataFrame([("c3", 0.5), ("c4", 1.0)], "id string, rank double")
    near = spark.createDataFrame([("c1",), ("c3",)], "id string")
    out = {r.id: r.score for r in search.fuse(vec, lex, near, 10).collect()}
    assert len(out) == 4 and out["c1"] == pytest.approx(0.56) and out["c4"] == pytest.approx(0.2)


def chunked(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = chunking.chunks(docs).orderBy("doc_id", "chunk").collect()
    return [[(r.kind, r.heading, r.page_start, r.page_end, r.content) for r in rows if r.doc_id == k] for k in range(len(texts))]


def test_chunks(spark):
    body = ("A sentence of words. " * 400).strip()
    rows = "a|b|c\n" + "\n".join(f"{k}|x|y" for k in range(120))
    paged = "First page here, long enough to be a chunk of its own, I say.\fEvidence\n" + "x" * 60 + "\fFacts of it\n" + "y" * 60
    marked = "Zero page, long enough to be a chunk of its own, I say again.\n<!-- PAGE 4 -->\n# Head\n" + "z" * 60
    small = "# One\nlong enough to be a chunk of its own, I say once more, really\n# Two\ntiny"
    a, b, c, d, e, f, g = chunked(spark, f"# Facts\n{body}", rows, paged, marked, small, None, " \n ")
    assert len(a) > 3 and a[0][4].startswith("Facts\nA sentence") and all(h == "Facts" and len(x) <= 2048 + 300 for _, h, _, _, x in a)
    assert all(x.startswith(y[-245:].strip()) for (*_, y), (*_, x) in zip(a[:-1], a[1:], strict=True) if len(y) > 245)
    assert [x[0] for x in b] == ["TABLE"] * 3 and all(x[4].startswith("a|b|c\n") for x in b) and b[2][4].count("\n") == 20
    assert [(h, p) for _, h, p, _, _ in c] == [("", 1), ("Evidence", 2), ("Facts of it", 3)]
    assert d[0][2:4] == (1, 4) and d[1][:4] == ("NARRATIVE", "Head", 4, 4)
    assert [x[4] for x in e] == ["One\nlong enough to be a chunk of its own, I say once more, really\nTwo\ntiny"]
    assert f == g == []


def test_chunk_parts_against_plain_python(spark):
    """Packing by a loop over strings, for sizes that break everywhere."""
    import random
    import re

    def loop(parts, glue, size, overlap):
        out, now = [], ""
        for p in parts:
            if now and len(now) + len(p) + (2 if glue == "\n\n" else 0) > size:
                out.append(now.strip())
                now = (now[len(now) - overlap :] + glue if 0 < overlap < len(now) else "") + p
            else:
                now = now + glue + p if now else p
        return [*out, now.strip()] if now.strip() else out

    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) + rng.choice(["", "", ".", "!"]) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    for size, overlap in ((30, 0), (30, 7), (80, 12)):
        df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", chunking.by_sentences(F.col("t"), size, overlap).alias("x"))
        for r in df.toLocalIterator():
            assert r.x == loop(re.split(r"(?<=[.!?])\s+", texts[r.k]), " ", size, overlap)


def test_graph_and_filters(spark):
    edges = spark.createDataFrame([(1, 1, 2, "k", 0.9), (2, 2, 3, "k", 0.9), (3, 3, 4, "k", 0.2)], "edge_id int, src int, dst int, kind string, weight double")
    start = spark.createDataFrame([(1,)], "node int")
    assert {r.node: r.hop for r in graph.explore(edges, start).collect()} == {1: 0, 2: 1, 3: 2, 4: 3}
    assert {r.edge_id for r in graph.expand(edges, start).collect()} == {1, 2}
    assert filters.read_only_sql("SELECT 1") and not filters.read_only_sql("SELECT 1; DROP TABLE x") and not filters.read_only_sql("WITH a AS (SELECT 1) DELETE FROM t")
    assert filters.in_int("a", ["x"]) is None


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id,t\n1,"x,y"\n')
    assert readers.csv(spark, str(tmp_path / "a.csv")).first().asDict() == {"id": "1", "t": "x,y"}
    (tmp_path / "a.json").write_text('{"case_id": "7", "body": "b"}\n{"id": ""}\nnot json\n')
    good, bad = readers.json_records(spark, str(tmp_path / "a.json"))
    assert good.first().id == "7" and bad.count() == 2
    xml = spark.createDataFrame([("<L><Contents><Key>a/b</Key><Size>5</Size></Contents></L>",)], "xml string")
    assert readers.xml_listing(xml).collect() == [("a/b", 5)]


def test_stream(spark, sf, tmp_path):
    events = spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).parquet(f"{sf}/event*.parquet")
    q = lifecycle.windows(events, "ts", "1 hour", "1 day").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path)).start()
    q.awaitTermination(120)
    assert spark.table("w").agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()


def test_shortened_names_find_themselves(spark, sf):
    rows = catalog.QUERIES["txt_seqmatch"](spark, sf).collect()
    assert len(rows) > 20 and all(r.name.startswith(r.fragment) and 0.85 <= r.score <= 1 for r in rows)


def test_lists_and_names():
    from casewright.operators import tables

    assert tables.listed("a\n- x\n  - y\n- z\nb\n1. only") == 'a\n[\n  {\n    "text": "x",\n    "children": [\n      {\n        "text": "y"\n      }\n    ]\n  },\n  {\n    "text": "z"\n  }\n]\nb\n1. only'
    deep = [f"{' ' * k}{m} n{k}" for k, m in zip(range(8), "-*+-*-+-")] + ["2) last"]
    tree, depth = json.loads(tables.listed("\n".join(deep))), 0
    assert [x["text"] for x in tree] == ["n0", "last"]
    while "children" in tree[0]:
        tree, depth = tree[0]["children"], depth + 1
    assert depth == tables.DEPTH - 1 and [x["text"] for x in tree] == ["n4", "n5", "n6", "n7"]
    assert tables.listed("- one\n  - two") == "- one\n  - two"
    assert tables.depths([2, 4, 4, 3, 0, 9, 1], 5) == [0, 1, 1, 1, 0, 1, 1]
    assert tables.ratio("ram", "Ram Kumar") < 0.85 and tables.ratio("ram kumar", "Ram Kumar Singh") >= 0.75 and tables.ratio("same", "Same") == 1


def test_table_chunks(spark):
    from casewright.operators import tables

    block = "<!-- TABLE_START -->\nDate||Date\n1|2|3\n4|5|6\n7|8|9\n<!-- TABLE_END -->"
    t = tables.parsed(F.lit(block))[0]
    parts = one(spark, tables.chunked(tables.heading(t, F.lit(1)), tables.sentences(t), 10_000, 2))
    assert len(parts) == 2 and parts[0].startswith("Table 1\n\nColumns: Date; Date; Column 3.") and parts[1].endswith("Row 3. Date is 7. Date is 8. Column 3 is 9.")
    assert one(spark, tables.header_keys(F.array(F.lit("Date"), F.lit(""), F.lit("Date")))) == ["date", "column_2", "date_2"]


def test_a_wide_table_is_parsed_once(spark):
    wide = "<!-- TABLE_START -->\n" + "\n".join("|".join(f"c{r}.{k}" for k in range(12)) for r in range(60)) + "\n<!-- TABLE_END -->"
    rows = spark.range(400).select(F.concat(F.lit(wide), F.col("id").cast("string")).alias("text"))
    t = F.get(tables.parsed(F.col("text")), F.lit(0))
    made = text.bound(t, lambda t: tables.chunked(tables.heading(t, F.lit(1)), tables.sentences(t), 100_000, 7))
    began = time.time()
    sizes = rows.select(F.size(made).alias("n"), F.length(text.bound(t, lambda t: tables.worded(t, F.lit(1)))).alias("w")).groupBy("n", "w").count().collect()
    assert [(r["n"], r["count"]) for r in sizes] == [(9, 400)] and time.time() - began < 60


@pytest.mark.parametrize(
    ("name", "made", "most"),
    [
        ("txt_table_sem", "regexp_extract_all(", 1),
        ("txt_split_table", "transform(sequence(1,", 1),
        ("txt_legalmeta", "StructsToJsonEvaluator(", 2),
        ("cls_row", "map(ddl_case_id,", 1),
    ],
)
def test_made_values_are_computed_once_a_row(spark, sf, name, made, most):
    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count(made) <= most


def test_pairs_of_users_and_documents_are_not_shuffled(spark, sf):
    from casewright.operators import details

    docs = spark.createDataFrame([(1, "A"), (2, "B"), (3, "B"), (3, "A"), (2, "B"), (4, None), (5, "B")], "document int, level string")
    users = spark.createDataFrame([(1, "A"), (2, "B"), (3, None), (1, "A")], "user int, clearance string")
    grants = spark.createDataFrame([(1, 2, None, None), (1, 2, None, 9), (1, 1, None, None), (3, None, "A", None), (3, 4, None, None), (3, 4, None, 1), (2, 5, None, None), (9, 1, None, None), (1, 99, None, None)], "user int, document int, level string, expires_at int")
    out = details.accessible(docs, users, grants, F.lit(5), {"A": 0, "B": 1})
    assert sorted(map(tuple, out.collect())) == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (2, 5), (3, 1), (3, 3), (3, 4)]
    out = catalog.QUERIES["flt_access_doc"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert out.lstrip().startswith("Union")


def test_pairs_of_users_and_documents_take_little_disk(spark, tmp_path):
    from casewright.operators import details

    docs, users = spark.range(20_000).select(F.col("id").alias("document"), F.lit("A").alias("level")), spark.range(300).select(F.col("id").alias("user"), F.lit("A").alias("clearance"))
    grants = spark.createDataFrame([], "user bigint, document bigint, level string, expires_at int")
    details.accessible(docs, users, grants, F.lit(5), {"A": 0, "B": 1}).write.parquet(str(tmp_path / "pairs"))
    rows = spark.read.parquet(str(tmp_path / "pairs"))
    assert tuple(rows.agg(F.count("*"), F.sum("user"), F.sum("document"), F.sum(F.col("user") * F.col("document"))).first()) == (6_000_000, 44_850 * 20_000, 199_990_000 * 300, 44_850 * 199_990_000)
    assert sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < 2_500_000
