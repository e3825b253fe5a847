"""Line dedup against a brute-force version."""

from __future__ import annotations

import hashlib
from collections import defaultdict

from casewright.llm import line_dedup

BLANK = " \t\n\x0b\x0c\r"


def brute(rows: list[tuple]) -> dict:
    held = defaultdict(set)
    lines = {i: (t or "").split("\n") for i, t in rows}

    def key(line: str) -> str:
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANK))

    for i, ls in lines.items():
        for x in ls:
            if len(key(x)) >= 20:
                held[key(x)].add(i)
    out = {}
    for i, ls in lines.items():
        kept = [x for x in ls if not (len(held[key(x)]) >= 3 and i < max(held[key(x)]))]
        out[i] = (len(ls), len(ls) - len(kept), "\n".join(kept))
    return out


def result(docs) -> dict:
    out = line_dedup.dedup_lines(docs).select("doc_id", "__n_lines", "__n_dropped", "__kept_text", "__keep")
    return {r[0]: (r[1], r[2], r[3]) for r in out.toLocalIterator()}


def test_odd_rows(odd):
    want = brute([(r.doc_id, r.text) for r in odd.toLocalIterator()])
    assert result(odd) == want
    assert odd.count() == line_dedup.dedup_lines(odd).count()


def test_corpus(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert result(docs) == brute([(r.doc_id, r.text) for r in docs.toLocalIterator()])


def test_empty_and_null_ids(spark, no_rows):
    assert not result(no_rows)
    line = "a line of more than twenty characters"
    docs = spark.createDataFrame([(1, line), (2, line), (None, line), (None, line)], "doc_id bigint, text string")
    out = line_dedup.dedup_lines(docs)
    assert out.count() == 4 and {r["__n_dropped"] for r in out.toLocalIterator()} == {0}


def test_keep_bitmap_is_the_text(odd):
    for r in line_dedup.dedup_lines(odd).toLocalIterator():
        lines = (r.text or "").split("\n")
        assert "\n".join(x for run in r["__keep"] for x in lines[run["start"] : run["start"] + run["len"]]) == r["__kept_text"]


def test_native(odd):
    plan = line_dedup.dedup_lines(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_query_digest(spark, sf):
    from casewright.llm import queries

    for r in queries.op10_line_dedup(spark, sf).limit(5).toLocalIterator():
        assert len(r.kept_sha256) == 64
    assert hashlib.sha256(b"").hexdigest() == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def test_repeated_ids_lose_their_own_lines(spark):
    line, own = "This line is in three documents.", "This line stands in one row only."
    rows = [(1, f"{line}\n{own}"), (1, f"{own} B\n{own} C"), (1, f"{own} B\n{own} C"), (2, line), (3, f"x\n{line}")]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id", "__kept_text", "__n_dropped")
    assert sorted(map(tuple, out.toLocalIterator())) == sorted([(1, own, 1), (1, f"{own} B\n{own} C", 0), (1, f"{own} B\n{own} C", 0), (2, "", 1), (3, f"x\n{line}", 0)])
