"""Archives and text files, also damaged ones."""

from __future__ import annotations

import csv
import io
import tarfile
import tempfile
from pathlib import Path

from casewright.sources import archives


def member(rows: list[list[str]], bom: bool = False) -> bytes:
    out = io.StringIO(newline="")
    csv.writer(out).writerows(rows)
    return (b"\xef\xbb\xbf" if bom else b"") + out.getvalue().encode()


def archive(path: Path, members: dict[str, bytes]) -> None:
    with tarfile.open(path, "w:gz") as t:
        folder = tarfile.TarInfo("data")
        folder.type = tarfile.DIRTYPE
        t.addfile(folder)
        for name, data in members.items():
            entry = tarfile.TarInfo(f"data/{name}")
            entry.size = len(data)
            t.addfile(entry, io.BytesIO(data))


def test_archives(spark):
    folder = Path(tempfile.mkdtemp(prefix="spark-"))
    cases = [["id", "name"], *([str(k), f'n "{k}",\nline'] for k in range(500))]
    archive(folder / "a.tar.gz", {"cases.csv": member(cases, bom=True), "acts.csv": member([["act"], ["IPC"], ["BNS"]]), "empty.csv": b""})
    archive(folder / "b.tar.gz", {"cases.csv": member([["id", "name"], ["9", "ä"], ["10", "x", "extra"]]), "bad.csv": b"id\n\xff\xfe\n", "acts.csv": member([["act"], ["X"]])})
    whole = (folder / "a.tar.gz").read_bytes()
    (folder / "c.tar.gz").write_bytes(whole[: len(whole) // 2])
    (folder / "d.tar.gz").write_bytes(b"no archive")
    rows, bad = archives.csv_members(spark, f"file://{folder}/*.tar.gz")
    good = [(Path(r.archive).name[0], r.member, r.place, dict(r.row)) for r in rows.collect()]
    assert sorted(x for x in good if x[0] in "ab") == sorted(
        [("a", "cases.csv", k, {"id": str(k), "name": f'n "{k}",\nline'}) for k in range(500)] + [("a", "acts.csv", 0, {"act": "IPC"}), ("a", "acts.csv", 1, {"act": "BNS"}), ("b", "cases.csv", 0, {"id": "9", "name": "ä"}), ("b", "acts.csv", 0, {"act": "X"})],
        key=lambda x: (x[0], x[1], x[2]),
    )
    errors = sorted((Path(r.archive).name[0], r.member, r.error.split(":")[0]) for r in bad.collect())
    assert errors[0] == ("b", "bad.csv", "UnicodeDecodeError") and errors[1] == ("b", "cases.csv", "more cells than names")
    assert {e[0] for e in errors} == {"b", "c", "d"} and len(errors) == 4


def test_only_wanted_members_are_read(spark):
    folder = Path(tempfile.mkdtemp(prefix="spark-"))
    archive(folder / "a.tar.gz", {"cases.csv": member([["id"], ["1"]]), "bad.csv": b"id\n\xff\n", "acts.csv": member([["act"], ["IPC"]])})
    rows, bad = archives.csv_members(spark, f"{folder}/*.tar.gz", ["cases.csv"])
    assert [(r.member, r.row) for r in rows.collect()] == [("cases.csv", {"id": "1"})] and bad.count() == 0
    rows, bad = archives.csv_members(spark, f"{folder}/*.tar.gz")
    assert [r.member for r in rows.where("member = 'acts.csv'").collect()] == ["acts.csv"]
    assert bad.where("member IN ('acts.csv', 'cases.csv')").count() == 0 and bad.count() == 1
    assert archives.csv_members(spark, f"{folder}/none*.tar.gz")[0].count() == 0


def test_text_files(spark):
    folder = Path(tempfile.mkdtemp(prefix="spark-"))
    (folder / "sub").mkdir()
    files = {"a.txt": "grün 你".encode(), "b.TXT": b"\xff\xfe" + "é!".encode("utf-16-le"), "c.csv": b"\xef\xbb\xbfid,x\n1,2", "sub/d.md": b"# Title\n\n**bold** text", "e.log": "café".encode("latin-1"), "f.pdf": b"%PDF", "g": b"x", "h.txt": b"", "i.txt": b"x" * 50}
    for name, data in files.items():
        (folder / name).write_bytes(data)
    good, bad = archives.text_files(spark, str(folder), most_bytes=40)
    texts = {Path(r.path).name: r.text for r in good.collect()}
    assert texts.pop("d.md").strip().startswith("Title")
    assert texts == {"a.txt": "grün 你", "b.TXT": "é!", "c.csv": "id,x\n1,2", "e.log": "café"}
    assert {Path(r.path).name: r.reason for r in bad.collect()} == {"f.pdf": "not a text file: pdf", "g": "not a text file: ", "i.txt": "too long"}


def test_stored_files(spark):
    """files lie in several folders, are read in few tasks, and those without bytes are files too."""
    folder = tempfile.mkdtemp(prefix="spark-")
    rows = spark.range(2500).selectExpr("concat(id, if(id % 5 = 4, '.pdf', '.TXT')) AS name", "encode(if(id % 7 = 0, '', concat('ü', id)), 'UTF-8') AS content")
    assert archives.write_files(rows, folder) == 2500
    assert sorted(f.name for f in Path(folder).iterdir()) == ["0", "1"]
    files = archives.stored_files(spark, f"file://{folder}", most_bytes=5)
    assert files.rdd.getNumPartitions() == 1 and files.where("content IS NULL").count() == sum(k % 5 == 4 or (k % 7 > 0 and k > 999) for k in range(2500))
    got = {Path(r.path).name: (r.text, r.reason) for r in archives.told(files, most_bytes=5).collect()}
    assert got == {f"{k}.pdf" if k % 5 == 4 else f"{k}.TXT": (None, "not a text file: pdf") if k % 5 == 4 else ("", None) if k % 7 == 0 else (None, "too long") if k > 999 else (f"ü{k}", None) for k in range(2500)}
    assert archives.stored_files(spark, f"{folder}/none").count() == 0


def test_semantic_chunks(spark):
    from casewright.operators import semantic

    docs = spark.createDataFrame([(1, " One. Two!  Three? four"), (2, ""), (3, None), (4, "only one"), (5, "a. " * 400)], "doc bigint, text string")
    told = semantic.sentences(docs, docs["text"])
    assert [(r.k, r.sentence) for r in told.where("doc = 1").orderBy("k").collect()] == [(0, "One."), (1, "Two!"), (2, "Three?"), (3, "four")]
    vec = "CASE WHEN doc = 1 AND k < 2 THEN array(1.0, 0.0) WHEN doc = 1 AND k = 3 THEN NULL ELSE array(0.0, 1.0) END AS vec"
    got = {(r.doc, r.chunk): (r.first, r.sentences, r.content) for r in semantic.chunked(told.selectExpr("*", vec), most=300).collect()}
    assert got[1, 0] == (0, 2, "One. Two!") and got[1, 1] == (2, 2, "Three? four") and got[4, 0] == (0, 1, "only one")
    fives = [got[5, k] for k in range(len(got) - 3)]
    assert sum(n for _, n, _ in fives) == 400 and {len(c) for _, _, c in fives[:-1]} == {299}


def test_statements_that_may_not_run(spark):
    import pytest

    from casewright.operators import patterns

    cases = {"cases": spark.range(5).toDF("n")}
    for bad in ("DELETE FROM cases", "SELECT 1; SELECT 2", "SELECT * FROM other", "INSERT INTO cases VALUES (1)", "SELECT * FROM cases WHERE n IN (SELECT n FROM secret)", "SELECT * FROM parquet.`/tmp/x`", "WITH a AS (SELECT * FROM secret) SELECT * FROM a", "SELEC 1", "DROP TABLE cases", "SELECT (SELECT max(n) FROM secret) AS m FROM cases", "SELECT * FROM range(5)", ""):
        with pytest.raises(patterns.NotAllowed):
            patterns.run(spark, bad, cases)
    rows = patterns.run(spark, "WITH a AS (SELECT n FROM cases WHERE n > CAST(:g1 AS INT)) SELECT count(*) AS c FROM a", cases, {"g1": "1 OR 1=1"[:1]})
    assert rows.first()["c"] == 3
    assert patterns.answer(spark, "delete all", [patterns.Pattern("delete (.+)", "DELETE FROM cases", "x"), patterns.Pattern("all", "SELECT count(*) AS c FROM cases", "y")], cases)[0] == "y"


def test_pages_are_found_row_by_row():
    """Python holds the strings of one row of a batch, not of all."""
    import tracemalloc

    import pyarrow as pa

    from casewright.operators import chunking

    lines = [f"line {k} of a text" for k in range(500)]
    rows = 400
    contents, whole = pa.array([lines] * rows + [None, ["b", "none"]]), pa.array(["\n\n".join(lines)] * rows + ["x", "a\n\nb"])
    ats = pa.array([[0, *(sum(len(x) + 2 for x in lines[:k]) for k in range(1, 500))]] * rows + [[0], [0, 3]], pa.list_(pa.int32()))
    pages = pa.array([[*range(1, 501)]] * rows + [[1], [1, 2]], pa.list_(pa.int32()))
    tracemalloc.start()
    out = chunking._pages_of_batch(contents, whole, ats, pages)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out[0].as_py() == [{"page_start": k, "page_end": k} for k in range(1, 501)] and out[rows].as_py() is None
    assert out[rows + 1].as_py() == [{"page_start": 2, "page_end": 2}, {"page_start": None, "page_end": None}]
    assert peak < 10_000_000  # the strings of all rows are above 12 MB, the dicts of their pages above 30 MB


def test_nearest_of_copies_and_of_what_is_no_number(spark):
    """a task leaves k of equal rows, and one part that is no number doesn't cost a batch its hits."""
    import numpy as np
    import pyarrow as pa

    from casewright.operators import search

    own = np.random.default_rng(7).normal(size=(900, 8))
    own[300:600] = own[300]
    own[700] = 0
    own /= np.maximum(np.linalg.norm(own, axis=1), 1e-300)[:, None]
    names = [f"v{k:03}" for k in range(900)]
    like = np.round(own[[300, 5]] @ own.T, 12)
    best = {(q, names[k]) for q, row in zip("ab", like, strict=True) for k in sorted(range(900), key=lambda k: (-row[k], k))[:7]}
    rows = [(n, v.tolist()) for n, v in zip(names, own, strict=True)] + [("x", [float("nan")] * 8), ("y", [1.0] * 7 + [None])]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in part]), pa.array([r[1] for r in part], pa.list_(pa.float64()))], ["id", "vec"]) for part in (rows[:450], rows[450:], rows[:0])]
    left = [r for b in search._best_of_part([("a", own[300].tolist()), ("b", own[5].tolist())], pa.string(), 7, None)(iter(batches)) for r in b.to_pylist()]
    assert {(r["q"], r["id"]) for r in left} >= best and len(left) <= 2 * 2 * 7
    vectors = spark.createDataFrame(rows, "id string, vec array<double>")
    queries = spark.createDataFrame([("a", own[300].tolist()), ("b", own[5].tolist()), ("c", [float("nan")] * 8)], "q string, v array<double>")
    assert {(r.q, r.id) for r in search.nearest(vectors, queries, 7, block=1).collect()} == best
    assert {r.id for r in search.nearest(vectors, queries.where("q = 'b'"), 7, least=0.999).collect()} == {"v005"}


def test_chunks_part_at_vectors_in_one_shuffle(spark):
    """neighbours are compared in the task that chunks, across batches, and unknown or odd vectors part nothing."""
    from casewright.operators import semantic

    vecs = [[1.0, 0.0], [1.0, 0.1], [0.0, 1.0], None, [1.0, 0.0], [1.0], [0.0, 1.0], [1.0, None], [0.0, 0.0], [0.0, 0.0], [0.0, 2.0], [0.0, 1.0]]
    rows = spark.createDataFrame([(d, k, f"s{k}", v) for d in (1, 2) for k, v in enumerate(vecs)], "doc bigint, k int, sentence string, vec array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        out = semantic.chunked(rows)
        got = [(r.doc, r.first, r.sentences, r.content) for r in out.orderBy("doc", "chunk").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    spans = [(0, 2), (2, 7), (9, 1), (10, 2)]
    assert got == [(d, k, n, " ".join(f"s{x}" for x in range(k, k + n))) for d in (1, 2) for k, n in spans]
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1
