"""The forest on held-out findings, candidates by brute force, and the native plan."""

from __future__ import annotations

import re

import pytest

from casewright.llm import secrets

RUN = re.compile(r"[A-Za-z0-9+/_-]{12,}={0,2}")


@pytest.fixture(scope="module")
def model(spark):
    return secrets.train(secrets.made_findings(spark))


def test_held_out_findings(spark, model):
    rows = secrets.described(secrets.made_findings(spark, rows=2000, seed=71))
    out = model.transform(secrets._assembled(rows)).select("label", "prediction").toPandas()
    assert (out["label"] == out["prediction"]).mean() > 0.95


def test_candidates(odd, spark, sf):
    for docs in (odd, spark.read.parquet(f"{sf}/documents.parquet")):
        got = sorted((r.doc, r.value) for r in secrets.candidates(docs).toLocalIterator())
        want = []
        for r in docs.toLocalIterator():
            for w in re.split(r"[\x20\x09-\x0D]+", r.text or ""):
                want += [(r.doc_id, v) for v in RUN.findall(w) if re.search("[0-9]", v)]
        assert got == sorted(want)


def test_planted(spark, model):
    rows = [
        (1, 'aws_secret_access_key = "wJalrXUtnF3MI7K7MDENGbPxRfiCYzX8Ak3yQQ1z"', "config/prod.env"),
        (2, "see commit 9fceb02d0ae598e95dc970b74767f19372d61af8 for the change", "notes.txt"),
        (3, "token = ghp_16C7e42F292c6912E7710c838347Ae178B4a", "src/app.py"),
        (4, "order 4929123412341234 was shipped", "notes.txt"),
        (5, None, None),
        (6, "", "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = {r.doc: r.is_secret for r in secrets.scan(docs, model).toLocalIterator()}
    assert out[1] and out[3] and not out[2] and not out[4] and 5 not in out and 6 not in out


def test_empty_and_native(no_rows, odd, model):
    assert secrets.scan(no_rows, model).count() == 0
    plan = secrets.candidates(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
