"""Document statistics against brute force; trees and their constraints."""

from __future__ import annotations

import re

import numpy as np

from casewright.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text: str | None) -> tuple:
    t = text or ""
    words = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = {}
    for i in range(len(words) - 2):
        grams.setdefault(tuple(words[i : i + 3]), []).append(i)
    inside = {i + k for g in grams.values() if len(g) > 1 for i in g for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(inside)


def check(docs, labels):
    out = {r.doc: r for r in quality.judge(docs, labels).toLocalIterator()}
    for r in docs.toLocalIterator():
        got, want = out[r.doc_id], brute(r.text)
        assert tuple(got[c] for c in quality.COUNTS[:5]) == want, r.doc_id
        assert got.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (got.base_failed and got.kept)


def test_odd_rows(spark, odd):
    check(odd, spark.createDataFrame([(1, 1, 0), (1, None, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int"))


def test_corpus(spark, sf):
    check(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))


def test_empty(spark, no_rows):
    assert quality.judge(no_rows, spark.createDataFrame([], "doc_id bigint, quality int")).count() == 0


def test_very_long_text():
    line = "some words of a long text " * 40 + "\n"
    text = line * 3000
    got = quality.statistics([text.encode()])[0]
    assert tuple(got[:5]) == brute(text)


def test_monotone_and_right():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 3))
    y = (x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) < 0.6).astype(float)
    trees = quality.boost(x, y, [-1, 0, 0])
    assert ((trees.margin(x) > 0) == (y > 0)).mean() > 0.95
    for _ in range(20):
        row = np.repeat(rng.random((1, 3)), 200, axis=0)
        row[:, 0] = np.linspace(0, 1, 200)
        assert (np.diff(trees.margin(row)) <= 1e-12).all()


def test_held_out_labels(spark):
    """Trees from two thirds of the labels judge the rest."""
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    out = quality.judge(docs, labels.where("doc_id % 3 != 0")).join(labels.withColumnRenamed("doc_id", "doc"), "doc").where("doc % 3 = 0 and quality is not null").toPandas()
    assert ((out["score"] >= 0.5) == (out["quality"] == 1)).mean() > 0.85


def test_node_arrays_against_a_recursive_walk():
    rng = np.random.default_rng(4)
    x = rng.random((800, 4))
    trees = quality.boost(x, (x[:, 0] * x[:, 2] > 0.3).astype(float), [1, 0, 0, -1], rounds=12)

    def walk(node: int, row: np.ndarray) -> float:
        if trees.left[node] == node:
            return trees.value[node]
        return walk(trees.left[node] if row[trees.feature[node]] <= trees.cut[node] else trees.right[node], row)

    want = [trees.start + sum(walk(root, row) for root in trees.roots) for row in x[:200]]
    assert len(trees.roots) == 12 and np.allclose(trees.margin(x[:200]), want)
