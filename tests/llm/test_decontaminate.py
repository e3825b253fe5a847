"""Planted copies, edits and paraphrases of test items."""

from __future__ import annotations

import random

import numpy as np

from casewright.llm import decontaminate
from tests.llm.conftest import WORDS, prose


def brute_align(a: list, b: list) -> int:
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            h[i + 1][j + 1] = max(0, h[i][j] + (2 if x == y else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
    return max(map(max, h))


def test_alignment_equals_the_full_table():
    rng = random.Random(2)
    for _ in range(30):
        a = [rng.randrange(6) for _ in range(rng.randint(1, 25))]
        b = [rng.randrange(6) for _ in range(rng.randint(1, 40))]
        assert decontaminate.align(np.array(a), np.array(b))[0] == brute_align(a, b)


def test_planted(spark):
    rng = random.Random(5)
    items = [(k, prose(30 + k, 100 + k)) for k in range(12)]
    rows, want = [], set()
    for k, (i, text) in enumerate(items):
        w = text.split()
        for p in range(0, len(w), 9):  # one word in nine is changed
            w[p] = rng.choice(WORDS) if k % 3 else w[p]
        if k % 3 == 2:
            del w[len(w) // 2]
        rows.append((k, f"{prose(200, 900 + k)}\n{' '.join(w).upper()} {prose(150, 700 + k)}"))
        want.add((k, i))
    rows += [(50 + k, prose(400, 2000 + k)) for k in range(40)]
    got = {(r.doc, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).toLocalIterator()}
    assert got == want


def test_an_edited_copy_in_many_documents(spark):
    """Under half of the 3-grams stay, and the original is nowhere."""
    item = prose(40, 300)
    w = item.split()
    w[::4] = [f"changed{p}" for p in range(0, len(w), 4)]
    rows = [(k, f"{prose(60, 400 + k)} {' '.join(w)} {prose(60, 500 + k)}") for k in range(30)]
    # many other 3-grams of the item occur once, by chance
    rows += [(100 + k, " ".join([prose(30, 600 + k), *item.split()[k : k + 3], prose(30, 700 + k)])) for k in range(38)]
    items = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    got = {(r.doc, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id bigint, text string"), items).toLocalIterator()}
    assert got == {(k, 1) for k in range(30)}


def test_blocks_give_the_same(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    one = {tuple(r) for r in decontaminate.contaminated(docs, items).toLocalIterator()}
    many = {tuple(r) for r in decontaminate.contaminated(docs, items, block_chars=2000).toLocalIterator()}
    assert one == many and one


def test_odd_rows(spark, odd, no_rows):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "two words"), (4, prose(80, 2)), (None, prose(40, 77))], "item_id bigint, text string")
    assert {r.doc for r in decontaminate.contaminated(odd, items).toLocalIterator()} == {5, 6, 7, 20}
    assert decontaminate.contaminated(no_rows, items).count() == 0
    assert decontaminate.contaminated(odd, items.limit(0)).count() == 0


def test_corpus_against_the_full_table(spark, sf):
    """Every item and document of up to 400 words that share two seeds, aligned as a whole."""
    short = [(r.doc_id, (r.text or "").lower().split()) for r in spark.read.parquet(f"{sf}/documents.parquet").toLocalIterator()]
    short = [(i, w) for i, w in short if len(w) <= 400]
    items = [(r.item_id, r.text.lower().split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").toLocalIterator()]
    seeds = lambda w: {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
    want = set()
    for i, w in short:
        own = seeds(w)
        for j, v in items:
            if len(own & seeds(v)) >= 2 and brute_align(v, w) >= len(v):
                want.add((i, j))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in short], "doc_id bigint, text string")
    asked = spark.createDataFrame([(j, " ".join(v)) for j, v in items], "item_id bigint, text string")
    got = {(r.doc, r.item_id) for r in decontaminate.contaminated(docs, asked).toLocalIterator()}
    assert got == want and want
