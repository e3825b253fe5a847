"""Near-duplicate groups and components against brute force."""

from __future__ import annotations

import random
import re

import numpy as np

from casewright.llm import minhash
from casewright.llm.components import components, extended

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text: str | None, n: int) -> frozenset:
    w = WORD.findall((text or "").encode().lower())
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def brute(rows: list[tuple], n: int, percent: int = 80) -> dict:
    sets = {i: shingles(t, n) for i, t in rows}
    up = {i: i for i in sets}

    def find(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def result(docs, n: int) -> dict:
    return {r.doc: (r.n, r.component, r.keep) for r in minhash.near_duplicates(docs, n=n).toLocalIterator()}


def test_odd_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.toLocalIterator()]
    for n in (2, 5):
        assert result(odd, n) == brute(rows, n)


def test_corpus(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.toLocalIterator()]
    for n in (2, 5):
        assert result(docs, n) == brute(rows, n)


def test_chain_of_edits(spark):
    rng = random.Random(9)
    words, rows = [f"w{i}" for i in range(120)], []
    for k in range(60):
        rows.append((k, " ".join(words)))
        words[rng.randrange(120)] = f"new{k}"
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert result(docs, 2) == brute(rows, 2)


def test_empty(no_rows):
    assert not result(no_rows, 2)


def test_min_max_agrees_with_similarity():
    rng = np.random.default_rng(3)
    pool = rng.integers(1, 1 << 63, 3000, dtype=np.uint64)
    a, b = pool[:2700], pool[300:]  # 2400 of 3000 in common
    sig = minhash.signature(np.concatenate([a, b]), np.array([0, 2700]))
    assert 0.7 < (sig[:, 0] == sig[:, 1]).mean() < 0.9
    keys = minhash.band_keys(sig)
    assert 0.03 < (keys[0] == keys[1]).mean() < 0.4


def test_components_on_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(100, 190)]
    star = [(5, i) for i in range(300, 360)]
    out = {r.id: r.component for r in components(spark.createDataFrame([*path, *star, (7, 7)], "a bigint, b bigint")).toLocalIterator()}
    assert all(out[i] == 100 for i in range(100, 191)) and all(out[i] == 5 for i in range(300, 360))


def test_components_grow_by_further_links(spark):
    edges = lambda *rows: spark.createDataFrame(list(rows), "a bigint, b bigint")
    labels = extended(None, edges((1, 2), (3, 4), (5, 6)))
    assert extended(labels, edges((1, 2), (2, 1))) is labels
    labels = extended(labels, edges((4, 2), (5, 9), (7, 8), (9, 10)))
    assert {r.id: r.component for r in labels.toLocalIterator()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 9: 5, 10: 5, 7: 7, 8: 7}


def made_pairs(shared: int, size: int, count: int) -> np.ndarray:
    """Signatures of pairs of sets with ``shared`` of ``2 * size - shared`` values in common."""
    rng = np.random.default_rng(shared)
    values = []
    for _ in range(count):
        pool = rng.integers(1, 1 << 63, 2 * size - shared, dtype=np.uint64)
        values += [pool[:size], pool[size - shared :]]
    return minhash.signature(np.concatenate(values), np.arange(2 * count) * size)


def test_recall_and_selectivity_of_bands_and_sketch():
    rng_limit, few = made_pairs(160, 180, 3000), made_pairs(72, 126, 3000)  # similarities 0.8 and 0.4
    for sig, low, high in ((rng_limit, 0.999, 1), (few, 0, 0.08)):
        keys = minhash.band_keys(sig)
        meet = (keys[::2] == keys[1::2]).any(axis=1)
        assert low <= meet.mean() <= high
        words = minhash.sketches(sig)
        agree = 512 - np.bitwise_count(words[:, ::2] ^ words[:, 1::2]).sum(axis=0)
        near = agree >= minhash.least_agreement(80)
        assert near.all() if low else near.mean() < 0.01


def test_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (None, None), (4, text), (4, "too short"), (9, text + " more"), (9, text + " more")]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), n=2)
    assert sorted(map(tuple, out.toLocalIterator()), key=str) == sorted([(None, 59, None, True), (None, 0, None, True), (4, 59, 4, True), (9, 60, 4, False)], key=str)
