"""Importance resampling against dictionaries of n-grams."""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter

import numpy as np

from casewright.llm import queries, resample

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def features(text: str | None) -> tuple[int, list[int]]:
    w = WORD.findall((text or "").translate(LOW))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(docs: list[tuple], bench: list[str | None]) -> list[tuple]:
    of = [(d, *features(t)) for d, t in docs]
    s, t = Counter(b for x in of for b in x[2]), Counter(b for x in bench for b in features(x)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (total_s + 10000) / ((s[b] + 1) * (total_t + 10000)))) for b in range(10000)}
    out = []
    for d, n, f in of:
        h = int(hashlib.sha256(f"42:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((x for x in out if x[4] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    k = 5 * len(able) // 100
    ranks = [(*x[:4], i + 1 if i < k else None) for i, x in enumerate(able)]
    return ranks + [(*x[:4], None) for x in out if x[4] < 20]


def same(got, want) -> None:
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


COLUMNS = ["doc_id", "n_features", "weight", "score", "rank"]


def test_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = queries.op12_importance_resampling(spark, sf)
    assert got.schema.simpleString().startswith("struct<doc_id:bigint,n_features:bigint,weight:bigint,score:bigint,rank:bigint")
    same(got.select(COLUMNS).collect(), brute(docs, bench))


def test_odd_rows(odd, spark):
    rows = [(r.doc_id, r.text) for r in odd.collect()] + [(None, "a null id " * 20), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = [None, "", "one two THREE", "a null id", "z" * 3000, "x"]
    got = resample.resample(docs, spark.createDataFrame([(x,) for x in bench], "text string"), share=(5, 100))
    same(got.select(COLUMNS).collect(), brute(rows, bench))
    assert resample.resample(odd, odd.where("false")).count() == odd.count()


def test_empty(no_rows, odd):
    assert resample.resample(no_rows, odd).count() == 0


def test_many_ties_have_one_rank_each(spark):
    docs = spark.range(4000).selectExpr("id % 40 as doc_id", "repeat('same words ', 30) as text")
    got = [r.rank for r in resample.resample(docs, docs.limit(1)).where("rank is not null").collect()]
    assert sorted(got) == list(range(1, 201))


def test_hashes_of_long_words_and_deep_grams():
    rng = random.Random(3)
    long = ["".join(rng.choice("abcé0") for _ in range(n)) for n in (1, 2, 47, 48, 49, 95, 96, 97, 5000, 300_000)]
    texts = [" ".join(rng.choice(long) for _ in range(30)) for _ in range(4)] + ["", "-", "a", "a b", "A-b.c"]
    bucket, owner, counts = resample.buckets_of([t.encode() for t in texts], 3, 10000)
    for k, t in enumerate(texts):
        n, want = features(t)
        assert counts[k] == n and Counter(bucket[owner == k].tolist()) == Counter(want)
    for n in (0, 1, 48, 49, 100_003):
        a, b = b"left side", bytes(rng.randrange(256) for _ in range(n))
        assert int(resample._moved(np.array([zlib.crc32(a)], np.uint32), np.array([n]))[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_pack():
    x = np.sort(np.random.default_rng(1).integers(0, 10000, 5000))
    assert (resample.unpack(resample.pack(x)) == x).all() and len(resample.unpack(resample.pack(x[:0]))) == 0
