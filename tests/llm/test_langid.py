"""Kneser-Ney models: sums, held-out accuracy, rejection and awkward rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from casewright.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs.where(langid.fold() != 0))
    out = langid.identify(docs, model).join(docs.select("doc_id", "lang"), langid.F.col("doc") == langid.F.col("doc_id")).where(langid.fold() == 0).toPandas()
    known = out[out["lang"].notna() & (out["lang_pred"] != "und")]
    assert (known["lang"] == known["lang_pred"]).mean() > 0.97
    assert known["rejected"].mean() < 0.05
    assert out["score"].between(0, 1).all()


def model_of(texts: dict[str, str]) -> langid.Model:
    tables = []
    for t in texts.values():
        tables.append(np.unique(langid.grams(langid.symbols(t), langid.ORDER), return_counts=True))
    return langid.Model(list(texts), tables)


def test_chances_of_a_context_sum_to_one():
    text = "the cat sat on the mat and the rat ran to the bat " * 3
    model = model_of({"a": text})
    alphabet = [ord(c) for c in "abcdefghijklmnopqrstuvwxyz"] + [0]
    own = set(langid.symbols(text).tolist())
    for context in (" th", "the", "at "):
        head = [0 if c == " " else ord(c) for c in context]
        g = np.array([(head[0] << 48) | (head[1] << 32) | (head[2] << 16) | s for s in alphabet if s in own], np.uint64)
        total = np.exp2(model.scores(g)[:, 0].astype(float)).sum()
        assert 0.9 < total <= 1.0001


def test_rejects_other_scripts_and_noise(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs.where(langid.fold() != 0))
    odd = spark.createDataFrame([(1, "съешь ещё этих мягких французских булок да выпей чаю " * 3, "en"), (2, "zqxj vkqz xxqj wvzk qqzx jjkq zzvx qwqk jxzq vvkk " * 3, "en"), (3, "1234 5678", "en"), (4, None, None)], "doc_id bigint, text string, lang string")
    assert all(r.rejected for r in langid.identify(odd, model).toLocalIterator())
    kept = langid.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() > 0.93 * docs.count()


def test_odd_rows(spark, odd, no_rows):
    model = langid.train(odd)
    out = {r.doc: r for r in langid.identify(odd, model).toLocalIterator()}
    assert out[0].lang_pred == out[1].lang_pred == out[15].lang_pred == out[17].lang_pred == "und" and out[0].score == 0
    assert out[5].lang_pred == "en"
    assert langid.identify(no_rows, model).count() == 0
    none = langid.train(no_rows)
    assert {r.lang_pred for r in langid.identify(odd, none).toLocalIterator()} == {"und"}
    assert langid.accepted(odd, none).count() == 0


def test_one_letter_is_text(spark):
    docs = spark.createDataFrame([(1, "the hat and the cat that sat there " * 9, "en"), (2, "żółw żuje żyto że aż żal ż żaby " * 9, "pl")], "doc_id bigint, text string, lang string")
    model = langid.train(docs)
    texts = spark.createDataFrame([(1, "H."), (2, " ż "), (3, "7."), (4, "7" * 600_000 + "ż")], "doc_id bigint, text string")
    out = {r.doc: r for r in langid.identify(texts, model).toLocalIterator()}
    assert [out[k].lang_pred for k in (1, 2, 3, 4)] == ["en", "pl", "und", "pl"]
    assert 0 < out[1].score <= 1 and not out[1].rejected and out[3].score == 0 and out[3].rejected
    assert sorted(r.doc_id for r in langid.accepted(texts, model).toLocalIterator()) == [1, 2, 4]


def test_a_large_language_takes_nothing_from_a_small_one(spark):
    rng = np.random.default_rng(8)
    large = ["".join(map(chr, rng.integers(0x4E00, 0x9F00, 55_000))) for _ in range(20)]
    small = "the cat sat on the mat and a dog ran by"
    rows = [(k, t, "large") for k, t in enumerate(large * 2)] + [(99, small, "small")]
    model = langid.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert model.langs == ["large", "small"]
    want = {int(g) for t in [*large, small] for g in langid.grams(langid.symbols(t), langid.ORDER)}
    assert len(model.keys[-1]) == len(want) > 1_000_000
    assert langid.identify(spark.createDataFrame([(1, small)], "doc_id bigint, text string"), model).first().lang_pred == "small"


def test_chances_against_plain_kneser_ney():
    """Dictionaries of tuples: counts at order 4, numbers of left contexts below, absolute discounts."""
    from collections import Counter

    text = "the cat sat on the mat, and the rat ran to that bat; then the hen sat "
    symbols = langid.symbols(text).tolist()
    tables = [Counter(tuple(symbols[k : k + 4]) for k in range(len(symbols) - 3))]
    for _ in range(3):
        tables.insert(0, Counter(g[1:] for g in tables[0]))
    size = len(tables[0]) + 1

    def chance(gram: tuple) -> float:
        if not gram:
            return 1 / size
        own, context = tables[len(gram) - 1], gram[:-1]
        once, twice = sum(c == 1 for c in own.values()), sum(c == 2 for c in own.values())
        d = once / (once + 2 * twice) if once and twice else 0.5
        total = sum(c for g, c in own.items() if g[:-1] == context)
        if not total:
            return chance(gram[1:])
        kinds = sum(g[:-1] == context for g in own)
        return max(own.get(gram, 0) - d, 0) / total + d * kinds / total * chance(gram[1:])

    model = model_of({"a": text})
    letters = sorted({s for s in symbols})
    grams = [tuple(symbols[k : k + 4]) for k in range(len(symbols) - 3)] + [(a, b, c, d) for a in letters[:5] for b in letters[:5] for c in letters[:4] for d in letters]
    packed = np.array([(a << 48) | (b << 32) | (c << 16) | d for a, b, c, d in grams], np.uint64)
    got = np.exp2(model.scores(packed)[:, 0].astype(float))
    assert np.allclose(got, [chance(g) for g in grams], rtol=1e-4)


def test_limits_come_from_all_labelled_texts(spark):
    import string

    words = ["".join(string.ascii_lowercase[(k * m + k // 26) % 26] for m in (1, 3, 7, 11, 5)) for k in range(400)]
    docs = spark.range(40_000).select(F.array(*(F.lit(w) for w in words)).alias("w"), "id").select(F.concat_ws(" ", *(F.get("w", (F.col("id") * k + k) % 400) for k in (1, 3, 7, 11, 13))).alias("text"), F.lit("aa").alias("lang"))
    model = langid.train(docs)
    seen = sorted(model.entropies([r["text"] for r in docs.select("text").collect()])[0][:, 0].tolist())
    assert abs(model.limit[0] - 0.5 - seen[int(len(seen) * 0.999) - 1]) < 1e-3
