"""The pipeline's stages, each on its own input."""

from __future__ import annotations

import corpus_pipeline
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_near import brute as brute_near


def test_stages(spark, sf):
    docs = corpus_pipeline.table(spark, sf, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.toLocalIterator()]
        docs = corpus_pipeline.materialize(stage(spark, docs, sf), "test")
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    before, after = seen["language_id"]
    assert len(before) - after.count() < 0.05 * len(before)
    before, after = seen["line_dedup"]
    want = brute_lines(before)
    assert {r.doc_id: r.text for r in after.toLocalIterator()} == {i: w[2] for i, w in want.items()}
    assert all(r.n_chars == len(r.text) for r in after.toLocalIterator())
    before, after = seen["near_dedup"]
    assert {r.doc_id for r in after.toLocalIterator()} == {i for i, w in brute_near(before, 5).items() if w[2]}
    before, after = seen["packing"]
    assert {r.doc_id for r in after.toLocalIterator()} == {i for i, _ in before}
    # the whole run packs the same pieces
    pieces = ["doc_id", "piece", "start", "length", "ids_crc32"]
    whole = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, whole.select(pieces).toLocalIterator())) == sorted(map(tuple, after.select(pieces).toLocalIterator()))
    # what decontamination lets go holds a passage, by plain search for its words
    before, after = seen["decontamination"]
    left = {r.doc_id for r in after.toLocalIterator()}
    items = [" ".join(r.text.lower().split()) for r in corpus_pipeline.table(spark, sf, "benchmark").toLocalIterator()]
    copies = {i for i, t in before if any(f" {item} " in f" {' '.join((t or '').lower().split())} " for item in items)}
    assert copies and not copies & left


def test_odd_rows(spark, odd, no_rows, sf):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (odd, odd.select(columns), no_rows.select(columns), spark.createDataFrame([(None, "null id " * 30, "en", None, None)], "doc_id bigint, text string, lang string, source string, n_chars bigint")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            if name != "packing":
                assert out.columns == docs.columns
            docs = corpus_pipeline.materialize(out, "odd")
