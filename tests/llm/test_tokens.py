"""Token ids, token files and packing."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from casewright.llm import packing, tokencode
from casewright.llm.tokens import default_path, encoder


def plain_ids(texts: list[str | None]) -> list[list[int]]:
    tok = Tokenizer.from_file(default_path())
    return [[*e.ids, 1] for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def pairs(docs) -> list[tuple]:
    return [(r.doc_id, r.text) for r in docs.toLocalIterator()]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aZ é.,!?'\"<|>\n\t19-ſİ你endoftxsar"), max_size=40), max_size=6))
def test_cached_words_equal_whole_texts(texts):
    ids, counts = encoder(default_path()).encode([t.encode() for t in texts])
    tok = Tokenizer.from_file(default_path())
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want if texts else not len(ids)


def test_marks_compose_before_case_goes():
    marks = [chr(x) for x in (0x300, 0x301, 0x308, 0x30A, 0x30C, 0x323, 0x327, 0x331, 0x345, 0x36F)]
    rng = np.random.default_rng(8)
    letters = [*"ABTHJWYKStxz.,!'<1", "Å", "K", "Å", "É", "İ", "ſ", "Ω", "你", "ﬁ"]
    texts = ["T\u0308est J\u030c H\u0331"]
    for _ in range(20_000):
        n = int(rng.integers(1, 9))
        texts.append("".join(rng.choice(letters) + (rng.choice(marks) if rng.random() < 0.4 else "") + (" " if rng.random() < 0.2 else "") for _ in range(n)))
    ids, counts = encoder(default_path()).encode([t.encode() for t in texts])
    want = [e.ids for e in Tokenizer.from_file(default_path()).encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want


@settings(max_examples=25, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 49_407), st.integers(0, 5)), max_size=6000))
def test_file_round_trip(ids):
    ids = np.array(ids, np.uint32)
    doc, counts, back = tokencode.decode_file(tokencode.encode_file(np.array([5, 9]), np.array([len(ids) // 2, len(ids) - len(ids) // 2]), ids, 49_408))
    assert back.tolist() == ids.tolist() and doc.tolist() == [5, 9]


def test_files_are_smaller_than_by_frequencies():
    texts = [t.as_py() or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0)]
    ids, counts = encoder(default_path()).encode([t.encode() for t in texts])
    n = np.bincount(ids)
    share = n[n > 0] / len(ids)
    data = tokencode.encode_file(np.arange(len(counts)), counts, ids, 49_408)
    assert 8 * len(data) / len(ids) < 8.0 < -(share * np.log2(share)).sum()


def test_more_ids_of_a_class_than_it_has_places(monkeypatch):
    monkeypatch.setattr(tokencode, "MEMBERS", 70)
    ids = np.concatenate([np.arange(1000), np.zeros(3000, np.int64), np.arange(1000)]).astype(np.uint32)
    prior = tokencode._Prior.of(1000, ids)
    assert np.bincount(prior.kinds).max() <= 70
    data = tokencode.encode_file(np.array([1]), np.array([len(ids)]), ids, 1000)
    assert (tokencode.decode_file(data)[2] == ids).all()


def test_damage_is_seen():
    ids = np.arange(5000, dtype=np.uint32) % 700
    data = bytearray(tokencode.encode_file(np.array([1]), np.array([5000]), ids, 49_408))
    assert len(data) < 4 * len(ids) / 2
    data[-200] ^= 64
    with pytest.raises(ValueError):
        tokencode.decode_file(bytes(data))


def check_files(docs):
    rows = sorted(pairs(docs))
    got = sorted(tuple(r) for r in tokencode.read_files(tokencode.write_files(docs)).toLocalIterator())
    want, at = [], 0
    for (i, _), ids in zip(rows, plain_ids([t for _, t in rows]), strict=True):
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert got == sorted(want)


def test_files_of_odd_rows(spark, odd):
    check_files(odd.dropDuplicates(["doc_id"]))


def test_files_of_corpus(spark, sf):
    check_files(spark.read.parquet(f"{sf}/documents.parquet"))


def test_no_files(no_rows):
    assert tokencode.read_files(tokencode.write_files(no_rows)).count() == 0


def check_packing(docs, capacity: int = 4096):
    rows = pairs(docs)
    ids = {i: x for (i, _), x in zip(rows, plain_ids([t for _, t in rows]), strict=True)}
    out = packing.pack(docs, capacity=capacity).toPandas()
    bins, found = defaultdict(list), defaultdict(list)
    for r in out.itertuples():
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert crc(own) == r.ids_crc32 and len(own) == r.length and r.start == r.piece * capacity
        bins[r.sequence_id].append((r.offset, r.length))
        found[r.doc_id].append((r.piece, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    for (i, _) in rows:
        lengths = [n for _, n in sorted(found[i])]
        assert sum(lengths) == len(ids[i]) * rows.count((i, dict(rows)[i])) or len(rows) != len(dict(rows))
    total = int(out["length"].sum())
    assert len(bins) <= max(1.03 * total / capacity + 2, int((out["length"] > capacity / 2).sum()) + 1)


def test_packing_odd_rows(odd):
    check_packing(odd)
    check_packing(odd, 64)


def test_packing_corpus(spark, sf):
    check_packing(spark.read.parquet(f"{sf}/documents.parquet"))


def test_packing_nothing(no_rows):
    assert packing.pack(no_rows).count() == 0


def test_bins_that_no_other_fits_leave_the_rounds(spark):
    sizes = [2500] * 300 + [4000] * 50 + [90] * 3 + [700]
    rest = spark.createDataFrame([(n, [i]) for i, n in enumerate(sizes)], "fill int, items array<int>")
    stays = [r.fill for r in rest.where(packing._goes_on(rest, 4096)).toLocalIterator()]
    assert sorted(x for x in stays if x < 2048) == [90, 90, 90, 700]
    assert 1 <= sum(x == 2500 for x in stays) <= 40 and 4000 not in stays
    assert packing._goes_on(rest.where("fill > 2048"), 4096) is None and packing._goes_on(rest.limit(0), 4096) is None


def test_files_of_repeated_ids(spark):
    texts = ["one two three", "four five", None, "one two three", "a much longer text than the others"]
    docs = spark.createDataFrame([(7, t) for t in texts] + [(3, "first")], "doc_id bigint, text string")
    runs = [sorted(tuple(r) for r in tokencode.read_files(tokencode.write_files(docs)).toLocalIterator()) for _ in range(2)]
    ids = plain_ids(texts)
    assert runs[0] == runs[1] and sorted(r[3] for r in runs[0] if r[0] == 7) == sorted(map(crc, ids))
    assert [r[1] for r in runs[0]] == np.cumsum([0] + [r[2] for r in runs[0]])[:-1].tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit_holds_everything_once(sizes):
    bins = packing.best_fit(sizes, 50)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 50 for b in bins)
    assert len(bins) <= 2 * sum(sizes) / 50 + 1
