"""Alignment of two tokenizers against encoding whole texts and plain loops."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from casewright.llm import crosstokens, queries

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


class Plain:
    """Groups of a text, from the libraries' own encoding of the whole text."""

    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(crosstokens.default_path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=crosstokens.default_path("piece_bpe_32k.model"))
        self.byte = {c: b for b, c in crosstokens.Aligner._byte_chars().items()}

    def groups(self, text: str | None) -> list[tuple[list[int], list[int]]]:
        if not text:
            return []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        bytes_a = [bytes(self.byte[c] for c in self.a.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [self.b.id_to_piece(i)]]
        if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            return []
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        out, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            p, q = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
            out.append((a[i:p], b[j:q]))
            i, j = p, q
        return out


def said(groups: list) -> str:
    return ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)


def brute(rows: list[tuple]) -> list[tuple]:
    plain = Plain()
    of = [(d, plain.groups(t)) for d, t in rows]
    links = [Counter((a, b) for x, y in g for a in x for b in y) for _, g in of]
    count = Counter(p for c in links for p in c)
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for (d, g), c in zip(of, links, strict=True):
        sha = hashlib.sha256(said(g).encode()).hexdigest() if g else ""
        out.append((d, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(c.values()), sum(n for p, n in c.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in c.items()), sha))
    return out


def same(got, want) -> None:
    key = lambda r: tuple((x is None, x or 0 if not isinstance(x, str) else x) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op11_cross_tokenizer_alignment(spark, sf)
    assert [f.dataType.simpleString() for f in got.schema][:8] == ["bigint"] * 7 + ["string"]
    same(got.select(COLUMNS).collect(), brute(rows))


def test_odd_rows(odd, spark):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    rows += [(None, "a null id"), (None, None), (30, "a▁b and more"), (31, " ▁"), (32, "<|endoftext|> <s></s> <0x41>"), (33, "x" * 5000), (34, " " * 700 + "\n" * 300), (35, "word.\nNext, one.  Two three 　four\x00"), (36, "你好" * 300), (37, "\U0001f600\U0001f469‍\U0001f467" * 40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    same(crosstokens.align(docs).select(COLUMNS).collect(), brute(rows))


def test_empty(no_rows, spark):
    assert crosstokens.align(no_rows).count() == 0
    none = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert sorted(map(tuple, crosstokens.align(none).collect())) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


@pytest.mark.parametrize("seed", range(4))
def test_parts_are_aligned_as_whole_texts(seed):
    rng, plain = random.Random(seed), Plain()
    bits = ["the", "Étion", "over-the", "don't", "I'll", "a.b", "U.S.", "12,5", "1.", "x!?", "…", " ", "  ", "\n", "\r\n", "\t", ".", ",", ";", "'s", " ", " ", "\u0085", "你好", "ſ", "Ǆ", "ʰ", "ª", "²", "́", "\U0001f600", "_", "<s>", "{\r", ");", "▁", "\x1c", "​", "ZZZ" * 30]
    for _ in range(1500):
        text = "".join(rng.choice(bits) + rng.choice(["", " ", " ", ". ", ",\n", "\n"]) for _ in range(rng.randrange(1, 14)))
        assert crosstokens.groups(text) == plain.groups(text), repr(text)


def test_long_texts_are_cut(monkeypatch):
    rng, plain = random.Random(9), Plain()
    text = " ".join(rng.choice(["word", "Two,", "three.\nfour", "  ", "\n"]) for _ in range(4000))
    monkeypatch.setattr(crosstokens, "SLICE", 512)
    assert len(list(crosstokens._pieces(text.encode()))) > 10
    assert crosstokens.groups(text) == plain.groups(text)


def test_wide_groups_count_the_same(monkeypatch):
    aligner = crosstokens.Aligner(crosstokens.default_path("byte_bpe_50k.json"), crosstokens.default_path("piece_bpe_32k.model"))
    text = ["ʰʰʰ one two three " + "\U0001f600" * 9, "ünder " * 4]
    data = [t.encode() for t in text]
    want = aligner.texts(data)
    aligner.clear()
    monkeypatch.setattr(crosstokens, "WIDE", 1)
    for x, y in zip(want, aligner.texts(data), strict=True):
        assert list(np.ravel(x)) == list(np.ravel(y))


def test_bounds_start_anew(monkeypatch):
    aligner = crosstokens.Aligner(crosstokens.default_path("byte_bpe_50k.json"), crosstokens.default_path("piece_bpe_32k.model"))
    data = [b"one two three, four."]
    want = aligner.texts(data)
    monkeypatch.setattr(crosstokens, "MOST_ROWS", 2)
    assert aligner.texts(data)[1] == want[1] and aligner.rows == 6


def test_pack():
    pairs, times = np.sort(np.random.default_rng(2).choice(1 << 30, 900, replace=False)), np.arange(900)
    got = crosstokens.unpack(crosstokens.pack(pairs, times))
    assert (got[0] == pairs).all() and (got[1] == times).all()
    assert len(crosstokens.unpack(crosstokens.pack(pairs[:0], times[:0]))[0]) == 0
