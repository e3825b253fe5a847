"""Archives: brute-force roles, exact payloads, damage."""

from __future__ import annotations

import base64
import hashlib

import pytest

from casewright.llm import warc


def brute(rows: list[tuple], least: int = 0) -> set:
    first = {}
    for i, html in rows:
        first[html or ""] = min(i, first.get(html or "", i))
    out = set()
    for i, html in rows:
        p = (html or "").encode()
        again = first[html or ""] != i and len(p) >= least
        out.add((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", first[html or ""] if again else None))
    return out


def result(pages, **more) -> set:
    return {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(warc.write_archives(pages, **more)).toLocalIterator()}


def test_corpus(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert result(pages) == brute([(r.page_id, r.html) for r in pages.toLocalIterator()])


def test_odd_rows(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (3, "a\nb", "ü" * 50, None), (4, "u", "ü" * 50, "x"), (5, "u", "\r\n\r\n", "x"), (6, "u", "x" * 300_000, "x"), (7, "u", "x" * 300_000, "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, payload string")
    for least in (0, 200):
        assert result(pages, min_bytes=least) == brute([(r[0], r[2]) for r in rows], least)
    urls = {r.page_id: r.url for r in warc.read_archives(warc.write_archives(pages)).toLocalIterator()}
    assert urls[2] is None and urls[3] == "a\nb"
    assert not result(pages.limit(0))


def test_null_page_ids(spark):
    rows = [(None, "u", "alone"), (None, "v", "both"), (7, "u", "both"), (9, None, "both"), (None, "u", "twice"), (None, "u", "twice"), (None, None, None)]
    out = warc.read_archives(warc.write_archives(spark.createDataFrame(rows, "page_id bigint, url string, html string")))
    got = sorted(((r.page_id, r.url, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload).decode()) for r in out.toLocalIterator()), key=str)
    want = [(None, "u", "response", None, "alone"), (None, "v", "revisit", 7, None), (7, "u", "response", None, "both"), (9, None, "revisit", 7, None), (None, "u", "response", None, "twice"), (None, "u", "response", None, "twice"), (None, None, "response", None, "")]
    assert got == sorted(want, key=str)


def test_dictionary_sample_is_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(warc.zstandard, "train_dictionary", lambda size, samples: seen.append(samples) or warc.zstandard.ZstdCompressionDict(b"some words"))
    pages = spark.createDataFrame([(k, "hot" if k < 600 else f"page {k}") for k in range(620)], "page_id bigint, html string")
    warc.train(pages, "html", 1000, 4096)
    warc.train(pages, "html", 8, 4096)
    assert len(seen[0]) == len(set(seen[0])) == 21 and 0 < len(seen[1]) <= 8


def test_payloads_come_back(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    html = {r.page_id: (r.html or "").encode() for r in pages.toLocalIterator()}
    for r in warc.read_archives(warc.write_archives(pages, archive_bytes=20_000)).toLocalIterator():
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == html[r.page_id]


def test_damage_is_seen():
    a = warc.Archive(b"WARC/1.1 text/html <p> a small dictionary of a few words")
    for k in range(3):
        a.add(warc.make_record(k, "http://x/", b"<p>payload</p>" * 20, None))
    data = a.data()
    assert [r["page_id"] for r in warc.read_archive(data)] == [0, 1, 2]
    for bad in (data[:-4], data[8:], b"", data[:-30] + bytes([data[-30] ^ 255]) + data[-29:], data + b"junk"):
        with pytest.raises((warc.BadArchive, ValueError)):
            list(warc.read_archive(bad))
    record = warc.make_record(1, "u", b"payload", None)
    for old, new in ((b"Content-Length: 7", b"Content-Length: 8"), (b"WARC/1.1", b"WARC/9.9"), (b"payload\r\n", b"paylOad\r\n"), (b"WARC-Date", b"X-Date")):
        with pytest.raises(warc.BadArchive):
            warc.parse_record(record.replace(old, new))


def test_archives_as_files(spark, sf, tmp_path):
    """Each row is a whole archive: as a file of its own it reads the same."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    made = warc.write_archives(pages, archive_bytes=50_000).collect()
    assert len(made) > 1
    for k, r in enumerate(made):
        (tmp_path / f"{k:03}.warc.zst").write_bytes(r.content)
    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(files).toLocalIterator()}
    assert got == brute([(r.page_id, r.html) for r in pages.toLocalIterator()])
