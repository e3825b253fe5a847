"""WARC archives in Zstandard, one frame for each record.

An archive starts with a skippable frame that holds the dictionary; each record
is a frame of its own compressed with it.  The writer stores the first of equal
payloads and lets the others revisit it; the reader cuts frames by their block
heads, decodes one at a time and checks versions, heads, lengths and digests.
Archives are rows of a table in the shared folder; the reader takes those as
well as files from the ``binaryFile`` source.

Defined cases: null html is an empty payload; a null url has no target line and
a null page_id no id line, and both read back as null; among equal payloads a
null page_id comes after all others, and where no row has an id all are
responses; rows that repeat the smallest page_id of equal payloads are
all responses; an empty table makes no archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm.storage import materialize

DICT_FRAME, FRAME = 0x184D2A5D, 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


class BadArchive(ValueError):
    """An archive or record that breaks the format."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    h = hashlib.md5(f"page {page_id}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if url is not None:
        plain = url.isascii() and url.isprintable() and url == url.strip()
        lines.append(f"WARC-Target-URI: {url}" if plain else f"X-Target-Base64: {base64.b64encode(url.encode('utf-8', 'surrogatepass')).decode()}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields of one record; raises BadArchive if a head or length is wrong."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise BadArchive(f"not a record: {raw[:20]!r}")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise BadArchive(f"bad head line {line!r}")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise BadArchive(f"no {name}")
    if not fields["content-length"].isdecimal() or rest[int(fields["content-length"]) :] != b"\r\n\r\n":
        raise BadArchive(f"the block is not of length {fields['content-length']}")
    http, found, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    size = dict(x.partition(b":")[::2] for x in http.split(b"\r\n")[1:]).get(b"Content-Length", b"").strip()
    if not found or not size.isdigit():
        raise BadArchive("the block has no HTTP head")
    kind, wanted = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and (len(payload) != int(size) or digest(payload) != wanted):
        raise BadArchive(f"the payload of {fields['warc-record-id']} does not match its length or digest")
    if kind not in ("response", "revisit") or kind == "revisit" and (payload or "x-refers-to-page" not in fields):
        raise BadArchive(f"bad record of type {kind}")
    url = base64.b64decode(fields["x-target-base64"]).decode("utf-8", "surrogatepass") if "x-target-base64" in fields else fields.get("warc-target-uri")
    return {"page_id": int(fields["x-page-id"]) if "x-page-id" in fields else None, "url": url, "payload": payload if kind == "response" else None, "payload_bytes": int(size), "payload_digest": wanted, "record_type": kind, "refers_to": int(fields["x-refers-to-page"]) if kind == "revisit" else None}


def frame_end(data: memoryview, at: int) -> int:
    """End of the Zstandard frame at ``at``, from its head and block heads."""
    if len(data) < at + 6 or struct.unpack_from("<I", data, at)[0] != FRAME:
        raise BadArchive(f"no frame at byte {at}")
    flags = data[at + 4]
    single, size_flag = flags >> 5 & 1, flags >> 6
    end = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[size_flag]
    while True:
        if len(data) < end + 3:
            raise BadArchive(f"the frame at byte {at} is cut short")
        head = data[end] | data[end + 1] << 8 | data[end + 2] << 16
        end += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            break
    end += 4 * (flags >> 2 & 1)
    if end > len(data):
        raise BadArchive(f"the frame at byte {at} is cut short")
    return end


class Archive:
    """Collects records; ``data()`` is the archive."""

    def __init__(self, dictionary: bytes):
        self.parts = [struct.pack("<II", DICT_FRAME, len(dictionary)), dictionary]
        self.size = 0
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)

    def add(self, record: bytes) -> None:
        self.parts.append(self.compressor.compress(record))
        self.size += len(self.parts[-1])

    def data(self) -> bytes:
        return b"".join(self.parts)


def read_archive(data: bytes) -> Iterator[dict]:
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != DICT_FRAME:
        raise BadArchive("no leading dictionary frame")
    at = 8 + struct.unpack_from("<I", data, 4)[0]
    dictionary = data[8:at]
    if dictionary[:4] == struct.pack("<I", FRAME):
        dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
    decompressor, view = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)), memoryview(data)
    while at < len(data):
        end = frame_end(view, at)
        try:
            raw = decompressor.decompress(view[at:end])
        except zstandard.ZstdError as e:
            raise BadArchive(f"the frame at byte {at} does not decode: {e}") from e
        yield parse_record(raw)
        at = end


def train(pages: DataFrame, html_col: str, sample_rows: int, size: int) -> bytes:
    """A dictionary from the first 16,384 characters of at most ``sample_rows`` different payloads.

    They are drawn by a hash of the html; copies count once, so that the driver
    gets no more than ``sample_rows`` of them however often a payload occurs.
    """
    share = min(1.0, 2 * sample_rows / max(1, pages.agg(F.approx_count_distinct(html_col)).first()[0]))
    starts = pages.select(F.xxhash64(html_col).alias("h"), F.substring(html_col, 1, 16_384).alias("start"))
    drawn = starts.where(F.pmod("h", F.lit(1_000_000)) < max(1, int(share * 1_000_000))).groupBy("h").agg(F.first("start").alias("start"))
    rows = drawn.orderBy("h").limit(sample_rows).select("start").toLocalIterator()
    samples = [make_record(0, "https://example.org/", (r[0] or "").encode(), None) for r in rows]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples: a plain prefix serves as well
        return b"".join([make_record(0, "https://example.org/", b"<!DOCTYPE html><html><head><body><p>", None), *samples])[:size]


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, sample_rows: int = 1000, dictionary_bytes: int = 32_768, archive_bytes: int = 8_000_000, broadcast_rows: int = 200_000) -> DataFrame:
    """(path, content): archives of about ``archive_bytes`` in the shared folder."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"))
    dictionary = train(rows, "html", sample_rows, dictionary_bytes)
    keyed = rows.withColumn("sha", F.sha1(F.encode("html", "UTF-8")))
    repeated = keyed.where(F.octet_length("html") >= min_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    repeated = materialize(repeated, "repeated")
    if repeated.count() <= broadcast_rows:
        repeated = F.broadcast(repeated)
    roles = keyed.join(repeated, "sha", "left").select("page_id", "url", "html", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, archive = TaskContext.get().partitionId(), 0, None

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}-{seq:06d}.warc.zst"]), pa.array([archive.data()], pa.binary())], names=["path", "content"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                archive = archive or Archive(dictionary)
                archive.add(make_record(row[0], row[1], row[2].encode(), row[3]))
                if archive.size >= archive_bytes:
                    yield flush()
                    seq, archive = seq + 1, None
        if archive:
            yield flush()

    return materialize(roles.mapInArrow(run, "path string, content binary"), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """RECORD columns and the payload (null for revisits) of each record of (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for content in batch.column(0):
                held = []
                for r in read_archive(content.as_py()):
                    held.append(r)
                    if len(held) == 1000:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return archives.select("content").mapInArrow(run, f"{RECORD}, payload binary")
