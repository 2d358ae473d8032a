"""WARC archives with a Zstandard frame for each record and a dictionary in front.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the
dictionary, raw or as a Zstandard frame of its own; then every record is one
frame. Readers load the dictionary, decode frame by frame and check version
line, headers, lengths and digests. Equal payloads of some size are stored
once: the other records are revisits that name the one with the payload.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _binary, _vector
from ._common import broadcast_if_small, store

DICTIONARY_MAGIC = 0x184D2A5D
ZSTD_MAGIC = 0xFD2FB528
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Stands in records whose URL has control characters or white space at an end: they and ``%`` are percent codes there. Others are as they are.
ESCAPED = "X-Target-URI-Escaped"
#: Rows (a digest and an id) that may be broadcast: 40 MB or so.
MAX_BROADCAST = 500_000


@dataclass(frozen=True)
class Archive:
    #: Bytes after which an archive is closed; a larger record has one of its own.
    size: int = 16_000_000
    level: int = 3
    #: A dictionary is trained for each archive on its first records, up to so many bytes, and has so many.
    sample: int = 2_000_000
    dictionary: int = 32_768
    date: str = "2024-01-01T00:00:00Z"
    #: Equal payloads of so many bytes or more are stored once.
    revisit_from: int = 1000


class WarcError(ValueError):
    """An archive that breaks the format."""


def sha1_label(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _odd(url: str) -> bool:
    """Whether a header line would not bring the URL back as it is."""
    return url != url.strip() or any(c < " " or c == "\x7f" for c in url)


def _escaped(url: str) -> str:
    return "".join(f"%{ord(c):02X}" if c <= " " or c in "%\x7f" else c for c in url)


def _unescaped(value: str) -> str:
    return re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), value)


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page(record: str) -> int | None:
    if not (record.startswith("<urn:page:") and record.endswith(">")):
        raise WarcError(f"not a record id: {record[:80]}")
    return None if record[10:-1] == "null" else int(record[10:-1])


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record; a revisit, whose block ends after the HTTP header, if ``refers_to`` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", date)]
    if url is not None:
        head += [("WARC-Target-URI", _escaped(url)), (ESCAPED, "percent")] if _odd(url) else [("WARC-Target-URI", url)]
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    head += [("WARC-Payload-Digest", digest), ("WARC-Block-Digest", sha1_label(block)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def _headers(data: bytes, what: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for line in data.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise WarcError(f"a line of the {what} header has no name: {line[:80]!r}")
        found[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return found


def parse_record(data: bytes) -> dict:
    """Headers, type, ids, length, digest and payload (None of a revisit) of one record; WarcError if anything is wrong."""
    if not data.startswith(VERSION):
        raise WarcError(f"no version line: {data[:20]!r}")
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise WarcError("the header does not end")
    head = _headers(data[len(VERSION) : end], "record")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in head:
            raise WarcError(f"no {name}")
    if not head["content-length"].isdigit():
        raise WarcError(f"Content-Length: {head['content-length'][:40]}")
    start, length = end + 4, int(head["content-length"])
    block = data[start : start + length]
    if len(block) != length or data[start + length :] != b"\r\n\r\n":
        raise WarcError(f"Content-Length is {length}, the block has {len(data) - start - 4} bytes")
    if head.get("warc-block-digest", want := sha1_label(block)) != want:
        raise WarcError("the block digest differs")
    cut = block.find(b"\r\n\r\n")
    if cut < 0 or not block.startswith(b"HTTP/"):
        raise WarcError("the block has no HTTP header")
    http = _headers(block[block.find(b"\r\n") + 2 : cut], "HTTP")
    size = http.get("content-length", "")
    if not size.isdigit():
        raise WarcError("the HTTP header has no Content-Length")
    payload, kind = block[cut + 4 :], head["warc-type"]
    if kind == "response":
        if len(payload) != int(size):
            raise WarcError(f"the payload should have {size} bytes; it has {len(payload)}")
        if head.get("warc-payload-digest", want := sha1_label(payload)) != want:
            raise WarcError("the payload digest differs")
        refers_to = None
    elif kind == "revisit":
        if payload or "warc-refers-to" not in head or "warc-payload-digest" not in head:
            raise WarcError("a revisit has a payload, or no reference")
        refers_to, payload = _page(head["warc-refers-to"]), None
    else:
        raise WarcError(f"type {kind[:40]}")
    url = head.get("warc-target-uri")
    url = _unescaped(url) if url is not None and ESCAPED.lower() in head else url
    label = head.get("warc-payload-digest") or sha1_label(payload)
    if not label.startswith("sha1:"):
        raise WarcError(f"digest {label[:40]}")
    return {
        "page_id": _page(head["warc-record-id"]), "url": url, "record_type": kind, "refers_to": refers_to,
        "payload_bytes": int(size), "payload_digest": base64.b32decode(label[5:]).hex(), "payload": payload,
    }


def train(samples: list[bytes], size: int) -> zstandard.ZstdCompressionDict | None:
    """A dictionary, or None where the samples are too few for one."""
    if len(samples) < 8:
        return None
    try:
        return zstandard.train_dictionary(size, samples)
    except zstandard.ZstdError:
        return None


class Writer:
    """Gathers records into archives."""

    def __init__(self, p: Archive):
        self.p, self.waiting, self.waiting_size, self.out, self.compressor = p, [], 0, bytearray(), None

    def add(self, record: bytes) -> Iterator[bytes]:
        if self.compressor is None:
            self.waiting.append(record)
            self.waiting_size += len(record)
            if self.waiting_size >= self.p.sample:
                self._begin()
        else:
            self.out += self.compressor.compress(record)
        if len(self.out) >= self.p.size:
            yield from self.finish()

    def _begin(self) -> None:
        found = train(self.waiting, min(self.p.dictionary, max(1024, self.waiting_size // 10)))
        if found is None:
            self.compressor = zstandard.ZstdCompressor(level=self.p.level)
        else:
            raw = zstandard.ZstdCompressor(level=self.p.level).compress(found.as_bytes())
            self.out += DICTIONARY_MAGIC.to_bytes(4, "little") + len(raw).to_bytes(4, "little") + raw
            self.compressor = zstandard.ZstdCompressor(level=self.p.level, dict_data=found)
        for x in self.waiting:
            self.out += self.compressor.compress(x)
        self.waiting, self.waiting_size = [], 0

    def finish(self) -> Iterator[bytes]:
        if self.waiting:
            self._begin()
        if self.out:
            yield bytes(self.out)
        self.out, self.compressor = bytearray(), None


def frames(archive: bytes) -> Iterator[bytes]:
    """The decoded records of an archive, one for each frame. Skippable frames after the first are passed over."""
    view, at, first = memoryview(archive), 0, True
    decompressor = zstandard.ZstdDecompressor()
    while at < len(view):
        if len(view) - at < 8:
            raise WarcError("bytes after the last frame")
        magic = int.from_bytes(view[at : at + 4], "little")
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            end = at + 8 + int.from_bytes(view[at + 4 : at + 8], "little")
            if end > len(view):
                raise WarcError("a skippable frame is cut off")
            if first and magic == DICTIONARY_MAGIC:
                raw = bytes(view[at + 8 : end])
                if raw[:4] == ZSTD_MAGIC.to_bytes(4, "little"):
                    raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
                decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
            at = end
        elif magic == ZSTD_MAGIC:
            one = decompressor.decompressobj()
            parts, step = [], 65_536
            try:
                while not one.eof:
                    if at >= len(view):
                        raise WarcError("a frame is cut off")
                    parts.append(one.decompress(view[at : at + step]))
                    at += min(step, len(view) - at)
            except zstandard.ZstdError as e:
                raise WarcError(f"a frame can't be decoded: {e}") from e
            at -= len(one.unused_data)
            yield b"".join(parts)
        else:
            raise WarcError(f"no frame begins with {magic:#x}")
        first = False


def with_types(pages: DataFrame, p: Archive = Archive(), owner: str = "") -> DataFrame:
    """Rows page_id, url, html, digest (SHA-1, hex) and ``refers_to``: null for a response.

    Only digests and ids are shuffled, and digests are aggregated first, so a
    payload that a third of the rows share is no hot key. Rows with the
    largest id of their payload are all responses.
    """
    html = F.coalesce("html", F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    large = base.where(F.octet_length("html") >= p.revisit_from).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("first")).where("n > 1")
    repeated = broadcast_if_small(store(large.select("digest", "first"), "warc-repeated", owner), MAX_BROADCAST)
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first"))
    return base.join(repeated, "digest", "left").select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def write_archives(pages: DataFrame, path: str, p: Archive = Archive(), owner: str = "") -> None:
    """Write a record for every row of ``pages`` (page_id, url, html) to archives below ``path``.

    A null html is an empty payload, a null id or url has no value in the
    record; repeated rows are records of their own. Other columns are not
    looked at. Empty pages give no archive.
    """

    def pack(batches):
        writer = Writer(p)
        for batch in batches:
            for part in _vector.pieces(batch, "html"):
                columns = [part.column(c).to_pylist() for c in ("page_id", "url", "digest", "refers_to")]
                for page_id, url, digest, refers_to, html in zip(*columns, part.column("html"), strict=True):
                    label = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
                    record = make_record(page_id, url, bytes(html.as_buffer() or b""), label, refers_to, p.date)
                    for archive in writer.add(record):
                        yield pa.RecordBatch.from_arrays([pa.array([archive], pa.binary())], ["data"])
        for archive in writer.finish():
            yield pa.RecordBatch.from_arrays([pa.array([archive], pa.binary())], ["data"])

    _binary.write_files(with_types(pages, p, owner).mapInArrow(pack, "data binary"), path)


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row for each record: page_id, url, record_type, refers_to, payload_bytes, payload_digest and, if asked for, payload (null for revisits)."""
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"] + ["payload"] * payloads
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * payloads
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * payloads

    def unpack(batches):
        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for record in frames(content.as_py()):
                    rows.append(parse_record(record))
                    held += len(record) if payloads else 100
                    if held >= 8_000_000:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return _binary.read_files(spark, path).select("content").mapInArrow(unpack, schema)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Records with payloads, where a revisit has that of the response it refers to."""
    kept = records.where("record_type = 'response'").select(F.col("page_id").alias("__lgw_id"), F.col("payload").alias("__lgw_payload")).dropDuplicates(["__lgw_id"])
    return records.join(kept, F.col("refers_to") == F.col("__lgw_id"), "left").withColumn("payload", F.coalesce("payload", "__lgw_payload")).drop("__lgw_id", "__lgw_payload")
