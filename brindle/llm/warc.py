"""WARC records in seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each holding whole WARC
records of about ``frame_bytes`` together, and a footer: the seek table of the
public seekable format, a skippable frame with every frame's sizes. An index
maps the record identifier to (bundle, frame, offset within the frame's
content, length). A record is so read by its frame alone; any Zstandard tool
can still unpack the bundle as one stream.

Of records with equal payloads of ``least`` bytes or more, the one with the
largest identifier is stored, as a response; the others are revisit records
that refer to it. Smaller payloads are stored each time.

Which payloads are shared is found from digests and identifiers alone, into a
table of the shared digests, which Spark broadcasts where its size allows;
payloads then go straight to their bundles.

A task writes bundles under names of its attempt's own and reports them in the
index; only an index that was written as a table counts, so files of lost
attempts are never read. Memory holds one frame at a time. The bundles are read
by as many tasks as there are bundles.

Headers are those that WARC 1.1 asks for, with the identical-payload-digest
profile for revisits. A record's identifier is made from the page's, so that a
revisit can name its response before that is written; repeated rows are one
record stored again, with the same identifier. ``X-Payload-Length`` is an
extension field. Frames and records are below 4 GiB, as the seek table and
Spark's strings (2 GiB) have it.

Defined cases: a null payload is empty; one of any length is a record of its
own frame; a null identifier counts as the least
one, so its record is a revisit where another has the payload, and a response
where none has; repeated rows of the largest identifier are all responses; a
null address has no header; an empty table gives no bundle and no rows; other
columns are not stored.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.store import materialize, new_path

SEEK_MAGIC, SKIPPABLE = 0x8F92EAB1, 0x184D2A5E
# Fixed value: the profile's name in the WARC 1.1 standard.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "record_id bigint, bundle string, frame int, at int, length int"


def record(record_id: int | None, url: str | None, kind: str, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record."""
    body = payload if kind == "response" else b""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:record:{'' if record_id is None else record_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:record:{refers_to}>", f"X-Payload-Length: {len(payload)}"]
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of one WARC record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


class Bundle:
    """Writes one bundle to an open stream."""

    def __init__(self, stream, frame_bytes: int, level: int = 3):
        import zstandard

        self.stream, self.frame_bytes, self.coder = stream, frame_bytes, zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int]] = []
        self.held: list[bytes] = []
        self.size = self.written = 0

    def add(self, data: bytes) -> tuple[int, int]:
        """(frame, offset) of the record."""
        place = (len(self.frames), self.size)
        self.held.append(data)
        self.size += len(data)
        if self.size >= self.frame_bytes:
            self.flush()
        return place

    def flush(self) -> None:
        if self.held:
            packed = self.coder.compress(b"".join(self.held))
            self.stream.write(packed)
            self.frames.append((len(packed), self.size))
            self.held, self.size, self.written = [], 0, self.written + len(packed)

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEK_MAGIC)
        self.stream.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.stream.close()


class BundleReader:
    """Reads frames of a bundle by its seek table; keeps the last frame."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        n, _, magic = struct.unpack("<IBI", source.read_at(9, size - 9))
        if magic != SEEK_MAGIC:
            raise ValueError("no seek table at the end")
        entries = source.read_at(8 * n, size - 9 - 8 * n)
        self.frames, at = [], 0
        for k in range(n):
            packed, plain = struct.unpack_from("<II", entries, 8 * k)
            self.frames.append((at, packed, plain))
            at += packed
        self.last = (-1, b"")

    def read(self, frame: int, at: int, length: int) -> bytes:
        import zstandard

        if self.last[0] != frame:
            start, packed, plain = self.frames[frame]
            self.last = (frame, zstandard.ZstdDecompressor().decompress(self.source.read_at(packed, start), max_output_size=plain))
        return self.last[1][at : at + length]


def classify(pages: DataFrame, id_column: str, url_column: str, payload_column: str, least: int) -> DataFrame:
    """(record_id, url, payload, digest, refers_to) of every page."""
    rows = pages.select(F.col(id_column).cast("bigint").alias("record_id"), F.col(url_column).alias("url"), F.coalesce(payload_column, F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    large = F.octet_length("payload") >= least
    # A table, so that the join is planned by its size and payloads are not
    # shuffled to meet a small one.
    shared = materialize(rows.where(large).groupBy("digest").agg(F.max("record_id").alias("largest"), F.count("*").alias("n")).where("n > 1").select("digest", "largest"), "shared")
    refers = F.when(large & (F.col("record_id").isNull() | (F.col("record_id") < F.col("largest"))), F.col("largest"))
    return rows.join(shared, "digest", "left").select("record_id", "url", "payload", "digest", refers.alias("refers_to"))


def write(pages: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", least: int = 1000, frame_bytes: int = 1 << 18, bundle_bytes: int = 1 << 26, date: str | None = None) -> DataFrame:
    """Write bundles into ``folder`` and return their index, itself written.
    ``date`` (UTC, 2024-01-31T12:00:00Z) is when the pages were got, now where
    it isn't given."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(folder)
        part, made, bundle, name, index = TaskContext.get().partitionId(), 0, None, "", []

        def told():
            out = [list(c) for c in zip(*index, strict=True)]
            index.clear()
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["record_id", "bundle", "frame", "at", "length"])

        for batch in batches:
            for key, url, payload, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bundle is None:
                    store.create_dir(base, recursive=True)
                    name = f"{part:06d}-{made:04d}-{uuid.uuid4().hex}.warc.zst"
                    bundle = Bundle(store.open_output_stream(f"{base}/{name}", compression=None), frame_bytes)
                    made += 1
                data = record(key, url, "response" if refers is None else "revisit", payload.encode(), digest, refers, date)
                index.append((key, name, *bundle.add(data), len(data)))
                if bundle.written >= bundle_bytes:
                    bundle.close()
                    bundle = None
                    yield told()
        if bundle is not None:
            bundle.close()
        if index:
            yield told()

    rows = classify(pages, id_column, url_column, payload_column, least)
    return materialize(rows.mapInArrow(of, INDEX), "warc-index", keep=True)


READ = "record_id bigint, url string, record_type string, payload binary, payload_bytes bigint, payload_digest string, refers_to bigint"


def read(index: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records that ``index`` names, parsed. A revisit's payload is null;
    its length and digest are those of the payload that it refers to. Each
    frame is unpacked once."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        name, reader = None, None
        number = lambda s: int(m[1]) if (m := re.fullmatch(r"<urn:record:(-?\d+)>", s)) else None
        for batch in batches:
            out = []
            for bundle, frame, at, length in zip(*(batch.column(c).to_pylist() for c in ("bundle", "frame", "at", "length")), strict=True):
                if bundle != name:
                    name, reader = bundle, BundleReader(store.open_input_file(f"{base}/{bundle}"))
                fields, body = parse(reader.read(frame, at, length))
                kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response":
                    found = hashlib.sha1(body).hexdigest()
                    if found != digest:
                        raise ValueError(f"record {fields['WARC-Record-ID']} of {bundle} is damaged")
                    size, refers = len(body), None
                else:
                    size, refers = int(fields["X-Payload-Length"]), number(fields["WARC-Refers-To"])
                out.append((number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), kind, body if with_payload and kind == "response" else None, size, digest, refers))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64())
            columns = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["record_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"])

    # By number, as the index's own size says nothing about the bundles'.
    n = max(1, index.select("bundle").distinct().count())
    dealt = index.repartition(n, "bundle").sortWithinPartitions("bundle", "frame", "at")
    return dealt.mapInArrow(of, READ)


def lookup(index: DataFrame, folder: str, wanted: DataFrame, id_column: str = "record_id") -> DataFrame:
    """The records whose identifiers ``wanted`` has, by random access."""
    return read(index.join(wanted.select(F.col(id_column).alias("record_id")).distinct(), "record_id", "left_semi"), folder)


def new_folder(spark) -> str:
    """A folder for bundles in the shared one, as a URI."""
    path = new_path(spark, "warc")
    return path if "://" in path or path.startswith("file:") else f"file://{path}"
