"""WARC archives of one Zstandard frame per record, written and read by Spark tasks.

An archive opens with a skippable frame that holds the dictionary its records
are compressed with; each record is a frame of its own. The reader takes
archives as a stream: it loads the dictionary, decodes frame after frame, and
checks the version line, the mandatory headers, the lengths and the digests.
Folders are URIs of any file system that Arrow knows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage

# Fixed values of the formats.
DICTIONARY_FRAME, ZSTD_FRAME, DICTIONARY_MAGIC = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
VERSION = b"WARC/1.1"
CRLF = b"\r\n"
MANDATORY = ("warc-record-id", "warc-date", "warc-type", "content-length")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Records a dictionary is trained on at most, and their bytes; sizes of dictionary and archive.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 4 << 20, 32 << 10
ARCHIVE_BYTES, CHUNK = 64 << 20, 1 << 20
#: A record may not unpack to more than this.
MAX_RECORD = 1 << 31

RECORD_SCHEMA = (
    "record_id string, type string, uri string, date string, page_id long, refers_to string, payload_digest string, "
    "payload_bytes long, stored_bytes long, archive string"
)


class ArchiveError(ValueError):
    """An archive that breaks the format."""


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def build_record(page_id: int | None, uri: str | None, date: str, digest: str, size: int, payload: bytes | None, refers_to: str | None) -> bytes:
    """A response with its payload, or, given ``refers_to``, a revisit with the HTTP head only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (payload or b"")
    fields = [("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date)]
    if uri:  # line breaks and other control characters are escaped
        fields.append(("WARC-Target-URI", "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode()) for c in uri)))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if refers_to:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", refers_to)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    return VERSION + CRLF + head + CRLF + block + CRLF + CRLF


def parse_headers(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise ArchiveError(f"not a header: {line[:80]!r}")
        out.setdefault(name.strip().lower().decode("latin-1"), value.strip().decode("utf-8"))
    return out


def parse_record(raw: bytes) -> dict:
    """The fields of one unpacked record; raises ArchiveError if it is not well formed."""
    head, gap, rest = raw.partition(CRLF + CRLF)
    lines = head.split(CRLF)
    if not gap or lines[0] != VERSION:
        raise ArchiveError(f"no {VERSION.decode()} header")
    h = parse_headers(lines[1:])
    if lost := [m for m in MANDATORY if m not in h]:
        raise ArchiveError(f"missing {', '.join(lost)}")
    if not h["content-length"].isdigit() or len(rest) != int(h["content-length"]) + 4 or rest[-4:] != CRLF + CRLF:
        raise ArchiveError(f"{h['warc-record-id']}: block and Content-Length differ")
    block = rest[:-4]
    http, gap, payload = block.partition(CRLF + CRLF)
    if not gap:
        raise ArchiveError(f"{h['warc-record-id']}: no HTTP head")
    declared = parse_headers(http.split(CRLF)[1:]).get("content-length", "")
    digest = h.get("warc-payload-digest", "").removeprefix("sha1:")
    if h["warc-type"] == "response":
        if not declared.isdigit() or int(declared) != len(payload) or base32_sha1(payload) != digest:
            raise ArchiveError(f"{h['warc-record-id']}: payload, length and digest differ")
    elif h["warc-type"] == "revisit":
        if payload or not declared.isdigit() or not h.get("warc-refers-to") or h.get("warc-profile") != PROFILE:
            raise ArchiveError(f"{h['warc-record-id']}: not a revisit of an identical payload")
    else:
        raise ArchiveError(f"{h['warc-record-id']}: type {h['warc-type']}")
    page = h["warc-record-id"].split(":")[2]
    return {
        "record_id": h["warc-record-id"], "type": h["warc-type"], "uri": h.get("warc-target-uri"), "date": h["warc-date"],
        "page_id": int(page) if page else None, "refers_to": h.get("warc-refers-to"), "payload_digest": digest,
        "payload_bytes": int(declared), "stored_bytes": len(payload),
    }


def frames(stream) -> Iterator[bytes]:
    """The unpacked frames of an archive, one at a time."""
    head = stream.read(8)
    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != DICTIONARY_FRAME:
        raise ArchiveError("no dictionary frame")
    size = struct.unpack("<I", head[4:])[0]
    raw = stream.read(size)
    if len(raw) != size:
        raise ArchiveError("cut dictionary frame")
    if raw[:4] == struct.pack("<I", ZSTD_FRAME):
        raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 27)
    if raw and raw[:4] != struct.pack("<I", DICTIONARY_MAGIC):
        raise ArchiveError("not a dictionary")
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
    data = stream.read(CHUNK)
    while data:
        frame, parts, total = unpack.decompressobj(), [], 0
        while True:
            parts.append(frame.decompress(data))
            total += len(parts[-1])
            if total > MAX_RECORD:
                raise ArchiveError("record too long")
            if frame.eof:
                data = frame.unused_data or stream.read(CHUNK)
                break
            if not (data := stream.read(CHUNK)):
                raise ArchiveError("cut record")
        yield b"".join(parts)


def read_archive(stream) -> Iterator[dict]:
    return map(parse_record, frames(stream))


def train_dictionary(samples: list[bytes]) -> bytes:
    """Empty if the samples are too few to learn from."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def _write(records: Iterator[bytes], fs: pafs.FileSystem, folder: str, name: str) -> Iterator[tuple[str, int, int]]:
    """Archives of about ARCHIVE_BYTES; each appears under its name only when it is whole."""
    number, done = 0, False
    while not done:
        samples, size = [], 0
        while len(samples) < SAMPLE_RECORDS and size < SAMPLE_BYTES:
            if (r := next(records, None)) is None:
                done = True
                break
            samples.append(r)
            size += len(r)
        if not samples:
            return
        dictionary = train_dictionary(samples)
        packed = zstandard.ZstdCompressor().compress(dictionary)
        pack = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        target = f"{folder}/{name}-{number:04d}.warc.zst"
        n, part = 0, f"{target}.{uuid.uuid4().hex[:8]}.part"
        with fs.open_output_stream(part, compression=None) as out:
            out.write(struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed)
            at = 8 + len(packed)
            while samples or at < ARCHIVE_BYTES:
                if samples:
                    r = samples.pop(0)
                elif done or (r := next(records, None)) is None:
                    done = True
                    break
                frame = pack.compress(r)
                out.write(frame)
                at += len(frame)
                n += 1
        fs.move(part, target)
        yield target, n, at
        number += 1


def write_archives(pages: DataFrame, folder: str, *, key: str = "page_id", url: str = "url", payload: str = "html",
                   min_revisit_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write one record per row into archives under ``folder`` (a URI);
    returns (archive, records, bytes) of each, from a staged table.

    Of the rows with equal payloads of ``min_revisit_bytes`` or more, those
    with the largest key (nulls smallest) are responses, the others revisit
    them. The choice is made on digests; payloads cross one shuffle. Null
    payload: empty. Repeated rows with the largest key are all responses.
    """
    digest = F.sha1(F.coalesce(F.col(payload), F.lit("")).cast("binary"))
    size = F.octet_length(F.coalesce(F.col(payload), F.lit("")))
    p = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("uri"), F.coalesce(F.col(payload), F.lit("")).alias("payload"),
                     digest.alias("sha1"), size.alias("size"))
    order = F.coalesce(F.col("page_id"), F.lit(-(2**63)).cast("long"))
    first = p.where(F.col("size") >= min_revisit_bytes).groupBy("sha1").agg(F.max(order).alias("top"), F.count(F.lit(1)).alias("n"))
    first = first.where("n > 1").select(F.col("sha1").alias("s"), "top")  # only payloads that come again
    joined = p.join(first, F.col("sha1") == F.col("s"), "left")
    revisit = F.col("top").isNotNull() & (order != F.col("top"))
    rows = joined.select(
        "page_id", "uri", F.when(~revisit, F.col("payload")).alias("payload"), "size",
        F.col("sha1"), revisit.alias("revisit"), F.when(F.col("top") != -(2**63), F.col("top")).alias("top"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, path = pafs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)

        def records() -> Iterator[bytes]:
            for b in batches:
                for page, uri, text, n, sha1, again, top in zip(*(c.to_pylist() for c in b.columns)):
                    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                    body, refers = (None, record_id(top, digest)) if again else (text.encode(), None)
                    yield build_record(page, uri, date, digest, n, body, refers)

        written = list(_write(records(), fs, path, f"part-{TaskContext.get().partitionId():05d}"))
        if written:
            names, ns, sizes = zip(*written)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(ns, pa.int64()), pa.array(sizes, pa.int64())], ["archive", "records", "bytes"])

    return stage(rows.mapInArrow(run, "archive string, records long, bytes long"), "archives")


def read_archives(spark: SparkSession, folder: str, archives: DataFrame) -> DataFrame:
    """The records of ``archives`` (column ``archive``: paths on the file
    system of ``folder``), checked; a broken archive fails the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for path in b.column(0).to_pylist():
                rows: list[dict] = []
                with fs.open_input_stream(path, compression=None) as stream:
                    for r in read_archive(stream):
                        rows.append(r | {"archive": path})
                        if len(rows) >= 5_000:
                            yield pa.RecordBatch.from_pylist(rows, _ARROW)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)

    n = max(1, min(archives.count(), 4 * spark.sparkContext.defaultParallelism))
    return archives.select("archive").repartition(n).mapInArrow(run, RECORD_SCHEMA)


_ARROW = pa.schema([(c.split()[0], pa.int64() if c.split()[1] == "long" else pa.string()) for c in RECORD_SCHEMA.split(", ")])
