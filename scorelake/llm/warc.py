"""WARC archives with a Zstandard dictionary in a leading skippable frame and one compressed frame per record.

Layout of an archive (the public .warc.zst layout): a skippable frame (magic 0x184D2A5D, little-endian length)
holds the dictionary; each WARC/1.1 record follows as a frame of its own, compressed with that dictionary. The
dictionary is trained from the archive's own records, on at most ``TRAIN_BYTES`` of them spread evenly.

Defined cases: a null html is an empty payload; a null url leaves out WARC-Target-URI; an empty table writes no
archive. Of rows with equal payloads the largest page_id is the response (nulls last; of repeated rows with that
page_id, the one that comes last in the table) and the others are revisits of it. Payloads are never cut; a
record's Content-Length is exact whatever its size. Extra columns are ignored.

Tasks write archives under names of their own, and the manifest table, committed by Spark, lists only those of
tasks that ended well: a repeated or speculative attempt leaves at most an unlisted file behind.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm import common

SKIPPABLE_MAGIC = 0x184D2A5D
ARCHIVE_BYTES = 64 << 20
TRAIN_BYTES = 1 << 20
TRAIN_PIECE = 8 << 10
DICTIONARY_BYTES = 32 << 10
LEVEL = 3
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PACKED = "page_id long, url string, sha1 string, packed binary"
MANIFEST = "archive string, records long, raw_bytes long, archive_bytes long"
READ = "page_id long, target_uri string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest each payload and compress it for the shuffle."""
    squeeze = zstandard.ZstdCompressor(level=1)
    for b in batches:
        payloads = [x or b"" for x in b.column("payload").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                b.column("page_id"),
                b.column("url"),
                pa.array([hashlib.sha1(x).hexdigest() for x in payloads], pa.string()),
                pa.array([squeeze.compress(x) for x in payloads], pa.binary()),
                b.column("at"),
            ],
            names=["page_id", "url", "sha1", "packed", "at"],
        )


def resolved(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """One row per page with its packed payload, and the page that it revisits (``is_revisit``, ``refers_to``).

    The groups of equal payloads are pre-aggregated by digest; the join can split a hot digest, as nothing above
    it needs a digest's rows together.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"),
        F.monotonically_increasing_id().alias("at"),
    )
    groups = (
        rows.where(F.octet_length("payload") >= least_bytes)
        .groupBy(F.sha1("payload").alias("sha1"))
        .agg(F.max(F.struct("page_id", "at")).alias("last"), F.count("*").alias("copies"))
        .where("copies > 1")
    )
    groups = common.written(groups.select("sha1", F.col("last.page_id").alias("to_page"), F.col("last.at").alias("to_at")), "copies")
    packed = rows.mapInArrow(_pack, PACKED + ", at long")
    other = F.col("to_at").isNotNull() & (F.col("at") != F.col("to_at"))
    return packed.join(groups, "sha1", "left").select(
        "page_id", "url", "sha1", "packed", "at", other.alias("is_revisit"), F.when(other, F.col("to_page")).alias("refers_to"), F.when(other, F.col("to_at")).alias("refers_at")
    )


def _name(page_id, at) -> str:
    """A record's id: the page's and the row's number, as rows may repeat a page."""
    return f"<urn:page:{'' if page_id is None else page_id}:{at}>"


def _record(page_id, url, digest: str, payload: bytes, revisit: bool, refers_to, at: int = 0, refers_at: int = 0, date: str = "2000-01-01T00:00:00Z") -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_name(page_id, at)}",
        f"WARC-Date: {date}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_name(refers_to, refers_at)}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from pieces spread evenly over the records; None where there is too little to learn from."""
    step = max(1, sum(min(len(r), TRAIN_PIECE) for r in records) // TRAIN_BYTES)
    samples = [r[:TRAIN_PIECE] for r in records[::step]]
    if len(samples) < 8:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:
        return None


def encode_archive(records: list[bytes]) -> bytes:
    """Leading skippable frame with the dictionary (empty if none could be trained), then a frame per record."""
    d = train(records)
    raw = d.as_bytes() if d else b""
    squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=d) if d else zstandard.ZstdCompressor(level=LEVEL)
    return b"".join([struct.pack("<II", SKIPPABLE_MAGIC, len(raw)), raw, *map(squeeze.compress, records)])


def decode_archive(blob: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive, in order."""
    magic, size = struct.unpack("<II", blob[:8])
    if magic != SKIPPABLE_MAGIC:
        raise ValueError("no leading dictionary frame")
    raw = blob[8 : 8 + size]
    plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)) if raw else zstandard.ZstdDecompressor()
    with plain.stream_reader(memoryview(blob)[8 + size :], read_across_frames=True, read_size=1 << 20) as stream:
        data, at = bytearray(), 0

        def more() -> bool:
            nonlocal data, at
            part = stream.read(1 << 20)
            data, at = data[at:] + part, 0
            return bool(part)

        while True:
            while (end := data.find(b"\r\n\r\n", at)) < 0:
                if not more():
                    if len(data) > at:
                        raise ValueError("a record is cut off")
                    return
            head = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:])
            length = int(head["Content-Length"])
            start = end + 4 - at
            while len(data) - at < start + length + 4:
                if not more():
                    raise ValueError("a record is cut off")
            yield head, bytes(data[at + start : at + start + length])
            at += start + length + 4


def _store(folder: str):
    """pyarrow's file system of a folder as Spark names it, and the folder's name there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", folder))


def write_archives(rows: DataFrame, folder: str, date: str | None = None) -> DataFrame:
    """Write ``resolved`` rows to archives below ``folder`` (any store pyarrow knows); the manifest, as written by Spark.
    ``date``: that of all records, by default the time of this call."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        plain, held, size = zstandard.ZstdDecompressor(), [], 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size
            blob, name = encode_archive(held), f"{base}/{uuid.uuid4().hex}.warc.zst"
            store.create_dir(base, recursive=True)
            with store.open_output_stream(name) as out:
                out.write(blob)
            row = {"archive": [name], "records": [len(held)], "raw_bytes": [size], "archive_bytes": [len(blob)]}
            held, size = [], 0
            return pa.RecordBatch.from_pydict(row)

        for b in batches:
            for r in b.to_pylist():
                payload = plain.decompress(r["packed"])
                digest = base64.b32encode(bytes.fromhex(r["sha1"])).decode()
                held.append(_record(r["page_id"], r["url"], digest, payload, r["is_revisit"], r["refers_to"], r["at"], r["refers_at"], date))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
        if held:
            yield flush()

    return common.written(rows.select("page_id", "url", "sha1", "packed", "at", "is_revisit", "refers_to", "refers_at").mapInArrow(write, MANIFEST), "manifest")


def _number(urn: str | None) -> int | None:
    value = urn[len("<urn:page:") : -1].partition(":")[0] if urn else ""
    return int(value) if value else None


def read_archives(spark: SparkSession, manifest: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of all archives in the manifest. Digests of responses are computed anew from their payloads."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(folder)
        for b in batches:
            for name in b.column("archive").to_pylist():
                with store.open_input_stream(name) as f:
                    blob = f.read()
                rows, size = [], 0
                for head, block in decode_archive(blob):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    revisit = head["WARC-Type"] == "revisit"
                    n = int(http.rpartition(b"Content-Length: ")[2].split(b"\r\n")[0])
                    digest = head["WARC-Payload-Digest"].partition(":")[2]
                    if not revisit and (len(payload) != n or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"{head['WARC-Record-ID']} in {name} does not match its digest")
                    rows.append((_number(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), n, digest, head["WARC-Type"], _number(head.get("WARC-Refers-To")), payload if with_payload and not revisit else None))
                    size += len(payload) * with_payload
                    if len(rows) >= 2000 or size > 16 << 20:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = ["page_id", "target_uri", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names=names)

    # a task per archive or so: the manifest's rows are tiny, the files behind them are not
    spread = manifest.select("archive").repartition(common.partitions(spark))
    return spread.mapInArrow(read, READ)


def query(spark: SparkSession, pages: DataFrame) -> DataFrame:
    folder = common.folder(spark, "warc")
    manifest = write_archives(resolved(pages), folder)
    return read_archives(spark, manifest, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri")


ORACLE = """
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, url, octet_length(b) AS payload_bytes, sha1(b) AS hx FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY hx) AS last_id FROM h),
bits AS (SELECT *, list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST(('0x' || substr(hx, 1 + 5 * (i // 4), 5))::BIGINT // [32768, 1024, 32, 1][1 + i % 4] % 32 AS INTEGER), 1)) AS letters FROM m)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, array_to_string(letters, '') AS payload_digest,
       CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last_id THEN NULL ELSE last_id END AS refers_to, url AS target_uri
FROM bits
"""
