"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames, frames into bundles of bounded size; each bundle ends in a seek table (a
skippable frame with the sizes of all frames), and an index maps record ids to a bundle, a frame and the offset within the
frame's contents. Of records with equal payloads of at least `least` bytes, the one with the largest id is a response
and the others revisit it. Bundles are rows of a binary column, so any store that Spark writes can hold them;
`export` puts them out as .warc.zst files.

Defined results: a null html is an empty payload; a null url has no target header; rows that repeat the id of the kept response are
responses too; a null id revisits a kept equal payload and is a response else; a payload larger than a frame is a frame of its own; an
empty table gives no bundles; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import os
import re
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_unique, saved, slices, split, table

#: Payloads from so many bytes on are stored once.
LEAST = 1000
#: Bytes of records in a frame, and in a bundle.
FRAME, BUNDLE = 256 << 10, 8 << 20
# The seekable format's magic numbers and the names that WARC prescribes.
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD_ID = "urn:page:{}"
_DATE = "1970-01-01T00:00:00Z"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit keeps the HTTP header, whose length is that of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url is not None else None
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_RECORD_ID.format('' if page_id is None else page_id)}>", f"WARC-Date: {_DATE}",
        *([f"WARC-Target-URI: {target}"] if target is not None else []), f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        *([f"WARC-Refers-To: <{_RECORD_ID.format(refers_to)}>", f"WARC-Profile: {_PROFILE}"] if kind == "revisit" else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Bundle:
    """Collects records into frames; `close` gives the bundle's bytes and its index."""

    def __init__(self, level: int = 3):
        self.frames, self.sizes, self.index, self.open, self.level = [], [], [], bytearray(), level

    def add(self, record_id: int | None, data: bytes) -> None:
        if self.open and len(self.open) + len(data) > FRAME:
            self._frame()
        self.index.append((record_id, len(self.frames), len(self.open), len(data)))
        self.open += data

    def size(self) -> int:
        return sum(s for _, s in self.sizes) + len(self.open)

    def _frame(self) -> None:
        packed = zstandard.ZstdCompressor(level=self.level, write_checksum=True).compress(bytes(self.open))
        self.frames.append(packed)
        self.sizes.append((len(packed), len(self.open)))
        self.open = bytearray()

    def close(self) -> tuple[bytes, list[tuple[int | None, int, int, int]]]:
        if self.open:
            self._frame()
        entries = b"".join(struct.pack("<II", a, b) for a, b in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, _SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", _SKIPPABLE, len(entries) + len(footer)) + entries + footer, self.index


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(start, packed size, size) of each frame, from the footer."""
    n, flags, magic = struct.unpack("<IBI", data[-9:])
    if magic != _SEEKABLE or flags & 0x7C:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    out, start = [], 0
    for k in range(n):
        a, b = struct.unpack_from("<II", data, len(data) - 9 - width * (n - k))
        out.append((start, a, b))
        start += a
    return out


def frame(data: bytes, k: int) -> bytes:
    """The contents of one frame, read by itself."""
    start, packed, size = seek_table(data)[k]
    return zstandard.ZstdDecompressor().decompress(data[start : start + packed], max_output_size=size)


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(header, block, end) of the record at an offset."""
    stop = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:stop].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"not a record: {first[:40]}")
    header = dict(x.split(": ", 1) for x in lines)
    end = stop + 4 + int(header["Content-Length"])
    return header, data[stop + 4 : end], end + 4


def annotated(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload, digest, record_type and refers_to of every page."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumn("digest", F.sha1("payload"))
    # Digests alone are shuffled to find copies; of the pages, only those whose digest may be one of a copy.
    long = F.octet_length("payload") >= least
    kept = pages.where(long).groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1 AND kept IS NOT NULL")
    kept = saved(kept.select("digest", "kept"), "warc-kept")
    maybe, single = split(pages, kept, "digest")
    copies = join_unique(maybe.where(long), kept, "digest", "left")
    copies = copies.withColumn("kept", F.when(F.coalesce(F.col("page_id") < F.col("kept"), F.lit(True)), F.col("kept")))
    out = copies.unionByName(maybe.where(~long).unionByName(single), allowMissingColumns=True)
    return out.select("page_id", "url", "payload", "digest", F.when(F.col("kept").isNull(), "response").otherwise("revisit").alias("record_type"), F.col("kept").alias("refers_to"))


def write(pages: DataFrame, least: int = LEAST, level: int = 3) -> DataFrame:
    """Bundles: bundle_id, data, and the index as parallel arrays record_ids, frames, offsets and lengths."""

    def run(batches):
        bundle = Bundle(level)

        def closed() -> pa.RecordBatch:
            data, index = bundle.close()
            ids, frames, offsets, lengths = zip(*index)
            name = hashlib.sha1(data).hexdigest()
            columns = [pa.array([name]), pa.array([data], pa.binary()), pa.array([ids], pa.list_(pa.int64())), *(pa.array([x], pa.list_(pa.int64())) for x in (frames, offsets, lengths))]
            return pa.record_batch(columns, names=["bundle_id", "data", "record_ids", "frames", "offsets", "lengths"])

        for batch in batches:
            for low, high in slices(batch.column(2)):
                for row in batch.slice(low, high - low).to_pylist():
                    bundle.add(row["page_id"], record(row["page_id"], row["url"], row["payload"], row["digest"], row["record_type"], row["refers_to"]))
                    if bundle.size() >= BUNDLE:
                        yield closed()
                        bundle = Bundle(level)
        if bundle.index:
            yield closed()

    return annotated(pages, least).mapInArrow(run, "bundle_id string, data binary, record_ids array<long>, frames array<long>, offsets array<long>, lengths array<long>")


def index(bundles: DataFrame) -> DataFrame:
    """record_id, bundle_id, frame, offset and length of every record."""
    one = bundles.select("bundle_id", F.explode(F.arrays_zip("record_ids", "frames", "offsets", "lengths")).alias("r"))
    return one.select(F.col("r.record_ids").alias("record_id"), "bundle_id", F.col("r.frames").alias("frame"), F.col("r.offsets").alias("offset"), F.col("r.lengths").alias("length"))


def read(bundles: DataFrame) -> DataFrame:
    """page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type and refers_to, from the archives.

    Frames are read one by one through the seek table, records through the index; digests of payloads are checked.
    """

    def number(uri: str) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d*)>", uri)[1]
        return int(found) if found else None

    def rows(data: bytes, places: list[tuple[int, int, int]]):
        table, opened, contents = seek_table(data), -1, b""
        for k, offset, length in places:
            if k != opened:
                start, packed, size = table[k]
                opened, contents = k, zstandard.ZstdDecompressor().decompress(data[start : start + packed], max_output_size=size)
            header, block, end = parse(contents, offset)
            if end - offset != length:
                raise ValueError("the index disagrees with the archive")
            http, _, payload = block.partition(b"\r\n\r\n")
            digest = base64.b32decode(header["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
            revisit = header["WARC-Type"] == "revisit"
            if not revisit and hashlib.sha1(payload).hexdigest() != digest:
                raise ValueError("a payload was damaged")
            size = int(re.search(rb"Content-Length: (\d+)", http)[1])
            yield number(header["WARC-Record-ID"]), header.get("WARC-Target-URI"), None if revisit else payload, size, digest, header["WARC-Type"], number(header["WARC-Refers-To"]) if revisit else None

    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                places = list(zip(*(batch.column(c)[k].as_py() for c in (1, 2, 3))))
                held, size = [], 0
                for row in rows(batch.column(0)[k].as_py(), places):
                    held.append(row)
                    size += len(row[2] or b"")
                    if size > BUNDLE // 4:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
                        held, size = [], 0
                if held:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)

    return bundles.select("data", "frames", "offsets", "lengths").mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def export(bundles: DataFrame, folder: str) -> DataFrame:
    """Writes each bundle to <folder>/<bundle_id>.warc.zst, a folder that all executors mount; returns the file names (lazily)."""

    def run(batches):
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = os.path.join(folder, f".{name}.{os.getpid()}")
                with io.open(part, "wb") as f:
                    f.write(data)
                os.replace(part, os.path.join(folder, f"{name}.warc.zst"))
                yield pa.record_batch([pa.array([f"{name}.warc.zst"])], names=["file"])

    return bundles.select("bundle_id", "data").mapInArrow(run, "file string")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    bundles = saved(write(table(spark, sf_dir, "pages")), "warc-bundles")
    return read(bundles).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT payload_digest, max(page_id) AS kept FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
  CASE WHEN page_id < kept THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < kept THEN kept END AS refers_to
FROM p LEFT JOIN k USING (payload_digest)
"""
