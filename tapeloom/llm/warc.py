"""WARC archives written from pages and read back as a table of payload chunks.

Writing: pages with equal payloads (length and SHA-1) share one `response`, that
of the largest page_id; the others become `revisit` records that name it. Each
record is a gzip member, and an archive is closed once it holds `archive_bytes`
of payload.

Reading: an archive is streamed. A payload comes out as rows of (record, chunk
number, bytes) of at most `chunk_bytes`, each with the digest of the payload up
to and with that chunk, so neither reader nor table ever holds a whole payload,
and the last chunk's digest is the payload's.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm import shared
from tapeloom.llm.text import slices, small_batches
from tapeloom.session import scratch_path, stage

# Fixed values of the format.
VERSION, PROFILE = b"WARC/1.1\r\n", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
MANIFEST = "path string, records long, payload_bytes long"
CHUNKS = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, declared_digest string, "
    "chunk int, is_last boolean, data binary, bytes_so_far long, digest_so_far string"
)


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def with_originals(pages: DataFrame, least: int) -> DataFrame:
    """page_id, url, html as bytes, and `original`: the page_id of the response this page revisits, or null.

    Payloads are grouped by length and digest, in counts per task before the
    shuffle, and only the groups with more than one page are joined back, by
    page; the payload itself moves once. Repeated page_ids and null ones are
    responses of their own unless a payload of theirs is held by a larger id.
    """
    raw = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), raw.alias("payload"))
    keys = rows.select("page_id", F.octet_length("payload").alias("size"), F.sha1("payload").alias("sha")).where(F.col("size") >= least)
    # Written first: a join with an aggregate of its own key could not split a payload that very many pages share.
    groups = stage(keys.groupBy("size", "sha").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n")).where("n > 1"), "payloads")
    found = keys.join(groups, ["size", "sha"]).where("page_id <> original").groupBy("page_id", "size", "sha").agg(F.max("original").alias("original"))
    tagged = rows.withColumn("size", F.octet_length("payload")).withColumn("sha", F.sha1("payload"))
    return tagged.join(found, ["page_id", "size", "sha"], "left").select("page_id", "url", "payload", "original")


def write(pages: DataFrame, *, least: int = 0, archive_bytes: int = 64 << 20, piece: int = 1 << 20) -> DataFrame:
    """Writes the archives to the shared folder; returns the written table of their paths."""
    folder = scratch_path(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, pending = TaskContext.get().partitionId(), _rows(batches)
        number, row = 0, next(pending, None)
        while row is not None:
            path, records, held = shared.new_file(folder, f"part-{part:06d}-{number:06d}", ".warc.gz"), 0, 0
            with shared.writer(path) as out:
                while row is not None and held < archive_bytes:
                    write_record(out, *row, piece)
                    records, held, row = records + 1, held + len(row[2]), next(pending, None)
            number += 1
            yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([records], pa.int64()), "payload_bytes": pa.array([held], pa.int64())})

    return stage(small_batches(with_originals(pages, least)).mapInArrow(run, MANIFEST), "archives")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in slices(batches, "payload"):
        payloads = batch.column("payload")
        rest = (batch.column(c).to_pylist() for c in ("page_id", "url", "original"))
        for k, (page_id, url, original) in enumerate(zip(*rest, strict=True)):
            yield page_id, url, memoryview(payloads[k].as_buffer()), original


def write_record(out: BinaryIO, page_id: int | None, url: str | None, payload: memoryview, original: int | None, piece: int) -> None:
    """One gzip member; the payload is hashed and written in pieces. A revisit has no block of its own."""
    digest = hashlib.sha1()
    for at in range(0, len(payload), piece):
        digest.update(payload[at : at + piece])
    head = {
        "WARC-Type": "response" if original is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Payload-Digest": f"sha1:{base32_sha1(digest.digest())}",
        "WARC-Payload-Length": str(len(payload)),
        "Content-Type": "text/html",
        "Content-Length": str(len(payload) if original is None else 0),
    }
    if url is None:
        del head["WARC-Target-URI"]
    if original is not None:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:page:{original}>"}
    with gzip.GzipFile(fileobj=out, mode="wb", compresslevel=1, mtime=0) as member:
        member.write(VERSION + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n")
        for at in range(0, len(payload) if original is None else 0, piece):
            member.write(payload[at : at + piece])
        member.write(b"\r\n\r\n")


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def records(stream: BinaryIO, chunk_bytes: int) -> Iterator[tuple]:
    """Rows of `CHUNKS` from one archive. A payload without bytes is one empty chunk."""
    with gzip.GzipFile(fileobj=stream, mode="rb") as archive:
        while version := archive.readline():
            if version != VERSION:
                raise ValueError(f"no record at this place: {version[:40]!r}")
            head = {}
            while (line := archive.readline()) not in (b"\r\n", b""):
                name, _, value = line.decode().rstrip("\r\n").partition(": ")
                head[name] = value
            length, digest, done, chunk = int(head["Content-Length"]), hashlib.sha1(), 0, 0
            known = (
                _page(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), head["WARC-Type"], _page(head.get("WARC-Refers-To")),
                int(head["WARC-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:"),
            )
            while done < length or chunk == 0:
                data = archive.read(min(chunk_bytes, length - done))
                if len(data) < min(chunk_bytes, length - done):
                    raise EOFError("the archive ends inside a payload")
                digest.update(data)
                done += len(data)
                yield (*known, chunk, done == length, data, done, base32_sha1(digest.copy().digest()))
                chunk += 1
            if archive.read(4) != b"\r\n\r\n":
                raise ValueError("a record does not end where its length says")


def read(archives: DataFrame, chunk_bytes: int = 256 << 10, with_data: bool = True) -> DataFrame:
    """The chunk table of all archives; `with_data=False` leaves the bytes out of the rows."""
    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.binary(), pa.int64(), pa.string()]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, held = [], 0
                with shared.reader(path) as stream:
                    for row in records(stream, chunk_bytes):
                        held += len(row[8]) * with_data
                        rows.append(row if with_data else (*row[:8], None, *row[9:]))
                        if held >= 8 << 20 or len(rows) >= 5000:
                            yield table(rows)
                            rows, held = [], 0
                if rows:
                    yield table(rows)

    return archives.select("path").repartition(n, "path").mapInArrow(run, CHUNKS)


def digests(chunks: DataFrame) -> DataFrame:
    """One row per record, from its last chunk; a response must have the length and digest its head declares."""
    own = (F.col("bytes_so_far") == F.col("payload_bytes")) & (F.col("digest_so_far") == F.col("declared_digest"))
    checked = F.when((F.col("record_type") == "revisit") | own, F.col("declared_digest")).otherwise(
        F.raise_error(F.concat(F.lit("payload differs from its head: page "), F.col("page_id").cast("string"))))
    return chunks.where("is_last").select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to")
