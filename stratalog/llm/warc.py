"""A deterministic sharded WARC writer, and the reader that checks what it wrote.

Records are range-sorted by page; each task writes its range as gzip members into files
that roll at a compressed size, under temporary names that become final by a rename. The
manifest, one row per finished file, is committed last; a file that it lacks is not part
of the archive, so a task that ran twice or died leaves nothing behind that is read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.common import fresh_dir, map_batches

#: Compressed bytes at which a file is closed, payload bytes of a task's range, tasks at most,
#: and the date that records carry.
ROLL_BYTES, RANGE_BYTES, MOST_RANGES, WARC_DATE = 16_000_000, 16_000_000, 20_000, "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("00000000-0000-0000-0000-000000000000")
_MANIFEST = "file string, n_records long, n_bytes long, sha256 string, first_page_id long, last_page_id long"
_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{digest}')}>"


def _uri(url: str | None) -> str:
    """url with what would break a header line percent-encoded; nothing for null."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url or "")


def record(page_id: int | None, url: str | None, payload: bytes | None, digest_hex: str, size: int, refers_to: int | None) -> bytes:
    """One gzip member: a response with payload, or where refers_to is given a revisit."""
    digest = base64.b32encode(bytes.fromhex(digest_hex)).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if payload is None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if payload is None else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id, digest)}",
        f"WARC-Date: {WARC_DATE}",
        f"WARC-Target-URI: {_uri(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{_sha1(block)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    if payload is None:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_record_id(refers_to, digest)}",
            f"Refers-To-Page-ID: {refers_to}",
        ]
    head = "\r\n".join(lines).encode("utf-8", "replace")
    return gzip.compress(head + b"\r\n\r\n" + block + b"\r\n\r\n", compresslevel=6, mtime=0)


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class _Roller:
    """The open file of one task; close() gives it its final name and its manifest row."""

    def __init__(self, folder: str, part: int):
        self.fs, self.folder = _file_system(folder)
        self.part, self.n, self.out = part, 0, None

    def add(self, page_id: int | None, member: bytes):
        if self.out is None:
            self.name = f"part-{self.part:06d}-{self.n:05d}.warc.gz"
            self.temp = f"{self.folder}/.{self.name}.{uuid.uuid4().hex}.tmp"
            self.out, self.sha, self.size, self.ids, self.records = self.fs.open_output_stream(self.temp), hashlib.sha256(), 0, [], 0
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)
        self.records += 1
        self.ids = [self.ids[0] if self.ids else page_id, page_id]

    def close(self):
        if self.out is None:
            return None
        self.out.close()
        self.fs.move(self.temp, f"{self.folder}/{self.name}")
        row = (self.name, self.records, self.size, self.sha.hexdigest(), *self.ids)
        self.out, self.n = None, self.n + 1
        return row


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields]
    )


def plan_records(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """The pages, and before each that becomes a revisit a marker row: its page_id and digest,
    with refers_to.

    Digests meet in a maximum that is combined before the shuffle, and markers are small
    rows, so the payloads are shuffled once, by the range sort that brings both together.
    """
    html = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    keyed = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("payload")
    ).withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    last = keyed.groupBy("digest").agg(F.max("page_id").alias("last_id"))
    markers = (
        keyed.where(F.col("size") >= min_revisit_bytes)
        .select("page_id", "digest", "size")
        .join(last, "digest")
        .where("page_id < last_id")
        .select(
            "page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"),
            "digest", "size", F.col("last_id").alias("refers_to"),
        )
        .distinct()
    )
    return markers.unionByName(keyed.withColumn("refers_to", F.lit(None).cast("long")))


def write_archive(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, min_revisit_bytes: int = 0) -> DataFrame:
    """Write pages(page_id, url, html) below folder; the committed manifest.

    Null html is an empty payload and null urls an empty URI. Of records with equal payloads
    of min_revisit_bytes or more, that with the largest page_id is the response; should rows
    repeat that id, each is one. Rows without page_id are always responses. An empty table gives an archive
    without files. Other columns are not read. folder: a URI that every executor can write.
    Records have the same order and bytes in every run; where a range, and so a file, ends
    follows Spark's sample of the page ids.
    """
    spark = pages.sparkSession
    fs, path = _file_system(folder)
    fs.create_dir(path, recursive=True)
    size = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    n = min(MOST_RANGES, size // RANGE_BYTES + 1)
    ranged = plan_records(pages, min_revisit_bytes).repartitionByRange(n, "page_id")
    ranged = ranged.sortWithinPartitions("page_id", F.col("refers_to").isNull(), "url", "digest")

    def write(batches):
        from pyspark import TaskContext

        roller, done, marked, at = _Roller(folder, TaskContext.get().partitionId()), [], {}, None
        for batch in batches:
            for page_id, url, payload, digest, size, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if page_id != at:
                    marked, at = {}, page_id
                if refers_to is not None:
                    marked[digest] = refers_to
                    continue
                again = marked.get(digest)
                roller.add(page_id, record(page_id, url, payload if again is None else None, digest, size, again))
                if roller.size >= roll_bytes:
                    done.append(roller.close())
        done.append(roller.close())
        yield _batch([r for r in done if r], _MANIFEST)

    map_batches(ranged, write, _MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


class BadRecord(ValueError):
    """A record whose lengths or digests do not fit what it holds."""


def _members(stream):
    """The gzip members of a stream, each decompressed whole."""
    left = b""
    while True:
        left = left or stream.read(1 << 20)
        if not left:
            return
        member, parts = zlib.decompressobj(wbits=31), []
        while not member.eof:
            if not left and not (left := stream.read(1 << 20)):
                raise BadRecord("cut short")
            parts.append(member.decompress(left))
            left = member.unused_data
        yield b"".join(parts)


def parse_record(raw: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to); digests are checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or f"sha1:{_sha1(block)}" != fields["WARC-Block-Digest"]:
        raise BadRecord(fields["WARC-Record-ID"])
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or _sha1(payload) != digest):
        raise BadRecord(fields["WARC-Record-ID"])
    number = lambda k: int(fields[k]) if k in fields else None
    return number("Page-ID"), size, digest, kind, number("Refers-To-Page-ID")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the files in the archive's manifest; files are read in streams, by
    as many tasks as there are files."""
    manifest = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")
    n = min(MOST_RANGES, max(1, manifest.count()))

    def read(batches):
        fs, path = _file_system(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for raw in _members(stream):
                        rows.append(parse_record(raw))
                        if len(rows) == 5000:
                            yield _batch(rows, _READ)
                            rows = []
                yield _batch(rows, _READ)

    return map_batches(manifest.select("file").repartitionByRange(n, "file"), read, _READ)


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write pages as an archive in a new folder of the shared one and read it back."""
    folder = folder or fresh_dir(pages.sparkSession, "warc")
    write_archive(pages, folder)
    return read_archive(pages.sparkSession, folder)
