"""WARC archives: a writer with revisit records and a splittable reader.

Every record is a gzip member of its own. The reader cuts files into byte ranges; a task scans its range for gzip
magic, takes a place for a record only if what it inflates there starts with a whole WARC header block, and owns the
records that start inside its range (the last may end beyond it). After a record it goes on at the byte where that
member ended, so magic bytes inside compressed data are seldom looked at, and never taken for a record.
"""

from __future__ import annotations

import base64
import hashlib
import os
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads of fewer bytes are always stored.
MIN_REVISIT_BYTES = 1000
SPLIT_BYTES = 16 << 20
CHUNK = 1 << 18
#: A header block of more bytes isn't one.
MAX_HEADER = 1 << 16
#: Tasks that a read is dealt out to at most; with more ranges, a task reads several.
MAX_TASKS = 100_000
LEVEL = 6

RECORDS = "record_id string, record_type string, target_uri string, payload_bytes long, payload_digest string, refers_to string, payload binary, path string, offset long"


def file_system(uri: str):
    """A pyarrow file system and a path in it; plain and file: paths are local."""
    from pyarrow import fs

    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path)
    return fs.FileSystem.from_uri(uri)


def _header(fields: list[tuple[str, str]]) -> bytes:
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"


def _urn(page_id: int) -> str:
    return f"<urn:page:{page_id}>"


def record(page_id: int, url: str | None, payload: bytes, digest: bytes, first: int | None) -> bytes:
    """One gzip member. first: the page whose record holds the payload, if that is another."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    fields = [("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest).decode())]
    if url is not None:
        # A line break would end the header.
        fields.append(("WARC-Target-URI", " ".join(url.split())))
    if first is not None:
        fields += [("WARC-Refers-To", _urn(first)), ("WARC-Profile", REVISIT_PROFILE)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(_header(fields) + block + b"\r\n\r\n") + packer.flush()


def parse_header(data: bytes) -> tuple[dict[str, str], int] | None:
    """Fields and length of a whole WARC header block at the start of data."""
    end = data.find(b"\r\n\r\n")
    if end < 0 or not data.startswith(b"WARC/"):
        return None
    fields = {}
    for line in data[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    if "warc-type" not in fields or not fields.get("content-length", "").isdigit():
        return None
    return fields, end + 4


class _Source:
    """Bytes of a file from a place on, read in chunks, with what has been read ahead kept."""

    def __init__(self, f, at: int, size: int):
        self.f, self.at, self.size, self.data = f, at, size, b""

    def more(self) -> bool:
        want = min(CHUNK, self.size - self.at - len(self.data))
        if want <= 0:
            return False
        self.f.seek(self.at + len(self.data))
        got = self.f.read(want)
        self.data += got
        return bool(got)

    def skip(self, n: int) -> None:
        self.data, self.at = self.data[n:], self.at + n


def _member(source: _Source) -> tuple[bytes, int] | None:
    """Inflates the member at the source's place; None if no WARC record starts there, or it is cut off."""
    if len(source.data) < 512:
        source.more()
    unpacker = zlib.decompressobj(31)
    out, used, checked = [], 0, False
    have = 0
    while not unpacker.eof:
        if used == len(source.data) and not source.more():
            return None
        piece = source.data[used : used + CHUNK]
        try:
            got = unpacker.decompress(piece)
        except zlib.error:
            return None
        used += len(piece)
        out.append(got)
        have += len(got)
        if not checked and (have >= MAX_HEADER or unpacker.eof or b"\r\n\r\n" in got):
            head = b"".join(out)
            if parse_header(head) is None:
                if have >= MAX_HEADER or unpacker.eof or b"\r\n\r\n" in head:
                    return None
            else:
                checked = True
        elif not checked and not b"".join(out)[:5] == VERSION[: min(5, have)]:
            return None
    return b"".join(out), used - len(unpacker.unused_data)


def scan(f, size: int, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Place and content of the records that start in [start, end)."""
    source = _Source(f, start, size)
    while source.at < end:
        found = source.data.find(MAGIC)
        if found < 0:
            # The last two bytes can be the start of magic.
            keep = min(2, len(source.data))
            if source.at + len(source.data) - keep >= end:
                return
            source.skip(len(source.data) - keep)
            if not source.more():
                return
            continue
        source.skip(found)
        if source.at >= end:
            return
        got = _member(source)
        if got is None:
            source.skip(1)
        else:
            yield source.at, got[0]
            source.skip(got[1])


def parse_record(data: bytes) -> dict | None:
    head = parse_header(data)
    if head is None:
        return None
    fields, at = head
    block = data[at : at + int(fields["content-length"])]
    length, payload = None, block
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        for line in http.split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length" and value.strip().isdigit():
                length = int(value)
    algorithm, _, code = fields.get("warc-payload-digest", "").partition(":")
    digest = base64.b32decode(code).hex() if algorithm == "sha1" and len(code) == 32 else code.lower() or None
    kind = fields["warc-type"]
    if kind != "revisit" and digest is not None and hashlib.sha1(payload).hexdigest() != digest:
        return None
    return {"record_id": fields.get("warc-record-id"), "record_type": kind, "target_uri": fields.get("warc-target-uri"), "payload_bytes": length if length is not None else len(payload), "payload_digest": digest, "refers_to": fields.get("warc-refers-to"), "payload": None if kind == "revisit" else payload}


def write_warc(pages: DataFrame, folder: str, id_col="page_id", url_col="url", html_col="html", min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write a record per row into files under folder, one for each partition; returns (path, bytes, records).

    Null html is an empty payload, null url leaves the target out. Of equal payloads of min_revisit_bytes or more, the
    largest id is a response and the others revisit it (rows that share that id are all responses). A file gets its
    name when it is whole, and a task that runs again writes the same file: lost executors do no harm. An empty table
    gives no files.
    """
    plain = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html")).withColumn("digest", F.unhex(F.sha1(F.col("html").cast("binary"))))
    long_ = F.octet_length("html") >= min_revisit_bytes
    # Groups are counted from digests alone; partial sums keep a group of any size to a row per task.
    firsts = plain.filter(long_).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    placed = plain.join(firsts, "digest", "left").select("page_id", "url", "html", "digest", F.when(F.col("first") > F.col("page_id"), F.col("first")).alias("first"))

    def run(batches):
        from pyspark import TaskContext

        fs, root = file_system(folder)
        n = TaskContext.get().partitionId()
        name = f"{root}/part-{n:06d}.warc.gz"
        mine = f"{root}/.part-{n:06d}.{os.getpid()}.{TaskContext.get().taskAttemptId()}"
        f, records, size = None, 0, 0
        for part in common.slices(batches):
            if f is None:
                fs.create_dir(root, recursive=True)
                f = fs.open_output_stream(mine)
            for row in part.to_pylist():
                data = record(row["page_id"], row["url"], row["html"].encode("utf-8", "replace"), row["digest"], row["first"])
                f.write(data)
                records, size = records + 1, size + len(data)
        if f is not None:
            f.close()
            fs.move(mine, name)
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/part-{n:06d}.warc.gz"], "bytes": [size], "records": [records]}, schema=pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

    return common.map_batches(placed, run, "path string, bytes long, records long")


def read_warc(files: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """Read archives listed in files(path, bytes). Records whose payload doesn't match its digest are left out.

    Ranges are dealt out one by one, so a single large file is read by as many tasks as it has ranges.
    """
    parts = files.select("path", F.col("bytes").alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start"))
    # A number of its own, so that small ranges aren't put together again: a task for each, up to MAX_TASKS.
    number = parts.agg(F.count("*").alias("n")).first()["n"]
    ranges = parts.repartition(max(1, min(number, MAX_TASKS)), "path", "start")

    def run(batches):
        names = ["record_id", "record_type", "target_uri", "payload_bytes", "payload_digest", "refers_to", "payload"]
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = file_system(row["path"])
                rows, held = [], 0
                with fs.open_input_file(path) as f:
                    for at, data in scan(f, row["size"], row["start"], min(row["size"], row["start"] + split_bytes)):
                        if got := parse_record(data):
                            if not payloads:
                                got["payload"] = None
                            rows.append([*(got[k] for k in names), row["path"], at])
                            held += len(got["payload"] or b"")
                        if len(rows) >= 1000 or held >= 8 << 20:
                            yield emit(rows)
                            rows, held = [], 0
                if rows:
                    yield emit(rows)

    schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary()), ("path", pa.string()), ("offset", pa.int64())])

    def emit(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return common.map_batches(ranges, run, RECORDS)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.new_path(spark, "warc")
    files = common.materialize(write_warc(common.table(spark, sf_dir, "pages"), folder), "warc-files")
    number = lambda c: F.regexp_extract(c, r"(-?\d+)>$", 1).cast("long")
    return read_warc(files, payloads=False).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.when(F.col("refers_to").isNotNull(), number("refers_to")).alias("refers_to"))


QUERIES = {"op7_warc": op7_warc}
ORACLE = {
    "op7_warc": """
with p as (select page_id, coalesce(html, '') as html from pages),
q as (select page_id, strlen(html) as payload_bytes, sha1(html) as payload_digest from p),
f as (select payload_digest, max(page_id) as first from q where payload_bytes >= 1000 group by payload_digest)
select q.page_id, q.payload_bytes, q.payload_digest,
       case when f.first > q.page_id then 'revisit' else 'response' end as record_type,
       case when f.first > q.page_id then f.first end as refers_to
from q left join f on q.payload_digest = f.payload_digest
"""
}
