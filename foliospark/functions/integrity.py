"""Digests, chunks and canonical forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 1 << 20
VERSION = "foliospark:chunked-sha256:1"


def chunk_digests(data: Column, size: int = CHUNK) -> Column:
    """SHA-256, in hex, of each chunk; one of the empty chunk if there is no data."""
    count = F.greatest(F.ceil(F.octet_length(data) / size), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(1), count), lambda k: F.sha2(F.substring(data, (k - 1) * size + 1, F.lit(size)), 256))


def transfer_checksum(digests: Column) -> Column:
    """SHA-256 of the chunk digests' bytes, end to end."""
    return F.sha2(F.unhex(F.array_join(digests, "")), 256)


def content_identity(data: Column, size: int = CHUNK) -> Column:
    """Identity of content by its chunks, size and a version tag."""
    head = F.encode(F.concat_ws("\n", F.lit(VERSION), F.octet_length(data).cast("string"), F.lit(str(size)), F.lit("")), "UTF-8")
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(head, F.unhex(F.array_join(chunk_digests(data, size), ""))), 256))


def chunk_count(size: Column, chunk: int = CHUNK) -> Column:
    return F.ceil(size / chunk).cast("long")


def canonical_json(**fields: Column) -> Column:
    """JSON with keys in order."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))
