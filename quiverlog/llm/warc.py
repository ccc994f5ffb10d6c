"""Content-addressed web archive: payload bytes stored once by digest, exact record headers kept apart, records rebuilt by joins."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverlog.llm.common import fresh_path, modest_batches

#: A fixed date keeps archives of the same input equal, byte for byte.
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CONV_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
PARSED = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string"


def base32_sha1(binary: F.Column) -> F.Column:
    """Base32 of the SHA-1 of a binary column: every 5 hex digits are 20 bits, 4 characters."""
    digest = F.upper(F.sha1(binary))
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), CONV_DIGITS, BASE32)


def record_uri(page_id: F.Column) -> F.Column:
    """A uuid that holds the 64-bit id, so that a reader gets the id back from the record alone."""
    digits = F.lpad(F.lower(F.hex(page_id)), 16, "0")
    return F.concat(F.lit("<urn:uuid:00000000-0000-8000-"), F.substring(digits, 1, 4), F.lit("-"), F.substring(digits, 5, 12), F.lit(">"))


def uri_id(uri: str) -> int:
    value = int(uri.strip("<>").rsplit(":", 1)[1].replace("-", "")[-16:], 16)
    return value - (1 << 64) if value >> 63 else value


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        payloads = batch.column(1)
        packed = pa.array((packer.compress(payloads[i].as_py()) for i in range(batch.num_rows)), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.binary()), packed], names=["digest", "packed"])


def write_archive(pages: DataFrame, path: str) -> None:
    """Write two tables under ``path``: ``payloads`` (digest, packed) and ``headers`` (page_id, digest, head).

    ``pages`` has page_id, url, html. A payload is the html in UTF-8; null is empty. The record with the smallest page_id
    among equal payloads is the response, the others are revisits that refer to it; rows that repeat the smallest id are
    responses, and so is a row without an id where no row of its payload has one. Payloads are pre-aggregated by their
    SHA-256 in each task before they are shuffled, so a group of copies sends one payload from each task.
    """
    modest_batches(pages.sparkSession)
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    keyed = base.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    packed = keyed.select("digest", "payload").mapInArrow(_pack, "digest binary, packed binary").groupBy("digest").agg(F.first("packed").alias("packed"))
    packed.write.option("compression", "none").parquet(f"{path}/payloads")

    slim = keyed.select("page_id", "url", "digest", F.octet_length("payload").alias("size"), base32_sha1(F.col("payload")).alias("sha1"))
    firsts = slim.groupBy("digest").agg(F.min("page_id").alias("first_id"))
    joined = slim.join(firsts, "digest")
    crlf = "\r\n"
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{crlf}Content-Type: text/html; charset=utf-8{crlf}Content-Length: "), F.col("size").cast("string"), F.lit(crlf + crlf))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("size"))
    lines = [
        F.concat(F.lit(f"WARC/1.1{crlf}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit(crlf)),
        F.coalesce(F.concat(F.lit("WARC-Record-ID: "), record_uri(F.col("page_id")), F.lit(crlf)), F.lit("")),
        F.lit(f"WARC-Date: {DATE}{crlf}"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]+", " "), F.lit(crlf)), F.lit("")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), record_uri(F.col("first_id")), F.lit(f"{crlf}WARC-Profile: {REVISIT_PROFILE}{crlf}"))).otherwise(F.lit("")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1"), F.lit(crlf)),
        F.concat(F.lit(f"Content-Type: application/http;msgtype=response{crlf}Content-Length: "), length.cast("string"), F.lit(crlf + crlf)),
        http,
    ]
    joined.select("page_id", "digest", F.concat(*lines).cast("binary").alias("head")).write.parquet(f"{path}/headers")


def _fields(block: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n")[1:])}


def parse_record(record: bytes, payload: bytes) -> tuple:
    """(page_id, payload bytes, digest, type, refers_to, uri) of one record; a revisit's payload is that of the record it refers to."""
    warc, _, rest = record.partition(b"\r\n\r\n")
    fields = _fields(warc)
    block, tail = rest[: int(fields["content-length"])], rest[int(fields["content-length"]) :]
    if tail != b"\r\n\r\n":
        raise ValueError("a record's block does not end where its header says")
    _, _, body = block.partition(b"\r\n\r\n")
    kind = fields["warc-type"]
    if kind == "response" and body != payload:
        raise ValueError("a response's payload is not the stored one")
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if fields["warc-payload-digest"] != f"sha1:{digest}":
        raise ValueError("a payload does not match its record's digest")
    of = fields.get("warc-record-id")
    to = fields.get("warc-refers-to")
    return uri_id(of) if of else None, len(payload), digest, kind, uri_id(to) if to else None, fields.get("warc-target-uri")


def rebuild(head: bytes, payload: bytes) -> bytes:
    """The record's exact bytes: its header, its payload unless it is a revisit, and the two line ends."""
    return head + (b"" if b"\r\nWARC-Type: revisit\r\n" in head[:64] else payload) + b"\r\n\r\n"


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[bytes, bytes]]]:
    """Head and verified payload of each row. Rows come sorted by digest from the join, so the copies of a payload unpack it once."""
    opener, known, payload = zstandard.ZstdDecompressor(), None, b""
    for batch in batches:
        heads, digests, packs = (batch.column(k) for k in range(3))
        rows = []
        for i in range(batch.num_rows):
            digest = digests[i].as_py()
            if digest != known:
                if not packs[i].is_valid:
                    raise ValueError("a record's payload is not in the archive")
                payload = opener.decompress(packs[i].as_py())
                if hashlib.sha256(payload).digest() != digest:
                    raise ValueError("a stored payload does not match its digest")
                known = digest
            rows.append((heads[i].as_py(), payload))
        yield rows


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    names = [x.split()[0] for x in PARSED.split(", ")]
    for found in _unpacked(batches):
        rows = [parse_record(rebuild(head, payload), payload) for head, payload in found]
        columns = list(zip(*rows)) if rows else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for found in _unpacked(batches):
        yield pa.RecordBatch.from_arrays([pa.array((rebuild(*x) for x in found), pa.binary())], names=["record"])


def _joined(spark: SparkSession, path: str) -> DataFrame:
    heads = spark.read.schema("page_id long, digest binary, head binary").parquet(f"{path}/headers")
    payloads = spark.read.schema("digest binary, packed binary").parquet(f"{path}/payloads")
    return heads.join(payloads, "digest", "left").select("head", "digest", "packed")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The archive's records as they were written, one binary column ``record``."""
    return _joined(spark, path).mapInArrow(_records, "record binary")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Rebuild every record by the join of headers and payloads, verify both digests and parse it."""
    return _joined(spark, path).mapInArrow(_parse, PARSED)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to an archive in the shared folder and return what its records say.

    One row for each row of ``pages``, also for nulls, repeated ids and repeated rows (see ``write_archive``); an empty
    table gives none; other columns are ignored.
    """
    path = fresh_path(pages.sparkSession, "warc")
    write_archive(pages, path)
    return read_archive(pages.sparkSession, path)
