"""WARC archives with dictionary compression.

An archive begins with a skippable frame that holds a Zstandard dictionary built from records of the same
archive; each record follows as a frame of its own, so a reader that knows a record's place reads it alone.
Archives are rows of a Parquet table: Spark's readers and writers carry the bytes to any store.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import files_of, read_files, sent_if_small, shared_dir, written

DICTIONARY_MAGIC = 0x184D2A5D
ARCHIVE_BYTES = 8 << 20
#: The dictionary is built from this much of an archive's records, spread over it, and has this size at most.
SAMPLE_BYTES = 1 << 20
DICTIONARY_BYTES = 32 << 10
LEAST_REVISIT = 1000
LEVEL = 3
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_uri(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_of(uri: str) -> int | None:
    name = uri.strip("<>").rpartition(":")[2]
    return None if name == "null" else int(name)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers: bool, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has the digest and size of its payload, not the payload."""
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers else 'response'}",
        f"WARC-Record-ID: {record_uri(page_id)}",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {' '.join(url.split())}"] if url else []),
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_uri(refers_to)}"] if refers else []),
        f"WARC-Payload-Digest: {digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {0 if refers else len(payload)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + (b"" if refers else payload) + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    return fields, rest[:size]


def dictionary_of(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from records taken evenly over the archive; none where they are too few to build one."""
    total = sum(map(len, records))
    step = max(1, -(-total // SAMPLE_BYTES))
    sample = [r[:SAMPLE_BYTES] for r in records[::step]]
    if len(sample) < 8 or sum(map(len, sample)) < 4096:
        return None
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, sample)) // 4), sample)
    except zstandard.ZstdError:  # records too alike or too short
        return None


def archive_bytes(records: list[bytes]) -> bytes:
    own = dictionary_of(records)
    held = own.as_bytes() if own else b""
    out = [struct.pack("<II", DICTIONARY_MAGIC, len(held)), held]
    press = zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=True, write_checksum=True)
    out += [press.compress(r) for r in records]
    return b"".join(out)


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records of an archive, frame by frame."""
    magic, size = struct.unpack_from("<II", data)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive has no dictionary frame")
    own = zstandard.ZstdCompressionDict(data[8 : 8 + size]) if size else None
    plain = zstandard.ZstdDecompressor(dict_data=own)
    rest = memoryview(data)[8 + size :]
    while len(rest):
        frame = plain.decompressobj()
        record = frame.decompress(rest)
        if not frame.eof:
            raise ValueError("a frame is cut")
        left = len(frame.unused_data)
        yield record
        rest = rest[len(rest) - left :]


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[bytes] = []
    size = 0

    def out():
        return pa.RecordBatch.from_arrays([pa.array([len(held)], pa.int64()), pa.array([archive_bytes(held)], pa.binary())], names=["n_records", "archive"])

    for batch in batches:
        for page_id, url, html, refers, refers_to in zip(*batch.columns, strict=True):
            held.append(record_bytes(page_id.as_py(), url.as_py(), (html.as_py() or "").encode(), refers.as_py(), refers_to.as_py()))
            size += len(held[-1])
            if size >= ARCHIVE_BYTES:
                yield out()
                held, size = [], 0
    if held:
        yield out()


_ROWS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for archive in batch.column(0):
            rows = []
            for record in read_archive(archive.as_py()):
                fields, payload = parse_record(record)
                digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                kind = fields["WARC-Type"]
                if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError("a payload does not have its digest")
                size = len(payload) if kind == "response" else int(fields["X-Payload-Length"])
                rows.append((page_of(fields["WARC-Record-ID"]), size, digest, kind, page_of(fields["WARC-Refers-To"]) if kind == "revisit" else None))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_ROWS.types)], schema=_ROWS)


def write_archives(pages: DataFrame) -> DataFrame:
    """(n_records, archive): WARC records of all pages, repeated payloads as revisits.

    Payloads are grouped by digest and size, never by their bytes; only the largest id of a group is gathered,
    and what meets by digest are ids. The html goes to its reference by page_id, or stays where it is if the
    revisits are few enough to be sent to every task.
    """
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    own = own.withColumn("digest", F.sha1(F.encode("html", "utf-8"))).withColumn("size", F.octet_length("html"))
    ids = own.filter(F.col("size") >= LEAST_REVISIT).select("page_id", "digest", "size")
    many = ids.groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    revisits = ids.join(many, ["digest", "size"]).filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to").distinct()
    revisits = sent_if_small(written(revisits, "revisits"))
    both = own.join(revisits, own["page_id"].eqNullSafe(revisits["page_id"]) & (own["digest"] == revisits["digest"]), "left")
    both = both.select(own["page_id"], "url", "html", revisits["digest"].isNotNull().alias("refers"), "refers_to")
    return both.mapInArrow(_write, "n_records bigint, archive binary")


def read_archives(archives: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record."""
    return archives.select("archive").mapInArrow(_read, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def save_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Writes every archive to a .warc.zst file of its own in `folder` (a URI that all machines see): (path, n_bytes)."""
    return files_of(archives, "archive", folder, ".warc.zst")


def archive_round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the archives as .warc.zst files to `folder` (None: a new one in the shared folder) and read the files back.

    Null html is an empty payload; a null url has no target line; a null page_id is smaller than all. Rows
    that repeat the largest page_id of a group are all responses. Empty table: no rows. Other columns are
    ignored.
    """
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    files = save_archives(write_archives(pages), folder)
    return read_archives(read_files(files, folder, ".warc.zst").withColumnRenamed("content", "archive"))
