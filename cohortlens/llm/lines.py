"""Lines that many documents repeat, found through two Bloom filters.

One filter holds the hashes of lines seen once, the other of lines seen twice. Tasks send the bits of their lines,
never the lines; whoever owns a segment of the bits puts those that come again into the second filter. Only lines
that the second filter knows, the suspected repeats, are shuffled: by their SHA-256, which confirms them exactly,
with the number of documents and the first place they stand at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8, written

#: Bits of a filter for each line, and the least and most bits there are. A filter that holds more lines than it is
#: made for suspects more of them; what is confirmed stays the same.
BITS_A_LINE, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 30
#: Bits of a segment, unless there would be more than MOST_SEGMENTS.
SEGMENT_BITS, MOST_SEGMENTS = 1 << 20, 1024
#: Hashes or repeats that a task holds before it sends them.
HELD = 1 << 18
#: Repeats that are broadcast; beyond, the documents meet them by a join.
SENT = 1 << 18
#: White space that a key loses at both ends.
BLANK = b" \t\n\v\f\r"


def key_of(line: bytes) -> bytes:
    """The line without white space at its ends, A-Z in lower case."""
    return line.strip(BLANK).lower()


def _documents(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Every batch with the lines of each of its texts."""
    for batch in batches:
        data, at = utf8(batch.column(column))
        raw, at = data.tobytes(), at.tolist()
        yield batch, [raw[a:b].split(b"\n") for a, b in zip(at, at[1:])]


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The two bits of each hash."""
    mask = np.uint64(bits - 1)
    return np.stack([hashes & mask, (hashes >> np.uint64(32)) & mask])


def _bits_of_lines(bits: int, width: int):
    """Per segment the bits of lines of this task, and those of lines that two of its documents have."""

    def send(hashes: list[int]) -> pa.RecordBatch:
        once, count = np.unique(np.array(hashes, np.uint64), return_counts=True)
        sent = [np.unique(_places(x, bits)).astype(np.int64) for x in (once, once[count > 1])]
        segments = np.unique(sent[0] // width)
        cut = [np.searchsorted(x, np.append(segments * width, bits)) for x in sent]
        cells = [[(x[a:b] % width).astype("<u4").tobytes() for a, b in zip(c, c[1:])] for x, c in zip(sent, cut, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(segments, pa.int32()), *[pa.array(x, pa.binary()) for x in cells]], names=["segment", "once", "twice"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[int] = []
        for _, texts in _documents(batches, 0):
            for lines in texts:
                held += {xxhash.xxh3_64_intdigest(k) for k in {key_of(x) for x in lines} if k}
                if len(held) >= HELD:
                    yield send(held)
                    held = []
        if held:
            yield send(held)

    return run


def _twice_seen(width: int):
    """The second filter of each segment; rows come sorted by segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, once, twice = None, np.zeros(0, bool), np.zeros(0, bool)

        def made():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())], names=["segment", "twice"])

        for batch in batches:
            for segment, *cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if segment != now:
                    if now is not None:
                        yield made()
                    now, once, twice = segment, np.zeros(width, bool), np.zeros(width, bool)
                first, again = (np.frombuffer(x, "<u4") for x in cells)
                twice[first[once[first]]] = True
                twice[again] = True
                once[first] = True
        if now is not None:
            yield made()

    return run


def twice_filter(documents: DataFrame, most_bits: int = MOST_BITS) -> np.ndarray:
    """The filter of lines that two documents have, as bytes; at most most_bits / 8 of them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    n = documents.agg(F.sum(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    bits = LEAST_BITS
    while bits < min(most_bits, n * BITS_A_LINE):
        bits *= 2
    bits = min(bits, most_bits)
    segments = min(MOST_SEGMENTS, max(1, bits // SEGMENT_BITS))
    width = bits // segments
    sent = documents.select("text").mapInArrow(_bits_of_lines(bits, width), "segment int, once binary, twice binary")
    met = sent.repartition(segments, "segment").sortWithinPartitions("segment").mapInArrow(_twice_seen(width), "segment int, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    for segment, twice in met.collect():  # bits / 8 bytes together
        out[segment * width // 8 : (segment + 1) * width // 8] = np.frombuffer(twice, np.uint8)
    return out


def suspected(hashes: np.ndarray, twice: np.ndarray) -> np.ndarray:
    p = _places(hashes, 8 * len(twice))
    return ((twice[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1).all(0)


def _suspects(twice):
    """(hash, digest, n documents of this task, first place) of suspected lines."""

    def send(found: dict) -> pa.RecordBatch:
        n, doc, line = zip(*found.values(), strict=True)
        hashes, digests = zip(*found, strict=True)
        kinds = (pa.uint64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        columns = [pa.array(x, k) for x, k in zip((hashes, digests, n, doc, line), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([columns[0].view(pa.int64()), *columns[1:]], names=["hash", "digest", "n", "doc_id", "line"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, bytes], tuple] = {}
        for batch, texts in _documents(batches, 1):
            keys, at, hashes = [], [], []
            for doc_id, lines in zip(batch.column(0).to_pylist(), texts, strict=True):
                firsts: dict[bytes, int] = {}
                for place, x in enumerate(lines):
                    firsts.setdefault(key_of(x), place)
                firsts.pop(b"", None)
                keys += firsts
                at += [(doc_id, place) for place in firsts.values()]
                hashes += map(xxhash.xxh3_64_intdigest, firsts)
            hits = suspected(np.array(hashes, np.uint64), twice.value) if keys else []
            for k in np.flatnonzero(hits).tolist():
                own = hashes[k], hashlib.sha256(keys[k]).digest()
                n, doc_id, place = found.get(own, (0, *at[k]))
                found[own] = n + 1, *min((doc_id, place), at[k], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
            if len(found) >= HELD:
                yield send(found)
                found = {}
        if found:
            yield send(found)

    return run


def repeated_lines(documents: DataFrame, min_documents: int, twice) -> DataFrame:
    """(hash, digest, n, doc_id, line) of every key found in min_documents documents: how many, and its first place."""
    sent = documents.select("doc_id", "text").mapInArrow(_suspects(twice), "hash bigint, digest binary, n bigint, doc_id bigint, line bigint")
    met = sent.groupBy("hash", "digest").agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "line")).alias("first"))
    return met.filter(F.col("n") >= min_documents).select("hash", "digest", "n", "first.*")


def _without(repeats, keep_first: bool):
    """Documents without repeated lines: doc_id, n_lines, n_dropped, kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = repeats.value
        hashes = {h for h, _ in known}
        for batch, texts in _documents(batches, 1):
            kept = []
            for doc_id, lines in zip(batch.column(0).to_pylist(), texts, strict=True):
                stay = []
                for place, x in enumerate(lines):
                    k = key_of(x)
                    h = xxhash.xxh3_64_intdigest(k)
                    first = known.get((h, hashlib.sha256(k).digest())) if h in hashes else None
                    if first is None or keep_first and first == (doc_id, place):
                        stay.append(x)
                kept.append(stay)
            yield _kept(batch.column(0), texts, kept)

    return run


def _kept(ids: pa.Array, texts: list[list[bytes]], kept: list[list[bytes]]) -> pa.RecordBatch:
    n = np.array([len(x) for x in texts], np.int64)
    dropped = n - np.array([len(x) for x in kept], np.int64)
    return pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(dropped), pa.array([b"\n".join(x).decode() for x in kept], pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept"])


def _places_of_suspects(twice):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _documents(batches, 2):
            out: list[tuple] = []
            for row, doc_id, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
                keys = [key_of(x) for x in lines]
                hits = suspected(np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64), twice.value)
                out += [(row, doc_id, k, hashlib.sha256(keys[k]).digest()) for k in np.flatnonzero(hits).tolist() if keys[k]]
            columns = [*zip(*out, strict=True)] or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["row", "doc_id", "line", "digest"])

    return run


def _drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in _documents(batches, 1):
        gone = [set(x or ()) for x in batch.column(2).to_pylist()]
        yield _kept(batch.column(0), texts, [[x for k, x in enumerate(lines) if k not in g] for lines, g in zip(texts, gone, strict=True)])


def _joined(documents: DataFrame, repeats: DataFrame, twice, keep_first: bool) -> DataFrame:
    """The same where repeats are too many to be sent: suspected lines meet them by digest, then their documents by row."""
    docs = written(documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "rows")
    lines = docs.mapInArrow(_places_of_suspects(twice), "row bigint, doc_id bigint, line bigint, digest binary")
    known = repeats.select("digest", F.col("doc_id").alias("first_doc"), F.col("line").alias("first_line"))
    met = lines.join(known, "digest")
    if keep_first:
        met = met.filter(~(F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("line") == F.col("first_line"))))
    gone = met.groupBy("row").agg(F.collect_list("line").alias("gone"))  # of one document
    return docs.join(gone, "row", "left").select("doc_id", "text", "gone").mapInArrow(_drop, "doc_id bigint, n_lines bigint, n_dropped bigint, kept string")


def dedup_lines(documents: DataFrame, min_documents: int = 10, keep_first: bool = False, most_bits: int = MOST_BITS, sent: int = SENT) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): every document without the lines whose key min_documents documents have.

    Lines end at \\n; a null or empty text is one empty line. A key is the line without white space at its ends,
    A-Z in lower case; empty keys are never dropped. With keep_first the first occurrence of a key (least doc_id,
    null first, then least line) stays. min_documents is 2 at least, as filters know no line that one document
    has. Every row is a document of its own, also one that repeats a doc_id; null doc_ids stay null. A text whose lines
    all go is empty. Empty table: no rows. Other columns are ignored.
    """
    if min_documents < 2:
        raise ValueError("min_documents is 2 at least")
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    context = docs.sparkSession.sparkContext
    twice = context.broadcast(twice_filter(docs, most_bits))
    repeats = written(repeated_lines(docs, min_documents, twice), "repeats")
    if repeats.count() > sent:
        return _joined(docs, repeats, twice, keep_first)
    known = {(r[0] & 0xFFFFFFFFFFFFFFFF, bytes(r[1])): (r[2], r[3]) for r in repeats.select("hash", "digest", "doc_id", "line").collect()}
    return docs.mapInArrow(_without(context.broadcast(known), keep_first), "doc_id bigint, n_lines bigint, n_dropped bigint, kept string")
