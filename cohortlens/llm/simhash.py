"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are dealt into buckets that share some blocks of bits (two fingerprints with at most `radius`
differing bits agree in at least blocks - radius of the blocks, so they meet in one bucket). In a bucket
they are sorted by Gray rank; runs of neighbours form nodes that hold the bits all their members share, and
nodes form upper nodes. Two nodes are followed only while the shared bits they both hold differ in at most
`radius` places, which rules out whole groups at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sent_if_small, whole_groups, written
from .components import component_labels
from .gray import GrayIndex, differing, spanning_links
from .similar import similar_documents

BITS = 64
#: Distinct fingerprints that one bucket holds at most; a larger bucket is dealt on by further blocks.
BUCKET_ROWS = 512
CHUNK_ROWS = 2048


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Bits set in more than half of the XXH64 values of the text's word shingles; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line, width = b" ".join(words), min(shingle, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    begins = (ends + 1 - sizes)[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], 42) for a, b in zip(begins, ends[width - 1 :].tolist(), strict=True)], np.uint64)
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def _print_batches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch.column(1)), np.uint64, len(batch)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=["doc_id", "print"])

    return run


def fingerprints(documents: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, print) with the 64 bits as a signed integer."""
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_print_batches(shingle), "doc_id bigint, print bigint")


def _links_of(rows: pa.Table, radius: int) -> pa.RecordBatch:
    """A spanning forest of the links inside each bucket."""
    bucket = np.cumsum(np.r_[0, (np.diff(rows["table"].to_numpy()) != 0) | (np.diff(rows["key"].to_numpy()) != 0)])
    prints, nodes = rows["print"].to_numpy().view(np.uint64), rows["node"].to_numpy()
    a, b = spanning_links(GrayIndex(bucket, prints), [prints], np.arange(len(nodes)), radius)
    return pa.RecordBatch.from_arrays([pa.array(nodes[a]), pa.array(nodes[b]), pa.array(differing([prints[a]], [prints[b]]))], names=["a", "b", "bits"])


def _link_batches(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["table", "key"], CHUNK_ROWS):
            yield _links_of(rows, radius)

    return run


def _block_masks(bits: list[int], blocks: int, agree: int) -> list[int]:
    """Masks of all choices of `agree` blocks among the given bits."""
    cuts = [bits[k * len(bits) // blocks : (k + 1) * len(bits) // blocks] for k in range(blocks)]
    return [sum(1 << x for c in chosen for x in cuts[c]) for chosen in combinations(range(blocks), agree)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_links(prints: DataFrame, radius: int = 3, blocks: int | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (a, b, bits) between nodes of (print, node), print distinct, that join all within `radius` bits.

    Buckets are made by every choice of blocks - radius of the blocks: prints within the radius agree in one of them.

    Not every pair is listed: of the pairs in one bucket a spanning forest stays, which keeps each
    component whole. A bucket of more than `bucket_rows` is dealt on by blocks of its remaining bits, again
    and again; as prints are distinct, this ends.
    """
    spark, blocks = prints.sparkSession, blocks or radius + 1
    agree = blocks - radius
    masks = _block_masks(list(range(BITS)), blocks, agree)
    rows = prints.select("print", "node", F.explode(F.array(*[F.struct(F.lit(m).alias("table"), F.col("print").bitwiseAND(F.lit(m)).alias("key")) for m in map(_signed, masks)])).alias("k"))
    rows = rows.select(F.col("k.table").alias("table"), F.col("k.key").alias("key"), "print", "node")
    links = None
    level, ready = 0, []
    while True:
        rows = written(rows, "buckets")
        large = written(rows.groupBy("table", "key").count().filter(F.col("count") > bucket_rows).select("table", "key"), "large")
        tables = [r[0] for r in large.select("table").distinct().collect()]  # masks: as many as there are choices of blocks
        ready.append(rows.join(large, ["table", "key"], "left_anti") if tables else rows)
        level += 1
        if not tables:
            break
        further = []
        for t in tables:
            left = [x for x in range(BITS) if not (t >> x) & 1]
            further += [(t, _signed(m | (t & ((1 << 64) - 1)))) for m in _block_masks(left, blocks, agree)]
        hot = rows.join(large, ["table", "key"], "left_semi")
        dealt = hot.join(F.broadcast(spark.createDataFrame(further, "table bigint, next bigint")), "table")
        rows = dealt.select(F.col("next").alias("table"), F.col("print").bitwiseAND(F.col("next")).alias("key"), "print", "node").distinct()
    for part in ready:
        own = part.repartition("table", "key").sortWithinPartitions("table", "key").mapInArrow(_link_batches(radius), "a bigint, b bigint, bits bigint")
        links = own if links is None else links.unionByName(own)
    return links


def near_duplicates(documents: DataFrame, shingle: int = 3, radius: int = 3, blocks: int | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document.

    Equal fingerprints are one node before any search, so copies cost one row each however many there are.
    Null, empty and blank texts have fingerprint zero and are linked like any other. A text of fewer words
    than a shingle is one shingle. Repeated doc_ids each have their row, and lie in the components of all
    their texts' fingerprints; a null doc_id links nothing and has a null component. Empty table: no rows.
    Other columns are ignored.
    """
    own = written(fingerprints(documents, shingle), "prints")
    nodes = written(own.filter("doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")), "nodes")
    links = near_links(nodes.select("print", "node"), radius, blocks)
    repeated = own.filter("doc_id is not null").groupBy("doc_id").agg(F.min("print").alias("p"), F.max("print").alias("q")).filter("p <> q")
    same_id = own.join(repeated.select("doc_id"), "doc_id").join(nodes, "print").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    labels = component_labels(links.select("a", "b").unionByName(same_id))
    of_print = nodes.join(labels, "node", "left").select("print", F.coalesce("label", "node").alias("component_id"))
    return own.join(of_print, "print", "left").select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def one_of_each(documents: DataFrame, **options) -> DataFrame:
    """documents with one row of each component of alike texts, one of least doc_id; all columns stay.

    Of rows that repeat a doc_id one stays, that of the least text hash. Rows with a null doc_id are in no
    component and stay. Texts without words are one component. Empty table: no rows.
    """
    found = written(similar_documents(documents, **options), "alike")
    gone = sent_if_small(written(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct(), "gone"))
    more = found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("__gone"))
    own = documents["doc_id"].cast("bigint")
    stay = documents.join(gone, own == gone["__gone"], "left_anti")
    if more.isEmpty():
        return stay
    repeated = stay.join(more, own == more["__gone"], "left_semi")
    row = F.struct(*[F.col(f"`{c}`").alias(c) for c in documents.columns])
    first = repeated.groupBy(F.col("doc_id").cast("bigint").alias("__id")).agg(F.min_by(row, F.xxhash64("text")).alias("__row")).select("__row.*")
    return stay.join(more, own == more["__gone"], "left_anti").unionByName(first)
