"""Documents alike in their sets of word shingles: SimHash candidates over a Gray-order index, exact links.

1. Every set has a SimHash fingerprint of 128 bits. Fingerprints are dealt by samples of their bits, as many
   samples as bring two sets of the asked similarity into one bucket all but certainly; the length of a sample
   grows with the corpus, and their number with that, so recall is the same at every size.
2. In a bucket the Gray-order index finds the fingerprints within the radius of the similarity. A forest of
   nearest pairs is compared on the whole sets, and what is alike becomes one component.
3. Fingerprints that have others of another component within the radius are what the forest did not decide.
   Their sets alone go through an exact join by prefixes: no pair of them that is alike is missed. A corpus that
   would need more than MOST_SAMPLES samples sends all its sets through that join, with the components so far as labels.
   Their prefixes are taken in the scan that makes the fingerprints and meet a slice of all hashes at a time; whole
   sets are made again, only for what met.

Only links found alike on the whole sets join components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, given_back, mixed, pieces, sent_if_small, shuffles_dropped, utf8, whole_groups, written
from .components import component_labels
from .dealing import dealt, labelled, salted, sorted_by
from .gray import GrayIndex, spanning_links
from .shingle_join import PREFIX, PREFIX_SCHEMA, Words, alike_links, candidates, common_hashes, confirmed, counted_rows, lists, prefix_columns, set_key, shingle_set

BITS = 128
#: Chance that two sets just as alike as asked lie beyond the radius, and that no sample of bits brings them together.
BEYOND = 0.01
APART = 0.02
#: Samples at most: a document has that many rows in buckets, whatever the corpus. Where APART asks for more (from about
#: a million documents on) these samples still bring most copies together, and all sets go through the exact join.
MOST_SAMPLES = 16
#: Fingerprints that share a bucket by chance.
BUCKET_ROWS = 2048
#: Rows of one bucket in a task; a bucket of more is dealt out.
MOST_ROWS = 1 << 16
CHUNK_ROWS = 1 << 14
#: Slices of the hashes by which all sets meet; a fixed number, as each is a share of the input.
SLICES = 4


def set_print(hashes: np.ndarray) -> tuple[int, int]:
    """Two words of bits that are set in more than half of a set's hashes."""
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 15):
        part = hashes[k : k + (1 << 15)]
        both = np.stack([part, mixed(part ^ np.uint64(0x6A09E667F3BCC909))], axis=1)
        bits = np.unpackbits(both.astype("<u8").view(np.uint8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.int64)
    words = np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8").astype(np.uint64).view(np.int64)
    return int(words[0]), int(words[1])


def _bits_apart(similarity: float) -> np.ndarray:
    """Chances of 0 .. BITS differing bits for two sets alike to `similarity`: their angle as a share of a half turn."""
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    d = np.arange(BITS + 1)
    ways = np.r_[0.0, np.cumsum(np.log(np.arange(BITS, 0, -1) / np.arange(1, BITS + 1)))]
    with np.errstate(divide="ignore"):
        log = ways + np.where(d > 0, d * np.log(max(p, 1e-12)), 0) + (BITS - d) * np.log(1 - p)
    return np.exp(log)


def radius_of(similarity: float) -> int:
    return int(np.searchsorted(np.cumsum(_bits_apart(similarity)), 1 - BEYOND))


def bit_samples(rows: int, similarity: float) -> list[list[int]]:
    """Samples of bits: of a length that leaves BUCKET_ROWS of `rows` random prints together, and so many that APART holds."""
    length = int(np.clip(np.ceil(np.log2(max(1, rows) / BUCKET_ROWS)), 4, 48))
    chances = _bits_apart(similarity)[: radius_of(similarity) + 1]
    d = np.arange(len(chances))
    equal = np.exp(sum(np.log(np.maximum(1e-12, (BITS - d - i) / (BITS - i))) for i in range(length)))
    number = 1
    while (chances * (1 - equal) ** number).sum() / chances.sum() > APART:
        number += 1
    rng, out = np.random.default_rng(length), []
    while len(out) < number:
        order = rng.permutation(BITS).tolist()
        out += [sorted(order[k : k + length]) for k in range(0, BITS - length + 1, length)]
    return out[:number]


def _hash_batches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Words()
        for batch in batches:
            for a, b in pieces(utf8(batch.column(0))[1]):
                yield pa.RecordBatch.from_arrays([lists([shingle_set(x.as_py(), shingle, held) for x in batch.column(0)[a:b]])], names=["hashes"])

    return given_back(run)


def _set_batches(shingle: int, similarity: float, common=None):
    """Key and fingerprint of each text's set; with `common` also its prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Words()
        for batch in batches:
            for a, b in pieces(utf8(batch.column(1))[1]):
                part = batch.slice(a, b - a)
                sets = [shingle_set(x.as_py(), shingle, held) for x in part.column(1)]
                prints = [set_print(s) for s in sets]
                columns = [part.column(0), pa.array([set_key(s) for s in sets], pa.binary()), *(pa.array([p[k] for p in prints], pa.int64()) for k in (0, 1))]
                more = prefix_columns(sets, similarity, common.value) if common else []
                yield pa.RecordBatch.from_arrays([*columns, *more], names=["doc_id", "set", "p", "q", *(PREFIX if common else [])])

    return given_back(run)


def _chosen_sets(shingle: int):
    """The sets of texts that are those of their node; a repeated doc_id may have others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Words()
        for batch in batches:
            for a, b in pieces(utf8(batch.column(2))[1]):
                part = batch.slice(a, b - a)
                sets = [shingle_set(x.as_py(), shingle, held) for x in part.column(2)]
                nodes, keys = (part.column(k).to_pylist() for k in (0, 1))
                own = [k for k, s in enumerate(sets) if set_key(s) == keys[k]]
                yield pa.RecordBatch.from_arrays([pa.array([nodes[k] for k in own], pa.int64()), lists([sets[k] for k in own])], names=["node", "hashes"])

    return given_back(run)


def _nodes_of(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, doc_id, set) of the ends of pairs."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    return written(ends.join(nodes.select("node", "doc_id", "set"), "node"), "asked")


def _sets_of(asked: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(node, hashes) of (node, doc_id, set), made from the texts."""
    texts = docs.join(sent_if_small(asked.select("doc_id", "node", "set")), "doc_id")
    made = texts.select("node", "set", "text").mapInArrow(_chosen_sets(shingle), "node bigint, hashes array<bigint>")
    return written(made.groupBy("node").agg(F.first("hashes").alias("hashes")), "sets")


def _columns(rows: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    words = [rows[c].to_numpy().view(np.uint64) for c in ("p", "q")]
    _, label = np.unique(rows["label"].to_numpy(), return_inverse=True)
    return words, label, rows["node"].to_numpy()


def _runs(rows: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(len(rows), bool)
    for k in keys:
        own = rows[k].to_numpy()
        new[1:] |= own[1:] != own[:-1]
    return np.cumsum(new)


def _forest_batches(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["key", "cell"], CHUNK_ROWS):
            words, label, node = _columns(rows)
            a, b = spanning_links(GrayIndex(_runs(rows, ["key", "cell"]), words), words, label, radius)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[a], node[b])), pa.array(np.maximum(node[a], node[b]))], names=["a", "b"])

    return given_back(run)


def _undecided_batches(radius: int):
    """Nodes that have another of another label within the radius, in their bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["key", "cell", "other"], CHUNK_ROWS):
            words, label, node = _columns(rows)
            group = _runs(rows, ["key", "cell", "other"])
            # Two sides meet each other only; the rest of a bucket meets all, but for the label of its majority.
            kind = rows["side"].to_numpy().astype(np.int64)
            own, number, count = np.unique(group * (int(label.max()) + 1) + label, return_inverse=True, return_counts=True)
            kind[(kind == 2) & (2 * count[number] > np.bincount(group)[group])] = 3
            tree = group * 4 + kind
            trees = np.unique(tree)
            ahead = np.flatnonzero((trees[1:] == trees[:-1] + 1) & (trees[:-1] % 2 == 0))
            within = np.flatnonzero(trees % 4 == 2)
            roots = (np.r_[ahead, within], np.r_[ahead + 1, within])
            seen = np.zeros(len(node), bool)
            for a, b in GrayIndex(tree, words, label).pairs(radius, roots):
                seen[a] = True
                seen[b] = True
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(node[seen]))], names=["node"])

    return given_back(run)


def similar_documents(documents: DataFrame, shingle: int = 5, similarity: float = 0.8, most_rows: int = MOST_ROWS) -> DataFrame:
    """(doc_id, component_id) of documents whose sets of word shingles are alike to `similarity` or more.

    Components join pairs with a Jaccard similarity of at least `similarity`, compared on whole sets of
    64-bit hashes; pairs are found as the module says. Equal sets (by 128 bits of them) are one node. Texts without words are
    alike. Repeated doc_ids each have their row, and join their texts' components; a null doc_id links
    nothing and has a null component. Empty table: no rows. Other columns are ignored.
    """
    with shuffles_dropped(documents.sparkSession):
        return _similar_documents(documents, shingle, similarity, most_rows)


def _needs_all(rows: int, similarity: float) -> bool:
    return len(bit_samples(rows, similarity)) > MOST_SAMPLES


def _similar_documents(documents: DataFrame, shingle: int, similarity: float, most_rows: int) -> DataFrame:
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total, common = docs.count(), None
    if _needs_all(total, similarity):  # and so perhaps the different sets do
        some = counted_rows(docs.select("text"), "text", total).distinct()
        common = documents.sparkSession.sparkContext.broadcast(common_hashes(some.mapInArrow(_hash_batches(shingle), "hashes array<bigint>")))
    read = written(docs.mapInArrow(_set_batches(shingle, similarity, common), "doc_id bigint, set binary, p bigint, q bigint" + (f", {PREFIX_SCHEMA}" if common else "")), "prints")
    once = read.filter("doc_id is not null").groupBy("set").agg(F.min("doc_id").alias("doc_id"), F.first("p").alias("p"), F.first("q").alias("q"))
    nodes = written(once.withColumn("node", F.monotonically_increasing_id()), "nodes")
    own = written(read.select("doc_id", "set").join(nodes.select("set", "node"), "set", "left").select("doc_id", "node"), "own")
    radius = radius_of(similarity)

    # Buckets: the bits of each sample, hashed with the sample's number.
    rows_of_nodes = nodes.count()
    whole, samples = _needs_all(rows_of_nodes, similarity), bit_samples(rows_of_nodes, similarity)[:MOST_SAMPLES]
    masks = [[sum(1 << (b % 64) for b in bits if b // 64 == w) for w in (0, 1)] for bits in samples]
    signed = lambda x: F.lit(x - (1 << 64) if x >> 63 else x)
    keys = F.array(*[F.xxhash64(F.lit(k), F.col("p").bitwiseAND(signed(m)), F.col("q").bitwiseAND(signed(n))) for k, (m, n) in enumerate(masks)])
    rows = written(nodes.select(F.explode(keys).alias("key"), "p", "q", "node"), "buckets")
    forest = sorted_by(salted(rows.withColumn("label", F.col("node")), most_rows), "key", "cell").select("key", "cell", "p", "q", "node", "label")
    pairs = written(forest.mapInArrow(_forest_batches(radius), "a bigint, b bigint").distinct(), "near")

    # Only the sets of nodes that have a near one are made, once.
    asked = _nodes_of(pairs, nodes)
    sets = _sets_of(asked, docs, shingle)
    repeated = own.filter("doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a <> b")
    same_id = own.join(repeated.select("doc_id", "a"), "doc_id").select("a", F.col("node").alias("b"))
    links = written(confirmed(pairs, sets, similarity).unionByName(same_id), "alike")
    labels = written(component_labels(links), "labels")

    if whole:
        own_rows = read.filter("doc_id is not null").groupBy("doc_id", "set").agg(*[F.first(c).alias(c) for c in PREFIX])
        of_set = labelled(nodes.select("node", "doc_id", "set"), labels)
        dropped(sets, rows)
        prefixes = written(own_rows.join(of_set, ["doc_id", "set"]).select("node", "label", *PREFIX), "prefixes")
        dropped(read)
        pairs = candidates(prefixes, similarity, most_rows, SLICES)
        dropped(prefixes)
        sets = _sets_of(_nodes_of(pairs, nodes), docs, shingle)
        more = written(confirmed(pairs, sets, similarity), "alike")
        dropped(sets)
    else:  # what has a near one in another component is decided exactly
        of_asked = labelled(asked.select("node"), labels)
        left = dealt(rows.join(of_asked, "node").select("key", "p", "q", "node", "label"), most_rows)
        left = sorted_by(left, "key", "cell", "other").select("key", "cell", "other", "side", "p", "q", "node", "label")
        undecided = written(left.mapInArrow(_undecided_batches(radius), "node bigint").distinct(), "undecided")
        more = alike_links(sets.join(undecided, "node"), labels, similarity, most_rows)
        dropped(sets, rows, read)
    labels = written(component_labels(links.unionByName(more)), "labels")

    of_node = labelled(nodes.select("node", "doc_id"), labels)
    least = of_node.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of_node = of_node.join(least, "label").select("node", "component_id")
    return own.select("doc_id", "node").join(of_node, "node", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
