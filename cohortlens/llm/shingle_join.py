"""Sets of word shingles, their comparison, and an exact join of alike sets by prefixes.

All sets are put into one order, common hashes last. Two sets alike to `similarity` share a hash within the
first n - ceil(similarity * n) + 1 of each, so these prefixes are dealt by hash and every pair that can be
alike meets. Sizes, places and a bitmap of each set rule most others out without loss; what is left is compared
on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, given_back, mixed, whole_groups, written
from .dealing import dealt, labelled, sorted_by
from .sketch import likeness

#: Sets whose hashes are counted to tell common ones, and how many common hashes are sent to every task.
COUNTED_ROWS = 20_000
COMMON_HASHES = 200_000
CHUNK_ROWS = 65_536
PAIRS_AT_ONCE = 250_000
MAP_WORDS = 8
MAP = [f"m{k}" for k in range(MAP_WORDS)]
PREFIX = ["n", *MAP, "wide", "prefix"]
PREFIX_SCHEMA = f"n int, {', '.join(f'{m} bigint' for m in MAP)}, wide binary, prefix array<bigint>"
STEP = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """XXH64 of words, held for the next use."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word, 42)
        return out


def shingle_set(text: str | None, width: int, held: dict | None = None) -> np.ndarray:
    """Sorted different hashes of runs of `width` words; of all words if there are fewer."""
    words = (text or "").lower().encode().split()
    held = Words() if held is None else held
    codes = np.fromiter(map(held.__getitem__, words), np.uint64, len(words))
    width = min(width, len(codes))
    if not width:
        return codes
    out = np.full(len(codes) - width + 1, width, np.uint64)
    for k in range(width):
        out = out * STEP + codes[k : k + len(out)]
    return np.unique(mixed(out))


def set_key(hashes: np.ndarray) -> bytes:
    """128 bits of a set; sets with equal keys are taken for equal, of 5e10 sets with a chance of 4e-18 wrongly."""
    return xxhash.xxh3_128_digest(hashes.tobytes())


def prefix_length(n: int, similarity: float) -> int:
    return n - int(np.ceil(similarity * n - 1e-9)) + 1 if n else 0


def lists(arrays: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(flat))


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets, of (node, hashes), are alike."""
    left, right = (sets.select(F.col("node").alias(end), F.col("hashes").alias(name)) for end, name in (("a", "x"), ("b", "y")))
    return pairs.join(left, "a").join(right, "b").filter(likeness(F.col("x"), F.col("y")) >= similarity).select("a", "b")


def counted_rows(rows: DataFrame, by: str, total: int) -> DataFrame:
    """About COUNTED_ROWS of `total` rows, chosen by a hash of a column."""
    share = min(1.0, COUNTED_ROWS / max(1, total))
    return rows.filter(F.pmod(F.xxhash64(by), F.lit(1 << 30)) < int(share * (1 << 30)))


def common_hashes(some: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that several of some sets have, and in how many. They order the prefixes only."""
    counted = some.select(F.explode("hashes").alias("hash")).groupBy("hash").count().filter("count > 2")
    rows = counted.orderBy(F.desc("count"), "hash").limit(COMMON_HASHES).toPandas()
    hashes, counts = rows["hash"].to_numpy(np.int64).view(np.uint64), rows["count"].to_numpy(np.int64)
    by = np.argsort(hashes)
    return hashes[by], counts[by]


def bitmap(hashes: np.ndarray, words: int = MAP_WORDS) -> np.ndarray:
    """So many words in which every hash turns one bit: two sets differ in as many members as bits at least."""
    bits = np.bincount((hashes >> np.uint64(20)).astype(np.int64) % (64 * words), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<u8").astype(np.uint64)


def wide_bitmap(hashes: np.ndarray) -> bytes:
    """A bitmap of two bits a member or more, a power of two: a thirtieth of the set, and not full however long that is."""
    return bitmap(hashes, max(MAP_WORDS, 1 << max(0, 2 * len(hashes) - 1).bit_length() - 6 if len(hashes) > 32 else 0)).astype("<u8").tobytes()


def bits_apart(a: bytes, b: bytes) -> int:
    """Differing bits of two wide bitmaps, the larger folded to the size of the smaller."""
    x, y = sorted((np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def prefix_columns(sets: list[np.ndarray], similarity: float, common: tuple[np.ndarray, np.ndarray]) -> list[pa.Array]:
    """n, the words of the bitmap and the prefix of each set: the columns PREFIX."""
    hashes, counts = common
    prefixes = []
    for own in sets:
        n = prefix_length(len(own), similarity)
        if len(hashes):
            at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
            own = own[np.argsort(np.where(hashes[at] == own, counts[at], 0), kind="stable")]
        prefixes.append(own[:n])
    maps = np.array([bitmap(own) for own in sets]).reshape(len(sets), MAP_WORDS).view(np.int64)
    return [pa.array([len(own) for own in sets], pa.int32()), *(pa.array(maps[:, k]) for k in range(MAP_WORDS)), pa.array([wide_bitmap(own) for own in sets], pa.binary()), lists(prefixes)]


def _prefix_batches(similarity: float, common):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [x.values.to_numpy().view(np.uint64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *prefix_columns(sets, similarity, common.value)], names=["node", *PREFIX])

    return given_back(run)


def _can_be_alike(n: np.ndarray, place: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the sizes allow it and, if this is the first hash that both have, what follows it is enough."""
    least = np.ceil(similarity / (1 + similarity) * (n[a] + n[b]) - 1e-9)
    return np.minimum(n[a] - place[a], n[b] - place[b]) >= least


def _ranges(begins: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of range, place in it), PAIRS_AT_ONCE or little more at a time."""
    wide = ends - begins
    upto = np.cumsum(wide)
    first = 0
    while first < len(wide):
        before = upto[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(upto, before + PAIRS_AT_ONCE, side="right")))
        w = wide[first:last]
        k = np.repeat(np.arange(first, last), w)
        yield k, np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w) + begins[k]
        first = last


def _runs(x: np.ndarray) -> np.ndarray:
    return np.cumsum(np.r_[0, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)


def _pairs(rows: pa.Table, similarity: float) -> Iterator[pa.RecordBatch]:
    """Pairs of different labels that can be alike, of one bucket and, where it has two sides, of different sides."""
    columns = {c: rows[c].to_numpy().astype(np.int64) for c in ("key", "cell", "other", "side", "node", "n", "place", "label")}
    by = np.lexsort((columns["n"], columns["other"], columns["cell"], columns["key"]))
    key, cell, other, side, node, n, place, label = (c[by] for c in columns.values())
    maps = np.stack([rows[c].to_numpy().view(np.uint64)[by] for c in MAP], axis=1)
    bucket = np.cumsum(np.r_[0, (np.diff(key) != 0) | (np.diff(cell) != 0) | (np.diff(other) != 0)])
    # Members of the label that is most frequent in their bucket meet only those of other labels.
    _, of = np.unique(label, return_inverse=True)
    _, run, count = np.unique(bucket * (int(of.max()) + 1) + of, return_inverse=True, return_counts=True)
    best = np.zeros(int(bucket[-1]) + 1, np.int64)
    np.maximum.at(best, bucket, count[run] * len(run) + run)
    own = np.flatnonzero(run != best[bucket] % len(run))
    wide = int(n.max()) * 2 + 3
    span = bucket * wide + n
    low = np.searchsorted(span, bucket[own] * wide + np.ceil(similarity * n[own] - 1e-9).astype(np.int64))
    high = np.searchsorted(span, bucket[own] * wide + np.minimum(wide - 1, np.floor(n[own] / similarity + 1e-9).astype(np.int64)), side="right")
    for k, b in _ranges(low, high):
        a = own[k]
        keep = (label[a] != label[b]) & ((side[a] != side[b]) | (side[a] == 2)) & _can_be_alike(n, place, a, b, similarity)
        a, b = a[keep], b[keep]
        least = np.ceil(similarity / (1 + similarity) * (n[a] + n[b]) - 1e-9)
        keep = np.bitwise_count(maps[a] ^ maps[b]).sum(axis=1, dtype=np.int64) <= n[a] + n[b] - 2 * least
        a, b = node[a[keep]], node[b[keep]]
        if len(a):
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])


def _pair_batches(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["key", "cell", "other"], CHUNK_ROWS):
            yield from _pairs(rows, similarity)

    return given_back(run)


def _apart_batches(similarity: float):
    """Pairs whose wide bitmaps do not rule them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m = (c.to_numpy() for c in batch.columns[:4])
            most = n + m - 2 * np.ceil(similarity / (1 + similarity) * (n + m) - 1e-9)
            apart = [bits_apart(x.as_py(), y.as_py()) for x, y in zip(*batch.columns[4:], strict=True)]
            yield batch.filter(pa.array(np.array(apart, np.int64) <= most, pa.bool_())).select(["a", "b"])

    return given_back(run)


def candidates(prefixes: DataFrame, similarity: float, most_rows: int, slices: int = 1) -> DataFrame:
    """Pairs (a, b) of (node, label, PREFIX) of different labels that can be alike: no alike pair is missed.

    Prefixes meet a slice of all hashes at a time, so their rows are on disk a slice at a time. A bucket of more than
    `most_rows` is dealt into cells in which every two of different labels meet.
    """
    found = []
    for k in range(slices):
        rows = prefixes.select("node", "n", "label", F.posexplode("prefix").alias("place", "key")).filter(F.pmod("key", F.lit(slices)) == k)
        # A hash that one label alone has brings nothing together.
        shared = written(rows.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least <> most").select("key"), "shared")
        rows = written(rows.join(shared, "key"), "met")
        cells = dealt(rows, most_rows).join(prefixes.select("node", *MAP), "node")
        cells = sorted_by(cells, "key", "cell", "other").select("key", "cell", "other", "side", "node", "n", "place", "label", *MAP)
        found.append(written(cells.mapInArrow(_pair_batches(similarity), "a bigint, b bigint").distinct(), "pairs"))
        dropped(shared, rows)
    pairs = found[0] if slices == 1 else written(reduce(DataFrame.unionByName, found).distinct(), "pairs")
    left, right = (prefixes.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.col("wide").alias(f"wide_{end}")) for end in "ab")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", F.col("n_a").cast("bigint"), F.col("n_b").cast("bigint"), "wide_a", "wide_b")
    return written(both.mapInArrow(_apart_batches(similarity), "a bigint, b bigint"), "pairs")


def alike_links(sets: DataFrame, labels: DataFrame, similarity: float, most_rows: int) -> DataFrame:
    """Links (a, b) between all nodes of (node, hashes) that are alike and have different labels (else their own)."""
    common = sets.sparkSession.sparkContext.broadcast(common_hashes(counted_rows(sets, "node", sets.count())))
    prefixes = sets.select("node", "hashes").mapInArrow(_prefix_batches(similarity, common), f"node bigint, {PREFIX_SCHEMA}")
    prefixes = written(labelled(prefixes, labels), "prefixes")
    pairs = candidates(prefixes, similarity, most_rows)
    dropped(prefixes)
    return written(confirmed(pairs, sets, similarity), "alike")
