"""Benchmark decontamination by winnowing: the least k-gram hash of each sliding window is kept as a
fingerprint on both sides, fingerprints meet, and each hit is extended to whole windows of words.

Every span of GRAM + WINDOW - 1 = 10 common words holds WINDOW common k-grams, whose least hash both sides
keep, so no shared span of that length is missed. Items shorter than a window are met by their whole
sequence, a window of one k-gram.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, given_back, mixed, pieces, powers, sliding_min, utf8, written

SPAN = 10
GRAM = 5
WINDOW = SPAN - GRAM + 1
#: Benchmark windows that are sent to every task; those of a larger benchmark are joined.
BLOCK_WINDOWS = 200_000
#: Bits of the sieve that goes before that join (8 MB), a power of two.
SIEVE_BITS = 1 << 26

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LOWER[np.r_[0:0x30, 0x3A:0x41, 0x5B:0x61, 0x7B:0x80]] = 0
_ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64))
_IN_WORD, _IN_GRAM = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F

HIT_SCHEMA = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(_ASCII))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, and for each text the number of words before it."""
    low = _LOWER[data]
    is_word = low != 0
    begins = is_word.copy()
    begins[1:] &= ~is_word[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    begins[inner] = is_word[inner]
    starts = np.flatnonzero(begins)
    before = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), before
    at = np.flatnonzero(is_word)
    first = np.searchsorted(at, starts)
    place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    parts = _BYTE[low[at]] * powers(_IN_WORD, int(place.max()) + 1)[place]
    return mixed(np.add.reduceat(parts, first)), before


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k, p in enumerate(powers(_IN_GRAM, n)):
        out += words[k : k + len(out)] * p
    return mixed(out)


def winnowed(grams: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """True for the k-grams whose hash is the least of a window of `width` that holds them."""
    keep = np.zeros(len(grams), bool)
    if len(grams) >= width:
        least = sliding_min(grams, width)
        for k in range(width):
            keep[k : k + len(least)] |= grams[k : k + len(least)] == least
    return keep


@dataclass
class Block:
    """Fingerprints and windows of a block of items. lengths: window lengths below SPAN that occur."""

    ids: list[str]
    prints: np.ndarray
    grams: dict[int, dict[str, list[int]]]
    hashes: dict[int, np.ndarray]


def blocks_of(items: list[tuple[str, str]]) -> Iterator[Block]:
    """The block of all items that have words, if any has."""
    held = [(item_id, words) for item_id, text in items if (words := words_of(text))]
    if held:
        yield _block(held)


def _block(items: list[tuple[str, list[str]]]) -> Block:
    grams: dict[int, dict[str, list[int]]] = {}
    prints, hashes = [], {}
    for k, (_, words) in enumerate(items):
        n = min(SPAN, len(words))
        for i in range(len(words) - n + 1):
            own = grams.setdefault(n, {}).setdefault(" ".join(words[i : i + n]), [])
            if not own or own[-1] != k:
                own.append(k)
        data = np.frombuffer(" ".join(words).encode(), np.uint8)
        hashed, _ = word_hashes(data, np.array([0, len(data)]))
        if n == SPAN:
            five = gram_hashes(hashed, GRAM)
            prints.append(five[winnowed(five)])
        else:
            hashes.setdefault(n, []).append(gram_hashes(hashed, n))
    return Block([i for i, _ in items], np.unique(np.concatenate(prints)) if prints else np.zeros(0, np.uint64), grams, {n: np.unique(np.concatenate(h)) for n, h in hashes.items()})


def _among(x: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(x), bool)
    at = np.searchsorted(sorted_set, x)
    at[at == len(sorted_set)] = 0
    return sorted_set[at] == x


def _candidates(words: np.ndarray, block: Block) -> dict[int, np.ndarray]:
    """For each window length the word positions where a window may begin."""
    out = {}
    if SPAN in block.grams:
        five = gram_hashes(words, GRAM)
        hits = np.flatnonzero(winnowed(five) & _among(five, block.prints))
        if len(hits):
            begin = np.unique((hits[:, None] - np.arange(WINDOW)[None, :]).ravel())
            out[SPAN] = begin[(begin >= 0) & (begin <= len(words) - SPAN)]
    for n, own in block.hashes.items():
        out[n] = np.flatnonzero(_among(gram_hashes(words, n), own))
    return {n: at for n, at in out.items() if len(at)}


def hits_of(text: str, words: np.ndarray, block: Block) -> tuple[set[int], set[int]]:
    """Word positions inside windows that occur, and the items that have these windows."""
    found = _candidates(words, block)
    if not found:
        return set(), set()
    own, hit, items = words_of(text), set(), set()
    for n, begins in found.items():
        for i in begins.tolist():
            has = block.grams[n].get(" ".join(own[i : i + n]))
            if has:
                hit.update(range(i, i + n))
                items.update(has)
    return hit, items


def _digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _scan(block):
    """Full rows of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = block.value
        for batch in batches:
            out = []
            for k, mine in _word_hashes(batch.column(1)):
                hit, found = hits_of(batch.column(1)[k].as_py(), mine, held) if len(mine) else (set(), set())
                ids = sorted({held.ids[x] for x in found})
                out.append((batch.column(0)[k].as_py(), len(mine), len(hit), len(ids), _digest(ids), bool(hit)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(_FULL.types)], schema=_FULL)

    return run


def _clean(block):
    """Rows whose last column, a text, has no window of the block; without that column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = block.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            good = [not (len(mine) and hits_of(texts[k].as_py(), mine, held)[0]) for k, mine in _word_hashes(texts)]
            yield batch.filter(pa.array(good, pa.bool_())).drop_columns([batch.schema.names[-1]])

    return given_back(run)


def _word_hashes(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, hashes of its words), a bounded amount of text at a time."""
    data, offsets = utf8(column)
    for a, b in pieces(offsets):
        at = offsets[a : b + 1]
        words, before = word_hashes(data[at[0] : at[-1]], at - at[0])
        for k in range(b - a):
            yield a + k, words[before[k] : before[k + 1]]


_FULL = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])
_GRAMS = pa.schema([("item_id", pa.string()), ("print", pa.int64()), ("n", pa.int32()), ("gram", pa.string())])
_MET = pa.schema([("doc_id", pa.int64()), ("text_md5", pa.string()), ("print", pa.int64()), ("n", pa.int32()), ("gram", pa.string()), ("place", pa.int32())])


def _print_of(words: np.ndarray, begins: np.ndarray, n: int) -> np.ndarray:
    """The fingerprint by which the window of n words from each place on is met: its least five-word hash, or of all words."""
    if n < SPAN:
        return gram_hashes(words, n)[begins]
    return sliding_min(gram_hashes(words, GRAM), WINDOW)[begins]


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of every item with its fingerprint."""
    for batch in batches:
        out = []
        for k, mine in _word_hashes(batch.column(1)):
            if len(mine):
                n, own = min(SPAN, len(mine)), words_of(batch.column(1)[k].as_py())
                prints = _print_of(mine, np.arange(len(mine) - n + 1), n).view(np.int64).tolist()
                out += [(batch.column(0)[k].as_py(), p, n, " ".join(own[i : i + n])) for i, p in enumerate(prints)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(_GRAMS.types)], schema=_GRAMS)


def _document_windows(sieve):
    """Windows of documents whose fingerprint the sieve lets through: what it keeps back, no item has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, lengths = sieve.value
        for batch in batches:
            out = []
            for k, mine in _word_hashes(batch.column(1)):
                own, digest = None, None
                for n in lengths:
                    if len(mine) < n:
                        continue
                    prints = _print_of(mine, np.arange(len(mine) - n + 1), n)
                    at = (prints & np.uint64(SIEVE_BITS - 1)).astype(np.int64)
                    for i in np.flatnonzero(bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).tolist():
                        if own is None:
                            text = batch.column(1)[k].as_py()
                            own, digest = words_of(text), hashlib.md5(text.encode()).hexdigest()
                        out.append((batch.column(0)[k].as_py(), digest, int(prints[i].astype(np.int64)), n, " ".join(own[i : i + n]), i))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(_MET.types)], schema=_MET)

    return run


def sieve_of(windows: DataFrame) -> tuple[np.ndarray, list[int]]:
    """A bit for the low bits of every fingerprint, SIEVE_BITS in all however many there are, and the lengths of windows."""
    low = F.col("print").bitwiseAND(F.lit(SIEVE_BITS - 1))
    rows = windows.select(F.shiftright(low, 6).alias("word"), F.expr("shiftleft(1L, cast(print & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    bits = np.zeros(SIEVE_BITS // 64, np.uint64)
    bits[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return bits, sorted(r[0] for r in windows.select("n").distinct().collect())


def joined_hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text_md5, hit, items) of documents that hold windows of items, by a join on fingerprints.

    Only windows that the sieve lets through are shuffled, with their words, which are compared where
    fingerprints meet. A window in many items meets each document once; its items are joined to what was hit.
    """
    spark = docs.sparkSession
    windows = written(items.mapInArrow(_item_windows, "item_id string, print bigint, n int, gram string").distinct(), "windows")
    sieve = spark.sparkContext.broadcast(sieve_of(windows))
    met = docs.mapInArrow(_document_windows(sieve), "doc_id bigint, text_md5 string, print bigint, n int, gram string, place int")
    key = ["print", "n", "gram"]
    met = written(met.distinct().join(windows.select(*key).distinct(), key), "met")
    document = ["doc_id", "text_md5"]
    hit = met.select(*document, F.explode(F.sequence(F.col("place"), F.col("place") + F.col("n") - 1)).alias("at")).distinct().groupBy(*document).agg(F.count("*").alias("n_hit"))
    of_items = met.select(*document, *key).distinct().join(windows, key).select(*document, "item_id").distinct()
    of_items = of_items.groupBy(*document).agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    same = [F.col(f"h.{c}").eqNullSafe(F.col(f"i.{c}")) for c in document]
    return hit.alias("h").join(of_items.alias("i"), same[0] & same[1]).select("h.doc_id", "h.text_md5", "n_hit", "items")


def _inputs(documents: DataFrame, benchmark: DataFrame, block_windows: int) -> tuple[DataFrame, DataFrame, Block | None]:
    """Documents, items, and the one block of all items, if it has at most `block_windows` windows."""
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_count(lowered, F.lit(WORD.pattern))
    held = items.agg(F.sum(F.when(words > 0, F.greatest(F.lit(1), words - SPAN + 1))), F.sum(F.octet_length("text"))).first()
    # Windows bound what is sent to every task, and bytes what the driver reads.
    if (held[0] or 0) > block_windows or (held[1] or 0) > 64 * BLOCK_WINDOWS:
        return docs, items, None
    return docs, items, next(blocks_of([tuple(r) for r in items.filter(words > 0).collect()]), Block([], np.zeros(0, np.uint64), {}, {}))


def decontaminate(documents: DataFrame, benchmark: DataFrame, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Overlap of each document with the benchmark's windows of ten words.

    A benchmark of at most `block_windows` windows goes to every task with its fingerprints, and documents are
    met in a single scan. The windows of a larger one are joined to those of documents by fingerprint; a sieve
    of fixed size keeps back what no item has before the shuffle. Hits are exact: the words of a candidate
    window are compared.

    Null or empty text: no words, not contaminated. An item without words has no windows; a null item_id
    is written `null`; repeated item ids count once; repeated documents each have their row. Empty tables
    give no rows or no hits. Other columns of either table are ignored.
    """
    docs, items, block = _inputs(documents, benchmark, block_windows)
    if block is not None:
        return docs.mapInArrow(_scan(docs.sparkSession.sparkContext.broadcast(block)), HIT_SCHEMA)
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sized = docs.select("doc_id", F.md5("text").alias("text_md5"), F.regexp_count(lowered, F.lit(WORD.pattern)).cast("bigint").alias("n_words"))
    joined = sized.alias("d").join(joined_hits(docs, items).alias("u"), F.col("d.doc_id").eqNullSafe(F.col("u.doc_id")) & (F.col("d.text_md5") == F.col("u.text_md5")), "left")
    found = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        F.col("d.doc_id").alias("doc_id"),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.size(found).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(found, ","), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def clean_documents(documents: DataFrame, benchmark: DataFrame, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """documents without the rows that hold a benchmark window; all their columns stay, and rows are not moved.

    Rows are judged by their own text, whatever other rows have their doc_id. Null and empty texts stay.
    Empty tables: nothing goes.
    """
    docs, items, block = _inputs(documents, benchmark, block_windows)
    if block is not None:
        return documents.withColumn(free_name(documents, "judged"), F.col("text").cast("string")).mapInArrow(_clean(docs.sparkSession.sparkContext.broadcast(block)), documents.schema)
    bad = joined_hits(docs, items).select(F.col("doc_id").alias("__bad"), "text_md5")
    same = documents["doc_id"].cast("bigint").eqNullSafe(bad["__bad"]) & (F.md5(F.coalesce(documents["text"].cast("string"), F.lit(""))) == bad["text_md5"])
    return documents.join(bad, same, "left_anti")
