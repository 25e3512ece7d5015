"""Token-ID output: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

The ids of a vocabulary are renumbered by how often they occur, so frequent ones take one byte. A shard
holds the control bytes (two bits per id: its length less one) apart from the data bytes, so both are read
by table lookup. Every shard is a file; Spark's reader of binary files reads them back.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import files_of, given_back, mixed, powers, read_files, shared_dir, written

END_ID = 1
#: Ids in a shard, unless one document alone has more.
SHARD_IDS = 1 << 22
#: Bytes of ids in a range of documents, and how many ranges there are at most; beyond, ranges grow.
PART_BYTES = 16 << 20
MOST_PARTS = 20_000
#: Texts in a batch of this many code points go through the tokenizer together.
BATCH_CHARS = 1 << 20
#: Words that a task remembers before it begins again.
MEMO_WORDS = 600_000
SUFFIX = ".frvb"
MAGIC = b"FRVB\x01\x00\x00\x00"

#: Texts of these characters only are cut into words before the tokenizer sees them: in this range lower
#: case, normal form C and white space are what they are character by character.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-įĲ-ſ]*")
# In lower case. The classes of the tokenizer file's own split pattern, written out for PLAIN, and
# the endings that go with an apostrophe.
LETTERS = re.compile(r"[a-zªµºß-öø-ſ]")
DIGITS = re.compile(r"[0-9²³¹¼½¾]")
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
SPACE, LETTER, DIGIT, OTHER = 0, 1, 2, 3
_KIND = np.array([SPACE if chr(c) in "\t\n\r " else LETTER if LETTERS.match(chr(c)) else DIGIT if DIGITS.match(chr(c)) else OTHER for c in range(0x180)], np.uint8)
_CHAR = mixed(np.arange(1, 0x181, dtype=np.uint64))
_IN_WORD = 0x9E3779B97F4A7C15


def words_in(low: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begin, size and 64-bit hash of each word of a plain text in lower case; the words' code units on end and their places in them.

    Words are runs of letters, single digits and runs of other signs; an apostrophe that begins one takes an
    ending of ENDINGS with it.
    """
    codes = np.frombuffer(low.encode("utf-16-le"), "<u2")
    kind = _KIND[codes]
    starts = kind != SPACE
    starts[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    marks = np.flatnonzero(starts[:-1] & (codes[:-1] == ord("'")) & (kind[1:] == LETTER))
    if len(marks):
        after, then = codes[marks + 1], codes[np.minimum(marks + 2, len(codes) - 1)]
        then = np.where(marks + 2 < len(codes), then, 0)
        taken = np.zeros(len(marks), np.int64)
        for x in ENDINGS:
            taken[(after == ord(x[0])) & ((then == ord(x[1])) if len(x) == 2 else True)] = len(x)
        marks, taken = marks[taken > 0], taken[taken > 0]
        starts[marks + 1] = False
        rest = marks + 1 + taken
        rest = rest[rest < len(codes)]
        starts[rest] |= kind[rest] == LETTER
    first = np.flatnonzero(starts)
    if not len(first):
        return first, first, np.zeros(0, np.uint64), codes[:0], first
    at = np.flatnonzero(kind)
    head = np.searchsorted(at, first)
    size = np.diff(np.append(head, len(at)))
    place = np.arange(len(at)) - np.repeat(head, size)
    units = codes[at]
    return first, size, mixed(np.add.reduceat(_CHAR[units] * powers(_IN_WORD, int(size.max()))[place], head)), units, place


class Numbers:
    """Numbers 0, 1, .. of 64-bit hashes in the order they are added: open addressing, all looked up at once."""

    def __init__(self, bits: int = 16):
        self.count = 0
        self._make(bits)

    def _make(self, bits: int) -> None:
        self.shift = np.uint64(64 - bits)
        self.most = (1 << bits) - 1
        self.held, self.number = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 where it has none."""
        at = (hashes >> self.shift).astype(np.int64)
        out = np.where(self.held[at] == hashes, self.number[at], -1)
        left = np.flatnonzero((out < 0) & (self.number[at] >= 0))
        at = at[left]
        while len(left):
            at = (at + 1) & self.most
            own, used = self.held[at] == hashes[left], self.number[at] >= 0
            out[left[own & used]] = self.number[at[own & used]]
            go = used & ~own
            left, at = left[go], at[go]
        return out

    def add(self, hashes: np.ndarray) -> None:
        """New hashes, each once."""
        numbers = np.arange(self.count, self.count + len(hashes), dtype=np.int32)
        self.count += len(hashes)
        if 2 * self.count > self.most:
            old, kept = self.held[self.number >= 0], self.number[self.number >= 0]
            bits = 64 - int(self.shift)
            while 2 * self.count > (1 << bits):
                bits += 1
            self._make(bits + 1)
            hashes, numbers = np.concatenate([old, hashes]), np.concatenate([kept, numbers])
        at = (hashes >> self.shift).astype(np.int64)
        while len(hashes):
            free = self.number[at] < 0
            self.number[at[free]] = numbers[free]
            self.held[at[free]] = hashes[free]
            lost = self.number[at] != numbers  # taken before, or by another of these
            hashes, numbers, at = hashes[lost], numbers[lost], (at[lost] + 1) & self.most


class Lists:
    """Lists of numbers on end, with room to grow."""

    def __init__(self, kind: type):
        self.held, self.ends, self.count = np.zeros(1 << 12, kind), np.zeros(1 << 10, np.int32), 0

    def add(self, values: np.ndarray, sizes: np.ndarray) -> None:
        begin, n = int(self.ends[self.count]), len(sizes)
        while self.count + n + 1 > len(self.ends):
            self.ends = np.append(self.ends, np.zeros_like(self.ends))
        while begin + len(values) > len(self.held):
            self.held = np.append(self.held, np.zeros_like(self.held))
        self.held[begin : begin + len(values)] = values
        self.ends[self.count + 1 : self.count + n + 1] = begin + np.cumsum(sizes)
        self.count += n

    def places(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and size of each list."""
        begin = self.ends[numbers].astype(np.int64)
        return begin, self.ends[numbers + 1] - begin


class Encoder:
    """Ids of whole texts, exactly as the tokenizer gives them.

    Words are found by a hash and then compared, so a word with the hash of another is never taken for it: such
    words are kept by themselves.
    """

    def __init__(self, path: str, by_word: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = by_word
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for t, k in vocabulary.items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.memo, self.others = Numbers(), {}
        self.ids, self.units = Lists(np.uint32), Lists(np.uint16)

    def _learn(self, words: list[str]) -> None:
        """Ids of new words. Words in a row, with spaces between, come back one by one: each has one last piece."""
        ids, sizes = [], []
        for k in range(0, len(words), 2000):
            part = words[k : k + 2000]
            got = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            last = np.flatnonzero(self.ends[got]) + 1
            if len(last) != len(part) or last[-1] != len(got):
                each = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
                got, last = np.concatenate(each), np.cumsum([len(x) for x in each])
            ids.append(got)
            sizes.append(np.diff(last, prepend=0))
        self.ids.add(np.concatenate(ids), np.concatenate(sizes))
        self.units.add(np.frombuffer("".join(words).encode("utf-16-le"), "<u2"), np.array([len(w) for w in words]))

    def _others(self, numbers: np.ndarray, size: np.ndarray, units: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Words, of these code units, that are not those that have their numbers."""
        begin, known = self.units.places(numbers)
        if (known == size).all():
            alike = self.units.held[np.repeat(begin, size) + place] == units
            return np.flatnonzero(~np.logical_and.reduceat(alike, np.cumsum(size) - size)) if not alike.all() else begin[:0]
        whole = known == size
        at = np.where(np.repeat(whole, size), np.repeat(begin, size) + place, 0)
        alike = (self.units.held[at] == units) & np.repeat(whole, size)
        return np.flatnonzero(~np.logical_and.reduceat(alike, np.cumsum(size) - size))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        plain = [k for k, t in enumerate(texts) if self.by_word and "<|" not in t and PLAIN.fullmatch(t)]
        known = set(plain)
        rest = [k for k in range(len(texts)) if k not in known]
        for k, x in zip(rest, self.tokenizer.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = np.array(x.ids, np.uint32)
        if self.memo.count > MEMO_WORDS:
            self._forget()
        if plain:
            low = "\n".join(texts[k] for k in plain).lower()
            ends = np.cumsum([len(texts[k]) + 1 for k in plain])
            first, size, hashes, units, place = words_in(low)
            number = self.memo.find(hashes)
            new = np.flatnonzero(number < 0)
            word = lambda k: low[first[k] : first[k] + size[k]]
            if len(new):
                _, once = np.unique(hashes[new], return_index=True)
                once = new[np.sort(once)]
                self._learn([word(k) for k in once.tolist()])
                self.memo.add(hashes[once])
                number[new] = self.memo.find(hashes[new])
            odd = self._others(number, size, units, place) if len(first) else first
            for k in odd.tolist():
                if (own := word(k)) not in self.others:
                    self._learn([own])
                    self.others[own], self.memo.count = self.memo.count, self.memo.count + 1
                number[k] = self.others[own]
            a, many = self.ids.places(number)
            upto = np.r_[0, np.cumsum(many)]
            ids = self.ids.held[np.arange(upto[-1]) - np.repeat(upto[:-1] - a, many)]
            for k, x in zip(plain, np.split(ids, upto[np.searchsorted(first, ends)][:-1]), strict=True):
                out[k] = x
        return out


def _encode(path: str, by_word: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, by_word)
        for batch in batches:
            first = 0
            while first < len(batch):
                last, chars, texts = first, 0, []
                while last < len(batch) and chars < BATCH_CHARS:
                    texts.append(batch.column(1)[last].as_py() or "")
                    chars += len(texts[-1])
                    last += 1
                ids = [np.append(x, np.uint32(END_ID)).astype("<u4") for x in encoder.encode(texts)]
                small = all(int(x.max()) < 1 << 16 for x in ids)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array([small] * len(ids)), pa.array([(x.astype("<u2") if small else x).tobytes() for x in ids], pa.binary())],
                    names=["doc_id", "small", "ids"],
                )
                first = last

    return given_back(run)


def _ids(small: bool, payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, "<u2" if small else "<u4").astype(np.uint32)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for small, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            got = np.bincount(_ids(small, payload))
            if len(got) > len(total):
                total = np.append(total, np.zeros(len(got) - len(total), np.int64))
            total[: len(got)] += got
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])


def packed(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of numbers below 2 ** 32."""
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = size - 1
    four = codes.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    cells = np.ascontiguousarray(ranks.astype("<u4")).view(np.uint8).reshape(-1, 4)
    return control.tobytes(), cells[np.arange(4) < size[:, None]].tobytes()


#: For each control byte the four lengths; for each length the bits that count.
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
_BITS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint64)


def unpacked(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(size) - size
    held = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint64)
    four = held[at] | held[at + 1] << np.uint64(8) | held[at + 2] << np.uint64(16) | held[at + 3] << np.uint64(24) if n else np.zeros(0, np.uint64)
    return (four & _BITS[size]).astype(np.uint32)


def shard_bytes(doc_ids: list[int | None], parts: list[np.ndarray], rank_of: np.ndarray) -> bytes:
    """A shard: magic, counts, ids of documents with a null mark, lengths of documents, control bytes, data bytes."""
    ranks = rank_of[np.concatenate(parts)]
    control, data = packed(ranks)
    head = struct.pack("<QQQQ", len(parts), len(ranks), len(control), len(data))
    ids = np.array([0 if i is None else i for i in doc_ids], "<i8").tobytes()
    null = np.array([i is None for i in doc_ids], np.uint8).tobytes()
    return MAGIC + head + ids + null + np.array([len(p) for p in parts], "<u4").tobytes() + control + data


def read_shard(payload: bytes, id_of: np.ndarray) -> tuple[list[int | None], list[np.ndarray]]:
    if payload[:8] != MAGIC:
        raise ValueError("not a token shard")
    docs, n, controls, size = struct.unpack_from("<QQQQ", payload, 8)
    at = 40
    ids = np.frombuffer(payload, "<i8", docs, at)
    null = np.frombuffer(payload, np.uint8, docs, at + 8 * docs)
    lengths = np.frombuffer(payload, "<u4", docs, at + 9 * docs)
    at += 13 * docs
    tokens = id_of[unpacked(payload[at : at + controls], payload[at + controls : at + controls + size], n)]
    return [None if z else int(i) for i, z in zip(ids, null, strict=True)], np.split(tokens, np.cumsum(lengths)[:-1])


def _pack(rank_of, shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ids: list = []
        parts: list[np.ndarray] = []
        held, before = 0, 0

        def out():
            columns = [pa.array([x], pa.int64()) for x in (part, before, held)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([shard_bytes(ids, parts, rank_of.value)], pa.binary())], names=["part", "before", "n_ids", "payload"])

        for batch in batches:
            for doc_id, small, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = _ids(small, payload)
                if parts and held + len(own) > shard_ids:
                    yield out()
                    ids, parts, held, before = [], [], 0, before + held
                ids.append(doc_id)
                parts.append(own)
                held += len(own)
        if parts:
            yield out()

    return given_back(run)


def _unpack(id_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, parts = read_shard(payload, id_of.value)
                sizes = np.array([len(p) for p in parts], np.int64)
                crc = [zlib.crc32(np.ascontiguousarray(p.astype("<u4"))) for p in parts]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(start + np.cumsum(sizes) - sizes), pa.array(sizes), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def write_shards(documents: DataFrame, vocabulary: str, by_word: bool, shard_ids: int = SHARD_IDS) -> tuple[DataFrame, np.ndarray]:
    """Shards (part, before, n_ids, payload) of the documents' ids in ascending doc_id order, and the ids by rank.

    `part` numbers ranges of doc_ids in their order, `before` counts the ids of earlier shards of the part.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    encoded = written(docs.mapInArrow(_encode(vocabulary, by_word), "doc_id bigint, small boolean, ids binary"), "ids", compression="zstd")
    counted = encoded.select("small", "ids").mapInArrow(_count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    # As many rows as the vocabulary has ids at most.
    ranked = np.array([r[0] for r in sorted(counted.collect(), key=lambda r: (-r[1], r[0]))], np.int64)
    rank_of = np.zeros(int(ranked.max()) + 1 if len(ranked) else 1, np.uint32)
    rank_of[ranked] = np.arange(len(ranked), dtype=np.uint32)
    parts = min(MOST_PARTS, (encoded.agg(F.sum(F.length("ids"))).first()[0] or 0) // PART_BYTES + 1)
    order = (F.col("doc_id").asc_nulls_first(), F.xxhash64("ids"))
    ordered = encoded.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    shards = ordered.mapInArrow(_pack(spark.sparkContext.broadcast(rank_of), shard_ids), "part bigint, before bigint, n_ids bigint, payload binary")
    return shards, ranked.astype(np.uint32)


def read_shards(shards: DataFrame, begins: DataFrame, id_of: np.ndarray) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the shards (part, before, payload).

    begins(part, n_ids) has as many rows as there are shards; payloads are not shuffled.
    """
    spark = shards.sparkSession
    # One row per part, MOST_PARTS at most.
    each = begins.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("begin", F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("n"))
    placed = shards.join(F.broadcast(each.select("part", "begin")), "part")
    return placed.select((F.col("begin") + F.col("before")).alias("start"), "payload").mapInArrow(_unpack(spark.sparkContext.broadcast(id_of)), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def save_shards(shards: DataFrame, folder: str) -> DataFrame:
    """Writes every shard to a .frvb file of its own in `folder` (a URI that all machines see): (path, n_bytes, part, before, n_ids)."""
    return files_of(shards, "payload", folder, SUFFIX, ["part", "before", "n_ids"])


def token_output(documents: DataFrame, vocabulary: str, by_word: bool = True, shard_ids: int = SHARD_IDS, folder: str | None = None) -> DataFrame:
    """Encode, write the shards as .frvb files to `folder` (None: a new one in the shared folder), read the files back:
    (doc_id, start, n_tokens, ids_crc32) of every document.

    `vocabulary` is the path of a tokenizers file, there on every machine. `by_word` is for word_bpe_49k.json
    only: words are then looked up and only new ones go through the tokenizer; the ids are the same. Null and
    empty texts have the end id alone. A null doc_id comes first; rows that repeat a doc_id follow each other
    in the order of their ids' hash. Empty table: no rows. Other columns are ignored.
    """
    folder = folder or f"{shared_dir(documents.sparkSession)}/tokens-{uuid.uuid4().hex}"
    shards, id_of = write_shards(documents, vocabulary, by_word, shard_ids)
    files = save_shards(shards, folder)
    return read_shards(read_files(files, folder, SUFFIX).withColumnRenamed("content", "payload"), files.select("part", "n_ids"), id_of)
