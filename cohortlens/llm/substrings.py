"""Exact substring dedup over suffixes sorted deep-shallow.

A byte goes if a string of SPAN bytes that covers it also starts in a document with a smaller id.

Suffixes that could share SPAN bytes are brought together without shuffling each of them: every window of
SPAN bytes holds one anchor, the ANCHOR-byte gram of least hash (the leftmost of equals). Windows with one
anchor in a row form a stretch of at most 2 * SPAN - ANCHOR bytes; equal windows have equal anchors, at the
same place. Documents are dealt into blocks; a block sends each different stretch once, however often it
holds it, to the bucket of its anchor. There the suffixes of stretches that can agree are sorted, multikey
by words of eight bytes to a shallow depth and by blind tries from there on, the least document of each
string is found, and the block is told which windows of its stretch start in an earlier document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, sliding_min, utf8

SPAN = 50
ANCHOR = 12
REACH = SPAN - ANCHOR
WIDE = SPAN + REACH
#: Bytes of text in a block and in a bucket's share of the text.
BLOCK_BYTES = 6 << 20
SLICE_BYTES = 1 << 20
STRETCHES_AT_ONCE = 1 << 17
SHALLOW_WORDS = 2
SUFFIXES_AT_ONCE = 200_000
NULL_ID = -(1 << 63)

SCHEMA = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
_SEND = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("payload", pa.binary())])
_ANSWER = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("payload", pa.binary())])
_FACTORS = mixed(np.arange(1, 17, dtype=np.uint64)) | np.uint64(1)
_COLUMNS = np.arange(WIDE, dtype=np.int16)
_STRETCH = np.dtype([("bytes", "u1", (WIDE,)), ("first", "u1"), ("last", "u1"), ("owner", "<i8")])
_RUN = np.dtype([("place", "<u4"), ("first", "u1"), ("last", "u1")])


def _packed(x: np.ndarray) -> bytes:
    """An array of records, field by field, compressed."""
    return zstandard.ZstdCompressor(level=6).compress(b"".join(np.ascontiguousarray(x[f]).tobytes() for f in x.dtype.names))


def _unpacked(payload: bytes, kind: np.dtype) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    out, at = np.empty(len(raw) // kind.itemsize, kind), 0
    for f in kind.names:
        size = kind[f].itemsize * len(out)
        out[f] = np.frombuffer(raw, kind[f].base, count=size // kind[f].base.itemsize, offset=at).reshape(out[f].shape)
        at += size
    return out


def hash_rows(words: np.ndarray) -> np.ndarray:
    """A hash of each row of 64-bit words."""
    out = np.zeros(len(words), np.uint64)
    for k in range(words.shape[1]):
        out = (out ^ mixed(words[:, k] + _FACTORS[k])) * _FACTORS[k]
    return out


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number (zeros follow the end)."""
    padded = np.zeros(len(data) // 8 * 8 + 24, np.uint8)
    padded[: len(data)] = data
    out = np.empty(len(data), np.uint64)
    for k in range(min(8, len(data))):
        part = padded[k:]
        part = part[: len(part) // 8 * 8].view("<u8")
        out[k::8] = part[: len(out[k::8])]
    return out


def stretches(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window and anchor of each stretch, for texts that end at `ends`."""
    if len(data) < SPAN:
        none = np.zeros(0, np.int64)
        return none, none, none
    eight = words_at(data)
    grams = mixed(eight[:-4] * _FACTORS[0] + eight[4:] * _FACTORS[1])[: len(data) - ANCHOR + 1]
    place = np.uint64((1 << 24) - 1)
    grams = (grams & ~place) | np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_min(grams, REACH + 1) & place).astype(np.int64)
    whole = np.ones(len(anchor), bool)
    begin = 0
    for end in ends.tolist():
        whole[max(begin, end - SPAN + 1) : end] = False
        begin = end
    new = whole.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~whole[:-1]
    old = whole.copy()
    old[:-1] &= (anchor[1:] != anchor[:-1]) | ~whole[1:]
    first, last = np.flatnonzero(new), np.flatnonzero(old)
    return first, last, anchor[first]


def cut_out(data: np.ndarray, first: np.ndarray, last: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of each stretch with its anchor at REACH, zero outside, and the places of its first and last window."""
    padded = np.zeros(len(data) + WIDE, np.uint8)
    padded[REACH : REACH + len(data)] = data
    rows = np.lib.stride_tricks.sliding_window_view(padded, WIDE)[anchor]
    lo, hi = first - anchor + REACH, last - anchor + REACH
    rows *= (_COLUMNS >= lo[:, None]) & (_COLUMNS < hi[:, None] + SPAN)
    return rows, lo.astype(np.uint8), hi.astype(np.uint8)


def alike(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each different row the first place, and for each row the number of its kind."""
    words = np.ascontiguousarray(rows).view("<u8")
    key = hash_rows(words)
    order = np.argsort(key, kind="stable")
    new = np.r_[True, key[order[1:]] != key[order[:-1]]] if len(order) else np.zeros(0, bool)
    kind = np.empty(len(rows), np.int64)
    kind[order] = np.cumsum(new) - 1
    first = order[new]
    if not all(np.array_equal(words[:, k], words[first, k][kind]) for k in range(words.shape[1])):  # two rows with one hash
        order = np.lexsort(words.T)
        new = np.r_[True, (words[order[1:]] != words[order[:-1]]).any(axis=1)]
        kind[order] = np.cumsum(new) - 1
        first = order[new]
    return first, kind


def equal_strings(text: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Deep-shallow sort of strings (rows of SPAN bytes) within groups; numbers the different strings in sorted order.

    Shallow: each group is sorted by its next word of eight bytes and split where the word changes. Deep: a
    group that still agrees is put in a blind trie: its members branch off the path of its first member at
    their common prefix, by the byte that follows, and each branch is a group of the next round.
    """
    n = len(text)
    order, group = np.arange(n), group.copy()
    open_rows = order
    for k in range(SHALLOW_WORDS):
        word = np.ascontiguousarray(text[open_rows, 8 * k : 8 * k + 8]).view(">u8").ravel().astype(np.uint64)
        group = _refined(open_rows, group, (word,))
        open_rows = _open(open_rows, group)
    done = np.zeros(n, bool)
    while len(open_rows):
        by = open_rows[np.argsort(group[open_rows], kind="stable")]
        heads = np.flatnonzero(np.r_[True, group[by[1:]] != group[by[:-1]]])
        lead = np.repeat(by[heads], np.diff(np.r_[heads, len(by)]))
        own, path = text[by, 8 * SHALLOW_WORDS :], text[lead, 8 * SHALLOW_WORDS :]
        differs = own != path
        common = np.where(differs.any(axis=1), differs.argmax(axis=1), SPAN)
        at = np.minimum(common, own.shape[1] - 1)
        rows = np.arange(len(by))
        branch = np.where(common == SPAN, 0, own[rows, at].astype(np.int64))
        below = own[rows, at] < path[rows, at]
        side = np.where(common == SPAN, SPAN, np.where(below, common, 2 * SPAN - common))
        group = _refined(by, group, (branch.astype(np.uint64), side.astype(np.uint64)))
        done[by[common == SPAN]] = True
        open_rows = _open(by[~done[by]], group)
    return group


def _refined(rows: np.ndarray, group: np.ndarray, keys: tuple[np.ndarray, ...]) -> np.ndarray:
    """Group numbers after each group of `rows` is sorted and split by keys (the last one first)."""
    order = np.lexsort((*keys, group[rows]))
    own = group[rows][order]
    new = np.r_[True, own[1:] != own[:-1]]
    split = new.copy()
    for key in keys:
        split[1:] |= key[order][1:] != key[order][:-1]
    # Parts after the first get numbers of their own, in order, above their group's number.
    more = split & ~new
    out = group.copy()
    if more.any():
        shift = np.zeros(int(group.max()) + 2, np.int64)
        np.add.at(shift, own[more] + 1, 1)
        shift = np.cumsum(shift)[:-1]
        out = group + shift[group]
        within = np.cumsum(more) - np.repeat((np.cumsum(more) - more)[new], np.diff(np.r_[np.flatnonzero(new), len(own)]))
        out[rows[order]] += within
    return out


def _open(rows: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The rows whose group has others."""
    if not len(rows):
        return rows
    return rows[np.bincount(group[rows])[group[rows]] > 1]


def owners_of(rows: np.ndarray, lo: np.ndarray, hi: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Least owner of each window: one row per stretch, one column per window place (others: its own owner)."""
    out = np.repeat(owner[:, None], REACH + 1, axis=1)
    anchor = hash_rows(np.ascontiguousarray(np.pad(rows[:, REACH:SPAN], ((0, 0), (0, 4)))).view("<u8"))
    _, kin = np.unique(anchor, return_inverse=True)
    shared = np.flatnonzero(np.bincount(kin)[kin] > 1)
    shared = shared[np.argsort(kin[shared], kind="stable")]
    windows = np.cumsum(hi[shared].astype(np.int64) - lo[shared] + 1)
    at = 0
    while at < len(shared):
        end = int(np.searchsorted(windows, (windows[at - 1] if at else 0) + SUFFIXES_AT_ONCE, side="right"))
        end = max(end, at + 1)
        while end < len(shared) and kin[shared[end]] == kin[shared[end - 1]]:
            end += 1
        part = shared[at:end]
        count = hi[part].astype(np.int64) - lo[part] + 1
        which = np.repeat(part, count)
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo[part], count)
        text = np.lib.stride_tricks.sliding_window_view(rows, SPAN, axis=1)[which, place]
        _, start = np.unique(kin[which] * (REACH + 1) + place, return_inverse=True)
        string = equal_strings(text, start)
        least = np.full(int(string.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, string, owner[which])
        out[which, place] = least[string]
        at = end
    return out


def _repeats(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    out = np.zeros(len(key), bool)
    out[order] = np.r_[same, False] | np.r_[False, same] if len(key) else False
    return out


def _bucket(table: pa.Table) -> pa.Table:
    """Answers to all blocks that sent stretches to one bucket."""
    block = table["block"].to_numpy()
    got = [_unpacked(x.as_py(), _STRETCH) for x in table["payload"]]
    home = np.repeat(np.arange(len(block)), [len(x) for x in got])
    place = np.concatenate([np.arange(len(x)) for x in got])
    all_rows = np.concatenate(got)
    del got
    # A common window holds the anchor and half its reach to the right or to the left, which must agree too.
    half = REACH // 2
    right, left = np.zeros((len(all_rows), 32), np.uint8), np.zeros((len(all_rows), 32), np.uint8)
    right[:, :31] = all_rows["bytes"][:, REACH : REACH + 31]
    left[:, :31] = all_rows["bytes"][:, SPAN - 31 : SPAN]
    can = np.zeros(len(all_rows), bool)
    for part, has in ((right, all_rows["last"] >= half), (left, all_rows["first"] <= half)):
        places = np.flatnonzero(has)
        can[places] |= _repeats(hash_rows(part[places].view("<u8")))
    del right, left
    keep = np.flatnonzero(can)
    all_rows, home, place = all_rows[keep], home[keep], place[keep]
    if not len(all_rows):
        return _ANSWER.empty_table()
    first, kind = alike(all_rows["bytes"])
    owner = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(owner, kind, all_rows["owner"])
    lo, hi = all_rows["first"][first], all_rows["last"][first]
    least = owners_of(all_rows["bytes"][first], lo, hi, owner)
    out_block, out_payload = [], []
    for k in np.unique(home):
        own = all_rows[home == k]
        rows = least[kind[home == k]]
        earlier = rows < own["owner"][:, None]
        columns = np.arange(REACH + 1)
        earlier &= (columns >= own["first"][:, None]) & (columns <= own["last"][:, None])
        edge = np.zeros((len(own), REACH + 3), np.int8)
        edge[:, 1:-1] = earlier
        step = np.diff(edge, axis=1)
        i, a = np.nonzero(step == 1)
        _, b = np.nonzero(step == -1)
        if len(i):
            runs = np.empty(len(i), _RUN)
            runs["place"], runs["first"], runs["last"] = place[home == k][i], a, b - 1
            out_block.append(int(block[k]))
            out_payload.append(_packed(runs))
    bucket = pa.array([table["bucket"][0].as_py()] * len(out_block), pa.int64())
    return pa.Table.from_arrays([pa.array(out_block, pa.int64()), bucket, pa.array(out_payload, pa.binary())], schema=_ANSWER)


def _alike_stretches(rows: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As alike, by bytes and places of windows (zeros alone do not tell them), numbered as kinds first occur."""
    lead, kind = alike(np.concatenate([rows, lo[:, None].astype(np.uint8), hi[:, None].astype(np.uint8), np.zeros((len(rows), 6), np.uint8)], axis=1))
    order = np.argsort(lead)
    number = np.empty(len(lead), np.int64)
    number[order] = np.arange(len(lead))
    return lead[order], number[kind]


class Block:
    """Documents of a block in the order of their ids, with their stretches. Both passes build it alike."""

    def __init__(self, table: pa.Table):
        order = pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("text", "ascending")], null_placement="at_start")
        self.ids = table["doc_id"].take(order).combine_chunks()
        self.data, self.offsets = utf8(table["text"].take(order))
        self.rank = pc.fill_null(self.ids, NULL_ID).to_numpy(zero_copy_only=False)
        parts: list[tuple] = []
        seen = 0
        for docs, begin, end in self._slices():
            ends = self.offsets[docs + 1] - begin if len(docs) > 1 else np.array([end - begin])
            s0, s1, anchor = stretches(self.data[begin:end], ends)
            # A run of one byte has a stretch at every place, all alike: of a slice, only different ones are held.
            for k in range(0, len(s0), STRETCHES_AT_ONCE):
                x, y = s0[k : k + STRETCHES_AT_ONCE], s1[k : k + STRETCHES_AT_ONCE]
                own, a, b = cut_out(self.data[begin:end], x, y, anchor[k : k + STRETCHES_AT_ONCE])
                lead, kind = _alike_stretches(own, a, b)
                parts.append((own[lead], a[lead], b[lead], kind + seen, docs[np.searchsorted(ends, x, side="right")], x + begin, (y - x).astype(np.uint8)))
                seen += len(lead)
        rows, lo, hi, kind, self.doc, self.first, self.span = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros((0, WIDE), np.uint8), *[np.zeros(0, np.int64)] * 6)
        # Kinds are numbered as they first occur: a payload in this order packs well and needs no numbers.
        lead, over = _alike_stretches(rows, lo, hi)
        self.kind = over[kind] if len(kind) else kind
        self.rows, self.lo, self.hi = rows[lead], lo[lead], hi[lead]
        # The first stretch of each kind in the order of documents.
        self.lead = np.full(len(lead), len(self.kind))
        np.minimum.at(self.lead, self.kind, np.arange(len(self.kind)))

    def dealt(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Kinds in the order they are sent, and the bucket of each of these."""
        anchor = hash_rows(np.ascontiguousarray(np.pad(self.rows[:, REACH:SPAN], ((0, 0), (0, 4)))).view("<u8"))
        to = (mixed(anchor) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        return order, to[order]

    def _slices(self) -> Iterator[tuple[np.ndarray, int, int]]:
        """Runs of texts; a text longer than a slice is cut so that each window lies in one slice."""
        first, n = 0, len(self.offsets) - 1
        while first < n:
            last = int(np.searchsorted(self.offsets, self.offsets[first] + SLICE_BYTES, side="right")) - 1
            if last > first:
                yield np.arange(first, last), int(self.offsets[first]), int(self.offsets[last])
                first = last
                continue
            begin, end = int(self.offsets[first]), int(self.offsets[first + 1])
            while begin + SPAN <= end:
                yield np.array([first]), begin, min(end, begin + SLICE_BYTES)
                begin += SLICE_BYTES - SPAN + 1
            first += 1


def _send(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        number = table["block"][0].as_py()
        block = Block(table)
        order, to = block.dealt(buckets)
        out = np.empty(len(order), _STRETCH)
        out["bytes"], out["first"], out["last"] = block.rows[order], block.lo[order], block.hi[order]
        out["owner"] = block.rank[block.doc[block.lead[order]]]
        starts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.zeros(0, np.int64)
        parts = [out[x:y] for x, y in zip(starts, [*starts[1:], len(to)], strict=True)]
        return pa.Table.from_arrays([pa.array(to[starts], pa.int64()), pa.array([number] * len(parts), pa.int64()), pa.array([_packed(x) for x in parts], pa.binary())], schema=_SEND)

    return run


def _remove(buckets: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        return _without(docs, answers, buckets)

    return run


def _without(docs: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    """The documents of a block without the bytes of windows that start in an earlier document."""
    if not len(docs):
        return _OUT.empty_table()
    block = Block(docs)
    begin, end = [], []
    # Windows of a stretch that an earlier document of this block has too.
    later = block.rank[block.doc[block.lead]][block.kind] < block.rank[block.doc] if len(block.kind) else np.zeros(0, bool)
    begin.append(block.first[later])
    end.append(block.first[later] + block.span[later] + SPAN)
    if len(answers):
        order, to = block.dealt(buckets)
        got = [(b.as_py(), _unpacked(x.as_py(), _RUN)) for b, x in zip(answers["bucket"], answers["payload"], strict=True)]
        kinds = np.concatenate([order[np.searchsorted(to, b) + x["place"]] for b, x in got])
        by = np.argsort(kinds, kind="stable")
        runs, kinds = np.concatenate([x for _, x in got])[by], kinds[by]
        rest = np.flatnonzero(~later)
        a, b = np.searchsorted(kinds, block.kind[rest]), np.searchsorted(kinds, block.kind[rest], side="right")
        count = b - a
        which = np.repeat(rest, count)
        of = runs[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(a, count)]
        base = block.first[which] - block.lo[block.kind[which]]
        begin.append(base + of["first"])
        end.append(base + of["last"] + SPAN)
    size = len(block.data)
    depth = np.bincount(np.concatenate(begin), minlength=size + 1) - np.bincount(np.concatenate(end), minlength=size + 1)
    gone = np.cumsum(depth[:size]) > 0
    heads = gone.copy()
    heads[1:] &= ~gone[:-1]
    at = block.offsets[:-1][block.offsets[:-1] < size]
    heads[at] = gone[at]
    total, spans = np.r_[0, np.cumsum(gone)], np.r_[0, np.cumsum(heads)]
    lo, hi = block.offsets[:-1], block.offsets[1:]
    kept = [hashlib.sha256(block.data[x:y][~gone[x:y]].tobytes()).hexdigest() for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]
    return pa.Table.from_arrays([block.ids, pa.array(hi - lo), pa.array(total[hi] - total[lo]), pa.array(spans[hi] - spans[lo]), pa.array(kept, pa.string())], schema=_OUT)


def dedup_substrings(documents: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): each text without the strings of 50 bytes of earlier documents.

    Text is shuffled once, by block; a block and a bucket hold a fixed amount of text each, and their number
    follows the input. A string in a third of all documents reaches its bucket once per block.

    Null and empty texts have no bytes; texts under 50 bytes lose nothing. Matches never cross documents. A
    null doc_id comes before all others; rows with one doc_id are no earlier than each other. Removal may
    cut a UTF-8 sequence: bytes are judged, not characters. Empty table: no rows. Other columns are ignored.
    """
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = documents.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    count = max(1, -(-size // block_bytes))
    dealt = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(count)).alias("block"), "doc_id", "text")
    sent = dealt.groupBy("block").applyInArrow(_send(count), "bucket bigint, block bigint, payload binary")
    answers = sent.groupBy("bucket").applyInArrow(_bucket, "block bigint, bucket bigint, payload binary")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_remove(count), SCHEMA)
