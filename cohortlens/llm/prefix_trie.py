"""Prefix trie of conversations by vertical bitmaps.

Conversations are cut into shards by ascending id. A shard's index has a bitset of conversations for each (position,
turn); a node's children are the intersections of its own bitset with the postings of the next position, taken depth
first, and give the node's count, its end list and, as places in the order of the walk, its subtree. The same node in
several shards has the same key, a digest chained over its turns, so counts, children and sums over subtrees are
Spark aggregates of one row per shard and node: a turn that very many conversations share has one row per shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_groups, written

#: Conversations of a shard, turns after which a shard ends sooner, and shards to a task.
SHARD_CONVERSATIONS, SHARD_TURNS, SHARDS_A_TASK = 4096, 200_000, 4
MOST_TASKS = 20_000
#: Nodes whose children are met by broadcast: at most this many, those with more than 1 / HOT of all nodes as children.
HOT = 1000
ROOT = bytes(16)
WORD = r"[^\x20\x09-\x0D]+"


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns) of every conversation, its turns in order as (digest, words)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    # The role's length before it, so that no other role and text make the same bytes.
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(" "), role, text).cast("binary"), 256)
    one = F.struct(F.col("turn").cast("bigint").alias("turn"), F.substring(F.unhex(digest), 1, 16).alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"))
    own = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), one.alias("one")).filter("conv_id is not null")
    held = own.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))  # of one conversation
    return held.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"], t["words"])).alias("turns"))


def rebuilt(turns: DataFrame, modulus: int = 20, most: int = 4) -> DataFrame:
    """Every conversation c after the first h turns of conversation c - c % modulus; h = crc32(c) % most."""
    bases = turns.filter(F.col("conv_id") % modulus == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("first"))
    met = turns.withColumn("base", F.col("conv_id") - F.col("conv_id") % modulus).withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")).join(bases, "base", "left")
    begin = F.when(F.col("first").isNotNull(), F.expr("slice(first, 1, h)")).otherwise(F.expr("slice(turns, 1, 0)"))
    return met.select("conv_id", F.concat(begin, F.expr("slice(turns, h + 1, size(turns))")).alias("turns"))


class Index:
    """The vertical index of one shard: bitsets by (position, turn), and how many conversations go on to a position."""

    def __init__(self, conversations: list[list[bytes]]):
        self.turns = conversations
        self.postings: list[dict[bytes, int]] = []
        for slot, turns in enumerate(conversations):
            bit = 1 << slot
            for position, turn in enumerate(turns):
                if position == len(self.postings):
                    self.postings.append({})
                own = self.postings[position]
                own[turn] = own.get(turn, 0) | bit
        self.longer = []
        for own in self.postings:
            every = 0
            for bits in own.values():
                every |= bits
            self.longer.append(every)

    def children(self, members: int, depth: int) -> Iterator[tuple[bytes, int]]:
        """Next turns of a node's members: each with the members' bitset that its posting leaves, least member first."""
        left = members & self.longer[depth] if depth < len(self.longer) else 0
        while left:
            slot = (left & -left).bit_length() - 1
            turn = self.turns[slot][depth]
            child = members & self.postings[depth][turn]
            yield turn, child
            left &= ~child

    def ends(self, members: int, depth: int) -> int:
        """Members that have no further turn."""
        return members & ~self.longer[depth] if depth < len(self.longer) else members


def slots(bits: int, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little"))


NODE_SCHEMA = "shard bigint, at bigint, upto bigint, node binary, parent binary, depth bigint, conv_id bigint, n_convs bigint, n_children bigint, words bigint, ends binary"


def shard_nodes(shard: int, ids: np.ndarray, turns: list[list[bytes]], words: list[list[int]]) -> pa.RecordBatch:
    """Nodes of one shard in the order of the walk; `upto` is the place after a node's subtree.

    Ends are the ids of the conversations that end there, ascending, each less the one before, as longs.
    """
    index = Index(turns)
    out: list[list] = []
    stack: list[tuple] = [(ROOT, None, 0, (1 << len(turns)) - 1, 0, -1)]
    path: list[int] = []  # places of the open nodes
    while stack:
        node, parent, depth, members, n_words, _ = stack.pop()
        while len(path) > depth:
            out[path.pop()][2] = len(out)
        place = len(out)
        path.append(place)
        low = (members & -members).bit_length() - 1
        n = members.bit_count()
        if n == 1:
            # One conversation: its remaining turns are a chain.
            own = turns[low]
            last = len(own) == depth
            out.append([shard, place, 0, node, parent, depth, int(ids[low]), 1, 0 if last else 1, n_words, np.array([ids[low]], "<i8").tobytes() if last else None])
            if not last:
                stack.append((_key(node, own[depth]), node, depth + 1, members, words[low][depth], 0))
            continue
        kids = [*index.children(members, depth)]
        ends = index.ends(members, depth)
        listed = np.diff(ids[slots(ends, len(ids))], prepend=0).astype("<i8").tobytes() if ends else None
        out.append([shard, place, 0, node, parent, depth, int(ids[low]), n, len(kids), n_words, listed])
        for turn, child in reversed(kids):
            slot = (child & -child).bit_length() - 1
            stack.append((_key(node, turn), node, depth + 1, child, words[slot][depth], 0))
    for place in path:
        out[place][2] = len(out)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 5, pa.binary()]
    names = [c.split()[0] for c in NODE_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def _key(parent: bytes, turn: bytes) -> bytes:
    return hashlib.sha256(parent + turn).digest()[:16]


def _walk(most: int, most_turns: int):
    """Nodes of each shard; rows come sorted by conv_id, a shard is a run of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        ids: list[int] = []
        turns: list[list[bytes]] = []
        words: list[list[int]] = []
        held = 0
        for batch in batches:
            for conv_id, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(conv_id)
                turns.append([t["digest"] for t in own])
                words.append([t["words"] for t in own])
                held += len(own)
                if len(ids) == most or held >= most_turns:
                    yield shard_nodes(first, np.array(ids, np.int64), turns, words)
                    first, ids, turns, words, held = first + 1, [], [], [], 0
        if ids:
            yield shard_nodes(first, np.array(ids, np.int64), turns, words)

    return run


def _end_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's end list; rows come sorted by node and shard, so lists are only ever read on."""
    node, digest, any_ = None, hashlib.sha256(), False

    def made():
        return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([digest.hexdigest()])], names=["node", "ends_sha256"])

    for batch in batches:
        for own, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if own != node:
                if node is not None:
                    yield made()
                node, digest, any_ = own, hashlib.sha256(), False
            ids = np.cumsum(np.frombuffer(ends, "<i8")).tolist()
            digest.update((("," if any_ else "") + ",".join(map(str, ids))).encode())
            any_ = True
    if node is not None:
        yield made()


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over each node's subtree in its shard: a subtree is a run in the order of the walk."""
    for rows in whole_groups(batches, ["shard"], 1 << 16):
        shard = rows["shard"].to_numpy()
        begins = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
        base = np.repeat(begins, np.diff(np.append(begins, len(shard))))
        first, upto = base + rows["at"].to_numpy(), base + rows["upto"].to_numpy()
        out = [rows["node"].combine_chunks()]
        for name in ("leaf", "saved"):
            total = np.append(0, np.cumsum(rows[name].to_numpy()))
            out.append(pa.array(total[upto] - total[first]))
        yield pa.RecordBatch.from_arrays([out[0].chunk(0) if isinstance(out[0], pa.ChunkedArray) else out[0], *out[1:]], names=["node", "n_leaves", "saved_tokens"])


def trie_of(conversations: DataFrame, shard: int = SHARD_CONVERSATIONS, shard_turns: int = SHARD_TURNS, hot: int = HOT) -> DataFrame:
    """Nodes (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of (conv_id, turns).

    conv_ids are unique. A conversation is read whole by one task, of a shard at a time.
    """
    held = written(conversations, "conversations")
    tasks = min(MOST_TASKS, max(1, held.count() // (shard * SHARDS_A_TASK) + 1))
    ordered = held.repartitionByRange(tasks, "conv_id").sortWithinPartitions("conv_id")
    local = written(ordered.mapInArrow(_walk(shard, shard_turns), NODE_SCHEMA), "nodes")

    # Each node once: its least member, its members and whether it ends in a leaf.
    nodes = written(local.groupBy("node").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.max("n_children").alias("some"), F.first("words").alias("words")), "trie")
    # Its words count (n_convs - 1) times: once for each member in each shard, less once in the shard of its least member.
    own = local.select("shard", "at", "upto", "node", F.col("conv_id").alias("low"), F.col("n_convs").alias("n"), "words").join(nodes.select("node", "conv_id", "some"), "node")
    first = F.col("low") == F.col("conv_id")
    valued = own.select("shard", "at", "upto", "node", (first & (F.col("some") == 0)).cast("bigint").alias("leaf"), (F.col("words") * (F.col("n") - first.cast("bigint"))).alias("saved"))
    sums = valued.repartition("shard").sortWithinPartitions("shard", "at").mapInArrow(_subtrees, "node binary, n_leaves bigint, saved_tokens bigint")
    ends = local.filter("ends is not null").select("node", "conv_id", "ends").repartition("node").sortWithinPartitions("node", "conv_id").select("node", "ends").mapInArrow(_end_digests, "node binary, ends_sha256 string")

    # What is known of a node, from everywhere, meets in one aggregate.
    nothing = {"parent": "binary", "depth": "bigint", "conv_id": "bigint", "n_convs": "bigint", "n_children": "bigint", "n_leaves": "bigint", "saved_tokens": "bigint", "ends_sha256": "string"}

    def facts(df: DataFrame, node: str = "node") -> DataFrame:
        return df.select(F.col(node).alias("node"), *[(F.col(c) if c in df.columns and c != node else F.lit(None)).cast(k).alias(c) for c, k in nothing.items()])

    children = nodes.filter("parent is not null").select("parent", F.lit(1).alias("n_children"))
    known = facts(nodes).union(facts(children, "parent")).union(facts(sums)).union(facts(ends)).groupBy("node")
    sum_ = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    whole = written(known.agg(*[F.max(c).alias(c) for c in ("parent", "depth", "conv_id", "n_convs")], *[sum_(c) for c in ("n_children", "n_leaves", "saved_tokens")], F.coalesce(F.max("ends_sha256"), F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")), "facts")

    # Parents with very many children, a thousand at most, are sent to them; the others meet theirs by key.
    parents = whole.filter("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    limit = max(hot, whole.count() // hot)
    named = whole.drop("node").join(F.broadcast(parents.filter(F.col("n_children") > limit).select("parent", F.struct("parent_conv_id").alias("sent"))), "parent", "left")
    columns = "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    sent = named.filter("sent is not null or parent is null").withColumn("parent_conv_id", F.col("sent.parent_conv_id")).select(*columns)
    met = named.filter("sent is null and parent is not null").join(parents.filter(F.col("n_children") <= limit).drop("n_children"), "parent").select(*columns)
    return sent.union(met)


def conversation_trie(conversations: DataFrame, modulus: int = 20, most: int = 4) -> DataFrame:
    """The trie of the rebuilt conversations: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    Turns are ordered by turn, null first; those that tie by the SHA-256 of role and text. Null role or text is
    empty. Rows without conv_id belong to no conversation and are left out; repeated rows are turns of their own.
    A rebuilt conversation without turns is a member of the root. Empty table: no rows. Other columns are ignored.
    """
    return trie_of(rebuilt(written(turns_of(conversations), "turns"), modulus, most))
