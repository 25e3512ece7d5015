"""The conversation trie against a trie of plain dictionaries."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest

from cohortlens.llm import prefix_trie, queries

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"


def plain(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn, role or "", text or ""))
    digest = lambda t: hashlib.sha256(f"{len(t[1])} {t[1]}{t[2]}".encode()).digest()
    own = {c: [t[1:] for t in sorted(x, key=lambda t: (t[0] is not None, t[0] or 0, digest(t)))] for c, x in own.items()}
    nodes = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        whole = tuple(own.get(base, [])[:h] + x[h:])
        for d in range(len(whole) + 1):
            nodes.setdefault(whole[:d], []).append((c, len(whole)))
    children = {}
    for path in nodes:
        if path:
            children.setdefault(path[:-1], []).append(path)
    leaves, saved = {}, {}
    for path in sorted(nodes, key=len, reverse=True):
        below = children.get(path, [])
        leaves[path] = sum(leaves[x] for x in below) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        saved[path] = (len(nodes[path]) - 1) * words + sum(saved[x] for x in below)
    out = []
    for path, members in nodes.items():
        ends = ",".join(str(c) for c, n in sorted(members) if n == len(path))
        out.append((min(members)[0], len(path), min(nodes[path[:-1]])[0] if path else None, len(members), len(children.get(path, [])), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows():
    rng = random.Random(5)
    out = []
    for c in range(-45, 400):
        if rng.random() < 0.15:
            continue
        for turn in range(rng.randrange(1, 7)):
            out.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["hi", "hello there\tyou", "", None, "a b\nc"]) if turn < 3 else f"text {rng.randrange(6)}"))
    out += [(900, None, "user", "before all"), (900, None, "user", "tied"), (900, 0, "a", "b"), (900, 0, "a", "b"), (901, 0, "ab", ""), (902, 0, "a", "b"), (None, 1, "user", "lost"), (1000, 1, None, None)]
    out += [(903 + k, t, "user", "same") for k in range(30) for t in range(40)]
    out += [(940, t, "user", f"long {t} " + "word " * 3000) for t in range(300)] + [(941, t, "user", f"long {t} " + "word " * 3000) for t in range(300)]
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", node string, shard int")


def test_like_the_plain_trie(spark):
    got = prefix_trie.conversation_trie(table(spark, rows()).repartition(6)).select(*COLUMNS).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows())


@pytest.mark.parametrize(("shard", "turns", "hot"), [(7, 10**6, 3), (50, 90, 1), (1, 1, 1000)])
def test_any_cut_into_shards(spark, shard, turns, hot):
    whole = prefix_trie.rebuilt(prefix_trie.turns_of(table(spark, rows())))
    got = prefix_trie.trie_of(whole, shard, turns, hot).select(*COLUMNS).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows())


def test_nothing_there(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert prefix_trie.conversation_trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).collect() == []


def test_conversation_without_turns(spark):
    # crc32 of the id is 3 modulo 4 and conversation 0 is not there: nothing is left of it.
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    got = [tuple(r) for r in prefix_trie.conversation_trie(spark.createDataFrame([(c, 0, "a", "b")], SCHEMA)).collect()]
    assert got == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())] == plain([(c, 0, "a", "b")])


def test_query_matches_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    got = queries.QUERIES["op12_prefix_trie"](spark, sf_dir).select(*COLUMNS)
    want = con.execute(queries.ORACLE_SQL["op12_prefix_trie"])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(COLUMNS)
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=str) == sorted(want.fetchall(), key=str)
