import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cohortlens.llm import substrings


def plain(rows, n=50):
    """{row: result} by brute force; rows are (doc_id or None, text or None)."""
    lead = lambda i: -(1 << 63) if i is None else i
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - n + 1):
            first[b[k : k + n]] = min(first.get(b[k : k + n], lead(i)), lead(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - n + 1):
            if first[b[k : k + n]] < lead(i):
                gone[k : k + n] = True
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


def same(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("block", F.lit("x")).withColumn("payload", F.lit(1))
    return sorted((tuple(r) for r in substrings.dedup_substrings(df, **options).collect()), key=str)


def test_random_texts_with_shared_passages(spark):
    rng = random.Random(5)
    alphabet = "abé \n"
    passages = ["".join(rng.choice(alphabet) for _ in range(rng.randint(45, 140))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 90))) for _ in range(rng.randint(0, 12)))) for i in rng.sample(range(-40, 200), 70)]
    rows += [(500, rows[3][1]), (501, rows[3][1]), (7, None), (8, ""), (None, passages[0]), (None, passages[0]), (600, "a" * 400), (601, "a" * 49), (602, "a" * 50), (3, passages[1]), (3, passages[1])]
    want = plain(rows)
    assert same(spark, rows) == want
    assert same(spark, rows, block_bytes=1500) == want


def test_long_text_is_cut_without_loss(spark, monkeypatch):
    rng = random.Random(6)
    words = "".join(rng.choice("abcdefgh ") for _ in range(9000))
    monkeypatch.setattr(substrings, "SLICE_BYTES", 700)
    rows = [(1, words), (2, words[3000:6000] + "zz" + words[100:149] + "y" + words[5000:5100])]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").select(F.lit(0).cast("bigint").alias("block"), "*").toArrow()
    answers = substrings._bucket(substrings._send(1)(table))
    got = sorted((tuple(r.values()) for r in substrings._remove(1)(table, answers).to_pylist()), key=str)
    assert got == plain(rows)


def test_sort_orders_strings():
    rng = np.random.default_rng(7)
    text = rng.integers(97, 99, (400, 50), dtype=np.uint8)
    text[:, :30] = 97
    text[200:] = text[rng.integers(0, 200, 200)]
    number = substrings.equal_strings(text, np.zeros(400, np.int64))
    rows = [bytes(r) for r in text]
    ranks = {s: k for k, s in enumerate(sorted(set(rows)))}
    assert [ranks[r] for r in rows] == [sorted(set(number)).index(x) for x in number]


def test_empty_table(spark):
    assert same(spark, []) == []


def test_documents(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert same(spark, rows, block_bytes=100_000) == plain(rows)


def test_runs_of_one_byte_take_little_memory():
    tracemalloc.start()
    table = pa.table({"doc_id": pa.array([1, 2], pa.int64()), "text": ["x" + " " * (6 << 20), " " * 70 + "y"]})
    block = substrings.Block(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1 << 30 and len(block.rows) < 1000


def test_runs_and_long_texts_through_the_operator(spark):
    rng = random.Random(8)
    long = "".join(rng.choice("abcdefgh ") for _ in range(1 << 21))
    rows = [(1, " " * 300_000), (2, "x" + " " * 200 + "x"), (3, long), (4, "new" + long[1_000_000:1_200_000] + "end"), (5, "ab" * 40_000), (6, "q" + "ba" * 100)]
    got = {r[0]: r[1:4] for r in same(spark, rows, block_bytes=1 << 20)}
    assert got[1] == (300_000, 0, 0) and got[2] == (202, 200, 1) and got[3] == (1 << 21, 0, 0)
    assert got[4] == (200_006, 200_000, 1) and got[5] == (80_000, 0, 0) and got[6] == (201, 200, 1)
