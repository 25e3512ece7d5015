import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import numpy as np
from cohortlens.llm import decontaminate as D

TEN = "alpha beta gamma delta epsilon zeta eta theta iota kappa"


def plain(docs, items):
    grams = {}
    for i, t in items:
        w = D.words_of(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            grams.setdefault(tuple(w[k : k + n]), set()).add("null" if i is None else str(i))
    out = []
    for i, t in docs:
        w = D.words_of(t)
        hit, found = set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                got = grams.get(tuple(w[k : k + n]))
                if got:
                    hit |= set(range(k, k + n))
                    found |= got
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("n_hit", F.lit("x")).withColumn("item_id", F.lit(1))
    b = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit("x"))
    return sorted((tuple(r) for r in D.decontaminate(d, b, **options).collect()), key=str)


def cases():
    rng = random.Random(4)
    vocabulary = ["a", "b", "Cc", "d1", "é", "the"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.randint(0, 25))) for k in range(25)] + [(3, TEN), (100, TEN.upper()), (101, None), (102, "!!"), (103, "one Two"), (None, "null item words")]
    docs = [(k, text(rng.randint(0, 60)) + (" " + (rng.choice(items)[1] or "") if rng.random() < 0.4 else "")) for k in range(80)]
    docs += [(200, None), (201, ""), (202, "ALPHA, beta; gamma-delta epsilon zeta eta theta iota kappa!"), (203, "two ONE two"), (None, "x null item words"), (204, TEN), (204, TEN), (205, "w " * 30000 + TEN)]
    return docs, items


def test_matches_brute_force_in_one_block_and_in_many(spark):
    docs, items = cases()
    want = plain(docs, items)
    assert run(spark, docs, items) == want
    assert run(spark, docs, items, block_windows=20) == want


def test_empty_tables(spark):
    assert run(spark, [], [(1, TEN)]) == []
    assert run(spark, [(1, TEN)], []) == plain([(1, TEN)], [])


def test_clean_documents_keep_columns(spark):
    d = spark.createDataFrame([(1, TEN, "x"), (2, "clean text", "y"), (None, "also clean", "z")], "doc_id bigint, text string, contaminated string")
    kept = D.clean_documents(d, spark.createDataFrame([(1, TEN)], "item_id bigint, text string"))
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {2, None}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=10, max_size=40), st.lists(st.integers(0, 5), max_size=20), st.lists(st.integers(0, 5), max_size=20))
def test_winnowing_keeps_a_common_print_of_every_shared_span(shared, before, after):
    words = lambda x: D.mixed(np.array(x, np.uint64) + np.uint64(1))
    a, b = D.gram_hashes(words(shared), D.GRAM), D.gram_hashes(words(before + shared + after), D.GRAM)
    assert set(a[D.winnowed(a)]) & set(b[D.winnowed(b)])


def test_items_of_one_id_in_several_blocks(spark):
    other, third, fourth = (" ".join(f"{x}{k}" for k in range(10)) for x in ("other", "third", "fourth"))
    items = [(7, TEN), (7, other), (None, third), (None, fourth)]
    docs = [(1, f"{TEN} and {other}"), (2, f"{third} and {fourth}"), (2, f"{third} and {fourth}"), (3, f"{TEN} then {third}"), (4, other)]
    want = run(spark, docs, items)
    assert run(spark, docs, items, block_windows=1) == want
    assert sorted(r[2] for r in want) == [10, 20, 20, 20, 20]


def test_rows_are_judged_by_their_own_text(spark):
    d = spark.createDataFrame([(1, TEN, "a"), (1, "clean text", "b"), (None, TEN, "c"), (None, "clean", "d"), (2, None, "e")], "doc_id bigint, text string, items string")
    b = spark.createDataFrame([(1, TEN)], "item_id bigint, text string")
    for most in (D.BLOCK_WINDOWS, 0):
        kept = D.clean_documents(d, b, block_windows=most)
        assert kept.columns == d.columns and sorted(r["items"] for r in kept.collect()) == ["b", "d", "e"]


def test_a_full_sieve_only_lets_more_through(spark, monkeypatch):
    docs, items = cases()
    monkeypatch.setattr(D, "SIEVE_BITS", 64)
    assert run(spark, docs, items, block_windows=0) == plain(docs, items)
