import math
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from cohortlens.llm import language


def plain_phrases(text, known):
    """Longest matches from left to right over the whole text."""
    n = i = 0
    while i < len(text):
        k = 1
        while i + k < len(text) and text[i : i + k + 1] in known:
            k += 1
        n, i = n + 1, i + k
    return n


def test_phrases_are_longest_matches():
    train = {"a": b"the cat sat on the mat and the hat was on the cat " * 3, "b": "über die brücke öl".encode()}
    model = language.Model.learn(train)
    texts = [language.folded(np.frombuffer(x, np.uint8)) for x in (b"The hat sat on the, bridge! 12 cat", "Öl über zx é".lower().encode(), b"x", b"the " * 200)]
    want = [[plain_phrases(t.tobytes(), language.folded(np.frombuffer(train[k] + b" ", np.uint8)).tobytes()) for k in ("a", "b")] for t in texts]
    assert model.phrases(texts).tolist() == want


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_edge_rows(spark):
    rows = [(1, "the cat and the dog are here", "en"), (3, "der hund und die katze sind hier", "de"), (4, None, "en"), (5, "", None), (6, "12 +!", "de"), (None, "the dog", "en"), (8, "the dog and the cat", None), (8, "die katze und der hund", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("score", F.lit("x")).withColumn("draw", F.lit(1))
    got = [(r.doc_id, r.lang_pred) for r in language.identify(df).collect()]
    assert (4, "und") in got and (5, "und") in got and (6, "und") in got and (None, "en") in got
    assert sorted(p for i, p in got if i == 8) == ["de", "en"]
    assert language.identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in language.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_a_phrase_goes_on_over_the_ends_of_stretches():
    rng = np.random.default_rng(3)
    train = {"a": bytes(rng.choice(list(b"ab "), 3000).astype(np.uint8)), "b": b"abba " * 500, "c": b"xyz"}
    model = language.Model.learn(train)
    known = {k: language.folded(np.frombuffer(t + b" ", np.uint8)).tobytes() for k, t in train.items()}
    texts = [b"abba " * 300, train["a"], b"z" * 700, bytes(rng.choice(list(b"ab "), 2000).astype(np.uint8)), b"abba " * 130 + b"b" + b"abba " * 130, b"", b"a"]
    texts = [language.folded(np.frombuffer(t, np.uint8)) for t in texts]
    want = [[plain_phrases(t.tobytes(), known[k]) for k in ("a", "b", "c")] for t in texts]
    assert model.phrases(texts).tolist() == want and want[0][1] == 1


def test_scores_ties_and_very_long_texts(spark):
    rows = [(1, "the cat and the dog", "en"), (3, "the cat and the dog", "zz"), (4, "the cat " * 200_000, None), (5, "the cat", None)]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert all(r.lang_pred == "en" and abs(r.score - 0.5) < 1e-9 for r in got.values())


def test_a_repeated_id_teaches_once(spark):
    rows = [(1, f"text number {k} of one id", "en") for k in range(500)] + [(3, "der text", "de")]
    texts = language.training_texts(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert len(texts["en"]) < 40


def plain_phrases_fast(text, known):
    """As plain_phrases; the longest match is found by doubling and halving."""
    n = i = 0
    while i < len(text):
        low, high = 1, 2
        while i + high <= len(text) and text[i : i + high] in known:
            low, high = high, 2 * high
        high = min(high, len(text) - i + 1)
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if text[i : i + mid] in known else (low, mid)
        n, i = n + 1, i + low
    return n


def test_whole_rows_like_the_plain_rule(spark, sf_dir):
    """lang_pred and score of documents from the training passages, by substring search alone."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = lambda b: re.sub(rb"[^a-z\x80-\xff]+", b" ", b.lower())
    known = {k: fold(t + b" ") for k, t in language.training_texts(docs.select("doc_id", "text", "lang")).items()}
    names = sorted(known)
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    judged = 0
    for r in docs.collect():
        own = got[r.doc_id]
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (own.lang_pred, own.score) == ("und", 0.0)
            continue
        text = fold(r.text.lower().encode())
        if len(text) > 3000:
            continue
        bits = [plain_phrases_fast(text, known[k]) * math.log2(max(2, len(known[k]))) / max(1, len(text)) for k in names]
        weight = sum(2 ** (-8.0 * (b - min(bits))) for b in bits)
        assert own.lang_pred == names[bits.index(min(bits))] and abs(own.score - 1 / weight) < 1e-9
        judged += 1
    assert judged > 100
