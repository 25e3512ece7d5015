import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from cohortlens.llm import gray, simhash
from cohortlens.llm.components import component_labels, nearest_forest


def plain_fingerprint(text, n=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or ""))
    words = [w for w in low.translate({k: " " for k in (9, 10, 11, 12, 13)}).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(prints, radius):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_fingerprint_matches_plain_form():
    rng = random.Random(1)
    texts = ["", None, " \t\n", "One", "Ünï Cödé TEXT two", "a b c d", "x " * 500] + [" ".join(rng.choice("abcdé") * rng.randint(1, 4) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    assert [simhash.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]


def test_index_and_components_match_brute_force(spark):
    rng = random.Random(2)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(300):
        x = rng.choice(prints)
        for _ in range(rng.randint(1, 5)):
            x ^= 1 << rng.randint(0, 63)
        prints.append(x)
    prints = sorted(set(prints))
    want = components(prints, 3)
    rows = [(int(np.uint64(p).astype(np.int64)), i) for i, p in enumerate(prints)]
    df = spark.createDataFrame(rows, "print bigint, node bigint")
    for bucket_rows in (2048, 4):
        labels = dict(component_labels(simhash.near_links(df, 3, bucket_rows=bucket_rows).select("a", "b")).collect())
        assert [labels.get(i, i) for i in range(len(prints))] == want


def test_wider_radius_by_choices_of_blocks(spark):
    rng = random.Random(3)
    prints = [rng.getrandbits(64) for _ in range(30)]
    prints = sorted(set(prints + [p ^ sum(1 << b for b in rng.sample(range(64), k)) for p in prints for k in (2, 6, 7, 9)]))
    df = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)), i) for i, p in enumerate(prints)], "print bigint, node bigint")
    labels = dict(component_labels(simhash.near_links(df, 6, 8).select("a", "b")).collect())
    assert [labels.get(i, i) for i in range(len(prints))] == components(prints, 6)


def test_edge_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "same words in here", "x"), (7, "same words in here", "x"), (5, "Same WORDS in here", None), (5, "Same WORDS in here", None), (None, "alone", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, print string").withColumn("component_id", F.lit(1))
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == [(-1, None), (1, 1), (2, 1), (3, 3), (5, 3), (5, 3), (7, 3)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert sorted((r.doc_id or -1) for r in simhash.one_of_each(df).select("doc_id").collect()) == [-1, 1, 3]
    again = df.unionByName(df).unionByName(spark.createDataFrame([(3, "other words of an id that is there", "x")], "doc_id bigint, text string, print string").withColumn("component_id", F.lit(1)))
    kept = simhash.one_of_each(again)
    assert kept.columns == again.columns and sorted((r.doc_id or -1) for r in kept.select("doc_id").collect()) == [-1, -1, 1, 3]


def test_very_long_text(spark):
    rng = random.Random(18)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(400_000))
    rows = [(1, long), (2, long + " and one more word"), (3, "short one")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert got == {i: (f"{plain_fingerprint(t):016x}", 1 if i < 3 else 3) for i, t in rows}
    assert dict(simhash.similar_documents(df).collect()) == {1: 1, 2: 1, 3: 3}


def test_gray_order_of_several_words():
    x = np.arange(1 << 10, dtype=np.uint64)
    # Words of five bits held in the upper bits: neighbours in the order differ in one bit.
    words = [(x >> np.uint64(5)) << np.uint64(59), (x & np.uint64(31)) << np.uint64(59)]
    by = np.lexsort((*reversed(gray.gray_ranks(words)),))
    steps = gray.differing([w[by][1:] for w in words], [w[by][:-1] for w in words])
    assert (steps == 1).all()


def test_documents_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    prints = [plain_fingerprint(r.text) for r in rows]
    want = {r.doc_id: (f"{p:016x}", rows[c].doc_id) for r, p, c in zip(rows, prints, components(prints, 3), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()} == want


def test_forest_spans_with_the_lightest_links():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 40, 300), rng.integers(0, 40, 300)
    w = rng.integers(0, 9, 300)
    taken = nearest_forest(40, a, b, w)
    root = {k: k for k in range(40)}
    total = 0
    for k in np.argsort(w, kind="stable"):
        x, y = root[a[k]], root[b[k]]
        if x != y:
            total += w[k]
            root = {i: (x if r == y else r) for i, r in root.items()}
    assert len(taken) == 40 - len(set(root.values())) and w[taken].sum() == total


def test_similar_documents_are_confirmed(spark):
    rng = random.Random(9)
    base = [[rng.choice("abcdefghij") * rng.randint(1, 5) + str(rng.randint(0, 99)) for _ in range(300)] for _ in range(12)]
    rows, group = [], {}
    for k, words in enumerate(base):
        for c in range(4):
            own = list(words)
            for _ in range(c):
                own[rng.randrange(300)] = "changed"
            rows.append((k * 10 + c, " ".join(own)))
            group[k * 10 + c] = k * 10
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert dict(simhash.similar_documents(df).collect()) == group
