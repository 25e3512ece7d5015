import hashlib
import re

import xxhash
from pyspark.sql import functions as F

from cohortlens.llm import sketch

TEXTS = [(5, "one two three four five six seven eight nine ten " * 3), (2, None), (9, "Ünï cödé\tshort"), (11, " \n"), (7, "one two three four five six seven eight nine ten " * 3), (None, "first of all"), (4, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 4)]


def edited(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    out = {}
    for k, (i, t) in enumerate(rows):
        half = len(t) // 2
        out[i] = (len(t), hashlib.sha256((t[: len(t) - half] + rows[(k + 1) % len(rows)][1][:half]).encode()).hexdigest())
    return out


def test_edited_texts_and_likeness(spark):
    df = spark.createDataFrame(TEXTS, "doc_id bigint, text string").withColumn("key", F.lit("x")).withColumn("fingerprint", F.lit(1))
    got = {r.doc_id: r for r in sketch.edited_fingerprints(df).collect()}
    assert {i: (r.n_chars, r.edited_sha256) for i, r in got.items()} == edited(TEXTS)
    assert got[5].fingerprint == got[7].fingerprint and len(got[5].fingerprint) % 16 == 0
    assert got[5].near_next == 1.0 and got[11].fingerprint == "" and got[2].near_edited == 1.0
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got.values())
    assert sketch.edited_fingerprints(df.limit(0)).count() == 0
    one = sketch.edited_fingerprints(df.filter("doc_id = 9")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_repeated_rows_keep_their_rows(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "x y"), (2, "q")], "doc_id bigint, text string")
    assert sketch.edited_fingerprints(df).count() == 4


def test_sketch_estimates_jaccard(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = edited([tuple(r) for r in docs.select("doc_id", "text").collect()])
    got = sketch.edited_fingerprints(docs).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == want
    text = {r.doc_id: r.text.lower().split() for r in docs.collect()}
    ids = sorted(text)
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    off = []
    for r in got:
        a, b = grams(text[r.doc_id]), grams(text[ids[(ids.index(r.doc_id) + 1) % len(ids)]])
        off.append(abs(r.near_next - len(a & b) / len(a | b)))
    assert sum(off) / len(off) < 0.03


def test_sketch_merges(spark):
    df = spark.createDataFrame([("a b c d e f g " * 40, "h i j k l m n o " * 30)], "x string, y string")
    r = sketch.with_sketch(sketch.with_sketch(df, "x", "sx", 2), "y", "sy", 2).select("*", sketch.containment(F.col("sx"), F.array_union("sx", "sy")).alias("c")).first()
    assert r.c == 1.0


def plain_sketch(text, scale=sketch.SCALE):
    """Sorted different hashes of runs of five words below the limit; the least one if there is none."""

    def chained(numbers):
        seed = 42
        for n in numbers:
            seed = xxhash.xxh64_intdigest((n & (1 << 64) - 1).to_bytes(8, "little"), seed)
        return seed

    words = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    runs = [words[i : i + sketch.SHINGLE] for i in range(max(1, len(words) - sketch.SHINGLE + 1))] if words else []
    hashes = sorted({chained(r) >> 1 for r in runs})
    return [h for h in hashes if h < (1 << 63) // scale] or hashes[:1]


def plain_likeness(a, b):
    return 1.0 if a == b else len(set(a) & set(b)) / len(set(a) | set(b))


def test_fingerprints_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    ids = sorted(text)
    hexed = lambda x: "".join(f"{h:016x}" for h in x)
    for r in sketch.edited_fingerprints(docs).collect():
        own, after = text[r.doc_id], text[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        half = len(own) // 2
        a, b = plain_sketch(own), plain_sketch(own[: len(own) - half] + after[:half])
        assert (r.fingerprint, r.edited_fingerprint) == (hexed(a), hexed(b))
        assert abs(r.near_edited - plain_likeness(a, b)) < 1e-12
        assert abs(r.near_next - plain_likeness(a, plain_sketch(after))) < 1e-12


def test_sketch_of_joined_sets_is_the_union(spark):
    a, b = (" ".join(f"{k}{n}" for n in range(3000)) for k in "ab")
    # The runs over the seam are in neither text; what the sketches hold of both must all be there.
    whole, one, other = (set(plain_sketch(t)) for t in (f"{a} {b}", a, b))
    rows = spark.createDataFrame([(1, a), (2, b), (3, f"{a} {b}")], "doc_id bigint, text string")
    got = {r.doc_id: set(r.sketch) for r in sketch.sketches(rows).collect()}
    assert got == {1: one, 2: other, 3: whole}
    assert got[1] | got[2] <= got[3] and len(got[3] - got[1] - got[2]) <= sketch.SHINGLE - 1


def test_main_path_is_native(spark, sf_dir, capsys):
    sketch.edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet")).explain("extended")
    plan = capsys.readouterr().out
    assert "Exchange" in plan and not re.search("Python|Arrow|Pandas", plan)


def test_very_long_text(spark):
    long = " ".join(f"w{n}" for n in range(200_000))
    rows = {r.doc_id: r for r in sketch.edited_fingerprints(spark.createDataFrame([(1, long), (2, "a b c d e f")], "doc_id bigint, text string")).collect()}
    own, edited = plain_sketch(long), plain_sketch(long[: len(long) - len(long) // 2] + "a b c d e f")
    assert rows[1].n_chars == len(long) and len(rows[1].fingerprint) == 16 * len(own)
    # The next text gives six words, so about half of the long one is gone.
    assert abs(rows[1].near_edited - plain_likeness(own, edited)) < 1e-12 and rows[1].near_edited < 0.6
