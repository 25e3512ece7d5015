from collections import defaultdict

from pyspark.sql import functions as F

from cohortlens.llm import mixing


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Shares above a source's limit are dealt again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if w[s] * level >= most * sizes[s]}
        if not over:
            out.update({s: w[s] * level for s in free})
            break
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_targets_copies_and_repeatability(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix_counts(docs).join(docs.select("doc_id", "source", "text"), "doc_id").collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.size == len((r.text or "").encode().split()) and r.taken == r.copies * r.size and 0 <= r.copies <= 2
        sizes[r.source] += r.size
        taken[r.source] += r.taken
    want = plain_targets(sizes)
    largest = {s: max(r.size for r in rows if r.source == s) for s in sizes}
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
    assert all(abs(taken[s] - want[s]) <= max(0.02 * want[s], 1.5 * largest[s]) for s in sizes)
    assert abs(sum(taken.values()) - sum(want.values())) < 0.03 * sum(want.values())
    again = mixing.mix_counts(docs.repartition(5)).collect()
    assert sorted(again) == sorted(mixing.mix_counts(docs).collect())


def test_edge_rows(spark):
    rows = [(1, "a b c", "x"), (2, None, "x"), (3, "", None), (None, "d e", None), (5, " \t ", "empty"), (6, "w " * 40000, "é"), (1, "a b c", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("size", F.lit("s")).withColumn("copies", F.lit(9))
    got = mixing.mix_counts(df).collect()
    assert len(got) == len(rows) and all(r.taken <= 2 * r.size for r in got)
    assert {r.size for r in got} == {3, 0, 2, 40000}
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns and mixed.filter("doc_id = 1").count() == sum(r.copies for r in got if r.doc_id == 1)
    assert mixing.mix_counts(df.limit(0)).count() == 0 and mixing.mixed_documents(df.limit(0)).count() == 0


def test_main_path_is_native(spark, sf_dir):
    plan = mixing.mix_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_smaller_windows_give_the_same_mix(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = sorted(mixing.mix_counts(docs).collect())
    monkeypatch.setattr(mixing, "first_digits", lambda rows: 4)
    assert sorted(mixing.mix_counts(docs).collect()) == want


def test_digits_follow_the_largest_group():
    assert [mixing.first_digits(n) for n in (0, 1 << 17, 1 << 25, (1 << 25) + 1, 1 << 29, 1 << 62)] == [2, 2, 2, 3, 3, 8]
