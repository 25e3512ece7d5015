from collections import Counter

import corpus_pipeline
from cohortlens.llm import decontaminate, mixing, quality
from cohortlens.llm.common import written

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_stages_against_plain_rules(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    steps = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        steps.append(written(stage(spark, steps[-1], sf_dir), f"test{k}"))
        assert k == 4 or steps[-1].columns == docs.columns
    ids = [Counter(r[0] for r in s.select("doc_id").collect()) for s in steps]

    passed = {r.doc_id for r in quality.score_quality(docs, labels).collect() if r.predicted}
    assert set(ids[1]) == passed

    text = {r.doc_id: r.text for r in docs.collect()}
    grams = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i in ids[1] for w in [(text[i] or "").lower().split()]}
    alike = lambda i, j: len(grams[i] & grams[j]) / len(grams[i] | grams[j])
    gone = set(ids[1]) - set(ids[2])
    assert all(max(alike(i, j) for j in ids[1] if j != i) >= 0.8 for i in gone)
    kept = sorted(ids[2])
    left = sum(alike(i, j) >= 0.8 for n, i in enumerate(kept) for j in kept[:n])
    assert left == 0

    items = {" ".join(w[k : k + n]) for r in benchmark.collect() for w in [decontaminate.words_of(r.text)] for n in [min(10, len(w))] for k in range(len(w) - n + 1)}
    hit = lambda t: any(" ".join(w[k : k + 10]) in items for w in [decontaminate.words_of(t)] for k in range(len(w)))
    assert set(ids[3]) == {i for i in ids[2] if not hit(text[i])}

    assert set(ids[4]) <= set(ids[3]) and max(ids[4].values(), default=0) <= 2
    assert ids[5] == ids[4]
    spans = sorted((r.start, r.n_tokens) for r in steps[5].collect())
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
    assert corpus_pipeline.run(spark, sf_dir).count() == steps[5].count()


def test_clashing_and_extra_columns_stay(spark):
    docs = spark.createDataFrame([(i, f"plain words in line {i} and {i * 7} more of them", "en", f"s{i % 3}", 10, "x") for i in range(30)], "doc_id bigint, text string, lang string, source string, n_chars bigint, size string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    good = quality.good_documents(docs, labels)
    assert good.columns == docs.columns and good.count() == 30
    mixed = corpus_pipeline.mixing_stage(spark, good, "")
    assert mixed.columns == docs.columns and 0 < mixed.count() <= 60


#: Names that stages use inside, now or before.
INSIDE = "__text judged __key __copies __rows __times __k __each mix_key mix_own mix_copies mix_rows mix_number mix_each __bad __gone __id __row text_md5 size class node label print print_0 component_id ids small".split()


def test_every_stage_keeps_columns_with_its_own_names(spark, tmp_path):
    rows = [(i, f"words of line {i} and {i * 7} more {i * i} to tell it from others here", "en", f"s{i % 3}", 10) for i in range(12)]
    rows += [(3, "repeated id with another text in it", "en", "s1", 9), (3, "repeated id with another text in it", "en", "s2", 9), (None, None, None, None, None)]
    folder = tables(spark, tmp_path, rows, [(1, 1, 0)], [(1, "a passage of ten words or more that no document has at all")])
    plain = spark.read.parquet(f"{folder}/documents.parquet")
    docs = plain.selectExpr("*", *[f"'x' AS `{c}`" for c in INSIDE])
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        got, want = stage(spark, docs, folder), stage(spark, plain, folder)
        if k < 4:
            assert got.columns == docs.columns
            assert Counter(map(str, got.select(*plain.columns).collect())) == Counter(map(str, want.collect()))
            assert got.filter("size = 'x' and judged = 'x'").count() == got.count()
        else:
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    # With a large benchmark, too.
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    assert decontaminate.clean_documents(docs, benchmark, block_windows=0).columns == docs.columns


def test_rows_of_an_id_are_mixed_by_their_own_source(spark):
    # Source b is taken twice, a hardly at all: the row of b comes twice whatever the row of a with its id does.
    docs = spark.createDataFrame([(1, "w " * 50, "a"), (1, "w " * 50, "b")] + [(k, "w " * 50, "a") for k in range(2, 300)], "doc_id bigint, text string, source string")
    counts = Counter((r.doc_id, r.source) for r in mixing.mix_counts(docs).collect() for _ in range(r.copies))
    assert Counter((r.doc_id, r.source) for r in mixing.mixed_documents(docs).collect()) == counts and counts[1, "b"] == 2


def tables(spark, folder, documents, labels=(), benchmark=()):
    spark.createDataFrame(documents, DOCUMENTS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(benchmark), "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_empty_tables(spark, tmp_path):
    run = corpus_pipeline.run(spark, tables(spark, tmp_path, []))
    assert run.columns[:4] == ["doc_id", "start", "n_tokens", "ids_crc32"] and run.count() == 0


def test_nulls_in_every_column_and_no_labels(spark, tmp_path):
    clean = " ".join(f"word{n}" for n in range(40))
    rows = [(None, None, None, None, None), (1, None, "en", None, 0), (2, "", None, "s", 0), (3, clean, "en", "s", 9), (3, clean, "en", "s", 9), (4, clean + " more", None, None, None), (None, "a text that no other document has at all", "en", "s", 1)]
    benchmark = [(1, None), (None, "never seen in any of the texts above at all"), (2, "")]
    folder = tables(spark, tmp_path, rows, [], benchmark)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept = written(stage(spark, kept, folder), "edge")
        assert kept.columns == docs.columns
    # Without labels all score a half and stay; of the alike 3, 3 and 4 and of the empty 1 and 2 the least id; null ids stay.
    assert Counter(r.doc_id for r in kept.collect()) == Counter({None: 2, 1: 1, 3: 1})
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} <= {None, 1, 3}
