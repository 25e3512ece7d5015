"""What outlives a run: caches, checked publication, model versions, streams with deltas; and plans that stay bounded."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens import catalogue
from cohortlens.operators import cohort, consensus, events, evidence, link, rules
from cohortlens.sources import keeping
from cohortlens.sources.shared import sent
from cohortlens.streaming import streams

C = F.col


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cache_computes_each_record_once(spark, tmp_path):
    path, asked = str(tmp_path / "cache"), []

    def compute(d):
        asked.append(d.count())
        return d.select("k", (C("x") * 2).alias("value"))

    records = spark.range(100).select(C("id").alias("k"), C("id").cast("double").alias("x"))
    run = lambda r, f="v1": sorted(map(tuple, keeping.cached_analysis(r, path, "k", f, compute).collect()))
    assert run(records.filter("k < 60")) == [(k, 2.0 * k, False) for k in range(60)]
    assert run(records) == [(k, 2.0 * k, k < 60) for k in range(100)]
    before = len(glob.glob(f"{path}/**/*.parquet", recursive=True))
    assert run(records) == [(k, 2.0 * k, True) for k in range(100)]
    assert [n for n in asked if n] == [60, 40] and len(glob.glob(f"{path}/**/*.parquet", recursive=True)) == before
    assert run(records.filter("k < 5"), "v2") == [(k, 2.0 * k, False) for k in range(5)]
    found = plan(keeping.cache_rows(spark, path, "k bigint, value double, check bigint, run bigint, fingerprint string", "v1"))
    assert "PartitionFilters: [isnotnull(fingerprint" in found and "= v1)" in found


def test_torn_files_and_wrong_values_are_computed_again(spark, tmp_path):
    path = str(tmp_path / "cache")
    records = spark.range(200).select(C("id").alias("k"))
    run = lambda: sorted(map(tuple, keeping.cached_analysis(records.repartition(4), path, "k", "v", lambda d: d.select("k", (C("k") + 1).alias("value"))).collect()))
    run()
    files = sorted(glob.glob(f"{path}/fingerprint=v/*.parquet"))
    with open(files[0], "r+b") as f:
        f.truncate(os.path.getsize(files[0]) // 2)
    wrong = spark.createDataFrame([(7, 999, 1, 9, "v"), (8, None, 1, 9, "v")], "k bigint, value bigint, check bigint, run bigint, fingerprint string")
    wrong.write.mode("append").partitionBy("fingerprint").parquet(path)
    again = run()
    assert [(k, v) for k, v, _ in again] == [(k, k + 1) for k in range(200)]
    assert 0 < sum(not c for *_, c in again) < 200
    assert all(c for *_, c in run())


def test_nothing_is_published_unless_all_adds_up(spark, tmp_path):
    folder, a = str(tmp_path / "out"), spark.range(10)
    with pytest.raises(FileNotFoundError):
        keeping.read_published(spark, folder, "all")
    frames = {"all": a, "low": a.filter("id < 4"), "high": a.filter("id >= 4")}
    checks = keeping.publish_checked(frames, folder, {"all": 10}, {"all": ["low", "high"]}).collect()
    assert all(r.ok for r in checks) and len(checks) == 2
    assert keeping.read_published(spark, folder, "low").count() == 4
    with pytest.raises(ValueError, match="all: 11 instead of 10; all = low \\+ high: 10 instead of 11"):
        keeping.publish_checked(frames | {"all": spark.range(11)}, folder, {"all": 10}, {"all": ["low", "high"]})
    assert keeping.read_published(spark, folder, "all").count() == 10


def test_a_frame_is_read_once_to_be_written_and_counted(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    keeping.publish_checked({"x": spark.range(50).mapInArrow(count, "id bigint")}, str(tmp_path), {"x": 50})
    assert seen.value == 50


def points(spark, n=400, seed=3):
    rng = np.random.default_rng(seed)
    label = rng.integers(0, 3, n)
    x = rng.normal(size=(n, 4)) + np.eye(3, 4)[label] * 1.5
    rows = [(k, [float(v) for v in x[k]], int(label[k]), "f1", k % 10 == 0) for k in range(n)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int, version string, excluded boolean"), x, label


def test_model_versions(spark, tmp_path):
    table, _, _ = points(spark)
    home = str(tmp_path / "models")
    version, model = evidence.versioned_softmax(table, "f1", home)
    same, again = evidence.versioned_softmax(table.repartition(7), "f1", home)
    assert same == version and np.array_equal(model.coefficientMatrix.toArray(), again.coefficientMatrix.toArray())
    other, _ = evidence.versioned_softmax(table.withColumn("label", F.when(C("vec_id") == 1, (C("label") + 1) % 3).otherwise(C("label"))), "f1", home)
    assert other != version and spark.read.parquet(f"{home}/versions").count() == 2
    assert spark.read.parquet(f"{home}/excluded/{version}").count() == 40
    want = {r.vec_id: int(r.prediction) for r in model.transform(table.withColumn("features", evidence_vector())).collect()}
    got = evidence.score_by_version(table, home, version).collect()
    assert {r.vec_id: r.predicted for r in got} == want and {r.model_version for r in got} == {version}


def evidence_vector():
    from pyspark.ml.functions import array_to_vector

    return array_to_vector("embedding")


def test_softmax_like_a_plain_fit(spark):
    """Newton steps in numpy on the same objective: mean weighted log loss and 0.01 / 2 of the squared weights of scaled features."""
    table, x, label = points(spark)
    model = evidence.balanced_softmax_fit(table, "f1")
    used = np.arange(len(x)) % 10 != 0
    a, y = x[used], label[used]
    weight = len(y) / (3 * np.bincount(y)[y])
    scale = np.sqrt(np.average((a - np.average(a, axis=0, weights=weight)) ** 2, axis=0, weights=weight))
    z, hot = np.c_[a / scale, np.ones(len(a))], np.eye(3)[y]
    w = np.zeros((3, z.shape[1]))
    penalty = np.tile(np.r_[np.full(4, 0.01), 1e-9], 3)
    for _ in range(30):
        p = np.exp(z @ w.T)
        p /= p.sum(1, keepdims=True)
        gradient = ((p - hot) * weight[:, None]).T @ z / weight.sum() + penalty.reshape(3, -1) * w
        hessian = np.diag(penalty)
        for i in range(3):
            for j in range(3):
                h = z.T @ (z * (weight * p[:, i] * ((i == j) - p[:, j]))[:, None]) / weight.sum()
                hessian[i * 5 : i * 5 + 5, j * 5 : j * 5 + 5] += h
        w -= np.linalg.solve(hessian, gradient.ravel()).reshape(w.shape)
    want = np.exp(np.c_[x / scale, np.ones(len(x))] @ w.T)
    want /= want.sum(1, keepdims=True)
    got = np.array([r.probability.toArray() for r in model.transform(table.withColumn("features", evidence_vector())).orderBy("vec_id").collect()])
    assert np.abs(got - want).max() < 0.02 and (got.argmax(1) == want.argmax(1)).mean() > 0.99


@pytest.mark.parametrize("share", [0.0, 0.5, 1e9])
def test_deltas_are_merged_as_the_table_grows(spark, tmp_path, share):
    folder, home = str(tmp_path / "in"), str(tmp_path / "home")
    rows = [(k % 40, k * 7 % 100, k) for k in range(300)]
    for k in range(6):
        spark.createDataFrame(rows[50 * k : 50 * k + 50], "k int, at int, v int").coalesce(1).write.mode("append").parquet(folder)
    streams.upsert_stream(streams._files(spark, folder, 1), ["k"], ["v"], "at", "v", home, share)
    base, n, deltas = streams._state(spark, home)
    got = streams.latest(streams._rows(spark, home, base, deltas), ["k"], ["v"], "at", "v")
    want = streams.latest(spark.createDataFrame(rows, "k int, at int, v int"), ["k"], ["v"], "at", "v")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {0.0: (5, 40, []), 1e9: (0, 40, [1, 2, 3, 4, 5])}.get(share, (base, n, deltas)) == (base, n, deltas)


def test_plans_stay_bounded(spark, sf_dir):
    w05, j11 = (plan(catalogue.QUERIES[q](spark, sf_dir)) for q in ("w05_balanced_development_selection", "j11_condition_rule_join"))
    assert "WindowGroupLimit" in w05
    assert "NestedLoop" not in j11 and "Cartesian" not in j11
    with pytest.raises(ValueError, match="more than 5 rows"):
        sent(spark.range(6), "the set", 5)


def test_clauses_of_negations_alone(spark):
    trees = [{"rule_code": "N", "status": "PUBLISHED", "condition": {"all": [{"not": {"field": "a", "op": ">", "value": 1}}, {"not": {"field": "b", "op": "exists"}}]}}, {"rule_code": "P", "status": "PUBLISHED", "priority": 3, "condition": {"field": "a", "op": ">", "value": 1}}]
    clauses = spark.createDataFrame(rules.compile_conditions(trees), "rule_id string, priority int, clause int, field string, op string, limit double, negate boolean")
    context = spark.createDataFrame([(1, "a", 2.0), (2, "a", 1.0), (3, "b", 0.0), (4, "c", None)], "patient_id int, field string, value double")
    assert sorted(map(tuple, rules.condition_rules(context, clauses).collect())) == [(1, "P", 3), (2, "N", 100), (4, "N", 100)]


def test_panel_rows_that_break_the_contract(spark):
    panel = spark.createDataFrame([(1, "POSITIVE", "af"), (2, "POSITIVE", "zz"), (3, "NEGATIVE_CONTROL", None), (4, "OTHER", None), (5, "POSITIVE", "af"), (6, "POSITIVE", "af"), (7, "NEGATIVE_CONTROL", None)], "record_id int, role string, target string")
    records = spark.createDataFrame([(1, 9, 40.0), (2, 1, 17.0), (3, 1, 50.0), (4, 1, 50.0), (6, 1, 30.0), (7, 1, 30.0)], "record_id int, fold int, age double")
    codes = spark.createDataFrame([(1, "AFIB"), (3, "AFIB"), (6, "OTHER"), (7, "OTHER")], "record_id int, code string")
    got = sorted((r.record_id, r.problem) for r in cohort.panel_violations(panel, records, codes, {"af": ["AFIB", "AFLT"]}, [1, 2]).collect())
    assert got == [(1, "forbidden_fold"), (2, "pediatric"), (2, "unknown_target"), (3, "control_matches_target"), (4, "unsupported_role"), (5, "missing_record"), (6, "target_no_longer_true")]


def test_headers_never_keep_what_follows(spark):
    good = "rec1 2 500/1000 5000 12:00\na.dat 16\nb.dat 16\n# secret diagnosis\n"
    rows = [(1, good), (2, good.replace("\n", "\r\n")), (3, "rec 3 500 10\na\nb\nc"), (4, "rec 2 250 10\na\nb"), (5, "rec 2 500 10\na\n"), (6, ""), (7, None), (8, "rec two 500 10\na\nb"), (9, "rec 2 500 10\n\nb\n"), (10, "rec 2\na\nb")]
    got = {r.k: (r.kept, r.n_samples, r.reason) for r in link.anonymised_headers(spark.createDataFrame(rows, "k int, t string"), "k", "t", signals=2).collect()}
    assert got[1] == ("rec1 2 500/1000 5000 12:00\na.dat 16\nb.dat 16", 5000, None) == got[2]
    assert [got[k][2] for k in range(3, 11)] == ["wrong_signals", "wrong_rate", "malformed", "malformed", "malformed", "malformed", None, "malformed"]
    assert all(v[0] is None or "secret" not in v[0] for v in got.values())


def test_premature_beats_by_hand(spark):
    t = [0, 1000, 2000, 2600, 4000, 5000, 6000, 6500]
    df = spark.createDataFrame([(1, k, x, 130.0 if k == 3 else 90.0, 1.0) for k, x in enumerate(t)] + [(2, 9, 0, 90.0, 1.0)], "record_id int, event_id int, t_ms bigint, width double, amplitude double")
    assert [tuple(r) for r in events.ectopic_beats(df).collect()] == [(1, 3, True, False, True, "ventricular")]
    got = {r.record_id: r for r in events.ectopy_burden(df).collect()}
    assert (got[1].premature, got[1].burden, got[1].explains_irregularity) == (1, 0.125, False)
    assert (got[2].evaluable, got[2].burden) == (False, None)


def test_global_duration_by_hand(spark):
    lead = lambda r, *v: [(r, k, float(x), c) for k, (x, c) in enumerate(v)]
    rows = lead(1, (100, 0.8), (110, 0.8), (120, 0.8), (104, 0.8), (300, 0.9), (200, 0.5)) + lead(2, (100, 0.5), (105, 0.1)) + lead(3, (100, 0.3), (110, 0.3), (120, 0.3), (90, 0.9))
    got = {r.record_id: r for r in consensus.global_duration(spark.createDataFrame(rows, "record_id int, lead int, value double, confidence double"), ["record_id"]).collect()}
    # 200 is above 110 + max(30, 3 * 1.4826 * 10) = 154.5; 300 is not plausible.
    assert (got[1].value, got[1].spread, got[1].n_eligible, got[1].mode) == (110.0, 16.0, 4, "upper_envelope")
    assert got[1].confidence == pytest.approx(0.8 * (1 - 16 / 110) * 4 / 6)
    assert got[2].mode == "single_trusted" and got[2].value == 100.0
    assert got[3].value == 110.0 and got[3].n_eligible == 4
