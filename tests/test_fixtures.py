"""Known answers of small hand-built tables, and invariants that hold for any input."""

import math
import random

import pytest
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from cohortlens.functions import text as X
from cohortlens.operators import cohort, consensus, events, link, measures, merge, phases, rules, score
from cohortlens.sources import readers
from cohortlens.streaming import streams

C = F.col


def one(spark, **values):
    return spark.range(1).select(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in values.items()])


BANDS = [("A", 30.0, 60.0, True, False), ("B", 60.0, None, False, True)]


@pytest.mark.parametrize(("value", "bands", "want"), [
    (40.0, BANDS, ["A"]), (60.0, [("A", 30.0, 60.0, True, True), ("B", 60.0, None, True, True)], []), (60.0, [("A", 30.0, 60.0, True, False), ("B", 60.0, None, True, True)], ["B"]),
    (15.0, [("A", 15.0, 30.0, False, True)], []), (15.1, [("A", 15.0, 30.0, False, True)], ["A"]), (math.nan, BANDS, []), (math.inf, BANDS, []), (-2.0, BANDS, []), (25.5, [("A", 10.0, 25.0, True, True), ("B", 26.0, 50.0, True, True)], []), (20.0, [("A", 30.0, 10.0, True, True)], []),
])
def test_band_rules(spark, value, bands, want):
    table = spark.createDataFrame([("m", "crcl", r, lo, hi, li, h) for r, lo, hi, li, h in bands], "med_id string, metric string, rule_id string, lo double, hi double, lo_incl boolean, hi_incl boolean")
    patients = spark.createDataFrame([(1, "m", "crcl", value, False)], "patient_id int, med_id string, metric string, value double, dialysis boolean")
    assert [r.rule_id for r in rules.band_join(patients, table).collect()] == want
    assert rules.band_join(patients.withColumn("dialysis", F.lit(True)), table).count() == 0


def test_condition_trees(spark):
    trees = [{"rule_code": "low", "status": "PUBLISHED", "condition": {"field": "k", "op": "<", "value": 3}}, {"rule_code": "notlow", "status": "PUBLISHED", "priority": 5, "condition": {"not": {"field": "k", "op": "<", "value": 3}}}, {"rule_code": "absent", "status": "PUBLISHED", "condition": {"not": {"field": "zz", "op": "exists"}}}, {"rule_code": "draft", "status": "DRAFT", "condition": {"field": "k", "op": "exists"}}]
    clauses = spark.createDataFrame(rules.compile_conditions(trees), "rule_id string, priority int, clause int, field string, op string, limit double, negate boolean")
    context = spark.createDataFrame([(1, "k", 2.0), (2, "k", 4.0), (3, "na", 140.0)], "patient_id int, field string, value double")
    got = {(r.patient_id, r.rule_id) for r in rules.condition_rules(context, clauses).collect()}
    assert got == {(1, "low"), (2, "notlow"), (3, "notlow"), (1, "absent"), (2, "absent"), (3, "absent")}


def test_pediatric_dose(spark):
    row = spark.createDataFrame([(20.0, "MG_KG_DOSIS", 22.5, None, None, None, 12.0, None, None, None)], "weight double, kind string, dose double, dose_max double, fixed double, divisions double, interval_h double, max_single double, max_day double, max_day_kg double")
    r = measures.pediatric_dose(row).first()
    assert (r.min_mg, r.max_mg, r.daily_max, r.cap_applied) == (450.0, 450.0, 900.0, False)
    assert measures.pediatric_dose(row.withColumn("max_day", F.lit(600.0))).first().max_mg == 300.0


def test_text_and_codes(spark):
    r = one(spark, a=X.fold_text(F.lit("  ÁCIDO  Fólico ")), b=X.packed_codes(F.lit("'L145+Modifier362'; J(111+112+113)"), r"\+Modifier.*$"), c=X.likelihood_positive(F.lit('{"AF": 80}'), ["AF"]), d=X.likelihood_positive(F.lit('{"AF": 79}'), ["AF"]), e=X.parse_number(F.lit(" 3,5 ")), f=X.parse_number(F.lit("x")), g=X.likelihood_positive(F.lit("bad"), ["AF"]), h=X.split_combination(F.lit("A / B Y C"))).first()
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g, r.h) == ("acido folico", ["L145", "J(111+112+113)"], True, False, 3.5, None, False, ["A", "B", "C"])


@pytest.mark.parametrize(("name", "want"), [("ambroxol clorhidrato", "salt"), ("estradiol cipionato", "ester"), ("calcio acetato", "ambiguous"), ("a + b", "combination"), ("plain", "plain")])
def test_identity_triage(spark, name, want):
    assert one(spark, k=link.identity_triage(F.lit(name), ["clorhidrato"], ["cipionato"], ["acetato"])).first().k == want


def test_agreement_of_known_errors(spark):
    df = spark.createDataFrame([("hr", float(v) + 5, float(v)) for v in range(10)] + [("hr", None, 3.0), ("hr", 4.0, None)], "metric string, engine double, comparator double")
    r = score.agreement_metrics(df, ["metric"]).first()
    assert (r.mae, r.bias, r.rmse, r.n_paired, r.n) == (5.0, 5.0, 5.0, 10, 12)
    assert one(spark, a=score.circular_error(F.lit(170.0), F.lit(-170.0)), b=score.circular_error(F.lit(0.0), F.lit(180.0))).first()[:] == (-20.0, -180.0)


def test_checked_join_refuses(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    with pytest.raises(ValueError, match="missing 2|right_repeated 1"):
        score.checked_join(a, b, ["k"])
    assert score.checked_join(a, b.limit(1), ["k"], complete=False).count() == 2


def test_bootstrap_covers_and_needs_records(spark):
    rng = random.Random(3)
    rows = [(i, 1, int(rng.random() < 0.8)) for i in range(600)] + [(1000 + i, 0, int(rng.random() < 0.1)) for i in range(600)]
    df = spark.createDataFrame(rows, "record_id int, y int, p int")
    r = score.bootstrap_ci(df, [], n_boot=300).first()
    assert r.sens_low < 0.8 < r.sens_high and r.sens_high - r.sens_low < 0.12 and r.spec_low < 0.9 < r.spec_high
    assert score.bootstrap_ci(df.limit(10), [], n_boot=50).first().sens_low is None


def test_bootstrap_narrows_with_the_root_of_records(spark):
    wide = {}
    for n in (600, 60_000):
        df = spark.range(2 * n).selectExpr("id AS record_id", "cast(id % 2 AS int) AS y", "cast(if(id % 2 = 1, id % 10 < 8, id % 20 < 2) AS int) AS p")
        r = score.bootstrap_ci(df, [], n_boot=400).first()
        wide[n] = r.sens_high - r.sens_low
        share = df.filter("y = 1").selectExpr("avg(p)").first()[0]
        assert abs(wide[n] / (3.92 * (share * (1 - share) / n) ** 0.5) - 1) < 0.25
    assert 7 < wide[600] / wide[60_000] < 14


def test_poisson_counts_have_their_mean_and_variance(spark):
    for mean in (1, 3, 64, 65, 10_000):
        r = spark.range(4000).select(score.poisson_count(5, F.col("id"), F.lit("x"), F.lit(mean)).alias("k")).selectExpr("avg(k) AS m", "var_samp(k) AS v").first()
        assert abs(r.m - mean) < 5 * (mean / 4000) ** 0.5 and abs(r.v / mean - 1) < 0.15


def test_measurement_states(spark):
    df = spark.createDataFrame([(104.0, 13.0, 0.0), (90.0, 53.0, 0.0), (132.0, 0.0, 1.0), (None, 0.0, 0.0)], "value double, disagreement double, mad double").withColumns({"confidence": F.lit(0.9), "digitizer": F.lit(0.0)})
    rows = consensus.threshold_relation(consensus.measurement_state(consensus.uncertainty_interval(df)), 120.0).collect()
    assert [r.state for r in rows] == ["WITH_UNCERTAINTY", "REMEASURE", "HIGH_CONFIDENCE", "UNMEASURABLE"] and rows[2].relation == "ABOVE" and rows[1].relation == "UNUSABLE"
    box = spark.createDataFrame([(113.0, 125.0, "HIGH_CONFIDENCE")], "low double, high double, state string")
    assert consensus.threshold_relation(box, 120.0).first().relation == "OVERLAPS"


def beats(spark, times, kind):
    return spark.createDataFrame([(1, 2 * x, kind) for x in times], "record_id bigint, t_ms bigint, kind string")


def test_two_to_one_conduction(spark):
    p, r = beats(spark, range(100, 1351, 250), "P"), beats(spark, (175, 675, 1175), "R")
    got = phases.conduction_class(p, r).first()
    assert (got.classification, got.confidence, got.dropped_n) == ("two_to_one", 0.84, 3)
    top = phases.sequence_topology(p, r).first()
    assert (top.evaluable, top.conducted_n, top.dropped_n, top.max_consecutive_drop, top.alternating, top.stable_pr) == (True, 3, 3, 1, True, True)
    assert top.dropped_rr_phase_n == 2 and top.dropped_rr_phase_mid_n == 2 and top.dropped_rr_phase_median == pytest.approx(0.35)


def test_wenckebach_and_complete_block(spark):
    steps, p, r = (160, 200, 260, None, 160, 200, 260, None), [], []
    for k, d in enumerate(steps):
        p.append(400 * k)
        r += [400 * k + d // 2 * 2] if d else []
    p, r = beats(spark, [x // 2 for x in p], "P"), beats(spark, [x // 2 for x in r], "R")
    assert phases.sequence_topology(p, r).first().progressive_pr
    assert phases.conduction_class(p, r).first().classification == "wenckebach"
    p, r = beats(spark, [300 * k for k in range(20)], "P"), beats(spark, [37 + 437 * k for k in range(13)], "R")
    got, relation = phases.conduction_class(p, r).first(), phases.harmonic_period(p, r).first()
    assert got.classification == "complete_block"
    assert relation.complete_block and relation.period == 600 and relation.atrial_rate == 100 and relation.faster


def test_ring_is_cut_at_its_largest_gap(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    rings = [[990.0, 5.0, 995.0], [0.0, 500.0], [10.0], [250.0, 250.0, 750.0], [0.0, 250.0, 500.0, 750.0], *[rng.uniform(0, 1000, n).round(3).tolist() for n in (3, 8, 40)]]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(rings)], "k int, v array<double>").select("k", phases.cut_ring(F.col("v"), F.lit(1000.0)).alias("ring")).withColumns({"mad": phases.mad(F.col("ring")), "span": phases.spread(F.col("ring"))})
    for row in df.collect():
        s = np.sort(rings[row.k])
        at = int(np.argmax(np.diff(np.r_[s, s[0] + 1000]).round(6)))
        want = np.r_[s[at + 1 :], s[: at + 1] + 1000]
        assert row.ring == pytest.approx(want.tolist()) and row.span == pytest.approx(want.max() - want.min())
        assert row.mad == pytest.approx(np.median(np.abs(want - np.median(want))))
    assert df.filter("k = 0").first().span == 15


def test_events_too_few_to_judge(spark):
    p, r = beats(spark, (1, 2, 3), "P"), beats(spark, (5, 6), "R")
    got = phases.harmonic_period(p, r).first()
    assert (got.evaluable, got.event_n, got.period, got.complete_block) == (False, 3, None, False)
    top = phases.sequence_topology(p, r).first()
    assert (top.evaluable, top.p_n, top.r_n, top.conducted_n) == (False, 3, 2, None)
    none = p.limit(0)
    assert phases.sequence_topology(none, none).count() == phases.conduction_class(none, r).count() == phases.harmonic_period(none, r).count() == 0
    late = phases.harmonic_period(beats(spark, (0, 5000, 11000), "P"), beats(spark, (5, 6, 9), "R")).first()
    assert (late.evaluable, late.period, late.harmonic_consistent) == (True, None, False)


def test_rounds_give_the_greedy_match(spark):
    import numpy as np

    rng, rows = np.random.default_rng(9), {"a": [], "b": []}
    for record in range(30):
        for side in rows:
            rows[side] += [(record, int(t)) for t in rng.integers(0, 400 if record % 2 else 60, rng.integers(0, 60))]
    a, b = (spark.createDataFrame(rows[s], "record_id bigint, t_ms bigint") for s in "ab")
    matched = events.tolerance_match(a, b, 25).collect()
    want = []
    for record in range(30):
        own = {s: sorted(t for r, t in rows[s] if r == record) for s in "ab"}
        used_a, used_b = set(), set()
        for e, i, j in sorted((abs(x - y), i, j) for i, x in enumerate(own["a"]) for j, y in enumerate(own["b"]) if abs(x - y) <= 25):
            if i not in used_a and j not in used_b:
                used_a.add(i)
                used_b.add(j)
                want.append((record, own["a"][i], own["b"][j], e))
    assert sorted((r.record_id, r.a_ms, r.b_ms, r.error) for r in matched) == sorted(want)
    assert 1 < max(r["round"] for r in matched) <= 3 * np.log2(len(rows["a"]))
    plan = events.tolerance_match(a, b, 25)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    times = np.cumsum([60 - k for k in range(24)]).tolist()  # every pair waits for the next one
    a, b = (spark.createDataFrame([(1, int(t)) for t in times[k::2]], "record_id bigint, t_ms bigint") for k in (0, 1))
    assert events.tolerance_match(a, b, 60).count() == 12


def test_greedy_match_takes_shortest_first(spark):
    a, b = beats(spark, (100, 110), "t"), beats(spark, (108, 125), "d")
    got = sorted((r.a_ms, r.b_ms) for r in events.tolerance_match(a, b, 60).collect())
    assert got == [(200.0, 250.0), (220.0, 216.0)]
    r = events.match_counts(a, b.limit(1), 60).first()
    assert (r.matched, r.missed, r.extra) == (1, 1, 0)


def test_exact_and_gap_clusters_agree_when_apart(spark):
    rows = [(1, t + d, k) for t in (0, 1000, 2000, 3000) for d, k in ((0, "I"), (10, "II"), (20, "V1"))]
    df = spark.createDataFrame(rows, "record_id bigint, t_ms bigint, kind string")
    both = [sorted((r.channels, r.t_ms, r.spread) for r in f(df, 36, 2).collect()) for f in (events.gap_clusters, events.exact_clusters)]
    assert both[0] == both[1] and len(both[0]) == 4


def test_cohorts_are_blind_to_order(spark):
    rows = [(s, f"r{k}", s % 3) for s in range(30) for k in range(2)]
    df = spark.createDataFrame(rows, "patient_id int, record_id string, site int")
    picks = [sorted(r.patient_id for r in cohort.hash_cohort(d, "patient_id", "x", 10).collect()) for d in (df, df.orderBy(F.desc("patient_id")).repartition(7))]
    assert picks[0] == picks[1] and len(set(picks[0])) == 10
    assert cohort.one_per_patient(df, "patient_id", "record_id", "n").count() == 30


def test_merges(spark):
    t, s = spark.createDataFrame([(1, "a", 5), (2, "b", 9)], "k int, v string, rank int"), spark.createDataFrame([(2, "c", 1), (3, "d", 1)], "k int, v string, rank int")
    keep = merge.upsert_table(t, s, ["k"], C("s.rank") >= C("t.rank"))
    assert {tuple(r) for r in keep.collect()} == {(1, "a", 5), (2, "b", 9), (3, "d", 1)}
    assert {r.v for r in merge.upsert_table(t, s, ["k"]).collect()} == {"a", "c", "d"}
    assert merge.insert_if_absent(t, s, ["k"]).count() == 3


def test_readers_and_sinks(spark, tmp_path):
    schema = StructType([StructField("med_id", LongType()), StructField("name", StringType()), StructField("extra", StringType())])
    (tmp_path / "c.csv").write_bytes("﻿med_id,name\n1,Ácido\n".encode())
    assert readers.read_catalog(spark, str(tmp_path / "c.csv"), schema).collect() == [(1, "Ácido", None)]
    assert readers.read_catalog(spark, str(tmp_path / "none.csv"), schema, optional=True).count() == 0
    with pytest.raises(KeyError, match="no column for x"):
        readers.resolve_columns(spark.range(1), {"x": ["y"]})
    (tmp_path / "l.json").write_text('{"results": [{"id": "a", "effective_time": "20240101", "pregnancy": ["p", "q"]}, {"id": "b", "effective_time": "2", "pregnancy": "s"}, {"id": "c"}]}')
    assert {(r.id, tuple(r.pregnancy)) for r in readers.read_label_documents(spark, str(tmp_path / "l.json"), ["pregnancy"]).collect()} == {("a", ("p", "q")), ("b", ("s",))}
    for k in range(2):
        (tmp_path / f"shard{k}.csv").write_text(f"record_id,p\n00{k},1\n")
    shards = readers.read_prediction_shards(spark, str(tmp_path / "shard*.csv"), ["record_id"]).collect()
    assert {r.record_id for r in shards} == {"000", "001"} and all("shard" in r.shard_file for r in shards)
    readers.write_audit_outputs(spark.createDataFrame([(1, "x"), (2, None)], "k int, reason string"), str(tmp_path / "audit"), "reason")
    assert {(r.k, r.reason) for r in spark.read.parquet(str(tmp_path / "audit")).collect()} == {(1, "x"), (2, "none")}


def test_stream_equals_batch_in_any_order(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.randint(0, 5), rng.randint(0, 1000), i) for i in range(120)]
    schema = "k int, at int, v int"
    for k in range(4):
        spark.createDataFrame(rows[k::4], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = streams.upsert_stream_result(spark, str(tmp_path / "in"), ["k"], ["v"], "at", "v")
    want = streams.latest(spark.createDataFrame(rows, schema), ["k"], ["v"], "at", "v").select("k", "v")
    assert sorted(got.collect()) == sorted(want.collect())


def test_learning_never_scores_what_it_has_seen(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(10 * k + i, [float(i % 2), 1.0], i % 2) for i in range(6)] + [(0, [0.0, 1.0], 0)], "vec_id bigint, embedding array<double>, label int").coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    rows = streams.evaluate_before_learn(spark, str(tmp_path / "e")).collect()
    assert len(rows) == len({r.vec_id for r in rows}) == 18
    assert all(r.correct for r in rows if r.version >= 0) and sum(r.version == -1 for r in rows) in (6, 7)


def test_no_cross_products_in_plans(spark, sf_dir):
    from cohortlens import catalogue

    for name in ("j05_fuzzy_candidates", "j16_tolerance_match_candidates", "j09_band_join", "j18_interval_exclusion", "w01_hash_cohort", "a04_agreement_metrics"):
        plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_known_blood_gases(spark):
    gases = [(7.20, 60.0, 24.0), (7.20, 30.0, 11.0), (7.50, 30.0, 23.0), (7.50, 48.0, 36.0), (7.10, 50.0, 15.0), (7.40, 50.0, 30.0), (7.38, 50.0, 30.0), (7.42, 50.0, 30.0), (7.40, 40.0, 24.0), (7.36, 30.0, 18.0), (7.30, 60.0, 31.0), (7.40, 50.0, 20.0), (None, 40.0, 24.0)]
    rows = measures.acid_base_class(spark.createDataFrame(gases, "ph double, pco2 double, hco3 double")).collect()
    assert [r.primary for r in rows] == ["RESP_ACIDOSIS", "MET_ACIDOSIS", "RESP_ALKALOSIS", "MET_ALKALOSIS", "RESP_ACIDOSIS+MET_ACIDOSIS", "RESP_ACIDOSIS_OR_MET_ALKALOSIS", "RESP_ACIDOSIS", "MET_ALKALOSIS", "NONE", "MET_ACIDOSIS", "RESP_ACIDOSIS", "RESP_ACIDOSIS", None]
    assert [r.chronicity for r in rows][:3] == ["ACUTE", None, "ACUTE"] and rows[10].chronicity == "CHRONIC"
    assert rows[1].second == "RESP_ACIDOSIS" and rows[4].second is None


def test_a_patient_given_twice_keeps_the_one_rule(spark):
    p = spark.createDataFrame([(1, 7, "crcl", 20.0, False)] * 2 + [(2, 7, "crcl", 20.0, False), (3, 7, "crcl", 30.0, False)], "patient_id int, med_id int, metric string, value double, dialysis boolean")
    r = spark.createDataFrame([(7, "crcl", 1, None, 30.0, True, True), (7, "crcl", 2, 30.0, None, True, True)], "med_id int, metric string, rule_id int, lo double, hi double, lo_incl boolean, hi_incl boolean")
    assert sorted(map(tuple, rules.band_join(p, r).collect())) == [(1, 7, 1), (1, 7, 1), (2, 7, 1)]


def test_conditions_of_negations_alone_ask_about_everybody(spark):
    tree = [{"rule_code": "none", "status": "PUBLISHED", "condition": {"not": {"field": "a", "op": "exists"}}}, {"rule_code": "both", "status": "PUBLISHED", "condition": {"all": [{"field": "a", "op": ">", "value": 1}, {"not": {"field": "b", "op": "<", "value": 5}}]}}]
    clauses = spark.createDataFrame(rules.compile_conditions(tree), "rule_id string, priority int, clause int, field string, op string, limit double, negate boolean")
    context = spark.createDataFrame([(1, "a", 2.0), (2, "b", 1.0), (3, "a", 2.0), (3, "b", 1.0), (4, "a", 2.0), (4, "b", 9.0)], "patient_id int, field string, value double")
    assert sorted((r.patient_id, r.rule_id) for r in rules.condition_rules(context, clauses).collect()) == [(1, "both"), (2, "none"), (4, "both")]


def test_difflib_ranks_by_its_own_ratio(spark):
    from difflib import SequenceMatcher

    names = ["red bolt", "bolt red", "red bold", "red belt long", "rod bolt", "blue bolt", "red bolts", "bolt"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = link.fuzzy_candidates(df, df, link.difflib_ratio).collect()
    for n in names:
        near = sorted(((-round(SequenceMatcher(None, n, c).ratio(), 4), c) for c in names if c != n and set(n.split()) & set(c.split())))[:5]
        assert [(r.candidate, r["rank"]) for r in sorted((r for r in got if r.name == n), key=lambda r: r["rank"])] == [(c, k + 1) for k, (_, c) in enumerate(near)]


def test_searches_by_id_alias_and_token(spark):
    cat = spark.createDataFrame([(101, "Ácido fólico", ["B9", None]), (202, "Warfarin", ["Coumadin"])], "med_id long, generic_name string, aliases array<string>")
    q = lambda *x: spark.createDataFrame([(v,) for v in x], "query string")
    assert {(r.query, r.med_id) for r in link.catalogue_search(q("acido", "20", "b9", "coum", "zz"), cat, ["med_id", "generic_name", "aliases"]).collect()} == {("acido", 101), ("20", 202), ("b9", 101), ("coum", 202)}
    names = cat.select(C("generic_name").alias("name"), "aliases")
    assert {(r.query, r.name, r.how) for r in link.literal_then_fuzzy(q("xoumadin", "folicc", "warf"), names, ["name", "aliases"], ["name", "aliases"]).collect()} == {("xoumadin", "warfarin", "fuzzy"), ("folicc", "acido folico", "fuzzy"), ("warf", "warfarin", "literal")}


def test_lead_picks(spark):
    rows = [(1, "II", True, 5.0, 5, 0.1), (1, "V1", True, 60.0, 60, 1.0), (2, "II", True, 4.0, 9, 1.0), (2, "V1", True, 10.0, 4, 0.9), (2, "V2", True, 99.0, 3, 1.0), (3, "II", False, 9.0, 9, 1.0), (4, "V5", True, 1.0, 4, None), (4, "V6", True, 1.0, 4, None)]
    df = spark.createDataFrame(rows, "record_id int, lead string, evaluable boolean, duration_s double, r_count int, confidence double")
    assert {(r.record_id, r.lead) for r in events.rhythm_lead_pick(df).collect()} == {(1, "II"), (2, "V1"), (4, "V6")}
    rows = [(1, "II", 4, 3, 0.5, False, 0.0, 0.0), (1, "V1", 9, 9, 0.1, True, 0.5, 0.9), (2, "II", 5, 5, None, False, 0.2, 0.2), (2, "aVF", 5, 5, None, False, 0.2, 0.2), (3, "II", 3, 3, 0.1, True, 1.0, 1.0), (4, "X", 9, 9, 0.1, True, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "record_id int, lead string, p_count int, r_count int, pp_cv double, reproducible boolean, coupling double, confidence double").withColumn("evaluable", F.lit(True))
    got = {r.record_id: (r.lead, r.score) for r in events.conduction_lead_pick(df, ["II", "V1", "aVF"]).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "V1", 2: "II"} and abs(got[1][1] - (40 + 25 + 9 + 4 + 9 + 4.5 + 4 / 3)) < 1e-9


def test_templates_are_found_under_a_shift(spark):
    wave = [float((i * 7) % 13) for i in range(30)]
    rows = [(1, "I", wave), (2, "I", wave[1:] + [0.0]), (3, "II", wave)]
    waves = spark.createDataFrame(rows, "record_id int, lead string, wave array<double>")
    templates = spark.createDataFrame([("same", "I", wave), ("same", "II", wave), ("flat", "I", [1.0] * 30)], "template string, lead string, wave array<double>")
    got = {(r.record_id, r.template): (r.visual, r.coverage) for r in events.template_scores(waves, templates, [(0, 30, 1.0)], 1).collect()}
    assert abs(got[1, "same"][0] - 0.85) < 1e-6 and got[1, "same"][1] == 0.5 and got[2, "same"][0] > 0.84 and got[1, "flat"][0] is None
    still = {(r.record_id, r.template): r.visual for r in events.template_scores(waves, templates, [(0, 30, 1.0)], 0).collect()}
    assert still[2, "same"] < 0.8
    fused = spark.createDataFrame([(1, "a", 1.0, 0.8, None, 0.6), (1, "b", 0.1, 0.9, 0.2, 0.6), (1, "c", None, None, None, 0.0), (1, "d", None, 0.8, None, 0.5)], "record_id int, template string, criteria double, visual double, measurement double, coverage double")
    got = {r.template: (r.fusion, r.status, r["rank"]) for r in events.fused_rank(fused, 4).collect()}
    assert {k: v[1] for k, v in got.items()} == {"a": "CONCORDANT_HIGH", "b": "VISUAL_MATCH_WITHOUT_CRITERIA", "c": "NO_VALORABLE", "d": "VISUAL_ONLY_NO_RULE"}
    assert abs(got["a"][0] - (0.45 + 0.28) / 0.8) < 1e-9 and got["c"][2] == 4


def test_a_stream_goes_on_and_writes_only_its_rows(spark, tmp_path):
    folder, home = str(tmp_path / "in"), f"file://{tmp_path}/home"
    write = lambda rows: spark.createDataFrame(rows, "k int, at int, v int").coalesce(1).write.mode("append").parquet(folder)
    run = lambda: sorted(map(tuple, streams.upsert_stream_result(spark, folder, ["k"], ["v"], "at", "v", home).collect()))
    write([(k, 5, k) for k in range(40)])
    assert run() == [(k, k) for k in range(40)]
    assert run() == [(k, k) for k in range(40)]  # no new files
    write([(3, 4, 100), (7, 6, 100)])
    assert run() == [(k, 100 if k == 7 else k) for k in range(40)]
    assert spark.read.parquet(f"{home}/batches").count() == 2
    assert spark.read.parquet(f"{home}/delta/1").count() == 2
    assert [tuple(r) for r in spark.read.schema("number bigint, n bigint").parquet(f"{home}/bases").select("number", "n").collect()] == [(0, 40)]
