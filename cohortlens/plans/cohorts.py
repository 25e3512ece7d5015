"""Cohort queries: W1-W6, J20, A12, G1, G2."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.operators import cohort
from cohortlens.plans.registry import query


@query("w01_hash_cohort", "SELECT patient_id, sha256('study|' || patient_id) AS hash FROM (SELECT DISTINCT patient_id FROM coh) ORDER BY 2, 1 LIMIT 200")
def _(t):
    return cohort.hash_cohort(t.coh, "patient_id", "study", 200)


@query("w01_hash_cohort_by_site", "SELECT site, patient_id, hash FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY hash, patient_id) AS r FROM (SELECT DISTINCT site, patient_id, sha256('study|' || patient_id) AS hash FROM coh)) WHERE r <= 10")
def _(t):
    return cohort.hash_cohort(t.coh, "patient_id", "study", 10, ["site"])


@query("w02_one_per_patient", "SELECT patient_id, record_id FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY sha256('rec|' || record_id), record_id) AS r FROM coh) WHERE r = 1")
def _(t):
    return cohort.one_per_patient(t.coh, "patient_id", "record_id", "rec")


@query("w03_enriched_cohort", "WITH gold AS (SELECT record_id, max(y) AS y FROM pred WHERE target = 'toxic' GROUP BY 1), r AS (SELECT DISTINCT record_id FROM pred), g AS (SELECT record_id FROM r ORDER BY sha256('e-general|' || record_id), record_id LIMIT 60), c AS (SELECT record_id FROM gold WHERE y = 0 ORDER BY sha256('e-control|' || record_id), record_id LIMIT 40), u AS (SELECT record_id, 'g' AS m FROM g UNION ALL SELECT record_id, 'p' FROM gold WHERE y = 1 UNION ALL SELECT record_id, 'c' FROM c) SELECT record_id, bool_or(m = 'g') AS is_general, bool_or(m = 'p') AS is_positive, bool_or(m = 'c') AS is_control FROM u GROUP BY 1")
def _(t):
    gold = t.pred.filter("target = 'toxic'").select("record_id", "y")
    return cohort.enriched_cohort(t.pred.select("record_id"), gold, "e", 60, 40)


@query("w04_shard_assign", "SELECT CAST(('0x' || substr(sha256('sh|' || record_id), 1, 8))::BIGINT % 16 AS INT) AS shard, count(*) AS n FROM coh GROUP BY 1")
def _(t):
    return cohort.shard_assign(t.coh, "record_id", "sh", 16).groupBy("shard").agg(F.count("*").alias("n"))


@query("w05_balanced_development_selection", "SELECT arm, record_id, CAST(rank AS INT) AS rank FROM (SELECT arm, record_id, row_number() OVER (PARTITION BY arm ORDER BY sha256('dev|' || record_id), record_id) AS rank FROM (SELECT record_id, CASE WHEN code IN ('1-URGENT', '2-HIGH') THEN code ELSE 'control' END AS arm FROM coh WHERE fold <= 8)) WHERE rank <= CASE WHEN arm = 'control' THEN 400 ELSE 80 END")
def _(t):
    records = t.coh.withColumn("target", F.when(F.col("code").isin("1-URGENT", "2-HIGH"), F.col("code")))
    return cohort.balanced_selection(records, list(range(1, 9)), "dev")


@query("w06_stage_loss_cases", "SELECT record_id, sha256('loss|' || record_id) AS hash FROM pred WHERE target = 'quality' AND y = 1 AND fusion = 1 AND final = 0 ORDER BY 2, 1 LIMIT 25")
def _(t):
    return cohort.stage_loss_cases(t.pred, "quality", "final", "fusion", 25, "loss")


@query("j20_holdout_anti_join", "WITH h AS (SELECT DISTINCT o_orderkey AS record_id FROM orders WHERE o_orderstatus = 'P') SELECT o_orderkey AS record_id, (SELECT count(*) FROM h) AS n_removed FROM orders WHERE o_orderkey NOT IN (SELECT record_id FROM h)")
def _(t):
    records = t.orders.select(F.col("o_orderkey").alias("record_id"))
    return cohort.holdout_anti_join(records, t.orders.filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("record_id")), "record_id")


@query("a12_uniqueness_report", "WITH k AS (SELECT 'patient' AS key_set, CAST(patient_id AS VARCHAR) AS v FROM coh UNION ALL SELECT 'record', CAST(record_id AS VARCHAR) FROM coh UNION ALL SELECT 'site_code', site || '|' || code FROM coh), c AS (SELECT key_set, v, count(*) AS n FROM k GROUP BY ALL HAVING count(*) > 1) SELECT key_set, count(*) AS n_repeated_keys, CAST(sum(n) AS BIGINT) AS n_rows FROM c GROUP BY 1")
def _(t):
    return cohort.uniqueness_report(t.coh, {"patient": ["patient_id"], "record": ["record_id"], "site_code": ["site", "code"]})


# Datasets from 22 on are not registered: uses of an unknown dataset are one of the refusals.
@query("g01_provenance_guard", "WITH reg AS (SELECT n_nationkey AS dataset, n_nationkey % 3 = 0 AS v, n_nationkey % 4 = 1 AS tu, n_nationkey % 5 = 1 AS fr, (n_nationkey + 1) % 25 AS ov FROM nation WHERE n_nationkey < 22), u AS (SELECT n_nationkey AS dataset, CASE WHEN n_nationkey % 2 = 0 THEN 'validation' ELSE 'tuning' END AS role FROM nation), h AS (SELECT u.dataset, role, reg.dataset AS known, v, tu, fr, ov FROM u LEFT JOIN reg ON u.dataset = reg.dataset) SELECT dataset, 'unknown_dataset' AS problem FROM h WHERE known IS NULL UNION ALL SELECT dataset, 'validation_refused' FROM h WHERE role = 'validation' AND NOT coalesce(v, false) UNION ALL SELECT dataset, 'tuning_refused' FROM h WHERE role = 'tuning' AND NOT coalesce(tu, false) UNION ALL SELECT dataset, 'frozen_but_tunable' FROM h WHERE coalesce(tu, false) AND coalesce(fr, false) UNION ALL SELECT h.dataset, 'overlaps_' || u.dataset FROM h JOIN u ON h.ov = u.dataset AND h.role <> u.role")
def _(t):
    k = F.col("n_nationkey")
    registry = t.nation.filter("n_nationkey < 22").select(k.alias("dataset"), F.lit("listed").alias("status"), (k % 3 == 0).alias("external_validation_allowed"), (k % 4 == 1).alias("allow_tuning"), (k % 5 == 1).alias("frozen"), F.array((k + 1) % 25).alias("overlaps"))
    return cohort.provenance_violations(registry, t.nation.select(k.alias("dataset"), F.expr("case when n_nationkey % 2 = 0 then 'validation' else 'tuning' end").alias("role")))


@query("g02_panel_contract", "WITH p AS (SELECT o_orderkey AS record_id, CASE WHEN o_orderkey % 5 = 0 THEN 'control' ELSE 'positive' END AS role, o_orderkey % 10 + 1 AS fold FROM orders WHERE o_orderpriority = '1-URGENT'), c AS (SELECT count(*) AS n, count(DISTINCT record_id) AS ids, count(*) FILTER (fold > 8) AS bad, count(*) FILTER (role = 'positive') AS pos, count(*) FILTER (role = 'control') AS con FROM p) SELECT 'size' AS check_name, n = 3000 AS ok, n AS found FROM c UNION ALL SELECT 'unique', n = ids, ids FROM c UNION ALL SELECT 'folds', bad = 0, bad FROM c UNION ALL SELECT 'present', true, 0 FROM c UNION ALL SELECT 'role_positive', pos = 2400, pos FROM c UNION ALL SELECT 'role_control', con = 600, con FROM c")
def _(t):
    panel = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("record_id"), F.expr("case when o_orderkey % 5 = 0 then 'control' else 'positive' end").alias("role"))
    return cohort.panel_contract(panel, t.coh, 3000, {"positive": 2400, "control": 600}, list(range(1, 9)))


_PANEL = "p AS (SELECT o_orderkey AS record_id, CASE o_orderkey % 7 WHEN 0 THEN 'NEGATIVE_CONTROL' WHEN 1 THEN 'NO_SUCH' ELSE 'POSITIVE' END AS role, CASE WHEN o_orderkey % 7 > 1 THEN CASE o_orderkey % 3 WHEN 0 THEN 'urgent' WHEN 1 THEN 'low' ELSE 'other' END END AS target FROM orders WHERE o_orderstatus <> 'P'), r AS (SELECT o_orderkey AS record_id, o_orderkey % 10 + 1 AS fold, o_custkey % 95 + 1 AS age, o_orderpriority AS code FROM orders WHERE o_orderstatus <> 'O')"


@query("g02_panel_labels", f"WITH {_PANEL}, h AS (SELECT p.*, fold, age, code, r.record_id IS NOT NULL AS there, CASE target WHEN 'urgent' THEN ['1-URGENT', '2-HIGH'] WHEN 'low' THEN ['5-LOW'] END AS wanted FROM p LEFT JOIN r ON r.record_id = p.record_id), x AS (SELECT record_id, role, target, unnest([CASE WHEN NOT there THEN 'missing_record' END, CASE WHEN there AND fold > 8 THEN 'forbidden_fold' END, CASE WHEN age < 18 THEN 'pediatric' END, CASE WHEN role = 'POSITIVE' AND wanted IS NULL THEN 'unknown_target' END, CASE WHEN there AND role = 'POSITIVE' AND NOT list_contains(wanted, code) THEN 'target_no_longer_true' END, CASE WHEN role = 'NEGATIVE_CONTROL' AND code IN ('1-URGENT', '2-HIGH', '5-LOW') THEN 'control_matches_target' END, CASE WHEN role NOT IN ('POSITIVE', 'NEGATIVE_CONTROL') THEN 'unsupported_role' END]) AS problem FROM h) SELECT * FROM x WHERE problem IS NOT NULL")
def _(t):
    k = F.col("o_orderkey")
    role = F.when(k % 7 == 0, "NEGATIVE_CONTROL").when(k % 7 == 1, "NO_SUCH").otherwise("POSITIVE")
    target = F.when(k % 7 > 1, F.when(k % 3 == 0, "urgent").when(k % 3 == 1, "low").otherwise("other"))
    panel = t.orders.filter("o_orderstatus <> 'P'").select(k.alias("record_id"), role.alias("role"), target.alias("target"))
    known = t.orders.filter("o_orderstatus <> 'O'")
    records = known.select(k.alias("record_id"), (k % 10 + 1).alias("fold"), (F.col("o_custkey") % 95 + 1).alias("age"))
    codes = known.select(k.alias("record_id"), F.col("o_orderpriority").alias("code"))
    return cohort.panel_violations(panel, records, codes, {"urgent": ["1-URGENT", "2-HIGH"], "low": ["5-LOW"]}, list(range(1, 9)))
