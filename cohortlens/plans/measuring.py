"""Queries of derived measures: F1-F13, F17, F19."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.operators import measures as M
from cohortlens.plans.registry import query

C = F.col
_R = lambda *names: ", ".join(f"round({n}, 6) AS {n}" for n in names)


@query("f01_renal_function", f"""WITH p AS (SELECT patient_id, age, female, CASE WHEN weight > 0 THEN weight END AS w, height, CASE WHEN creat > 0 THEN creat END AS cr FROM pats),
q AS (SELECT *, cr / CASE WHEN female THEN 0.7::DOUBLE ELSE 0.9::DOUBLE END AS r FROM p),
s AS (SELECT patient_id, CASE WHEN age >= 18 AND r IS NOT NULL THEN 142 * pow(CASE WHEN r < 1 THEN r ELSE 1 END, CASE WHEN female THEN -0.241 ELSE -0.302 END) * pow(CASE WHEN r > 1 THEN r ELSE 1 END, -1.2) * pow(0.9938, age) * CASE WHEN female THEN 1.012 ELSE 1 END END AS ckd_epi, (140 - age) * w / (72 * cr) * CASE WHEN female THEN 0.85 ELSE 1 END AS crcl, 0.413 * height / cr AS schwartz, sqrt(height * w / 3600) AS bsa FROM q)
SELECT patient_id, {_R('ckd_epi', 'crcl', 'schwartz', 'bsa')}, round(crcl * 1.73 / bsa, 6) AS crcl_173, CASE WHEN crcl < 10 THEN '<10' WHEN crcl < 30 THEN '10-29' WHEN crcl < 60 THEN '30-59' WHEN crcl IS NOT NULL THEN '>=60' END AS band FROM s""")
def _(t):
    return M.renal_function(t.pats).select("patient_id", "ckd_epi", "crcl", "schwartz", "bsa", "crcl_173", "band")


_DOSE = "SELECT l_orderkey AS record_id, l_linenumber AS line_no, CAST(l_quantity AS DOUBLE) AS weight, CASE l_linenumber % 5 WHEN 0 THEN 'MG_KG_DOSIS' WHEN 1 THEN 'MG_KG_DOSIS_RANGE' WHEN 2 THEN 'MG_KG_DIA' WHEN 3 THEN 'MG_KG_DIA_RANGE' ELSE 'FIJA' END AS kind, l_discount * 100 AS dose, CASE WHEN l_tax > 0 THEN l_discount * 100 + 5 END AS dose_max, l_extendedprice / 50 AS fixed, CAST(l_orderkey % 4 AS DOUBLE) AS divisions, CASE WHEN l_orderkey % 3 > 0 THEN 12.0 END AS interval_h, CASE WHEN l_orderkey % 2 = 0 THEN 200.0 END AS max_single, CASE WHEN l_orderkey % 5 = 0 THEN 500.0 END AS max_day, CASE WHEN l_orderkey % 7 = 0 THEN 15.0 END AS max_day_kg FROM lineitem"


@query("f02_pediatric_dose", f"""WITH d AS ({_DOSE}), n AS (SELECT *, coalesce(nullif(divisions, 0), 1) AS div, CASE WHEN kind LIKE '%RANGE' THEN coalesce(dose_max, dose) ELSE dose END AS hi FROM d),
r AS (SELECT *, CASE WHEN kind LIKE 'MG_KG_DIA%' THEN div ELSE coalesce(24 / interval_h, 1) END AS n_day, CASE WHEN kind LIKE 'MG_KG_DOSIS%' THEN dose * weight WHEN kind = 'FIJA' THEN fixed ELSE dose * weight / div END AS lo0, CASE WHEN kind LIKE 'MG_KG_DOSIS%' THEN hi * weight WHEN kind = 'FIJA' THEN fixed ELSE hi * weight / div END AS hi0, least(max_day, max_day_kg * weight) AS cap_day FROM n),
c AS (SELECT *, least(lo0, max_single, cap_day / n_day) AS lo, least(hi0, max_single, cap_day / n_day) AS hi1 FROM r)
SELECT record_id, line_no, weight, round(lo, 6) AS min_mg, round(hi1, 6) AS max_mg, round(lo * n_day, 6) AS daily_min, round(hi1 * n_day, 6) AS daily_max, lo < lo0 OR hi1 < hi0 AS cap_applied FROM c""")
def _(t):
    return M.pediatric_dose(t.spark.sql(_DOSE.replace("FROM lineitem", "FROM {lineitem}"), lineitem=t.lineitem)).select("record_id", "line_no", "weight", "min_mg", "max_mg", "daily_min", "daily_max", "cap_applied")


@query("f03_exposure_ratio", "SELECT l_orderkey AS k, l_linenumber AS n, round(l_extendedprice / l_quantity, 9) AS mg_kg, round(l_extendedprice / l_quantity / nullif(l_tax * 1000, 0), 9) AS ratio FROM lineitem", places=9)
def _(t):
    return M.exposure_ratio(t.lineitem.select(C("l_orderkey").alias("k"), C("l_linenumber").alias("n"), C("l_extendedprice").alias("dose_mg"), C("l_quantity").alias("weight"), (C("l_tax") * 1000).alias("threshold"))).select("k", "n", "mg_kg", "ratio")


@query("f04_unit_harmonise", "SELECT event_id, analyte, unit, value, round(value * CASE unit WHEN 'mmol/L' THEN 1 WHEN 'mEq/L' THEN CASE analyte WHEN 'NA' THEN 1 WHEN 'MG' THEN 0.5 WHEN 'CA' THEN 0.5 END WHEN 'mg/dL' THEN CASE analyte WHEN 'MG' THEN 10 / 24.305 WHEN 'CA' THEN 10 / 40.078 WHEN 'P' THEN 10 / 30.973761998 END END, 6) AS mmol_l, CASE WHEN (unit = 'mEq/L' AND analyte = 'P') OR (unit = 'mg/dL' AND analyte = 'NA') THEN 'unit_not_supported' END AS reason FROM (SELECT event_id, value, CASE event_id % 4 WHEN 0 THEN 'NA' WHEN 1 THEN 'MG' WHEN 2 THEN 'CA' ELSE 'P' END AS analyte, CASE user_id % 3 WHEN 0 THEN 'mmol/L' WHEN 1 THEN 'mEq/L' ELSE 'mg/dL' END AS unit FROM events)")
def _(t):
    labs = t.events.select("event_id", "value", F.expr("case event_id % 4 when 0 then 'NA' when 1 then 'MG' when 2 then 'CA' else 'P' end").alias("analyte"), F.expr("case user_id % 3 when 0 then 'mmol/L' when 1 then 'mEq/L' else 'mg/dL' end").alias("unit"))
    return M.unit_harmonise(labs, t.spark.createDataFrame(M.lab_units(), "analyte string, unit string, factor double"))


def plans(t):
    src = t.lineitem.select((C("l_orderkey") * 10 + C("l_linenumber")).alias("plan_id"), C("l_quantity").alias("target_mmol"), (C("l_discount") * 20 + 0.2).alias("product_mmol_ml"), F.lit(100.0).alias("container_ml"), (C("l_tax") * 100).alias("hours"), F.expr("case l_linenumber % 3 when 0 then 'ADD_TO_BAG' when 1 then 'REPLACE_EQUAL_VOLUME' else 'FINAL_VOLUME' end").alias("mode"), F.lit(2).alias("valence"), F.lit(10.0).alias("ampoule_ml"))
    return M.infusion_plan(src)


_PLAN = "WITH s AS (SELECT l_orderkey * 10 + l_linenumber AS plan_id, l_quantity AS tm, l_quantity / (l_discount * 20 + 0.2) AS conc, l_tax * 100 AS hours, l_linenumber % 3 = 0 AS added FROM lineitem), f AS (SELECT *, added OR conc <= 100 AS ok FROM s), v AS (SELECT plan_id, tm, CASE WHEN ok THEN conc END AS concentrate_ml, CASE WHEN ok THEN CASE WHEN added THEN 100 ELSE 100 - conc END END AS diluent_ml, CASE WHEN ok THEN CASE WHEN added THEN 100 + conc ELSE 100 END END AS final_ml, CASE WHEN hours > 0 THEN hours END AS h FROM f), p AS (SELECT *, tm / final_ml * 1000 AS mmol_l, final_ml / h AS rate_ml_h FROM v) "


@query("f05_infusion_plan", _PLAN + f"SELECT plan_id, {_R('concentrate_ml', 'diluent_ml', 'final_ml', 'mmol_l', 'rate_ml_h')}, coalesce(CAST(ceil(concentrate_ml / 10) AS BIGINT), 0) AS ampoules, round(mmol_l * 2, 6) AS meq_l, round(mmol_l * rate_ml_h / 1000, 6) AS rate_mmol_h, round(mmol_l * 2 * rate_ml_h / 1000, 6) AS rate_meq_h FROM p")
def _(t):
    return plans(t).fillna(0, ["ampoules"]).select("plan_id", "concentrate_ml", "diluent_ml", "final_ml", "mmol_l", "rate_ml_h", "ampoules", "meq_l", "rate_mmol_h", "rate_meq_h")


@query("f06_limit_check", _PLAN + ", c AS (SELECT plan_id, max(mmol_l) AS a, max(mmol_l * rate_ml_h / 1000) AS b, min(CASE WHEN coalesce(mmol_l <= 40, false) AND coalesce(mmol_l * rate_ml_h / 1000 <= 10, false) THEN 1 ELSE 0 END) AS peri FROM p GROUP BY 1) SELECT plan_id, 'peripheral' AS line, 2 * (SELECT count(*) FROM p x WHERE x.plan_id = c.plan_id) AS n_limits, peri = 1 AS ok FROM c UNION ALL SELECT plan_id, 'central', 0, false FROM c")
def _(t):
    limits = t.spark.createDataFrame([("peripheral", "concentration", 40.0, True), ("peripheral", "rate", 10.0, True), ("central", "rate", 20.0, False)], "line string, metric string, maximum double, verified boolean")
    return M.limit_check(plans(t), limits)


@query("f07_component_loads", "SELECT l_orderkey AS plan_id, p_brand AS ion, round(sum(l_quantity * p_size), 6) AS load_mmol FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
def _(t):
    return M.component_loads(t.lineitem.select(C("l_orderkey").alias("plan_id"), C("l_partkey").alias("product"), C("l_quantity").alias("volume_ml")), t.part.select(C("p_partkey").alias("product"), C("p_brand").alias("ion"), C("p_size").alias("mmol_ml")))


@query("f08_composition_check", "SELECT p_partkey AS product, round(p_size / 24.305, 9) AS theory, round(abs(p_retailprice / 1500 - p_size / 24.305) / (p_size / 24.305), 9) AS relative_error, abs(p_retailprice / 1500 - p_size / 24.305) / (p_size / 24.305) <= 0.02 AS ok FROM part WHERE p_size > 0", places=9)
def _(t):
    return M.composition_check(t.part.filter("p_size > 0").select(C("p_partkey").alias("product"), C("p_size").cast("double").alias("mg_ml"), F.lit(24.305).alias("mass"), (C("p_retailprice") / 1500).alias("declared"))).select("product", "theory", "relative_error", "ok")


@query("f09_sodium_osmolality", "SELECT record_id, round(tbw, 6) AS tbw, round(greatest(0, tbw * (na / 140 - 1)), 6) AS deficit_l, round(CASE WHEN na > 145 THEN greatest(na - 10, 140) WHEN na < 135 THEN least(na + 8, 135) ELSE na END, 6) AS target_24h, round((na * tbw + 154) / (tbw + 1), 6) AS na_after_1l, round(na + 1.6 * greatest(0, glucose * 18 - 100) / 100, 6) AS corrected_na, 2 * na + glucose + urea AS osmolality, 2 * na + glucose AS tonicity, round(measured_osm - (2 * na + glucose + bun / 2.8), 6) AS osmolar_gap FROM (SELECT *, weight * CASE WHEN female THEN 0.5::DOUBLE ELSE 0.6::DOUBLE END AS tbw FROM labs)")
def _(t):
    return M.sodium_osmolality(t.labs).select("record_id", "tbw", "deficit_l", "target_24h", "na_after_1l", "corrected_na", "osmolality", "tonicity", "osmolar_gap")


@query("f10_gap_metrics", "WITH g AS (SELECT *, na - cl - hco3 AS ag, CASE WHEN hco3 < 24 THEN (na - cl - hco3 - 12) / (24 - hco3) END AS dr, na + k + 2 * ca + 2 * mg - cl - lactate AS sida, hco3 + albumin * (0.123 * ph - 0.631) + phosphate * (0.309 * ph - 0.469) AS side FROM labs) SELECT record_id, round(ca + 0.02 * (40 - albumin), 6) + 0.0::DOUBLE AS corrected_ca, ag AS anion_gap, round(ag + 2.5 * (4 - albumin / 10), 6) + 0.0::DOUBLE AS albumin_gap, round(dr, 6) AS delta_ratio, CASE WHEN dr IS NULL THEN 'NOT_COMPUTABLE' WHEN dr < 0 THEN 'INCONSISTENT' WHEN dr < 0.4 THEN 'NORMAL_GAP' WHEN dr < 1 THEN 'MIXED_GAP' WHEN dr <= 2 THEN 'HIGH_GAP' ELSE 'HIGH_GAP_PLUS_ALKALOSIS' END AS delta_class, ag - 12 AS delta_gap, una + uk - ucl AS urine_gap, round(sida, 6) AS sida, round(side, 6) AS side, round(sida - side, 6) AS sig FROM g")
def _(t):
    return M.gap_metrics(t.labs).select("record_id", "corrected_ca", "anion_gap", "albumin_gap", "delta_ratio", "delta_class", "delta_gap", "urine_gap", "sida", "side", "sig")


@query("f11_acid_base_class", """WITH e AS (SELECT record_id, ph, pco2, hco3, 24 + (pco2 - 40) / 10 * CASE WHEN pco2 > 40 THEN 1 ELSE 2 END AS acute, 24 + (pco2 - 40) / 10 * CASE WHEN pco2 > 40 THEN 3.5::DOUBLE ELSE 4.5::DOUBLE END AS chronic FROM labs),
p AS (SELECT *, abs(hco3 - acute) AS da, abs(hco3 - chronic) AS dc, CASE WHEN ph < 7.35::DOUBLE THEN 'ACIDEMIA' WHEN ph > 7.45::DOUBLE THEN 'ALKALEMIA' ELSE 'IN_RANGE' END AS state,
CASE WHEN ph < 7.35::DOUBLE THEN CASE WHEN pco2 > 40 AND hco3 < 24 THEN 'RESP_ACIDOSIS+MET_ACIDOSIS' WHEN pco2 > 40 THEN 'RESP_ACIDOSIS' WHEN hco3 < 24 THEN 'MET_ACIDOSIS' ELSE 'UNDETERMINED' END
WHEN ph > 7.45::DOUBLE THEN CASE WHEN pco2 < 40 AND hco3 > 24 THEN 'RESP_ALKALOSIS+MET_ALKALOSIS' WHEN pco2 < 40 THEN 'RESP_ALKALOSIS' WHEN hco3 > 24 THEN 'MET_ALKALOSIS' ELSE 'UNDETERMINED' END
WHEN pco2 > 45 AND hco3 > 26 THEN CASE WHEN ph < 7.4::DOUBLE THEN 'RESP_ACIDOSIS' WHEN ph > 7.4::DOUBLE THEN 'MET_ALKALOSIS' ELSE 'RESP_ACIDOSIS_OR_MET_ALKALOSIS' END
WHEN pco2 < 35 AND hco3 < 22 THEN CASE WHEN ph > 7.4::DOUBLE THEN 'RESP_ALKALOSIS' WHEN ph < 7.4::DOUBLE THEN 'MET_ACIDOSIS' ELSE 'RESP_ALKALOSIS_OR_MET_ACIDOSIS' END
WHEN pco2 BETWEEN 35 AND 45 AND hco3 BETWEEN 22 AND 26 THEN 'NONE' WHEN pco2 > 45 THEN 'RESP_ACIDOSIS' WHEN pco2 < 35 THEN 'RESP_ALKALOSIS' WHEN hco3 < 22 THEN 'MET_ACIDOSIS' WHEN hco3 > 26 THEN 'MET_ALKALOSIS' ELSE 'NONE' END AS prim FROM e),
a AS (SELECT *, CASE WHEN da + 1 < dc THEN acute WHEN dc + 1 < da THEN chronic WHEN da <= dc THEN acute ELSE chronic END AS aim FROM p)
SELECT record_id, state, prim AS "primary", CASE WHEN prim IN ('RESP_ACIDOSIS', 'RESP_ALKALOSIS') THEN CASE WHEN hco3 < aim - 2 THEN 'MET_ACIDOSIS' WHEN hco3 > aim + 2 THEN 'MET_ALKALOSIS' END WHEN state <> 'IN_RANGE' AND prim = 'MET_ACIDOSIS' THEN CASE WHEN pco2 > 1.5 * hco3 + 10 THEN 'RESP_ACIDOSIS' WHEN pco2 < 1.5 * hco3 + 6 THEN 'RESP_ALKALOSIS' END WHEN state <> 'IN_RANGE' AND prim = 'MET_ALKALOSIS' THEN CASE WHEN pco2 > 40 + 0.7::DOUBLE * (hco3 - 24) + 5 THEN 'RESP_ACIDOSIS' WHEN pco2 < 40 + 0.7::DOUBLE * (hco3 - 24) - 5 THEN 'RESP_ALKALOSIS' END END AS second,
CASE WHEN prim IN ('RESP_ACIDOSIS', 'RESP_ALKALOSIS') THEN CASE WHEN da + 1 < dc THEN 'ACUTE' WHEN dc + 1 < da THEN 'CHRONIC' ELSE 'UNDETERMINED' END END AS chronicity FROM a""")
def _(t):
    return M.acid_base_class(t.labs).select("record_id", "state", "primary", "second", "chronicity")


@query("f12_oxygenation", "SELECT record_id, round(pb, 6) AS pb, round(f * (pb - 47) - pco2 / 0.8, 6) AS pao2_alveolar, round(f * (pb - 47) - pco2 / 0.8 - pao2, 6) AS aa_gradient, (age + 10) / 4 AS aa_expected, round(pao2 / f, 6) AS pf, round(CASE WHEN sao2 <= 100 THEN 1.34 * hb * sao2 / 100 + 0.003 * pao2 END, 6) AS o2_content FROM (SELECT *, CASE WHEN fio2 > 0 AND fio2 <= 1 THEN fio2 END AS f, CASE WHEN altitude BETWEEN 0 AND 11000 THEN 760 * pow(1 - 0.0000225577 * altitude, 5.25588) END AS pb FROM labs)")
def _(t):
    return M.oxygenation(t.labs).select("record_id", "pb", "pao2_alveolar", "aa_gradient", "aa_expected", "pf", "o2_content")


@query("f13_qt_corrections", "SELECT record_id, lead, round(qt / sqrt(rr / 1000), 6) AS bazett, round(qt / cbrt(rr / 1000), 6) AS fridericia, round(qt + 154 * (1 - rr / 1000), 6) AS framingham, round(qt + 1.75 * (60 / (rr / 1000) - 60), 6) AS hodges, round(qt - qrs, 6) AS jt, round(qt / sqrt(rr / 1000) - qrs, 6) AS jtc, round(abs(s_v1) + greatest(r_v5, r_v6), 6) AS sokolow, round(r_avl + abs(s_v3), 6) AS cornell, round(degrees(atan2(avf * 2 / sqrt(3), lead_i)), 6) AS axis FROM ecgm")
def _(t):
    return M.qt_corrections(t.ecgm).select("record_id", "lead", "bazett", "fridericia", "framingham", "hodges", "jt", "jtc", "sokolow", "cornell", "axis")


@query("f17_age_strata", "SELECT stratum, count(*) AS n, round(avg(years), 6) AS mean_years FROM (SELECT years, CASE WHEN years IS NULL THEN 'unknown' WHEN years < 1 THEN '<1' WHEN years < 7 THEN '1-<7' WHEN years <= 14 THEN '7-14' ELSE 'outside' END AS stratum FROM (SELECT CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_orderkey % 6000 END / 365.25 AS years FROM orders)) GROUP BY 1")
def _(t):
    text = F.expr("case when o_orderkey % 50 = 0 then 'n/a' else concat(o_orderkey % 6000, 'd') end")
    return M.age_strata(t.orders.select(text.alias("age_text")), "age_text").groupBy("stratum").agg(F.count("*").alias("n"), F.avg("years").alias("mean_years"))


@query("f19_prediction_flags", "WITH m(code, target) AS (VALUES ('1-URGENT', 'acute'), ('2-HIGH', 'acute'), ('5-LOW', 'routine')), g AS (SELECT DISTINCT target FROM m), r AS (SELECT DISTINCT o_custkey AS record_id FROM orders) SELECT record_id, target, CAST(EXISTS (SELECT 1 FROM orders JOIN m ON o_orderpriority = code WHERE o_custkey = record_id AND m.target = g.target) AS INT) AS p FROM r, g")
def _(t):
    mapping = t.spark.createDataFrame([("1-URGENT", "acute"), ("2-HIGH", "acute"), ("5-LOW", "routine")], "code string, target string")
    return M.prediction_flags(t.orders.select(C("o_custkey").alias("record_id"), C("o_orderpriority").alias("code")), mapping)
