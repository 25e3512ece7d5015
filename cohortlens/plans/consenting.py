"""Consensus queries: A16-A23, F14-F16, F18, E14-E16."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.operators import consensus as K
from cohortlens.plans.registry import query

C = F.col
_LEADS = "leads AS (SELECT record_id, lead, engine AS value, confidence FROM meas)"
_MAD = "c AS (SELECT record_id, median(value) AS m, count(value) AS n FROM leads GROUP BY 1), d AS (SELECT leads.*, m, n FROM leads JOIN c USING (record_id)), mad AS (SELECT record_id, median(abs(value - m)) AS mad FROM d GROUP BY 1)"


def leads(t):
    return t.meas.select("record_id", "lead", C("engine").alias("value"), "confidence")


_A16 = f"WITH {_LEADS}, t AS (SELECT record_id, count(*) FILTER (confidence >= 0.45) AS nt FROM leads GROUP BY 1), u AS (SELECT leads.*, nt FROM leads JOIN t USING (record_id) WHERE nt = 0 OR confidence >= 0.45), c AS (SELECT record_id, median(value) AS m, count(*) AS n, avg(confidence) AS mc, max(nt) AS nt FROM u GROUP BY 1), s AS (SELECT u.record_id, median(abs(value - m)) AS mad FROM u JOIN c USING (record_id) GROUP BY 1) SELECT record_id, round(m, 9) AS value, round(mad, 9) AS mad, n AS n_used, CASE WHEN nt >= 2 THEN 'multi_trusted' WHEN nt > 0 THEN 'single_trusted' WHEN n >= 2 THEN 'multi_low' ELSE 'single_low' END AS tier, round(least(1, mc / (1 + mad / greatest(1, abs(m) * 0.1)) * CASE WHEN nt >= 2 THEN 1 WHEN nt > 0 THEN 0.85 WHEN n >= 2 THEN 0.75 ELSE 0.65 END), 9) AS confidence FROM c JOIN s USING (record_id)"


@query("a16_robust_consensus", _A16, places=9)
def _(t):
    return K.robust_consensus(leads(t), ["record_id"])


@query("a17_upper_envelope_consensus", f"WITH {_LEADS}, {_MAD}, k AS (SELECT d.*, row_number() OVER (PARTITION BY record_id ORDER BY value DESC, lead) AS r FROM d JOIN mad USING (record_id) WHERE value <= m + greatest(30, 3 * 1.4826 * mad)) SELECT record_id, round(median(value), 9) AS value, round(max(value) - min(value), 9) AS spread, max(n) AS n FROM k WHERE r <= 3 OR n < 3 GROUP BY 1", places=9)
def _(t):
    return K.upper_envelope(leads(t), ["record_id"])


@query("a17_global_duration", f"WITH leads AS (SELECT record_id, lead, engine / 10 AS value, confidence FROM meas WHERE lead <= 6), able AS (SELECT *, count(*) FILTER (confidence >= 0.45) OVER (PARTITION BY record_id) AS nt FROM leads WHERE value BETWEEN 40 AND 220 AND confidence >= 0.20), used AS (SELECT *, median(value) OVER (PARTITION BY record_id) AS m, count(*) OVER (PARTITION BY record_id) AS n FROM able WHERE nt < 3 OR confidence >= 0.45), dev AS (SELECT *, median(abs(value - m)) OVER (PARTITION BY record_id) AS mad FROM used WHERE n >= 3), lim AS (SELECT *, value <= m + greatest(30, 3 * 1.4826 * mad) AS ok, count(*) FILTER (value <= m + greatest(30, 3 * 1.4826 * mad)) OVER (PARTITION BY record_id) AS n_ok FROM dev), kept AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY value DESC, lead) AS r, count(*) OVER (PARTITION BY record_id) AS k FROM lim WHERE ok OR n_ok < 3), top AS (SELECT record_id, median(value) AS value, max(value) - min(value) AS spread, avg(confidence) AS c, max(k) AS k FROM kept WHERE r <= 3 GROUP BY 1), upper AS (SELECT record_id, round(value, 9) AS value, round(spread, 9) AS spread, round(c * least(1, greatest(0.45, 1 - spread / greatest(value, 60))) * least(1, greatest(0.60, k / 6)), 9) AS confidence, CAST(3 AS BIGINT) AS n_used, k AS n_eligible, 'upper_envelope' AS mode FROM top), rest AS (SELECT * FROM leads WHERE record_id NOT IN (SELECT record_id FROM upper)), t AS (SELECT record_id, count(*) FILTER (confidence >= 0.45) AS nt FROM rest GROUP BY 1), u AS (SELECT rest.*, nt FROM rest JOIN t USING (record_id) WHERE nt = 0 OR confidence >= 0.45), c AS (SELECT record_id, median(value) AS m, count(*) AS n, avg(confidence) AS mc, max(nt) AS nt FROM u GROUP BY 1), s AS (SELECT u.record_id, median(abs(value - m)) AS mad FROM u JOIN c USING (record_id) GROUP BY 1) SELECT record_id, value, spread, confidence, n_used, n_eligible, mode FROM upper UNION ALL BY NAME SELECT record_id, round(m, 9) AS value, CAST(NULL AS DOUBLE) AS spread, n AS n_used, n AS n_eligible, CASE WHEN nt >= 2 THEN 'multi_trusted' WHEN nt > 0 THEN 'single_trusted' WHEN n >= 2 THEN 'multi_low' ELSE 'single_low' END AS mode, round(least(1, mc / (1 + mad / greatest(1, abs(m) * 0.1)) * CASE WHEN nt >= 2 THEN 1 WHEN nt > 0 THEN 0.85 WHEN n >= 2 THEN 0.75 ELSE 0.65 END), 9) AS confidence FROM c JOIN s USING (record_id)", places=9)
def _(t):
    return K.global_duration(leads(t).filter("lead <= 6").withColumn("value", C("value") / 10), ["record_id"])


@query("a18_inlier_rate_consensus", f"WITH {_LEADS}, c AS (SELECT record_id, median(value) AS m0 FROM leads GROUP BY 1), d AS (SELECT leads.*, m0, abs(value - m0) <= greatest(8, 0.18 * abs(m0)) AS inl FROM leads JOIN c USING (record_id)) SELECT record_id, round(CASE WHEN count(*) FILTER (inl) >= 3 THEN median(value) FILTER (inl) ELSE max(m0) END, 9) AS rate, count(*) FILTER (inl) AS n_in, bool_or(lead = 2 AND NOT inl) AS selected_outlier FROM d GROUP BY 1", places=9)
def _(t):
    return K.inlier_rate(leads(t).withColumn("is_selected", C("lead") == 2), ["record_id"])


@query("a19_dispersion", "SELECT record_id, round(max(engine) - min(engine), 9) AS dispersion, count(engine) AS n FROM meas WHERE confidence >= 0.45 GROUP BY 1 HAVING count(engine) >= 2", places=9)
def _(t):
    return K.dispersion(leads(t), ["record_id"])


_ANGLES = {1: 0.0, 2: 60.0, 3: 120.0, 4: -150.0, 5: -30.0, 6: 90.0}


@query("a20_limb_axis_fit", "WITH x AS (SELECT record_id, engine - 1500 AS y, cos(radians(a)) AS c, sin(radians(a)) AS s FROM meas JOIN (VALUES (1, 0.0), (2, 60.0), (3, 120.0), (4, -150.0), (5, -30.0), (6, 90.0)) g(l, a) ON lead = l), u AS (SELECT record_id, count(*) AS n, sum(c * c) AS cc, sum(c * s) AS cs, sum(s * s) AS ss, sum(c * y) AS cy, sum(s * y) AS sy, sum(y * y) AS yy, sum(y) AS sy1 FROM x GROUP BY 1 HAVING count(*) >= 4), f AS (SELECT *, (cy * ss - sy * cs) / (cc * ss - cs * cs) AS bx, (sy * cc - cy * cs) / (cc * ss - cs * cs) AS bb FROM u WHERE abs(cc * ss - cs * cs) > 1e-9) SELECT record_id, n, round(degrees(atan2(bb, bx)), 4) AS axis, round(sqrt(bx * bx + bb * bb), 4) AS amplitude, round(CASE WHEN yy - sy1 * sy1 / n > 0 THEN 1 - (yy - bx * cy - bb * sy) / (yy - sy1 * sy1 / n) END, 4) AS r2 FROM f", places=4)
def _(t):
    return K.axis_fit(leads(t).withColumn("value", C("value") - 1500), _ANGLES, ["record_id"])


def samples(t):
    s = t.embeddings.select(C("vec_id").alias("record_id"), F.posexplode("embedding").alias("i", "v"))
    return s.select("record_id", "i", C("v").cast("double").alias("v"))


_SAMPLES = "s AS (SELECT vec_id AS record_id, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"


@query("a21_waveform_agreement", f"WITH {_SAMPLES}, b AS (SELECT record_id + 1 AS record_id, i + sh AS i, v AS w, sh FROM s, (VALUES (-2), (-1), (0), (1), (2)) x(sh)), p AS (SELECT record_id, sh, count(*) AS n, corr(v, w) AS pe, sqrt(avg((v - w) ** 2)) AS rms, 10 * log10(sum(v * v) / nullif(sum((v - w) ** 2), 0)) AS snr FROM s JOIN b USING (record_id, i) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY snr DESC, abs(sh), sh DESC) AS k FROM p) SELECT record_id, sh AS shift, n, round(pe, 6) AS pearson, round(rms, 6) AS rms, round(snr, 6) AS snr FROM r WHERE k = 1")
def _(t):
    s = samples(t)
    return K.waveform_agreement(s, s.withColumn("record_id", C("record_id") + 1), [-2, -1, 0, 1, 2])


@query("a22_signal_integrity", f"WITH {_SAMPLES}, q AS (SELECT record_id, i, CASE WHEN i % 17 = 3 THEN NULL ELSE v END AS v, CASE WHEN i % 23 = 5 THEN 0 WHEN i % 5 = 0 THEN 1 ELSE 2 END AS q FROM s), u AS (SELECT *, v IS NOT NULL AND q > 0 AS u FROM q), l AS (SELECT *, sum(CASE WHEN u THEN 0 ELSE 1 END) OVER (PARTITION BY record_id ORDER BY i) AS g FROM u), r AS (SELECT record_id, max(n) AS longest_run FROM (SELECT record_id, g, count(*) AS n FROM l WHERE u GROUP BY 1, 2) GROUP BY 1), b AS (SELECT record_id, count(*) AS n, avg(CASE WHEN v IS NULL THEN 0 ELSE 1 END) AS fs, avg(CASE WHEN q = 2 THEN 1 ELSE 0 END) AS os, quantile_cont(v, 0.99) - quantile_cont(v, 0.01) AS span FROM u GROUP BY 1) SELECT record_id, n, round(fs, 6) AS finite_share, round(os, 6) AS observed_share, longest_run, round(span, 6) AS span, span < 0.02 AS flat, fs >= 0.8 AND longest_run >= 0.5 * n AS eligible FROM b JOIN r USING (record_id)")
def _(t):
    s = samples(t).withColumns({"v": F.when(C("i") % 17 != 3, C("v")), "q": F.when(C("i") % 23 == 5, 0).when(C("i") % 5 == 0, 1).otherwise(2)})
    return K.signal_integrity(s)


@query("a23_lead_threshold_counts", f"WITH {_LEADS}, {_MAD} SELECT c.record_id, round(m, 9) AS median, n, (SELECT count(*) FROM leads l WHERE l.record_id = c.record_id AND value > 2000) AS n_wide, (SELECT count(*) FROM leads l WHERE l.record_id = c.record_id AND value >= 1100 AND value < 1500) AS n_mid, round(mad, 9) AS mad, (SELECT count(*) FROM leads l WHERE l.record_id = c.record_id AND value > 2000) >= 2 AS flag_wide, (SELECT count(*) FROM leads l WHERE l.record_id = c.record_id AND value >= 1100 AND value < 1500) >= 2 AS flag_mid FROM c JOIN mad USING (record_id)", places=9)
def _(t):
    return K.lead_threshold_counts(leads(t), ["record_id"], {"wide": C("value") > 2000, "mid": (C("value") >= 1100) & (C("value") < 1500)})


_INTERVAL = "i AS (SELECT record_id, lead, engine / 10 AS value, qty / 3 AS digitizer, tax * 200 AS mad, (engine - comparator) / 20 AS dis, confidence FROM meas), p AS (SELECT *, 1.4826 * mad AS pm, dis / 2 AS pd, (1 - confidence) * 10 AS pc FROM i), u AS (SELECT *, greatest(4, digitizer, pm, pd, pc) AS u FROM p), s AS (SELECT *, CASE WHEN value IS NULL THEN 'UNMEASURABLE' WHEN abs(dis) > 36 THEN 'REMEASURE' WHEN abs(dis) > 12 OR mad > 12 THEN 'WITH_UNCERTAINTY' ELSE 'HIGH_CONFIDENCE' END AS state FROM u)"


def intervals(t):
    base = t.meas.select("record_id", "lead", (C("engine") / 10).alias("value"), (C("qty") / 3).alias("digitizer"), (C("tax") * 200).alias("mad"), ((C("engine") - C("comparator")) / 20).alias("disagreement"), "confidence")
    return K.uncertainty_interval(base)


@query("f14_uncertainty_interval", f"WITH {_INTERVAL} SELECT record_id, lead, round(value, 9) AS value, round(u, 9) AS uncertainty, round(value - u, 9) AS low, round(value + u, 9) AS high, CASE WHEN u = 4 THEN 'floor' WHEN u = digitizer THEN 'digitizer' WHEN u = pm THEN 'mad' WHEN u = pd THEN 'disagreement' ELSE 'confidence' END AS source FROM s", places=9)
def _(t):
    return intervals(t).select("record_id", "lead", "value", "uncertainty", "low", "high", "source")


@query("f15_measurement_state", f"WITH {_INTERVAL} SELECT state, count(*) AS n FROM s GROUP BY 1")
def _(t):
    return K.measurement_state(intervals(t)).groupBy("state").agg(F.count("*").alias("n"))


@query("f16_threshold_relation", f"WITH {_INTERVAL} SELECT relation, count(*) AS n FROM (SELECT CASE WHEN state IN ('REMEASURE', 'UNMEASURABLE') THEN 'UNUSABLE' WHEN value - u > 120 THEN 'ABOVE' WHEN value + u < 120 THEN 'BELOW' ELSE 'OVERLAPS' END AS relation FROM s) GROUP BY 1")
def _(t):
    return K.threshold_relation(K.measurement_state(intervals(t)), 120.0).groupBy("relation").agg(F.count("*").alias("n"))


_WHOLE = _A16.replace("round(m, 9) AS", "m AS").replace("round(mad, 9) AS", "mad AS").replace("round(least(", "(least(").replace(" END), 9) AS confidence", " END)) AS confidence")


@query(
    "f18_measurement_envelope",
    f"SELECT k.record_id, round(value, 6) AS value, CASE WHEN mad > 12 THEN 'WITH_UNCERTAINTY' ELSE 'HIGH_CONFIDENCE' END AS state, round(value - u, 6) AS low, round(value + u, 6) AS high, n_sources, round(source_mean, 6) AS source_mean FROM (SELECT *, greatest(4.0, 1.4826 * mad, (1 - confidence) * 10) AS u FROM ({_WHOLE}) a) k JOIN (SELECT record_id, count(*) AS n_sources, avg(v) AS source_mean FROM (SELECT record_id, lead, avg(engine) AS v FROM meas GROUP BY 1, 2) GROUP BY 1) n ON n.record_id = k.record_id",
)
def _(t):
    c = K.measurement_state(K.uncertainty_interval(K.robust_consensus(leads(t), ["record_id"]).withColumns({"digitizer": F.lit(2.0), "disagreement": F.lit(0.0)})))
    e = K.measurement_envelope(c, leads(t), ["record_id"])
    mean = F.aggregate(F.map_values("envelope.sources"), F.lit(0.0), lambda s, v: s + v) / F.size("envelope.sources")
    return e.select("record_id", "envelope.value", "envelope.state", "envelope.low", "envelope.high", F.size("envelope.sources").alias("n_sources"), mean.alias("source_mean"))


_FLAGS = "f AS (SELECT l_orderkey AS record_id, l_quantity > 20 AS wide, l_discount > 0.05 AS rsr, l_tax > 0.04 AS notched FROM lineitem)"


def flags(t):
    return t.lineitem.select(C("l_orderkey").alias("record_id"), (C("l_quantity") > 20).alias("wide"), (C("l_discount") > 0.05).alias("rsr"), (C("l_tax") > 0.04).alias("notched"))


@query("e14_bundle_branch_rules", f"WITH {_FLAGS}, g AS (SELECT record_id, count(*) FILTER (wide) AS w, count(*) FILTER (wide AND rsr) AS r, count(*) FILTER (wide AND notched) AS l FROM f GROUP BY 1), k AS (SELECT *, CASE WHEN r > l THEN 'RIGHT' WHEN l > 0 THEN 'LEFT' END AS kind FROM g) SELECT record_id, w AS n_wide, CASE WHEN kind IS NULL THEN CASE WHEN w >= 4 THEN 'UNSPECIFIED_WIDE' ELSE 'NONE' END WHEN w >= 4 THEN 'COMPLETE_' || kind ELSE 'INCOMPLETE_' || kind END AS pattern FROM k")
def _(t):
    return K.bundle_branch_rules(flags(t))


@query("e15_axis_pattern_rules", "WITH m AS (SELECT record_id, " + ", ".join(f"coalesce(avg(CASE WHEN lead = {k} THEN engine - 1500 END), 0) AS v{k}" for k in range(1, 8)) + " FROM meas GROUP BY 1) SELECT record_id, CASE WHEN v1 > 0 AND v3 < 0 THEN 40 + 30 * CAST(v2 < 0 AS INT) + 30 + 10 * CAST(v5 > 0 AS INT) ELSE 0 END AS left_score, CASE WHEN v1 < 0 AND v3 > 0 THEN 40 + 30 * CAST(v2 > 0 AS INT) + 30 + 10 * CAST(v5 < 0 AS INT) ELSE 0 END AS right_score FROM m")
def _(t):
    return K.axis_pattern_rules(leads(t).withColumn("value", C("value") - 1500))


@query("e16_concordant_channel_rule", f"WITH {_FLAGS} SELECT record_id, count(*) FILTER (rsr AND notched) AS n_both, CASE WHEN count(*) FILTER (rsr AND notched) >= 2 THEN 'CONCORDANT' WHEN bool_or(rsr) AND bool_or(notched) THEN 'GLOBAL' ELSE 'NONE' END AS path FROM f GROUP BY 1")
def _(t):
    return K.concordant_channels(flags(t), "rsr", "notched")
