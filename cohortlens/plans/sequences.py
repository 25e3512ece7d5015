"""Event, rule and series queries: J9-J11, J15-J19, E1-E13, E17-E22."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from cohortlens.operators import events as E
from cohortlens.operators import patterns as N
from cohortlens.operators import phases as P
from cohortlens.operators import rules as R
from cohortlens.plans.registry import query
from cohortlens.sources.shared import written

C = F.col
H = 3_600_000


def kind(t, k):
    return t.evts.filter(C("kind") == k)


_ONE = "r AS (SELECT DISTINCT record_id, t_ms FROM evts WHERE kind = 'purchase'), p AS (SELECT DISTINCT record_id, t_ms FROM evts WHERE kind = 'view')"


@query("j09_band_join", "WITH rules AS (SELECT n_nationkey AS med_id, b AS rule_id, CASE b WHEN 1 THEN NULL WHEN 2 THEN 30 ELSE 60 END AS lo, CASE b WHEN 1 THEN 30 WHEN 2 THEN 60 END AS hi, n_nationkey % 2 = 0 AS li, n_nationkey % 3 = 0 AS hincl FROM nation, (VALUES (1), (2), (3)) v(b)), p AS (SELECT o_orderkey AS patient_id, o_orderkey % 25 AS med_id, CAST(o_orderkey % 91 AS DOUBLE) - 1 AS value FROM orders WHERE o_orderstatus <> 'P'), h AS (SELECT patient_id, p.med_id, rule_id, count(*) OVER (PARTITION BY patient_id, p.med_id) AS n FROM p JOIN rules ON p.med_id = rules.med_id AND value >= 0 AND (lo IS NULL OR value > lo OR (li AND value = lo)) AND (hi IS NULL OR value < hi OR (hincl AND value = hi))) SELECT patient_id, med_id, rule_id FROM h WHERE n = 1")
def _(t):
    bands = t.nation.select(C("n_nationkey").cast("bigint").alias("med_id"), (C("n_nationkey") % 2 == 0).alias("lo_incl"), (C("n_nationkey") % 3 == 0).alias("hi_incl"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("rule_id"))
    rules = bands.withColumns({"metric": F.lit("crcl"), "lo": F.expr("case rule_id when 2 then 30.0 when 3 then 60.0 end"), "hi": F.expr("case rule_id when 1 then 30.0 when 2 then 60.0 end")})
    patients = t.orders.select(C("o_orderkey").alias("patient_id"), (C("o_orderkey") % 25).alias("med_id"), F.lit("crcl").alias("metric"), ((C("o_orderkey") % 91).cast("double") - 1).alias("value"), (C("o_orderstatus") == "P").alias("dialysis"))
    return R.band_join(patients, rules)


@query("j10_demographic_rule_join", "WITH m AS (SELECT DISTINCT segment FROM pats), r AS (SELECT segment, k AS rule_id, CASE WHEN k > 1 THEN k * 15 END AS amin, CASE WHEN k < 4 THEN k * 25 END AS amax, k * 10 AS wmin, CASE WHEN k < 3 THEN 90 END AS wmax, k % 2 = 0 AS wo FROM m, (VALUES (1), (2), (3), (4)) v(k)) SELECT patient_id, rule_id FROM pats JOIN r USING (segment) WHERE (amin IS NULL OR age >= amin) AND (amax IS NULL OR age < amax) AND (CASE WHEN wo THEN weight > wmin ELSE weight >= wmin END) AND (wmax IS NULL OR weight <= wmax)")
def _(t):
    rules = t.pats.select("segment").distinct().withColumn("rule_id", F.explode(F.array(*[F.lit(k) for k in (1, 2, 3, 4)])))
    rules = rules.withColumns({"age_min": F.expr("case when rule_id > 1 then rule_id * 15 end"), "age_max": F.expr("case when rule_id < 4 then rule_id * 25 end"), "w_min": C("rule_id") * 10, "w_max": F.expr("case when rule_id < 3 then 90 end"), "w_min_open": C("rule_id") % 2 == 0, "w_max_open": F.lit(False)})
    return R.demographic_join(t.pats, rules, "segment")


_TREES = [
    {"rule_code": "A", "status": "PUBLISHED", "priority": 10, "condition": {"all": [{"field": "view", "op": ">", "value": 200}, {"not": {"field": "error", "op": ">=", "value": 250}}]}},
    {"rule_code": "B", "status": "PUBLISHED", "condition": {"any": [{"field": "click", "op": "<", "value": 90}, {"all": [{"field": "signup", "op": "exists"}, {"field": "purchase", "op": ">=", "value": 260}]}]}},
    {"rule_code": "C", "status": "DRAFT", "condition": {"field": "view", "op": "exists"}},
]


@query("j11_condition_rule_join", "WITH c AS (SELECT record_id, max(amplitude) FILTER (kind = 'view') AS v, max(amplitude) FILTER (kind = 'error') AS e, max(amplitude) FILTER (kind = 'click') AS c, max(amplitude) FILTER (kind = 'signup') AS s, max(amplitude) FILTER (kind = 'purchase') AS p FROM evts GROUP BY 1) SELECT record_id AS patient_id, 'A' AS rule_id, 10 AS priority FROM c WHERE coalesce(v > 200, false) AND NOT coalesce(e >= 250, false) UNION ALL SELECT record_id, 'B', 100 FROM c WHERE coalesce(c < 90, false) OR (s IS NOT NULL AND coalesce(p >= 260, false))")
def _(t):
    context = t.evts.groupBy(C("record_id").alias("patient_id"), C("kind").alias("field")).agg(F.max("amplitude").alias("value"))
    clauses = t.spark.createDataFrame(R.compile_conditions(_TREES), "rule_id string, priority int, clause int, field string, op string, limit double, negate boolean")
    return R.condition_rules(context, clauses)


@query("j15_asof_nearest_before", f"WITH {_ONE} SELECT r.record_id, CAST(r.t_ms AS DOUBLE) AS r_ms, CAST(max(p.t_ms) AS DOUBLE) AS p_ms FROM r LEFT JOIN p ON p.record_id = r.record_id AND p.t_ms <= r.t_ms - {H} AND p.t_ms >= r.t_ms - {48 * H} GROUP BY 1, 2")
def _(t):
    d = lambda k: kind(t, k).select("record_id", C("t_ms").cast("double").alias("t_ms")).distinct()
    return E.asof_before(d("purchase"), d("view"), float(H), 48.0 * H)


@query("j15_asof_claimed")
def _(t):
    return E.claimed_pairs(kind(t, "purchase"), kind(t, "view"), float(H), 48.0 * H)


@query("j16_tolerance_match_candidates", f"WITH {_ONE} SELECT r.record_id, r.t_ms AS a_ms, p.t_ms AS b_ms, abs(r.t_ms - p.t_ms) AS error FROM r JOIN p ON r.record_id = p.record_id AND abs(r.t_ms - p.t_ms) <= {6 * H}")
def _(t):
    d = lambda k: kind(t, k).select("record_id", "t_ms").distinct()
    return E.near_pairs(d("purchase"), d("view"), 6 * H)


# Greedy over all pairs in order: a fold that keeps what is used. The first element of each list is the empty state.
_STATE = "{'a': CAST([] AS VARCHAR[]), 'b': CAST([] AS VARCHAR[]), 'e': CAST([] AS BIGINT[])}"
_FOLD = "list_reduce(list_prepend(" + _STATE + ", l), lambda s, x: CASE WHEN list_contains(s.a, x.a[1]) OR list_contains(s.b, x.b[1]) THEN s ELSE {'a': s.a || x.a, 'b': s.b || x.b, 'e': s.e || x.e} END).e"
_PAIRS = "list({'a': [a.t_ms || '#' || a.n], 'b': [b.t_ms || '#' || b.n], 'e': [abs(a.t_ms - b.t_ms)]} ORDER BY abs(a.t_ms - b.t_ms), a.t_ms, a.n, b.t_ms, b.n) AS l"
_NUMBERED = "SELECT record_id, t_ms, row_number() OVER (PARTITION BY record_id, t_ms) AS n FROM evts WHERE kind = "


@query("j16_tolerance_match", f"WITH a AS ({_NUMBERED}'purchase'), b AS ({_NUMBERED}'view'), p AS (SELECT record_id, {_PAIRS} FROM a JOIN b USING (record_id) WHERE abs(a.t_ms - b.t_ms) <= {6 * H} GROUP BY 1), m AS (SELECT record_id, {_FOLD} AS e FROM p), n AS (SELECT record_id, coalesce(x, 0) AS n_truth, coalesce(y, 0) AS n_found FROM (SELECT record_id, count(*) AS x FROM a GROUP BY 1) FULL JOIN (SELECT record_id, count(*) AS y FROM b GROUP BY 1) USING (record_id)) SELECT record_id, n_truth, n_found, coalesce(len(e), 0) AS matched, CAST(list_median(e) AS DOUBLE) AS median_error, n_truth - coalesce(len(e), 0) AS missed, n_found - coalesce(len(e), 0) AS extra FROM n LEFT JOIN m USING (record_id)")
def _(t):
    return E.match_counts(kind(t, "purchase"), kind(t, "view"), 6 * H)


@query("j17_near_any", f"SELECT event_id, EXISTS (SELECT 1 FROM evts b WHERE b.kind = 'error' AND b.record_id = a.record_id AND abs(a.t_ms - b.t_ms) <= {3 * H}) AS near FROM evts a WHERE kind = 'click'")
def _(t):
    return E.near_any(kind(t, "click"), kind(t, "error"), 3 * H).select("event_id", "near")


@query("j18_interval_exclusion", f"SELECT event_id FROM evts a WHERE kind = 'view' AND NOT EXISTS (SELECT 1 FROM evts b WHERE b.kind = 'purchase' AND b.record_id = a.record_id AND a.t_ms BETWEEN b.t_ms - {4 * H} AND b.t_ms + {10 * H})")
def _(t):
    spans = kind(t, "purchase").select("record_id", (C("t_ms") - 4 * H).alias("lo"), (C("t_ms") + 10 * H).alias("hi"))
    return E.interval_exclusion(kind(t, "view"), spans, 7 * H).select("event_id")


@query("j19_context_window_events", f"SELECT record_id, t_ms, CASE WHEN t_ms - p <= {40 * H} THEN p END AS prev_ms, CASE WHEN n - t_ms <= {65 * H} THEN n END AS next_ms FROM (SELECT record_id, t_ms, (SELECT max(t_ms) FROM evts b WHERE b.record_id = q.record_id AND b.kind = 'view' AND b.t_ms < q.t_ms) AS p, (SELECT min(t_ms) FROM evts b WHERE b.record_id = q.record_id AND b.kind = 'error' AND b.t_ms > q.t_ms) AS n FROM (SELECT DISTINCT record_id, t_ms FROM evts WHERE kind = 'purchase') q) WHERE p IS NOT NULL AND n IS NOT NULL AND t_ms - p <= {40 * H} AND n - t_ms <= {65 * H}")
def _(t):
    return E.context_window(kind(t, "purchase").select("record_id", "t_ms").distinct(), t.evts, ("view", 40 * H), ("error", 65 * H)).filter("prev_ms is not null and next_ms is not null")


_STATS = f"g0 AS (SELECT record_id, t_ms, t_ms - lag(t_ms) OVER (PARTITION BY record_id ORDER BY t_ms) AS gap FROM (SELECT DISTINCT record_id, t_ms FROM evts)), g AS (SELECT *, gap - lag(gap) OVER (PARTITION BY record_id ORDER BY t_ms) AS step FROM g0 WHERE gap IS NOT NULL), a AS (SELECT record_id, count(*) AS n, median(gap) AS median, avg(gap) AS mean, stddev_samp(gap) / avg(gap) AS cv, sqrt(avg(CAST(step AS DOUBLE) * step)) AS rmssd, avg(CASE WHEN abs(step) > {H} THEN 1 WHEN step IS NOT NULL THEN 0 END) AS pnn FROM g GROUP BY 1), m AS (SELECT g.record_id, median(abs(gap - median)) AS mad FROM g JOIN a USING (record_id) GROUP BY 1), s AS (SELECT * FROM a JOIN m USING (record_id))"


@query("e01_interval_stats", f"WITH {_STATS} SELECT record_id, n, round(median, 3) AS median, round(mean, 3) AS mean, round(cv, 6) AS cv, round(rmssd, 3) AS rmssd, round(pnn, 6) AS pnn, round(mad, 3) AS mad, coalesce(cv <= 0.12, false) AS regular, coalesce(cv <= 0.10 AND mad / median <= 0.08, false) AS very_regular FROM s")
def _(t):
    s = E.interval_stats(t.evts, short=H)
    return s.withColumns({c: F.round(c, 3) for c in ("median", "mean", "rmssd", "mad")})


@query("e02_irregularity_score", f"WITH {_STATS}, p AS (SELECT record_id, least(1, greatest(0, (cv - 0.05) / 1.15)) AS a, least(1, greatest(0, (rmssd / mean - 0.05) / 1.45)) AS b, least(1, greatest(0, (pnn - 0.1) / 0.9)) AS c, least(1, greatest(0, (mad / median - 0.05) / 0.95)) AS d, cv, rmssd, pnn FROM s) SELECT record_id, round((coalesce(CASE WHEN cv IS NOT NULL THEN a END * 0.35, 0) + coalesce(CASE WHEN rmssd IS NOT NULL THEN b END * 0.25, 0) + coalesce(CASE WHEN pnn IS NOT NULL THEN c END * 0.25, 0) + d * 0.15) / (CASE WHEN cv IS NOT NULL THEN 0.35 ELSE 0 END + CASE WHEN rmssd IS NOT NULL THEN 0.25 ELSE 0 END + CASE WHEN pnn IS NOT NULL THEN 0.25 ELSE 0 END + 0.15), 6) AS irregularity FROM p WHERE cv IS NOT NULL AND rmssd IS NOT NULL")
def _(t):
    return E.irregularity_score(E.interval_stats(t.evts, short=H).filter("cv is not null and rmssd is not null")).select("record_id", "irregularity")


@query("e03_premature_events", "WITH g AS (SELECT *, t_ms - lag(t_ms) OVER w AS gap, lead(t_ms) OVER w - t_ms AS after FROM evts WINDOW w AS (PARTITION BY record_id ORDER BY t_ms, event_id)), m AS (SELECT record_id, median(gap) AS mg, median(amplitude) AS ma FROM g GROUP BY 1), p AS (SELECT g.record_id, event_id, abs(amplitude - ma) > 0.5 * ma AS outlier, coalesce(gap + after >= 1.8 * mg, false) AS pause FROM g JOIN m USING (record_id) WHERE gap < 0.82 * mg) SELECT *, CASE WHEN outlier AND pause THEN 'ventricular_like' WHEN outlier OR pause THEN 'undetermined' ELSE 'supraventricular_like' END AS class FROM p")
def _(t):
    return E.premature_events(t.evts)


_ECTOPIC = "b AS (SELECT record_id, event_id, t_ms, amplitude, 60 + event_id % 80 AS width FROM evts), g AS (SELECT *, t_ms - lag(t_ms) OVER w AS gap, lead(t_ms) OVER w - t_ms AS after FROM b WINDOW w AS (PARTITION BY record_id ORDER BY t_ms, event_id)), m AS (SELECT record_id, count(*) AS n, median(gap) AS mg, median(width) AS mw, median(amplitude) AS ma FROM g GROUP BY 1), p AS (SELECT g.record_id, event_id, coalesce(width >= 120 OR width >= mw + 25, false) AS wide, coalesce(abs(amplitude - ma) >= greatest(0.30, 0.60::DOUBLE * abs(ma)), false) AS amplitude_outlier, gap + after >= 1.75::DOUBLE * mg AS pause FROM g JOIN m USING (record_id) WHERE n >= 5 AND after IS NOT NULL AND gap < 0.82::DOUBLE * mg), x AS (SELECT *, CASE WHEN wide AND (amplitude_outlier OR pause) THEN 'ventricular' WHEN NOT wide THEN 'supraventricular' ELSE 'unclassified' END AS kind FROM p)"


def wide_beats(t):
    return t.evts.select("record_id", "event_id", "t_ms", "amplitude", (60 + C("event_id") % 80).alias("width"))


@query("e03_ectopic_beats", f"WITH {_ECTOPIC} SELECT * FROM x")
def _(t):
    return E.ectopic_beats(wide_beats(t))


@query("e03_ectopy_burden", f"WITH {_ECTOPIC}, k AS (SELECT record_id, count(*) AS premature, count(*) FILTER (kind = 'ventricular') AS v, count(*) FILTER (kind = 'supraventricular') AS s FROM x GROUP BY 1), o AS (SELECT record_id, n AS n_beats, coalesce(premature, 0) AS premature, coalesce(v, 0) AS ventricular, coalesce(s, 0) AS supraventricular, n >= 5 AS evaluable FROM m LEFT JOIN k USING (record_id)) SELECT *, CASE WHEN evaluable THEN round(premature / n_beats, 6) END AS burden, evaluable AND premature >= 2 AND premature / n_beats >= 0.10 AS explains_irregularity FROM o")
def _(t):
    return E.ectopy_burden(wide_beats(t))


_CLUST = f"k0 AS (SELECT *, CASE WHEN t_ms - lag(t_ms) OVER (PARTITION BY record_id ORDER BY t_ms, kind) <= {6 * H} THEN 0 ELSE 1 END AS n FROM evts), k1 AS (SELECT *, sum(n) OVER (PARTITION BY record_id ORDER BY t_ms, kind ROWS UNBOUNDED PRECEDING) AS c FROM k0), k AS (SELECT record_id, c, count(DISTINCT kind) AS channels, median(t_ms) AS t_ms, CAST(max(t_ms) - min(t_ms) AS DOUBLE) AS spread FROM k1 GROUP BY 1, 2)"


@query("e04_cross_channel_cluster", f"WITH {_CLUST} SELECT record_id, channels, t_ms, spread FROM k WHERE channels >= 2")
def _(t):
    return E.gap_clusters(t.evts, 6 * H, 2)


@query("e04_cross_channel_cluster_exact")
def _(t):
    return E.exact_clusters(t.evts, 6.0 * H, 2)


@query("e05_refractory_dedupe", f"WITH {_CLUST}, e AS (SELECT * FROM k WHERE channels >= 2), h AS (SELECT *, CASE WHEN t_ms - lag(t_ms) OVER (PARTITION BY record_id ORDER BY t_ms) < {18 * H} THEN 0 ELSE 1 END AS n FROM e), g AS (SELECT *, sum(n) OVER (PARTITION BY record_id ORDER BY t_ms ROWS UNBOUNDED PRECEDING) AS x FROM h) SELECT record_id, arg_max(t_ms, (channels, -t_ms)) AS t_ms, max(channels) AS channels FROM g GROUP BY record_id, x")
def _(t):
    return E.refractory_dedupe(E.gap_clusters(t.evts, 6 * H, 2), 18 * H)


@query("e06_organised_sequence", f"WITH {_STATS} SELECT record_id, n + 1 AS n_events, round(median, 3) AS median, round(cv, 6) AS cv, coalesce(n + 1 >= 4 AND median BETWEEN {3 * H} AND {15 * H} AND cv <= 0.9, false) AS organised FROM s")
def _(t):
    return E.organised_sequence(t.evts, 3 * H, 15 * H, 0.9).withColumn("median", F.round("median", 3))


@query("e07_conduction_class")
def _(t):
    return P.conduction_class(kind(t, "view"), kind(t, "purchase"), H, 48.0 * H, 20.0 * H, 12.0 * H, 1.0 * H, 2.0 * H, regular=0.9)


_GAPS = "{0}g AS (SELECT record_id, count(*) AS n, median(g) AS m, CASE WHEN count(g) >= 2 THEN stddev_samp(g) / avg(g) END AS cv FROM (SELECT record_id, t_ms - lag(t_ms) OVER (PARTITION BY record_id ORDER BY t_ms) AS g FROM {0}) GROUP BY 1)"


@query(
    "e08_sequence_topology",
    f"WITH {_ONE}, {_GAPS.format('p')}, {_GAPS.format('r')}, x AS (SELECT record_id, t_ms AS t, (SELECT max(t_ms) FROM r WHERE r.record_id = p.record_id AND r.t_ms < p.t_ms) AS rb, (SELECT min(t_ms) FROM r WHERE r.record_id = p.record_id AND r.t_ms > p.t_ms) AS ra FROM p), y AS (SELECT *, CASE WHEN ra - t BETWEEN {H} AND {48 * H} THEN ra - t END AS d, row_number() OVER (PARTITION BY record_id ORDER BY t) - 1 AS i FROM x), "
    "z AS (SELECT *, sum(CAST(d IS NOT NULL AS INT)) OVER w AS island, lag(d, 1) OVER w AS d1, lag(d, 2) OVER w AS d2, lag(d, 3) OVER w AS d3, CASE WHEN d IS NULL THEN CAST(t - rb AS DOUBLE) / (ra - rb) END AS place FROM y WINDOW w AS (PARTITION BY record_id ORDER BY t)), l AS (SELECT record_id, max(s) AS longest FROM (SELECT record_id, island, count(*) FILTER (d IS NULL) AS s FROM z GROUP BY 1, 2) GROUP BY 1), "
    f"a AS (SELECT record_id, count(d) AS c, count(*) AS n, abs(count(d) FILTER (i % 2 = 0) - count(d) FILTER (i % 2 = 1)) >= greatest(1, count(*) // 3) AS alt, bool_or(coalesce(d IS NULL AND d2 - d3 > {H} AND d1 - d2 > {H}, false)) AS rising, count(place) AS dn, count(*) FILTER (place BETWEEN 0.25 AND 0.75) AS dmid, median(place) AS dm, median(d) AS pm FROM z GROUP BY 1), k AS (SELECT z.record_id, CASE WHEN count(d) >= 3 THEN median(abs(d - pm)) END AS mad FROM z JOIN a USING (record_id) GROUP BY 1), "
    "h AS (SELECT record_id, d, median(d) OVER (PARTITION BY record_id) AS m FROM (SELECT r.record_id, r.t_ms - (SELECT max(t_ms) FROM p WHERE p.record_id = r.record_id AND p.t_ms < r.t_ms) AS d, pg.m AS g FROM r JOIN pg USING (record_id)) WHERE d <= 1.05::DOUBLE * g), f AS (SELECT record_id, count(*) AS n, median(abs(d - m)) AS mad, max(d) - min(d) AS span FROM h GROUP BY 1), "
    f"o AS (SELECT i.record_id, coalesce(pg.n, 0) AS p_n, coalesce(rg.n, 0) AS r_n, coalesce(pg.n, 0) >= 4 AND coalesce(rg.n, 0) >= 3 AS e, pg.cv AS pcv, rg.cv AS rcv, c, a.n - c AS dropped, longest, alt, coalesce(k.mad <= {20 * H}, false) AS stable, rising, coalesce(f.n >= 3 AND f.mad >= greatest({2 * H}, 0.15::DOUBLE * pg.m) AND f.span >= 0.30::DOUBLE * pg.m, false) AS diss, dmid, dn, dm, pm, k.mad AS mad FROM (SELECT record_id FROM p UNION SELECT record_id FROM r) i LEFT JOIN pg USING (record_id) LEFT JOIN rg USING (record_id) LEFT JOIN a USING (record_id) LEFT JOIN l USING (record_id) LEFT JOIN k USING (record_id) LEFT JOIN f USING (record_id)) "
    "SELECT record_id, e AS evaluable, p_n, r_n, CASE WHEN e THEN round(pcv, 6) END AS pp_cv, CASE WHEN e THEN round(rcv, 6) END AS rr_cv, CASE WHEN e THEN c END AS conducted_n, CASE WHEN e THEN dropped END AS dropped_n, CASE WHEN e THEN longest END AS max_consecutive_drop, CASE WHEN e THEN round(p_n / r_n, 6) END AS p_r_ratio, CASE WHEN e THEN alt END AS alternating, CASE WHEN e THEN stable END AS stable_pr, CASE WHEN e THEN rising END AS progressive_pr, CASE WHEN e THEN diss END AS phase_dissociation, CASE WHEN e THEN dmid END AS dropped_rr_phase_mid_n, CASE WHEN e THEN dn END AS dropped_rr_phase_n, CASE WHEN e THEN round(dm, 6) END AS dropped_rr_phase_median, CASE WHEN e THEN round(pm, 6) END AS pr_median_ms, CASE WHEN e THEN round(mad, 6) END AS pr_mad_ms FROM o",
)
def _(t):
    out = P.sequence_topology(kind(t, "view"), kind(t, "purchase"), H, 48.0 * H, 20.0 * H, 1.0 * H, 2.0 * H)
    return out.select(*[C(c).cast("bigint").alias(c) if d == "int" else C(c) for c, d in out.dtypes])


@query("e09_coupling_relation")
def _(t):
    return E.coupling_relation(kind(t, "view"), kind(t, "purchase"), float(H), 48.0 * H, 0.3, 12.0 * H)


@query("e10_relative_amplitude_filter", "WITH k AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY amplitude DESC NULLS LAST, event_id) AS k, count(amplitude) OVER (PARTITION BY record_id) AS n FROM evts), r AS (SELECT record_id, median(amplitude) AS reference FROM k WHERE k <= ceil(n / 2) GROUP BY 1) SELECT event_id, round(reference, 6) AS reference FROM evts JOIN r USING (record_id) WHERE amplitude >= 0.15 * reference")
def _(t):
    return E.relative_amplitude_filter(t.evts).select("event_id", "reference")


@query("e11_threshold_sweep", f"WITH k AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY amplitude DESC NULLS LAST, event_id) AS k, count(amplitude) OVER (PARTITION BY record_id) AS n FROM evts WHERE kind = 'view'), r AS (SELECT record_id, median(amplitude) AS reference FROM k WHERE k <= ceil(n / 2) GROUP BY 1), h AS (SELECT unnest([0.15::DOUBLE, 0.2::DOUBLE, 0.25::DOUBLE]) AS threshold), b0 AS (SELECT threshold, record_id, t_ms FROM h, k LEFT JOIN r USING (record_id) WHERE amplitude IS NULL OR reference IS NULL OR amplitude >= threshold * reference), b AS (SELECT *, row_number() OVER (PARTITION BY threshold, record_id, t_ms) AS n FROM b0), a AS (SELECT threshold, x.* FROM h, ({_NUMBERED}'purchase') x), p AS (SELECT threshold, record_id, {_PAIRS} FROM a JOIN b USING (threshold, record_id) WHERE abs(a.t_ms - b.t_ms) <= {6 * H} GROUP BY 1, 2), m AS (SELECT threshold, sum(len({_FOLD})) AS matched FROM p GROUP BY 1), t AS (SELECT threshold, count(*) AS x FROM a GROUP BY 1), f AS (SELECT threshold, count(*) AS y FROM b GROUP BY 1) SELECT threshold, CAST(coalesce(matched, 0) AS BIGINT) AS matched, CAST(x - coalesce(matched, 0) AS BIGINT) AS missed, CAST(y - coalesce(matched, 0) AS BIGINT) AS extra FROM t JOIN f USING (threshold) LEFT JOIN m USING (threshold)")
def _(t):
    return E.threshold_sweep(kind(t, "view"), kind(t, "purchase"), [0.15, 0.2, 0.25], 6 * H)


@query("e12_extra_event_attribution", f"WITH a AS (SELECT event_id, EXISTS (SELECT 1 FROM evts b WHERE b.kind = 'view' AND b.record_id = e.record_id AND abs(b.t_ms - e.t_ms) <= {3 * H}) AS p, EXISTS (SELECT 1 FROM evts b WHERE b.kind = 'error' AND b.record_id = e.record_id AND abs(b.t_ms - e.t_ms) <= {3 * H}) AS q FROM evts e WHERE kind = 'signup') SELECT event_id, CASE WHEN p THEN 'near_p' WHEN q THEN 'near_t' ELSE 'other' END AS attribution FROM a")
def _(t):
    return E.extra_event_attribution(kind(t, "signup"), kind(t, "view"), kind(t, "error"), 3 * H).select("event_id", "attribution")


_SAM = "s AS (SELECT vec_id AS record_id, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"


# Kinds of events stand for leads, days for seconds.
_DAY = 86_400_000
_LEADS = f"g AS (SELECT record_id, kind, t_ms, t_ms - lag(t_ms) OVER (PARTITION BY record_id, kind ORDER BY t_ms) AS gap FROM (SELECT DISTINCT record_id, kind, t_ms FROM evts)), v AS (SELECT record_id, kind, stddev_samp(gap) / avg(gap) AS pp_cv FROM g WHERE gap IS NOT NULL GROUP BY 1, 2), a AS (SELECT record_id, kind AS lead, (max(t_ms) - min(t_ms)) / {_DAY}.0::DOUBLE AS duration_s, count(*) AS r_count, count(DISTINCT t_ms) AS p_count, avg(amplitude) / 100 AS confidence, count(*) FILTER (amplitude > 50) AS high FROM evts GROUP BY 1, 2), leads AS (SELECT a.*, v.pp_cv FROM a LEFT JOIN v ON a.record_id = v.record_id AND a.lead = v.kind)"


def leads(t):
    a = t.evts.groupBy("record_id", C("kind").alias("lead")).agg(((F.max("t_ms") - F.min("t_ms")) / float(_DAY)).alias("duration_s"), F.count("*").alias("r_count"), F.countDistinct("t_ms").alias("p_count"), (F.avg("amplitude") / 100).alias("confidence"), F.count_if(C("amplitude") > 50).alias("high"))
    cv = E.interval_stats(t.evts, ("record_id", "kind")).select("record_id", C("kind").alias("lead"), C("cv").alias("pp_cv"))
    return a.join(cv, ["record_id", "lead"], "left")


@query("w12_rhythm_lead_pick", f"WITH {_LEADS}, u AS (SELECT *, lead = 'view' AND duration_s >= 5 AND r_count >= 5 AS usual FROM leads WHERE high > 0) SELECT record_id, arg_max(lead, (usual, duration_s * greatest(confidence, 0.1), lead)) AS lead FROM u WHERE usual OR r_count >= 4 GROUP BY 1")
def _(t):
    return E.rhythm_lead_pick(leads(t).withColumn("evaluable", C("high") > 0), "view", 5.0)


@query("w12_conduction_lead_pick", f"WITH {_LEADS}, s AS (SELECT record_id, lead, 40.0::DOUBLE * CAST(high > 2 AS INT) + 25.0::DOUBLE * coalesce(CAST(pp_cv <= 0.12 AS INT), 0) + 10.0::DOUBLE * least(1.0, greatest(0.0, confidence)) + 8.0::DOUBLE * least(1.0, high / r_count) + least(p_count, 12) + 0.5::DOUBLE * least(r_count, 12) + 2.0::DOUBLE * (4 - list_position(['view', 'click', 'purchase'], lead)) / 3 AS score FROM leads WHERE lead IN ('view', 'click', 'purchase') AND high > 0 AND p_count >= 4 AND r_count >= 3) SELECT record_id, arg_max(lead, (score, lead)) AS lead, round(max(score), 6) AS score FROM s GROUP BY 1")
def _(t):
    x = leads(t).withColumns({"evaluable": C("high") > 0, "reproducible": C("high") > 2, "coupling": C("high") / C("r_count")})
    return E.conduction_lead_pick(x, ["view", "click", "purchase"])


# Halves of an embedding stand for two leads; templates are the mean waves of the labels.
_WINDOWS = [(0, 12, 0.12), (8, 12, 0.48), (16, 16, 0.40)]
_HALVES = "s AS (SELECT vec_id AS record_id, label, i // 32 AS lead, i % 32 AS i, v FROM (SELECT vec_id, label, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)), m AS (SELECT label AS template, lead, i, avg(v) AS v FROM s GROUP BY ALL)"


def halves(t):
    rows = t.embeddings.filter(F.size("embedding") > 0).select(C("vec_id").alias("record_id"), "label", C("embedding").cast("array<double>").alias("v"))
    waves = rows.withColumn("lead", F.explode(F.sequence(F.lit(0), F.floor((F.size("v") - 1) / 32).cast("int")))).withColumn("wave", F.slice("v", C("lead") * 32 + 1, F.lit(32)))
    means = waves.select(C("label").alias("template"), "lead", F.posexplode("wave").alias("i", "v")).groupBy("template", "lead", "i").agg(F.avg("v").alias("v"))
    templates = means.groupBy("template", "lead").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("wave"))
    return waves.select("record_id", "lead", "wave"), templates


_WAVES = (
    f"{_HALVES}, w(k, first, size, weight) AS (VALUES {', '.join(f'({k}, {a}, {n}, {x}::DOUBLE)' for k, (a, n, x) in enumerate(_WINDOWS))}), c AS (SELECT s.record_id, m.template, s.lead, w.k, w.weight, d.d, corr(s.v, m.v) AS c FROM s JOIN w ON s.i >= w.first AND s.i < w.first + w.size JOIN (VALUES (-2), (-1), (0), (1), (2)) d(d) ON s.i + d.d >= w.first AND s.i + d.d < w.first + w.size JOIN m ON m.lead = s.lead AND m.i = s.i + d.d GROUP BY ALL HAVING count(*) >= 10), b AS (SELECT record_id, template, lead, weight, least(1, greatest(0, (max(c) + 1) / 2)) AS shape FROM c GROUP BY record_id, template, lead, k, weight), "
    "h AS (SELECT record_id, template, lead, sum(shape * weight) / sum(weight) AS shape FROM b GROUP BY ALL), p AS (SELECT record_id, lead, max(v) - min(v) AS p FROM s GROUP BY ALL), q AS (SELECT template, lead, max(v) - min(v) AS q FROM m GROUP BY ALL), l AS (SELECT record_id, template, avg(0.85::DOUBLE * shape + 0.15::DOUBLE * exp(-abs(ln((p + 1e-6) / (q + 1e-6))))) AS visual FROM h JOIN p USING (record_id, lead) JOIN q USING (template, lead) GROUP BY ALL), "
)


@query(
    "e13_template_rank",
    f"WITH {_WAVES}"
    "x AS (SELECT l.*, CASE WHEN e.label = template THEN 1.0::DOUBLE WHEN template % 3 = 0 THEN 0.1::DOUBLE END AS criteria, CASE WHEN template % 2 = 0 THEN 0.8::DOUBLE END AS measurement FROM l JOIN embeddings e ON e.vec_id = record_id), f AS (SELECT *, (0.35::DOUBLE * visual + coalesce(0.45::DOUBLE * criteria, 0) + coalesce(0.20::DOUBLE * measurement, 0)) / (0.35::DOUBLE + CASE WHEN criteria IS NULL THEN 0 ELSE 0.45::DOUBLE END + CASE WHEN measurement IS NULL THEN 0 ELSE 0.20::DOUBLE END) AS fusion FROM x), r AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY round(fusion, 6) DESC, template) AS rank FROM f) "
    "SELECT record_id, template, round(fusion, 6) AS fusion, CASE WHEN criteria >= 0.95 AND visual >= 0.72 AND fusion >= 0.75 THEN 'CONCORDANT_HIGH' WHEN criteria >= 0.95 AND visual >= 0.56 AND fusion >= 0.63 THEN 'CONCORDANT_MODERATE' WHEN criteria >= 0.95 THEN 'CRITERIA_POSITIVE_VISUAL_DISCORDANT' WHEN criteria IS NULL AND visual >= 0.78 THEN 'VISUAL_ONLY_NO_RULE' WHEN criteria <= 0.20 AND visual >= 0.78 THEN 'VISUAL_MATCH_WITHOUT_CRITERIA' WHEN criteria <= 0.20 AND fusion < 0.60 THEN 'NOT_SUPPORTED' ELSE 'INDETERMINATE' END AS status, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3",
)
def _(t):
    scores = E.template_scores(*halves(t), _WINDOWS, 2).join(t.embeddings.select(C("vec_id").alias("record_id"), "label"), "record_id")
    scores = scores.withColumns({"criteria": F.when(C("label") == C("template"), 1.0).when(C("template") % 3 == 0, 0.1), "measurement": F.when(C("template") % 2 == 0, 0.8)})
    return E.fused_rank(scores)


_STATS2 = re.sub(r"\b(g0|g|a|m|s)\b", r"st_\1", _STATS)
_BOUNDS = [(100, "median_h", 10.0, 30.0), (100, "cv", 0.0, 1.0), (3, "cv", 0.5, 0.7)]


@query(
    "e13_rhythm_patterns",
    f"WITH {_WAVES}{_STATS2}, qs AS (SELECT *, coalesce(cv <= 0.10 AND mad / median <= 0.08, false) AS vr FROM st_s), st AS (SELECT record_id, 'IRREGULAR' AS rule_id, CASE WHEN n < 4 OR cv IS NULL THEN 'NOT_ASSESSABLE' WHEN cv > 0.9 AND mad / median <= 0.08 THEN 'CONFOUNDED' WHEN cv > 0.9 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS status FROM qs UNION ALL SELECT record_id, 'VERY_REGULAR', CASE WHEN n < 4 OR cv IS NULL THEN 'NOT_ASSESSABLE' WHEN vr THEN 'POSITIVE' ELSE 'NEGATIVE' END FROM qs), pat(template, rule_id) AS (VALUES (100, 'IRREGULAR'), (101, 'VERY_REGULAR'), (102, 'ABSENT')), "
    "vis AS (SELECT record_id, template, visual, 1.0::DOUBLE AS coverage FROM l UNION ALL SELECT e.vec_id, pat.template, CASE status WHEN 'POSITIVE' THEN 0.90::DOUBLE WHEN 'NEGATIVE' THEN 0.15::DOUBLE WHEN 'CONFOUNDED' THEN 0.35::DOUBLE ELSE 0.50::DOUBLE END, 1.0::DOUBLE FROM embeddings e CROSS JOIN pat LEFT JOIN st ON st.record_id = e.vec_id AND st.rule_id = pat.rule_id), "
    "rul(template, rule_id) AS (VALUES (100, 'IRREGULAR'), (101, 'VERY_REGULAR'), (3, 'IRREGULAR'), (3, 'VERY_REGULAR')), cri AS (SELECT record_id, template, avg(CASE status WHEN 'POSITIVE' THEN 1.0::DOUBLE WHEN 'NEGATIVE' THEN 0.0::DOUBLE WHEN 'CONFOUNDED' THEN 0.35::DOUBLE END) AS criteria FROM st JOIN rul USING (rule_id) GROUP BY ALL), "
    f"bnd(template, key, lo, hi) AS (VALUES {', '.join(f"({a}, '{b}', {c}::DOUBLE, {d}::DOUBLE)" for a, b, c, d in _BOUNDS)}), mes AS (SELECT record_id, 'cv' AS key, cv AS value FROM qs UNION ALL SELECT record_id, 'median_h', median / {H} FROM qs), con AS (SELECT record_id, template, avg(exp(-greatest(lo - value, value - hi, 0) / greatest(10, (hi - lo) * 0.30::DOUBLE))) AS measurement FROM mes JOIN bnd USING (key) WHERE value IS NOT NULL GROUP BY ALL), "
    "x AS (SELECT vis.*, criteria, measurement FROM vis LEFT JOIN cri USING (record_id, template) LEFT JOIN con USING (record_id, template)), f AS (SELECT *, (0.35::DOUBLE * visual + coalesce(0.45::DOUBLE * criteria, 0) + coalesce(0.20::DOUBLE * measurement, 0)) / (0.35::DOUBLE + CASE WHEN criteria IS NULL THEN 0 ELSE 0.45::DOUBLE END + CASE WHEN measurement IS NULL THEN 0 ELSE 0.20::DOUBLE END) AS fusion FROM x), r AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY round(fusion, 6) DESC, template) AS rank FROM f) "
    "SELECT record_id, template, round(fusion, 6) AS fusion, CASE WHEN criteria >= 0.95 AND visual >= 0.72 AND fusion >= 0.75 THEN 'CONCORDANT_HIGH' WHEN criteria >= 0.95 AND visual >= 0.56 AND fusion >= 0.63 THEN 'CONCORDANT_MODERATE' WHEN criteria >= 0.95 THEN 'CRITERIA_POSITIVE_VISUAL_DISCORDANT' WHEN criteria IS NULL AND visual >= 0.78 THEN 'VISUAL_ONLY_NO_RULE' WHEN criteria <= 0.20 AND visual >= 0.78 THEN 'VISUAL_MATCH_WITHOUT_CRITERIA' WHEN criteria <= 0.20 AND fusion < 0.60 THEN 'NOT_SUPPORTED' ELSE 'INDETERMINATE' END AS status, CAST(rank AS INT) AS rank FROM r WHERE rank <= 4",
)
def _(t):
    # Waves are those of the embeddings; the rhythm of a record is that of the user with its id, where there is one.
    stats = written(E.interval_stats(t.evts, short=H), "interval_stats")
    states = N.rhythm_states(stats, 0.9)
    table = lambda rows, schema: t.spark.createDataFrame(rows, schema)
    patterns = table([(100, "IRREGULAR"), (101, "VERY_REGULAR"), (102, "ABSENT")], "template int, rule_id string")
    rules = table([(100, "IRREGULAR"), (101, "VERY_REGULAR"), (3, "IRREGULAR"), (3, "VERY_REGULAR")], "template int, rule_id string")
    measures = stats.select("record_id", F.explode(F.create_map(F.lit("cv"), C("cv"), F.lit("median_h"), C("median") / H)).alias("key", "value"))
    constraints = table(_BOUNDS, "template int, key string, lo double, hi double")
    visual = [E.template_scores(*halves(t), _WINDOWS, 2), N.rhythm_scores(t.embeddings.select(C("vec_id").alias("record_id")), states, patterns)]
    return N.pattern_rank(visual, N.criteria_scores(states, rules), N.constraint_scores(measures, constraints), 4)


@query(
    "e17_harmonic_period",
    f"WITH {_ONE}, {_GAPS.format('p')}, {_GAPS.format('r')}, g AS (SELECT record_id, CAST(t_ms - lag(t_ms) OVER (PARTITION BY record_id ORDER BY t_ms) AS DOUBLE) AS gap FROM p), h AS (SELECT * FROM g WHERE gap > 0), c AS (SELECT DISTINCT record_id, gap / k AS period FROM h, (VALUES (1), (2), (3), (4)) v(k) WHERE gap / k BETWEEN {3.0 * H} AND {90.0 * H}), m AS (SELECT c.record_id, period, median(abs(gap - greatest(1, round_even(gap / period, 0)) * period) / period) AS residual FROM c JOIN h ON c.record_id = h.record_id GROUP BY 1, 2), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY round(residual, 9), period DESC) AS n FROM m) WHERE n = 1), "
    "s AS (SELECT record_id, min(t_ms) AS first FROM p GROUP BY 1), w AS (SELECT r.record_id, period, CAST(r.t_ms - first AS DOUBLE) % period AS v FROM r JOIN s USING (record_id) JOIN b USING (record_id)), q AS (SELECT record_id, period, CASE WHEN v < 0 THEN v + period ELSE v END AS v FROM w), u AS (SELECT *, row_number() OVER o AS k, round(coalesce(lead(v) OVER o, first_value(v) OVER o + period) - v, 6) AS ahead FROM q WINDOW o AS (PARTITION BY record_id ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), "
    "cut AS (SELECT record_id, arg_max(k, (ahead, -k)) AS upto FROM u GROUP BY 1), ring AS (SELECT record_id, CASE WHEN k > upto THEN v ELSE v + period END AS v FROM u JOIN cut USING (record_id)), y AS (SELECT record_id, median(v) AS m, max(v) - min(v) AS span, count(*) AS n FROM ring GROUP BY 1), z AS (SELECT ring.record_id, median(abs(v - m)) AS mad FROM ring JOIN y USING (record_id) GROUP BY 1), "
    f"o AS (SELECT pg.record_id, pg.n AS event_n, pg.n >= 3 AND coalesce(rg.n, 0) >= 3 AS e, b.period, b.residual, rg.cv, coalesce(b.residual <= 0.12, false) AS cons, coalesce(rg.cv <= 0.9, false) AS reg, coalesce(60000 / b.period > 1.25::DOUBLE * 60000 / rg.m, false) AS fast, z.mad, y.span, coalesce(y.n >= 3 AND z.mad >= greatest({2 * H}, 0.15::DOUBLE * b.period) AND y.span >= 0.30::DOUBLE * b.period, false) AS diss FROM pg LEFT JOIN rg USING (record_id) LEFT JOIN b USING (record_id) LEFT JOIN y USING (record_id) LEFT JOIN z USING (record_id)) "
    "SELECT record_id, e AS evaluable, event_n, CASE WHEN e THEN round(period, 6) END AS period, CASE WHEN e THEN round(residual, 6) END AS residual, CASE WHEN e THEN round(60000 / period, 6) END AS atrial_rate, CASE WHEN e THEN round(cv, 6) END AS rr_cv, CASE WHEN e THEN round(mad, 3) END AS phase_mad, CASE WHEN e THEN round(span, 3) END AS phase_range, e AND cons AS harmonic_consistent, e AND reg AS ventricular_regular, e AND fast AS faster, e AND diss AS phase_dissociation, e AND cons AND fast AND reg AND diss AS complete_block FROM o",
)
def _(t):
    out = P.harmonic_period(kind(t, "view"), kind(t, "purchase"), 3.0 * H, 90.0 * H, 2.0 * H, regular=0.9)
    return out.withColumns({c: F.round(c, 3) for c in ("phase_mad", "phase_range")}).withColumn("event_n", C("event_n").cast("bigint"))


def series(t):
    return t.embeddings.select(C("vec_id").alias("record_id"), F.posexplode("embedding").alias("i", "x")).select("record_id", "i", C("x").cast("double").alias("v"))


@query("e18_trim_padding", f"WITH {_SAM}, l AS (SELECT record_id, min(i) AS a, max(i) AS b FROM s WHERE abs(v) > 0.2 GROUP BY 1) SELECT record_id, i - a AS i, round(v, 6) AS v FROM s JOIN l USING (record_id) WHERE i BETWEEN a AND b")
def _(t):
    return E.trim_padding(series(t), 0.2).withColumn("i", C("i").cast("bigint"))


@query("e19_fill_short_gaps", f"WITH {_SAM}, h AS (SELECT record_id, i, CASE WHEN i % 11 IN (3, 4) OR i BETWEEN 30 AND 37 THEN NULL ELSE v END AS v FROM s), x AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS i0, last_value(v IGNORE NULLS) OVER b AS v0, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER f AS i1, first_value(v IGNORE NULLS) OVER f AS v1 FROM h WINDOW b AS (PARTITION BY record_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY record_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT record_id, i, round(CASE WHEN v IS NULL AND i1 - i0 - 1 <= 4 THEN v0 + (v1 - v0) * (i - i0) / (i1 - i0) ELSE v END, 6) AS v, coalesce(v IS NULL AND i1 - i0 - 1 <= 4, false) AS interpolated FROM x")
def _(t):
    holes = series(t).withColumn("v", F.when(~((C("i") % 11).isin(3, 4) | C("i").between(30, 37)), C("v")))
    return E.fill_short_gaps(holes, 4).withColumn("i", C("i").cast("bigint"))


@query("e20_resample_grid", f"WITH s AS (SELECT record_id, t_ms, avg(amplitude) AS v FROM evts GROUP BY 1, 2), n AS (SELECT *, lead(t_ms) OVER w AS t1, lead(v) OVER w AS v1 FROM s WINDOW w AS (PARTITION BY record_id ORDER BY t_ms)), g AS (SELECT *, unnest(range(CAST(ceil(t_ms / {2 * H}) AS BIGINT), CAST(ceil(t1 / {2 * H}) AS BIGINT))) * {2 * H} AS grid_ms FROM n WHERE t1 - t_ms <= {24 * H}) SELECT record_id, grid_ms, round(v + (v1 - v) * (grid_ms - t_ms) / (t1 - t_ms), 6) AS v, CASE WHEN grid_ms = t_ms THEN 2 ELSE 1 END AS quality FROM g")
def _(t):
    return E.resample_grid(t.evts.withColumnRenamed("amplitude", "v"), 2 * H, 24 * H)


@query("e21_despike", f"WITH {_SAM}, y AS (SELECT record_id, i, CASE WHEN i % 19 = 7 THEN v + 9 ELSE v END AS v FROM s), x AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b, abs(v - lag(v) OVER w) AS st FROM y WINDOW w AS (PARTITION BY record_id ORDER BY i)), m AS (SELECT record_id, median(st) AS m FROM x GROUP BY 1), d AS (SELECT x.record_id, max(m) AS m, median(abs(st - m)) AS mad FROM x JOIN m USING (record_id) GROUP BY 1) SELECT record_id, i, round(v, 6) AS v FROM x JOIN d USING (record_id) WHERE NOT coalesce(abs(v - (a + b) / 2) > greatest(1.5, m + 12 * mad) AND abs(a - b) <= greatest(1.5, m + 12 * mad), false)")
def _(t):
    return E.despike(series(t).withColumn("v", F.when(C("i") % 19 == 7, C("v") + 9).otherwise(C("v")))).withColumn("i", C("i").cast("bigint"))


@query("e22_channel_regularity", f"WITH {_CLUST}, o AS (SELECT record_id, stddev_samp(gap) / avg(gap) AS cv FROM (SELECT record_id, t_ms - lag(t_ms) OVER (PARTITION BY record_id ORDER BY t_ms) AS gap FROM (SELECT DISTINCT record_id, t_ms FROM evts WHERE kind = 'view')) WHERE gap IS NOT NULL GROUP BY 1), q AS (SELECT record_id, stddev_samp(gap) / avg(gap) AS cv FROM (SELECT record_id, t_ms - lag(t_ms) OVER (PARTITION BY record_id ORDER BY t_ms) AS gap FROM (SELECT DISTINCT record_id, t_ms FROM k WHERE channels >= 3)) WHERE gap IS NOT NULL GROUP BY 1) SELECT coalesce(o.record_id, q.record_id) AS record_id, round(o.cv, 6) AS channel_cv, round(q.cv, 6) AS consensus_cv FROM o FULL JOIN q ON o.record_id = q.record_id")
def _(t):
    return E.channel_regularity(t.evts, "view", 6 * H)
