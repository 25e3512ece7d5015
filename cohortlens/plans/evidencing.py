"""Evidence and learning queries: R1-R7, M1, T1, T2."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.operators import evidence as V
from cohortlens.plans.registry import query
from cohortlens.sources.shared import written
from cohortlens.streaming import streams

C = F.col
_F = "f AS (SELECT l_orderkey AS record_id, max(l_quantity) AS q, max(l_discount) AS d, max(l_tax) AS x, count(*) AS n, min(l_quantity) AS qmin FROM lineitem GROUP BY 1)"


def features(t):
    return t.lineitem.groupBy(C("l_orderkey").alias("record_id")).agg(F.max("l_quantity").alias("q"), F.max("l_discount").alias("d"), F.max("l_tax").alias("x"), F.count("*").alias("n"), F.min("l_quantity").alias("qmin"))


_PARTS = [("AF", "q > 40", 0.5, "rr"), ("AF", "d > 0.07", 0.3, "p"), ("AF", "x > 0.05", 0.3, "f"), ("BBB", "qmin < 10", 0.6, "qrs"), ("BBB", "n > 4", 0.4, "lead")]
_CAND = f"{_F}, e AS ({' UNION ALL '.join(f'''SELECT record_id, '{c}' AS code, {w} AS w, '{s}' AS source FROM f WHERE {p}''' for c, p, w, s in _PARTS)}), c AS (SELECT record_id, code, least(1.0::DOUBLE, sum(w::DOUBLE)) AS score, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(DISTINCT source) AS n_sources FROM e GROUP BY 1, 2)"


def candidates(f):
    return V.evidence_candidates(f, [(c, F.expr(p), w, s) for c, p, w, s in _PARTS])


@query("r01_evidence_candidates", f"WITH {_CAND} SELECT record_id, code, round(score, 6) AS score, sources, n_sources FROM c")
def _(t):
    return candidates(features(t))


_CHECKS = [("WIDTH", "BLOCKING", "q - qmin > 45"), ("RATE", "WARNING", "d > 0.09"), ("PR", "BLOCKING", "x >= 0.08 and n > 5")]
_CONF = f"k AS ({' UNION ALL '.join(f'''SELECT record_id, '{c}' AS code, '{s}' AS severity FROM f WHERE {p}''' for c, s, p in _CHECKS)})"


def conflicts(f):
    return V.consistency_conflicts(f, [(c, s, F.expr(p)) for c, s, p in _CHECKS])


@query("r02_consistency_conflicts", f"WITH {_F}, {_CONF} SELECT * FROM k")
def _(t):
    return conflicts(features(t))


_GATES = f"{_CONF}, dm(domain) AS (VALUES ('RHYTHM'), ('BUNDLE_BRANCH'), ('AV')), cm(code, domain) AS (VALUES ('WIDTH', 'BUNDLE_BRANCH'), ('PR', 'AV'), ('PR', 'RHYTHM'), ('RATE', 'RHYTHM')), un AS (SELECT record_id, 'qrs_ms' AS measure FROM f WHERE qmin < 3 UNION ALL SELECT record_id, 'pr_ms' FROM f WHERE n = 1), mm(measure, domain) AS (VALUES ('qrs_ms', 'BUNDLE_BRANCH'), ('pr_ms', 'AV')), b AS (SELECT record_id, domain, count(DISTINCT code) AS nc FROM k JOIN cm USING (code) WHERE severity = 'BLOCKING' GROUP BY 1, 2), u AS (SELECT record_id, domain, count(DISTINCT measure) AS nu FROM un JOIN mm USING (measure) JOIN f USING (record_id) WHERE NOT (domain = 'BUNDLE_BRANCH' AND n >= 4) GROUP BY 1, 2), g AS (SELECT f.record_id, dm.domain, coalesce(nc, 0) AS n_conflicts, coalesce(nu, 0) AS n_unusable, coalesce(nc, 0) = 0 AND coalesce(nu, 0) = 0 AS eligible FROM f CROSS JOIN dm LEFT JOIN b ON b.record_id = f.record_id AND b.domain = dm.domain LEFT JOIN u ON u.record_id = f.record_id AND u.domain = dm.domain)"


def kept(t):
    """features of lineitem, written once for all that ask."""
    return written(features(t), "features")


def gates(f):
    s = f.sparkSession
    unusable = f.filter("qmin < 3").select("record_id", F.lit("qrs_ms").alias("measure")).unionByName(f.filter("n = 1").select("record_id", F.lit("pr_ms").alias("measure")))
    cm = s.createDataFrame([("WIDTH", "BUNDLE_BRANCH"), ("PR", "AV"), ("PR", "RHYTHM"), ("RATE", "RHYTHM")], "code string, domain string")
    mm = s.createDataFrame([("qrs_ms", "BUNDLE_BRANCH"), ("pr_ms", "AV")], "measure string, domain string")
    rescues = f.filter("n >= 4").select("record_id", F.lit("BUNDLE_BRANCH").alias("domain"), F.lit("qrs_ms").alias("measure"))
    return V.domain_gates(f, conflicts(f), unusable, cm, mm, rescues, ["RHYTHM", "BUNDLE_BRANCH", "AV"])


@query("r03_domain_gates", f"WITH {_F}, {_GATES} SELECT * FROM g")
def _(t):
    return gates(kept(t))


_FUSE = f"{_CAND}, {_GATES}, z AS (SELECT c.record_id, CASE c.code WHEN 'AF' THEN 'RHYTHM' ELSE 'BUNDLE_BRANCH' END AS domain, c.code, c.score, c.n_sources, c.record_id % 7 = 0 AS sp, CASE WHEN c.record_id % 11 = 0 THEN 1 ELSE 0 END AS nr, CASE WHEN c.record_id % 13 = 0 THEN 1 ELSE 0 END AS nb FROM c), w AS (SELECT z.*, eligible, CASE WHEN sp THEN least(CASE code WHEN 'AF' THEN 0.7::DOUBLE ELSE 0.8::DOUBLE END, 0.6::DOUBLE) ELSE CASE code WHEN 'AF' THEN 0.7::DOUBLE ELSE 0.8::DOUBLE END END AS t, CASE WHEN sp THEN 2 WHEN code = 'AF' THEN 2 ELSE 3 END AS ns FROM z LEFT JOIN g USING (record_id, domain)), fu AS (SELECT record_id, domain, code, score, CASE WHEN nr > 0 THEN 'MEASUREMENT_ABSTENTION' WHEN nb > 0 THEN 'BOUNDARY_UNCERTAIN' WHEN NOT coalesce(eligible, false) THEN 'DOMAIN_ABSTENTION' WHEN score >= t AND n_sources >= ns THEN CASE WHEN sp THEN 'ESTABLISHED' ELSE 'PROBABLE' END ELSE 'CANDIDATE_REVIEW' END AS state FROM w)"


def fused(t):
    f = kept(t)
    c = candidates(f).select("record_id", F.when(C("code") == "AF", "RHYTHM").otherwise("BUNDLE_BRANCH").alias("domain"), "code", "score", "n_sources", (C("record_id") % 7 == 0).alias("specialist"), F.when(C("record_id") % 11 == 0, 1).otherwise(0).alias("n_unresolved"), F.when(C("record_id") % 13 == 0, 1).otherwise(0).alias("n_boundary"))
    return V.fuse_evidence(c, gates(f), t.spark.createDataFrame([("AF", 0.7, 2)], "code string, threshold double, min_sources int"), ["GENERIC"])


@query("r04_fuse_evidence", f"WITH {_FUSE} SELECT record_id, domain, code, round(score, 6) AS score, state, state IN ('ESTABLISHED', 'PROBABLE') AS publishable FROM fu")
def _(t):
    return fused(t)


@query("r05_final_findings", f"WITH {_FUSE} SELECT record_id, coalesce(max(CASE WHEN state IN ('ESTABLISHED', 'PROBABLE') AND domain = 'RHYTHM' THEN code END), '') AS primary_rhythm, '' AS secondary, coalesce(max(CASE WHEN state IN ('ESTABLISHED', 'PROBABLE') AND domain <> 'RHYTHM' THEN code END), '') AS conduction, coalesce(string_agg(DISTINCT CASE WHEN state = 'DOMAIN_ABSTENTION' THEN domain END, ',' ORDER BY CASE WHEN state = 'DOMAIN_ABSTENTION' THEN domain END), '') AS abstained FROM fu GROUP BY 1")
def _(t):
    return V.final_findings(fused(t), ["VT", "AF"])


@query("r06_cross_engine_agreement", "WITH f AS (SELECT doc_id AS record_id, CASE WHEN quality = 1 THEN 'Q' ELSE 'T' END AS code FROM labels), m(code, label) AS (VALUES ('Q', 'q')), p AS (SELECT doc_id AS record_id, 'q' AS label, CAST(n_chars % 101 AS DOUBLE) / 100 AS p FROM documents WHERE lang <> 'de'), x AS (SELECT f.record_id, f.code, m.label FROM f LEFT JOIN m USING (code)), b AS (SELECT coalesce(x.record_id, p.record_id) AS record_id, x.code, x.label, p.label AS l, p.p FROM x FULL JOIN p ON x.label = p.label AND x.record_id = p.record_id) SELECT record_id, coalesce(code, l) AS item, agreement FROM (SELECT *, CASE WHEN code IS NULL THEN CASE WHEN p >= 0.8 THEN 'REVIEW' END WHEN label IS NULL OR p IS NULL THEN 'NOT_COMPARABLE' WHEN p >= 0.8 THEN 'SUPPORTED' WHEN p <= 0.2 THEN 'DISCORDANT' ELSE 'NEUTRAL' END AS agreement FROM b) WHERE agreement IS NOT NULL")
def _(t):
    findings = t.labels.select(C("doc_id").alias("record_id"), F.when(C("quality") == 1, "Q").otherwise("T").alias("code"))
    probs = t.documents.filter("lang <> 'de'").select(C("doc_id").alias("record_id"), F.lit("q").alias("label"), ((C("n_chars") % 101).cast("double") / 100).alias("p"))
    return V.cross_engine_agreement(findings, probs, t.spark.createDataFrame([("Q", "q")], "code string, label string"))


@query("r07_advisory_findings", "SELECT event_id AS record_id, kind AS external_code, CASE kind WHEN 'view' THEN 'V' WHEN 'click' THEN 'K' WHEN 'error' THEN 'E' END AS code, r AS reason, r IS NULL AS accepted FROM (SELECT *, CASE WHEN kind NOT IN ('view', 'click', 'error') THEN 'unknown_code' WHEN amplitude / 100 > 1 THEN 'bad_confidence' END AS r FROM evts)")
def _(t):
    raw = t.evts.select(C("event_id").alias("record_id"), C("kind").alias("external_code"), (C("amplitude") / 100).alias("confidence"))
    return V.advisory_findings(raw, t.spark.createDataFrame([("view", "V"), ("click", "K"), ("error", "E")], "external_code string, code string"))


@query("m01_balanced_softmax_fit")
def _(t):
    rows = t.embeddings.withColumns({"version": F.lit("v1"), "excluded": C("vec_id") % 20 == 0})
    model = V.balanced_softmax_fit(rows, "v1")
    from pyspark.ml.functions import array_to_vector

    return model.transform(rows.withColumn("features", array_to_vector("embedding"))).select("vec_id", "label", C("prediction").cast("int").alias("predicted"))


@query("t01_annotation_upsert_stream", "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2")
def _(t):
    return streams.upsert_stream_result(t.spark, streams.in_lots(t.events, 5, "event_id"), ["user_id", "event_type"], ["event_id", "value"], "ts", "event_id")


@query("t02_evaluate_before_learn_stream")
def _(t):
    return streams.evaluate_before_learn(t.spark, streams.in_lots(t.embeddings, 6, "vec_id"))
