"""Evidence rows: candidates, conflicts, domain gates, fusion and final findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlens.sources.keeping import keep_model, model_version

C = F.col


def evidence_candidates(features: DataFrame, components: list[tuple[str, Column, float, str]]) -> DataFrame:
    """(record_id, code, score, n_sources, sources): weights of the components that hold, capped at 1, per code."""
    fired = F.filter(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(w).alias("w"), F.lit(src).alias("source"))) for code, cond, w, src in components]), lambda x: x.isNotNull())
    long = features.select("record_id", F.explode(fired).alias("f")).select("record_id", "f.*")
    g = long.groupBy("record_id", "code").agg(F.least(F.lit(1.0), F.sum("w")).alias("score"), F.collect_set("source").alias("s"))
    return g.select("record_id", "code", "score", F.array_join(F.sort_array("s"), ",").alias("sources"), F.size("s").cast("bigint").alias("n_sources"))


def consistency_conflicts(features: DataFrame, checks: list[tuple[str, str, Column]]) -> DataFrame:
    """(record_id, code, severity) of every contradiction found."""
    found = F.filter(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity"))) for code, sev, cond in checks]), lambda x: x.isNotNull())
    return features.select("record_id", F.explode(found).alias("x")).select("record_id", "x.*")


def domain_gates(records: DataFrame, conflicts: DataFrame, unusable: DataFrame, conflict_map: DataFrame, measure_map: DataFrame, rescues: DataFrame, domains: list[str]) -> DataFrame:
    """(record_id, domain, eligible, n_conflicts, n_unusable): a domain closes only for conflicts and measurements that are mapped to it.

    rescues(record_id, domain, measure) take an unusable measurement off a domain's list.
    """
    every = records.select("record_id", F.explode(F.array(*[F.lit(d) for d in domains])).alias("domain"))
    blocking = conflicts.filter(C("severity") == "BLOCKING").join(F.broadcast(conflict_map), "code").select("record_id", "domain", "code").distinct().groupBy("record_id", "domain").agg(F.count("*").alias("n_conflicts"))
    bad = unusable.join(F.broadcast(measure_map), "measure").join(rescues, ["record_id", "domain", "measure"], "left_anti").select("record_id", "domain", "measure").distinct().groupBy("record_id", "domain").agg(F.count("*").alias("n_unusable"))
    rows = lambda df, own, nc, nu: df.select("record_id", "domain", F.lit(own).alias("own"), nc.alias("n_conflicts"), nu.alias("n_unusable"))
    none = F.lit(0).cast("bigint")
    marks = rows(every, True, none, none).unionByName(rows(blocking, False, C("n_conflicts"), none)).unionByName(rows(bad, False, none, C("n_unusable")))
    out = marks.groupBy("record_id", "domain").agg(F.bool_or("own").alias("own"), F.sum("n_conflicts").alias("n_conflicts"), F.sum("n_unusable").alias("n_unusable")).filter("own").drop("own")
    return out.withColumn("eligible", (C("n_conflicts") == 0) & (C("n_unusable") == 0))


def fuse_evidence(candidates: DataFrame, gates: DataFrame, policy: DataFrame, never: list[str]) -> DataFrame:
    """Fusion state of each candidate: generic, measurement abstention, boundary, domain abstention, then score and sources.

    candidates(record_id, domain, code, score, n_sources, specialist, n_unresolved, n_boundary); a code without
    policy needs 0.80 and three sources; a specialist's confirmation lowers these to 0.60 and two at most.
    """
    x = candidates.join(F.broadcast(policy), "code", "left").join(gates.select("record_id", "domain", "eligible"), ["record_id", "domain"], "left")
    t, n = F.coalesce("threshold", F.lit(0.80)), F.coalesce("min_sources", F.lit(3))
    t, n = F.when(C("specialist"), F.least(t, F.lit(0.60))).otherwise(t), F.when(C("specialist"), F.least(n, F.lit(2))).otherwise(n)
    state = (
        F.when(C("code").isin(never), "CANDIDATE_REVIEW").when(C("n_unresolved") > 0, "MEASUREMENT_ABSTENTION").when(C("n_boundary") > 0, "BOUNDARY_UNCERTAIN").when(~F.coalesce("eligible", F.lit(False)), "DOMAIN_ABSTENTION")
        .when((C("score") >= t) & (C("n_sources") >= n), F.when(C("specialist"), "ESTABLISHED").otherwise("PROBABLE")).otherwise("CANDIDATE_REVIEW")
    )
    return x.withColumn("state", state).withColumn("publishable", C("state").isin("ESTABLISHED", "PROBABLE")).select("record_id", "domain", "code", "score", "state", "publishable")


def final_findings(fused: DataFrame, rhythm_order: list[str]) -> DataFrame:
    """Primary rhythm (ventricular first, else the best score), other published rhythms, conduction and abstained domains per record, in one pass."""
    rank = reduce(lambda rest, kv: F.when(C("code") == kv[1], kv[0]).otherwise(rest), enumerate(reversed(rhythm_order), 1), F.lit(0))
    rhythm, other = C("publishable") & (C("domain") == "RHYTHM"), C("publishable") & (C("domain") != "RHYTHM")
    line = lambda c: F.array_join(F.sort_array(c), ",")
    each = fused.groupBy("record_id").agg(
        F.max_by(F.when(rhythm, C("code")), F.when(rhythm, F.struct(rank, C("score"), C("code")))).alias("first"), F.collect_set(F.when(rhythm, C("code"))).alias("rhythms"),
        F.collect_set(F.when(other, C("code"))).alias("others"), F.collect_set(F.when(C("state") == "DOMAIN_ABSTENTION", C("domain"))).alias("held"),
    )
    out = each.select("record_id", C("first").alias("primary_rhythm"), line(F.array_remove("rhythms", C("first"))).alias("secondary"), line("others").alias("conduction"), line("held").alias("abstained"))
    return out.fillna("", ["primary_rhythm", "secondary"])


def cross_engine_agreement(findings: DataFrame, probs: DataFrame, mapping: DataFrame, high: float = 0.80, low: float = 0.20) -> DataFrame:
    """SUPPORTED, DISCORDANT, NEUTRAL or NOT_COMPARABLE per finding, and REVIEW for what only the second engine sees."""
    mine = findings.join(mapping, "code", "left")
    both = mine.join(probs.withColumnRenamed("label", "__l"), (mine["label"] == C("__l")) & (mine["record_id"] == probs["record_id"]), "full")
    rec = F.coalesce(mine["record_id"], probs["record_id"])
    state = F.when(mine["code"].isNull(), F.when(C("p") >= high, "REVIEW")).when(C("label").isNull() | C("p").isNull(), "NOT_COMPARABLE").when(C("p") >= high, "SUPPORTED").when(C("p") <= low, "DISCORDANT").otherwise("NEUTRAL")
    return both.select(rec.alias("record_id"), F.coalesce("code", "__l").alias("item"), state.alias("agreement")).filter("agreement is not null")


def advisory_findings(raw: DataFrame, codes: DataFrame) -> DataFrame:
    """Third-party findings by a code map: accepted, or rejected with the reason. They have no authority."""
    known = raw.join(F.broadcast(codes), "external_code", "left")
    reason = F.when(C("external_code").isNull(), "no_code").when(C("code").isNull(), "unknown_code").when(~F.coalesce(C("confidence").between(0, 1), F.lit(False)), "bad_confidence")
    return known.select("record_id", "external_code", "code", reason.alias("reason"), reason.isNull().alias("accepted"))


def _training_rows(features: DataFrame, version: str) -> DataFrame:
    return features.filter((C("version") == version) & ~F.coalesce("excluded", F.lit(False)))


def balanced_softmax_fit(features: DataFrame, version: str):
    """Class-balanced multinomial logistic regression on features of one version that are not excluded."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = _training_rows(features, version)
    every = W.partitionBy()
    counts = rows.groupBy("label").agg(F.count("*").alias("n_c")).withColumns({"n": F.sum("n_c").over(every), "k": F.count("*").over(every)})
    weighted = rows.join(F.broadcast(counts), "label").withColumns({"weight": C("n") / (C("k") * C("n_c")), "features": array_to_vector("embedding"), "y": C("label").cast("double")})
    return LogisticRegression(family="multinomial", labelCol="y", weightCol="weight", maxIter=20, regParam=0.01).fit(weighted)


def versioned_softmax(features: DataFrame, feature_version: str, home: str, key: str = "vec_id"):
    """(version, model): the fit of these training rows, kept in `home` under a version that they fix; it is not fitted again."""
    from pyspark.ml.classification import LogisticRegressionModel

    version = model_version(_training_rows(features, feature_version).select(key, "label", "embedding"), feature_version)
    excluded = features.filter(F.coalesce("excluded", F.lit(False))).select(key)
    return version, keep_model(home, version, lambda: balanced_softmax_fit(features, feature_version), LogisticRegressionModel.load, excluded)


def score_by_version(features: DataFrame, home: str, version: str) -> DataFrame:
    """features with what the kept model of a version predicts."""
    from pyspark.ml.classification import LogisticRegressionModel
    from pyspark.ml.functions import array_to_vector

    model = LogisticRegressionModel.load(f"{home}/models/{version}")
    scored = model.transform(features.withColumn("features", array_to_vector("embedding")))
    return scored.select(*features.columns, C("prediction").cast("int").alias("predicted"), F.lit(version).alias("model_version"))
