"""Rules met with patients: bands, demographics, condition trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlens.sources.shared import sent

C = F.col
#: Leaves of all rules together.
MOST_LEAVES = 10_000


def band_join(patients: DataFrame, rules: DataFrame) -> DataFrame:
    """(patient_id, med_id, rule_id) where exactly one rule of the drug and metric holds the value.

    Edges are inclusive or not each by itself; NaN, infinite, negative values, dialysis and reversed bands are
    refused. All different matching rules are seen before one is taken: two mean no answer. A patient's row
    given twice has its answer twice.
    """
    ok = patients.filter(~F.isnan("value") & (C("value") >= 0) & (C("value") < float("inf")) & ~F.coalesce("dialysis", F.lit(False)))
    both = ok.join(rules.filter(C("lo").isNull() | C("hi").isNull() | (C("lo") <= C("hi"))), ["med_id", "metric"])
    above = C("lo").isNull() | (C("value") > C("lo")) | (C("lo_incl") & (C("value") == C("lo")))
    below = C("hi").isNull() | (C("value") < C("hi")) | (C("hi_incl") & (C("value") == C("hi")))
    one = W.partitionBy("patient_id", "med_id", "metric", "value")
    hits = both.filter(above & below).withColumn("only", F.min("rule_id").over(one) == F.max("rule_id").over(one))
    return hits.filter("only").select("patient_id", "med_id", "rule_id")


def demographic_join(patients: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """Rules of the patient's key whose age (upper edge open) and weight limits hold; null is no limit."""
    both = patients.join(rules, key)
    age = F.coalesce(C("age") >= C("age_min"), F.lit(True)) & F.coalesce(C("age") < C("age_max"), F.lit(True))
    low = F.coalesce(F.when(C("w_min_open"), C("weight") > C("w_min")).otherwise(C("weight") >= C("w_min")), F.lit(True))
    high = F.coalesce(F.when(C("w_max_open"), C("weight") < C("w_max")).otherwise(C("weight") <= C("w_max")), F.lit(True))
    return both.filter(age & low & high).select("patient_id", "rule_id")


def compile_conditions(rules: list[dict]) -> list[tuple]:
    """Published condition trees ({all, any, not} over {field, op, value}) as rows (rule_id, priority, clause, field, op, value, negate) of their disjunctive form."""

    def dnf(node: dict, negate: bool) -> list[list[tuple]]:
        if "not" in node:
            return dnf(node["not"], not negate)
        for word, other in (("all", "any"), ("any", "all")):
            if word in node:
                parts = [dnf(x, negate) for x in node[word]]
                if (word == "any") != negate:
                    return [c for p in parts for c in p]
                out: list[list[tuple]] = [[]]
                for p in parts:
                    out = [a + b for a in out for b in p]
                return out
        return [[(node["field"], node["op"], node.get("value"), negate)]]

    return [(r["rule_code"], r.get("priority", 100), k, f, op, None if v is None else float(v), n) for r in rules if r.get("status") == "PUBLISHED" for k, clause in enumerate(dnf(r["condition"], False)) for f, op, v, n in clause]


def condition_rules(context: DataFrame, clauses: DataFrame) -> DataFrame:
    """(patient_id, rule_id, priority) of rules with a clause whose leaves all hold; context is (patient_id, field, value).

    A leaf over a missing field is false, and its negation true. Clauses are met from their leaves that hold;
    only clauses of negations alone ask about every patient.
    """
    leaf = clauses.withColumn("leaf", F.monotonically_increasing_id())
    v, x = C("value"), C("limit")
    holds = F.when(C("op") == ">", v > x).when(C("op") == ">=", v >= x).when(C("op") == "<", v < x).when(C("op") == "<=", v <= x).when(C("op") == "==", v == x).when(C("op") == "exists", v.isNotNull())
    seen = context.join(sent(leaf, "the rules' clauses", MOST_LEAVES), "field").withColumn("met", F.coalesce(holds, F.lit(False)))
    hit = seen.filter("met").groupBy("patient_id", "rule_id", "clause").agg(F.countDistinct(F.when(~C("negate"), C("leaf"))).alias("pos"), F.countDistinct(F.when(C("negate"), C("leaf"))).alias("bad"))
    need = leaf.groupBy("rule_id", "priority", "clause").agg(F.count_if(~C("negate")).alias("need"))
    clause = ["rule_id", "clause"]
    met = hit.join(F.broadcast(need.filter("need > 0")), clause).filter("pos = need and bad = 0").select("patient_id", "rule_id", "priority")
    # Clauses of negations alone hold for every patient of whom no leaf of theirs is met: MOST_LEAVES at most.
    alone = [F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.clause).alias("clause"), F.lit(r.priority).alias("priority")) for r in need.filter("need = 0").orderBy(*clause).collect()]
    if not alone:
        return met.distinct()
    bad = hit.filter("bad > 0").groupBy("patient_id").agg(F.collect_list(F.struct(*clause)).alias("bad"))
    every = context.select("patient_id").distinct().join(bad, "patient_id", "left")
    free = every.select("patient_id", F.explode(F.filter(F.array(*alone), lambda c: ~F.coalesce(F.array_contains("bad", F.struct(c["rule_id"], c["clause"])), F.lit(False)))).alias("c")).select("patient_id", "c.rule_id", "c.priority")
    return met.unionByName(free).distinct()
