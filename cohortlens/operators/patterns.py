"""Patterns of a record in one ranking: by rule evidence and beat intervals, or by waves (events.template_scores)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.events import fused_rank
from cohortlens.sources.shared import sent

C = F.col
# What a rule's state is worth as seen evidence of a rhythm, and as a criterion; other states are no criterion.
SEEN = {"POSITIVE": 0.90, "NEGATIVE": 0.15, "CONFOUNDED": 0.35}
UNSEEN = 0.50
CRITERION = {"POSITIVE": 1.0, "NEGATIVE": 0.0, "CONFOUNDED": 0.35}
#: Rows of rules or constraints of all patterns together.
MOST_ROWS = 100_000


def _worth(values: dict[str, float], otherwise: Column) -> Column:
    return reduce(lambda rest, kv: F.when(C("status") == kv[0], kv[1]).otherwise(rest), values.items(), otherwise)


def rhythm_states(stats: DataFrame, irregular: float = 0.15) -> DataFrame:
    """(record_id, rule_id, status) of rhythm rules from interval statistics (events.interval_stats)."""
    n = C("n") >= 4
    state = lambda yes, doubt: F.when(~n | C("cv").isNull(), "NOT_ASSESSABLE").when(doubt, "CONFOUNDED").when(yes, "POSITIVE").otherwise("NEGATIVE")
    own = F.array(
        F.struct(F.lit("IRREGULAR").alias("rule_id"), state(C("cv") > irregular, (C("cv") > irregular) & (C("mad") / C("median") <= 0.08)).alias("status")),
        F.struct(F.lit("VERY_REGULAR").alias("rule_id"), state(C("very_regular"), F.lit(False)).alias("status")),
    )
    return stats.select("record_id", F.explode(own).alias("s")).select("record_id", "s.*")


def rhythm_scores(records: DataFrame, states: DataFrame, patterns: DataFrame) -> DataFrame:
    """(record_id, template, visual, coverage) of patterns that their rhythm shows: the state of the pattern's rule, whole coverage.

    patterns(template, rule_id), one rule each; a rule that a record lacks is worth UNSEEN.
    """
    every = records.select("record_id").crossJoin(sent(patterns.select("template", "rule_id"), "the rhythm patterns", MOST_ROWS))
    seen = every.join(states, ["record_id", "rule_id"], "left")
    return seen.select("record_id", "template", _worth(SEEN, F.lit(UNSEEN)).cast("double").alias("visual"), F.lit(1.0).alias("coverage"))


def criteria_scores(states: DataFrame, rules: DataFrame) -> DataFrame:
    """(record_id, template, criteria): mean worth of a pattern's rules that could be judged; rules(template, rule_id)."""
    met = states.join(sent(rules.select("template", "rule_id"), "the patterns' rules", MOST_ROWS), "rule_id")
    return met.withColumn("w", _worth(CRITERION, F.lit(None).cast("double"))).groupBy("record_id", "template").agg(F.avg("w").alias("criteria"))


def constraint_scores(measures: DataFrame, constraints: DataFrame) -> DataFrame:
    """(record_id, template, measurement): mean over a pattern's bounds (template, key, lo, hi): 1 inside, falling off outside."""
    met = measures.filter(C("value").isNotNull()).join(sent(constraints, "the patterns' bounds", MOST_ROWS), "key")
    beyond = F.greatest(C("lo") - C("value"), C("value") - C("hi"), F.lit(0.0))
    one = F.exp(-beyond / F.greatest(F.lit(10.0), (C("hi") - C("lo")) * 0.30))
    return met.withColumn("s", one).groupBy("record_id", "template").agg(F.avg("s").alias("measurement"))


def pattern_rank(visual: list[DataFrame], criteria: DataFrame, measurement: DataFrame, k: int = 3) -> DataFrame:
    """One ranking over the visual scores of all modes; what a pattern lacks is shared out among its other parts."""
    both = reduce(DataFrame.unionByName, visual).join(criteria, ["record_id", "template"], "left").join(measurement, ["record_id", "template"], "left")
    return fused_rank(both, k)
