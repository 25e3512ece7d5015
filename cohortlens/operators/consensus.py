"""Consensus of measurements over channels: medians, spreads, uncertainty and states."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

C = F.col


def robust_consensus(leads: DataFrame, by: list[str], min_conf: float = 0.45, min_sources: int = 2) -> DataFrame:
    """Median of channels with its tier and confidence.

    Two trusted channels or more; else one trusted at 0.85; else two of low confidence at 0.75; else one at
    0.65. Confidence is the mean confidence by the consistency of the spread by the share of sources wanted.
    """
    n_trust, n_all = F.count_if(C("confidence") >= min_conf), F.count("value")
    tiers = leads.filter(C("value").isNotNull()).groupBy(*by).agg(n_trust.alias("n_trusted"), n_all.alias("n_all"))
    both = leads.filter(C("value").isNotNull()).join(tiers, by)
    used = both.filter((C("n_trusted") == 0) | (C("confidence") >= min_conf))
    center = used.groupBy(*by).agg(F.median("value").alias("value"), F.count("*").alias("n_used"), F.avg("confidence").alias("mean_conf"), F.first("n_trusted").alias("n_trusted"))
    spread = used.select(*by, C("value").alias("__v")).join(center, by).groupBy(*by).agg(F.median(F.abs(C("__v") - C("value"))).alias("mad"))
    out = center.join(spread, by)
    factor = F.when(C("n_trusted") >= min_sources, 1.0).when(C("n_trusted") > 0, 0.85).when(C("n_used") >= min_sources, 0.75).otherwise(0.65)
    tier = F.when(C("n_trusted") >= min_sources, "multi_trusted").when(C("n_trusted") > 0, "single_trusted").when(C("n_used") >= min_sources, "multi_low").otherwise("single_low")
    consistency = 1 / (1 + C("mad") / F.greatest(F.lit(1.0), F.abs("value") * 0.1))
    return out.withColumns({"tier": tier, "confidence": F.least(F.lit(1.0), C("mean_conf") * consistency * factor)}).select(*by, "value", "mad", "n_used", "tier", "confidence")


def upper_envelope(leads: DataFrame, by: list[str]) -> DataFrame:
    """Median of the three largest values that are not above median + max(30, 3 robust spreads); below three values the plain median."""
    center = leads.groupBy(*by).agg(F.median("value").alias("m"), F.count("value").alias("n"))
    dev = leads.join(center, by)
    mad = dev.groupBy(*by).agg(F.median(F.abs(C("value") - C("m"))).alias("mad"))
    kept = dev.join(mad, by).filter(C("value") <= C("m") + F.greatest(F.lit(30.0), 3 * 1.4826 * C("mad")))
    ranked = kept.withColumn("r", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("value"), "lead")))
    return ranked.filter((C("r") <= 3) | (C("n") < 3)).groupBy(*by).agg(F.median("value").alias("value"), (F.max("value") - F.min("value")).alias("spread"), F.first("n").alias("n"))


#: Fixed values of a duration over all channels: bounds, least and trusted confidence, least spread that is an outlier's.
LOW, HIGH, LEAST_CONF, TRUSTED, SPREAD_FLOOR = 40.0, 220.0, 0.20, 0.45, 30.0


def global_duration(leads: DataFrame, by: list[str]) -> DataFrame:
    """(by, value, spread, confidence, n_used, n_eligible, mode): the duration over all channels, by their upper envelope.

    Of plausible channels the trusted count if there are three, else all; those above median + max(30, 3 robust
    spreads) go if three remain; the value is the median of the three longest. Confidence is the mean of theirs, by
    how near they are to each other and by the share of six channels. Below three channels it is robust_consensus.
    """
    able = leads.filter(C("value").between(LOW, HIGH) & (F.coalesce("confidence", F.lit(0.0)) >= LEAST_CONF))
    g = able.groupBy(*by).agg(F.collect_list(F.struct((-C("value")).alias("down"), "lead", "value", "confidence")).alias("all"))  # a record's channels
    g = g.withColumn("trusted", F.filter("all", lambda x: x["confidence"] >= TRUSTED))
    g = g.withColumn("rows", F.array_sort(F.when(F.size("trusted") >= 3, C("trusted")).otherwise(C("all")))).filter(F.size("rows") >= 3)
    g = g.withColumn("m", middle(C("rows.value")))
    g = g.withColumn("limit", C("m") + F.greatest(F.lit(SPREAD_FLOOR), 3 * 1.4826 * middle(F.transform("rows", lambda x: F.abs(x["value"] - C("m"))))))
    g = g.withColumn("kept", F.filter("rows", lambda x: x["value"] <= C("limit")))
    g = g.withColumn("kept", F.when(F.size("kept") >= 3, C("kept")).otherwise(C("rows")))
    g = g.withColumn("top", F.slice("kept", 1, 3)).withColumns({"value": C("top.value")[1], "spread": C("top.value")[0] - C("top.value")[2]})
    mean = F.aggregate("top", F.lit(0.0), lambda s, x: s + x["confidence"]) / 3
    unit = lambda x, low: F.least(F.lit(1.0), F.greatest(F.lit(low), x))
    sure = mean * unit(1 - C("spread") / F.greatest(C("value"), F.lit(60.0)), 0.45) * unit(F.size("kept") / 6, 0.60)
    upper = g.select(*by, "value", "spread", sure.alias("confidence"), F.lit(3).cast("bigint").alias("n_used"), F.size("kept").cast("bigint").alias("n_eligible"), F.lit("upper_envelope").alias("mode"))
    rest = robust_consensus(leads.join(upper.select(*by), by, "left_anti"), by)
    return upper.unionByName(rest.select(*by, "value", F.lit(None).cast("double").alias("spread"), "confidence", "n_used", C("n_used").alias("n_eligible"), C("tier").alias("mode")))


def middle(a: Column) -> Column:
    """Median of a short array."""
    s, n = F.array_sort(a), F.size(a)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.ceil((n - 1) / 2).cast("int"))) / 2


def inlier_rate(leads: DataFrame, by: list[str], selected: str = "is_selected") -> DataFrame:
    """Median over channels within max(8, 18 %) of the first median if three remain, and whether the selected channel is an outlier."""
    first = leads.groupBy(*by).agg(F.median("value").alias("m0"))
    both = leads.join(first, by).withColumn("__in", F.abs(C("value") - C("m0")) <= F.greatest(F.lit(8.0), 0.18 * F.abs("m0")))
    inner = both.groupBy(*by).agg(F.first("m0").alias("m0"), F.count_if("__in").alias("n_in"), F.median(F.when(C("__in"), C("value"))).alias("m1"), F.coalesce(F.bool_or(C(selected) & ~C("__in")), F.lit(False)).alias("selected_outlier"))
    return inner.select(*by, F.when(C("n_in") >= 3, C("m1")).otherwise(C("m0")).alias("rate"), "n_in", "selected_outlier")


def dispersion(leads: DataFrame, by: list[str], min_conf: float = 0.45) -> DataFrame:
    """Largest less smallest value over trusted channels, where there are two."""
    return leads.filter(C("confidence") >= min_conf).groupBy(*by).agg((F.max("value") - F.min("value")).alias("dispersion"), F.count("value").alias("n")).filter("n >= 2")


def axis_fit(leads: DataFrame, angles: dict[int, float], by: list[str], least: int = 4) -> DataFrame:
    """Least squares of channel areas on the cosine and sine of their angles: axis, amplitude and R2."""
    angle = F.radians(reduce(lambda rest, kv: F.when(C("lead") == kv[0], F.lit(kv[1])).otherwise(rest), angles.items(), F.lit(None).cast("double")))
    x = leads.withColumn("__a", angle).filter("__a is not null").withColumns({"__c": F.cos("__a"), "__s": F.sin("__a")})
    sums = x.groupBy(*by).agg(F.count("*").alias("n"), F.sum(C("__c") ** 2).alias("cc"), F.sum(C("__c") * C("__s")).alias("cs"), F.sum(C("__s") ** 2).alias("ss"), F.sum(C("__c") * C("value")).alias("cy"), F.sum(C("__s") * C("value")).alias("sy"), F.sum(C("value") ** 2).alias("yy"), F.sum("value").alias("y")).filter(C("n") >= least)
    det = C("cc") * C("ss") - C("cs") ** 2
    fit = sums.filter(F.abs(det) > 1e-9).withColumns({"bx": (C("cy") * C("ss") - C("sy") * C("cs")) / det, "by_": (C("sy") * C("cc") - C("cy") * C("cs")) / det})
    rest, total = C("yy") - C("bx") * C("cy") - C("by_") * C("sy"), C("yy") - C("y") ** 2 / C("n")
    return fit.select(*by, "n", F.degrees(F.atan2("by_", "bx")).alias("axis"), F.sqrt(C("bx") ** 2 + C("by_") ** 2).alias("amplitude"), F.when(total > 0, 1 - rest / total).alias("r2"))


def waveform_agreement(a: DataFrame, b: DataFrame, shifts: list[int]) -> DataFrame:
    """Per record the shift of b with the best signal-to-noise ratio, with Pearson and RMS; samples are (record_id, i, v)."""
    moved = b.select("record_id", C("v").alias("w"), F.explode(F.array(*[F.lit(s) for s in shifts])).alias("shift"), C("i").alias("__i")).withColumn("i", C("__i") + C("shift")).drop("__i")
    both = a.join(moved, ["record_id", "i"])
    per = both.groupBy("record_id", "shift").agg(F.count("*").alias("n"), F.corr("v", "w").alias("pearson"), F.sqrt(F.avg((C("v") - C("w")) ** 2)).alias("rms"), (10 * F.log10(F.sum(C("v") ** 2) / F.nullif(F.sum((C("v") - C("w")) ** 2), F.lit(0.0)))).alias("snr"))
    best = per.groupBy("record_id").agg(F.max_by(F.struct("shift", "n", "pearson", "rms", "snr"), F.struct(F.coalesce("snr", F.lit(999.0)), -F.abs("shift"), "shift")).alias("x"))
    return best.select("record_id", "x.*")


def signal_integrity(samples: DataFrame) -> DataFrame:
    """Shares of finite and observed samples, the longest usable run, the 1-99 span, flatness and eligibility of (record_id, i, v, q)."""
    usable = C("v").isNotNull() & (C("q") > 0)
    marked = samples.withColumn("u", usable)
    over = W.partitionBy("record_id").orderBy("i")
    runs = marked.withColumn("island", F.sum((~C("u")).cast("int")).over(over.rowsBetween(W.unboundedPreceding, 0))).filter("u").groupBy("record_id", "island").count().groupBy("record_id").agg(F.max("count").alias("longest_run"))
    base = marked.groupBy("record_id").agg(F.count("*").alias("n"), F.avg(C("v").isNotNull().cast("int")).alias("finite_share"), F.avg((C("q") == 2).cast("int")).alias("observed_share"), F.percentile("v", F.array(F.lit(0.01), F.lit(0.99))).alias("__p"))
    out = base.join(runs, "record_id", "left").fillna(0, ["longest_run"]).withColumn("span", C("__p")[1] - C("__p")[0]).drop("__p")
    return out.withColumns({"flat": F.coalesce(C("span") < 0.02, F.lit(True)), "eligible": (C("finite_share") >= 0.8) & (C("longest_run") >= 0.5 * C("n"))})


def lead_threshold_counts(leads: DataFrame, by: list[str], limits: dict[str, Column], least: int = 2) -> DataFrame:
    """Usable channels, channels per limit with a flag for `least` of them, median and spread."""
    center = leads.groupBy(*by).agg(F.median("value").alias("median"), F.count("value").alias("n"), *[F.count_if(c).alias(f"n_{k}") for k, c in limits.items()])
    mad = leads.join(center.select(*by, "median"), by).groupBy(*by).agg(F.median(F.abs(C("value") - C("median"))).alias("mad"))
    return center.join(mad, by).withColumns({f"flag_{k}": C(f"n_{k}") >= least for k in limits})


def uncertainty_interval(df: DataFrame, floor: float = 4.0) -> DataFrame:
    """Value +/- the largest of sampling floor, digitizer, robust spread, half the disagreement and confidence penalty, with its source."""
    parts = {"floor": F.lit(floor), "digitizer": F.coalesce("digitizer", F.lit(0.0)), "mad": 1.4826 * F.coalesce("mad", F.lit(0.0)), "disagreement": F.coalesce("disagreement", F.lit(0.0)) / 2, "confidence": (1 - F.coalesce("confidence", F.lit(0.0))) * 10}
    u = F.greatest(*parts.values())
    source = reduce(lambda rest, kv: F.when(kv[1] == C("uncertainty"), kv[0]).otherwise(rest), reversed(list(parts.items())), F.lit(None).cast("string"))
    return df.withColumn("uncertainty", u).withColumns({"low": C("value") - C("uncertainty"), "high": C("value") + C("uncertainty"), "source": source})


def measurement_state(df: DataFrame, tolerance: float = 12.0) -> DataFrame:
    """HIGH_CONFIDENCE, WITH_UNCERTAINTY, REMEASURE or UNMEASURABLE from disagreement and spread."""
    d = F.coalesce(F.abs("disagreement"), F.lit(0.0))
    return df.withColumn("state", F.when(C("value").isNull(), "UNMEASURABLE").when(d > 3 * tolerance, "REMEASURE").when((d > tolerance) | (F.coalesce("mad", F.lit(0.0)) > tolerance), "WITH_UNCERTAINTY").otherwise("HIGH_CONFIDENCE"))


def threshold_relation(df: DataFrame, threshold: float) -> DataFrame:
    """ABOVE, BELOW or OVERLAPS of an interval against a threshold; UNUSABLE without one or when it must be measured again."""
    no = C("low").isNull() | C("high").isNull() | C("state").isin("REMEASURE", "UNMEASURABLE")
    return df.withColumn("relation", F.when(no, "UNUSABLE").when(C("low") > threshold, "ABOVE").when(C("high") < threshold, "BELOW").otherwise("OVERLAPS"))


def measurement_envelope(consensus: DataFrame, leads: DataFrame, by: list[str]) -> DataFrame:
    """One provenance struct per metric: value, state, interval and the channels it came from, as a map."""
    sources = leads.groupBy(*by, "lead").agg(F.avg("value").alias("v")).groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(C("lead").cast("string"), "v")))).alias("sources"))
    out = consensus.join(sources, by, "left")
    return out.select(*by, F.struct("value", "state", "low", "high", "sources").alias("envelope"))


def bundle_branch_rules(flags: DataFrame) -> DataFrame:
    """(record_id, pattern) from widths and morphology over channels: four wide channels or more make a block complete."""
    g = flags.groupBy("record_id").agg(F.count_if("wide").alias("n_wide"), F.count_if(C("wide") & C("rsr")).alias("n_right"), F.count_if(C("wide") & C("notched")).alias("n_left"), F.count("*").alias("n"))
    kind = F.when(C("n_right") > C("n_left"), "RIGHT").when(C("n_left") > 0, "LEFT")
    pattern = F.when(kind.isNull(), F.when(C("n_wide") >= 4, "UNSPECIFIED_WIDE").otherwise("NONE")).when(C("n_wide") >= 4, F.concat(F.lit("COMPLETE_"), kind)).otherwise(F.concat(F.lit("INCOMPLETE_"), kind))
    return g.select("record_id", "n_wide", pattern.alias("pattern"))


def axis_pattern_rules(leads: DataFrame) -> DataFrame:
    """Additive scores of two axis patterns, zero without their mandatory part."""
    mean = leads.groupBy("record_id").agg(*[F.avg(F.when(C("lead") == k, C("value"))).alias(f"v{k}") for k in range(1, 8)])
    up = lambda k: F.coalesce(C(f"v{k}") > 0, F.lit(False)).cast("int")
    down = lambda k: F.coalesce(C(f"v{k}") < 0, F.lit(False)).cast("int")
    left = F.when((up(1) == 1) & (down(3) == 1), 40 * up(1) + 30 * down(2) + 30 * down(3) + 10 * up(5)).otherwise(0)
    right = F.when((down(1) == 1) & (up(3) == 1), 40 * down(1) + 30 * up(2) + 30 * up(3) + 10 * down(5)).otherwise(0)
    return mean.select("record_id", left.alias("left_score"), right.alias("right_score"))


def concordant_channels(flags: DataFrame, a: str, b: str, least: int = 2) -> DataFrame:
    """Whether the same channels meet both criteria, `least` of them; else each criterion anywhere."""
    g = flags.groupBy("record_id").agg(F.count_if(C(a) & C(b)).alias("n_both"), F.coalesce(F.bool_or(a), F.lit(False)).alias("any_a"), F.coalesce(F.bool_or(b), F.lit(False)).alias("any_b"))
    return g.select("record_id", "n_both", F.when(C("n_both") >= least, "CONCORDANT").when(C("any_a") & C("any_b"), "GLOBAL").otherwise("NONE").alias("path"))
