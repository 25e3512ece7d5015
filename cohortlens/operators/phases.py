"""Two event sequences of a record against each other: brackets, phases, topology, conduction and cadence.

p and r are (record_id, t_ms). A record is a patient's recording, so its events fit one row; everything after the one
shuffle by record is a column expression over its sorted arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlens.operators.events import claimed_pairs

C = F.col
#: Which variation of gaps is regular, how much of the period the phases of a dissociated r take up, up
#: to how much of the median gap a p may lie before its r, and how much faster than r an independent p is.
REGULAR, PHASE_MAD, PHASE_RANGE, NEAR, FASTER = 0.12, 0.15, 0.30, 1.05, 1.25


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def median(a: Column) -> Column:
    s, n = F.array_sort(a), F.size(a)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.ceil((n - 1) / 2).cast("int"))) / 2


def mad(a: Column) -> Column:
    return median(F.transform(a, lambda x: F.abs(x - median(a))))


def differences(a: Column) -> Column:
    n = F.greatest(F.size(a) - 1, F.lit(0))
    return F.zip_with(F.slice(a, 2, n), F.slice(a, 1, n), lambda x, y: x - y)


def variation(a: Column) -> Column:
    """Standard deviation (n - 1) by mean; null under two values or a mean of zero."""
    n, m = F.size(a), total(a) / F.nullif(F.size(a), F.lit(0))
    return F.when((n >= 2) & (m > 0), F.sqrt(total(F.transform(a, lambda x: (x - m) * (x - m))) / (n - 1)) / m)


def spread(a: Column) -> Column:
    return F.array_max(a) - F.array_min(a)


def bracket(p: DataFrame, r: DataFrame) -> DataFrame:
    """(record_id, t_ms, is_p, is_r, p_before, r_before, r_after): each distinct time with the events strictly around it."""
    one = lambda df, a, b: df.select("record_id", C("t_ms").cast("double").alias("t_ms"), F.lit(a).alias("is_p"), F.lit(b).alias("is_r"))
    line = one(p, True, False).unionByName(one(r, False, True)).groupBy("record_id", "t_ms").agg(F.max("is_p").alias("is_p"), F.max("is_r").alias("is_r"))
    past = W.partitionBy("record_id").orderBy("t_ms").rowsBetween(W.unboundedPreceding, -1)
    future = W.partitionBy("record_id").orderBy(F.desc("t_ms")).rowsBetween(W.unboundedPreceding, -1)  # from the end, so each is read once
    own_p, own_r = F.when(C("is_p"), C("t_ms")), F.when(C("is_r"), C("t_ms"))
    return line.withColumns({"p_before": F.last(own_p, True).over(past), "r_before": F.last(own_r, True).over(past), "r_after": F.last(own_r, True).over(future)})


def _sequences(p: DataFrame, r: DataFrame) -> DataFrame:
    """Per record ps (t, r_before, r_after) and rs (t, p_before) in order, and the statistics of their gaps."""
    x = bracket(p, r).groupBy("record_id").agg(
        F.array_sort(F.collect_list(F.when(C("is_p"), F.struct(C("t_ms").alias("t"), "r_before", "r_after")))).alias("ps"),
        F.array_sort(F.collect_list(F.when(C("is_r"), F.struct(C("t_ms").alias("t"), "p_before")))).alias("rs"),
    )
    x = x.withColumns({"pp": differences(C("ps.t")), "rr": differences(C("rs.t")), "p_n": F.size("ps"), "r_n": F.size("rs")})
    return x.withColumns({"pp_median": median(C("pp")), "rr_median": median(C("rr")), "pp_cv": variation(C("pp")), "rr_cv": variation(C("rr"))})


def _dissociated(delays: Column, period: Column, floor: float) -> Column:
    """Whether three delays or more wander over the period."""
    wide = (mad(delays) >= F.greatest(F.lit(floor), PHASE_MAD * period)) & (spread(delays) >= PHASE_RANGE * period)
    return F.coalesce((F.size(delays) >= 3) & wide, F.lit(False))


def _phase_of_r(x: DataFrame) -> Column:
    """Delay of each r after the p before it, where that is near."""
    return F.transform(F.filter("rs", lambda e: (e["t"] - e["p_before"]) <= NEAR * C("pp_median")), lambda e: e["t"] - e["p_before"])


def _longest_drop(delays: Column) -> Column:
    step = lambda s, d: F.struct(F.when(d.isNull(), s["run"] + 1).otherwise(F.lit(0)).alias("run"), F.greatest(s["most"], F.when(d.isNull(), s["run"] + 1).otherwise(F.lit(0))).alias("most"))
    return F.aggregate(delays, F.struct(F.lit(0).alias("run"), F.lit(0).alias("most")), step, lambda s: s["most"])


def _alternating(delays: Column) -> Column:
    at = lambda k: F.size(F.filter(F.transform(delays, lambda d, i: d.isNotNull() & (i % 2 == k)), lambda b: b))
    return F.abs(at(0) - at(1)) >= F.greatest(F.lit(1), F.floor(F.size(delays) / 3))


def _progressive(delays: Column, rise: float) -> Column:
    """Whether three delays that grow by more than `rise` each come before a dropped event."""
    def ends(d, i):
        a, b, c = (F.get(delays, i - k) for k in (3, 2, 1))
        return F.coalesce(d.isNull() & (i >= 3) & (b - a > rise) & (c - b > rise), F.lit(False))

    return F.exists(F.transform(delays, ends), lambda b: b)


def sequence_topology(p: DataFrame, r: DataFrame, lo: float = 80.0, hi: float = 500.0, stable: float = 30.0, rise: float = 8.0, floor: float = 50.0) -> DataFrame:
    """Per record with events: how p events and r events follow each other; nothing but counts under four p or three r.

    A p event is conducted if the first r after it comes lo to hi later. Columns: ratio p to r, gap variation, conducted
    and dropped, the longest run of dropped ones, alternation, stable and progressive delays, dissociation by the
    phases of r after p, and where in the interval from r to r the dropped p events lie (0.25 to 0.75: in the middle).
    """
    x = _sequences(p, r).withColumn("evaluable", (C("p_n") >= 4) & (C("r_n") >= 3))
    delay = lambda e: F.when((e["r_after"] - e["t"]).between(lo, hi), e["r_after"] - e["t"])
    within = lambda e: (e["t"] - e["r_before"]) / (e["r_after"] - e["r_before"])
    x = x.withColumns({"delays": F.transform("ps", delay), "phases": _phase_of_r(x), "dropped_at": F.filter(F.transform("ps", lambda e: F.when(delay(e).isNull(), within(e))), lambda v: v.isNotNull())})
    x = x.withColumn("known", F.filter("delays", lambda d: d.isNotNull()))
    x = x.withColumns({"pr_median_ms": median(C("known")), "pr_mad_ms": F.when(F.size("known") >= 3, mad(C("known")))})
    found = {
        "pp_cv": C("pp_cv"), "rr_cv": C("rr_cv"), "conducted_n": F.size("known"), "dropped_n": C("p_n") - F.size("known"), "max_consecutive_drop": _longest_drop(C("delays")), "p_r_ratio": C("p_n") / C("r_n"),
        "alternating": _alternating(C("delays")), "stable_pr": F.coalesce(C("pr_mad_ms") <= stable, F.lit(False)), "progressive_pr": _progressive(C("delays"), rise), "phase_dissociation": _dissociated(C("phases"), C("pp_median"), floor),
        "dropped_rr_phase_mid_n": F.size(F.filter("dropped_at", lambda v: v.between(0.25, 0.75))), "dropped_rr_phase_n": F.size("dropped_at"), "dropped_rr_phase_median": median(C("dropped_at")), "pr_median_ms": C("pr_median_ms"), "pr_mad_ms": C("pr_mad_ms"),
    }
    return x.select("record_id", "evaluable", "p_n", "r_n", *[F.when(C("evaluable"), v).alias(c) for c, v in found.items()])


def conduction_class(p: DataFrame, r: DataFrame, lo: float = 80.0, hi: float = 500.0, long_delay: float = 200.0, stable: float = 30.0, rise: float = 8.0, floor: float = 50.0, regular: float = REGULAR, reproducible: DataFrame | None = None) -> DataFrame:
    """(record_id, p_n, r_n, conducted_n, dropped_n, max_consecutive_drop, pr_median_ms, pr_mad_ms, phase_mad, phase_range, classification, confidence).

    Every r takes the last free p from lo to hi before it (claimed_pairs). The first of these that holds: first degree
    (one to one, stable and long delays, in records whose p is `reproducible`; None: all are); complete block (both regular, p faster than r, phases that
    wander); of regular p with dropped ones two to one, high grade, Mobitz II, and Wenckebach; else none established.
    Records with p and r events each have a row.
    """
    distinct = lambda df: df.select("record_id", C("t_ms").cast("double").alias("t_ms")).distinct()
    p, r = distinct(p), distinct(r)
    pairs = claimed_pairs(r, p, lo, hi).filter("p_ms is not null").select("record_id", C("p_ms").alias("t_ms"), (C("r_ms") - C("p_ms")).alias("d"))
    mapped = p.join(pairs, ["record_id", "t_ms"], "left").groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("t_ms", "d"))).alias("m")).select("record_id", C("m.d").alias("delays"))
    x = _sequences(p, r).filter("p_n > 0 and r_n > 0").join(mapped, "record_id")
    x = x.withColumns({"known": F.filter("delays", lambda d: d.isNotNull()), "phases": _phase_of_r(x)})
    x = x.withColumns({"conducted_n": F.size("known"), "pr_median_ms": median(C("known")), "pr_mad_ms": mad(C("known")), "max_consecutive_drop": _longest_drop(C("delays")), "phase_mad": F.when(F.size("phases") >= 3, mad(C("phases"))), "phase_range": F.when(F.size("phases") >= 3, spread(C("phases")))})
    x = x.withColumn("dropped_n", C("p_n") - C("conducted_n"))
    if reproducible is None:
        x = x.withColumn("reproducible", F.lit(True))
    else:
        x = x.join(reproducible.select("record_id", "reproducible"), "record_id", "left").withColumn("reproducible", F.coalesce("reproducible", F.lit(False)))
    steady = F.coalesce((C("conducted_n") >= 3) & (C("pr_mad_ms") <= stable), F.lit(False))
    p_regular, r_regular = F.coalesce(C("pp_cv") <= regular, F.lit(False)), F.coalesce(C("rr_cv") <= regular, F.lit(False))
    one_to_one = C("reproducible") & (C("dropped_n") == 0) & (C("conducted_n") >= 3) & (F.abs(C("p_n") - C("r_n")) <= 1)
    faster = F.coalesce(C("rr_median") > FASTER * C("pp_median"), F.lit(False))
    dropping = p_regular & (C("dropped_n") >= 1) & (C("conducted_n") >= 2)
    rules = [
        (one_to_one & steady & (C("pr_median_ms") > long_delay), "first_degree", 0.90),
        (p_regular & r_regular & (C("p_n") >= 5) & (C("r_n") >= 3) & faster & _dissociated(C("phases"), C("pp_median"), floor) & ~steady, "complete_block", 0.86),
        (dropping & (C("p_n") / C("r_n")).between(1.75, 2.25) & _alternating(C("delays")), "two_to_one", 0.84),
        (dropping & (C("max_consecutive_drop") >= 2), "high_grade", 0.88),
        (dropping & steady, "mobitz_two", 0.80),
        (dropping & _progressive(C("delays"), rise), "wenckebach", 0.78),
    ]
    name, sure = F.lit("none_established"), F.when(p_regular, 0.65).otherwise(0.35)
    for holds, own, confidence in reversed(rules):
        name, sure = F.when(holds, own).otherwise(name), F.when(holds, confidence).otherwise(sure)
    return x.select("record_id", "p_n", "r_n", "conducted_n", "dropped_n", "max_consecutive_drop", "pr_median_ms", "pr_mad_ms", "phase_mad", "phase_range", name.alias("classification"), sure.alias("confidence"))


def cut_ring(places: Column, period: Column) -> Column:
    """Places on a ring (0 up to the period) from its largest gap on (of gaps that tie, the first): no pair is farther apart than on the ring."""
    s = F.array_sort(places)
    ahead = F.concat(F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), F.array(F.get(s, F.lit(0)) + period))
    gaps = F.zip_with(ahead, s, lambda b, a: F.round(b - a, 6))
    at = F.array_position(gaps, F.array_max(gaps)).cast("int")
    return F.concat(F.slice(s, at + 1, F.size(s)), F.transform(F.slice(s, 1, at), lambda v: v + period))


def best_period(events: DataFrame, low: float, high: float, step: float = 1.0, divisors: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    """(record_id, period, residual): of gaps / divisors within bounds the period with the least median relative residual; ties: the longer.

    Gaps are counted in steps first, so a record has at most high / step candidates a divisor and compares each with
    its distinct gaps.
    """
    gap = lambda df: df.withColumn("gap", F.round((C("t_ms") - F.lag("t_ms").over(W.partitionBy("record_id").orderBy("t_ms"))) / step) * step)
    g = gap(events.select("record_id", C("t_ms").cast("double").alias("t_ms")).distinct()).filter("gap > 0").groupBy("record_id", "gap").agg(F.count("*").alias("n"))
    cand = g.select("record_id", F.explode(F.array(*[C("gap") / k for k in divisors])).alias("period")).filter(C("period").between(low, high)).distinct()
    cycles = F.greatest(F.lit(1.0), F.rint(C("gap") / C("period")))
    both = cand.join(g, "record_id").withColumn("res", F.abs(C("gap") - cycles * C("period")) / C("period"))
    m = both.groupBy("record_id", "period").agg(F.percentile("res", F.lit(0.5), C("n")).alias("residual"))
    return m.groupBy("record_id").agg(F.min_by(F.struct("period", "residual"), F.struct(F.round("residual", 9), -C("period"))).alias("x")).select("record_id", "x.*")


def harmonic_period(events: DataFrame, r: DataFrame, low: float = 300.0, high: float = 1500.0, floor: float = 50.0, regular: float = REGULAR, residual: float = 0.12, step: float = 1.0) -> DataFrame:
    """Cadence of events beside that of r, per record with events; nothing is judged under three events or three r.

    The period is that of best_period; rates are per minute. The phases of r in it lie on a ring that is cut at its
    largest gap before their MAD and range are taken. A complete block is a consistent period, faster than a regular
    r, with r all over the ring.
    """
    x = _sequences(events, r).filter("p_n > 0").join(best_period(events, low, high, step), "record_id", "left")
    x = x.withColumn("evaluable", (C("p_n") >= 3) & (C("r_n") >= 3))
    first = F.get(C("ps.t"), F.lit(0))
    x = x.withColumn("ring", F.when(C("evaluable") & C("period").isNotNull(), cut_ring(F.transform("rs", lambda e: F.pmod(e["t"] - first, C("period"))), C("period"))))
    x = x.withColumns({"atrial_rate": 60000.0 / C("period"), "phase_mad": mad(C("ring")), "phase_range": spread(C("ring")), "harmonic_consistent": F.coalesce(C("residual") <= residual, F.lit(False)), "ventricular_regular": F.coalesce(C("rr_cv") <= regular, F.lit(False))})
    x = x.withColumns({"faster": F.coalesce(C("atrial_rate") > FASTER * 60000.0 / C("rr_median"), F.lit(False)), "phase_dissociation": _dissociated(C("ring"), C("period"), floor)})
    x = x.withColumn("complete_block", C("harmonic_consistent") & C("faster") & C("ventricular_regular") & C("phase_dissociation"))
    numbers = [F.when(C("evaluable"), C(c)).alias(c) for c in ("period", "residual", "atrial_rate", "rr_cv", "phase_mad", "phase_range")]
    flags = [(C("evaluable") & C(c)).alias(c) for c in ("harmonic_consistent", "ventricular_regular", "faster", "phase_dissociation", "complete_block")]
    return x.select("record_id", "evaluable", C("p_n").alias("event_n"), *numbers, *flags)
