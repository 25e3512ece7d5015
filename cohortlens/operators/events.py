"""Event sequences of records: matching, intervals, clusters, conduction, series repair. Times are t_ms."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from cohortlens.sources.shared import written

C = F.col
#: Waves of all templates together: with a few hundred numbers each, some MB.
MOST_TEMPLATES = 10_000
#: Scores of waves against templates that a task holds at once.
MOST_SCORES = 1 << 18


def rec():
    return W.partitionBy("record_id")


def asof_before(r: DataFrame, p: DataFrame, lo: float, hi: float) -> DataFrame:
    """Each r event (r_ms) with the last p event (p_ms) from lo to hi before it; one pass over the joint timeline."""
    line = r.select("record_id", (C("t_ms") - lo).alias("at"), F.lit(1).alias("o"), C("t_ms").alias("r_ms"), F.lit(None).cast("double").alias("p_ms")).unionByName(p.select("record_id", C("t_ms").alias("at"), F.lit(0).alias("o"), F.lit(None).cast("double").alias("r_ms"), C("t_ms").cast("double").alias("p_ms")))
    got = line.withColumn("p_ms", F.last("p_ms", ignorenulls=True).over(rec().orderBy("at", "o").rowsBetween(W.unboundedPreceding, 0))).filter("r_ms is not null")
    return got.select("record_id", "r_ms", F.when(C("p_ms") >= C("r_ms") - hi, C("p_ms")).alias("p_ms"))


def _claim(lo: float, hi: float):
    def run(key, part: pd.DataFrame) -> pd.DataFrame:
        rs, ps, out = sorted(part.t_ms[part.side == "r"]), sorted(part.t_ms[part.side == "p"]), []
        free, k = [], 0  # the latest free one is on top; what is too early for one is so for all later ones
        for t in rs:
            while k < len(ps) and t - ps[k] >= lo:
                free.append(ps[k])
                k += 1
            out.append((key[0], t, free.pop() if free and t - free[-1] <= hi else None))
        return pd.DataFrame(out, columns=["record_id", "r_ms", "p_ms"])

    return run


def claimed_pairs(r: DataFrame, p: DataFrame, lo: float, hi: float) -> DataFrame:
    """As asof_before, but a p event is taken by one r event only, the earliest first: one record at a time."""
    both = r.select("record_id", C("t_ms").cast("double").alias("t_ms"), F.lit("r").alias("side")).unionByName(p.select("record_id", C("t_ms").cast("double").alias("t_ms"), F.lit("p").alias("side")))
    return both.groupBy("record_id").applyInPandas(_claim(lo, hi), "record_id bigint, r_ms double, p_ms double")


def near_pairs(a: DataFrame, b: DataFrame, tol: float, by: tuple[str, ...] = ("record_id",), also: tuple[str, ...] = ()) -> DataFrame:
    """(record_id, a_ms, b_ms, error) of all pairs within tol: equal time buckets and their neighbours meet.

    Columns `also` of either side go with it as a_ and b_.
    """
    left = a.select(*by, C("t_ms").alias("a_ms"), *[C(c).alias(f"a_{c}") for c in also], F.floor(C("t_ms") / tol).alias("__k"))
    right = b.select(*by, C("t_ms").alias("b_ms"), *[C(c).alias(f"b_{c}") for c in also], F.explode(F.array(*[F.floor(C("t_ms") / tol) + d for d in (-1, 0, 1)])).alias("__k"))
    return left.join(right, [*by, "__k"]).withColumn("error", F.abs(C("a_ms") - C("b_ms"))).filter(C("error") <= tol).drop("__k")


#: Rounds of matching in one job; then what is still open is written.
ROUNDS = 4


def tolerance_match(truth: DataFrame, found: DataFrame, tol: float, by: tuple[str, ...] = ("record_id",)) -> DataFrame:
    """(record_id, a_ms, b_ms, error, round): one-to-one matches, shortest error first; ties by truth, then detection.

    In each round the pairs that are best for both of their events, under that order, are matched, and pairs with a
    matched event go; when no pair is left, these are the matches of the greedy walk over all pairs in that order.
    Rows are dealt by record, which all windows of a job share. Events of one time are separate events.
    """
    numbered = lambda df: df.withColumn("n", F.row_number().over(W.partitionBy(*by, "t_ms").orderBy("t_ms")))
    pairs = near_pairs(numbered(truth), numbered(found), tol, by, ("n",)).select(*by, *[C(c).cast("double").alias(c) for c in ("a_ms", "b_ms", "error")], "a_n", "b_n", F.lit(0).alias("round"))
    key = F.struct("error", "a_ms", "a_n", "b_ms", "b_n")
    of_a, of_b = W.partitionBy(*by, "a_ms", "a_n"), W.partitionBy(*by, "b_ms", "b_n")
    open_, done, number = pairs, None, 0
    while True:
        x = open_.repartition(*by)
        for _ in range(ROUNDS):  # round: 0 open, -1 without a chance, else the round that matched it
            number += 1
            free = C("round") == 0
            x = x.withColumn("best", F.min(F.when(free, key)).over(of_a)).withColumn("won", free & (key == C("best")) & (key == F.min(F.when(free, key)).over(of_b)))
            x = x.withColumn("gone", F.max("won").over(of_b)).withColumn("gone", C("gone") | F.max("won").over(of_a))
            x = x.withColumn("round", F.when(C("won"), number).when(free & C("gone"), -1).otherwise(C("round"))).drop("best", "won", "gone")
        held = written(x.filter("round >= 0"), "matched")
        matched = held.filter("round > 0").select(*by, "a_ms", "b_ms", "error", "round")
        done = matched if done is None else done.unionByName(matched)
        open_ = held.filter("round = 0")
        if open_.isEmpty():
            return done


def match_counts(truth: DataFrame, found: DataFrame, tol: float, by: tuple[str, ...] = ("record_id",)) -> DataFrame:
    """Matched, missed and extra events with the median error."""
    n = truth.groupBy(*by).agg(F.count("*").alias("n_truth")).join(found.groupBy(*by).agg(F.count("*").alias("n_found")), list(by), "full").fillna(0, ["n_truth", "n_found"])
    m = tolerance_match(truth, found, tol, by).groupBy(*by).agg(F.count("*").alias("matched"), F.median("error").alias("median_error"))
    return n.join(m, list(by), "left").fillna(0, ["matched"]).withColumns({"missed": C("n_truth") - C("matched"), "extra": C("n_found") - C("matched")})


def near_any(a: DataFrame, b: DataFrame, tol: float) -> DataFrame:
    """a events with a flag whether any b event lies within tol."""
    hit = near_pairs(a, b, tol).select("record_id", C("a_ms").alias("t_ms")).distinct().withColumn("near", F.lit(True))
    return a.join(hit, ["record_id", "t_ms"], "left").withColumn("near", F.coalesce("near", F.lit(False)))


def interval_exclusion(cands: DataFrame, spans: DataFrame, bucket: float) -> DataFrame:
    """Candidates outside all protected spans (lo, hi) of their record."""
    held = spans.select("record_id", "lo", "hi", F.explode(F.sequence(F.floor(C("lo") / bucket), F.floor(C("hi") / bucket))).alias("__k"))
    keyed = cands.withColumn("__k", F.floor(C("t_ms") / bucket))
    inside = (keyed["record_id"] == held["record_id"]) & (keyed["__k"] == held["__k"]) & (keyed["t_ms"] >= held["lo"]) & (keyed["t_ms"] <= held["hi"])
    return keyed.join(held, inside, "left_anti").drop("__k")


def context_window(q: DataFrame, evts: DataFrame, before: tuple[str, float], after: tuple[str, float]) -> DataFrame:
    """Each q event with the previous event of one kind and the next of another, within bounds."""
    line = evts.select("record_id", "t_ms", "kind", F.lit(False).alias("q")).unionByName(q.select("record_id", "t_ms", F.lit(None).cast("string").alias("kind"), F.lit(True).alias("q")))
    over = rec().orderBy("t_ms").rangeBetween(W.unboundedPreceding, -1)
    ahead = rec().orderBy("t_ms").rangeBetween(1, W.unboundedFollowing)
    got = line.withColumns({"prev": F.max(F.when(C("kind") == before[0], C("t_ms"))).over(over), "next": F.min(F.when(C("kind") == after[0], C("t_ms"))).over(ahead)}).filter("q")
    return got.select("record_id", "t_ms", F.when(C("t_ms") - C("prev") <= before[1], C("prev")).alias("prev_ms"), F.when(C("next") - C("t_ms") <= after[1], C("next")).alias("next_ms"))


def gaps(evts: DataFrame, by: tuple[str, ...] = ("record_id",)) -> DataFrame:
    """Differences of sorted distinct event times."""
    d = evts.select(*by, "t_ms").distinct()
    return d.withColumn("gap", C("t_ms") - F.lag("t_ms").over(W.partitionBy(*by).orderBy("t_ms")))


def interval_stats(evts: DataFrame, by: tuple[str, ...] = ("record_id",), short: float = 50.0) -> DataFrame:
    """Median, MAD, CV (n - 1), RMSSD and share of large steps of the gaps, with the two regularity flags."""
    g = gaps(evts, by).filter("gap is not null").withColumn("step", C("gap") - F.lag("gap").over(W.partitionBy(*by).orderBy("t_ms")))
    a = g.groupBy(*by).agg(F.count("*").alias("n"), F.median("gap").alias("median"), F.avg("gap").alias("mean"), (F.stddev_samp("gap") / F.avg("gap")).alias("cv"), F.sqrt(F.avg(C("step") * C("step"))).alias("rmssd"), F.avg((F.abs("step") > short).cast("int")).alias("pnn"))
    mad = g.join(a.select(*by, "median"), list(by)).groupBy(*by).agg(F.median(F.abs(C("gap") - C("median"))).alias("mad"))
    return a.join(mad, list(by)).withColumns({"regular": F.coalesce(C("cv") <= 0.12, F.lit(False)), "very_regular": F.coalesce((C("cv") <= 0.10) & (C("mad") / C("median") <= 0.08), F.lit(False))})


def irregularity_score(stats: DataFrame) -> DataFrame:
    """0 to 1 from up to four linear parts; weights of absent parts are shared out."""
    line = lambda c, a, b: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (c - a) / (b - a)))
    parts = [(line(C("cv"), 0.05, 1.2), 0.35), (line(C("rmssd") / C("mean"), 0.05, 1.5), 0.25), (line(C("pnn"), 0.1, 1.0), 0.25), (line(C("mad") / C("median"), 0.05, 1.0), 0.15)]
    top = sum(F.coalesce(p * w, F.lit(0.0)) for p, w in parts)
    weight = sum(F.when(p.isNotNull(), w).otherwise(0.0) for p, w in parts)
    return stats.withColumn("irregularity", top / F.nullif(weight, F.lit(0.0)))


def premature_events(beats: DataFrame, early: float = 0.82) -> DataFrame:
    """Beats whose gap is below `early` of the median, with wide, outlying and pause flags and their class."""
    w = rec().orderBy("t_ms", "event_id")
    g = beats.withColumns({"gap": C("t_ms") - F.lag("t_ms").over(w), "after": F.lead("t_ms").over(w) - C("t_ms")})
    m = g.groupBy("record_id").agg(F.median("gap").alias("m_gap"), F.median("amplitude").alias("m_amp"))
    p = g.join(m, "record_id").filter(C("gap") < early * C("m_gap"))
    flags = p.withColumns({"outlier": F.abs(C("amplitude") - C("m_amp")) > 0.5 * C("m_amp"), "pause": F.coalesce(C("gap") + C("after") >= 1.8 * C("m_gap"), F.lit(False))})
    return flags.select("record_id", "event_id", "outlier", "pause", F.when(C("outlier") & C("pause"), "ventricular_like").when(C("outlier") | C("pause"), "undetermined").otherwise("supraventricular_like").alias("class"))


#: Fixed values of premature beats: gap and pause by the median gap, width by itself and over the median, amplitude by itself and by the median.
EARLY, PAUSE, WIDE, WIDER, TALL, TALLER = 0.82, 1.75, 120.0, 25.0, 0.30, 0.60


def ectopic_beats(beats: DataFrame) -> DataFrame:
    """Premature beats of records with five beats or more: (record_id, event_id, wide, amplitude_outlier, pause, kind).

    beats(record_id, event_id, t_ms, width, amplitude); unknown widths and amplitudes are no outliers. The first and
    the last beat of a record are not judged.
    """
    w = rec().orderBy("t_ms", "event_id")
    g = beats.withColumns({"gap": C("t_ms") - F.lag("t_ms").over(w), "after": F.lead("t_ms").over(w) - C("t_ms")})
    m = g.groupBy("record_id").agg(F.count("*").alias("n"), F.median("gap").alias("m_gap"), F.median("width").alias("m_width"), F.median("amplitude").alias("m_amp")).filter("n >= 5")
    p = g.filter("after is not null").join(m, "record_id").filter(C("gap") < EARLY * C("m_gap"))
    no = F.lit(False)
    p = p.withColumns({
        "wide": F.coalesce((C("width") >= WIDE) | (C("width") >= C("m_width") + WIDER), no), "amplitude_outlier": F.coalesce(F.abs(C("amplitude") - C("m_amp")) >= F.greatest(F.lit(TALL), TALLER * F.abs("m_amp")), no),
        "pause": C("gap") + C("after") >= PAUSE * C("m_gap"),
    })
    kind = F.when(C("wide") & (C("amplitude_outlier") | C("pause")), "ventricular").when(~C("wide"), "supraventricular").otherwise("unclassified")
    return p.select("record_id", "event_id", "wide", "amplitude_outlier", "pause", kind.alias("kind"))


def ectopy_burden(beats: DataFrame) -> DataFrame:
    """Per record: beats, premature ones by kind, their share of all beats, and whether they may explain irregular gaps."""
    n = beats.groupBy("record_id").agg(F.count("*").alias("n_beats"))
    k = ectopic_beats(beats).groupBy("record_id").agg(F.count("*").alias("premature"), F.count_if(C("kind") == "ventricular").alias("ventricular"), F.count_if(C("kind") == "supraventricular").alias("supraventricular"))
    out = n.join(k, "record_id", "left").fillna(0, ["premature", "ventricular", "supraventricular"]).withColumn("evaluable", C("n_beats") >= 5)
    out = out.withColumn("burden", F.when(C("evaluable"), C("premature") / C("n_beats")))
    return out.withColumn("explains_irregularity", F.coalesce((C("premature") >= 2) & (C("burden") >= 0.10), F.lit(False)))


def gap_clusters(evts: DataFrame, tol: float, channels: int = 2, by: tuple[str, ...] = ("record_id",)) -> DataFrame:
    """Clusters of events less than tol apart, with their channels, median time and spread; those of enough channels."""
    w = W.partitionBy(*by).orderBy("t_ms", "kind")
    c = evts.withColumn("n_c", F.sum(F.coalesce((C("t_ms") - F.lag("t_ms").over(w) > tol).cast("int"), F.lit(1))).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return c.groupBy(*by, "n_c").agg(F.countDistinct("kind").alias("channels"), F.median("t_ms").alias("t_ms"), (F.max("t_ms") - F.min("t_ms")).cast("double").alias("spread")).filter(C("channels") >= channels).drop("n_c")


def _running(tol: float, channels: int):
    def run(key, part: pd.DataFrame) -> pd.DataFrame:
        out, times, kinds = [], [], set()  # times come sorted, so the median is in the middle
        middle = lambda: (times[(len(times) - 1) // 2] + times[len(times) // 2]) / 2
        rows = part.sort_values(["t_ms", "kind"])
        for t, kind in [*zip(rows.t_ms.astype(float), rows.kind, strict=True), (None, None)]:
            if times and (t is None or abs(t - middle()) > tol):
                if len(kinds) >= channels:
                    out.append((key[0], len(kinds), middle(), times[-1] - times[0]))
                times, kinds = [], set()
            if t is not None:
                times.append(t)
                kinds.add(kind)
        return pd.DataFrame(out, columns=["record_id", "channels", "t_ms", "spread"])

    return run


def exact_clusters(evts: DataFrame, tol: float, channels: int = 2) -> DataFrame:
    """Clusters whose next event lies within tol of their running median: order-dependent, one record at a time."""
    return evts.select("record_id", "t_ms", "kind").groupBy("record_id").applyInPandas(_running(tol, channels), "record_id bigint, channels bigint, t_ms double, spread double")


def refractory_dedupe(events: DataFrame, refractory: float) -> DataFrame:
    """Of each chain of events less than `refractory` apart the one with most channels; ties: the first."""
    w = rec().orderBy("t_ms")
    chained = events.withColumn("chain", F.sum(F.coalesce((C("t_ms") - F.lag("t_ms").over(w) >= refractory).cast("int"), F.lit(1))).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return chained.groupBy("record_id", "chain").agg(F.max_by("t_ms", F.struct("channels", -C("t_ms"))).alias("t_ms"), F.max("channels").alias("channels")).drop("chain")


def organised_sequence(events: DataFrame, low: float, high: float, cv: float = 0.12, least: int = 4) -> DataFrame:
    s = interval_stats(events)
    ok = (C("n") + 1 >= least) & C("median").between(low, high) & (C("cv") <= cv)
    return s.select("record_id", (C("n") + 1).alias("n_events"), "median", "cv", F.coalesce(ok, F.lit(False)).alias("organised"))


def coupling_relation(p: DataFrame, r: DataFrame, lo: float, hi: float, fraction: float = 0.70, mad: float = 30.0) -> DataFrame:
    """Share of p events that an r event of their own follows, and whether the delay is stable."""
    pairs = claimed_pairs(r, p, lo, hi).filter("p_ms is not null").withColumn("d", C("r_ms") - C("p_ms"))
    m = pairs.groupBy("record_id").agg(F.count("*").alias("coupled"), F.median("d").alias("delay"))
    s = pairs.join(m, "record_id").groupBy("record_id").agg(F.median(F.abs(C("d") - C("delay"))).alias("delay_mad"))
    out = p.groupBy("record_id").agg(F.count("*").alias("n_p")).join(m, "record_id", "left").join(s, "record_id", "left").fillna(0, ["coupled"])
    return out.withColumn("related", F.coalesce((C("coupled") / C("n_p") >= fraction) & (C("delay_mad") <= mad), F.lit(False)))


def relative_amplitude_filter(beats: DataFrame, t: float = 0.15) -> DataFrame:
    """Beats of at least t times the median of the upper half of amplitudes; unevaluable ones stay."""
    w = rec().orderBy(F.desc_nulls_last("amplitude"), "event_id")
    ranked = beats.withColumns({"k": F.row_number().over(w), "n": F.count("amplitude").over(rec())})
    ref = ranked.filter(C("k") <= F.ceil(C("n") / 2)).groupBy("record_id").agg(F.median("amplitude").alias("reference"))
    return ranked.join(ref, "record_id", "left").filter(C("amplitude").isNull() | C("reference").isNull() | (C("amplitude") >= t * C("reference"))).drop("k", "n")


def threshold_sweep(beats: DataFrame, truth: DataFrame, thresholds: list[float], tol: float) -> DataFrame:
    """Matched, missed and extra events after the amplitude filter, per threshold; all thresholds are matched together."""
    kept = reduce(DataFrame.unionByName, [relative_amplitude_filter(beats, t).select("record_id", "t_ms", F.lit(t).alias("threshold")) for t in thresholds])
    each = truth.select("record_id", "t_ms", F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"))
    return match_counts(each, kept, tol, ("threshold", "record_id")).groupBy("threshold").agg(*[F.sum(c).alias(c) for c in ("matched", "missed", "extra")])


def extra_event_attribution(extras: DataFrame, p: DataFrame, q: DataFrame, tol: float) -> DataFrame:
    near_p = near_any(extras, p, tol).withColumnRenamed("near", "near_p")
    both = near_any(near_p, q, tol).withColumnRenamed("near", "near_q")
    return both.withColumn("attribution", F.when(C("near_p"), "near_p").when(C("near_q"), "near_t").otherwise("other"))


def trim_padding(samples: DataFrame, eps: float, most: int | None = None) -> DataFrame:
    """Samples between the first and last index where any channel exceeds eps; at most the first `most` of them."""
    live = samples.groupBy("record_id", "i").agg(F.max(F.abs("v")).alias("m")).filter(C("m") > eps).groupBy("record_id").agg(F.min("i").alias("a"), F.max("i").alias("b"))
    out = samples.join(live, "record_id").filter(C("i").between(C("a"), C("b")))
    return (out.filter(C("i") < C("a") + most) if most else out).withColumn("i", C("i") - C("a")).drop("a", "b")


def fill_short_gaps(series: DataFrame, most: int) -> DataFrame:
    """Linear fill of inner gaps of up to `most` samples, flagged."""
    back, ahead = rec().orderBy("i").rowsBetween(W.unboundedPreceding, 0), rec().orderBy("i").rowsBetween(0, W.unboundedFollowing)
    at = F.when(C("v").isNotNull(), C("i"))
    x = series.withColumns({"i0": F.last(at, True).over(back), "v0": F.last("v", True).over(back), "i1": F.first(at, True).over(ahead), "v1": F.first("v", True).over(ahead)})
    can = C("v").isNull() & (C("i1") - C("i0") - 1 <= most)
    line = C("v0") + (C("v1") - C("v0")) * (C("i") - C("i0")) / (C("i1") - C("i0"))
    return x.select("record_id", "i", F.when(can, line).otherwise(C("v")).alias("v"), F.coalesce(can, F.lit(False)).alias("interpolated"))


def resample_grid(series: DataFrame, step: int, most: int) -> DataFrame:
    """Linear interpolation of (record_id, t_ms, v) on a grid of `step`, never across gaps longer than `most`."""
    s = series.groupBy("record_id", "t_ms").agg(F.avg("v").alias("v"))
    nxt = s.withColumns({"t1": F.lead("t_ms").over(rec().orderBy("t_ms")), "v1": F.lead("v").over(rec().orderBy("t_ms"))}).filter(C("t1") - C("t_ms") <= most)
    first, last = F.ceil(C("t_ms") / step), F.ceil(C("t1") / step) - 1
    grid = nxt.filter(first <= last).select("record_id", "t_ms", "t1", "v", "v1", F.explode(F.sequence(first, last)).alias("g"))
    t = C("g") * step
    return grid.select("record_id", t.alias("grid_ms"), (C("v") + (C("v1") - C("v")) * (t - C("t_ms")) / (C("t1") - C("t_ms"))).alias("v"), F.when(t == C("t_ms"), 2).otherwise(1).alias("quality"))


def despike(series: DataFrame) -> DataFrame:
    """Series without points far from the midpoint of neighbours that agree: beyond max(1.5, median + 12 MAD of steps)."""
    w = rec().orderBy("i")
    x = series.withColumns({"a": F.lag("v").over(w), "b": F.lead("v").over(w)}).withColumn("step", F.abs(C("v") - C("a")))
    m = x.groupBy("record_id").agg(F.median("step").alias("m"))
    d = x.join(m, "record_id").groupBy("record_id").agg(F.median(F.abs(C("step") - C("m"))).alias("mad"), F.first("m").alias("m"))
    limit = F.greatest(F.lit(1.5), C("m") + 12 * C("mad"))
    bad = (F.abs(C("v") - (C("a") + C("b")) / 2) > limit) & (F.abs(C("a") - C("b")) <= limit)
    return x.join(d, "record_id").filter(~F.coalesce(bad, F.lit(False))).select("record_id", "i", "v")


def channel_regularity(evts: DataFrame, selected: str, tol: float) -> DataFrame:
    """CV of a channel's gaps beside the CV of the clusters of three channels or more."""
    own = interval_stats(evts.filter(C("kind") == selected)).select("record_id", C("cv").alias("channel_cv"))
    cons = interval_stats(gap_clusters(evts, tol, 3).select("record_id", "t_ms")).select("record_id", C("cv").alias("consensus_cv"))
    return own.join(cons, "record_id", "full")


def rhythm_lead_pick(leads: DataFrame, first: str = "II", long: float = 5.0) -> DataFrame:
    """(record_id, lead): the conventional lead if it is long enough with five beats, else the best by duration and confidence.

    leads(record_id, lead, evaluable, duration_s, r_count, confidence); others need four beats. Records without any have no row.
    """
    usual = (C("lead") == first) & (C("duration_s") >= long) & (C("r_count") >= 5)
    score = F.coalesce("duration_s", F.lit(0.0)) * F.greatest(F.coalesce("confidence", F.lit(0.0)), F.lit(0.1))
    able = leads.filter(C("evaluable") & (F.coalesce(usual, F.lit(False)) | (C("r_count") >= 4)))
    return able.groupBy("record_id").agg(F.max_by("lead", F.struct(F.coalesce(usual, F.lit(False)), score, C("lead"))).alias("lead"))


def conduction_lead_pick(leads: DataFrame, preferred: list[str]) -> DataFrame:
    """(record_id, lead, score): the lead with the best atrial evidence among the preferred, whose order breaks near ties.

    leads(record_id, lead, evaluable, p_count, r_count, pp_cv, reproducible, coupling, confidence): four p and three r at least.
    """
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(c, F.lit(0.0))))
    flag = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    order = F.array_position(F.array(*[F.lit(x) for x in preferred]), C("lead"))
    able = leads.filter((order > 0) & C("evaluable") & (C("p_count") >= 4) & (C("r_count") >= 3))
    evidence = 40.0 * flag(C("reproducible")) + 25.0 * flag(C("pp_cv") <= 0.12) + 10.0 * unit(C("confidence")) + 8.0 * unit(C("coupling")) + F.least(C("p_count"), F.lit(12)) + 0.5 * F.least(C("r_count"), F.lit(12))
    score = evidence + 2.0 * (len(preferred) + 1 - order) / len(preferred)
    return able.groupBy("record_id").agg(F.max(F.struct(score.alias("score"), "lead")).alias("x")).select("record_id", "x.lead", "x.score")


def _wave_matrix(waves: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Values (null as 0) and nulls of waves of `size` numbers each."""
    flat = waves.flatten()
    return flat.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, size), flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, size)


def _peak_to_peak(v: np.ndarray, null: np.ndarray) -> np.ndarray:
    return np.max(np.where(null, -np.inf, v), axis=1, initial=-np.inf) - np.min(np.where(null, np.inf, v), axis=1, initial=np.inf)


def window_correlation(a: np.ndarray, b: np.ndarray, shift: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pearson correlation of each row of a at i with each row of b at i + shift over the places that both have, and where there is one: `least` places or more and spread."""
    n = min(a.shape[1], b.shape[1]) - abs(shift)
    if n < max(least, 1):
        return np.zeros((len(a), len(b))), np.zeros((len(a), len(b)), bool)
    x, y = a[:, max(0, -shift) :][:, :n], b[:, max(0, shift) :][:, :n]
    x, y = x - x.mean(axis=1, keepdims=True), y - y.mean(axis=1, keepdims=True)
    spread = np.sqrt((x * x).sum(axis=1))[:, None] * np.sqrt((y * y).sum(axis=1))[None, :]
    return x @ y.T / spread, ~(n * spread <= 1e-9)


def _lead_scores(waves: tuple[np.ndarray, np.ndarray], templates: tuple[np.ndarray, np.ndarray], windows: list[tuple[int, int, float]], shift: int, amplitude: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores of every wave against every template of one lead, and where there is one."""
    (a, a_null), (b, b_null) = waves, templates
    total, weighted = np.zeros((2, len(a), len(b)))
    for first, size, weight in windows:
        at = slice(first, first + size)
        best, seen = np.full((len(a), len(b)), -np.inf), np.zeros((len(a), len(b)), bool)
        for s in range(-shift, shift + 1):
            c, there = window_correlation(a[:, at], b[:, at], s, least)
            n = min(a[:, at].shape[1], b[:, at].shape[1]) - abs(s)
            if n > 0:
                there = there & ~(a_null[:, at][:, max(0, -s) :][:, :n].any(axis=1)[:, None] | b_null[:, at][:, max(0, s) :][:, :n].any(axis=1)[None, :])
            best, seen = np.where(there, np.maximum(best, c), best), seen | there
        weighted += np.where(seen, weight * np.fmin(1.0, np.maximum(0.0, (best + 1) / 2)), 0.0)
        total += np.where(seen, weight, 0.0)
    mean = weighted / total
    p, q = _peak_to_peak(a, a_null)[:, None], _peak_to_peak(b, b_null)[None, :]
    like = np.exp(-np.abs(np.log((p + 1e-6) / (q + 1e-6))))
    return np.where((p <= 1e-6) | (q <= 1e-6), mean, (1 - amplitude) * mean + amplitude * like), total != 0


def template_scores(waves: DataFrame, templates: DataFrame, windows: list[tuple[int, int, float]], shift: int, amplitude: float = 0.15, least: int = 10) -> DataFrame:
    """(record_id, template, visual, coverage) of each record against each of a bounded set of templates.

    waves(record_id, lead, wave) and templates(template, lead, wave). Per lead every window (first, size, weight)
    has its best correlation over shifts, on a scale from 0 to 1; their weighted mean and the likeness of the
    peak-to-peak sizes make the lead's score. The mean over leads is lowered by leads of the template that the
    record lacks. Arrow batches of waves meet all templates of their lead at once.
    """
    spark = waves.sparkSession
    given = templates.filter("template is not null").select("template", "lead", C("wave").cast("array<double>").alias("wave"))
    rows = given.limit(MOST_TEMPLATES + 1).collect()
    if len(rows) > MOST_TEMPLATES:
        raise ValueError(f"the set of templates has more than {MOST_TEMPLATES} rows, too many to be sent to every task")
    names = {name: k for k, name in enumerate(dict.fromkeys(r.template for r in rows))}
    own: dict = {}
    for r in rows:
        own.setdefault(r.lead, {}).setdefault(None if r.wave is None else len(r.wave), []).append((names[r.template], r.wave))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {lead: [(np.array([k for k, _ in x], "int32"), None if size is None else _wave_matrix(pa.array([w for _, w in x], pa.list_(pa.float64())), size)) for size, x in sets.items()] for lead, sets in own.items()}
        for batch in batches:
            lead, wave = batch.column("lead").dictionary_encode(), batch.column("wave")
            sizes = pc.fill_null(pc.list_value_length(wave), -1).to_numpy(zero_copy_only=False)
            codes = pc.fill_null(lead.indices, -1).to_numpy(zero_copy_only=False)
            for code, size in sorted({*zip(codes.tolist(), sizes.tolist(), strict=True)}):
                for which, other in known.get(lead.dictionary[code].as_py(), []) if code >= 0 else []:
                    at = np.flatnonzero((codes == code) & (sizes == size))
                    step = max(1, MOST_SCORES // len(which))
                    for part in (at[k : k + step] for k in range(0, len(at), step)):
                        score, there = np.zeros((len(part), len(which))), np.zeros((len(part), len(which)), bool)
                        if size > 0 and other is not None:
                            with np.errstate(all="ignore"):
                                score, there = _lead_scores(_wave_matrix(wave.take(pa.array(part)), size), other, windows, shift, amplitude, least)
                        yield pa.RecordBatch.from_arrays([batch.column("record_id").take(pa.array(np.repeat(part, len(which)))), pa.array(np.tile(which, len(part))), pa.array(score.ravel(), mask=~there.ravel())], ["record_id", "k", "score"])

    kinds = StructType([StructField("record_id", waves.schema["record_id"].dataType), StructField("k", IntegerType()), StructField("score", DoubleType())])
    scored = waves.select("record_id", "lead", C("wave").cast("array<double>").alias("wave")).mapInArrow(run, kinds)
    leads = Counter(names[r.template] for r in rows)
    named = spark.createDataFrame([(k, name, leads[k]) for name, k in names.items()], StructType([StructField("k", IntegerType()), StructField("template", templates.schema["template"].dataType), StructField("n", LongType())]))
    by = scored.groupBy("record_id", "k").agg(F.avg("score").alias("mean"), F.count("score").alias("m")).join(F.broadcast(named), "k")
    coverage = C("m") / C("n")
    return by.select("record_id", "template", (C("mean") * (0.70 + 0.30 * coverage)).alias("visual"), coverage.alias("coverage"))


def fused_rank(scores: DataFrame, k: int = 3) -> DataFrame:
    """(record_id, template, fusion, status, rank) of (criteria, visual, measurement, coverage): weights .45, .35, .20 shared out over what is there."""
    parts = [(C("criteria"), 0.45), (C("visual"), 0.35), (C("measurement"), 0.20)]
    weight = sum(F.when(c.isNotNull(), F.lit(w)).otherwise(0.0) for c, w in parts)
    fusion = sum(F.coalesce(c * w, F.lit(0.0)) for c, w in parts) / F.nullif(weight, F.lit(0.0))
    met, seen = C("criteria") >= 0.95, C("visual").isNotNull()
    status = (
        F.when(C("fusion").isNull(), "NO_VALORABLE")
        .when(met & seen & (C("coverage") >= 0.50) & (C("visual") >= 0.72) & (C("fusion") >= 0.75), "CONCORDANT_HIGH")
        .when(met & seen & (C("coverage") >= 0.35) & (C("visual") >= 0.56) & (C("fusion") >= 0.63), "CONCORDANT_MODERATE")
        .when(met, "CRITERIA_POSITIVE_VISUAL_DISCORDANT")
        .when(C("criteria").isNull() & (C("coverage") >= 0.50) & (C("visual") >= 0.78), "VISUAL_ONLY_NO_RULE")
        .when((C("criteria") <= 0.20) & (C("coverage") >= 0.50) & (C("visual") >= 0.78), "VISUAL_MATCH_WITHOUT_CRITERIA")
        .when((C("criteria") <= 0.20) & (C("fusion") < 0.60), "NOT_SUPPORTED")
        .otherwise("INDETERMINATE")
    )
    ranked = scores.withColumn("fusion", fusion).withColumn("rank", F.row_number().over(W.partitionBy("record_id").orderBy(F.round("fusion", 6).desc_nulls_last(), "template")))
    return ranked.filter(C("rank") <= k).select("record_id", "template", "fusion", status.alias("status"), "rank")
