"""Queries without SQL, held to plain Python over the same tables."""

import re
from collections import Counter, defaultdict
from statistics import median

import numpy as np
import pytest

from cohortlens import catalogue

H = 3_600_000


@pytest.fixture(scope="module")
def events(spark, sf_dir):
    """{kind: {record: sorted (t_ms, amplitude, event_id)}}"""
    out = defaultdict(lambda: defaultdict(list))
    for r in spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_type", "user_id", "unix_millis(cast(ts as timestamp)) AS t", "value", "event_id").collect():
        out[r.event_type][r.user_id].append((r.t, r.value, r.event_id))
    return {k: {u: sorted(v) for u, v in d.items()} for k, d in out.items()}


def rows(spark, sf_dir, name):
    return [r.asDict() for r in catalogue.QUERIES[name](spark, sf_dir).collect()]


def claims(rs, ps, lo, hi):
    used, out = set(), []
    for t in sorted(rs):
        free = [k for k, x in enumerate(sorted(ps)) if k not in used and lo <= t - x <= hi]
        used |= set(free[-1:])
        out.append((t, sorted(ps)[free[-1]] if free else None))
    return out


def times(events, kind, record):
    return [t for t, *_ in events[kind].get(record, [])]


def test_j15_claimed(spark, sf_dir, events):
    want = Counter((u, t, p) for u in events["purchase"] for t, p in claims(times(events, "purchase", u), times(events, "view", u), H, 48 * H))
    assert Counter((r["record_id"], r["r_ms"], r["p_ms"]) for r in rows(spark, sf_dir, "j15_asof_claimed")) == want and any(p for _, _, p in want)


def greedy(a, b, tol):
    used_a, used_b, errors = set(), set(), []
    for e, x, y in sorted((abs(x - y), x, y) for x in set(a) for y in set(b) if abs(x - y) <= tol):
        if x not in used_a and y not in used_b:
            used_a.add(x)
            used_b.add(y)
            errors.append(e)
    return errors


def test_j16_greedy_match(spark, sf_dir, events):
    got = {r["record_id"]: (r["matched"], r["missed"], r["extra"], r["median_error"]) for r in rows(spark, sf_dir, "j16_tolerance_match")}
    want = {}
    for u in {*events["purchase"], *events["view"]}:
        a, b = times(events, "purchase", u), times(events, "view", u)
        e = greedy(a, b, 6 * H)
        want[u] = (len(e), len(a) - len(e), len(b) - len(e), median(e) if e else None)
    assert got == want


def test_e04_exact_clusters(spark, sf_dir, events):
    want = []
    for u in {u for d in events.values() for u in d}:
        held = []
        for t, k in [*sorted((t, k) for k, d in events.items() for t, *_ in d.get(u, [])), (None, None)]:
            if held and (t is None or abs(t - median(x for x, _ in held)) > 6 * H):
                if len({k for _, k in held}) >= 2:
                    want.append((u, len({k for _, k in held}), median(x for x, _ in held), held[-1][0] - held[0][0]))
                held = []
            held.append((t, k))
    assert sorted((r["record_id"], r["channels"], r["t_ms"], r["spread"]) for r in rows(spark, sf_dir, "e04_cross_channel_cluster_exact")) == sorted(want)


def cv(x):
    return np.std(x, ddof=1) / np.mean(x) if len(x) >= 2 else None


def conduction(p, r, lo, hi, long_delay, stable, rise, floor, regular):
    p, r = sorted(set(p)), sorted(set(r))
    pair = {x: t - x for t, x in claims(r, p, lo, hi) if x is not None}
    d = [pair.get(x) for x in p]
    known = [x for x in d if x is not None]
    delay = median(known) if known else None
    mad = median(abs(x - delay) for x in known) if known else None
    longest = max(map(len, "".join("d" if x is None else "-" for x in d).split("-")))
    pp, rr = np.diff(p), np.diff(r)
    phase = [t - max(x for x in p if x < t) for t in r if any(x < t for x in p)]
    phase = [x for x in phase if len(pp) and x <= 1.05 * np.median(pp)]
    wander = np.median(np.abs(phase - np.median(phase))) if len(phase) >= 3 else None
    span = max(phase) - min(phase) if len(phase) >= 3 else None
    apart = wander is not None and wander >= max(floor, 0.15 * np.median(pp)) and span >= 0.30 * np.median(pp)
    steady = len(known) >= 3 and mad <= stable
    p_regular, r_regular = (x is not None and x <= regular for x in (cv(pp), cv(rr)))
    flags = [x is not None for x in d]
    alternating = abs(sum(flags[::2]) - sum(flags[1::2])) >= max(1, len(flags) // 3)
    rising = any(d[k] is None and None not in d[k - 3 : k] and d[k - 2] - d[k - 3] > rise and d[k - 1] - d[k - 2] > rise for k in range(3, len(d)))
    dropping = p_regular and not all(flags) and len(known) >= 2
    if all(flags) and len(known) >= 3 and abs(len(p) - len(r)) <= 1 and steady and delay > long_delay:
        kind = "first_degree"
    elif p_regular and r_regular and len(p) >= 5 and len(r) >= 3 and np.median(rr) > 1.25 * np.median(pp) and apart and not steady:
        kind = "complete_block"
    elif dropping and 1.75 <= len(p) / len(r) <= 2.25 and alternating:
        kind = "two_to_one"
    elif dropping and longest >= 2:
        kind = "high_grade"
    elif dropping and steady:
        kind = "mobitz_two"
    else:
        kind = "wenckebach" if dropping and rising else "none_established"
    return len(p), len(r), len(known), longest, delay, mad, wander, span, kind


def test_e07_conduction(spark, sf_dir, events):
    got = {r["record_id"]: tuple(r[c] for c in ("p_n", "r_n", "conducted_n", "max_consecutive_drop", "pr_median_ms", "pr_mad_ms", "phase_mad", "phase_range", "classification")) for r in rows(spark, sf_dir, "e07_conduction_class")}
    both = set(events["view"]) & set(events["purchase"])
    want = {u: conduction(times(events, "view", u), times(events, "purchase", u), H, 48 * H, 20 * H, 12 * H, H, 2 * H, 0.9) for u in both}
    assert got == want and len({w[-1] for w in want.values()}) >= 2


def test_e09_coupling(spark, sf_dir, events):
    got = {r["record_id"]: (r["n_p"], r["coupled"], r["delay"], r["related"]) for r in rows(spark, sf_dir, "e09_coupling_relation")}
    want = {}
    for u, ps in events["view"].items():
        d = [t - x for t, x in claims(times(events, "purchase", u), times(events, "view", u), H, 48 * H) if x is not None]
        delay = median(d) if d else None
        want[u] = (len(ps), len(d), delay, bool(d) and len(d) / len(ps) >= 0.3 and median(abs(x - delay) for x in d) <= 12 * H)
    assert got == want


def test_e11_threshold_sweep(spark, sf_dir, events):
    got = {r["threshold"]: (r["matched"], r["missed"], r["extra"]) for r in rows(spark, sf_dir, "e11_threshold_sweep")}
    for least in (0.15, 0.2, 0.25):
        total = np.zeros(3, int)
        for u in {*events["purchase"], *events["view"]}:
            own = events["view"].get(u, [])
            known = sorted((a for _, a, _ in own if a is not None), reverse=True)
            limit = least * median(known[: -(-len(known) // 2)]) if known else 0
            b = [t for t, a, _ in own if a is None or a >= limit]
            a = times(events, "purchase", u)
            e = greedy(a, b, 6 * H)
            total += (len(e), len(a) - len(e), len(b) - len(e))
        assert got[least] == tuple(total)


def test_p06_windows(spark, sf_dir):
    term, skip = re.compile("licen[cs]ed|license", re.IGNORECASE), re.compile("copyright", re.IGNORECASE)
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["n_hits"], r["context"]) for r in rows(spark, sf_dir, "p06_clinical_text_windows")}
    for i, t in text.items():
        spans = [(max(0, m.start() - 60), min(len(t), m.end() + 120)) for m in term.finditer(t)]
        good = [t[a:b] for a, b in spans if not skip.search(t[a:b])][:8]
        assert got[i] == (len(spans), "\n".join(good)[:12_000])
    assert any(n for n, _ in got.values()) and len(got) == len(text)


def test_f18_envelope_has_its_sources(spark, sf_dir):
    leads = defaultdict(set)
    for r in spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber").collect():
        leads[r.l_orderkey].add(r.l_linenumber)
    got = rows(spark, sf_dir, "f18_measurement_envelope")
    assert {r["record_id"]: r["n_sources"] for r in got} == {k: len(v) for k, v in leads.items()}
    assert {r["state"] for r in got} <= {"HIGH_CONFIDENCE", "WITH_UNCERTAINTY", "REMEASURE", "UNMEASURABLE"}


def test_m01_learns_the_labels(spark, sf_dir):
    ids = {r.vec_id for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id").collect()}
    got = rows(spark, sf_dir, "m01_balanced_softmax_fit")
    assert {r["vec_id"] for r in got} == ids and sum(r["label"] == r["predicted"] for r in got) > 0.25 * len(got)  # chance is a tenth


def test_t02_predicts_from_earlier_batches_only(spark, sf_dir):
    table = {r.vec_id: (r.label, np.array(r.embedding, float)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    got = rows(spark, sf_dir, "t02_evaluate_before_learn_stream")
    assert len(got) == len(table) and {r["version"] for r in got} >= set(range(-1, 5))
    for r in got:
        if r["version"] < 0:
            assert r["predicted"] is None
            continue
        seen = [table[x["vec_id"]] for x in got if x["version"] + 1 <= r["version"]]
        centre = {k: np.mean([v for y, v in seen if y == k], axis=0) for k in {y for y, _ in seen}}
        own = table[r["vec_id"]][1]
        near = {k: float(((own - c) ** 2).sum()) for k, c in centre.items()}
        assert near[r["predicted"]] <= min(near.values()) + 1e-9


def test_p01_folds_any_script(spark, sf_dir):
    import hashlib
    import unicodedata

    from pyspark.sql import functions as F

    from cohortlens.functions import text as X

    def fold(t):
        return " ".join("".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).casefold().split())

    texts = ["Ñandú  ÀÉ", "Ελληνικά ΆΣΣ ς", "Ёлка ЙОД", "Tiếng Việt Đường", "ﬁne ﬂow ½ ª Ⅷ", "Straße İ", "ｆｕｌｌ width", "한글", "e\u0301 cafe\u0301", " \t\n", "", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r.k: r.f for r in df.select("k", X.fold_unicode(F.col("t")).alias("f")).collect()}
    assert got == {k: None if t is None else fold(t) for k, t in enumerate(texts)}
    pairs = [("ΆΝΑ", "ανα", True), ("Ёлка", "елка", True), ("Việt", "viet", True), ("a", "b", False), ("STRASSE", "straße", True)]
    both = spark.createDataFrame([p[:2] for p in pairs], "a string, b string").select(X.same_text(F.col("a"), F.col("b")).alias("same"), X.holds_text(F.concat(F.lit("x "), "a"), F.col("b")).alias("holds"))
    assert [r.same for r in both.collect()] == [p[2] for p in pairs] and [r.holds for r in both.collect()][:4] == [p[2] for p in pairs][:4]
    want = {r.doc_id: fold(r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if r.text is not None}
    found = {r["doc_id"]: (r["n"], r["digest"]) for r in rows(spark, sf_dir, "p01_fold_unicode") if r["n"] is not None}
    assert found == {i: (len(t), hashlib.md5(t.encode()).hexdigest()) for i, t in want.items()}
