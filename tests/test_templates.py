"""Scores of waves against templates, held to a plain version on ragged, empty and flat waves."""

import math
import random

from cohortlens import catalogue
from cohortlens.operators import events

WINDOWS, SHIFT, LEAST = [(0, 12, 0.12), (8, 12, 0.48), (16, 16, 0.40)], 2, 10
WAVES, TEMPLATES = "record_id bigint, lead string, wave array<double>", "template string, lead string, wave array<double>"


def plain_correlation(a, b, shift):
    pairs = [(a[i], b[i + shift]) for i in range(len(a)) if 0 <= i + shift < len(b)] if a is not None and b is not None else []
    n = min(len(a), len(b)) - abs(shift) if pairs else 0
    pairs = pairs[:n]
    if n < LEAST or any(None in p for p in pairs):
        return None
    x, y = zip(*pairs, strict=True)
    mx, my = math.fsum(x) / n, math.fsum(y) / n
    sx, sy = math.fsum((v - mx) ** 2 for v in x), math.fsum((v - my) ** 2 for v in y)
    return math.fsum((p - mx) * (q - my) for p, q in pairs) / math.sqrt(sx * sy) if n * math.sqrt(sx * sy) > 1e-9 else None


def plain_score(a, b):
    total = weighted = 0.0
    for first, size, weight in WINDOWS:
        cut = lambda w: None if w is None else w[first : first + size]  # noqa: B023, E731
        found = [c for s in range(-SHIFT, SHIFT + 1) if (c := plain_correlation(cut(a), cut(b), s)) is not None]
        if found:
            total, weighted = total + weight, weighted + weight * min(1.0, max(0.0, (max(found) + 1) / 2))
    if not total:
        return None
    p, q = (max(v for v in w if v is not None) - min(v for v in w if v is not None) for w in (a, b))
    mean = weighted / total
    return mean if p <= 1e-6 or q <= 1e-6 else 0.85 * mean + 0.15 * math.exp(-abs(math.log((p + 1e-6) / (q + 1e-6))))


def plain(waves, templates):
    scores, out = {}, {}
    for k, lead, wave in waves:
        for name, other, shape in templates:
            if lead == other and lead is not None:
                scores.setdefault((k, name), []).append(plain_score(wave, shape))
    for (k, name), own in scores.items():
        own, coverage = [s for s in own if s is not None], sum(s is not None for s in own) / sum(t[0] == name for t in templates)
        out[k, name] = (sum(own) / len(own) * (0.7 + 0.3 * coverage) if own else None, coverage)
    return out


def test_template_scores_of_odd_waves(spark, monkeypatch):
    monkeypatch.setattr(events, "MOST_SCORES", 5)
    rng = random.Random(3)
    wave = lambda n: [rng.uniform(-1, 1) for _ in range(n)]
    odd = [None, [], [0.1] * 32, [1.3] * 32, [None] * 32, [0.7] * 20 + wave(12), wave(31) + [None], [None, *wave(31)], wave(9), wave(18), wave(40)]
    waves = [(k, lead, rng.choice(odd) if rng.random() < 0.4 else wave(32)) for k in range(60) for lead in ["I", "II", "V9", None] if rng.random() < 0.8]
    templates = [(name, lead, w) for name in "abc" for lead, w in (("I", wave(32)), ("II", wave(rng.choice([24, 32, 36]))))] + [("flat", "I", [0.1] * 32), ("none", "I", None), ("holes", "II", [None, *wave(31)]), ("a", "V1", wave(32))]
    got = {(r.record_id, r.template): (r.visual, r.coverage) for r in events.template_scores(spark.createDataFrame(waves, WAVES).repartition(3), spark.createDataFrame(templates, TEMPLATES), WINDOWS, SHIFT).collect()}
    want = plain(waves, templates)
    assert got.keys() == want.keys()
    for key, (visual, coverage) in want.items():
        assert got[key][1] == coverage and (got[key][0] is None) == (visual is None) and (visual is None or abs(got[key][0] - visual) < 1e-9), (key, got[key], visual)
    assert sum(v is None for v, _ in want.values()) > 30 and len({c for _, c in want.values()}) > 3


def test_flat_waves_are_like_nothing(spark):
    flat = [(k, "I", [k / 10] * 32) for k in range(1, 40)]
    templates = [("a", "I", [math.sin(k) for k in range(32)])]
    got = events.template_scores(spark.createDataFrame(flat, WAVES), spark.createDataFrame(templates, TEMPLATES), WINDOWS, SHIFT).collect()
    assert len(got) == 39 and {(r.visual, r.coverage) for r in got} == {(None, 0.0)}


def test_waves_meet_their_templates_in_a_small_plan(spark, sf_dir):
    plan = catalogue.QUERIES["e13_template_rank"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and len(plan) < 50_000
