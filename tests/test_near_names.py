"""Near names on large sides against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from cohortlens.functions.text import similarity, token_set_ratio
from cohortlens.operators import link, near_names


def typo(rng, name):
    k = rng.randrange(len(name))
    return rng.choice([name[:k] + name[k + 1 :], name[:k] + rng.choice("aeiourstln") + name[k:], name[:k] + rng.choice("aeiourstln") + name[k + 1 :]])


def table(spark, names):
    return spark.createDataFrame([(n,) for n in names], "name string")


def test_top_five_of_names_that_all_share_a_token(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(rng.randrange(4, 7)))
    base = [f"{word()} {word()} tablets" for _ in range(150)]
    # Each name has six near ones, with a typo in any word but the hot one.
    other = [" ".join([*(typo(rng, w) if rng.random() < 0.8 else w for w in n.split()[:2]), "tablets"]) for n in base for _ in range(6)]
    left, right = table(spark, base), table(spark, sorted({*other} - {*base}))
    pairs = link.name_pairs(left, right, most_pairs=1000)
    every = left.select("name").crossJoin(right.select(F.col("name").alias("candidate"))).withColumn("score", similarity(F.col("name"), F.col("candidate")))
    best = {}
    for r in every.collect():
        best.setdefault(r.name, []).append((-r.score, r.candidate))
    best = {(n, c) for n, x in best.items() for _, c in sorted(x)[:5]}
    found = {tuple(r) for r in pairs.collect()}
    assert len(best & found) / len(best) >= 0.95
    assert len(found) < 0.1 * len(base) * right.count()
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {tuple(r) for r in link.name_pairs(left, right).collect()} >= found  # no hot token: all that share one


@pytest.mark.parametrize("least", [50.0, 64.0, 80.0, 95.0])
def test_rare_grams_lose_no_pair(spark, least):
    rng = random.Random(int(least))
    names = {"".join(rng.choice("ab c") for _ in range(rng.randrange(0, 9))) for _ in range(150)}
    names |= {typo(rng, n) for n in [*names] if n} | {"aaaaaaaaaaaa", "aaaaaaaaaa", "aaaaaaa", "", "é中b", "é中c"}
    a, b = table(spark, sorted(names)), table(spark, sorted(names)[::2] + [None, "aa", "aa"])
    got = {tuple(r) for r in near_names.similar_pairs(a, b, least).filter(similarity(F.col("name"), F.col("candidate")) >= least).collect()}
    every = a.crossJoin(b.filter("name is not null").distinct().select(F.col("name").alias("candidate"))).filter(similarity(F.col("name"), F.col("candidate")) >= least)
    want = {tuple(r) for r in every.collect()}
    assert got == want and len(want) > 50


def test_many_queries_find_what_few_do(spark):
    rng = random.Random(6)
    names = [f"{rng.choice(['red', 'blue', 'warm'])} {rng.choice(['bolt', 'gear', 'widget', 'ring'])}{k % 40}" for k in range(200)]
    rows = spark.createDataFrame([(n, n.split()[0] + "ish") for n in names], "name string, class string")
    queries = spark.createDataFrame([(typo(rng, rng.choice(names)),) for _ in range(30)] + [("red",), ("zzz",)], "query string").distinct()
    few, many = (link.literal_then_fuzzy(queries, rows, ["name"], ["name", "class"], most_queries=n) for n in (1000, 0))
    want = sorted(map(tuple, few.collect()))
    assert sorted(map(tuple, many.collect())) == want and any(how == "fuzzy" for *_, how in want)
    with pytest.raises(ValueError):
        near_names.similar_pairs(rows, rows, 40.0)


def shuffled_rows(spark, work):
    """Rows that the stages of work() write to shuffles."""
    jvm = spark.sparkContext._jvm

    def rows():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteRecords() for k in range(stages.size())}

    before = rows()
    work()
    return sum(n for stage, n in rows().items() if stage not in before)


def test_component_lists_meet_as_all_pairs_do(spark):
    rng = random.Random(8)
    words = ["acid folic", "folic acid", "acid folicc", "zinc", "zincs", "iron salt", "salt iron", "magnesium chloride", "magnesium chlorides", "potassium"]
    some = lambda k: [rng.choice(words) for _ in range(k)]
    cat = [(k, sorted(set(some(rng.randrange(0, 4))))) for k in range(80)] + [(80, ["zinc", "zinc"]), (81, None), (82, ["zinc", None]), (83, ["zinc"]), (83, ["zinc"])]
    src = [(k, some(rng.randrange(0, 5))) for k in range(80)] + [(80, ["zinc", "zinc"]), (81, None), (82, ["zinc", None]), (83, ["zinc"]), (83, ["zinc"])]
    got = link.component_identity(spark.createDataFrame(cat, "med_id int, parts array<string>"), spark.createDataFrame(src, "source_id int, ingredients array<string>"))
    pairs = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    alike = {(r.a, r.b) for r in pairs.filter(token_set_ratio(F.col("a"), F.col("b")) >= 92).collect() if r.a == r.b or set(r.a.split()) & set(r.b.split())}
    fits = lambda parts, held: len(set(parts)) == len(parts) > 0 and all(any((p, x) in alike for x in held) for p in parts) and (len(parts) > 1 or len(held) == 1)
    want = sorted({(m, s) for m, p in cat if p for s, h in src if h and fits(p, h)})
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100


def test_component_lists_meet_once_and_by_their_rarest_part(spark):
    n = 1000
    cat = spark.range(20 * n).select(F.col("id").alias("med_id"), F.array(F.lit("common"), F.concat(F.lit("own"), F.col("id") % n)).alias("parts"))
    src = spark.range(n).select(F.col("id").alias("source_id"), F.array(F.lit("common"), F.concat(F.lit("own"), F.col("id")), F.lit("extra")).alias("ingredients"))
    found = []
    moved = shuffled_rows(spark, lambda: found.append(link.component_identity(cat, src).collect()))
    assert {tuple(r) for r in found[0]} == {(k, k % n) for k in range(20 * n)} and len(found[0]) == 20 * n
    assert moved < 5 * 20 * n
