"""Evidence steps against plain Python on odd rows, and how often they read their input."""

import random

from cohortlens import catalogue
from cohortlens.operators import evidence

CODES, DOMAINS = ["VT", "AF", "SVT", "BBB", None], ["RHYTHM", "BUNDLE_BRANCH", "AV", None]


def rows_read(spark, work):
    """Rows that the stages of work() read from files."""
    jvm = spark.sparkContext._jvm

    def rows():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {stages.apply(k).stageId(): stages.apply(k).inputRecords() for k in range(stages.size())}

    before = rows()
    work()
    return sum(n for stage, n in rows().items() if stage not in before)


def test_final_findings_of_odd_rows(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(40), rng.choice(DOMAINS), rng.choice(CODES), rng.choice([None, 0.1, 0.5, 0.9]), rng.choice(["PROBABLE", "DOMAIN_ABSTENTION", "CANDIDATE_REVIEW"])) for _ in range(300)] + [(50, "RHYTHM", None, 0.5, "PROBABLE")]
    fused = [(*r, r[4] == "PROBABLE") for r in rows]
    got = {r.record_id: tuple(r)[1:] for r in evidence.final_findings(spark.createDataFrame(fused, "record_id int, domain string, code string, score double, state string, publishable boolean"), ["VT", "AF"]).collect()}
    order = {"VT": 2, "AF": 1}
    want = {}
    for k in {r[0] for r in fused}:
        own = [r for r in fused if r[0] == k]
        rhythm = [(order.get(r[2], 0), -1.0 if r[3] is None else r[3], r[2] or "") for r in own if r[5] and r[1] == "RHYTHM"]
        first = max(rhythm)[2] if rhythm else ""
        line = lambda xs: ",".join(sorted({x for x in xs if x is not None}))
        rest = line(c for *_, c in rhythm if c and c != first) if first else ""
        want[k] = (first, rest, line(r[2] for r in own if r[5] and r[1] not in (None, "RHYTHM")), line(r[1] for r in own if r[4] == "DOMAIN_ABSTENTION"))
    assert got == want and len({w[1] for w in want.values()}) > 2


def test_gates_of_odd_rows(spark):
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    conflicts = table([(1, "A", "BLOCKING"), (1, "A", "BLOCKING"), (1, "B", "BLOCKING"), (1, "C", "WARNING"), (2, "Z", "BLOCKING"), (9, "A", "BLOCKING")], "record_id int, code string, severity string")
    unusable = table([(2, "q"), (2, "q"), (2, "p"), (3, "q"), (9, "q")], "record_id int, measure string")
    maps = table([("A", "R"), ("B", "R"), ("B", "elsewhere"), ("C", "R")], "code string, domain string"), table([("q", "R"), ("p", "R"), ("q", "S")], "measure string, domain string")
    rescues = table([(3, "S", "q")], "record_id int, domain string, measure string")
    got = evidence.domain_gates(table([(1,), (2,), (3,), (3,)], "record_id int"), conflicts, unusable, *maps, rescues, ["R", "S"])
    want = {(1, "R", 2, 0, False), (1, "S", 0, 0, True), (2, "R", 0, 2, False), (2, "S", 0, 1, False), (3, "R", 0, 1, False), (3, "S", 0, 0, True)}
    found = [tuple(r) for r in got.select("record_id", "domain", "n_conflicts", "n_unusable", "eligible").collect()]
    assert set(found) == want and len(found) == len(want)


def test_final_findings_read_lineitem_once(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    read = rows_read(spark, lambda: catalogue.QUERIES["r05_final_findings"](spark, sf_dir).collect())
    assert n <= read < 3 * n
