"""Line dedup against a plain count of keys."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from cohortlens.llm import lines, queries

SCHEMA = "doc_id bigint, text string"


def plain(rows, least, keep_first=False):
    def key(line):
        return re.sub(r"[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\v\f\r"))

    split = [(i, (t or "").split("\n")) for i, t in rows]
    count = Counter(k for _, own in split for k in {key(x) for x in own})
    first = {}
    for i, own in split:
        for place, x in enumerate(own):
            at = (i is not None, i or 0, place)
            first[key(x)] = min(first.get(key(x), at), at)
    out = []
    for i, own in split:
        kept = [x for p, x in enumerate(own) if not key(x) or count[key(x)] < least or keep_first and first[key(x)] == (i is not None, i or 0, p)]
        out.append((i, len(own), len(own) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def rows():
    rng = random.Random(3)
    common = ["Share this", "  share THIS\t", "ÄRGER", "ärger", "All rights reserved.", " x", "x", "İ", "once more", "\vonce more\f"]
    out = [(k, "\n".join(rng.choice(common) if rng.random() < 0.5 else f"line {rng.randrange(300)}" for _ in range(rng.randrange(1, 30)))) for k in range(200)]
    out += [(None, None), (500, ""), (501, "\n"), (502, "\n\n \n"), (503, "x\r\nx\r"), (7, out[7][1]), (7, out[7][1]), (None, "Share this"), (504, "y" * 3_000_000 + "\n" + "ab\n" * 100_000)]
    return out


@pytest.mark.parametrize(("least", "keep_first", "bits", "sent"), [(10, False, lines.MOST_BITS, lines.SENT), (2, True, 1 << 9, lines.SENT), (2, False, 1 << 12, 0), (3, True, lines.MOST_BITS, 0)])
def test_like_the_plain_count(spark, least, keep_first, bits, sent):
    docs = spark.createDataFrame([(*r, "extra") for r in rows()], SCHEMA + ", kept string").repartition(7)
    got = sorted((tuple(r) for r in lines.dedup_lines(docs, least, keep_first, bits, sent).collect()), key=str)
    assert got == plain(rows(), least, keep_first)


def test_nothing_there(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert lines.dedup_lines(empty).collect() == []
    only = spark.createDataFrame([(1, None)] * 12, SCHEMA)
    assert [tuple(r) for r in lines.dedup_lines(only).collect()] == [(1, 1, 0, "")] * 12
    with pytest.raises(ValueError):
        lines.dedup_lines(empty, min_documents=1)


def test_few_lines_that_stand_once_are_suspected(spark):
    docs = spark.createDataFrame([(k, f"only {k}\nboth {k // 2}") for k in range(20_000)], SCHEMA).repartition(5)
    twice = lines.twice_filter(docs)
    import xxhash

    def share(keys):
        return lines.suspected(np.array([xxhash.xxh3_64_intdigest(k.encode()) for k in keys], np.uint64), twice).mean()

    assert share(f"both {k}" for k in range(10_000)) == 1
    assert share(f"only {k}" for k in range(20_000)) < 0.05


def test_query_matches_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = queries.QUERIES["op13_line_dedup"](spark, sf_dir)
    want = con.execute(queries.ORACLE_SQL["op13_line_dedup"])
    names = [c[0] for c in want.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())
    assert got.filter("n_dropped = n_lines").filter(f"kept_sha256 <> '{hashlib.sha256(b'').hexdigest()}'").count() == 0
    assert got.agg({"n_dropped": "sum"}).first()[0] > 0
