import hashlib
import random

import pytest
import zstandard
from pyspark.sql import functions as F

from cohortlens.llm import warc


def test_archive_is_plain_zstandard_frames():
    rng = random.Random(1)
    records = [warc.record_bytes(i, f"http://a/{i}", (" ".join(rng.choice(["<p>", "alpha", "beta", "é"]) for _ in range(200))).encode(), False, None) for i in range(60)]
    data = warc.archive_bytes(records)
    assert data[:4] == bytes.fromhex("5d2a4d18") and len(data) < sum(map(len, records)) / 2
    assert list(warc.read_archive(data)) == records
    size = int.from_bytes(data[4:8], "little")
    assert size > 0 and zstandard.ZstdCompressionDict(data[8 : 8 + size]).dict_id()
    with pytest.raises(ValueError):
        list(warc.read_archive(data[:-3]))


def test_few_records_need_no_dictionary():
    one = warc.record_bytes(None, None, b"", False, None)
    assert list(warc.read_archive(warc.archive_bytes([one]))) == [one]
    fields, payload = warc.parse_record(one)
    assert warc.page_of(fields["WARC-Record-ID"]) is None and payload == b""


def test_edge_rows(spark):
    long = "x" * 996 + "é\n\r\n\r\n"
    rows = [(1, "u", long), (4, None, long), (9, "u\r\nX: y", long), (9, "again", long), (2, "u", None), (3, "u", ""), (None, "u", long), (5, "u", "y" * 999), (6, "u", "y" * 999), (7, "u", "z" * 1000), (8, "u", "z" * 1000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit(1)).withColumn("n", F.lit("x"))
    got = sorted(((r.page_id or 0, r.record_type, r.refers_to) for r in warc.archive_round_trip(df).collect()), key=str)
    assert got == sorted([(1, "revisit", 9), (4, "revisit", 9), (9, "response", None), (9, "response", None), (2, "response", None), (3, "response", None), (0, "revisit", 9), (5, "response", None), (6, "response", None), (7, "revisit", 8), (8, "response", None)], key=str)
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = {r.page_id: (len((r.html or "").encode()), hashlib.sha1((r.html or "").encode()).hexdigest()) for r in pages.collect()}
    assert {r.page_id: (r.payload_bytes, r.payload_digest) for r in warc.archive_round_trip(pages).collect()} == want


def test_several_archives_large_payloads_and_files(spark, monkeypatch, tmp_path):
    rng = random.Random(2)
    big = "".join(rng.choice("abcdefghij <>p") for _ in range(3 << 20))
    rows = [(k, f"http://a/{k}", big if k % 3 == 0 else "small page %d " % k * 90_000) for k in range(12)]
    archives = warc.write_archives(spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1))
    archives = warc.written(archives, "test")
    assert archives.count() > 1
    got = {r.page_id: (r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(archives).collect()}
    assert got == {i: (hashlib.sha1(t.encode()).hexdigest(), "revisit" if i in (0, 3, 6) else "response", 9 if i in (0, 3, 6) else None) for i, _, t in rows}
    files = warc.save_archives(archives, f"file://{tmp_path}/out").collect()
    assert len(files) == archives.count() and all(f.path.endswith(".warc.zst") for f in files)
    records = [r for f in files for r in warc.read_archive(open(f.path, "rb").read())]
    assert sorted(warc.page_of(warc.parse_record(r)[0]["WARC-Record-ID"]) for r in records) == list(range(12))


def test_revisits_by_join_as_by_broadcast(spark, monkeypatch):
    rows = [(k % 7 if k % 5 else None, "u", "p" * (1000 + k % 3)) for k in range(40)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    sent = sorted(map(str, warc.archive_round_trip(df).collect()))
    monkeypatch.setattr(warc, "sent_if_small", lambda x: x)
    assert sorted(map(str, warc.archive_round_trip(df).collect())) == sent and len(sent) == 40
