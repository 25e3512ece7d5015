"""Label files read element by element."""

import io
import json
import random
import subprocess
import sys

import pytest

from cohortlens.sources import labels, readers

FIELDS = ["pregnancy", "warnings"]


def document(rng, k):
    out = {"id": f"ID{k}", "effective_time": "2024", "openfda": {"generic_name": ["a", "b"], "nested": {"results": [1, 2]}}}
    if k % 3:
        out["pregnancy"] = [f"Text é 中 \\ \" {rng.random()} ] }}", None, 5][: rng.randrange(1, 4)]
    if k % 5 == 0:
        out["warnings"] = rng.choice(["one text", 7, {"a": [1]}, ""])
    return out


def rows_of(docs):
    return [(d["id"], d["effective_time"], *[labels._texts(d.get(f)) for f in FIELDS]) for d in docs if any(d.get(f) is not None for f in FIELDS)]


def listed(batches):
    return [tuple(r.values()) for b in batches for r in b.to_pylist()]


@pytest.mark.parametrize("chunk", [1, 7, 64, 1 << 20])
@pytest.mark.parametrize("indent", [None, 2])
def test_any_cut_of_the_bytes(chunk, indent):
    rng = random.Random(1)
    docs = [document(rng, k) for k in range(30)]
    for whole in ({"meta": {"n": [1, {"results": []}]}, "results": docs, "after": 1.5e3}, {"results": docs}, {"results": []}, {"results": None, "x": "y"}, {}):
        data = json.dumps(whole, ensure_ascii=False, indent=indent).encode()
        assert listed(labels.label_batches(io.BytesIO(data), FIELDS, chunk)) == rows_of(whole.get("results") or [])
    data = b"\xef\xbb\xbf" + json.dumps({"results": [1, "x", None, docs[1]]}).encode()
    assert listed(labels.label_batches(io.BytesIO(data), FIELDS, chunk)) == rows_of([docs[1]])


@pytest.mark.parametrize("bad", [b"", b"[]", b'{"results": [', b'{"results": [{"id": 1}', b'{"results": [{"id": 1} {"id": 2}]}', b'{"results": [{"id": 1}]'])
def test_what_is_cut_off_is_an_error(bad):
    with pytest.raises(ValueError):
        list(labels.elements(io.BytesIO(bad)))


def test_files_folders_and_missing_fields(spark, tmp_path):
    rng = random.Random(2)
    docs = [document(rng, k) for k in range(3000)]
    for k in range(3):
        (tmp_path / f"part {k}.json").write_text(json.dumps({"results": docs[1000 * k : 1000 * k + 1000]}))
    got = readers.read_label_documents(spark, str(tmp_path), FIELDS)
    assert got.columns == ["id", "effective_time", *FIELDS] and got.rdd.getNumPartitions() == 3
    assert sorted(map(tuple, got.collect()), key=str) == sorted(rows_of(docs), key=str)
    assert readers.read_label_documents(spark, str(tmp_path), ["no_such"]).count() == 0
    (tmp_path / "part 3.json").write_text('{"results": [{"id": "x", "pregnancy": "y"')
    with pytest.raises(Exception, match="part 3.json"):
        readers.read_label_documents(spark, str(tmp_path), FIELDS).collect()


def test_memory_does_not_follow_the_file(tmp_path):
    one = json.dumps({"id": "x", "pregnancy": ["word " * 4000], "other": "z" * 20_000})
    path = tmp_path / "large.json"
    with path.open("w") as out:
        out.write('{"meta": {}, "results": [' + one)
        for _ in range(6000):
            out.write("," + one)
        out.write("]}")
    code = f"import resource; from cohortlens.sources import labels; n = sum(len(b) for b in labels.label_batches(open({str(path)!r}, 'rb'), ['pregnancy'])); print(n, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)"
    n, mb, _ = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
    assert int(n) == 6001 and path.stat().st_size > 230e6 and int(mb) < 200
