import random
import time
from collections import defaultdict
from pathlib import Path

import numpy as np

from cohortlens.llm import dealing, gray, shingle_join, similar, simhash

SCHEMA = "doc_id bigint, text string"


def sets_of(rows):
    return {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in rows for w in [t.lower().split()]}


def plain_components(rows, similarity=0.8):
    sets = sets_of(rows)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def words(rng, n):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def cut_pairs(rng, many, sizes=(50, 90, 145)):
    """Pairs of texts of which the second lacks words at the end and has some others: 0.70 to 0.90 alike."""
    rows = []
    for k in range(many):
        own = words(rng, rng.choice(sizes))
        new = rng.randint(len(own) // 20, len(own) // 6)
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(own[: len(own) - new] + words(rng, rng.randint(0, new))))]
    return rows


def test_short_texts_are_judged_on_whole_sets(spark):
    rows = cut_pairs(random.Random(11), 150)
    sets = sets_of(rows)
    got = dict(simhash.similar_documents(spark.createDataFrame(rows, SCHEMA)).collect())
    alike = [len(sets[2 * k] & sets[2 * k + 1]) / len(sets[2 * k] | sets[2 * k + 1]) for k in range(150)]
    joined = [got[2 * k] == got[2 * k + 1] for k in range(150)]
    assert sum(0.7 < a < 0.8 for a in alike) > 20 and sum(0.8 <= a < 0.9 for a in alike) > 20
    assert not [a for a, j in zip(alike, joined, strict=True) if j and a < 0.8]
    assert not [a for a, j in zip(alike, joined, strict=True) if not j and a >= 0.8]


def test_a_bridging_text_costs_no_true_link(spark):
    """A and C are alike; B, nearer to both by fingerprint, is like neither."""
    rng = random.Random(13)
    rows, k = [], 0
    while len(rows) < 24:
        base = words(rng, 60)
        a, c = " ".join(base), " ".join(base[:54] + words(rng, 5))
        mix = [" ".join(rng.choice([base, base[:54] + words(rng, 6)])[: rng.randint(44, 60)] + words(rng, 9)) for _ in range(40)]
        p, r = simhash.fingerprint(a, 5), simhash.fingerprint(c, 5)
        bits = (p ^ r).bit_count()
        own = sets_of(enumerate([a, c, *mix]))
        alike = lambda i, j: len(own[i] & own[j]) / len(own[i] | own[j])  # noqa: B023, E731
        near = [m for n, m in enumerate(mix) if max((simhash.fingerprint(m, 5) ^ x).bit_count() for x in (p, r)) < bits and max(alike(0, n + 2), alike(1, n + 2)) < 0.77]
        if 3 < bits <= 14 and alike(0, 1) >= 0.8 and near:
            rows += [(k, a), (k + 1, c), (k + 2, near[0])]
            k += 3
    assert dict(simhash.similar_documents(spark.createDataFrame(rows, SCHEMA)).collect()) == plain_components(rows)


def test_all_pairs_are_found_in_large_buckets(spark, monkeypatch):
    rng = random.Random(12)
    shared, rows = words(rng, 40), []
    for family in range(12):
        base = words(rng, 110)
        for c in range(12):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = words(rng, 1)[0]
            rows.append((family * 100 + c, " ".join(shared + own if family % 2 else own)))
    for chunk, common, most in ((65_536, 200_000, 1 << 16), (4, 0, 10)):
        monkeypatch.setattr(shingle_join, "CHUNK_ROWS", chunk)
        monkeypatch.setattr(shingle_join, "PAIRS_AT_ONCE", 7 if chunk == 4 else 250_000)
        monkeypatch.setattr(gray, "PAIRS_AT_ONCE", 7 if chunk == 4 else 250_000)
        monkeypatch.setattr(shingle_join, "COMMON_HASHES", common)
        assert dict(simhash.similar_documents(spark.createDataFrame(rows, SCHEMA), most_rows=most).collect()) == plain_components(rows)


def test_a_family_that_is_not_alike_makes_few_pairs(spark, monkeypatch):
    """Texts with a sixth of their words of their own are near by fingerprint and not alike: prefixes rule them out."""
    rng = random.Random(14)
    base, seen = words(rng, 120), []
    rows = [(k, " ".join(base[: 120 - n] + words(rng, n))) for k, n in enumerate([rng.choice((2, 3, 16)) for _ in range(300)])]
    plain = shingle_join.confirmed
    monkeypatch.setattr(shingle_join, "confirmed", lambda pairs, *a: (seen.append(pairs.count()), plain(pairs, *a))[1])
    assert dict(simhash.similar_documents(spark.createDataFrame(rows, SCHEMA)).collect()) == plain_components(rows)
    assert sum(seen) < 3000


def test_every_two_of_other_labels_meet_in_one_cell(spark):
    rng = random.Random(15)
    rows = [(k, n, 0 if rng.random() < 0.7 else n) for k, many in ((1, 90), (2, 5), (3, 33)) for n in range(many)]
    got = dealing.dealt(spark.createDataFrame(rows, "key bigint, node bigint, label bigint"), 10).collect()
    cells = defaultdict(list)
    for r in got:
        cells[r.key, r.cell, r.other].append(r)
    met = {(r.key, min(r.node, s.node), max(r.node, s.node)) for own in cells.values() for r in own for s in own if r.node != s.node and (r.side != s.side or r.side == 2)}
    assert {(k, i, j) for k, i, a in rows for m, j, b in rows if k == m and i < j and a != b} <= met
    assert max(map(len, cells.values())) < 33
    assert {(r.key, r.node) for r in dealing.salted(spark.createDataFrame(rows, "key bigint, node bigint, label bigint"), 10).collect()} == {(k, n) for k, n, _ in rows}


def test_samples_of_bits_hold_recall_at_every_size():
    rng = np.random.default_rng(16)
    p = np.arccos(1.6 / 1.8) / np.pi
    for rows in (1_000, 10**6, 10**8):
        samples = np.zeros((len(similar.bit_samples(rows, 0.8)), similar.BITS), bool)
        for k, bits in enumerate(similar.bit_samples(rows, 0.8)):
            samples[k, bits] = True
        apart = rng.random((4000, similar.BITS)) < p
        found = ((apart.astype(np.int32) @ samples.T) == 0).any(axis=1) & (apart.sum(axis=1) <= similar.radius_of(0.8))
        assert found.mean() > 0.95


def test_recall_on_texts_of_all_lengths(spark):
    """Pairs just over 0.8, by words changed here and there or by a stretch."""
    rng = random.Random(17)
    rows = []
    for k in range(200):
        own = words(rng, rng.choice((50, 120, 400, 2000)))
        other = list(own)
        n = int(len(own) * rng.uniform(0.05, 0.105))
        if k % 2:
            a = rng.randrange(len(own) - n)
            other[a : a + n] = words(rng, n)
        else:
            for a in rng.sample(range(len(own)), max(1, n // 5)):
                other[a] = words(rng, 1)[0]
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(other))]
    sets = sets_of(rows)
    want = [k for k in range(200) if len(sets[2 * k] & sets[2 * k + 1]) >= 0.8 * len(sets[2 * k] | sets[2 * k + 1])]
    got = dict(simhash.similar_documents(spark.createDataFrame(rows, SCHEMA)).collect())
    assert len(want) > 150 and sum(got[2 * k] == got[2 * k + 1] for k in want) >= 0.97 * len(want)


def test_repeated_ids_and_texts_without_words(spark):
    one, two = "a b c d e f g h", "other words of the same id"
    rows = [(4, one), (4, two), (9, one), (3, two), (7, None), (8, " "), (None, one), (5, "short"), (6, "Short")]
    got = simhash.similar_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in got) == [(-1, None), (3, 3), (4, 3), (4, 3), (5, 5), (6, 5), (7, 7), (8, 7), (9, 3)]
    assert simhash.similar_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rows_of_a_document_are_bounded_at_every_size(spark, monkeypatch):
    """Beyond MOST_SAMPLES all sets go through the exact join, whatever the few samples found."""
    assert [min(similar.MOST_SAMPLES, len(similar.bit_samples(n, 0.8))) for n in (1_000, 10**6, 10**9, 5 * 10**10)][1:] == [similar.MOST_SAMPLES] * 3
    rng = random.Random(29)
    rows = cut_pairs(rng, 60) + [(1000 + k, " ".join(words(rng, 4))) for k in range(20)] + [(2000, ""), (2001, ""), (2002, rng.choice("ab") * 3)]
    rows += [(3000 + k, rows[0][1]) for k in range(5)]
    monkeypatch.setattr(similar, "MOST_SAMPLES", 1)
    docs = spark.createDataFrame([*rows, (None, rows[0][1])], SCHEMA)
    got = simhash.similar_documents(docs).collect()
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == plain_components(rows)
    assert simhash.similar_documents(docs.limit(0)).count() == 0


def test_all_sets_meet_without_being_written(spark, monkeypatch):
    """Where all sets go through the exact join, prefixes are written and whole sets of what met only; shuffle files go."""
    rng, seen, found = random.Random(31), [], []
    rows = [(k, " ".join(words(rng, 400))) for k in range(500)] + [(k + 1000, t) for k, t in cut_pairs(rng, 20)]
    # Long texts that share a tenth of their words meet by prefix; their bitmaps of fixed size are full.
    shared = words(rng, 400)
    rows += [(2000 + k, " ".join(shared + words(rng, 3600))) for k in range(8)]
    base = words(rng, 4000)
    rows += [(3000 + k, " ".join(base[: 4000 - 150 * k] + words(rng, 150 * k))) for k in range(4)]
    monkeypatch.setattr(similar, "MOST_SAMPLES", 1)
    plain, joined = similar.written, similar.confirmed
    for module in (similar, shingle_join, dealing):
        monkeypatch.setattr(module, "written", lambda df, name, *a: (out := plain(df, name, *a), seen.append((name, [(f, Path(f.removeprefix("file://")).stat().st_size) for f in out.inputFiles()])))[0])
    monkeypatch.setattr(similar, "confirmed", lambda pairs, *a: (found.append(pairs.count()), joined(pairs, *a))[1])
    jvm = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {p.name for d in jvm.localDirs() for p in Path(str(d)).rglob("shuffle_*.data")}
    before = shuffled()
    got = dict(simhash.similar_documents(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == plain_components(rows)
    size = sum(n for _, files in seen for _, n in files)
    stay = {name for name, files in seen for f, _ in files if Path(f.removeprefix("file://")).exists()}
    assert not stay & {"prints", "buckets", "sets", "prefixes", "shared", "met"}
    assert size < 0.75 * sum(len(t) for _, t in rows)
    assert found[-1] < 30
    for _ in range(50):
        if len(left := shuffled() - before) <= 2:  # of the last, lazy part
            break
        time.sleep(0.2)
    assert len(left) <= 12


def test_wide_bitmaps_rule_out_no_alike_sets():
    rng = np.random.default_rng(32)
    for n in (0, 1, 32, 33, 256, 257, 5000):
        own = rng.integers(0, 1 << 63, n).astype(np.uint64)
        for new in (0, n // 9, n // 2):
            other = np.concatenate([own[new:], rng.integers(0, 1 << 63, new // 3).astype(np.uint64)])
            apart, least = len(np.setxor1d(own, other)), shingle_join.bits_apart(shingle_join.wide_bitmap(own), shingle_join.wide_bitmap(other))
            assert least <= apart and least >= apart - 0.8 * apart
        assert len(shingle_join.wide_bitmap(own)) * 8 >= max(512, 2 * n)


def test_prefixes_that_turn_out_not_to_be_needed(spark, monkeypatch):
    """Rows ask for more than MOST_SAMPLES, different sets do not."""
    rows = cut_pairs(random.Random(33), 30)
    monkeypatch.setattr(similar, "_needs_all", lambda n, similarity: n > 70)
    assert dict(simhash.similar_documents(spark.createDataFrame(rows + [(100 + k, rows[0][1]) for k in range(20)], SCHEMA)).collect()) == plain_components(rows + [(100 + k, rows[0][1]) for k in range(20)])
