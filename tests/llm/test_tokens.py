import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortlens.llm import tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
PLAIN = Tokenizer.from_file(PATH)


def expected(rows):
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*PLAIN.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aZé ÉßŸİŉµªº²½×÷'sStdll'RE0 9\t\n \u0085́Σσ<|>endoftext.!*#$")), max_size=5))
def test_words_give_the_tokenizers_ids(texts):
    got = tokens.Encoder(PATH, True).encode(texts)
    assert [x.tolist() for x in got] == [PLAIN.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=40))
def test_coding_round_trip(numbers):
    x = np.array(numbers, np.uint32)
    assert tokens.unpacked(*tokens.packed(x), len(x)).tolist() == numbers


def test_edge_rows(spark):
    rows = [(3, None), (1, ""), (None, "null id"), (9, "<|endoftext|> The Quick'S brown"), (7, "words " * 3000), (2, "Ünïcödé 中文 text́")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit("x"))
    got = sorted((tuple(r) for r in tokens.token_output(df, PATH).collect()), key=lambda r: r[1])
    assert got == expected(rows)
    assert tokens.token_output(df.limit(0), PATH).count() == 0
    twice = tokens.token_output(df.unionByName(df), PATH).collect()
    assert len(twice) == 12 and len({r.start for r in twice}) == 12


def test_small_shards(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randint(0, 30)))) for i in range(50)]
    shards, id_of = tokens.write_shards(spark.createDataFrame(rows, "doc_id bigint, text string"), PATH, True, shard_ids=40)
    assert shards.count() > 15 and shards.filter("before > 0").count() > 10
    assert sorted((tuple(r) for r in tokens.read_shards(shards, shards, id_of).collect()), key=lambda r: r[1]) == expected(rows)
    with pytest.raises(ValueError):
        tokens.read_shard(b"x" * 60, id_of)


def test_words_of_plain_texts():
    pattern = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ſ]+|[0-9²³¹¼½¾]|[^\t\n\r a-zªµºß-öø-ſ0-9²³¹¼½¾]+")
    rng = random.Random(5)
    for _ in range(2000):
        low = "".join(rng.choice("aabdelrstvm''''.,\"! \n019é½ſßx-") for _ in range(rng.randint(1, 40)))
        first, size, _, units, _ = tokens.words_in(low)
        assert units.tobytes().decode("utf-16-le") == "".join(pattern.findall(low))
        assert [low[a : a + n] for a, n in zip(first.tolist(), size.tolist(), strict=True)] == pattern.findall(low)


def halves(doublings):
    """Two words of 2 ** doublings letters whose polynomial hashes are equal whatever the factor: each half is the other one's complement."""
    a, b = "a", "b"
    for _ in range(doublings):
        a, b = a + b, b + a
    return a, b


def test_words_with_equal_hashes_have_their_own_ids():
    pairs = [halves(k) for k in (10, 11, 12)]
    for a, b in pairs:
        _, _, hashes, _, _ = tokens.words_in(f"{a} {b}")
        assert hashes[0] == hashes[1]
    texts = [" ".join([a, b, "plain", b, a]) for a, b in pairs]
    texts += [b for _, b in pairs] + [texts[0] + " " + texts[2], "plain words"]
    encoder = tokens.Encoder(PATH, True)
    for part in ([texts[0]], texts[1:4], texts[4:], texts):
        assert [x.tolist() for x in encoder.encode(part)] == [PLAIN.encode(t, add_special_tokens=False).ids for t in part]
    assert len(encoder.others) == 3


def test_any_words_with_equal_hashes(monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(tokens, "mixed", lambda x: x % np.uint64(5))
    encoder = tokens.Encoder(PATH, True)
    for _ in range(40):
        texts = [" ".join("".join(rng.choice("abcé1!'s") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 30))) for _ in range(3)]
        assert [x.tolist() for x in encoder.encode(texts)] == [PLAIN.encode(t, add_special_tokens=False).ids for t in texts]


def test_numbers_of_hashes():
    rng = np.random.default_rng(6)
    own, held = tokens.Numbers(4), {}
    for _ in range(30):
        x = rng.integers(0, 1 << 9, 60).astype(np.uint64) << np.uint64(55)
        got = own.find(x)
        assert got.tolist() == [held.get(v, -1) for v in x.tolist()]
        new = np.unique(x[got < 0])
        own.add(new)
        held |= {v: len(held) + k for k, v in enumerate(new.tolist())}


def test_long_texts_and_forgotten_words(monkeypatch):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7)))
    texts = [" ".join(word() for _ in range(n)) for n in (200_000, 5, 3000, 1)]
    encoder = tokens.Encoder(PATH, True)
    monkeypatch.setattr(tokens, "MEMO_WORDS", 100)
    for t in texts:
        assert encoder.encode([t])[0].tolist() == PLAIN.encode(t, add_special_tokens=False).ids


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted((tuple(r) for r in tokens.token_output(docs, PATH).collect()), key=lambda r: r[1])
    assert got == expected([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_the_query_reads_its_files(spark, tmp_path):
    rows = [(i, f"some words {i % 7} more") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    folder = f"file://{tmp_path}/shards"
    got = tokens.token_output(df, PATH, shard_ids=100, folder=folder)
    files = [f for f in (tmp_path / "shards").iterdir() if f.suffix == ".frvb"]
    assert len(files) > 5 and all(f.read_bytes()[:8] == tokens.MAGIC for f in files)
    # What an attempt that was lost left behind is not read; a file that is gone is missed.
    (tmp_path / "shards" / "part-00000-lost-00000.frvb").write_bytes(files[0].read_bytes())
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[1]) == expected(rows)
