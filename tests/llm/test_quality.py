import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from cohortlens.llm import quality


def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score_quality(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    good, bad = [r for r in held if r.quality == 1], [r for r in held if r.quality == 0]
    print(len(held), np.mean([r.predicted for r in good]), np.mean([r.predicted for r in bad]))
    assert np.mean([r.predicted == 1 for r in good]) > 0.97
    assert np.mean([r.predicted == 0 for r in bad]) > 0.8
    score = sorted((r.score, r.quality) for r in held)
    rank = np.array([k for k, (_, q) in enumerate(score) if q == 1])
    auc = (rank.sum() - len(rank) * (len(rank) - 1) / 2) / (len(rank) * (len(score) - len(rank)))
    assert auc > 0.95


def test_gradients_learn_a_curve():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, quality.DIMENSIONS)).astype(np.float32)
    y = (np.abs(x[:, 0]) > 0.7).astype(float)
    net = quality.Network.fit(x, y, np.arange(600) % 5 == 0)
    assert np.mean((net.probability(x) > 0.5) == y) > 0.8 and 0.25 <= net.temperature <= 8


def test_edge_rows(spark):
    rows = [(i, ("good words in a line " if i % 2 else "BAD!! BAD!! ### ") * 5) for i in range(60)] + [(100, None), (101, ""), (102, " \n"), (None, "x"), (5, "again"), (103, "long " * 30000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("score", F.lit("x")).withColumn("fold", F.lit(1))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (3, None, 0), (999, 1, 0), (4, 7, 0)], "doc_id bigint, quality int, toxic int")
    got = quality.score_quality(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    kept = quality.good_documents(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {1, 3, 7}
    assert quality.score_quality(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}


def test_scores_match_the_plain_form(spark, sf_dir):
    """Each score again, token by token: shapes, repeats, the mean vector, both layers and the temperature."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    words, net = quality.learn(docs, labels)
    got = {r.doc_id: r.score for r in quality.score_quality(docs, labels).collect()}
    for r in docs.collect():
        line = quality.TOKEN.findall(r.text or "")
        seen = []
        for k, t in enumerate(line):
            n = words.number.get(t, words.number.get(quality.shape(t), words.number["<none>"]))
            seen.append(words.vectors[n])
            if words.is_word[n] and t in line[max(0, k - 2) : k]:
                seen.append(words.vectors[words.number["<again>"]])
        x = np.mean(np.array(seen, np.float64), axis=0) if seen else np.zeros(quality.DIMENSIONS)
        hidden = [math.tanh(sum((x[i] - net.mean[i]) / net.scale[i] * net.w1[i, j] for i in range(quality.DIMENSIONS)) + net.b1[j]) for j in range(quality.HIDDEN)]
        logit = sum(h * w for h, w in zip(hidden, net.w2)) + net.b2
        assert abs(got[r.doc_id] - 1 / (1 + math.exp(-logit / net.temperature))) < 1e-4


def test_word_vectors_match_the_plain_form():
    texts = ["one two three two one", "two three 44 55 !!", "one one one"]
    words = quality.WordVectors.learn(texts)
    lines = [[t if t in words.number else quality.shape(t) for t in quality.TOKEN.findall(x)] for x in texts]
    for name in ("one", "two", "three", "<digits>", "<sign2>"):
        context = np.zeros(quality.DIMENSIONS)
        for line in lines:
            for k, t in enumerate(line):
                if t == name:
                    context += sum((quality.index_vector(line[j]) for j in range(max(0, k - quality.REACH), min(len(line), k + quality.REACH + 1)) if j != k), np.zeros(quality.DIMENSIONS))
        want = quality.index_vector(name) / math.sqrt(quality.NONZERO) + context / (np.linalg.norm(context) or 1)
        assert np.allclose(words.vectors[words.number[name]], want, atol=1e-5)
