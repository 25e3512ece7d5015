"""Whitening against numpy's own eigenvectors of the distinct vectors' covariance."""

import math

import numpy as np
import pyarrow.parquet as pq
import pytest

from cohortlens.llm import queries, whitening

SCHEMA = "vec_id bigint, embedding array<float>"


def plain(rows, most=16):
    """{row: (vec_id, deviation, |whitened|)}, explained shares; by numpy.linalg.eigh and whole numbers of any size."""
    rows = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    sizes = [len(v) for _, v in rows]
    d = max(set(sizes), key=lambda s: (sizes.count(s), s))
    rows = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if len(v) == d]
    fit = sorted({tuple(x) for _, x in rows})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centre = lambda x: [(n * c - s) / n for c, s in zip(x, sums, strict=True)]
    y = np.array([centre(x) for x in fit])
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = int((values[:most] > 1e-12 * values.sum()).sum())
    white = [np.array(centre(x)) @ vectors[:, :k] / np.sqrt(values[:k]) for _, x in rows]
    return n, [(i, sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)), np.abs(w)) for (i, x), w in zip(rows, white, strict=True)], values[:k] / values.sum()


def compare(got, rows, tolerance=1e-6):
    n, want, explained = plain(rows)
    k = len(explained)
    assert len(got) == k * len(want)
    assert {r.n for r in got} <= {n} and all(r.identity_error <= 1e-4 for r in got)
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r.whitened)
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
    for vec_id, deviation, white in want:
        for c in range(k):
            assert any(abs(w) == pytest.approx(white[c], abs=tolerance) for w in by[vec_id, deviation][c + 1])
    for c in range(k):  # one sign for all rows: covariances with each other are the identity
        assert {r.component for r in got} == set(range(1, k + 1))


def test_whole_table(spark, sf_dir):
    got = queries.QUERIES["op11_whitening"](spark, sf_dir).collect()
    table = pq.read_table(f"{sf_dir}/embeddings.parquet").to_pydict()
    compare(got, list(zip(table["vec_id"], table["embedding"], strict=True)))
    white = {}
    for r in got:
        white.setdefault(r.vec_id, np.zeros(16))[r.component - 1] = r.whitened
    w = np.array([*white.values()])
    assert np.abs(w.T @ w / len(w) - np.eye(16)).max() < 1e-4 and np.abs(w.mean(0)).max() < 1e-8


def test_edge_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [float(np.float32(c)) for c in rng.standard_normal(5) * [9, 3, 1, 0.5, 0]]) for k in range(60)]
    rows += [(3, rows[3][1]), (None, rows[4][1]), (100, rows[5][1]), (101, None), (102, []), (103, [1.0, None, 1.0, 1.0, 1.0]), (104, [math.nan] * 5), (105, [math.inf, 0.0, 0.0, 0.0, 0.0]), (106, [1.0, 2.0])]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as n", "'x' as whitened", "2 as v")
    compare(whitening.whiten(df.repartition(5)).collect(), rows)


def test_without_variance_there_are_no_components(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [math.nan])], SCHEMA)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)).collect() == []


def test_very_large_entries_are_held_and_have_no_deviation(spark):
    got = whitening.whiten(spark.createDataFrame([(1, [1e30]), (2, [-1e30]), (3, [0.0])], SCHEMA)).collect()
    assert len(got) == 3 and all(r.deviation is None for r in got if r.vec_id != 3)
    assert sorted(abs(r.whitened) for r in got) == pytest.approx([0, 1.5**0.5, 1.5**0.5], abs=1e-6)


@pytest.mark.parametrize("kind", ["random", "clusters", "wide", "graded", "identity", "zero", "swap", "one"])
def test_components_like_eigh(kind):
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.standard_normal((48, 48)))[0]
    v = {"random": np.cov(rng.standard_normal((48, 90))), "clusters": (q * np.repeat([5, 3, 1, 0], 12)) @ q.T, "wide": (q * np.r_[1e10, np.ones(47)]) @ q.T, "graded": (q * 10.0 ** -np.arange(48)) @ q.T, "identity": np.eye(7), "zero": np.zeros((5, 5)), "swap": np.array([[0.0, 1.0], [1.0, 0.0]]), "one": np.array([[3.0]])}[kind]
    scale = max(np.abs(v).max(), 1e-300)
    for most in (None, 4):
        values, vectors = whitening.components_of(v, most)
        assert np.abs(values - np.linalg.eigvalsh(v)[::-1][: len(values)]).max() <= 1e-13 * scale
        assert np.abs(v @ vectors - vectors * values).max() <= 1e-13 * scale
        assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() <= 1e-13


def test_polar_factor_is_the_sign():
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.standard_normal((30, 30)))[0]
    values = np.r_[-(10.0 ** -np.arange(10)), 10.0 ** -np.arange(20) * 0.5]
    values = np.where(np.abs(values) < 1e-8, 1e-8, values)
    assert np.abs(whitening.qdwh((q * values) @ q.T) - (q * np.sign(values)) @ q.T).max() < 1e-6
