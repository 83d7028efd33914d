"""Whitening against numpy's dense eigenvectors, with broken rows, ties, repeats and low rank."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label string, whitened string, deviation string, n string"


def frame(spark, vectors, ids=None):
    rows = [(i, v, "l", "clash", "clash", "clash") for i, v in zip(ids or range(len(vectors)), vectors)]
    return spark.createDataFrame(rows, SCHEMA)


def brute(vectors, k=4):
    """{row: (n, deviation, whitened up to sign)}, explained."""
    ok = {i: [int(np.floor(256 * float(np.float32(c)))) for c in v] for i, v in enumerate(vectors) if v is not None and all(c is not None and np.isfinite(c) for c in v)}
    fitted = np.array(sorted({tuple(x) for x in ok.values()}), float)
    n = len(fitted)
    c = fitted - fitted.mean(0)
    cov = c.T @ c / n
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values)[:k]
    sums = fitted.astype(np.int64).sum(0)
    told = {i: (n, int(((n * np.array(x) - sums) ** 2).sum()), (np.array(x) - fitted.mean(0)) @ axes[:, order] / np.sqrt(values[order])) for i, x in ok.items()}
    return told, values[order] / np.trace(cov)


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(4)
    base = (rng.standard_normal((300, 12)) * np.linspace(2, 0.2, 12)) @ rng.standard_normal((12, 12))
    vectors = base.astype(np.float32).tolist() + [base[0].astype(np.float32).tolist()] * 90
    broken = [None, [None] * 12, [float("nan")] + [0.5] * 11, [float("inf")] * 12]
    df = frame(spark, vectors + broken).repartition(7)
    want, explained = brute(vectors + broken)
    rows = whitening.whiten(df).collect()
    assert len(rows) == 4 * len(vectors)
    got = {}
    for r in rows:
        got.setdefault(r["vec_id"], {})[r["component"]] = r
        assert (r["n"], r["deviation"]) == want[r["vec_id"]][:2] and r["identity_error"] < 1e-9
        assert r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-9)
    for j in range(4):
        mine = np.array([got[i][j + 1]["whitened"] for i in sorted(got)])
        other = np.array([want[i][2][j] for i in sorted(want)])
        assert min(np.abs(mine - other).max(), np.abs(mine + other).max()) < 1e-8


def test_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = whitening.whiten(df).collect()
    table = {r["vec_id"]: r["embedding"] for r in df.collect()}
    ids = sorted(table)
    want, explained = brute([table[i] for i in ids])
    assert len(rows) == 4 * len(ids) and rows[0]["identity_error"] < 1e-9
    for r in rows:
        n, dev, w = want[ids.index(r["vec_id"])]
        assert (r["n"], r["deviation"]) == (n, dev) and abs(abs(r["whitened"]) - abs(w[r["component"] - 1])) < 1e-7
        assert r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-6)


def test_eigenvectors():
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.standard_normal((9, 9)))
    cases = [np.eye(5), np.diag([3.0, 3, 3, 1, 0]), np.zeros((4, 4)), np.array([[2.0]]), np.array([[2.0, 1], [1, 2]]), q @ np.diag([5, 5, 5 - 1e-13, 4, 1, 1, 0, 0, 0]) @ q.T, q @ np.diag(10.0 ** -np.arange(9)) @ q.T]
    for a in cases:
        a = (a + a.T) / 2
        values, vectors = whitening.leading_vectors(a, 4)
        k = min(4, len(a))
        size = max(1e-300, np.abs(a).max())
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:k], atol=1e-14 * size * 10, rtol=0)
        assert np.abs(vectors @ vectors.T - np.eye(k)).max() < 1e-13
        assert np.abs(a @ vectors.T - vectors.T * values).max() <= 1e-13 * size


def test_odd_tables(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [None, [float("nan")]])).count() == 0
    one = whitening.whiten(frame(spark, [[1.0, 2.0]] * 3, [None, None, 5])).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, None, None, None)] * 6
    # rank one, another length, and entries beyond a long
    rows = whitening.whiten(frame(spark, [[0.0, 0.0], [1.0, 1.0], [2.0, 2.0], [1.0]])).collect()
    told = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(rows) == 8 and told[3, 1]["whitened"] is None and told[3, 1]["deviation"] is None
    assert abs(told[2, 1]["whitened"]) == pytest.approx(1.5**0.5) and told[0, 2]["whitened"] is None
    assert told[2, 1]["explained"] == pytest.approx(1) and told[2, 2]["explained"] == 0
    huge = whitening.whiten(frame(spark, [[3e38, 0.0], [-3e38, 1.0], [0.0, 2.0]])).collect()
    assert len(huge) == 6 and all(r["deviation"] is None for r in huge if r["vec_id"] < 2) and huge[0]["identity_error"] < 1e-9


def test_transform_keeps_columns(spark):
    df = frame(spark, [[1.0, 0.0], [0.0, 1.0], None, [3.0, 1.0]])
    out = whitening.transform(df, whitening.fit(df))
    assert set(out.columns) == set(df.columns) and out.where(F.col("whitened").isNull()).count() == 1
    assert {r["n"] for r in out.collect()} == {"clash"}
