"""Whitening against a plain eigenvalue solver, with exact deviations."""

import numpy as np
import pytest

from wayrisk.llm import whitening
from wayrisk.llm.bidiagonal import right_vectors, squared_singular_values

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>"


def usable(rows) -> list[tuple]:
    keep = [(k, np.array(v, np.float32).astype(float)) for k, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    return [(k, np.floor(64 * v).astype(np.int64) + 1_000_000) for k, v in keep]


def check(rows, got, components=16):
    points = usable(rows)
    fit = np.array(sorted({tuple(x) for _, x in points}))
    n, sums = len(fit), fit.sum(axis=0)
    centred = (n * fit - sums) / n
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    values, directions = values[::-1], directions[:, ::-1]
    k = min(components, fit.shape[1])
    assert len(got) == k * len(points)
    by_key = {}
    for r in got:
        by_key.setdefault(r.vec_id, {})[r.component] = r
    sign = {}
    for key, x in points:
        apart = n * x - sums
        for c in range(k):
            r = by_key[key][c + 1]
            assert r.n == n and r.deviation == int((apart.astype(object) ** 2).sum()) and r.identity_error <= 1e-9
            assert r.explained == pytest.approx(values[c] / values.sum(), rel=1e-9)
            plain = apart / n @ directions[:, c] / np.sqrt(values[c])
            if abs(plain) > 1e-6:
                s = sign.setdefault(c, np.sign(plain * r.whitened))
                assert s * r.whitened == pytest.approx(plain, abs=1e-7)


def test_whole_table(spark):
    from wayrisk.llm.queries import QUERIES

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    check(rows, QUERIES["op12_whitening"](spark, FOLDER).collect())


def test_copies_and_many_parts(spark, monkeypatch):
    rng = np.random.default_rng(2)
    vectors = (rng.standard_normal((400, 12)) * np.logspace(1, -1, 12)).astype(np.float32).tolist()
    rows = list(enumerate(vectors + [vectors[0]] * 300))
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 7)
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(9)).collect()
    check(rows, got)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 3.0]), (None, [2.0, 2.5, 3.0]), (2, None), (3, []), (4, [1.0, None, 2.0]), (5, [nan, 1.0, 1.0]), (6, [inf, 1.0, 1.0]), (7, [1.0, 2.0]), (8, [-4.0, 2.0, 3.0])]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS component", "2 AS x", "3 AS n", "'a' AS whitened")
    got = whitening.whiten(frame).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == sorted((k, c) for k in (0, 1, 1, 8) for c in (1, 2, 3))
    assert {r.n for r in got} == {3} and all((r.whitened is None) == (r.component == 3) for r in got)
    assert all(r.identity_error < 1e-9 for r in got)
    assert whitening.whiten(frame.where("false")).count() == 0 and whitening.whiten(frame.where("vec_id BETWEEN 2 AND 6")).count() == 0
    one = whitening.whiten(frame.where("vec_id = 1")).collect()
    assert len(one) == 6 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, None, None, 0.0)}
    huge = whitening.whiten(spark.createDataFrame([(1, [3e38]), (2, [1.0])], SCHEMA)).collect()
    assert {(r.vec_id, r.deviation) for r in huge} == {(1, None), (2, None)} and all(abs(abs(r.whitened) - 1) < 1e-9 for r in huge)
    small = whitening.whiten(spark.createDataFrame([(1, [2.0**40]), (2, [1.0])], SCHEMA)).collect()
    half = 64 * (2**40 - 1)
    assert {r.deviation for r in small} == {None if half**2 >= 1 << 63 else half**2}


def solved(a: np.ndarray, k: int):
    values, v = right_vectors(np.linalg.qr(np.vstack([a, np.zeros((a.shape[1], a.shape[1]))]), mode="r"), k)
    s = np.linalg.svd(a, compute_uv=False)
    s = np.append(s, np.zeros(a.shape[1] - len(s)))
    top = max(s[0] ** 2, 1e-300)
    assert np.abs(values - s**2).max() <= 1e-13 * top
    assert np.abs(v.T @ v - np.eye(k)).max() < 1e-11
    assert np.abs(a.T @ (a @ v) - v * values[:k]).max() <= 1e-13 * top


def test_bidiagonal_solver():
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.standard_normal((300, 40)))[0]
    lost = rng.standard_normal((200, 20))
    lost[:, 3], lost[:, 4] = 0, lost[:, 5]
    for a, k in [
        (rng.standard_normal((500, 64)), 16),
        (rng.standard_normal((300, 64)) * np.logspace(0, -6, 64), 64),
        (lost, 20),
        (q, 40),
        (q * np.r_[np.ones(20), np.linspace(1 + 1e-10, 1 + 1e-8, 20)], 16),
        (np.diag([3.0, 3, 2, 2, 2, 1, 1e-9, 0]), 8),
        (np.eye(8), 8),
        (np.zeros((4, 3)), 3),
        (rng.standard_normal((5, 20)), 16),
        (np.ones((10, 4)), 4),
        (rng.standard_normal((1, 1)), 1),
    ]:
        solved(a, k)


def test_small_singular_values_are_accurate():
    diagonal, above = np.logspace(0, -12, 13), np.logspace(0, -12, 13)[:-1] * 1e-3
    plain = np.linalg.svd(np.diag(diagonal) + np.diag(above, 1), compute_uv=False)
    assert np.sqrt(squared_singular_values(diagonal, above)) == pytest.approx(plain, rel=1e-9, abs=0)
