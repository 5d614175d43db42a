"""Whitening against numpy on all rows, and its defined cases."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyproof.llm import queries, whitening

SF = "/root/testdata/sf0.01"


def brute(vectors, components=32):
    """n, S, deviations, eigenvalues, trace and the covariance, from whole numbers."""
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    far = ((n * x - sums) ** 2).sum(axis=1)
    centred = np.array([[float(Fraction(int(n * a - s), n)) for a, s in zip(row, sums)] for row in x])
    return n, far, centred, centred.T @ centred / n


def test_equals_numpy(spark):
    rows = [(r.vec_id, r.embedding) for r in queries.table(spark, SF, "embeddings").select("vec_id", "embedding").collect()]
    n, far, centred, covariance = brute([v for _, v in rows])
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    found = queries.op11_whitening(spark, SF).collect()
    assert len(found) == 32 * len(rows)
    place = {ident: i for i, (ident, _) in enumerate(rows)}
    white = np.zeros((len(rows), 32))
    for r in found:
        white[place[r.vec_id], r.component - 1] = r.whitened
        assert r.n == n and r.deviation == far[place[r.vec_id]] and r.identity_error < 1e-9
        assert r.explained == pytest.approx(values[r.component - 1] / covariance.trace(), rel=1e-9)
    want = centred @ axes[:, :32] / np.sqrt(values[:32])
    for k in range(32):
        sign = np.sign(want[:, k] @ white[:, k])
        assert white[:, k] * sign == pytest.approx(want[:, k], abs=1e-6)
    assert white.T @ white / n == pytest.approx(np.eye(32), abs=1e-9)


def frame(spark, rows, kind="array<float>"):
    return spark.createDataFrame(rows, f"vec_id long, embedding {kind}")


def test_counts_or_one(spark):
    rng = np.random.default_rng(1)
    few = [rng.normal(0, 1, 3).tolist() for _ in range(9)]
    rows = frame(spark, [(i, few[i % 9 if i % 2 else 0]) for i in range(200)], "array<double>")
    for kind in ("count", "one"):
        fitted = whitening.fit(rows, weights=kind)
        used = [few[i % 9 if i % 2 else 0] for i in range(200)] if kind == "count" else few
        n, _, _, covariance = brute(used)
        assert fitted.n == n and fitted.vectors.count() == 9
        assert np.sort(fitted.eigenvalues) == pytest.approx(np.linalg.eigvalsh(covariance), rel=1e-9)
        assert fitted.identity_error < 1e-9
        found = whitening.whiten(rows, fitted).collect()
        assert len(found) == 600 and len({(r.vec_id, r.component) for r in found}) == 600
        fitted.release()


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = frame(
        spark,
        [(1, None), (2, []), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, 2.0]), (6, [1.0, 2.0]), (None, [-3.0, 0.5]),
         (8, [1.0, 2.0, 3.0]), (9, [2.0, 2.0])],
    ).withColumns({c: F.lit("clash") for c in ("_id", "_key", "_n", "_size", "component", "deviation", "whitened")})
    fitted = whitening.fit(rows)
    found = whitening.whiten(rows, fitted).collect()
    n, far, _, _ = brute([[1.0, 2.0], [1.0, 2.0], [-3.0, 0.5], [2.0, 2.0]])
    assert fitted.n == n == 4
    assert sorted([r.vec_id or 0, r.component, int(r.deviation)] for r in found) == sorted(
        [i, c, int(d)] for i, d in zip((6, 6, 0, 9), far) for c in (1, 2)
    )
    assert whitening.whiten(rows.limit(0), whitening.fit(rows.limit(0))).count() == 0
    same = frame(spark, [(i, [1.0, 2.0]) for i in range(5)])
    assert whitening.whiten(same, whitening.fit(same)).count() == 0
    flat = frame(spark, [(i, [float(i), 2.0, -float(i)]) for i in range(5)])
    assert {r.component for r in whitening.whiten(flat, whitening.fit(flat)).collect()} == {1}
    with pytest.raises(ValueError):
        whitening.fit(flat, most_dimensions=2)


def test_widths_and_exact_deviations(spark):
    """Numbers of every width, beyond what 64 bits hold when squared."""
    numbers = [[1e-9, 3.0], [2.5, -400.0], [1e8, 7.0], [1e15, -1e16], [3e38, -3e38], [-1e300, 1e300]]
    rows = frame(spark, list(enumerate(numbers)), "array<double>")
    fitted = whitening.fit(rows)
    x = [[max(-(2**62), min(2**62, math.floor(64 * Fraction(c)))) for c in v] for v in numbers]
    sums = [sum(v[i] for v in x) for i in range(2)]
    assert fitted.sums == sums
    want = [sum((6 * a - s) ** 2 for a, s in zip(v, sums)) for v in x]
    found = {r.vec_id: r.deviation for r in whitening.whiten(rows, fitted).collect()}
    assert {i: None if d is None else int(d) for i, d in found.items()} == {i: d if d < 10**38 else None for i, d in enumerate(want)}
    small = np.random.default_rng(0).integers(-500, 500, (50, 7))
    n, total = 12_345_678_901, np.random.default_rng(1).integers(0, 12_345_678_901, 7)
    whole = np.arange(7)
    exact = [sum((n * (int(a) - int(w)) - int(r)) ** 2 for a, w, r in zip(v, whole, total)) for v in small]
    assert whitening.deviations(small, whole, total, n) == exact


def test_one_vector_that_is_very_frequent(spark):
    rows = spark.range(3000).selectExpr("id as vec_id", "if(id % 3 = 0, array(1D, 2D, 3D), array(id / 7D, sin(id), id % 11 * 1D)) as embedding")
    fitted = whitening.fit(rows.repartition(7))
    assert fitted.n == 3000 and fitted.vectors.agg(F.max("_n")).first()[0] >= 1000
    white = whitening.whiten(rows, fitted)
    assert white.count() == 9000 and white.filter("vec_id % 3 = 0 and component = 1").select("whitened").distinct().count() == 1
