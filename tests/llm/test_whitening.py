import math

import numpy as np
import pytest

from tidemark.llm import catalog, whitening


def spectra():
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.normal(size=(24, 24)))[0]
    u = np.linalg.qr(rng.normal(size=(24, 24)))[0]
    return {"graded": u @ np.diag(2.0 ** -np.arange(24)) @ q, "equal": u @ np.diag(np.r_[np.ones(9), np.full(15, 0.5)]) @ q,
            "close": u @ np.diag(1 + 1e-9 * np.arange(24)) @ q, "rank 5": u @ np.diag(np.r_[np.ones(5), np.zeros(19)]) @ q,
            "random": rng.normal(size=(24, 24)), "diagonal": np.diag([3.0, 3, 1, 1, 0]), "one": np.array([[2.0]]),
            "zero": np.zeros((3, 3))}


@pytest.mark.parametrize("name", list(spectra()))
def test_solver_against_a_library_decomposition(name):
    r = np.linalg.qr(spectra()[name], mode="r")
    values, axes = whitening.directions(r, 16)
    s = np.linalg.svd(r, compute_uv=False)
    large = s > 1e-7 * max(s[0], 1e-300)
    assert np.allclose(np.sqrt(values)[large], s[large], rtol=1e-7, atol=0)
    k = axes.shape[1]
    assert k == min(16, int((s > 1e-13 * s[0]).sum()) if s[0] else 0)
    assert np.allclose(axes.T @ axes, np.eye(k), atol=1e-13)
    if k:
        assert np.abs(r.T @ (r @ axes) - axes * values[:k]).max() < 1e-13 * s[0] ** 2


def brute(rows, most=16):
    """Covariance of the distinct vectors and its eigenvectors, from their definition."""
    good = [(i, v) for i, v in rows if v is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in good]
    fit = np.array(sorted(set(map(tuple, x))), dtype=object)
    n, s = len(fit), [int(t) for t in fit.sum(axis=0)]
    centred = (fit - fit[0]).astype(float)
    centred -= centred.mean(axis=0)
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    mean = [a / n for a in s]
    return {i: (n, sum((n * a - b) ** 2 for a, b in zip(r, s)),
                [float(np.dot(np.array(r, float) - mean, v[:, k]) / np.sqrt(e[k])) for k in range(min(most, len(e)))])
            for (i, _), r in zip(good, x)}, e / e.sum()


def vectors(spark, rows, extra=""):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>" + extra)


def test_rows_against_brute_force(spark):
    rng = np.random.default_rng(5)
    q = rng.normal(size=(20, 20)) * 2.0 ** -np.arange(20)[:, None] * 8
    rows = [(i, [float(c) for c in rng.normal(size=20) @ q]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(150)]                       # a third are copies of one
    rows += [(900, None), (901, []), (902, [1.0] * 19 + [None]), (903, [math.nan] * 20), (904, [math.inf] * 20), (905, [1.0] * 3)]
    want, explained = brute([r for r in rows if r[0] != 905])
    got = {}
    for r in whitening.whiten(vectors(spark, rows).repartition(7)).collect():
        got.setdefault(r["vec_id"], {})[r["component"]] = r
    assert set(got) == set(want)
    signs = {}
    for i, (n, deviation, z) in want.items():
        assert list(sorted(got[i])) == list(range(1, 17))
        for k, value in enumerate(z, 1):
            r = got[i][k]
            assert (r["n"], r["deviation"]) == (n, deviation)
            assert math.isclose(r["explained"], explained[k - 1], rel_tol=1e-8) and r["identity_error"] < 1e-9
            sign = signs.setdefault(k, math.copysign(1, value * r["whitened"]))
            assert math.isclose(sign * r["whitened"], value, rel_tol=1e-6, abs_tol=1e-6)


def test_triangles_fold_in_several_levels(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(c) for c in rng.normal(size=3)]) for i in range(200)]
    many = whitening.whiten(vectors(spark, rows).repartition(40)).groupBy().max("identity_error").first()[0]
    assert many < 1e-10


def test_degenerate_tables(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None), (2, [])])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    one = whitening.whiten(vectors(spark, [(1, [0.0, 5.0]), (2, [1.0, 5.0]), (None, [1.0, 5.0])])).collect()
    assert sorted((r["vec_id"] or 0, r["component"], r["deviation"]) for r in one) == [(0, 1, 4096), (1, 1, 4096), (2, 1, 4096)]
    assert {round(abs(r["whitened"]), 12) for r in one} == {1.0} and {r["explained"] for r in one} == {1.0}


def test_huge_entries_and_clashing_columns(spark):
    rows = [(1, [3e38, 0.0], "a", 5), (2, [-3e38, 1.0], "b", 6), (3, [0.0, 2.0], "c", 7)]
    got = whitening.whiten(vectors(spark, rows, ", x string, n int")).collect()
    assert {r["vec_id"] for r in got} == {1, 2, 3} and got[0]["deviation"] is None


def test_registered():
    assert "op11_whitened_vectors" in catalog.QUERIES
