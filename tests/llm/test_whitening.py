import math

import numpy as np
import pytest

from paperloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x string, n int, c0 int"


@pytest.mark.parametrize("size", [1, 2, 3, 17, 64])
def test_components_match_a_plain_eigensolver(size):
    rng = np.random.default_rng(size)
    a = rng.standard_normal((size, 3 * size))
    a = a @ a.T
    values, vectors = whitening.components(a)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], rtol=1e-12, atol=1e-12 * np.abs(a).max())
    assert np.abs(vectors.T @ vectors - np.eye(size)).max() < 1e-13
    assert np.abs(a @ vectors - vectors * values).max() < 1e-12 * np.linalg.norm(a)


def test_components_of_hard_spectra():
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.standard_normal((12, 12)))
    for spectrum in ([5.0] * 12, [0.0] * 12, [9, 9, 9, 4, 4, 1, 1, 1, 1, 0, 0, 0], [1e12, 1e6, 1, 1e-3, *[1e-6] * 8], [3, 3 - 1e-9, 3 - 2e-9, *range(9)], np.diff(np.arange(13.0))):
        e = np.sort(np.array(spectrum, float))[::-1]
        a = (q * e) @ q.T
        a = (a + a.T) / 2
        values, vectors = whitening.components(a)
        assert np.allclose(values, e, rtol=1e-9, atol=1e-13 * max(1, e[0]))
        assert np.abs(a @ vectors - vectors * values).max() <= 1e-12 * max(1.0, e[0])


def test_polar_factor_is_orthogonal():
    a = np.random.default_rng(3).standard_normal((20, 20))
    u = whitening.polar(a)
    w, _, v = np.linalg.svd(a)
    assert np.abs(u - w @ v).max() < 1e-12


def plain(rows):
    """By numpy's own eigensolver over the distinct whole-number vectors."""
    good = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in good}), float)
    n, mean = len(fit), fit.mean(0)
    cov = (fit - mean).T @ (fit - mean) / n
    values, vectors = np.linalg.eigh(cov)
    sums = [int(s) for s in fit.sum(0)]
    out = {}
    for i, x in good:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        for k in range(min(16, len(sums))):
            e = values[-1 - k]
            out.setdefault((i, k + 1), []).append((n, deviation, (np.array(x) - mean) @ vectors[:, -1 - k] / math.sqrt(e), e / values.sum()))
    return out


def test_rows_match_a_plain_version(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(c)) for c in rng.standard_normal(20) * np.linspace(0.2, 2, 20)]) for i in range(300)]
    rows += [(900, rows[0][1]), (900, rows[0][1]), (901, None), (902, [1.0] * 19 + [None]), (903, [math.nan] + [1.0] * 19), (904, [math.inf] + [1.0] * 19), (None, rows[1][1])]
    docs = spark.createDataFrame([(*r, "a", 1, 2) for r in rows], SCHEMA).repartition(3)
    got = whitening.whiten(docs, whitening.learn(docs)).collect()
    want = plain(rows)
    assert sorted((r["vec_id"] or -1, r["component"]) for r in got) == sorted((i or -1, k) for (i, k), v in want.items() for _ in v)
    sign = {}
    for r in got:
        n, deviation, whitened, explained = want[r["vec_id"], r["component"]][0]
        assert (r["n"], r["deviation"]) == (n, deviation)
        if abs(whitened) > 1e-3:
            sign.setdefault(r["component"], math.copysign(1, whitened * r["whitened"]))
            assert abs(r["whitened"] * sign[r["component"]] - whitened) < 1e-8
        assert abs(r["explained"] - explained) < 1e-10 and r["identity_error"] < 1e-10


def test_empty_constant_and_mixed_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert whitening.whiten(empty, whitening.learn(empty)).count() == 0
    nulls = spark.createDataFrame([(1, None, "", 1, 1), (2, [], "", 1, 1)], SCHEMA)
    assert whitening.whiten(nulls, whitening.learn(nulls)).count() == 0
    one = spark.createDataFrame([(1, [0.5, 0.25], "", 1, 1), (2, [0.5, 0.25], "", 1, 1), (3, [1.0], "", 1, 1)], SCHEMA)
    got = whitening.whiten(one, whitening.learn(one)).collect()
    assert [(r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["identity_error"]) for r in sorted(got, key=lambda r: (r["vec_id"], r["component"]))] == [(i, k, 1, 0, 0.0, 0.0) for i in (1, 2) for k in (1, 2)]


def test_large_entries_stay_exact(spark):
    rows = [(1, [3e9, 1.0]), (2, [-3e9, 2.0]), (3, [0.0, 7.0]), (4, [1e30, 0.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["vec_id"], r["component"]): r for r in whitening.whiten(docs, whitening.learn(docs)).collect()}
    assert {i for i, _ in got} == {1, 2, 3}
    x = [[64 * int(a) + 1_000_000, 64 * int(b) + 1_000_000] for _, (a, b) in rows[:3]]
    sums = [sum(v) for v in zip(*x)]
    for i, v in enumerate(x):
        want = sum((3 * a - s) ** 2 for a, s in zip(v, sums))
        assert got[i + 1, 1]["deviation"] == (want if want < 2**63 else None)
    assert got[1, 1]["identity_error"] < 1e-6
