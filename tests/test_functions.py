import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixloom.functions import numeric, optimize, special


def test_gamma_family_agrees_with_exact_values():
    for x in (1e-3, 0.1, 0.5, 1.0, 2.5, 17.0, 1e4):
        assert special.gammaln(x) == pytest.approx(math.lgamma(x), rel=1e-11, abs=1e-11)
        slope = (math.lgamma(x * 1.0001) - math.lgamma(x * 0.9999)) / (x * 0.0002)
        assert special.digamma(x) == pytest.approx(slope, rel=1e-5, abs=1e-5)
    assert special.trigamma(1.0) == pytest.approx(math.pi**2 / 6)
    assert special.multigammaln(3.0, 2) == pytest.approx(0.5 * math.log(math.pi) + math.lgamma(3) + math.lgamma(2.5))


def test_gamma_columns(spark):
    df = spark.createDataFrame([(x,) for x in (0.05, 1.0, 9.5, 500.0)] + [(None,)], "x double")
    for r in df.select("x", special.lgamma_col(F.col("x")).alias("g"), special.digamma_col(F.col("x")).alias("d")).collect():
        if r.x is None:
            assert r.g is None
        else:
            assert r.g == pytest.approx(math.lgamma(r.x), abs=1e-9)
            assert r.d == pytest.approx(float(special.digamma(r.x)), abs=1e-9)


def test_sticks_and_counts():
    assert numeric.greater_than_counts([1, 3, 7, 2]).tolist() == [12, 9, 2, 0]
    rho = np.array([0.3, 0.5, 0.2])
    beta = numeric.stick_to_weights(rho)
    assert beta.sum() == pytest.approx(1) and np.allclose(numeric.weights_to_stick(beta), rho)
    assert optimize.first_sticks(3, 0, 1)[0].tolist() == [0.5, 0.5, 0.5]


def test_sorts():
    assert numeric.big_to_small([3, 4, 5, 2, 2, 2, 1]).tolist() == [2, 1, 0, 3, 4, 5, 6]
    a, b = [1, 1, 1, 0, 0, -1, -1, -1], [6, 5, 4, 8, 7, 11, 1.5, -1.5]
    assert numeric.big_to_small(a, b).tolist() == [0, 1, 2, 3, 4, 5, 6, 7]
    assert numeric.big_to_small(b, a).tolist() == [5, 3, 4, 0, 1, 2, 6, 7]


def test_array_columns_match_numpy(spark):
    rng = np.random.default_rng(0)
    s = rng.normal(scale=20, size=(6, 4))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(s)], "i int, s array<double>")
    got = df.select("i", numeric.exp_normalise_col(F.col("s")).alias("r"), numeric.log_sum_exp_col(F.col("s")).alias("e"), numeric.argmax_col(F.col("s")).alias("a"), numeric.top_l_col(numeric.exp_normalise_col(F.col("s")), 1).alias("t")).orderBy("i").collect()
    resp, norm = numeric.exp_normalise(s)
    for r, want, e in zip(got, resp, norm):
        assert np.allclose(r.r, want) and r.e == pytest.approx(e) and r.a == want.argmax()
        assert r.t[0].k == want.argmax() and r.t[0].r == 1.0


def test_hungarian_against_all_permutations():
    rng = np.random.default_rng(1)
    for n, m in ((3, 3), (4, 6), (6, 4), (5, 5)):
        c = rng.normal(size=(n, m))
        best = min(sum(c[i, j] for i, j in zip(range(n), p)) for p in itertools.permutations(range(m), n)) if n <= m else min(sum(c[i, j] for j, i in zip(range(m), p)) for p in itertools.permutations(range(n), m))
        assert sum(c[i, j] for i, j in optimize.hungarian(c)) == pytest.approx(best)


def test_label_alignment():
    true = np.array([3, 3, 3, 1, 1, 1, 1, 1])
    assert optimize.align_labels(true, np.array([2, 2, 2, 0, 0, 0, 0, 0])).tolist() == true.tolist()
    assert optimize.align_labels(np.array([0, 0, 1]), np.array([5, 5, 5])).tolist() == [0, 0, 0]
    assert sorted(set(optimize.align_labels(np.array([0, 0, 0]), np.array([1, 2, 3])).tolist())) == [0, 1, 2]


def test_stick_gradient_and_optimum():
    k, kw = 4, {"n_rows": 7.0, "gamma": 2.0, "pull": np.array([-3.0, -5, -9, -4, -8])}
    rho, omega = np.array([0.4, 0.3, 0.5, 0.2]), np.array([9.0, 8, 7, 6])
    _, grad = optimize.sticks_objective(rho, omega, **kw)
    for i in range(k):
        up, down = rho.copy(), rho.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        slope = (optimize.sticks_objective(up, omega, **kw)[0] - optimize.sticks_objective(down, omega, **kw)[0]) / 2e-6
        assert grad[i] == pytest.approx(slope, rel=1e-4)
    best = optimize.best_sticks(rho, omega, **kw)
    assert optimize.sticks_objective(best, omega, **kw)[0] >= optimize.sticks_objective(rho, omega, **kw)[0]


def test_lbfgs_and_simplex():
    f = lambda x: (float(((x - 3) ** 2 * [1, 10]).sum()), 2 * (x - 3) * np.array([1.0, 10]))
    assert np.allclose(optimize.lbfgs(f, np.zeros(2))[0], 3, atol=1e-4)
    topics = np.array([[0.9, 0.1], [0.1, 0.9]])
    pi = optimize.simplex_map(np.array([50.0, 50.0]), topics)
    assert np.allclose(pi, 0.5, atol=1e-3)
