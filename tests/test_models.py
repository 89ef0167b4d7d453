"""Smooth regressions and structures against planted truths and plain algebra."""

import numpy as np
import pandas as pd
import pytest

from contactloom.functions import kernels
from contactloom.operators import smooths


def test_splines_sum_to_one_and_are_local():
    x = np.linspace(2, 9, 500)
    b = smooths.splines(x, 2.0, 9.0)
    assert b.shape == (500, smooths.SPLINES) and np.allclose(b.sum(axis=1), 1) and (b >= 0).all()
    assert ((b > 0).sum(axis=1) <= smooths.DEGREE + 1).all() and np.allclose(smooths.splines(np.array([1.0, 20.0]), 2.0, 9.0), b[[0, -1]])
    # a cubic is in their span
    y = 3 + x - 0.2 * x**3
    assert np.allclose(b @ np.linalg.lstsq(b, y, rcond=None)[0], y)


@pytest.fixture(scope="module")
def curved(spark):
    rng = np.random.default_rng(1)
    n = 3000
    a, b = rng.uniform(0.2, 0.7, n), rng.uniform(0.5, 1.0, n)
    eta = 4 + 2.0 * np.sin(12 * a) - 6 * (b - 0.8) ** 2
    y = rng.poisson(np.exp(eta))
    df = pd.DataFrame({"bin_id": np.arange(n), "a": a, "b": b, "coverage": y.astype(float), "mean": np.exp(eta)})
    return df, spark.createDataFrame(df).repartition(5)


def test_curved_covariates_are_recovered(curved):
    df, rows = curved
    model = smooths.fitted(rows, ["a", "b"], "coverage")
    got = np.exp(model.columns(df) @ model.beta)
    assert np.median(np.abs(got / df["mean"] - 1)) < 0.02 and 8 < model.freedom < 21
    # the penalised likelihood has no slope at the fit
    x, widths = model.columns(df), [smooths.SPLINES] * 2
    score = x.T @ (df["coverage"] - got) - smooths.penalty(widths, 10**model.penalties) @ model.beta
    assert np.abs(score).max() < 1e-3 * df["coverage"].sum()
    # a covariate without effect is smoothed away
    flat = df.assign(coverage=np.random.default_rng(7).poisson(50, len(df)))
    flat = smooths.fitted(rows.sparkSession.createDataFrame(flat), ["a", "b"], "coverage")
    assert flat.freedom < 8 and flat.deviance < 1.1 * len(df)


def test_sums_of_parts_are_those_of_all_rows(curved):
    df, rows = curved
    model = smooths.Smooths(["a", "b"], [(0.2, 0.7), (0.5, 1.0)], np.r_[3.0, np.linspace(-0.1, 0.1, 20)], np.ones(2), 0.0, 0.0)
    got = rows.select("a", "b", "coverage").mapInPandas(smooths.summing(model, "coverage", False), "k int, v double").groupBy("k").sum("v").toPandas().sort_values("k")
    x, y = model.columns(df), df["coverage"].to_numpy()
    mu = np.exp(x @ model.beta)
    z = x @ model.beta + (y - mu) / mu
    want = np.concatenate([((x * mu[:, None]).T @ x).ravel(), (x * mu[:, None]).T @ z, [(mu * z * z).sum(), len(y)]])
    assert np.allclose(got["sum(v)"].to_numpy()[:-1], want)


def test_profile(spark, curved):
    df, rows = curved
    df = df.assign(coverage=np.where(df["bin_id"] % 50 == 0, 0, df["coverage"] * np.where(df["bin_id"] >= 2000, 2, 1)))
    got = smooths.profile(spark.createDataFrame(df), ["a", "b"]).toPandas().sort_values("bin_id")["ratio"].to_numpy()
    assert (got[::50] == 0).all() and (got >= 0).all()
    filled = df["bin_id"] % 50 != 0
    low, high = (np.median(got[filled & m]) for m in (df["bin_id"] < 2000, df["bin_id"] >= 2000))
    assert (high - low) / low > 0.5
    assert smooths.profile(spark.createDataFrame(df).limit(0), ["a", "b"]).count() == 0


def test_gradient_is_that_of_differences():
    rng = np.random.default_rng(2)
    n = 9
    i, j = np.triu_indices(n, 1)
    count, x = rng.poisson(20, len(i)).astype(float), rng.normal(size=3 * n)
    _, grad = kernels.contact_likelihood(x, i, j, count, -2.5, 7.0)
    for k in range(3 * n):
        e = np.zeros(3 * n)
        e[k] = 1e-6
        up, down = (kernels.contact_likelihood(x + s * e, i, j, count, -2.5, 7.0)[0] for s in (1, -1))
        assert grad[k] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-4)


def test_minimum_of_a_valley():
    rosen = lambda v: (float((1 - v[0]) ** 2 + 100 * (v[1] - v[0] ** 2) ** 2), np.array([-2 * (1 - v[0]) - 400 * v[0] * (v[1] - v[0] ** 2), 200 * (v[1] - v[0] ** 2)]))
    assert np.allclose(kernels.quasi_newton(rosen, np.array([-1.2, 1.0]), 500, tolerance=1e-12), 1, atol=1e-3)


def test_exponent_of_planted_counts():
    rng = np.random.default_rng(3)
    d = rng.uniform(1, 10, 4000)
    count = rng.poisson(500 * d**-2.2).astype(float)
    assert kernels.best_exponent(d, count, -3.0) == pytest.approx(-2.2, abs=0.03)


@pytest.mark.parametrize("alpha", [-3.0, -2.0])
def test_helix_is_recovered_up_to_rotation(alpha):
    rng = np.random.default_rng(4)
    t = np.arange(60) * 0.45
    helix = np.stack([3 * np.cos(t), 3 * np.sin(t), 0.8 * t], axis=1)
    i, j = np.triu_indices(60, 1)
    d = np.sqrt(((helix[i] - helix[j]) ** 2).sum(axis=1))
    count = rng.poisson(3000 * d**alpha).astype(float)
    seen = count > 0
    got = kernels.coordinates(i[seen], j[seen], count[seen], 60)
    assert np.sqrt((np.diff(got, axis=0) ** 2).sum(axis=1)).mean() == pytest.approx(1.1)
    a, b = (x - x.mean(axis=0) for x in (helix, got))
    u, s, v = np.linalg.svd(b.T @ a)
    fit = b @ (u @ v) * s.sum() / (b * b).sum()
    assert np.sqrt(((fit - a) ** 2).sum() / (a * a).sum()) < 0.1
