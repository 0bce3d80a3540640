"""Fits by sums over rows: against numpy on all rows at once."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from epispark.operators import additive
from epispark.operators.dlnm import fit_quasi_poisson


def series(days=1100, seed=3):
    rng = np.random.default_rng(seed)
    t = np.arange(days)
    doy = np.array([(datetime.date(2001, 1, 1) + datetime.timedelta(int(i))).timetuple().tm_yday for i in t])
    mu = np.exp(3 + 0.4 * np.sin(2 * np.pi * doy / 365.25) + 0.0004 * t + 0.1 * ((t % 7) == 2))
    return [(datetime.date(2001, 1, 1) + datetime.timedelta(int(i)), int(y)) for i, y in zip(t, rng.poisson(mu))], mu


def test_splines_are_a_partition_of_unity_and_meet_at_the_ends():
    t = np.linspace(0, 1, 50)
    for cyclic in (True, False):
        b = additive.cubic(t, 9, cyclic)
        assert np.allclose(b.sum(axis=1), 1) and (b >= 0).all()
        # a straight line has no second differences
        assert np.allclose(additive.roughness(9, False) @ np.arange(9.0), 0)
    assert np.allclose(additive.cubic(np.array([0.0]), 9, True), additive.cubic(np.array([1.0]), 9, True))
    assert np.allclose(additive.roughness(9, True) @ np.ones(9), 0)
    z = additive.contrast(6)
    assert np.allclose(z.sum(axis=0), 0) and np.allclose(z.T @ z, np.eye(5))


def restricted_likelihood(x, y, beta, penalties, log):
    """Of the working model at ``beta``, over all rows, with the scale profiled out."""
    mu = np.exp(x @ beta)
    z, w = x @ beta + (y - mu) / mu, mu
    s = sum(np.exp(v) * m for v, (m, _) in zip(log, penalties))
    g = x.T @ (x * w[:, None])
    b = np.linalg.solve(g + s, x.T @ (w * z))
    free = len(y) - (x.shape[1] - sum(r for _, r in penalties))
    d = w @ (z - x @ b) ** 2 + b @ s @ b
    return -0.5 * (free * np.log(d / free) + np.linalg.slogdet(g + s)[1] - sum(v * r for v, (_, r) in zip(log, penalties)))


def test_penalised_baseline(spark):
    rows, mu = series()
    df = spark.createDataFrame([(d, y, "x") for d, y in rows] + [(None, 5, "x"), (datetime.date(2002, 2, 2), None, "y")], "date date, deaths int, expected string").repartition(7)
    out, about = additive.penalised_baseline(df)
    got = out.filter("deaths is not null and date is not null").orderBy("date").collect()
    assert about["status"] == "success" and 4 < about["edf"] < 26
    y, e = np.array([r["deaths"] for r in got], float), np.array([r["expected"] for r in got])
    assert abs(y.sum() - e.sum()) < 1e-5 * y.sum()  # observed and expected sums agree
    assert np.abs(np.log(e) - np.log(mu)).max() < 0.12
    assert 0.5 < about["deviance_explained"] < 1
    left = {(r["date"], r["deaths"]): r["expected"] for r in out.filter("deaths is null or date is null").collect()}
    assert left[(None, 5)] is None and left[(datetime.date(2002, 2, 2), None)] == pytest.approx(e[397], rel=1e-12)
    # all rows at once: the score equations hold, and no other weights have a higher restricted likelihood
    day = np.array([(r["date"] - datetime.date(1970, 1, 1)).days for r in got], float)
    doy = np.array([r["date"].timetuple().tm_yday for r in got], float)
    model = additive.Smooth(int(day.min()), int(day.max()), 10, 10)
    x, beta, log = model.rows(day, doy), np.array(about["coef"]), np.log(about["weights"])
    penalties = model.penalties()
    penalty = sum(np.exp(v) * m for v, (m, _) in zip(log, penalties))
    assert np.abs(x.T @ (y - np.exp(x @ beta)) - penalty @ beta).max() < 1e-3
    best = restricted_likelihood(x, y, beta, penalties, log)
    for i in range(2):
        for step in (-0.5, 0.5):
            assert restricted_likelihood(x, y, beta, penalties, log + step * np.eye(2)[i]) < best + 5e-3


def test_baseline_without_events(spark):
    df = spark.createDataFrame([(datetime.date(2001, 1, 1), 0)], "date date, deaths int")
    out, about = additive.penalised_baseline(df)
    assert about["status"] == "no events" and out.first()["expected"] is None
    assert additive.penalised_baseline(df.limit(0))[0].count() == 0
    short, about = additive.penalised_baseline(spark.createDataFrame(series(400)[0], "date date, deaths int"), steps=1)
    assert about["status"] == "not settled"


def test_long_fit_equals_the_fit_of_all_rows(spark):
    rng = np.random.default_rng(5)
    x = np.column_stack([np.ones(900), rng.normal(size=(900, 3))])
    y = rng.poisson(np.exp(x @ [1.0, 0.3, -0.2, 0.1]))
    rows = [("hot" if i >= 100 else "small", x[i].tolist(), int(y[i])) for i in range(900)] + [("hot", None, 3), ("hot", x[0].tolist(), None)]
    df = spark.createDataFrame(rows, "key string, x array<double>, deaths int").repartition(8)
    assert df.filter("key = 'hot'").select(F.spark_partition_id()).distinct().count() == 8  # one key over several tasks
    got = {r["key"]: r for r in additive.fit_long(df, ("key",)).collect()}
    for key, at in (("hot", slice(100, 900)), ("small", slice(0, 100))):
        beta, cov, dispersion, _, _ = fit_quasi_poisson(x[at], y[at].astype(float))
        r = got[key]
        assert r["status"] == "success" and r["n_rows"] == len(y[at]) and r["n_deaths"] == y[at].sum()
        assert np.allclose(r["coef"], beta, atol=1e-7) and np.allclose(r["vcov"], cov.ravel(), rtol=1e-5, atol=1e-10) and r["dispersion"] == pytest.approx(dispersion, rel=1e-6)
    whole = additive.fit_long(df.drop("key")).first()
    assert np.allclose(whole["coef"], fit_quasi_poisson(x, y.astype(float))[0], atol=1e-7)
    assert additive.fit_long(df, ("key",), steps=1).first()["status"] == "not settled"
    assert additive.fit_long(df.limit(0), ("key",)).count() == 0
    twice = df.select("key", F.concat("x", F.slice("x", 2, 1)).alias("x"), "deaths")  # a collinear column
    r = {r["key"]: r for r in additive.fit_long(twice, ("key",)).collect()}["hot"]
    assert r["coef"][1] + r["coef"][4] == pytest.approx(got["hot"]["coef"][1], abs=1e-6)
    with pytest.raises(ValueError, match="too many keys"):
        additive.LARGEST, kept = 100, additive.LARGEST
        try:
            additive.fit_long(df, ("key",))
        finally:
            additive.LARGEST = kept
