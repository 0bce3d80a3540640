"""The fitted queries against independent fits in numpy, on the registered tables."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from epispark.functions.splines import NaturalSpline, lag_basis
from epispark.operators import dlnm, matched, pooling
from epispark.plans import registry as R
from epispark.plans.surrogates import dense_panel, panel, records

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def run(spark):
    known = {}

    def get(name):
        if name not in known:
            known[name] = __spark_entry__.queries()[name](spark, SF).toPandas()
        return known[name]

    return get


@pytest.fixture(scope="module")
def frame(spark):
    return panel(spark, SF).toPandas().sort_values(["region", "date"])


@pytest.fixture(scope="module")
def main_spline(spark):
    return R.exposure_spline(panel(spark, SF))


def cross(x, spline, lags, lag_df):
    """The cross-basis from its definition: for each day, basis of each lagged exposure times basis of the lag."""
    b, c = spline.basis(x), lag_basis(lags, lag_df).basis(np.arange(lags + 1))
    out = np.full((len(x), spline.df * lag_df), np.nan)
    for t in range(lags, len(x)):
        out[t] = np.einsum("lj,lk->jk", b[t - np.arange(lags + 1)], c).ravel()
    return out


def poisson(x, y):
    """Poisson regression by weighted least squares, and its covariance scaled by the Pearson dispersion."""
    scale = np.abs(x).max(axis=0)
    z, beta = x / scale, np.zeros(x.shape[1])
    beta[np.flatnonzero((x == 1).all(axis=0))] = np.log(y.mean())
    for _ in range(60):
        root = np.exp(z @ beta / 2)
        beta = beta + np.linalg.lstsq(z * root[:, None], (y - root**2) / root, rcond=None)[0]
    mu = np.exp(z @ beta)
    phi = ((y - mu) ** 2 / mu).sum() / (len(y) - np.linalg.matrix_rank(z))
    inverse = np.linalg.pinv(z * np.sqrt(mu)[:, None], rcond=1e-12)
    return beta / scale, inverse @ inverse.T * phi / np.outer(scale, scale)


def reference(rows, spline, lags=21, lag_df=4, per_year=7, extra=None):
    """Coefficients and covariance of the cross-basis (and of an extra column) of one series."""
    x, y = rows["exposure"].to_numpy(float), rows["deaths"].to_numpy(float)
    day = (rows["date"].to_numpy("datetime64[D]") - np.datetime64("1970-01-01")).astype(float)
    cb = cross(x, spline, lags, lag_df)
    more = np.zeros((len(x), 0)) if extra is None else np.asarray(extra, float).reshape(len(x), -1)
    ok = ~np.isnan(cb).any(axis=1) & ~np.isnan(more).any(axis=1)
    cb, more, x, y, day = cb[ok], more[ok], x[ok], y[ok], day[ok]
    inner = np.quantile(day, np.linspace(0, 1, max(2, round(per_year * (day[-1] - day[0]) / 365.25) + 1))[1:-1])
    season = NaturalSpline((day[0], day[-1]), tuple(inner)).basis(day)
    weekday = np.stack([(day.astype(int) + 3) % 7 == k for k in range(1, 7)], axis=1).astype(float)
    beta, cov = poisson(np.hstack([cb, more, np.ones((len(y), 1)), season, weekday]), y)
    return beta, cov, x, cb.shape[1]


def one(frame, region):
    return frame[frame["region"] == region]


def test_region_fit(run, frame, main_spline):
    fits = run("dlnm_region_fit").set_index("region")
    assert (fits["status"] == "success").all() and len(fits) == 5
    for region in (0, 3):
        beta, cov, x, p = reference(one(frame, region), main_spline)
        got = fits.loc[region]
        assert np.allclose(np.array(got["coef"]), beta[:p], rtol=1e-2, atol=1e-2)
        at = np.quantile(x, [0.01, 0.05, 0.5, 0.95, 0.99])
        assert np.allclose([got[k] for k in dlnm.PERCENTILES], at)
        grid = np.linspace(at[0], at[-1], 100)
        s = lag_basis(21, 4).basis(np.arange(22)).sum(axis=0)
        theta = beta[:p].reshape(main_spline.df, 4) @ s
        mmt = grid[np.argmin(main_spline.basis(grid) @ theta)]
        assert got["mmt"] == pytest.approx(mmt, abs=1e-6)
        rr = np.exp((main_spline.basis(at) - main_spline.basis(np.array([mmt]))) @ theta)
        assert np.allclose([got[f"rr_{k}"] for k in dlnm.PERCENTILES], rr, rtol=5e-3)
        m = np.kron(np.eye(main_spline.df), s)
        d = main_spline.basis(at[-1:]) - main_spline.basis(np.array([mmt]))
        se = math.sqrt((d @ m @ cov[:p, :p] @ m.T @ d.T)[0, 0])
        assert math.log(got["rr_p99_hi"] / got["rr_p99"]) / 1.96 == pytest.approx(se, rel=1e-2)


def test_grid_strata_and_horizons(spark, run, frame, main_spline):
    grid = run("sensitivity_grid")
    assert len(grid) == 5 * 13 and set(grid["exposure_df"]) == {3, 4, 5}
    rows, spline = one(frame, 2), R.exposure_spline(panel(spark, SF), (0.25, 0.5, 0.75))
    beta, _, x, p = reference(rows, spline, 21, 3)
    got = grid[(grid["region"] == 2) & (grid["spline"] == "df4") & (grid["lag_df"] == 3)].iloc[0]
    theta = beta[:p].reshape(spline.df, 3) @ lag_basis(21, 3).basis(np.arange(22)).sum(axis=0)
    d = spline.basis(np.array([np.quantile(x, 0.99)])) - spline.basis(np.array([got["mmt"]]))
    assert math.log(got["rr_p99"]) == pytest.approx((d @ theta)[0], rel=1e-2, abs=5e-3)

    h = run("harvesting_fits")
    assert sorted(set(h["lags"])) == [7, 14, 21, 28, 35]
    assert (h.groupby("region")["mmt"].nunique() <= 1).all()  # all horizons share the longest one's minimum
    beta, _, x, p = reference(rows, main_spline, 35, 4)
    theta = beta[:p].reshape(main_spline.df, 4) @ lag_basis(35, 4).basis(np.arange(36)).sum(axis=0)
    places = np.linspace(*np.quantile(x, [0.01, 0.99]), 100)
    mine = h[(h["region"] == 2) & (h["lags"] == 7)].iloc[0]
    assert mine["mmt"] == pytest.approx(places[np.argmin(main_spline.basis(places) @ theta)], abs=1e-6)
    for region, rows in h.groupby("region"):
        rr = {r.lags: r.rr_p99 for r in rows.itertuples()}
        assert rr[7] == 1 or rows["harvesting"].iloc[0] == pytest.approx(1 - (rr[35] - 1) / (rr[7] - 1))

    strata = run("stratum_fits")
    fitted = strata[strata["status"] == "success"]
    assert len(fitted), strata[["status", "reason"]]
    found = fitted.iloc[0]
    p3 = records(spark, SF).withColumnRenamed("o_orderstatus", "stratum").groupBy("region", "stratum", "date").count().join(R.exposure(spark, SF), ["region", "date"])
    curve = R.exposure_spline(p3)
    mine = p3.filter((F.col("region") == int(found["region"])) & (F.col("stratum") == found["stratum"])).toPandas().rename(columns={"count": "deaths"}).sort_values("date")
    beta, _, x, p = reference(mine, curve)
    d = curve.basis(np.array([np.quantile(x, 0.95)])) - curve.basis(np.array([found["mmt"]]))
    assert math.log(found["rr_p95"]) == pytest.approx((d @ (beta[:p].reshape(curve.df, 4) @ lag_basis(21, 4).basis(np.arange(22)).sum(axis=0)))[0], rel=1e-2, abs=5e-3)
    assert {"F", "O", "P"} == set(strata["stratum"]) and len(strata) == 15 and (strata.loc[strata["status"] == "skip", "n_rows"].notna()).all()


def test_extra_terms(spark, run, frame, main_spline):
    rows = one(frame, 1)
    x = rows["exposure"].to_numpy(float)
    hot = x > np.quantile(frame["exposure"].to_numpy(float), 0.95)
    wave, k = np.zeros(len(x)), 0
    while k < len(x):
        end = k
        while end < len(x) and hot[end]:
            end += 1
        if end - k >= 3:
            wave[k:end] = 1
        k = max(end, k + 1)
    from epispark.operators import timeseries as ts

    p = ts.attach_quantiles(panel(spark, SF), "exposure", {"p95": 0.95})
    p = ts.runs(p, F.col("exposure") > F.col("p95"), ["region"], min_length=3).withColumn("heatwave", F.col("in_run").cast("double"))
    fits = dlnm.fit_regions(dlnm.cross_basis(p, "exposure", main_spline), main_spline, extra=("heatwave",)).toPandas().set_index("region")
    beta, cov, _, n = reference(rows, main_spline, extra=wave)
    assert fits.loc[1, "extra_log_rr"] == pytest.approx(beta[n], rel=1e-4) and fits.loc[1, "extra_se"] == pytest.approx(math.sqrt(cov[n, n]), rel=1e-4)
    ok = fits[fits["extra_se"].between(1e-9, 10)]
    pooled = run("heatwave_effect")
    y, v = ok["extra_log_rr"].to_numpy(float), ok["extra_se"].to_numpy(float) ** 2
    assert pooled["fixed"].iloc[0] == pytest.approx((y / v).sum() / (1 / v).sum(), rel=1e-6) and pooled["k"].iloc[0] == len(ok) > 0
    assert pooled["rr"].iloc[0] == pytest.approx(math.exp(pooled["random"].iloc[0]))
    models = run("adjusted_models")
    main = run("dlnm_region_fit").set_index("region")
    for r in models[models["model"] == "main"].itertuples():
        assert r.rr_p99 == pytest.approx(main.loc[r.region, "rr_p99"], rel=1e-6)
    assert set(models["model"]) == {"main", "pm25", "flu"} and len(models) == 15
    daily = R.table(spark, SF, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(F.avg("l_discount").alias("pm25"), F.avg("l_tax").alias("flu")).toPandas()
    rows = rows.merge(daily, on="date", how="left").sort_values("date")
    ok = np.arange(len(rows)) >= 21  # the rows that the model uses
    v = rows["pm25"].to_numpy(float)
    q = np.quantile(v[ok], [0, 1 / 3, 2 / 3, 1])
    theirs = {"flu": rows["flu"].to_numpy(float), "pm25": NaturalSpline((q[0], q[3]), (q[1], q[2])).basis(v)}
    s = lag_basis(21, 4).basis(np.arange(22)).sum(axis=0)
    for name, more in theirs.items():
        beta, _, x, p = reference(rows, main_spline, extra=more)
        theta = beta[:p].reshape(main_spline.df, 4) @ s
        places = np.linspace(*np.quantile(x, [0.01, 0.99]), 100)
        mmt = places[np.argmin(main_spline.basis(places) @ theta)]
        d = main_spline.basis(np.quantile(x, [0.01, 0.99])) - main_spline.basis(np.array([mmt]))
        got = models[(models["model"] == name) & (models["region"] == 1)].iloc[0]
        assert np.allclose(np.log([got["rr_p1"], got["rr_p99"]]), d @ theta, rtol=1e-4, atol=1e-6)


def restricted(y, v, x, tau2):
    w = 1 / (v + tau2)
    a = x.T @ (x * w[:, None])
    b = np.linalg.solve(a, x.T @ (w * y))
    return -0.5 * (np.log(v + tau2).sum() + np.linalg.slogdet(a)[1] + (w * (y - x @ b) ** 2).sum()), b, np.linalg.inv(a)


def best_tau2(y, v, x):
    grid = np.r_[0, np.geomspace(1e-9, 1, 4000) * (np.var(y) + v.mean()) * 20]
    return grid[np.argmax([restricted(y, v, x, t)[0] for t in grid])]


def test_univariate_reml(spark, run):
    s = R.studies(spark, SF).toPandas()
    got = run("pool_reml").set_index("region")
    for region, rows in s.groupby("region"):
        y, v = rows["y"].to_numpy(float), rows["v"].to_numpy(float)
        x = np.ones((len(y), 1))
        tau2 = best_tau2(y, v, x)
        _, b, cov = restricted(y, v, x, tau2)
        r = got.loc[region]
        assert r["method"] == "reml" and r["tau2"] == pytest.approx(tau2, rel=0.02, abs=1e-6)
        assert r["y"] == pytest.approx(b[0], abs=1e-4) and r["se"] == pytest.approx(math.sqrt(cov[0, 0]), rel=0.02)
    # the fallback maximises the unrestricted likelihood
    rng = np.random.default_rng(2)
    v = rng.uniform(0.01, 0.05, 30)
    y = rng.normal(0.3, np.sqrt(v + 0.04))
    likelihood = lambda t: -0.5 * (np.log(v + t).sum() + ((y - ((y / (v + t)).sum() / (1 / (v + t)).sum())) ** 2 / (v + t)).sum())
    grid = np.linspace(0, 0.2, 20001)
    assert pooling.likelihood_tau2(y, v)[0] == pytest.approx(grid[np.argmax([likelihood(t) for t in grid])], abs=2e-5)
    few = spark.createDataFrame([("a", 0.1, 0.01)], "g string, y double, v double")
    assert pooling.pool_random(few, ["g"]).first()["method"] == "too few"


def test_meta_regression(spark, run):
    s = R.studies(spark, SF).join(R.nations(spark, SF), "nation").toPandas()
    got = run("meta_regression").set_index("moderator")
    y, v = s["y"].to_numpy(float), s["v"].to_numpy(float)
    for m in ("pop", "wealth"):
        z = s[m].to_numpy(float)
        x = np.column_stack([np.ones(len(z)), (z - z.mean()) / z.std(ddof=1)])
        tau2 = best_tau2(y, v, x)
        _, b, cov = restricted(y, v, x, tau2)
        assert got.loc[m, "slope"] == pytest.approx(b[1], abs=1e-4) and got.loc[m, "slope_se"] == pytest.approx(math.sqrt(cov[1, 1]), rel=0.02)
        assert got.loc[m, "p"] == pytest.approx(math.erfc(abs(got.loc[m, "z"]) / math.sqrt(2)))


def test_multivariate_reml_is_a_maximum():
    rng = np.random.default_rng(7)
    s = np.stack([np.diag(rng.uniform(0.02, 0.06, 2)) for _ in range(25)])
    y = rng.multivariate_normal([0.5, -0.2], [[0.09, 0.03], [0.03, 0.05]], 25) + np.stack([rng.multivariate_normal([0, 0], a) for a in s])
    mean, cov, psi, settled = pooling.multivariate_reml(y, s)

    def value(p):
        w = np.linalg.inv(s + p)
        a = w.sum(axis=0)
        m = np.linalg.solve(a, np.einsum("ijk,ik->j", w, y))
        return -0.5 * (np.linalg.slogdet(s + p)[1].sum() + np.linalg.slogdet(a)[1] + np.einsum("ij,ijk,ik->", y - m, w, y - m))

    assert settled and np.trace(psi) > 0
    best = value(psi)
    for _ in range(200):
        d = rng.normal(0, 0.004, (2, 2))
        trial = psi + d + d.T
        if np.linalg.eigvalsh(trial).min() > 0:
            assert value(trial) <= best + 1e-6
    assert np.allclose(np.linalg.inv(np.linalg.inv(s + psi).sum(axis=0)), cov)
    assert not pooling.multivariate_reml(y, s, steps=1)[3]
    # the gradient, by differences
    p0 = np.array([[0.05, 0.01], [0.01, 0.08]])
    gradient = pooling.restricted_likelihood(y, s, p0)[1]
    for i, j in ((0, 0), (0, 1), (1, 1)):
        e = np.zeros((2, 2))
        e[i, j] = e[j, i] = 1e-6
        assert (value(p0 + e) - value(p0 - e)) / 2e-6 == pytest.approx((gradient * e).sum() / 1e-6, rel=1e-5)


def test_multivariate_reml_at_the_edges():
    rng = np.random.default_rng(8)
    v = rng.uniform(0.5, 2, 30) * 1e-6  # estimates of any scale
    y = rng.normal(3e-3, 1e-3, 30) + rng.normal(0, np.sqrt(v))
    b, cov, tau2, settled = pooling.reml(y, v)
    mean, c, psi, also = pooling.multivariate_reml(y[:, None], v[:, None, None])
    assert settled and also and psi[0, 0] == pytest.approx(tau2, rel=1e-4) and mean[0] == pytest.approx(b[0], rel=1e-6) and c[0, 0] == pytest.approx(cov[0, 0], rel=1e-4)
    # no heterogeneity, or more coefficients than studies: an optimum of low rank, a positive covariance all the same
    for n, p, spread in ((20, 3, 0.0), (6, 8, 0.5)):
        a = rng.normal(size=(n, p, p))
        s = np.einsum("ijk,ilk->ijl", a, a) / p + 0.1 * np.eye(p)
        y = np.stack([rng.multivariate_normal(np.zeros(p), m) for m in s]) * (1 - spread) + spread * rng.normal(size=(n, 1))
        mean, cov, psi, settled = pooling.multivariate_reml(y, s)
        assert settled and np.array_equal(cov, cov.T) and np.linalg.eigvalsh(cov).min() > 0 and np.linalg.eigvalsh(psi).min() > -1e-9


def test_pooled_curve_percentiles_and_burden(spark, run, frame, main_spline):
    fits, spline, p = R.fitted_nations(spark, SF)
    region = fits.toPandas()
    region, frame = region[region["status"] == "success"], p.toPandas()
    assert len(region) >= 10  # the gate
    n = len(region["coef"].iloc[0])
    y = np.stack(region["coef"])
    s = np.stack([np.array(v).reshape(n, n) for v in region["vcov"]])
    s = s + 1e-6 * np.einsum("ijj->i", s)[:, None, None] / n * np.eye(n)
    pooled = R.pooled_fit(fits).first()
    psi, coef, vcov = np.array(pooled["psi"]).reshape(n, n), np.array(pooled["coef"]), np.array(pooled["vcov"]).reshape(n, n)
    w = np.linalg.inv(s + psi)
    assert pooled["method"] == "reml" and np.allclose(np.linalg.solve(w.sum(axis=0), np.einsum("ijk,ik->j", w, y)), coef, rtol=1e-5, atol=1e-7)
    assert np.allclose(np.linalg.inv(w.sum(axis=0)), vcov, rtol=1e-4) and np.linalg.eigvalsh(vcov).min() > 0
    het = run("pooled_heterogeneity").iloc[0]
    w = np.linalg.inv(s)
    r = y - np.linalg.solve(w.sum(axis=0), np.einsum("ijk,ik->j", w, y))
    q = np.einsum("ij,ijk,ik->", r, w, r)
    assert het["q"] == pytest.approx(q, rel=1e-5) and het["df"] == (len(y) - 1) * n and het["tau2_trace"] == pytest.approx(np.trace(psi)) and het["tau2_mean"] == pytest.approx(np.trace(psi) / n)
    z = ((het["q"] / het["df"]) ** (1 / 3) - 1 + 2 / (9 * het["df"])) / math.sqrt(2 / (9 * het["df"]))  # Wilson and Hilferty
    assert het["q_p"] == pytest.approx(math.erfc(z / math.sqrt(2)) / 2, abs=2e-3)
    middle = sum(spline.boundary) / 2
    for name, at in (("dlnm_pooled_curve", None), ("rr_curve", None), ("pooled_percentiles", None)):
        got = run(name)
        log_rr, se = dlnm.cumulative_rr(coef, vcov, spline, got["at"].to_numpy(), middle, 21, 4)
        assert np.allclose(np.log(got["rr"]), log_rr, atol=1e-6) and np.allclose(np.log(got["rr_hi"]), log_rr + 1.96 * se, atol=1e-6)
    assert len(run("dlnm_pooled_curve")) == 100 and np.allclose(np.diff(run("rr_curve")["at"]), 0.1)
    rows = run("pooled_percentiles").set_index("percentile")
    for k in dlnm.PERCENTILES:
        assert rows.loc[k, "at"] == pytest.approx(np.median(region[k]))
    log_rr, se = dlnm.cumulative_rr(coef, vcov, spline, rows["at"].to_numpy(), middle, 21, 4)
    assert np.allclose(rows["log_se"], se, atol=1e-8)

    # the Monte Carlo burden, row by row of the panel
    x, n = frame["exposure"].to_numpy(float), frame["deaths"].to_numpy(float)
    low, high = np.quantile(x, [0.01, 0.99])
    centre, _ = dlnm.minimum_risk(coef, vcov, spline, low, high, 21, 4)
    theta, v = dlnm.reduce_over_lags(coef, vcov, spline.df, 21, 4)
    rng = np.random.default_rng(9)
    d = spline.basis(x) - spline.basis(np.array([centre]))
    total = []
    for t in rng.multivariate_normal(theta, v, 400):
        log_rr = d @ t
        total.append((np.where(log_rr > 0, 1 - np.exp(-log_rr), 0) * n)[x != centre].sum())
    got = run("monte_carlo_burden").set_index("metric").loc["total_an"]
    assert got["mean"] == pytest.approx(np.mean(total), abs=4 * np.std(total) * math.sqrt(1 / 400 + 1 / 1000))
    wide = run("burden_intervals").set_index(["metric", "measure"])
    assert len(wide) == 21
    for k in ("mean", "median", "ci_lo", "ci_hi"):
        for metric in ("total_an", "cold_p1_an"):
            sums = run("monte_carlo_burden").set_index("metric").loc[metric, k]
            assert wide.loc[(metric, "total"), k] == pytest.approx(sums) and wide.loc[(metric, "af_pct"), k] == pytest.approx(sums / n.sum() * 100)
            assert wide.loc[(metric, "annual"), k] == pytest.approx(sums / frame["date"].nunique() * 365.25)
    assert got["ci_hi"] - got["ci_lo"] == pytest.approx(np.subtract(*np.quantile(total, [0.975, 0.025])), rel=0.2)


def conditional(rows, x, beta):
    """Score and information of the conditional likelihood from day counts, stratum by stratum."""
    score, info = np.zeros(len(beta)), np.zeros((len(beta), len(beta)))
    for _, at in rows.groupby("stratum").indices.items():
        n, z = rows["deaths"].to_numpy(float)[at], x[at]
        if len(at) < 3 or not n.sum():
            continue
        w = np.exp(z @ beta - (z @ beta).max())
        w /= w.sum()
        mean = w @ z
        score += n @ z - n.sum() * mean
        info += n.sum() * ((z.T * w) @ z - np.outer(mean, mean))
    return score, info


def test_conditional_models(spark, run):
    p = dense_panel(spark, SF).toPandas()
    p["stratum"] = [f"{r}|{d.year}_{d.month}_{d.isoweekday()}" for r, d in zip(p["region"], p["date"])]
    x = p["exposure"].to_numpy(float)
    got = run("conditional_logit").iloc[0]
    score, info = conditional(p, (x - x.mean())[:, None], np.array([got["log_or"]]))
    assert abs(score[0]) < 1e-5 * info[0, 0] and got["se"] == pytest.approx(1 / math.sqrt(info[0, 0]), rel=1e-6)
    two = run("conditional_logit_extremes").set_index("term")
    low, high = np.quantile(x, [0.05, 0.95])
    score, info = conditional(p, np.column_stack([x <= low + 1e-9, x > high + 1e-9]).astype(float), two.loc[["is_low", "is_high"], "log_or"].to_numpy())
    assert np.abs(np.linalg.solve(info, score)).max() < 1e-6
    assert np.allclose(two.loc[["is_low", "is_high"], "se"], np.sqrt(np.diag(np.linalg.inv(info))), rtol=1e-6)
    square = run("quadratic_logit").iloc[0]
    z = np.column_stack([x - x.mean(), x * x - (x * x).mean()])
    score, info = conditional(p, z, square[["log_or", "log_or_square"]].to_numpy(float))
    assert np.abs(np.linalg.solve(info, score)).max() < 1e-6
    b = square[["log_or", "log_or_square"]].to_numpy(float)
    assert square["optimum"] == pytest.approx(-b[0] / (2 * b[1]) if b[1] < 0 else np.median(x))
    assert matched.quadratic_optimum(np.array([2.0, -0.5]), 9.0) == 2.0

    strata = run("stratified_dlnm")
    assert list(strata["percentile"]) == list(dlnm.PERCENTILES) and strata["rr"].iloc[2] == 1 and strata["se"].iloc[2] == 0
    spline = R.exposure_spline(dense_panel(spark, SF), (0.5,))
    p = p.sort_values(["region", "date"]).reset_index(drop=True)
    cb = np.concatenate([cross(g["exposure"].to_numpy(float), spline, 7, 3) for _, g in p.groupby("region", sort=True)])
    ok = ~np.isnan(cb).any(axis=1)
    p, cb = p[ok].reset_index(drop=True), cb[ok]
    beta = np.zeros(cb.shape[1])
    for _ in range(30):
        score, info = conditional(p, cb - cb.mean(axis=0), beta)
        beta = beta + np.linalg.solve(info, score)
    theta = beta.reshape(spline.df, 3) @ lag_basis(7, 3).basis(np.arange(8)).sum(axis=0)
    d = spline.basis(strata["at"].to_numpy()) - spline.basis(strata["at"].to_numpy()[2:3])
    assert np.allclose(np.log(strata["rr"]), d @ theta, atol=1e-5)


def test_penalised_baseline_and_long_series(spark, run, frame):
    e, flat = run("penalised_baseline").sort_values("date"), run("excess_baseline").sort_values("date")
    assert set(e["status"]) == {"success"} and e["expected"].sum() == pytest.approx(e["deaths"].sum(), rel=1e-6) and (e["date"].to_numpy() == flat["date"].to_numpy()).all()
    for k in range(7):  # weekdays are not penalised
        assert abs(e["excess"][[d.weekday() == k for d in e["date"]]].sum()) < 1e-3 * e["deaths"].sum()
    assert 0 < e["expected"].std() < 2 * max(flat["expected"].std(), 1)

    fits = run("long_series_fit").set_index("level")
    assert set(fits.index) == {"all", "0", "1", "2", "3", "4"} and (fits["status"] == "success").all()
    p = dense_panel(spark, SF).toPandas()
    spline = R.exposure_spline(dense_panel(spark, SF))
    for level, rows in (("all", p), ("3", p[p["region"] == 3])):
        turn = np.array([d.timetuple().tm_yday for d in rows["date"]]) * 2 * math.pi / 365.25
        day = np.array([d.weekday() for d in rows["date"]])
        x = np.column_stack([np.ones(len(rows)), spline.basis(rows["exposure"].to_numpy(float)), np.sin(turn), np.cos(turn), *[(day == k).astype(float) for k in range(1, 7)]])
        beta, _ = poisson(x, rows["deaths"].to_numpy(float))
        assert fits.loc[level, "n_rows"] == len(rows) and np.allclose(x @ np.array(fits.loc[level, "coef"]), x @ beta, atol=1e-5)


def test_excess_baseline(spark, run):
    e = run("excess_baseline").sort_values("date")
    assert e["expected"].sum() == pytest.approx(e["deaths"].sum(), rel=1e-6)
    assert np.allclose(e["excess"], e["deaths"] - e["expected"]) and np.allclose(e["excess_pct"], e["excess"] / e["expected"] * 100)
    turn = np.array([d.timetuple().tm_yday for d in e["date"]]) * 2 * math.pi / 365.25
    for k in (1, 2, 3):  # the score equations of what the model holds
        assert abs((e["excess"] * np.sin(k * turn)).sum()) < 1e-3 * e["deaths"].sum() and abs((e["excess"] * np.cos(k * turn)).sum()) < 1e-3 * e["deaths"].sum()
    for k in range(7):
        assert abs(e["excess"][[d.weekday() == k for d in e["date"]]].sum()) < 1e-3 * e["deaths"].sum()


def test_stratum_difference(spark, run):
    r = records(spark, SF).select("region", "o_orderstatus", "o_totalprice").toPandas()
    for row in run("stratum_difference_p").itertuples():
        y = {s: np.log(g["o_totalprice"].to_numpy(float)) for s, g in r[r["region"] == row.region].groupby("o_orderstatus")}
        z = (y["F"].mean() - y["O"].mean()) / math.sqrt(y["F"].var(ddof=1) / len(y["F"]) + y["O"].var(ddof=1) / len(y["O"]))
        assert row.z == pytest.approx(z, rel=1e-6) and row.p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=1e-6)
