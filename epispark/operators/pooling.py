"""Pooling and meta-analysis."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epispark.functions.splines import NaturalSpline
from epispark.functions.stats import chi2_p, chi2_tail, is_finite, normal_p
from epispark.operators.dlnm import predict_rr


def ridge(vcov: Column, n: int, share: float = 1e-6) -> Column:
    """Add ``share`` of the mean variance to the diagonal of a flattened n x n matrix."""
    mean = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(vcov, i * (n + 1))), F.lit(0.0), lambda s, x: s + x) / n
    return F.transform(vcov, lambda v, i: F.when(i % (n + 1) == 0, v + share * mean).otherwise(v))


def valid_estimates(df: DataFrame, estimate: str = "y", variance: str = "v", largest: float = 100.0) -> DataFrame:
    """Finite estimates with a variance in (0, ``largest``)."""
    return df.filter(is_finite(F.col(estimate)) & is_finite(F.col(variance)) & (F.col(variance) > 0) & (F.col(variance) < largest))


def pool(studies: DataFrame, by: list[str], estimate: str = "y", variance: str = "v", min_studies: int = 1) -> DataFrame:
    """Fixed-effect and DerSimonian-Laird pooling with Q, I2, H2, tau2, from one aggregate of power sums and one more."""
    w, y = 1 / F.col(variance), F.col(estimate)
    sums = studies.groupBy(*by).agg(F.count(F.lit(1)).alias("k"), F.sum(w).alias("_w"), F.sum(w * y).alias("_wy"), F.sum(w * w).alias("_ww"))
    fixed = sums.filter(F.col("k") >= min_studies).withColumn("fixed", F.col("_wy") / F.col("_w")).withColumn("fixed_se", F.sqrt(1 / F.col("_w")))
    spread = _attach(studies, fixed.select(*by, "fixed"), by)
    q = spread.groupBy(*by).agg(F.sum(w * F.pow(y - F.col("fixed"), 2)).alias("q"))
    out = _attach(fixed, q, by)
    df = F.col("k") - 1
    c = F.col("_w") - F.col("_ww") / F.col("_w")
    tau2 = F.when((c > 0) & (df > 0), F.greatest(F.lit(0.0), (F.col("q") - df) / c)).otherwise(0.0)
    out = out.withColumns({"df": df, "tau2": tau2, "i2": F.when(F.col("q") > 0, F.greatest(F.lit(0.0), (F.col("q") - df) / F.col("q") * 100)).otherwise(0.0), "h2": F.when(df > 0, F.col("q") / df)})
    both = _attach(studies, out.select(*by, "tau2"), by)
    wr = 1 / (F.col(variance) + F.col("tau2"))
    random = both.groupBy(*by).agg((F.sum(wr * y) / F.sum(wr)).alias("random"), F.sqrt(1 / F.sum(wr)).alias("random_se"))
    return _attach(out, random, by).drop("_w", "_wy", "_ww")


def _attach(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    return left.join(right, by) if by else left.join(F.broadcast(right))


def heterogeneity(pooled: DataFrame) -> DataFrame:
    """Add the p-value of Q."""
    return pooled.withColumn("q_p", chi2_p(F.col("q").cast("double"), F.col("df").cast("double")))


def reml(y: np.ndarray, v: np.ndarray, x: np.ndarray | None = None, steps: int = 200) -> tuple[np.ndarray, np.ndarray, float, bool]:
    """(coefficients, covariance, tau2, settled) of a univariate random-effects (meta-)regression by Fisher scoring."""
    x = np.ones((len(y), 1)) if x is None else x
    tau2, settled = max(0.0, float(np.var(y) - v.mean())), False
    for _ in range(steps):
        w = 1 / (v + tau2)
        p = np.diag(w) - (x * w[:, None]) @ np.linalg.solve(x.T @ (x * w[:, None]), (x * w[:, None]).T)
        new = max(0.0, tau2 + (y @ p @ p @ y - np.trace(p)) / np.trace(p @ p))
        settled = abs(new - tau2) < 1e-9 * (tau2 + v.mean())
        tau2 = new
        if settled:
            break
    w = 1 / (v + tau2)
    cov = np.linalg.inv(x.T @ (x * w[:, None]))
    return cov @ (x.T @ (w * y)), cov, float(tau2), settled


def likelihood_tau2(y: np.ndarray, v: np.ndarray, steps: int = 5000) -> tuple[float, bool]:
    """(tau2, settled) of the random-effects model by maximum likelihood, from its fixed-point equation."""
    tau2 = max(0.0, float(np.var(y) - v.mean()))
    for _ in range(steps):
        w = 1 / (v + tau2)
        mean = (w * y).sum() / w.sum()
        new = max(0.0, float((w * w * ((y - mean) ** 2 - v)).sum() / (w * w).sum()))
        if abs(new - tau2) < 1e-10 * (tau2 + v.mean()):
            return new, True
        tau2 = new
    return tau2, False


def pool_random(studies: DataFrame, by: list[str], estimate: str = "y", variance: str = "v", min_studies: int = 6, largest: float = 100.0) -> DataFrame:
    """Univariate random effects by restricted maximum likelihood, each group of ``by`` (one row a region) in one task.

    Only estimates that ``valid_estimates`` lets through count. Falls back to maximum likelihood where the restricted steps
    don't settle; groups with fewer than ``min_studies`` have the method ``too few``, those where neither settles ``not settled`` and no
    estimates. Returns
    n_studies, method, y, se, tau2, rr, rr_lo, rr_hi (of a log relative risk).
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in studies.select(*by).schema.fields) + ", n_studies int, method string, y double, se double, tau2 double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        base = {k: pdf[k].iloc[0] for k in by} | {"n_studies": len(pdf)}
        if len(pdf) < max(2, min_studies):
            return pd.DataFrame([base | {"method": "too few", "y": None, "se": None, "tau2": None}])
        y, v = pdf[estimate].to_numpy(float), pdf[variance].to_numpy(float)
        method = "reml"
        try:
            b, cov, tau2, ok = reml(y, v)
            ok = ok and np.isfinite([b[0], cov[0, 0], tau2]).all()
        except np.linalg.LinAlgError:
            ok = False
        if not ok:
            method = "ml"
            tau2, ok = likelihood_tau2(y, v)
            if not ok:
                return pd.DataFrame([base | {"method": "not settled", "y": None, "se": None, "tau2": None}])
            w = 1 / (v + tau2)
            b, cov = np.array([(w * y).sum() / w.sum()]), np.array([[1 / w.sum()]])
        return pd.DataFrame([base | {"method": method, "y": float(b[0]), "se": float(np.sqrt(cov[0, 0])), "tau2": float(tau2)}])

    out = valid_estimates(studies, estimate, variance, largest).select(*by, estimate, variance).groupBy(*by).applyInPandas(run, schema)
    bound = lambda z: F.exp(F.col("y") + z * F.col("se"))
    return out.withColumns({"rr": F.exp("y"), "rr_lo": bound(-1.96), "rr_hi": bound(1.96)})


def restricted_likelihood(y: np.ndarray, s: np.ndarray, psi: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(log-likelihood, its gradient by psi, mean, the mean's covariance, weights) of a multivariate random-effects model, restricted."""
    factor = np.linalg.cholesky(s + psi)
    half = np.linalg.inv(factor)
    w = np.einsum("ikj,ikl->ijl", half, half)
    total = w.sum(axis=0)
    root = np.linalg.inv(np.linalg.cholesky(total))
    cov = root.T @ root
    mean = cov @ np.einsum("ijk,ik->j", w, y)
    r = y - mean
    wr = np.einsum("ijk,ik->ij", w, r)
    value = -np.log(np.einsum("ijj->ij", factor)).sum() - 0.5 * (r * wr).sum() + np.log(np.diag(root)).sum()
    gradient = 0.5 * (wr.T @ wr - total + np.einsum("ijk,kl,ilm->jm", w, cov, w))
    return float(value), (gradient + gradient.T) / 2, mean, cov, w


def multivariate_reml(y: np.ndarray, s: np.ndarray, steps: int = 5000, tolerance: float = 1e-5) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """(mean, its covariance, between-study matrix psi, settled) by quasi-Newton steps (BFGS) on the Cholesky factor of psi.

    psi = L L' stays positive semidefinite wherever L goes, so optima of lower rank are reached as others are. It has settled when no element
    of the restricted likelihood's gradient by L is above ``tolerance`` a study. Estimates are scaled by their mean variances first, and
    covariances come from Cholesky factors, so they are symmetric and positive.
    """
    n, p = y.shape
    unit = np.sqrt(np.einsum("ijj->j", s) / n)
    y, s = y / unit, s / np.outer(unit, unit)
    spread = np.cov(y.T).reshape(p, p) if n > 1 else np.zeros((p, p))
    low = np.tril_indices(p)

    def at(entries: np.ndarray) -> tuple[float, np.ndarray, tuple, np.ndarray]:
        factor = np.zeros((p, p))
        factor[low] = entries
        psi = factor @ factor.T
        try:
            value, gradient, mean, cov, _ = restricted_likelihood(y, s, psi)
        except np.linalg.LinAlgError:
            return np.inf, np.zeros(len(entries)), (), psi
        return -value, -(2 * gradient @ factor)[low], (mean, cov), psi

    x = np.linalg.cholesky(spread / 2 + 0.01 * np.eye(p))[low]
    value, g, found, psi = at(x)
    inverse, settled = np.eye(len(x)) / max(np.abs(g).max(), 1.0), False
    for _ in range(steps):
        settled = bool(np.abs(g).max() < tolerance * n)
        if settled:
            break
        move = -inverse @ g
        if move @ g >= 0:
            inverse = np.eye(len(x)) / max(np.abs(g).max(), 1.0)
            move = -inverse @ g
        step, low_step, high_step = 1.0, 0.0, np.inf
        for _ in range(40):  # bisection to a step that falls enough and flattens (weak Wolfe conditions)
            trial = at(x + step * move)
            if not trial[0] <= value + 1e-4 * step * (move @ g) + 1e-13 * abs(value):
                high_step = step
            elif trial[1] @ move < 0.9 * (move @ g):
                low_step = step
            else:
                break
            step = (low_step + high_step) / 2 if np.isfinite(high_step) else 2 * low_step
        if not np.isfinite(trial[0]):
            break
        dx, dg = step * move, trial[1] - g
        x, (value, g, found, psi) = x + dx, trial
        if (curve := dx @ dg) > 1e-14:
            hg = inverse @ dg
            inverse = inverse + (1 + dg @ hg / curve) * np.outer(dx, dx) / curve - (np.outer(hg, dx) + np.outer(dx, hg)) / curve
    mean, cov = found
    return mean * unit, cov * np.outer(unit, unit), psi * np.outer(unit, unit), settled


def pool_multivariate(fits: DataFrame, by: list[str], coef: str = "coef", vcov: str = "vcov", min_studies: int = 10) -> DataFrame:
    """Pool coefficient vectors by restricted maximum likelihood, each group of ``by`` in one task.

    A group holds one row a region (thousands at most). Returns n_studies, method, coef, vcov, psi (flattened by columns), the trace and the mean of
    psi's diagonal (tau2_trace, tau2_mean), q, df, q_p, i2 and h2. The method is ``reml``, or ``too few`` for groups with fewer than
    ``min_studies``, or ``not settled``; both of these have no estimates (the heterogeneity about the fixed-effect mean needs none of the steps, and
    stays).
    """
    names = ["coef", "vcov", "psi"]
    numbers = ["tau2_trace", "tau2_mean", "q", "q_p", "i2", "h2"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fits.select(*by).schema.fields) + (", " if by else "") + ", ".join(["n_studies int, method string", *(f"{n} array<double>" for n in names), *(f"{n} double" for n in numbers), "df int"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        base = {k: pdf[k].iloc[0] for k in by} | {"n_studies": len(pdf)} | dict.fromkeys([*names, *numbers, "df"])
        if len(pdf) < max(2, min_studies):
            return pd.DataFrame([base | {"method": "too few"}])
        y = np.stack(pdf[coef].to_numpy())
        p = y.shape[1]
        s = np.stack([np.asarray(v).reshape(p, p, order="F") for v in pdf[vcov]])
        s = (s + s.transpose(0, 2, 1)) / 2 + 1e-6 * np.einsum("ijj->i", s)[:, None, None] / p * np.eye(p)
        w = np.linalg.inv(s)
        fixed = np.linalg.solve(w.sum(axis=0), np.einsum("ijk,ik->j", w, y))
        r = y - fixed
        q = float(np.einsum("ij,ijk,ik->", r, w, r))
        df = (len(y) - 1) * p
        base |= {"q": q, "df": df, "q_p": chi2_tail(q, df), "i2": max(0.0, (q - df) / q * 100) if q > 0 else 0.0, "h2": q / df}
        try:
            mean, cov, psi, settled = multivariate_reml(y, s)
        except np.linalg.LinAlgError:
            settled = False
        if not settled:
            return pd.DataFrame([base | {"method": "not settled"}])
        found = {"coef": mean.tolist(), "vcov": cov.ravel(order="F").tolist(), "psi": psi.ravel(order="F").tolist(), "tau2_trace": float(np.trace(psi)), "tau2_mean": float(np.trace(psi) / p)}
        return pd.DataFrame([base | found | {"method": "reml"}])

    ready = fits.select(*by, coef, vcov).withColumn("_all", F.lit(1))
    return ready.groupBy(*(by or ["_all"])).applyInPandas(run, schema)


def meta_regression(studies: DataFrame, by: list[str], moderator: str, estimate: str = "y", variance: str = "v", min_studies: int = 10) -> DataFrame:
    """Random-effects regression on one (z-scored) moderator per group: slope, intercept, their errors, z and p.

    Unpivot moderators and effects into ``by`` to fit them all in one job. Groups are one row a region. status is success, skip (fewer than
    ``min_studies``, or a constant moderator) or not settled; only success has estimates.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in studies.select(*by).schema.fields) + ", n_studies int, status string, intercept double, intercept_se double, slope double, slope_se double, tau2 double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        base = {k: pdf[k].iloc[0] for k in by}
        pdf = pdf.dropna()
        out = dict.fromkeys(("intercept", "intercept_se", "slope", "slope_se", "tau2")) | {"status": "skip"}
        if len(pdf) >= max(3, min_studies) and pdf[moderator].std() > 0:
            b, cov, tau2, settled = reml(pdf[estimate].to_numpy(float), pdf[variance].to_numpy(float), np.column_stack([np.ones(len(pdf)), pdf[moderator].to_numpy(float)]))
            out["status"] = "success" if settled else "not settled"
            if settled:
                out |= {"intercept": b[0], "intercept_se": np.sqrt(cov[0, 0]), "slope": b[1], "slope_se": np.sqrt(cov[1, 1]), "tau2": tau2}
        return pd.DataFrame([base | {"n_studies": len(pdf)} | out])

    fitted = studies.select(*by, moderator, estimate, variance).groupBy(*by).applyInPandas(run, schema)
    return fitted.withColumn("z", F.col("slope") / F.nullif(F.col("slope_se"), F.lit(0.0))).withColumn("p", normal_p("z"))


def stratum_difference(pooled: DataFrame, by: list[str], stratum: str, first: str, second: str, estimate: str = "y", se: str = "se") -> DataFrame:
    """first minus second on the log scale: diff, diff_se, z, p (two-sided, normal), rr_ratio."""
    side = lambda s, n: pooled.filter(F.col(stratum) == s).select(*by, F.col(estimate).alias(f"_y{n}"), F.col(se).alias(f"_s{n}"))
    out = _attach(side(first, 1), side(second, 2), by)
    out = out.withColumns({"diff": F.col("_y1") - F.col("_y2"), "diff_se": F.sqrt(F.col("_s1") * F.col("_s1") + F.col("_s2") * F.col("_s2"))})
    return out.withColumns({"z": F.col("diff") / F.nullif(F.col("diff_se"), F.lit(0.0)), "rr_ratio": F.exp("diff")}).withColumn("p", normal_p("z")).drop("_y1", "_y2", "_s1", "_s2")


def harvesting_ratio(rr: DataFrame, by: list[str], horizon: str = "lags", value: str = "rr", short: int = 7, long: int = 35) -> DataFrame:
    """1 - ERR(long) / ERR(short), ERR = RR - 1; null where the short one is zero."""
    at = lambda h: F.max(F.when(F.col(horizon) == h, F.col(value) - 1))
    out = rr.groupBy(*by).agg(at(short).alias("err_short"), at(long).alias("err_long"))
    return out.withColumn("harvesting", 1 - F.col("err_long") / F.nullif(F.col("err_short"), F.lit(0.0)))


def compare_models(results: DataFrame, baseline: str, by: list[str], model: str = "model", value: str = "rr") -> DataFrame:
    """Percent change of each model's value against the baseline model's."""
    base = results.filter(F.col(model) == baseline).select(*by, F.col(value).alias("_base"))
    out = _attach(results.filter(F.col(model) != baseline), base, by)
    return out.withColumn("pct_change", (F.col(value) - F.col("_base")) / F.nullif(F.col("_base"), F.lit(0.0)) * 100).drop("_base")


def pooled_percentiles(pooled: DataFrame, spline: NaturalSpline, medians: DataFrame, percentiles: list[str], centre: Column, lags: int = 21, lag_df: int = 4) -> DataFrame:
    """The pooled curve at percentiles of the exposure (columns of the one-row ``medians``), one row each: percentile,
    at, rr, rr_lo, rr_hi, log_rr, and log_se as it follows from the interval."""
    places = F.array(*[F.struct(F.lit(p).alias("percentile"), F.col(p).alias("x")) for p in percentiles])
    joined = pooled.join(F.broadcast(medians.select(*percentiles))).withColumn("_p", F.explode(places))
    rows = predict_rr(joined.withColumn("percentile", F.col("_p.percentile")), spline, F.array("_p.x"), centre, lags, lag_df)
    return rows.select("percentile", "at", "rr", "rr_lo", "rr_hi", "log_rr", se_from_interval(F.col("rr_lo"), F.col("rr_hi")).alias("log_se"))


def se_from_interval(low: Column, high: Column, log: bool = True) -> Column:
    """Standard error behind a 95 % interval, on the log scale or (as some published tables have it) the ratio scale."""
    return (F.log(high) - F.log(low)) / (2 * 1.96) if log else (high - low) / (2 * 1.96)
