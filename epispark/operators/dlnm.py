"""Distributed-lag non-linear models per region.

The cross-basis is made of column expressions over one window, or, where several models are fitted, of the series itself in the task that
fits it. Fits run as grouped-map tasks, one bounded group (a region's days) each; regions, strata and models are all part of the group
key, so any number of fits is one job over one scan. Coefficients come back as rows. Series too long for one task are
``additive.fit_long``'s.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epispark.functions.splines import NaturalSpline, lag_basis


def cross_basis(panel: DataFrame, exposure: str, spline: NaturalSpline, lags: int = 21, lag_df: int = 4, by: tuple[str, ...] = ("region",), order: str = "date", out: str = "cb") -> DataFrame:
    """Add ``out``: array of spline.df * lag_df values, sum over lags of exposure basis times lag basis.

    Null where a series has less than ``lags`` rows before, or a gap in the exposure. Element j * lag_df + k
    belongs to exposure function j and lag function k.
    """
    weights = lag_basis(lags, lag_df).basis(np.arange(lags + 1))
    w = Window.partitionBy(*by).orderBy(order)
    names = [f"_b{j}" for j in range(spline.df)]
    based = panel.withColumns(dict(zip(names, spline.columns(F.col(exposure)))))
    frame = w.rowsBetween(-lags, 0)
    seen = based.withColumns({f"_h{n}": F.collect_list(n).over(frame) for n in names})  # oldest first; nulls are left out
    terms = []
    for n in names:
        for k in range(lag_df):
            lagged = F.array(*[F.lit(float(v)) for v in weights[::-1, k]])
            terms.append(F.aggregate(F.zip_with(F.col(f"_h{n}"), lagged, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))
    full = F.size(f"_h{names[0]}") == lags + 1
    return seen.withColumn(out, F.when(full, F.array(*terms))).drop(*names, *[f"_h{n}" for n in names])


def cross_matrix(x: np.ndarray, spline: NaturalSpline, lags: int, lag_df: int) -> np.ndarray:
    """The cross-basis of an ordered series, one row a value: NaN where ``cross_basis`` is null."""
    weights = lag_basis(lags, lag_df).basis(np.arange(lags + 1))
    basis, out = spline.basis(x), np.full((len(x), spline.df * lag_df), np.nan)
    if len(x) > lags:
        total = np.zeros((len(x) - lags, spline.df, lag_df))
        for lag in range(lags, -1, -1):
            total += basis[lags - lag : len(x) - lag, :, None] * weights[lag]
        out[lags:] = total.reshape(len(total), -1)
    return out


def lowest(curve: DataFrame, by: list[str], at: str = "at", value: str = "rr") -> DataFrame:
    """The place of the smallest value of each curve, ties to the lowest place: at, value."""
    least = F.min(F.struct(F.col(value).alias("value"), F.col(at).alias("at")))
    return curve.groupBy(*by).agg(least.alias("_m")).select(*by, F.col("_m.at").alias(at), F.col("_m.value").alias(value))


def fit_quasi_poisson(x: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[np.ndarray, np.ndarray, float, np.ndarray, bool]:
    """(coefficients, covariance, dispersion, kept columns, settled): iteratively reweighted least squares with step halving.

    Columns that depend on earlier ones are dropped; the covariance is the dispersion (Pearson chi-square
    over the degrees of freedom) times the inverse information.
    """
    scale = np.sqrt((x * x).sum(axis=0))
    kept: list[int] = []
    basis = np.zeros((len(y), 0))
    for j in range(x.shape[1]):  # modified Gram-Schmidt against what is kept
        v = x[:, j].astype(float)
        for _ in range(2):
            v = v - basis @ (basis.T @ v)
        if np.linalg.norm(v) > 1e-7 * max(scale[j], 1e-300):
            basis = np.column_stack([basis, v / np.linalg.norm(v)])
            kept.append(j)
    z = x[:, kept]
    unit = np.sqrt((z * z).mean(axis=0))
    z = z / unit
    beta = np.zeros(z.shape[1])
    mu = y + 0.1
    eta = np.log(mu)
    deviance, done = np.inf, False
    for _ in range(steps):
        root = np.sqrt(mu)
        q, r = np.linalg.qr(z * root[:, None])
        new = np.linalg.solve(r, q.T @ (root * (eta + (y - mu) / mu)))
        for _ in range(30):
            trial = np.clip(z @ new, -30, 30)
            m = np.exp(trial)
            dev = 2 * np.sum(np.where(y > 0, y * np.log(np.maximum(y, 1e-300) / m), 0) - (y - m))
            if np.isfinite(dev) and (dev <= deviance + 1e-10 * (abs(deviance) + 0.1) or not np.isfinite(deviance)):
                break
            new = (new + beta) / 2
        done = abs(dev - deviance) < 1e-11 * (abs(dev) + 0.1)
        beta, eta, mu, deviance = new, trial, m, dev
        if done:
            break
    dispersion = float(np.sum((y - mu) ** 2 / mu) / max(len(y) - len(kept), 1))
    inverse = np.linalg.inv(np.linalg.qr(z * np.sqrt(mu)[:, None], mode="r"))
    covariance = dispersion * inverse @ inverse.T
    return beta / unit, covariance / np.outer(unit, unit), dispersion, np.array(kept), bool(done)


def reduce_over_lags(coef: np.ndarray, vcov: np.ndarray, spline_df: int, lags: int, lag_df: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and covariance of the cumulative association: the lag basis summed over the lags."""
    s = lag_basis(lags, lag_df).basis(np.arange(lags + 1)).sum(axis=0)
    m = np.kron(np.eye(spline_df), s)
    return m @ coef, m @ vcov @ m.T


def cumulative_rr(coef: np.ndarray, vcov: np.ndarray, spline: NaturalSpline, at: np.ndarray, centre: float, lags: int, lag_df: int) -> tuple[np.ndarray, np.ndarray]:
    """(log relative risk, standard error) at the points ``at`` against ``centre``, by the delta method."""
    theta, v = reduce_over_lags(coef, vcov, spline.df, lags, lag_df)
    d = spline.basis(np.asarray(at, dtype=float)) - spline.basis(np.array([centre], dtype=float))
    return d @ theta, np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", d, v, d), 0))


def minimum_risk(coef: np.ndarray, vcov: np.ndarray, spline: NaturalSpline, low: float, high: float, lags: int, lag_df: int, points: int = 100) -> tuple[float, bool]:
    """The exposure of minimal cumulative risk on a grid, and whether it is at the grid's edge."""
    x = np.linspace(low, high, points)
    theta, _ = reduce_over_lags(coef, vcov, spline.df, lags, lag_df)
    k = int(np.argmin(spline.basis(x) @ theta))
    return float(x[k]), k in (0, points - 1)


#: Percentiles at which the relative risk is reported; the minimum is looked for between the outer ones.
PERCENTILES = {"p1": 0.01, "p5": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99}

FIT_SCHEMA = ", ".join([
    "status string, reason string, n_rows bigint, n_deaths double, n_params int, dispersion double, mmt double, mmt_at_boundary boolean",
    *[f"{p} double" for p in PERCENTILES],
    *[f"rr_{p}{side} double" for p in PERCENTILES for side in ("", "_lo", "_hi")],
    "extra_log_rr double, extra_se double, coef array<double>, vcov array<double>",
])


@dataclass(frozen=True)
class Model:
    """A specification: exposure spline, lags, what else is in it, and smoothness of the season."""

    spline: NaturalSpline
    lags: int = 21
    lag_df: int = 4
    extra: tuple[str, ...] = ()
    splined: tuple[str, ...] = ()
    df_per_year: float = 7


def season_columns(day: np.ndarray, df_per_year: float) -> np.ndarray:
    """Intercept, natural spline of time with knots at its quantiles, weekdays. ``day`` counts from 1970-01-01 and ascends."""
    years = max((day[-1] - day[0]) / 365.25, 1e-9)
    season = NaturalSpline((day[0], max(day[-1], day[0] + 1)), tuple(np.quantile(day, np.linspace(0, 1, max(2, round(df_per_year * years) + 1))[1:-1])))
    return np.hstack([np.ones((len(day), 1)), season.basis(day), np.eye(7)[((day.astype(int) + 3) % 7)][:, 1:]])


def fit_series(cross: np.ndarray, x: np.ndarray, y: np.ndarray, day: np.ndarray, others: dict[str, np.ndarray], model: Model, centre: float | None) -> dict:
    """One model of one series, whose rows are all usable: the columns of ``FIT_SCHEMA`` but for the counts."""
    curve, p = model.spline, cross.shape[1]
    if y.sum() <= 0:
        return {"status": "error", "reason": "no events"}
    parts = [cross, *[others[c][:, None] for c in model.extra]]
    for c in model.splined:
        q = np.quantile(others[c], [0, 1 / 3, 2 / 3, 1])
        parts.append(NaturalSpline((q[0], max(q[3], q[0] + 1e-9)), (q[1], q[2])).basis(others[c]) if q[0] < q[1] < q[2] < q[3] else others[c][:, None])
    beta, cov, dispersion, kept, settled = fit_quasi_poisson(np.hstack([*parts, season_columns(day, model.df_per_year)]), y)
    if not settled:
        return {"status": "not settled", "reason": "the deviance still changed in the last step"}
    if not (kept[:p] == np.arange(p)).all():
        return {"status": "error", "reason": "cross-basis is not of full rank"}
    coef, vcov = beta[:p], cov[:p, :p]
    if not np.isfinite(vcov).all() or not np.isfinite(coef).all() or (np.diag(vcov) <= 0).any():
        return {"status": "error", "reason": "covariance is not finite and positive"}
    at = np.quantile(x, list(PERCENTILES.values()))
    mmt, edge = minimum_risk(coef, vcov, curve, at[0], at[-1], model.lags, model.lag_df) if centre is None else (float(centre), False)
    rr, se = cumulative_rr(coef, vcov, curve, at, mmt, model.lags, model.lag_df)
    out = {"status": "success", "n_params": len(kept), "dispersion": dispersion, "mmt": mmt, "mmt_at_boundary": edge, "coef": coef.tolist(), "vcov": vcov.ravel(order="F").tolist()}
    for i, name in enumerate(PERCENTILES):
        out |= {name: at[i], f"rr_{name}": float(np.exp(rr[i])), f"rr_{name}_lo": float(np.exp(min(rr[i] - 1.96 * se[i], 700))), f"rr_{name}_hi": float(np.exp(min(rr[i] + 1.96 * se[i], 700)))}
    if model.extra and p in kept:
        place = int(np.flatnonzero(kept == p)[0])
        out |= {"extra_log_rr": float(beta[place]), "extra_se": float(np.sqrt(cov[place, place]))}
    return out


def _fit_groups(ready: DataFrame, keys: tuple[str, ...], model_of, cross_of, deaths: str, exposure: str, date: str, min_rows: int, centre: float | str | None) -> DataFrame:
    """Fit each group of ``keys``. ``model_of(pdf)`` is its model, ``cross_of(pdf, model)`` its cross-basis, the rows being in order."""
    ready = ready.withColumn(date, F.datediff(date, F.lit("1970-01-01").cast("date")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ready.select(*keys).schema.fields) + ", " + FIT_SCHEMA

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        base = {k: pdf[k].iloc[0] for k in keys} | {n.split()[0]: None for n in FIT_SCHEMA.split(", ")}
        base["n_rows"], base["n_deaths"] = len(pdf), float(pdf[deaths].sum())
        try:
            model = model_of(pdf)
            reference = pdf[centre].iloc[0] if isinstance(centre, str) else centre
            if isinstance(centre, str) and pd.isna(reference):
                return pd.DataFrame([base | {"status": "skip", "reason": "no reference exposure"}])
            pdf = pdf.sort_values(date)
            cross = cross_of(pdf, model)
            used = pdf[[deaths, exposure, *model.extra, *model.splined]].notna().all(axis=1).to_numpy() & np.isfinite(cross).all(axis=1)
            if used.sum() < min_rows:
                return pd.DataFrame([base | {"status": "skip", "reason": f"{used.sum()} usable rows, {min_rows} needed"}])
            column = {c: pdf[c].to_numpy(float)[used] for c in dict.fromkeys((exposure, deaths, date, *model.extra, *model.splined))}
            return pd.DataFrame([base | fit_series(cross[used], column[exposure], column[deaths], column[date], column, model, reference)])
        except (np.linalg.LinAlgError, FloatingPointError, ValueError) as e:
            return pd.DataFrame([base | {"status": "error", "reason": str(e)[:200]}])

    return ready.groupBy(*keys).applyInPandas(fit, schema)


def fit_regions(
    panel: DataFrame,
    spline: NaturalSpline,
    keys: tuple[str, ...] = ("region",),
    deaths: str = "deaths",
    exposure: str = "exposure",
    date: str = "date",
    cb: str = "cb",
    lags: int = 21,
    lag_df: int = 4,
    df_per_year: float = 7,
    min_rows: int = 365,
    extra: tuple[str, ...] = (),
    splined: tuple[str, ...] = (),
    centre: float | str | None = None,
) -> DataFrame:
    """Fit deaths ~ cross-basis + ns(time) + weekday (+ extra columns, + ns(df=3) of ``splined``) for each key.

    One row a key with status success, skip (fewer than ``min_rows`` usable rows), not settled (no estimates are given then) or
    error; errors stay in their row. The first of ``extra`` is reported as extra_log_rr. ``centre`` fixes the
    reference exposure, or names a column with each group's own; groups without one are skipped.
    """
    model, width = Model(spline, lags, lag_df, tuple(extra), tuple(splined), df_per_year), spline.df * lag_df
    names = [*keys, date, deaths, exposure, cb, *extra, *splined, *((centre,) if isinstance(centre, str) else ())]

    def cross_of(pdf: pd.DataFrame, _: Model) -> np.ndarray:
        return np.stack([np.full(width, np.nan) if v is None else np.asarray(v, float) for v in pdf[cb]])

    return _fit_groups(panel.select(*dict.fromkeys(names)), keys, lambda _: model, cross_of, deaths, exposure, date, min_rows, centre)


def fit_models(
    panel: DataFrame,
    models: dict[str, Model],
    keys: tuple[str, ...] = ("region",),
    deaths: str = "deaths",
    exposure: str = "exposure",
    date: str = "date",
    min_rows: int = 365,
    centre: float | str | None = None,
) -> DataFrame:
    """Fits of each model (column ``model``) and key, in one job over one scan of the panel.

    The panel's few columns are exploded by the models' names; a task makes the cross-basis from the series that it
    fits, so no histories are collected, sorted or moved for each model. Rows as of ``fit_regions``.
    """
    names = [*keys, date, deaths, exposure, *(c for m in models.values() for c in (*m.extra, *m.splined)), *((centre,) if isinstance(centre, str) else ())]
    long = panel.select(*dict.fromkeys(names), F.explode(F.array(*[F.lit(n) for n in models])).alias("model"))

    def cross_of(pdf: pd.DataFrame, model: Model) -> np.ndarray:
        return cross_matrix(pdf[exposure].to_numpy(float), model.spline, model.lags, model.lag_df)

    return _fit_groups(long, (*keys, "model"), lambda pdf: models[pdf["model"].iloc[0]], cross_of, deaths, exposure, date, min_rows, centre)


def fit_grid(panel: DataFrame, splines: dict[str, NaturalSpline], specs: list[tuple[int, str, int]], keys: tuple[str, ...] = ("region",), **options) -> DataFrame:
    """``fit_models`` for each specification (lags, name of the exposure's spline, lag_df).

    Adds the columns lags, spline and lag_df to the key, and exposure_df.
    """
    models = {f"{lags}|{name}|{lag_df}": Model(splines[name], lags, lag_df) for lags, name, lag_df in specs}
    fits = fit_models(panel, models, keys, **options)
    part = F.split("model", "[|]")
    sizes = F.create_map(*[F.lit(v) for name, s in splines.items() for v in (name, s.df)])
    spec = {"lags": part[0].cast("int"), "spline": part[1], "lag_df": part[2].cast("int"), "exposure_df": F.element_at(sizes, part[1])}
    return fits.withColumns(spec).drop("model")


def predict_rr(fits: DataFrame, spline: NaturalSpline, at: Column, centre: Column, lags: int = 21, lag_df: int = 4, prefix: str = "") -> DataFrame:
    """Explode an array of exposures ``at`` to rows with at, rr, rr_lo, rr_hi (and log_rr, se), by column expressions."""
    from epispark.functions.stats import dot, quadratic_form

    s = lag_basis(lags, lag_df).basis(np.arange(lags + 1)).sum(axis=0)
    p = spline.df
    summed = F.array(*[F.lit(float(v)) for v in s])
    theta = F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda j: dot(F.slice("coef", j * lag_df + 1, lag_df), summed))
    # covariance of the reduced coefficients, by columns: element (i, j) sums s_k s_l V[i * lag_df + k, j * lag_df + l]
    n = p * lag_df
    v = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda j: F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda i: F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(lag_df - 1)), lambda m: F.get(summed, m) * dot(F.slice("vcov", (j * lag_df + m) * n + i * lag_df + 1, lag_df), summed)), F.lit(0.0), lambda a, x: a + x))))
    rows = fits.withColumns({"_theta": theta, "_v": v, "_c": centre}).withColumn("at", F.explode(at))
    d = F.array(*[a - b for a, b in zip(spline.columns(F.col("at")), spline.columns(F.col("_c")))])
    rows = rows.withColumn("_d", d)
    rows = rows.withColumns({"log_rr": dot(F.col("_d"), F.col("_theta")), "se": F.sqrt(F.greatest(quadratic_form(F.col("_d"), F.col("_v"), p), F.lit(0.0)))})
    bound = lambda z: F.exp(F.col("log_rr") + z * F.col("se"))
    return rows.withColumns({"rr": F.exp("log_rr"), "rr_lo": bound(-1.96), "rr_hi": bound(1.96)}).drop("_theta", "_v", "_c", "_d")
