"""Time-stratified case-crossover."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epispark.functions.splines import NaturalSpline


def stratum_key(date: Column | str) -> Column:
    """year_month_weekday (Monday 1)."""
    d = F.col(date) if isinstance(date, str) else date
    return F.concat_ws("_", F.year(d), F.month(d), F.weekday(d) + 1)


def matched_sets(cases: DataFrame, days: DataFrame, case_id: str, date: str = "date", by: list[str] | None = None, min_controls: int = 2) -> DataFrame:
    """(case_id, date, is_case): each case's day and its control days of the same stratum.

    ``days`` are the days that may serve (those with a full lag history). Cases with fewer than
    ``min_controls`` controls are left out. A stratum has five days at most, so the equi-join is bounded.
    """
    keys = [*(by or []), "_s"]
    left = cases.select(case_id, *(by or []), F.col(date).alias("_case"), stratum_key(date).alias("_s"))
    right = days.select(*(by or []), F.col(date).alias("_day"), stratum_key(date).alias("_s")).distinct()
    sizes = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    joined = left.join(right.join(sizes, keys).filter(F.col("_n") > min_controls), keys)
    own = right.select(*keys, F.col("_day").alias("_case"))
    valid = joined.join(own, [*keys, "_case"], "left_semi")
    return valid.select(case_id, *(by or []), F.col("_day").alias(date), (F.col("_day") == F.col("_case")).cast("int").alias("is_case"))


def matched_summary(sets: DataFrame) -> DataFrame:
    cases, controls = F.sum("is_case"), F.sum(1 - F.col("is_case"))
    return sets.agg(cases.alias("n_cases"), controls.alias("n_controls"), (controls / F.nullif(cases, F.lit(0))).alias("controls_per_case"))


def collapse(sets: DataFrame, keys: list[str]) -> DataFrame:
    """Cases and observations by (date, stratum)."""
    return sets.groupBy(*keys).agg(F.sum("is_case").alias("cases"), F.count(F.lit(1)).alias("observations"))


def stratum_counts(days: DataFrame, counts: str, covariates: list[str], date: str = "date", by: list[str] | None = None) -> DataFrame:
    """The sufficient statistics: one row a day with its stratum, its count of cases and its covariates."""
    return days.select(*(by or []), F.concat_ws("|", *(by or []), stratum_key(date)).alias("stratum"), F.col(counts).cast("double").alias("n"), *[F.col(c).cast("double").alias(c) for c in covariates])


def stratum_dates(days: DataFrame, date: str = "date") -> DataFrame:
    return days.groupBy(stratum_key(date).alias("stratum")).agg(F.sort_array(F.collect_list(date)).alias("dates"))


def conditional_logit(counts: DataFrame, covariates: list[str], stratum: str = "stratum", n: str = "n", steps: int = 60, tolerance: float = 1e-8, min_days: int = 3) -> dict:
    """Conditional logistic regression from day counts, by Newton steps of two aggregates each.

    All cases of a stratum share one risk set, so its contribution is sum_d n_d x_d b - N log sum_d exp(x_d b): no
    expansion to matched sets and no cap on cases. Strata without cases or with fewer than ``min_days`` days
    drop out. Returns beta, se, covariance, iterations, log_likelihood, n_cases; only p + p * p sums reach
    the driver. Estimates that don't settle in ``steps`` steps are an error.
    """
    p = len(covariates)
    sizes = counts.groupBy(stratum).agg(F.count(F.lit(1)).alias("_days"), F.sum(n).alias("_cases")).filter((F.col("_days") >= min_days) & (F.col("_cases") > 0))
    # centred covariates keep exp() in range and change nothing else
    centre = counts.agg(*[F.avg(c).alias(c) for c in covariates]).first()
    rows = counts.na.drop(subset=[*covariates, n]).join(sizes.select(stratum), stratum, "left_semi")
    rows = rows.select(stratum, n, *[(F.col(c) - float(centre[c] or 0.0)).alias(f"_x{i}") for i, c in enumerate(covariates)]).cache()
    beta, total, step = np.zeros(p), 0.0, 0
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    try:
        for step in range(1, steps + 1):
            eta = sum((F.col(f"_x{i}") * float(b) for i, b in enumerate(beta)), F.lit(0.0))
            w = F.exp(eta)
            moments = rows.groupBy(stratum).agg(
                F.sum(n).alias("_n"), F.sum(w).alias("_w"), F.sum(F.col(n) * eta).alias("_ne"),
                *[F.sum(F.col(n) * F.col(f"_x{i}")).alias(f"_s{i}") for i in range(p)], *[F.sum(w * F.col(f"_x{i}")).alias(f"_m{i}") for i in range(p)],
                *[F.sum(w * F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"_q{i}_{j}") for i, j in pairs],
            )
            mean = lambda i: F.col(f"_m{i}") / F.col("_w")
            sums = moments.agg(
                F.sum("_n").alias("cases"), F.sum(F.col("_ne") - F.col("_n") * F.log("_w")).alias("ll"),
                *[F.sum(F.col(f"_s{i}") - F.col("_n") * mean(i)).alias(f"g{i}") for i in range(p)],
                *[F.sum(F.col("_n") * (F.col(f"_q{i}_{j}") / F.col("_w") - mean(i) * mean(j))).alias(f"h{i}_{j}") for i, j in pairs],
            ).first()
            if not sums["cases"]:
                raise ValueError("no stratum has cases and enough days")
            g = np.array([sums[f"g{i}"] for i in range(p)])
            h = np.zeros((p, p))
            for i, j in pairs:
                h[i, j] = h[j, i] = sums[f"h{i}_{j}"]
            total = sums["ll"]
            move = np.linalg.solve(h, g)
            limit = 5.0 / max(5.0, np.abs(move).max())
            beta = beta + move * limit
            if np.abs(move).max() < tolerance * (1 + np.abs(beta).max()):
                break
        else:
            raise ValueError(f"the estimates have not settled after {steps} steps")
    finally:
        rows.unpersist()
    cov = np.linalg.inv(h)
    return {"beta": beta, "se": np.sqrt(np.diag(cov)), "covariance": cov, "iterations": step, "log_likelihood": total, "n_cases": sums["cases"]}


def quadratic_optimum(beta: np.ndarray, otherwise: float) -> float:
    """-b1 / 2 b2 of a quadratic with a maximum (b2 < 0), else the given value."""
    return float(-beta[0] / (2 * beta[1])) if beta[1] < 0 else otherwise


def extreme_indicators(exposure: str, low: float, high: float) -> dict[str, Column]:
    """Right-closed classes: at most ``low``, above ``high``; the middle is the reference."""
    return {"is_low": (F.col(exposure) <= low).cast("double"), "is_high": (F.col(exposure) > high).cast("double")}


def quadratic_logit(days: DataFrame, counts: str, exposure: str, otherwise: float, date: str = "date", by: list[str] | None = None) -> dict:
    """Conditional logistic regression on the exposure and its square, and the exposure of the highest odds, if the
    square's coefficient is negative, else ``otherwise``."""
    squared = days.withColumn("_square", F.col(exposure) * F.col(exposure))
    fit = conditional_logit(stratum_counts(squared, counts, [exposure, "_square"], date, by), [exposure, "_square"])
    return fit | {"optimum": quadratic_optimum(fit["beta"], otherwise)}


def stratified_dlnm(based: DataFrame, spline: NaturalSpline, counts: str = "deaths", cb: str = "cb", lag_df: int = 4, date: str = "date", by: list[str] | None = None) -> dict:
    """The distributed-lag model with a factor for each stratum, from day counts that hold a cross-basis.

    A Poisson model with stratum factors has the likelihood of the conditional one, so no factor is fitted. The
    covariance is scaled by the dispersion about the strata's expected counts. Returns that of ``conditional_logit``
    with covariance and se scaled, and dispersion.
    """
    p = spline.df * lag_df
    names = [f"cb{i}" for i in range(p)]
    rows = stratum_counts(based.filter(F.col(cb).isNotNull()).withColumns({n: F.get(cb, i) for i, n in enumerate(names)}), counts, names, date, by)
    fit = conditional_logit(rows, names)
    eta = sum((F.col(n) * float(b) for n, b in zip(names, fit["beta"])), F.lit(0.0))
    whole = Window.partitionBy("stratum")
    expected = rows.withColumn("_e", F.exp(eta - F.max(eta).over(whole)))
    expected = expected.withColumn("_mu", F.sum("n").over(whole) * F.col("_e") / F.sum("_e").over(whole)).filter("_mu > 0")
    found = expected.agg(F.sum(F.pow(F.col("n") - F.col("_mu"), 2) / F.col("_mu")).alias("x"), F.count(F.lit(1)).alias("k"), F.count_distinct("stratum").alias("s")).first()
    dispersion = found["x"] / max(found["k"] - found["s"] - p, 1)
    covariance = fit["covariance"] * dispersion
    return fit | {"covariance": covariance, "se": np.sqrt(np.diag(covariance)), "dispersion": dispersion}
