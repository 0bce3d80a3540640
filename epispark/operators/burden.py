"""Attributable burden, its Monte Carlo interval, years of life lost."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epispark.functions.splines import NaturalSpline
from epispark.functions.stats import grid, is_finite
from epispark.operators.dlnm import predict_rr


def rr_lookup(pooled: DataFrame, spline: NaturalSpline, low: float, high: float, centre: Column, step: float = 0.1, lags: int = 21, lag_df: int = 4) -> DataFrame:
    """The pooled curve (at, rr, rr_lo, rr_hi) on a grid."""
    return predict_rr(pooled, spline, grid(low, step, int(round((high - low) / step)) + 1), centre, lags, lag_df).select("at", "rr", "rr_lo", "rr_hi")


def curve_array(curve: DataFrame, x: str = "at", y: str = "rr") -> tuple[float, float, list[float]]:
    """(first x, step, values) of an equally spaced curve: a few hundred numbers on the driver."""
    rows = curve.select(x, y).orderBy(x).collect()
    step = (rows[-1][0] - rows[0][0]) / (len(rows) - 1) if len(rows) > 1 else 1.0
    return rows[0][0], step, [r[1] for r in rows]


def interpolate(x: Column, start: float, step: float, values: list[float]) -> Column:
    """Linear interpolation in an equally spaced table, constant beyond its ends: an array lookup, no join."""
    table = F.array(*[F.lit(float(v)) for v in values])
    at = F.least(F.greatest((x - start) / step, F.lit(0.0)), F.lit(float(len(values) - 1)))
    low = F.least(F.floor(at), F.lit(max(len(values) - 2, 0))).cast("int")
    if len(values) == 1:
        return F.when(x.isNotNull(), float(values[0]))
    return F.when(x.isNotNull(), F.get(table, low) + (F.get(table, low + 1) - F.get(table, low)) * (at - low))


def nearest_value(x: Column, start: float, step: float, values: list[float]) -> Column:
    """The table's value at the nearest grid point (ties to the lower one)."""
    table = F.array(*[F.lit(float(v)) for v in values])
    at = F.ceil((x - start) / step - 0.5)
    return F.when(x.isNotNull(), F.get(table, F.least(F.greatest(at, F.lit(0)), F.lit(len(values) - 1)).cast("int")))


def curve_lookup(df: DataFrame, x: str, curves: DataFrame, by: list[str], at: str = "at", value: str = "rr", how: str = "linear", out: str = "rr", parts: int = 32) -> DataFrame:
    """Look ``x`` up in its group's own curve (rows ``by``, ``at``, ``value``), whose knots may be anywhere: an as-of join.

    Rows and knots are sorted together, so a row sees the last knot at or before it, which carries its successor along; ``linear`` joins the
    two by a line, ``nearest`` takes the nearer one (ties to the lower). Beyond its ends a curve is constant. Knots at one place are averaged. A
    group's rows are dealt to ``parts`` parts and its knots, which are few, go to each, so a group may hold any share of the rows. Null for
    a null or NaN ``x``, and for groups without a curve; knots without a finite place or a value don't count.
    """
    if how not in ("linear", "nearest"):
        raise ValueError(f"linear or nearest, not {how}")
    names = [f.name for f in df.schema.fields if f.name != out]
    order = Window.partitionBy(*by).orderBy("_at")
    knots = curves.select(*by, F.col(at).cast("double").alias("_at"), F.col(value).cast("double").alias("_v")).filter(is_finite(F.col("_at")) & F.col("_v").isNotNull())
    knots = knots.groupBy(*by, "_at").agg(F.avg("_v").alias("_v")).withColumns({"_next": F.lead("_at").over(order), "_w": F.lead("_v").over(order), "_first": F.row_number().over(order) == 1})
    # what lies before the first knot meets one that is infinitely far to the left
    knots = knots.select(*by, F.explode(F.array(
        F.struct(F.lit(True).alias("keep"), F.col("_at").alias("x"), F.struct("_at", "_v", "_next", "_w").alias("k")),
        F.struct(F.col("_first").alias("keep"), F.lit(float("-inf")).alias("x"), F.struct(F.lit(float("-inf")).alias("_at"), F.col("_v"), F.col("_at").alias("_next"), F.col("_v").alias("_w")).alias("k")),
    )).alias("_e")).filter("_e.keep")
    knots = knots.select(*by, "_e.x", "_e.k", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"), F.lit(None).cast(df.select(*names).schema).alias("_row"))
    rows = df.select(*by, F.col(x).cast("double").alias("x"), F.lit(None).cast(knots.schema["k"].dataType).alias("k"), F.pmod(F.xxhash64(x, F.monotonically_increasing_id()), F.lit(parts)).cast("int").alias("_part"), F.struct(*names).alias("_row"))
    place = Window.partitionBy(*by, "_part").orderBy(F.asc_nulls_first("x"), F.col("k").isNull())
    met = knots.unionByName(rows).withColumn("k", F.last("k", ignorenulls=True).over(place.rowsBetween(Window.unboundedPreceding, 0))).filter("_row is not null")
    here, ahead, left = F.col("x") - F.col("k._at"), F.col("k._next") - F.col("x"), F.col("k._v")
    line = left + (F.col("k._w") - left) * here / (F.col("k._next") - F.col("k._at"))
    found = F.when(F.col("k._next").isNull() | (F.col("k._at") == float("-inf")), left)
    found = found.otherwise(line) if how == "linear" else found.when(here <= ahead, left).otherwise(F.col("k._w"))
    return met.select(*[F.col("_row")[n].alias(n) for n in names], F.when(F.col("x").isNotNull() & ~F.isnan("x"), found).alias(out))


def interpolate_table(df: DataFrame, x: str, table: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Interpolation in a table with whole-number keys (a life table): exact, else linear, clamped at the ends.

    The table is a dimension; its bounds come from one aggregate and the joins are equi-joins.
    """
    ends = table.agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"))
    clamped = df.join(F.broadcast(ends)).withColumn("_x", F.least(F.greatest(F.col(x).cast("double"), F.col("_lo").cast("double")), F.col("_hi").cast("double")))
    clamped = clamped.withColumns({"_k0": F.floor("_x").cast("bigint"), "_k1": F.ceil("_x").cast("bigint")})
    side = lambda n: table.select(F.col(key).cast("bigint").alias(f"_k{n}"), F.col(value).alias(f"_e{n}"))
    both = clamped.join(side(0), "_k0", "left").join(side(1), "_k1", "left")
    return both.withColumn(out, F.col("_e0") + (F.col("_e1") - F.col("_e0")) * (F.col("_x") - F.col("_k0"))).drop("_x", "_lo", "_hi", "_k0", "_k1", "_e0", "_e1")


def attributable(panel: DataFrame, rr: Column, deaths: str = "deaths") -> DataFrame:
    """Add rr, af = (rr - 1) / rr where rr > 1 else 0, and an = af * deaths."""
    out = panel.withColumn("rr", rr)
    out = out.withColumn("af", F.when(F.col("rr") > 1, (F.col("rr") - 1) / F.col("rr")).otherwise(0.0))
    return out.withColumn("an", F.col("af") * F.col(deaths))


def burden_rates(sums: DataFrame, population: DataFrame, by: list[str], column: str = "population") -> DataFrame:
    """Add the yearly heat, cold and total burden per 100,000 of the population; null where it isn't known."""
    out = sums.join(population.select(*by, column), by, "left").withColumn("annual_total_an", F.col("annual_heat_an") + F.col("annual_cold_an"))
    return out.withColumns({f"{n}_rate": F.when(F.col(column) > 0, F.col(f"annual_{n}_an") / F.col(column) * 100_000) for n in ("heat", "cold", "total")})


def burden_sums(flagged: DataFrame, by: list[str], deaths: str = "deaths", days_per_year: float = 365.25) -> DataFrame:
    """Sums of an over heat, cold and the extreme cuts, day counts, percentages of deaths and yearly means.

    Without ``by`` one row for all (the national burden). Rows carry the flags of ``extreme_flags``.
    """
    over = lambda flag: F.sum(F.when(F.col(flag), F.col("an")).otherwise(0.0))
    flags = {"heat": "is_heat", "cold": "is_cold", "extreme_heat": "is_extreme_heat", "extreme_cold": "is_extreme_cold", "heat_p99": "is_heat_p99", "cold_p1": "is_cold_p1"}
    out = flagged.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_days"), F.sum(deaths).alias("total_deaths"),
        *[over(f).alias(f"{n}_an") for n, f in flags.items()], *[F.count_if(f).alias(f"n_{n}_days") for n, f in flags.items()],
    )
    years = F.col("n_days") / days_per_year
    share = {f"{n}_af_pct": F.col(f"{n}_an") / F.nullif(F.col("total_deaths"), F.lit(0)) * 100 for n in ("heat", "cold")}
    yearly = {f"annual_{n}_an": F.col(f"{n}_an") / years for n in ("heat", "cold")}
    return out.withColumns(share | yearly | {"total_an": F.col("heat_an") + F.col("cold_an")})


def region_and_national(flagged: DataFrame, region: str, deaths: str = "deaths") -> DataFrame:
    """Regions and their total (region null) in one pass, by rollup."""
    return flagged.rollup(region).agg(F.sum(deaths).alias("total_deaths"), F.sum(F.when(F.col("is_heat"), F.col("an")).otherwise(0.0)).alias("heat_an"), F.sum(F.when(F.col("is_cold"), F.col("an")).otherwise(0.0)).alias("cold_an"))


def monte_carlo(
    panel: DataFrame,
    coef: np.ndarray,
    vcov: np.ndarray,
    spline: NaturalSpline,
    centre: float,
    cuts: dict[str, float],
    exposure: str = "exposure",
    deaths: str = "deaths",
    draws: int = 1000,
    seed: int = 42,
    digits: int | None = None,
) -> DataFrame:
    """(draw, heat_an, cold_an, extreme_heat_an, extreme_cold_an, heat_p99_an, cold_p1_an, total_an).

    ``coef`` and ``vcov`` are those summed over lags (``reduce_over_lags``). The panel is first summed to
    its distinct exposures (rounded to ``digits`` where given, a few hundred rows whatever its length); a task holds all
    draws against a thousand of its rows at a time, and the draws' partial sums are added up. ``cuts`` has p1, p2_5,
    p97_5, p99.
    """
    summed = panel.groupBy((F.col(exposure) if digits is None else F.round(exposure, digits)).alias("x")).agg(F.sum(deaths).cast("double").alias("n")).filter("x is not null")
    normal = np.random.default_rng(seed).standard_normal((draws, len(coef)))
    values, vectors = np.linalg.eigh((vcov + vcov.T) / 2)
    if values.min() < -1e-9 * max(values.max(), 0):
        raise ValueError("the covariance is not positive semidefinite")
    drawn = coef + normal @ (vectors * np.sqrt(np.maximum(values, 0))).T
    names = ["heat_an", "cold_an", "extreme_heat_an", "extreme_cold_an", "heat_p99_an", "cold_p1_an"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((draws, len(names)))
        for pdf in (whole.iloc[k : k + 1000] for whole in batches for k in range(0, len(whole), 1000)):
            x, n = pdf["x"].to_numpy(float), pdf["n"].to_numpy(float)
            log_rr = (spline.basis(x) - spline.basis(np.array([centre]))) @ drawn.T
            an = np.where(log_rr > 0, 1 - np.exp(-log_rr), 0.0) * n[:, None]
            masks = (x > centre, x < centre, x > cuts["p97_5"], x < cuts["p2_5"], x > cuts["p99"], x < cuts["p1"])
            total += np.stack([an[m].sum(axis=0) for m in masks], axis=1)
        yield pd.DataFrame({"draw": np.arange(draws)} | {n: total[:, i] for i, n in enumerate(names)})

    parts = summed.mapInPandas(run, "draw long, " + ", ".join(f"{n} double" for n in names))
    out = parts.groupBy("draw").agg(*[F.sum(n).alias(n) for n in names])
    return out.withColumn("total_an", F.col("heat_an") + F.col("cold_an"))


#: The burden's metrics, and whether each is a share of heat and cold together.
METRICS = ("heat_an", "cold_an", "extreme_heat_an", "extreme_cold_an", "heat_p99_an", "cold_p1_an", "total_an")


def interval_metrics(draws: DataFrame, total_deaths: float, years: float, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Intervals of each metric as a sum, per year, and as a percentage of all deaths: metric, measure (total, annual, af_pct), mean, median,
    ci_lo, ci_hi. ``years`` and ``total_deaths`` are those of the panel that was drawn; without them (0) the measure is null."""
    scaled = {"total": 1.0, "annual": 1 / years if years else None, "af_pct": 100 / total_deaths if total_deaths else None}
    cells = [F.struct(F.lit(m).alias("metric"), F.lit(k).alias("measure"), (F.col(m) * F.lit(v).cast("double")).alias("value")) for m in metrics for k, v in scaled.items()]
    long = draws.select(F.explode(F.array(*cells)).alias("_m")).select("_m.*")
    # a draw is a row: a thousand of them, whatever the panel's size
    q = F.percentile("value", F.array(F.lit(0.5), F.lit(0.025), F.lit(0.975)))
    out = long.groupBy("metric", "measure").agg(F.avg("value").alias("mean"), q.alias("_q"))
    return out.select("metric", "measure", "mean", *[F.col("_q")[i].alias(n) for i, n in enumerate(("median", "ci_lo", "ci_hi"))])


def interval_summary(draws: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, mean, median, ci_lo, ci_hi) over the draws."""
    long = draws.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("_m")).select("_m.*")
    q = F.percentile("value", F.array(F.lit(0.5), F.lit(0.025), F.lit(0.975)))
    out = long.groupBy("metric").agg(F.avg("value").alias("mean"), q.alias("_q"))
    return out.select("metric", "mean", *[F.col("_q")[i].alias(n) for i, n in enumerate(("median", "ci_lo", "ci_hi"))])


def life_table_lookup(tables: DataFrame, age: str = "age", ex: str = "ex", year: str = "year") -> DataFrame:
    return tables.groupBy(age).agg(F.avg(ex).alias("ex_mean"), F.min(ex).alias("ex_min"), F.max(ex).alias("ex_max"), F.count_distinct(year).alias("n_years"))


def life_table_bands(tables: DataFrame, band: Column, age: str = "age", ex: str = "ex", year: str = "year") -> DataFrame:
    """Means by (band, year), then by band; the middle age is that of the first year."""
    yearly = tables.withColumn("band", band).filter("band is not null").groupBy("band", year).agg(F.avg(ex).alias("_ex"), F.median(age).alias("_mid"))
    return yearly.groupBy("band").agg(F.avg("_ex").alias("ex"), F.min_by("_mid", year).alias("age_midpoint"))


def weighted_expectancy(ages: DataFrame, tables: DataFrame, age: str = "age", weight: str = "weight", key: str = "age", ex: str = "ex_mean", by: list[str] | None = None) -> DataFrame:
    """Mean remaining life expectancy under an age distribution."""
    looked = interpolate_table(ages, age, tables, key, ex, "_ex")
    return looked.groupBy(*(by or [])).agg((F.sum(F.col(weight) * F.col("_ex")) / F.sum(weight)).alias("ex"))


def years_of_life_lost(burden: DataFrame, expectancy: float | Column, years: str = "n_years", population: str | None = None) -> DataFrame:
    """Add yll and yearly yll for heat, cold and both, and rates per 100,000 where there is a population."""
    e = expectancy if isinstance(expectancy, Column) else F.lit(float(expectancy))
    out = burden.withColumns({"yll_heat": F.col("heat_an") * e, "yll_cold": F.col("cold_an") * e})
    out = out.withColumn("yll_total", F.col("yll_heat") + F.col("yll_cold"))
    out = out.withColumns({f"annual_yll_{n}": F.col(f"yll_{n}") / F.col(years) for n in ("heat", "cold", "total")})
    if population:
        out = out.withColumns({f"yll_rate_{n}": F.when(F.col(population) > 0, F.col(f"annual_yll_{n}") / F.col(population) * 100000) for n in ("heat", "cold", "total")})
    return out


def yll_summary(regions: DataFrame, column: str = "yll_total") -> DataFrame:
    return regions.agg(F.count(F.lit(1)).alias("n_regions"), F.sum(column).alias("total"), F.avg(column).alias("mean"), F.median(column).alias("median"))


def top_regions(regions: DataFrame, column: str = "yll_total", region: str = "region", n: int = 5) -> DataFrame:
    return regions.orderBy(F.desc(column), region).limit(n)
