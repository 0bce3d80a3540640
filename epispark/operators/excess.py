"""Excess events against a baseline without exposure."""

from __future__ import annotations

import math

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epispark.functions.splines import equal_knots


def expected_baseline(series: DataFrame, deaths: str = "deaths", date: str = "date", harmonics: int = 3, trend_df: int = 4, out: str = "expected") -> DataFrame:
    """Add the expected count: Poisson regression on yearly harmonics, a natural-spline trend and weekdays.

    The fit is Spark ML's (it reads the rows where they are). With an intercept, observed and expected
    sums agree.
    """
    span = series.agg(F.min(date).alias("a"), F.max(date).alias("b")).first()
    if span["a"] is None:
        return series.withColumn(out, F.lit(None).cast("double"))
    days = max((span["b"] - span["a"]).days, 1)
    time = F.datediff(F.col(date), F.lit(span["a"])) / float(days)
    turn = F.dayofyear(date) * (2 * math.pi / 365.25)
    columns: dict[str, Column] = {}
    for k in range(1, harmonics + 1):
        columns |= {f"_sin{k}": F.sin(turn * k), f"_cos{k}": F.cos(turn * k)}
    columns |= {f"_t{i}": c for i, c in enumerate(equal_knots(0.0, 1.0, trend_df).columns(time))}
    columns |= {f"_d{k}": (F.weekday(date) == k).cast("double") for k in range(1, 7)}
    ready = VectorAssembler(inputCols=list(columns), outputCol="_features").transform(series.withColumns(columns).withColumn("_y", F.col(deaths).cast("double")))
    model = GeneralizedLinearRegression(family="poisson", link="log", featuresCol="_features", labelCol="_y", predictionCol=out, maxIter=50).fit(ready.filter("_y is not null"))
    return model.transform(ready).drop("_features", "_y", *columns)


def excess(series: DataFrame, deaths: str = "deaths", expected: str = "expected") -> DataFrame:
    e = F.col(deaths) - F.col(expected)
    return series.withColumns({"excess": e, "excess_pct": e / F.nullif(F.col(expected), F.lit(0.0)) * 100})


def excess_by_class(series: DataFrame, classes: dict[str, Column], deaths: str = "deaths", expected: str = "expected") -> DataFrame:
    """Overlapping classes in one pass: n_days, sums, percentage, mean excess a day and its standard error."""
    labels = F.filter(F.array(F.lit("all"), *[F.when(c, F.lit(k)) for k, c in classes.items()]), lambda x: x.isNotNull())
    long = series.select(F.explode(labels).alias("class"), F.col(deaths).alias("d"), F.col(expected).alias("e"), (F.col(deaths) - F.col(expected)).alias("x"))
    out = long.groupBy("class").agg(F.count(F.lit(1)).alias("n_days"), F.sum("d").alias("total_deaths"), F.sum("e").alias("total_expected"), F.sum("x").alias("total_excess"), F.avg("x").alias("mean_excess"), (F.stddev_samp("x") / F.sqrt(F.count("x"))).alias("se_excess"))
    return out.withColumn("excess_pct", F.col("total_excess") / F.nullif(F.col("total_expected"), F.lit(0.0)) * 100)


def annual_excess(series: DataFrame, flags: dict[str, Column], date: str = "date", deaths: str = "deaths", expected: str = "expected") -> DataFrame:
    x = F.col(deaths) - F.col(expected)
    over = [F.sum(F.when(c, x).otherwise(0.0)).alias(f"{k}_excess") for k, c in flags.items()]
    out = series.groupBy(F.year(date).alias("year")).agg(F.sum(deaths).alias("total_deaths"), F.sum(expected).alias("total_expected"), F.sum(x).alias("total_excess"), *over)
    return out.withColumn("excess_pct", F.col("total_excess") / F.nullif(F.col("total_expected"), F.lit(0.0)) * 100)


def compare_methods(excess_row: DataFrame, burden_row: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Ratios excess / attributable of two one-row summaries."""
    return excess_row.join(F.broadcast(burden_row)).select(*[(F.col(a) / F.nullif(F.col(b), F.lit(0.0))).alias(f"{k}_ratio") for k, (a, b) in pairs.items()])
