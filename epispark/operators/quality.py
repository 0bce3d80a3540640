"""Data-quality operators and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epispark.functions.stats import is_finite


def parse_failures(df: DataFrame, raw: str, parsed: Column) -> DataFrame:
    """Rows, failures (a value that parses to null) and their rate."""
    failed = F.count_if(parsed.isNull() & F.col(raw).isNotNull())
    return df.agg(F.count(F.lit(1)).alias("n"), failed.alias("n_failed"), (failed / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("failure_rate"))


def match_rate(df: DataFrame, matched: Column) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(matched).alias("n_matched"), (F.count_if(matched) / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("match_rate"))


def require_match_rate(df: DataFrame, matched: Column, fail_below: float = 0.85, warn_below: float = 0.95) -> str:
    """ok, warn or empty; raises below ``fail_below``."""
    rate = match_rate(df, matched).first()["match_rate"]
    if rate is None:
        return "empty"
    if rate < fail_below:
        raise ValueError(f"only {rate:.1%} of the rows match; {fail_below:.0%} needed")
    return "warn" if rate < warn_below else "ok"


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return df


def missing_years(panel: DataFrame, date: str, value: str, first: int, last: int) -> DataFrame:
    """Expected years for which the panel sums to nothing."""
    there = panel.groupBy(F.year(date).alias("year")).agg(F.sum(value).alias("_n")).filter("_n > 0")
    return panel.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("year")).join(there, "year", "left_anti")


def valid_fits(fits: DataFrame, columns: list[str], se: str | None = None, largest_se: float = 20.0) -> DataFrame:
    """Finite and positive estimates, standard error below a limit."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & is_finite(F.col(c)) & (F.col(c) > 0)
    return fits.filter(ok & (is_finite(F.col(se)) & (F.col(se) < largest_se) if se else F.lit(True)))


def min_rows(panel: DataFrame, by: list[str], least: int = 365) -> DataFrame:
    """Series with at least ``least`` rows."""
    return panel.join(panel.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).select(*by), by, "left_semi")


def min_events(panel: DataFrame, by: list[str], event: Column, least: int = 10) -> DataFrame:
    """Series with at least ``least`` rows that meet a condition."""
    return panel.join(panel.groupBy(*by).agg(F.count_if(F.coalesce(event, F.lit(False))).alias("_n")).filter(F.col("_n") >= least).select(*by), by, "left_semi")


def coverage_share(panel: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Share of non-null values per column, and the smallest of them."""
    shares = panel.groupBy(*by).agg(*[(F.count(c) / F.count(F.lit(1))).alias(f"{c}_share") for c in columns])
    names = [F.col(f"{c}_share") for c in columns]
    return shares.withColumn("coverage", F.least(*names) if len(names) > 1 else names[0])


def coverage_filter(panel: DataFrame, by: list[str], columns: list[str], least: float = 0.7) -> DataFrame:
    return panel.join(coverage_share(panel, by, columns).filter(F.col("coverage") >= least).select(*by), by, "left_semi")


def min_studies(studies: DataFrame, by: list[str], least: int = 10) -> DataFrame:
    return studies.join(studies.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).select(*by), by, "left_semi")


def region_diagnostics(panel: DataFrame, region: str, exposure: str, deaths: str, fits: DataFrame | None = None, valid_se: float = 10.0, extreme_se: float = 20.0) -> DataFrame:
    """Days, exposure spread and quantiles, deaths, share of zero days; with fits also status and a class of the standard error."""
    q = F.percentile(exposure, F.array(F.lit(0.01), F.lit(0.99)))
    out = panel.groupBy(region).agg(
        F.count(F.lit(1)).alias("n_days"), (F.max(exposure) - F.min(exposure)).alias("temp_range"), F.avg(exposure).alias("temp_mean"), F.stddev_samp(exposure).alias("temp_sd"), q.alias("_q"),
        F.sum(deaths).alias("deaths_total"), F.avg(deaths).alias("deaths_mean"), (F.count_if(F.col(deaths) == 0) / F.count(F.lit(1)) * 100).alias("deaths_zero_pct"),
    )
    out = out.withColumns({"temp_p1": F.col("_q")[0], "temp_p99": F.col("_q")[1]}).drop("_q")
    if fits is None:
        return out
    se = (F.log("rr_p99_hi") - F.log("rr_p99_lo")) / (2 * 1.96)
    kind = F.when(~is_finite(F.col("rr_p99_se")), "none").when(F.col("rr_p99_se") <= valid_se, "valid").when(F.col("rr_p99_se") <= extreme_se, "high").otherwise("extreme")
    return out.join(fits.select(region, "status", "rr_p99", "rr_p1", se.alias("rr_p99_se")), region, "left").withColumn("se_category", kind)


def inventory(panel: DataFrame, region: str, date: str, value: str) -> DataFrame:
    return panel.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(region).alias("n_regions"), F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.sum(value).alias("total"))
