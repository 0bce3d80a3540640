"""Region-day panels: lookups, stratified counts, densifying, joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epispark.functions.stats import selected_quantiles


def lookup_region(events: DataFrame, code: str, mapping: DataFrame, key: str, fallback: str | None = None) -> DataFrame:
    """Left-join a mapping by ``key``; rows that miss are looked up again by ``fallback``, a second key of the mapping.

    The mapping is a dimension table; Spark broadcasts it if it is small enough.
    """
    values = [c for c in mapping.columns if c not in (key, fallback)]
    first = mapping.select(F.col(key).alias(code), *values)
    if fallback is None:
        return events.join(first, code, "left")
    second = mapping.select(F.col(fallback).alias("_key2"), *[F.col(v).alias(f"_2{v}") for v in values])
    out = events.join(first, code, "left").join(second, events[code] == F.col("_key2"), "left")
    return out.select(*[F.col(c) for c in events.columns], *[F.coalesce(v, f"_2{v}").alias(v) for v in values])


def unmatched_codes(events: DataFrame, code: str, mapping: DataFrame, key: str) -> DataFrame:
    """Distinct codes of the events that the mapping lacks."""
    return events.select(code).join(mapping.select(F.col(key).alias(code)), code, "left_anti").filter(F.col(code).isNotNull()).distinct()


def count_events(events: DataFrame, keys: list[str], where: Column | None = None, name: str = "deaths") -> DataFrame:
    return (events if where is None else events.filter(where)).groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def count_strata(events: DataFrame, keys: list[str], strata: dict[str, Column]) -> DataFrame:
    """All strata in one pass: one count column each, and ``n`` over all rows."""
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in strata.items()])


def strata_cube(events: DataFrame, date: str, levels: list[str], strata: dict[str, Column]) -> DataFrame:
    """Long form of all (level, stratum) datasets: level, region, date, stratum, n. Only strata with events.

    The events are exploded by level and aggregated once: one shuffle for all datasets.
    """
    labels = F.filter(F.array(F.lit("all"), *[F.when(c, F.lit(k)) for k, c in strata.items()]), lambda x: x.isNotNull())
    places = F.array(*[F.struct(F.lit(lv).alias("level"), F.col(lv).cast("string").alias("region")) for lv in levels])
    counted = events.groupBy(date, *levels, labels.alias("_labels")).agg(F.count(F.lit(1)).alias("n"))  # first to distinct combinations
    spread = counted.select(date, F.explode(places).alias("_p"), "_labels", "n").select(date, "_p.level", "_p.region", F.explode("_labels").alias("stratum"), "n")
    return spread.groupBy("level", "region", date, "stratum").agg(F.sum("n").alias("n"))


def pivot_strata(events: DataFrame, keys: list[str], stratum: str, values: list[str], prefix: str = "") -> DataFrame:
    """One column for each stratum, zero where there is none."""
    out = events.groupBy(*keys).pivot(stratum, values).count().na.fill(0)
    for v in values:
        out = out.withColumnRenamed(v, prefix + v)
    return out


def yearly_summary(events: DataFrame, year: str, flags: dict[str, Column]) -> DataFrame:
    return events.groupBy(year).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in flags.items()])


def coverage(panel: DataFrame, by: list[str], date: str, region: str, value: str) -> DataFrame:
    """Sum, distinct days, distinct regions."""
    return panel.groupBy(*by).agg(F.sum(value).alias("total"), F.count_distinct(date).alias("n_days"), F.count_distinct(region).alias("n_regions"))


def calendar(spark, start: str, end: str) -> DataFrame:
    """One row a day."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 day"))).alias("date"))


def densify(panel: DataFrame, region: str = "region", date: str = "date", fill: list[str] | None = None, days: DataFrame | None = None) -> DataFrame:
    """A row for each region and day, ``fill`` columns zero where there was none.

    Days are those of ``days``, or all from the panel's first to its last. They are generated per region
    by ``sequence``, not by a cross join.
    """
    fill = fill if fill is not None else [c for c in panel.columns if c not in (region, date)]
    regions = panel.select(region).distinct()
    if days is None:
        span = panel.agg(F.min(date).alias("_a"), F.max(date).alias("_b"))
    else:
        span = days.agg(F.min(date).alias("_a"), F.max(date).alias("_b"))
    full = regions.join(F.broadcast(span)).select(region, F.explode(F.sequence("_a", "_b", F.expr("interval 1 day"))).alias(date))
    if days is not None:
        full = full.join(days.select(date).distinct(), date, "left_semi")
    return full.join(panel, [region, date], "left").na.fill(0, fill)


def join_panels(left: DataFrame, right: DataFrame, keys: tuple[str, str] = ("region", "date"), how: str = "inner") -> DataFrame:
    """Deaths by exposure (inner), or confounders (left), on region and day."""
    return left.join(right, list(keys), how)


def join_covariates(panel: DataFrame, *tables: DataFrame, on: str = "region", how: str = "inner") -> DataFrame:
    for t in tables:
        panel = panel.join(t, on, how)
    return panel


def daily_extremes(readings: DataFrame, cell: list[str], ts: str, value: str, extra_means: tuple[str, ...] = ()) -> DataFrame:
    """Mean, minimum and maximum of a cell's day; nulls are skipped."""
    aggs = [F.avg(value).alias(f"{value}_mean"), F.min(value).alias(f"{value}_min"), F.max(value).alias(f"{value}_max")]
    return readings.groupBy(*cell, F.to_date(ts).alias("date")).agg(*aggs, *[F.avg(c).alias(f"{c}_mean") for c in extra_means])


def region_mean(cells: DataFrame, region: str, date: str, columns: list[str]) -> DataFrame:
    """Unweighted means over cells (a region's minimum is the mean of its cells' minima)."""
    return cells.groupBy(region, date).agg(*[F.avg(c).alias(c) for c in columns])


def daily_grid(readings: DataFrame, cell: list[str], ts: str, columns: list[str]) -> DataFrame:
    """Duplicates of (time, cell) dropped, then the daily mean of each cell."""
    once = readings.groupBy(ts, *cell).agg(*[F.max(c).alias(c) for c in columns])
    return once.groupBy(F.to_date(ts).alias("date"), *cell).agg(*[F.avg(c).alias(c) for c in columns])


def mode_by(df: DataFrame, key: str, column: str) -> DataFrame:
    """The most frequent value, ties to the lowest."""
    counted = df.groupBy(key, column).agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(key).agg(F.min_by(column, F.struct((-F.col("_n")).alias("n"), F.col(column).alias("v"))).alias(column))


def sums_and_members(df: DataFrame, key: str, sums: list[str], member: str) -> DataFrame:
    return df.groupBy(key).agg(*[F.sum(c).alias(c) for c in sums], F.count_distinct(member).alias(f"n_{member}"))


def count_flags(events: DataFrame, keys: list[Column | str], flags: dict[str, Column], date: str | None = None) -> DataFrame:
    """Counts of flags by any keys (days, ISO weeks, states); with ``date`` also its first and last value."""
    aggs = [F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in flags.items()]
    if date:
        aggs += [F.min(date).alias("first_date"), F.max(date).alias("last_date")]
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("cases"), *aggs)


def national_series(panel: DataFrame, date: str, sums: list[str], exposure: str) -> DataFrame:
    """Sums over regions, and the unweighted mean, minimum and maximum of the exposure."""
    return panel.groupBy(date).agg(*[F.sum(c).alias(c) for c in sums], F.avg(exposure).alias(f"{exposure}_mean"), F.min(exposure).alias(f"{exposure}_min"), F.max(exposure).alias(f"{exposure}_max"))


def macro_means(df: DataFrame, key: str, columns: list[str], digits: int = 1) -> DataFrame:
    return df.groupBy(key).agg(*[F.round(F.avg(c), digits).alias(c) for c in columns])


def spread(df: DataFrame, key: str, column: str) -> DataFrame:
    """Sample standard deviation and range."""
    return df.groupBy(key).agg(F.stddev_samp(column).alias(f"{column}_sd"), (F.max(column) - F.min(column)).alias(f"{column}_range"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns scaled to 0-1 over the whole table, as ``<column>_norm``."""
    bounds = df.agg(*[f(c).alias(f"_{n}{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    out = df.join(F.broadcast(bounds))
    return out.withColumns({f"{c}_norm": (F.col(c) - F.col(f"_lo{c}")) / F.nullif(F.col(f"_hi{c}") - F.col(f"_lo{c}"), F.lit(0)) for c in columns}).drop(*[f"_{n}{c}" for c in columns for n in ("lo", "hi")])


def vulnerability(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean of the inverted min-max scaled columns: 1 is the most vulnerable."""
    scaled = min_max(df, columns)
    return scaled.withColumn("vulnerability", sum((1 - F.col(f"{c}_norm") for c in columns), F.lit(0.0)) / len(columns)).drop(*[f"{c}_norm" for c in columns])


def z_scores(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns standardised by the sample deviation over the whole table, as ``<column>_z``."""
    stats = df.agg(*[f(c).alias(f"_{n}{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    return df.join(F.broadcast(stats)).withColumns({f"{c}_z": (F.col(c) - F.col(f"_m{c}")) / F.nullif(F.col(f"_s{c}"), F.lit(0.0)) for c in columns}).drop(*[f"_{n}{c}" for c in columns for n in ("m", "s")])


def add_missing_days(known: DataFrame, extra: DataFrame, date: str = "date") -> DataFrame:
    """Append those rows of ``extra`` whose day ``known`` lacks."""
    return known.unionByName(extra.join(known, date, "left_anti"), allowMissingColumns=True)


def sample_rows(df: DataFrame, key: str, cap: int, size: int, seed: int = 42) -> DataFrame:
    """``size`` rows by the smallest seeded hash (MD5) of the key if there are more than ``cap``, else all."""
    if df.count() <= cap:
        return df
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), key).limit(size)


def valid_events(events: DataFrame, required: list[str], code: str | None = None, sentinel: int = 999990) -> DataFrame:
    """Rows with all required fields, and a code below the sentinel."""
    out = events.na.drop(subset=required)
    return out.filter(F.col(code) < sentinel) if code else out


def with_lag_room(panel: DataFrame, lags: int, date: str = "date", exposures: DataFrame | None = None) -> DataFrame:
    """Rows from ``lags`` days after the first date of ``exposures`` (by default of the panel) to their last date."""
    ends = (panel if exposures is None else exposures).agg(F.min(date).alias("_first"), F.max(date).alias("_last"))
    room = F.col(date).between(F.date_add("_first", lags), F.col("_last"))
    return panel.join(F.broadcast(ends)).filter(room).drop("_first", "_last")


def attach_attributes(units: DataFrame, attributes: DataFrame, key: str, attribute_key: str) -> DataFrame:
    """Each unit (a region with its most frequent state) with that state's attributes; null where there are none."""
    return units.join(attributes.withColumnRenamed(attribute_key, key), key, "left")


def common_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).intersect(right.select(key))


def missing_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``left`` that ``right`` lacks."""
    return left.select(key).distinct().join(right.select(key), key, "left_anti")


def keep_regions(panel: DataFrame, regions: DataFrame, region: str = "region") -> DataFrame:
    return panel.join(regions.select(region), region, "left_semi")


def median_of(statistics: DataFrame, columns: list[str]) -> DataFrame:
    """Medians across regions of per-region statistics."""
    found = selected_quantiles(statistics, columns, [0.5])
    return statistics.sparkSession.createDataFrame([tuple(q[0] for q in found)], ", ".join(f"`{c}` double" for c in columns))
