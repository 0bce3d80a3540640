"""Operators on ordered series: lags, runs, gaps, holidays, group quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epispark.functions.stats import selected_quantiles


def _series(by: list[str], order: str) -> Window:
    return Window.partitionBy(*by).orderBy(order)


def lag_matrix(panel: DataFrame, column: str, lags: int, by: list[str], order: str = "date", prefix: str = "lag") -> DataFrame:
    """Row lags 0..``lags`` as columns, null where a series is too short: one sort serves them all."""
    w = _series(by, order)
    return panel.withColumns({f"{prefix}{k}": F.lag(column, k).over(w) for k in range(lags + 1)})


def join_lags(counts: DataFrame, exposures: DataFrame, column: str, lags: int, keys: list[str], date: str = "date", by: list[str] | None = None) -> DataFrame:
    """Counts with the lag vector of their day, from an exposure series of its own; null where that lacks the day."""
    lagged = lag_matrix(exposures, column, lags, by or [k for k in keys if k != date], date)
    return counts.join(lagged.select(*keys, *[f"lag{k}" for k in range(lags + 1)]), keys, "left")


def case_numbers(events: DataFrame, date: str, order: list[str], out: str = "case_id") -> DataFrame:
    """Number the rows from 1 in the order of ``date`` and ``order`` (a total order).

    Rows are numbered within their day, and days start after the sum of the days before: only the table of
    day counts, one row a day, is ordered as a whole.
    """
    daily = events.groupBy(date).agg(F.count(F.lit(1)).alias("_n"))
    before = daily.select(date, (F.sum("_n").over(Window.orderBy(F.asc_nulls_first(date))) - F.col("_n")).alias("_before"))
    numbered = events.withColumn("_k", F.row_number().over(Window.partitionBy(date).orderBy(*order)))
    both = numbered.alias("l").join(before.alias("r"), F.col(f"l.{date}").eqNullSafe(F.col(f"r.{date}")))
    return both.select("l.*", (F.col("_k") + F.col("_before")).alias(out)).drop("_k")


def calendar_lags(panel: DataFrame, column: str, lags: int, by: list[str], date: str = "date", prefix: str = "lag") -> DataFrame:
    """Lags by days, not rows: null where that day has no row. A range frame over the day number, no self-join."""
    day = F.datediff(F.col(date), F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy(*by).orderBy(day)
    return panel.withColumns({f"{prefix}{k}": F.first(column).over(w.rangeBetween(-k, -k)) for k in range(lags + 1)})


def neighbour_flags(days: DataFrame, flag: str = "is_holiday", date: str = "date") -> DataFrame:
    """Flags of the day before a holiday, the day after, and either or the day itself.

    The series is one row a day (a calendar of bounded length); it is one window partition per year,
    with the neighbouring days of the turn of the year joined by date.
    """
    marked = days.filter(F.col(flag) == 1).select(F.col(date).alias("_d"))
    before = marked.select(F.date_sub("_d", 1).alias(date), F.lit(1).alias("is_day_before_holiday")).distinct()
    after = marked.select(F.date_add("_d", 1).alias(date), F.lit(1).alias("is_day_after_holiday")).distinct()
    out = days.join(before, date, "left").join(after, date, "left").na.fill(0, ["is_day_before_holiday", "is_day_after_holiday"])
    return out.withColumn("is_holiday_week", F.greatest(flag, "is_day_before_holiday", "is_day_after_holiday"))


def runs(panel: DataFrame, condition: Column, by: list[str], order: str = "date", min_length: int = 3) -> DataFrame:
    """Add run_length (of the run of consecutive rows that meet the condition; 0 outside) and in_run (0/1)."""
    w, hot = _series(by, order), F.coalesce(condition, F.lit(False))
    marked = panel.withColumn("_hot", hot)
    inner = Window.partitionBy(*by, "_hot").orderBy(order)
    islands = marked.withColumn("_island", F.row_number().over(w) - F.row_number().over(inner))
    length = F.when(F.col("_hot"), F.count(F.lit(1)).over(Window.partitionBy(*by, "_hot", "_island"))).otherwise(0)
    return islands.withColumn("run_length", length.cast("bigint")).withColumn("in_run", (F.col("run_length") >= min_length).cast("int")).drop("_hot", "_island")


def fill_gaps(panel: DataFrame, column: str, by: list[str], order: str = "date", max_gap: int = 14, rest: float | None = None) -> DataFrame:
    """Linear interpolation over gaps of at most ``max_gap`` rows; no extrapolation; ``rest`` fills what remains."""
    w = _series(by, order)
    at = F.row_number().over(w)
    numbered = panel.withColumn("_at", at).withColumn("_known", F.when(F.col(column).isNotNull(), F.col("_at")))
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    around = numbered.withColumns({
        "_v0": F.last(column, ignorenulls=True).over(back), "_a0": F.last("_known", ignorenulls=True).over(back),
        "_v1": F.first(column, ignorenulls=True).over(ahead), "_a1": F.first("_known", ignorenulls=True).over(ahead),
    })
    blend = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col("_at") - F.col("_a0")) / F.nullif(F.col("_a1") - F.col("_a0"), F.lit(0))
    filled = F.coalesce(column, F.when(F.col("_a1") - F.col("_a0") - 1 <= max_gap, blend))
    if rest is not None:
        filled = F.coalesce(filled, F.lit(rest))
    return around.withColumn(column, filled).drop("_at", "_known", "_v0", "_a0", "_v1", "_a1")


def attach_quantiles(panel: DataFrame, column: str, named: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Add the quantiles of the row's group as columns: one aggregate, joined back. Those of all rows are selected by radix and added as literals."""
    if not by:
        found = selected_quantiles(panel, column, list(named.values()))
        return panel.withColumns({n: F.lit(v).cast("double") for n, v in zip(named, found)})
    q = panel.groupBy(*by).agg(F.percentile(column, F.array(*[F.lit(p) for p in named.values()])).alias("_q"))
    return panel.join(q.select(*by, *[F.col("_q")[i].alias(n) for i, n in enumerate(named)]), by)


def extreme_flags(panel: DataFrame, column: str, centre: Column | float, low1: str = "p1", low: str = "p2_5", high: str = "p97_5", high1: str = "p99", near: float = 2.0) -> DataFrame:
    """Heat and cold against the centre, extremes against quantile columns, near-optimal days."""
    c = centre if isinstance(centre, Column) else F.lit(centre)
    x = F.col(column)
    return panel.withColumns({
        "is_heat": x > c, "is_cold": x < c, "is_extreme_heat": x > F.col(high), "is_extreme_cold": x < F.col(low),
        "is_heat_p99": x > F.col(high1), "is_cold_p1": x < F.col(low1), "is_near_optimal": F.abs(x - c) <= near,
    })


def time_index(panel: DataFrame, date: str = "date", by: list[str] | None = None) -> DataFrame:
    """Days since the first date (of the group): an aggregate joined back, not a global window."""
    first = panel.groupBy(*(by or [])).agg(F.min(date).alias("_first"))
    out = panel.join(first, by) if by else panel.join(F.broadcast(first))
    return out.withColumn("time", F.datediff(date, "_first")).drop("_first")


def local_support(panel: DataFrame, column: str, by: list[str], within: float = 1.0) -> DataFrame:
    """Rows within ``within`` of the group's P1 and of its P99."""
    placed = attach_quantiles(panel, column, {"p1": 0.01, "p99": 0.99}, by)
    return placed.groupBy(*by).agg(*[F.count_if(F.abs(F.col(column) - F.col(p)) <= within).alias(f"n_near_{p}") for p in ("p1", "p99")])


def keep_one(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by a total order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_rn = 1").drop("_rn")
