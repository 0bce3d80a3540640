"""More registered queries: names and dates, attributes, gates, curves, and comparisons of results."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epispark.functions import parse, stats
from epispark.operators import additive, burden, dlnm, excess, matched, pooling, quality
from epispark.operators import panel as P
from epispark.operators import timeseries as ts
from epispark.plans import registry as R
from epispark.plans.registry import query, rounded
from epispark.plans.surrogates import deaths, exposure, panel, records, table
from epispark.sources import io

# Names and dates


@query("SELECT n_nationkey AS N_NATIONKEY, n_name AS N_NAME FROM nation", cte=False)
def clean_names(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias(' "n_nationkey"'), F.col("n_name").alias('n_Name" '))
    return parse.clean_column_names(n)


@query("SELECT o_custkey AS region_code, CAST(o_orderdate AS DATE) AS date, o_totalprice FROM orders", cte=False)
def panel_scan(spark, sf):
    """A panel whose region key and date have other names."""
    return io.read_panel(spark, f"{sf}/orders.parquet", ["CODE_RM", "O_CUSTKEY"], date_aliases=["o_orderdate"]).select("region_code", "date", "o_totalprice")


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 4 = 1 AND o_orderkey % 5 = 0 THEN NULL WHEN o_custkey % 4 = 3 AND o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS date FROM orders""", cte=False)
def date_fallback(spark, sf):
    """Four files: two with ISO dates (one of them with some in the other layout), two without any (one with rubbish)."""
    day, odd = F.to_date("o_orderdate"), F.col("o_orderkey") % 5 == 0
    short = F.regexp_replace(F.date_format(day, "ddMMyyyy"), "^0", "")
    raw = F.when(F.col("file") == 0, day.cast("string")).when(F.col("file") == 1, F.when(odd, short).otherwise(day.cast("string"))).when(F.col("file") == 2, short).otherwise(F.when(odd, F.lit("unknown")).otherwise(short))
    o = table(spark, sf, "orders").withColumn("file", F.col("o_custkey") % 4).withColumn("raw", raw)
    return parse.with_date_fallback(o, "raw", ["file"]).select("o_orderkey", "date")


BACKUP_SQL = """, t AS (SELECT o_orderkey, date, CASE WHEN o_custkey % 3 = 0 THEN date END AS few, CASE WHEN o_custkey % 3 <> 0 THEN date END AS many FROM ev),
s AS (SELECT 1 - count(few) / count(*) AS few, 1 - count(many) / count(*) AS many FROM t)
SELECT o_orderkey, CASE WHEN s.few > 0.5 THEN coalesce(t.few, date + 1) ELSE t.few END AS few, CASE WHEN s.many > 0.5 THEN coalesce(t.many, date + 1) ELSE t.many END AS many FROM t, s"""


@query(BACKUP_SQL)
def backup_dates(spark, sf):
    """A date column that is mostly null is filled from a backup, one that mostly isn't stays."""
    third = F.col("o_custkey") % 3 == 0
    r = records(spark, sf).withColumns({"few": F.when(third, F.col("date")), "many": F.when(~third, F.col("date")), "later": F.date_add("date", 1)})
    return r.select("o_orderkey", *[parse.backup_dates(r, c, ["later"]).alias(c) for c in ("few", "many")])


# Attributes


@query(", l AS (SELECT region, date, exposure, lag(exposure, 1) OVER w AS a, lag(exposure, 2) OVER w AS b FROM x WINDOW w AS (PARTITION BY region ORDER BY date)) SELECT d.region, d.date, deaths, round(exposure, 6) AS lag0, round(a, 6) AS lag1, round(b, 6) AS lag2 FROM d LEFT JOIN l USING (region, date)")
def counts_with_lags(spark, sf):
    return rounded(ts.join_lags(deaths(spark, sf), exposure(spark, sf), "exposure", 2, ["region", "date"]))


ATTRIBUTE_SQL = """, m AS (SELECT nation, arg_min(o_orderpriority, (-n, o_orderpriority)) AS state FROM (SELECT nation, o_orderpriority, count(*) AS n FROM ev GROUP BY ALL) GROUP BY nation),
a AS (SELECT o_orderpriority AS state, round(avg(o_totalprice), 6) AS wealth FROM ev WHERE o_orderpriority <> '5-LOW' GROUP BY 1) SELECT nation, m.state, wealth FROM m LEFT JOIN a USING (state)"""


@query(ATTRIBUTE_SQL)
def state_attributes(spark, sf):
    """Units get the attributes of their most frequent state; one state has none."""
    r = records(spark, sf).withColumnRenamed("o_orderpriority", "state")
    attributes = r.filter("state <> '5-LOW'").groupBy(F.col("state").alias("code")).agg(F.avg("o_totalprice").alias("wealth"))
    return rounded(P.attach_attributes(P.mode_by(r, "nation", "state"), attributes, "state", "code").select("nation", "state", "wealth"))


@query("""SELECT n_nationkey AS nation, customers, suppliers, best FROM nation LEFT JOIN (SELECT c_nationkey AS k, CAST(count(*) AS BIGINT) AS customers FROM customer GROUP BY 1) c ON n_nationkey = c.k
LEFT JOIN (SELECT s_nationkey AS k, CAST(count(*) AS BIGINT) AS suppliers FROM supplier GROUP BY 1) s ON n_nationkey = s.k LEFT JOIN (SELECT s_nationkey AS k, max(s_acctbal) AS best FROM supplier WHERE s_acctbal > 8000 GROUP BY 1) b ON n_nationkey = b.k""", cte=False)
def covariate_chain(spark, sf):
    """Left joins in a chain: units without a piece keep their row."""
    n, c, s = (table(spark, sf, t) for t in ("nation", "customer", "supplier"))
    pieces = [
        c.groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("customers")),
        s.groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("suppliers")),
        s.filter("s_acctbal > 8000").groupBy(F.col("s_nationkey").alias("nation")).agg(F.max("s_acctbal").alias("best")),
    ]
    return P.join_covariates(n.select(F.col("n_nationkey").alias("nation")), *pieces, on="nation", how="left")


@query(", pop AS (SELECT nation, count(DISTINCT o_custkey) AS population FROM ev WHERE region < 3 GROUP BY 1), t AS (SELECT nation, count(*) AS deaths FROM ev GROUP BY 1) SELECT nation, CAST(deaths AS BIGINT) AS deaths, CAST(population AS BIGINT) AS population, round(deaths * 100000.0 / population, 6) AS rate FROM t LEFT JOIN pop USING (nation)")
def population_lookup(spark, sf):
    """Units without a population have no rate."""
    r = records(spark, sf)
    population = r.filter("region < 3").groupBy("nation").agg(F.count_distinct("o_custkey").alias("population"))
    found = P.join_covariates(P.count_events(r, ["nation"]), population, on="nation", how="left")
    return rounded(found.select("nation", "deaths", "population", (F.col("deaths") / F.col("population") * 100_000).alias("rate")))


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY date, o_orderkey) AS BIGINT) AS case_id FROM ev")
def case_numbers(spark, sf):
    return ts.case_numbers(records(spark, sf), "date", ["o_orderkey"]).select("o_orderkey", "case_id")


SETS_SQL = """, cs AS (SELECT o_orderkey, date, strftime(date, '%Y_') || month(date) || '_' || isodow(date) AS s FROM ev), dy AS (SELECT DISTINCT date, strftime(date, '%Y_') || month(date) || '_' || isodow(date) AS s FROM ev),
m AS (SELECT s, dy.date, CAST(dy.date = cs.date AS INTEGER) AS is_case FROM cs JOIN dy USING (s) WHERE s IN (SELECT s FROM dy GROUP BY s HAVING count(*) > 2)) """


@query(SETS_SQL + "SELECT date, s AS stratum, CAST(sum(is_case) AS BIGINT) AS cases, CAST(count(*) AS BIGINT) AS observations FROM m GROUP BY ALL")
def collapsed_sets(spark, sf):
    r = records(spark, sf)
    sets = matched.matched_sets(r, r.select("date").distinct(), "o_orderkey").withColumn("stratum", matched.stratum_key("date"))
    return matched.collapse(sets, ["date", "stratum"])


# Gates and matrices


@query(R.STUDY_SQL + "k AS (SELECT region FROM st WHERE v < 0.002 GROUP BY region HAVING count(*) >= 3) SELECT region, nation, round(y, 6) AS y FROM st WHERE v < 0.002 AND region IN (SELECT region FROM k)")
def study_gate(spark, sf):
    return rounded(quality.min_studies(R.studies(spark, sf).filter("v < 0.002"), ["region"], 3).select("region", "nation", "y"))


@query(R.STUDY_SQL + "e AS (SELECT nation, CASE WHEN nation % 5 = 0 THEN NULL WHEN nation % 5 = 1 THEN -y ELSE y END AS y, sqrt(v) AS se FROM st) SELECT nation, round(y, 6) AS y, round(se, 6) AS se FROM e WHERE y > 0 AND se < (SELECT median(se) FROM e)")
def estimate_gate(spark, sf):
    """Estimates that are missing, not positive or too uncertain don't pass."""
    odd = F.col("nation") % 5
    s = R.studies(spark, sf).select("nation", F.when(odd == 0, F.lit(float("nan"))).when(odd == 1, -F.col("y")).otherwise(F.col("y")).alias("y"), F.sqrt("v").alias("se"))
    middle = stats.selected_quantiles(s, "se", [0.5])[0] or 0.0
    return rounded(quality.valid_fits(s, ["y"], "se", middle))


@query(""", t AS (SELECT region, var_samp(ln(o_totalprice)) AS a, covar_samp(ln(o_totalprice), o_custkey / 1000.0) AS b, var_samp(o_custkey / 1000.0) AS c FROM ev GROUP BY region)
SELECT region, round(a + 1e-3 * (a + c) / 2, 6) AS v11, round(b, 6) AS v12, round(c + 1e-3 * (a + c) / 2, 6) AS v22 FROM t""")
def shrunk_covariance(spark, sf):
    p, k = F.log("o_totalprice"), F.col("o_custkey") / 1000
    m = records(spark, sf).groupBy("region").agg(F.array(F.var_samp(p), F.covar_samp(p, k), F.covar_samp(k, p), F.var_samp(k)).alias("v"))
    m = m.withColumn("v", pooling.ridge(F.col("v"), 2, 1e-3))
    return rounded(m.select("region", *[F.col("v")[i].alias(n) for i, n in ((0, "v11"), (1, "v12"), (3, "v22"))]))


# Curves and burden


@query(""", q AS (SELECT region, quantile_cont(exposure, 0.01) AS a, quantile_cont(exposure, 0.99) AS b FROM p GROUP BY region), g AS (SELECT region, a + (b - a) * i / 99 AS x FROM q, range(0, 100) t(i)),
r AS (SELECT region, x, 1 + 0.0006 * pow(x - 22.3, 2) AS rr FROM g) SELECT region, round(arg_min(x, rr), 6) AS "at", round(min(rr), 8) AS rr FROM r GROUP BY region""")
def minimum_of_curve(spark, sf):
    """The exposure of the lowest risk on 100 places between each region's first and last percentile."""
    q = stats.quantiles(panel(spark, sf), "exposure", [0.01, 0.99], ["region"])
    places = q.withColumn("at", F.explode(F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.col("q")[0] + (F.col("q")[1] - F.col("q")[0]) * i / 99)))
    out = dlnm.lowest(places.withColumn("rr", 1 + 0.0006 * F.pow(F.col("at") - 22.3, 2)), ["region"])
    return out.select("region", F.round("at", 6).alias("at"), F.round("rr", 8).alias("rr"))


@query("SELECT a.region, round(annual_heat_an / population * 100000, 3) AS heat_rate, round(annual_cold_an / population * 100000, 3) AS cold_rate, round((annual_heat_an + annual_cold_an) / population * 100000, 3) AS total_rate FROM (" + R.ORACLES["attributable_region"] + ") a LEFT JOIN (SELECT n_regionkey AS region, count(*) AS population FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey < 4 GROUP BY 1) p ON a.region = p.region", cte=False)
def burden_rates(spark, sf):
    n = table(spark, sf, "nation").filter("n_regionkey < 4").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("region"))
    population = table(spark, sf, "customer").join(n, "c_nationkey").groupBy("region").agg(F.count(F.lit(1)).alias("population"))
    out = burden.burden_rates(R.attributable_region(spark, sf), population, ["region"])
    return rounded(out.select("region", "heat_rate", "cold_rate", "total_rate"), 3)


@query("SELECT region, round(heat_an * (80 - 0.85 * 75), 3) AS yll_heat, round(cold_an * (80 - 0.85 * 75), 3) AS yll_cold FROM (" + R.ORACLES["attributable_region"] + ")", cte=False)
def median_age_yll(spark, sf):
    """Years of life lost if all died at the age of 75."""
    at = burden.weighted_expectancy(spark.createDataFrame([(75, 1)], "a int, weight int"), R.life_table(spark), "a")
    sums = R.attributable_region(spark, sf).withColumn("n_years", F.col("n_days") / 365.25)
    return rounded(burden.years_of_life_lost(sums.join(F.broadcast(at)), F.col("ex")).select("region", "yll_heat", "yll_cold"), 3)


@query("SELECT CAST(count(*) AS BIGINT) AS n_regions, round(sum(yll_total), 3) AS total, round(avg(yll_total), 3) AS mean, round(median(yll_total), 3) AS median FROM (" + R.ORACLES["yll_region"] + ")", cte=False)
def yll_summary(spark, sf):
    return rounded(burden.yll_summary(R.yll_region(spark, sf)), 3)


@query("SELECT round((SELECT sum(heat_excess) FROM (" + R.ORACLES["annual_excess"] + ")) / nullif(heat_an, 0), 4) AS heat_ratio FROM (" + R.ORACLES["attributable_national"] + ")", cte=False)
def method_comparison(spark, sf):
    """Excess on hot days over the burden attributed to heat."""
    total = R.annual_excess(spark, sf).agg(F.sum("heat_excess").alias("heat_excess"))
    return rounded(excess.compare_methods(total, R.attributable_national(spark, sf), {"heat": ("heat_excess", "heat_an")}), 4)


# Models (no SQL: fitted by iteration)


@query()
def pool_reml(spark, sf):
    return pooling.pool_random(R.studies(spark, sf), ["region"], min_studies=3)


@query()
def stratum_difference_p(spark, sf):
    p = F.log("o_totalprice")
    s = records(spark, sf).groupBy("region", F.col("o_orderstatus").alias("s")).agg(F.avg(p).alias("y"), (F.stddev_samp(p) / F.sqrt(F.count(F.lit(1)))).alias("se"))
    return pooling.stratum_difference(s, ["region"], "s", "F", "O").select("region", "z", "p")


def pooled_at(spark, sf) -> tuple[DataFrame, object, DataFrame]:
    """The pooled fit, its spline, and the medians over regions of the percentiles."""
    fits, spline, _ = R.fitted_nations(spark, sf)
    return R.pooled_fit(fits), spline, P.median_of(fits.filter("status = 'success'"), list(dlnm.PERCENTILES))


@query()
def pooled_percentiles(spark, sf):
    pooled, spline, medians = pooled_at(spark, sf)
    return pooling.pooled_percentiles(pooled, spline, medians, list(dlnm.PERCENTILES), F.lit(sum(spline.boundary) / 2))


CURVE_SQL = """, k AS (SELECT region, avg(exposure) AS pos, 1 + stddev_samp(exposure) / 100 AS rr FROM p GROUP BY region, year(date), quarter(date)),
n AS (SELECT region, pos, rr, lead(pos) OVER w AS pos2, lead(rr) OVER w AS rr2, row_number() OVER w AS i FROM (SELECT region, pos, avg(rr) AS rr FROM k WHERE rr IS NOT NULL GROUP BY region, pos) WINDOW w AS (PARTITION BY region ORDER BY pos)),
m AS (SELECT p.region, p.date, p.exposure AS x, n.* EXCLUDE (region) FROM p JOIN n ON p.region = n.region AND (p.exposure >= n.pos OR n.i = 1) AND (n.pos2 IS NULL OR p.exposure < n.pos2)) """


def curves(spark, sf) -> DataFrame:
    """A curve for each region, with a knot a quarter, wherever its mean exposure is."""
    k = panel(spark, sf).groupBy("region", F.year("date"), F.quarter("date")).agg(F.avg("exposure").alias("at"), (1 + F.stddev_samp("exposure") / 100).alias("rr"))
    return k.select("region", "at", "rr")


@query(CURVE_SQL + "SELECT region, date, round(CASE WHEN x < pos OR pos2 IS NULL THEN rr ELSE rr + (rr2 - rr) * (x - pos) / (pos2 - pos) END, 6) AS rr FROM m")
def rr_by_region(spark, sf):
    """Each region's days on the region's own curve, with uneven knots."""
    return rounded(burden.curve_lookup(panel(spark, sf), "exposure", curves(spark, sf), ["region"]).select("region", "date", "rr"))


@query(CURVE_SQL + "SELECT region, date, round(CASE WHEN x < pos OR pos2 IS NULL OR x - pos <= pos2 - x THEN rr ELSE rr2 END, 6) AS rr FROM m")
def rr_by_region_nearest(spark, sf):
    return rounded(burden.curve_lookup(panel(spark, sf), "exposure", curves(spark, sf), ["region"], how="nearest").select("region", "date", "rr"))


@query()
def pooled_heterogeneity(spark, sf):
    """How the nations' curves differ: multivariate Q and its p-value, between-study variances."""
    fits, _, _ = R.fitted_nations(spark, sf)
    pooled = pooling.pool_multivariate(fits.filter("status = 'success'"), [])
    return pooled.select("n_studies", "method", "q", "df", "q_p", "i2", "h2", "tau2_trace", "tau2_mean")


@query()
def penalised_baseline(spark, sf):
    """The national series against a smooth baseline: cyclic season, trend, weekdays, penalties chosen by the data."""
    series = P.national_series(R.dense_panel(spark, sf), "date", ["deaths"], "exposure")
    expected, about = additive.penalised_baseline(series)
    return excess.excess(expected).select("date", "deaths", "expected", "excess", "excess_pct", F.lit(about["status"]).alias("status"))


@query()
def long_series_fit(spark, sf):
    """Each region's series, and all of them as one long series, by sums over rows: exposure spline, yearly wave, weekdays."""
    p = R.dense_panel(spark, sf)
    spline = R.exposure_spline(p)
    turn = F.dayofyear("date") * (2 * np.pi / 365.25)
    x = F.array(F.lit(1.0), *spline.columns(F.col("exposure")), F.sin(turn), F.cos(turn), *[(F.weekday("date") == k).cast("double") for k in range(1, 7)])
    levels = p.select(F.explode(F.array(F.lit("all"), F.col("region").cast("string"))).alias("level"), "deaths", x.alias("x"))
    return additive.fit_long(levels, ("level",)).drop("vcov")


@query()
def rr_curve(spark, sf):
    """The pooled curve on a grid of a tenth."""
    pooled, spline, _ = pooled_at(spark, sf)
    return burden.rr_lookup(pooled, spline, *spline.boundary, F.lit(sum(spline.boundary) / 2))


@query()
def quadratic_logit(spark, sf):
    p = R.dense_panel(spark, sf)
    middle = stats.selected_quantiles(p, "exposure", [0.5])[0] or 0.0
    fit = matched.quadratic_logit(p, "deaths", "exposure", middle, by=["region"])
    return spark.createDataFrame([(float(fit["beta"][0]), float(fit["beta"][1]), float(fit["optimum"]))], "log_or double, log_or_square double, optimum double")


@query()
def stratified_dlnm(spark, sf):
    """Distributed lags within strata of region, month and weekday: relative risks at percentiles of the exposure."""
    p = R.dense_panel(spark, sf)
    spline = R.exposure_spline(p, (0.5,))
    fit = matched.stratified_dlnm(dlnm.cross_basis(p, "exposure", spline, 7, 3), spline, lag_df=3, by=["region"])
    q = stats.selected_quantiles(p, "exposure", list(dlnm.PERCENTILES.values()))
    rr, se = dlnm.cumulative_rr(fit["beta"], fit["covariance"], spline, np.array(q), q[2], 7, 3)
    rows = [(name, float(x), float(np.exp(r)), float(s), float(fit["dispersion"])) for name, x, r, s in zip(dlnm.PERCENTILES, q, rr, se)]
    return spark.createDataFrame(rows, "percentile string, at double, rr double, se double, dispersion double")
