"""Registered queries over the driver's tables, one or more for each operator family, with DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epispark.functions import parse, stats
from epispark.functions.splines import NaturalSpline
from epispark.operators import burden, dlnm, excess, geo, matched, pooling, quality
from epispark.operators import panel as P
from epispark.operators.lineage import cut
from epispark.operators import timeseries as ts
from epispark.plans.surrogates import CTE, deaths, dense_panel, exposure, panel, records, table
from epispark.sources import io

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, cte: bool = True):
    """Register a query under its function's name, with its SQL."""

    def put(function):
        name = function.__name__
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = (CTE if cte else "") + sql
        return function

    return put


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def is_elderly():
    return F.col("o_totalprice") >= 200000


def is_cvd():
    return F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")


# Panels and strata


@query("SELECT region, date, deaths FROM d")
def event_panel_count(spark, sf):
    return deaths(spark, sf)


@query("SELECT region, date, deaths FROM dense")
def event_panel_dense(spark, sf):
    return P.densify(deaths(spark, sf), fill=["deaths"])


@query("SELECT region, date, deaths, round(exposure, 6) AS exposure FROM p")
def panel_join(spark, sf):
    return rounded(panel(spark, sf))


@query("SELECT d.region, d.date, deaths, round(exposure, 6) AS exposure FROM d LEFT JOIN x ON d.region = x.region AND d.date = x.date")
def panel_left_join(spark, sf):
    return rounded(P.join_panels(deaths(spark, sf), exposure(spark, sf), how="left"))


@query("""SELECT 'region' AS level, CAST(region AS VARCHAR) AS region, date, s AS stratum, CAST(count(*) AS BIGINT) AS n
FROM (SELECT region, date, unnest(list_filter(['all', CASE WHEN o_totalprice >= 200000 THEN 'elderly' END, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'cvd' END, CASE WHEN o_orderstatus = 'F' THEN 'female' END], lambda z: z IS NOT NULL)) AS s FROM ev) GROUP BY ALL
UNION ALL SELECT 'nation', CAST(nation AS VARCHAR), date, s, CAST(count(*) AS BIGINT)
FROM (SELECT nation, date, unnest(list_filter(['all', CASE WHEN o_totalprice >= 200000 THEN 'elderly' END, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'cvd' END, CASE WHEN o_orderstatus = 'F' THEN 'female' END], lambda z: z IS NOT NULL)) AS s FROM ev) GROUP BY ALL""")
def strata_cube(spark, sf):
    return P.strata_cube(records(spark, sf), "date", ["region", "nation"], {"elderly": is_elderly(), "cvd": is_cvd(), "female": F.col("o_orderstatus") == "F"})


@query("SELECT region, date, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (o_totalprice >= 200000) AS BIGINT) AS elderly, CAST(count(*) FILTER (o_totalprice >= 200000 AND o_orderpriority IN ('1-URGENT', '2-HIGH')) AS BIGINT) AS elderly_cvd FROM ev GROUP BY ALL")
def strata_counts(spark, sf):
    return P.count_strata(records(spark, sf), ["region", "date"], {"elderly": is_elderly(), "elderly_cvd": is_elderly() & is_cvd()})


@query("SELECT region, date, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS sex_F, CAST(count(*) FILTER (o_orderstatus = 'O') AS BIGINT) AS sex_O, CAST(count(*) FILTER (o_orderstatus = 'P') AS BIGINT) AS sex_P FROM ev GROUP BY ALL")
def strata_pivot(spark, sf):
    return P.pivot_strata(records(spark, sf), ["region", "date"], "o_orderstatus", ["F", "O", "P"], "sex_")


@query("SELECT CAST(year(date) AS INTEGER) AS year, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (o_totalprice >= 200000) AS BIGINT) AS elderly, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS female FROM ev GROUP BY 1")
def yearly_summary(spark, sf):
    return P.yearly_summary(records(spark, sf).withColumn("year", F.year("date")), "year", {"elderly": is_elderly(), "female": F.col("o_orderstatus") == "F"})


@query("SELECT CAST(year(date) AS INTEGER) AS year, CAST(sum(deaths) AS BIGINT) AS total, count(DISTINCT date) AS n_days, count(DISTINCT region) AS n_regions FROM d GROUP BY 1")
def yearly_coverage(spark, sf):
    return P.coverage(deaths(spark, sf).withColumn("year", F.year("date")), ["year"], "date", "region", "deaths")


@query("SELECT date, CAST(sum(deaths) AS BIGINT) AS deaths, round(avg(exposure), 6) AS exposure_mean, round(min(exposure), 6) AS exposure_min, round(max(exposure), 6) AS exposure_max FROM p GROUP BY date")
def national_series(spark, sf):
    return rounded(P.national_series(panel(spark, sf), "date", ["deaths"], "exposure"))


@query("SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM ev GROUP BY ALL")
def value_counts(spark, sf):
    return P.value_counts(records(spark, sf), "o_orderpriority")


@query("SELECT DISTINCT region, nation FROM ev")
def distinct_keys(spark, sf):
    return records(spark, sf).select("region", "nation").distinct()


@query("SELECT CAST(count(*) AS BIGINT) AS n_rows, count(DISTINCT region) AS n_regions, min(date) AS first_date, max(date) AS last_date, CAST(sum(deaths) AS BIGINT) AS total FROM d")
def inventory(spark, sf):
    return quality.inventory(deaths(spark, sf), "region", "date", "deaths")


# Grid readings


@query("""SELECT user_id, CAST(ts AS DATE) AS date, round(avg(value), 6) AS value_mean, min(value) AS value_min, max(value) AS value_max FROM events GROUP BY ALL""", cte=False)
def daily_extremes_from_hours(spark, sf):
    return rounded(P.daily_extremes(table(spark, sf, "events"), ["user_id"], "ts", "value"))


@query("""SELECT CAST(user_id % 7 AS BIGINT) AS region, date, round(avg(a), 6) AS value_mean, round(avg(b), 6) AS value_min, round(avg(c), 6) AS value_max
FROM (SELECT user_id, CAST(ts AS DATE) AS date, avg(value) AS a, min(value) AS b, max(value) AS c FROM events GROUP BY ALL) GROUP BY ALL""", cte=False)
def region_mean_of_cells(spark, sf):
    cells = P.daily_extremes(table(spark, sf, "events"), ["user_id"], "ts", "value").withColumn("region", F.col("user_id") % 7)
    return rounded(P.region_mean(cells, "region", "date", ["value_mean", "value_min", "value_max"]))


@query("""SELECT user_id, CAST(t AS DATE) AS date, round(avg(value), 6) AS value FROM (SELECT date_trunc('hour', ts) AS t, user_id, max(value) AS value FROM events GROUP BY ALL) GROUP BY ALL""", cte=False)
def daily_grid(spark, sf):
    hours = table(spark, sf, "events").select(F.date_trunc("hour", "ts").alias("ts"), "user_id", "value")
    return rounded(P.daily_grid(hours, ["user_id"], "ts", ["value"]))


@query("""SELECT CAST(isoyear(CAST(ts AS DATE)) AS INTEGER) AS iso_year, CAST(week(CAST(ts AS DATE)) AS INTEGER) AS iso_week, CAST(date_trunc('week', CAST(ts AS DATE)) AS DATE) AS week_start,
CAST(count(*) AS BIGINT) AS cases, CAST(count(*) FILTER (event_type = 'error' AND value > 10) AS BIGINT) AS severe, min(CAST(ts AS DATE)) AS first_date, max(CAST(ts AS DATE)) AS last_date FROM events GROUP BY ALL""", cte=False)
def iso_week_counts(spark, sf):
    rows = table(spark, sf, "events").withColumn("date", F.to_date("ts"))
    return P.count_flags(rows, [c.alias(n) for n, c in parse.iso_week("date").items()], {"severe": (F.col("event_type") == "error") & (F.col("value") > 10)}, "date")


# Parsing: raw strings are made from the orders


RAW_SQL = """WITH raw AS (SELECT o_orderkey, CASE WHEN year(o_orderdate) % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 11 = 0 THEN '32132020' ELSE ltrim(strftime(o_orderdate, '%d%m%Y'), '0') END AS dt,
CASE WHEN o_custkey % 13 = 0 THEN 'x' WHEN o_custkey % 7 = 0 THEN CAST(o_custkey % 400 AS VARCHAR) ELSE CAST(400 + o_custkey % 120 AS VARCHAR) END AS age,
CASE o_orderstatus WHEN 'F' THEN 'Feminino' WHEN 'O' THEN '1' ELSE 'Ignorado' END AS sex,
substr('IJVKXYTW', CAST(o_orderkey % 8 AS INTEGER) + 1, 1) || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') END AS icd,
CAST(110000 + o_custkey % 900 AS VARCHAR) || CAST(o_custkey % 10 AS VARCHAR) AS muni, o_orderdate FROM orders) """


def raw_strings(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("d", F.to_date("o_orderdate"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        "o_orderkey", "d",
        F.when(F.year("d") % 2 == 0, F.date_format("d", "yyyy-MM-dd")).when(k % 11 == 0, "32132020").otherwise(F.regexp_replace(F.date_format("d", "ddMMyyyy"), "^0+", "")).alias("dt"),
        F.when(c % 13 == 0, "x").when(c % 7 == 0, (c % 400).cast("string")).otherwise((400 + c % 120).cast("string")).alias("age"),
        F.when(F.col("o_orderstatus") == "F", "Feminino").when(F.col("o_orderstatus") == "O", "1").otherwise("Ignorado").alias("sex"),
        F.concat(F.substring(F.lit("IJVKXYTW"), (k % 8).cast("int") + 1, F.lit(1)), F.when(k % 5 == 0, "").otherwise(F.lpad((k % 100).cast("string"), 2, "0"))).alias("icd"),
        F.concat((110000 + c % 900).cast("string"), (c % 10).cast("string")).alias("muni"),
    )


@query(RAW_SQL + "SELECT o_orderkey, coalesce(CAST(try_strptime(dt, '%Y-%m-%d') AS DATE), CASE WHEN regexp_full_match(dt, '[0-9]{7,8}') THEN CAST(try_strptime(lpad(dt, 8, '0'), '%d%m%Y') AS DATE) END) AS date FROM raw", cte=False)
def parse_dates(spark, sf):
    return raw_strings(spark, sf).select("o_orderkey", parse.parse_date("dt").alias("date"))


@query(RAW_SQL + """, v AS (SELECT o_orderkey, age, CAST(floor(TRY_CAST(age AS DOUBLE)) AS INTEGER) AS v FROM raw) SELECT o_orderkey,
CASE WHEN v >= 400 THEN v - 400 WHEN v IS NOT NULL THEN 0 END AS age_a, CASE WHEN v >= 400 THEN v - 400 WHEN v < 200 THEN v WHEN v IS NOT NULL THEN 0 END AS age_b,
CASE WHEN v >= 400 THEN v - 400 WHEN v < 200 THEN v END AS age_c, CASE WHEN v >= 400 THEN v - 400 END AS age_e,
CASE WHEN regexp_full_match(age, '[0-9]+') THEN CAST(CASE WHEN age LIKE '4%' AND length(age) >= 3 THEN substr(age, 2) ELSE age END AS INTEGER) END AS age_d FROM v""", cte=False)
def decode_age(spark, sf):
    return raw_strings(spark, sf).select("o_orderkey", *[parse.decode_age("age", v).alias(f"age_{v.lower()}") for v in "ABCDE"])


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 4 THEN CAST(o_custkey % 110 AS INTEGER) WHEN 3 THEN CAST(floor((o_custkey % 110) / 12.0) AS INTEGER) WHEN 2 THEN CAST(floor((o_custkey % 110) / 365.0) AS INTEGER) WHEN 1 THEN 0 END AS age_f,
CASE o_orderkey % 5 WHEN 3 THEN CAST(o_custkey % 110 AS INTEGER) WHEN 2 THEN CAST(floor((o_custkey % 110) / 365.0) AS INTEGER) WHEN 1 THEN 0 END AS age_g FROM orders""", cte=False)
def decode_age_units(spark, sf):
    o = table(spark, sf, "orders").withColumns({"u": F.col("o_orderkey") % 5, "v": F.col("o_custkey") % 110})
    return o.select("o_orderkey", parse.decode_age((F.col("u") * 1000 + F.col("v")).cast("string"), "F").alias("age_f"), parse.decode_age(F.col("v").cast("string"), "G", "u").alias("age_g"))


@query(RAW_SQL + """SELECT o_orderkey, CASE WHEN sex = 'Feminino' THEN 'F' WHEN sex = '1' THEN 'M' END AS sex,
CASE WHEN icd LIKE 'I%' THEN 'cvd' WHEN icd LIKE 'J%' THEN 'respiratory' WHEN substr(icd, 1, 1) IN ('V', 'W', 'X', 'Y') THEN 'external' ELSE 'other' END AS cause,
CASE WHEN length(icd) < 3 THEN 'other' WHEN icd LIKE 'I%' THEN 'cvd' WHEN icd LIKE 'J%' THEN 'respiratory' WHEN substr(icd, 1, 1) IN ('V', 'W', 'X', 'Y') THEN 'external' ELSE 'other' END AS cause_strict,
CAST(icd LIKE 'J%' AS INTEGER) AS is_resp, CAST(icd LIKE 'I%' AS INTEGER) AS is_cvd, CAST(icd LIKE 'T67%' OR icd LIKE 'X30%' AS INTEGER) AS is_heat, CAST(substr(muni, 1, 6) AS INTEGER) AS muni_6, CAST(CAST(muni AS INTEGER) // 10 AS INTEGER) AS muni_div FROM raw""", cte=False)
def classify_code(spark, sf):
    r = raw_strings(spark, sf)
    return r.select("o_orderkey", parse.decode_sex("sex").alias("sex"), parse.classify_cause("icd").alias("cause"), parse.classify_cause("icd", strict=True).alias("cause_strict"), *[c.alias(k) for k, c in parse.cause_flags("icd").items()], parse.municipality_code("muni").alias("muni_6"), parse.municipality_code(F.col("muni").cast("int"), True).alias("muni_div"))


@query(RAW_SQL + "SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (TRY_CAST(age AS DOUBLE) IS NULL) AS BIGINT) AS n_failed, round(count(*) FILTER (TRY_CAST(age AS DOUBLE) IS NULL) / count(*), 6) AS failure_rate FROM raw", cte=False)
def parse_failures(spark, sf):
    return rounded(quality.parse_failures(raw_strings(spark, sf), "age", parse.decode_age("age")))


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 110 >= 80 THEN '80+' WHEN o_custkey % 110 >= 70 THEN '70-79' WHEN o_custkey % 110 >= 60 THEN '60-69' END AS band,
CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(dayofyear(o_orderdate) AS INTEGER) AS doy, CAST(isodow(o_orderdate) AS INTEGER) AS dow,
CAST(CAST(o_orderdate AS DATE) - DATE '1995-01-01' AS INTEGER) AS time, strftime(o_orderdate, '%Y_') || CAST(month(o_orderdate) AS VARCHAR) || '_' || CAST(isodow(o_orderdate) AS VARCHAR) AS stratum FROM orders""", cte=False)
def calendar_features(spark, sf):
    o = table(spark, sf, "orders").withColumn("d", F.to_date("o_orderdate"))
    return o.select("o_orderkey", parse.age_band(F.col("o_custkey") % 110).alias("band"), *[c.alias(n) for n, c in parse.calendar_features("d", F.lit("1995-01-01").cast("date")).items()], matched.stratum_key("d").alias("stratum"))


@query("""SELECT region, date, round(CASE WHEN exposure IS NOT NULL THEN exposure + 0.33 * (h / 100 * st) - 4.0 END, 6) AS apparent FROM (
SELECT region, date, exposure, 6.112 * exp(17.67 * exposure / (exposure + 243.5)) AS st, least(greatest(100 * (6.112 * exp(17.67 * (exposure - 5) / (exposure - 5 + 243.5))) / (6.112 * exp(17.67 * exposure / (exposure + 243.5))), 0), 100) AS h FROM p)""")
def apparent_temperature(spark, sf):
    p = panel(spark, sf).withColumn("dew", F.col("exposure") - 5)
    return rounded(p.select("region", "date", parse.apparent_temperature("exposure", "dew").alias("apparent")))


@query("""SELECT region, date, round(exposure + 273.15 - 273.15, 6) AS celsius, round(exposure * 1e-9 * 1e9, 6) AS micrograms, round(exposure * 2.1415e-5 / 2.1415e-5, 6) AS dobson FROM p""")
def unit_conversions(spark, sf):
    p = panel(spark, sf).withColumn("kelvin", F.col("exposure") + 273.15)
    return rounded(p.select("region", "date", parse.temperature_in_celsius(p, "kelvin").alias("celsius"), parse.to_micrograms(F.col("exposure") * 1e-9).alias("micrograms"), parse.to_dobson(F.col("exposure") * 2.1415e-5).alias("dobson")))


@query("""WITH y AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders), e AS (SELECT y, CASE y WHEN 1995 THEN DATE '1995-04-16' WHEN 1996 THEN DATE '1996-04-07' WHEN 1997 THEN DATE '1997-03-30' WHEN 1998 THEN DATE '1998-04-12' WHEN 1999 THEN DATE '1999-04-04' WHEN 2000 THEN DATE '2000-04-23' WHEN 2001 THEN DATE '2001-04-15' WHEN 2002 THEN DATE '2002-03-31' END AS e FROM y)
SELECT CAST(y AS INTEGER) AS year, CAST(e - k AS DATE) AS date FROM e, (SELECT unnest([47, 48, 49, 50]) AS k)""", cte=False)
def carnival_days(spark, sf):
    years = table(spark, sf, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    return parse.carnival_days(years)


# Joins and lookups


@query("SELECT o_orderkey, coalesce(a.n_name, b.n_name) AS n_name FROM (SELECT o_orderkey, o_custkey % 40 AS code FROM orders) LEFT JOIN nation a ON a.n_nationkey = code LEFT JOIN nation b ON b.n_nationkey + 30 = code", cte=False)
def two_key_lookup(spark, sf):
    nation = table(spark, sf, "nation").select("n_nationkey", (F.col("n_nationkey") + 30).alias("second"), "n_name")
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 40).alias("code"))
    return P.lookup_region(o, "code", nation, "n_nationkey", "second").select("o_orderkey", "n_name")


@query("SELECT DISTINCT o_custkey % 40 AS code FROM orders WHERE o_custkey % 40 NOT IN (SELECT n_nationkey FROM nation)", cte=False)
def unmatched_codes(spark, sf):
    return P.unmatched_codes(table(spark, sf, "orders").select((F.col("o_custkey") % 40).alias("code")), "code", table(spark, sf, "nation"), "n_nationkey")


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(n_name) AS BIGINT) AS n_matched, round(count(n_name) / count(*), 6) AS match_rate FROM orders LEFT JOIN nation ON n_nationkey = o_custkey % 40", cte=False)
def match_rate(spark, sf):
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 40).alias("code"))
    looked = P.lookup_region(o, "code", table(spark, sf, "nation").select("n_nationkey", "n_name"), "n_nationkey")
    return rounded(quality.match_rate(looked, F.col("n_name").isNotNull()))


@query("""WITH q AS (SELECT c_custkey, c_acctbal / 100 AS x, c_custkey % 100 AS y FROM customer), s AS (SELECT s_suppkey, s_acctbal / 100 AS x, s_suppkey % 100 AS y FROM supplier),
j AS (SELECT c_custkey, s_suppkey, sqrt(pow(q.x - s.x, 2) + pow(q.y - s.y, 2)) AS distance, row_number() OVER (PARTITION BY c_custkey ORDER BY pow(q.x - s.x, 2) + pow(q.y - s.y, 2), s_suppkey) AS rn FROM q, s)
SELECT c_custkey, s_suppkey, round(distance, 6) AS distance FROM j WHERE rn = 1""", cte=False)
def nearest_join(spark, sf):
    q = table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") / 100).alias("lon"), (F.col("c_custkey") % 100).cast("double").alias("lat"))
    s = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_acctbal") / 100).alias("lon"), (F.col("s_suppkey") % 100).cast("double").alias("lat"))
    return rounded(geo.nearest_join(q, s, "c_custkey", "s_suppkey"))


@query("""WITH q AS (SELECT c_custkey, c_acctbal / 100 AS x, c_custkey % 100 AS y FROM customer), s AS (SELECT s_suppkey, s_acctbal / 100 AS x, s_suppkey % 100 AS y FROM supplier),
j AS (SELECT s_suppkey, min(sqrt(pow(q.x - s.x, 2) + pow(q.y - s.y, 2))) AS d FROM q, s GROUP BY 1)
SELECT CAST(count(*) AS BIGINT) AS n, round(quantile_cont(d, 0.5), 6) AS p50, round(quantile_cont(d, 0.9), 6) AS p90, round(quantile_cont(d, 0.95), 6) AS p95, round(max(d), 6) AS max, CAST(count(*) FILTER (d > 0.5) AS BIGINT) AS n_far FROM j""", cte=False)
def distance_audit(spark, sf):
    q = table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") / 100).alias("lon"), (F.col("c_custkey") % 100).cast("double").alias("lat"))
    s = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_acctbal") / 100).alias("lon"), (F.col("s_suppkey") % 100).cast("double").alias("lat"))
    return rounded(geo.distance_audit(geo.nearest_join(s, q, "s_suppkey", "c_custkey")))


@query("SELECT nation, arg_min(o_orderpriority, (-n, o_orderpriority)) AS o_orderpriority FROM (SELECT nation, o_orderpriority, count(*) AS n FROM ev GROUP BY ALL) GROUP BY nation")
def mode_by_group(spark, sf):
    return P.mode_by(records(spark, sf), "nation", "o_orderpriority")


@query("SELECT n_nationkey AS nation, CAST(sum(c_custkey) AS BIGINT) AS c_custkey, count(DISTINCT c_mktsegment) AS n_c_mktsegment FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1", cte=False)
def region_sums(spark, sf):
    c = table(spark, sf, "customer").withColumnRenamed("c_nationkey", "nation")
    return P.sums_and_members(c, "nation", ["c_custkey"], "c_mktsegment")


NATION_SQL = "WITH n AS (SELECT c_nationkey AS nation, CAST(count(*) AS BIGINT) AS pop, sum(c_acctbal) AS wealth, CAST(count(*) FILTER (c_mktsegment = 'BUILDING') AS BIGINT) AS urban FROM customer GROUP BY 1) "


def nations(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("pop"), F.sum("c_acctbal").alias("wealth"), F.count_if(F.col("c_mktsegment") == "BUILDING").alias("urban"))


@query(NATION_SQL + "SELECT nation, round(((1 - (pop - (SELECT min(pop) FROM n)) / nullif((SELECT max(pop) - min(pop) FROM n), 0)) + (1 - (wealth - (SELECT min(wealth) FROM n)) / nullif((SELECT max(wealth) - min(wealth) FROM n), 0))) / 2, 6) AS vulnerability FROM n", cte=False)
def minmax_index(spark, sf):
    return rounded(P.vulnerability(nations(spark, sf), ["pop", "wealth"]).select("nation", "vulnerability"))


@query(NATION_SQL + "SELECT nation, round((wealth - (SELECT avg(wealth) FROM n)) / (SELECT stddev_samp(wealth) FROM n), 6) AS wealth_z FROM n", cte=False)
def zscore(spark, sf):
    return rounded(P.z_scores(nations(spark, sf), ["wealth"]).select("nation", "wealth_z"))


@query(NATION_SQL + "SELECT nation, round(least(urban * 500.0 / nullif(pop, 0), 100), 6) AS urban_pct, round(wealth * 1000 / nullif(pop, 0), 6) AS gdp_per_capita FROM n", cte=False)
def ratio_capped(spark, sf):
    n = nations(spark, sf)
    return rounded(n.select("nation", parse.ratio_capped("urban", "pop", 500.0).alias("urban_pct"), parse.ratio_capped("wealth", "pop", 1000.0, None).alias("gdp_per_capita")))


@query(NATION_SQL + ", e AS (SELECT nation, count(*) AS k FROM (SELECT c_nationkey AS nation FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY 1) SELECT n.nation, round(CASE WHEN pop > 0 THEN k / pop * 100000 END, 6) AS rate FROM n JOIN e ON n.nation = e.nation", cte=False)
def rate_per_100k(spark, sf):
    k = P.count_events(records(spark, sf), ["nation"], name="k")
    return rounded(P.join_covariates(k, nations(spark, sf), on="nation").select("nation", parse.rate_per_100k("k", "pop").alias("rate")))


@query("SELECT c_mktsegment, round(avg(c_acctbal), 1) AS c_acctbal FROM customer GROUP BY 1", cte=False)
def macro_means(spark, sf):
    return P.macro_means(table(spark, sf, "customer"), "c_mktsegment", ["c_acctbal"])


# Time series


@query("SELECT region, date, round(exposure, 6) AS lag0, round(lag(exposure, 1) OVER w, 6) AS lag1, round(lag(exposure, 2) OVER w, 6) AS lag2, round(lag(exposure, 3) OVER w, 6) AS lag3 FROM p WINDOW w AS (PARTITION BY region ORDER BY date)")
def lag_matrix(spark, sf):
    return rounded(ts.lag_matrix(panel(spark, sf), "exposure", 3, ["region"]).drop("deaths", "exposure"))


@query("SELECT a.region, a.date, a.deaths AS lag0, b.deaths AS lag1, c.deaths AS lag7 FROM d a LEFT JOIN d b ON a.region = b.region AND b.date = a.date - 1 LEFT JOIN d c ON a.region = c.region AND c.date = a.date - 7")
def calendar_lags(spark, sf):
    return ts.calendar_lags(deaths(spark, sf), "deaths", 7, ["region"]).select("region", "date", "lag0", "lag1", "lag7")


@query("""SELECT region, date, CAST(CASE WHEN hot THEN count(*) OVER (PARTITION BY region, hot, island) ELSE 0 END AS BIGINT) AS run_length, CAST(CASE WHEN hot THEN count(*) OVER (PARTITION BY region, hot, island) ELSE 0 END >= 2 AS INTEGER) AS in_run FROM (
SELECT region, date, hot, row_number() OVER (PARTITION BY region ORDER BY date) - row_number() OVER (PARTITION BY region, hot ORDER BY date) AS island FROM (SELECT region, date, exposure > (SELECT quantile_cont(exposure, 0.95) FROM p) AS hot FROM p))""")
def heatwave_runs(spark, sf):
    placed = ts.attach_quantiles(panel(spark, sf), "exposure", {"p95": 0.95})
    return ts.runs(placed, F.col("exposure") > F.col("p95"), ["region"], min_length=2).select("region", "date", "run_length", "in_run")


@query("""SELECT region, date, round(coalesce(v, CASE WHEN a1 - a0 - 1 <= 3 THEN v0 + (v1 - v0) * (pos - a0) / (a1 - a0) END), 6) AS exposure FROM (
SELECT *, last_value(v IGNORE NULLS) OVER b AS v0, last_value(k IGNORE NULLS) OVER b AS a0, first_value(v IGNORE NULLS) OVER f AS v1, first_value(k IGNORE NULLS) OVER f AS a1 FROM (
SELECT region, date, pos, v, CASE WHEN v IS NOT NULL THEN pos END AS k FROM (SELECT region, date, row_number() OVER (PARTITION BY region ORDER BY date) AS pos, CASE WHEN day(date) % 4 = 0 OR day(date) BETWEEN 10 AND 14 THEN NULL ELSE exposure END AS v FROM p))
WINDOW b AS (PARTITION BY region ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY region ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""")
def gap_fill_linear(spark, sf):
    d = F.dayofmonth("date")
    holes = panel(spark, sf).withColumn("exposure", F.when((d % 4 == 0) | d.between(10, 14), None).otherwise(F.col("exposure")))
    return rounded(ts.fill_gaps(holes, "exposure", ["region"], max_gap=3).select("region", "date", "exposure"))


@query("SELECT round(quantile_cont(exposure, 0.1), 6) AS p10, round(quantile_cont(exposure, 0.75), 6) AS p75, round(quantile_cont(exposure, 0.9), 6) AS p90 FROM p")
def quantiles_global(spark, sf):
    q = stats.quantiles(panel(spark, sf), "exposure", [0.1, 0.75, 0.9])
    return rounded(q.select(*[F.col("q")[i].alias(n) for i, n in enumerate(("p10", "p75", "p90"))]))


@query("SELECT region, round(quantile_cont(exposure, 0.01), 6) AS p1, round(quantile_cont(exposure, 0.5), 6) AS p50, round(quantile_cont(exposure, 0.99), 6) AS p99, round(stddev_samp(exposure), 6) AS exposure_sd, round(max(exposure) - min(exposure), 6) AS exposure_range FROM p GROUP BY region")
def quantiles_by_region(spark, sf):
    p = panel(spark, sf)
    q = stats.quantiles(p, "exposure", [0.01, 0.5, 0.99], ["region"])
    return rounded(q.select("region", *[F.col("q")[i].alias(n) for i, n in enumerate(("p1", "p50", "p99"))]).join(P.spread(p, "region", "exposure"), "region"))


FLAGS_SQL = """, q AS (SELECT region, quantile_cont(exposure, 0.01) AS p1, quantile_cont(exposure, 0.025) AS p2_5, quantile_cont(exposure, 0.975) AS p97_5, quantile_cont(exposure, 0.99) AS p99 FROM pd GROUP BY region),
fl AS (SELECT pd.*, exposure > 25 AS is_heat, exposure < 25 AS is_cold, exposure > p97_5 AS is_extreme_heat, exposure < p2_5 AS is_extreme_cold, exposure > p99 AS is_heat_p99, exposure < p1 AS is_cold_p1, abs(exposure - 25) <= 2 AS is_near_optimal FROM pd JOIN q USING (region))
"""
CUTS = {"p1": 0.01, "p2_5": 0.025, "p97_5": 0.975, "p99": 0.99}


def flagged_panel(spark, sf) -> DataFrame:
    placed = ts.attach_quantiles(dense_panel(spark, sf), "exposure", CUTS, ["region"])
    return ts.extreme_flags(placed, "exposure", 25.0).drop(*CUTS)


@query(FLAGS_SQL + "SELECT region, date, CAST(deaths AS BIGINT) AS deaths, round(exposure, 6) AS exposure, is_heat, is_cold, is_extreme_heat, is_extreme_cold, is_heat_p99, is_cold_p1, is_near_optimal FROM fl")
def extreme_flags(spark, sf):
    return rounded(flagged_panel(spark, sf))


@query(""", h AS (SELECT date, CAST(isodow(date) = 7 OR (month(date) = 1 AND day(date) = 1) AS INTEGER) AS is_holiday FROM (SELECT DISTINCT date FROM dense))
SELECT date, is_holiday, CAST(coalesce((SELECT 1 FROM h b WHERE b.date = h.date + 1 AND b.is_holiday = 1), 0) AS INTEGER) AS is_day_before_holiday, CAST(coalesce((SELECT 1 FROM h b WHERE b.date = h.date - 1 AND b.is_holiday = 1), 0) AS INTEGER) AS is_day_after_holiday,
CAST(greatest(is_holiday, coalesce((SELECT 1 FROM h b WHERE b.date = h.date + 1 AND b.is_holiday = 1), 0), coalesce((SELECT 1 FROM h b WHERE b.date = h.date - 1 AND b.is_holiday = 1), 0)) AS INTEGER) AS is_holiday_week FROM h""")
def holiday_window_flags(spark, sf):
    span = deaths(spark, sf).agg(F.min("date").alias("a"), F.max("date").alias("b"))
    days = span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("date"))
    marked = days.withColumn("is_holiday", ((F.weekday("date") == 6) | ((F.month("date") == 1) & (F.dayofmonth("date") == 1))).cast("int"))
    return ts.neighbour_flags(marked)


@query("SELECT region, date, CAST(date - (SELECT min(date) FROM d) AS INTEGER) AS time FROM d")
def time_index(spark, sf):
    return ts.time_index(deaths(spark, sf)).select("region", "date", "time")


@query("SELECT region, CAST(count(*) FILTER (abs(exposure - a) <= 1) AS BIGINT) AS n_near_p1, CAST(count(*) FILTER (abs(exposure - b) <= 1) AS BIGINT) AS n_near_p99 FROM p JOIN (SELECT region, quantile_cont(exposure, 0.01) AS a, quantile_cont(exposure, 0.99) AS b FROM p GROUP BY region) USING (region) GROUP BY region")
def local_support(spark, sf):
    return ts.local_support(panel(spark, sf), "exposure", ["region"])


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM ev ORDER BY o_custkey, date DESC, o_orderkey")
def latest_per_key(spark, sf):
    return ts.keep_one(records(spark, sf), ["o_custkey"], [F.desc("date"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query(", y AS (SELECT year(date) AS year FROM d GROUP BY 1) SELECT CAST(r AS INTEGER) AS year FROM range(1990, 2011) t(r) WHERE r NOT IN (SELECT year FROM y)")
def missing_years(spark, sf):
    return quality.missing_years(deaths(spark, sf), "date", "deaths", 1990, 2010)


@query("""SELECT region, round(count(exposure) / count(*), 6) AS exposure_share, round(count(flu) / count(*), 6) AS flu_share, round(least(count(exposure) / count(*), count(flu) / count(*)), 6) AS coverage
FROM (SELECT dense.region, exposure, CASE WHEN deaths > 1 THEN deaths END AS flu FROM dense LEFT JOIN x USING (region, date)) GROUP BY region""")
def coverage_share(spark, sf):
    full = P.join_panels(P.densify(deaths(spark, sf), fill=["deaths"]), exposure(spark, sf), how="left").withColumn("flu", F.when(F.col("deaths") > 1, F.col("deaths")))
    return rounded(quality.coverage_share(full, ["region"], ["exposure", "flu"]))


@query("SELECT region, date, deaths FROM d WHERE region IN (SELECT region FROM dense LEFT JOIN x USING (region, date) GROUP BY region HAVING count(exposure) / count(*) >= 0.7)")
def coverage_filter(spark, sf):
    full = P.join_panels(P.densify(deaths(spark, sf), fill=["deaths"]), exposure(spark, sf), how="left")
    good = quality.coverage_share(full, ["region"], ["exposure"]).filter("coverage >= 0.7").select("region")
    return deaths(spark, sf).join(good, "region", "left_semi")


@query("SELECT nation, CAST(count(*) AS BIGINT) AS n FROM ev WHERE nation IN (SELECT nation FROM ev GROUP BY nation HAVING count(*) >= 365 AND count(*) FILTER (o_totalprice > 400000) >= 10) GROUP BY nation")
def minimum_size_filters(spark, sf):
    kept = quality.min_events(quality.min_rows(records(spark, sf), ["nation"], 365), ["nation"], F.col("o_totalprice") > 400000, 10)
    return P.count_events(kept, ["nation"], name="n")


@query("""SELECT region, CAST(count(*) AS BIGINT) AS n_days, round(max(exposure) - min(exposure), 6) AS temp_range, round(avg(exposure), 6) AS temp_mean, round(stddev_samp(exposure), 6) AS temp_sd, CAST(sum(deaths) AS BIGINT) AS deaths_total, round(avg(deaths), 6) AS deaths_mean,
round(count(*) FILTER (deaths = 0) / count(*) * 100, 6) AS deaths_zero_pct, round(quantile_cont(exposure, 0.01), 6) AS temp_p1, round(quantile_cont(exposure, 0.99), 6) AS temp_p99 FROM pd GROUP BY region""")
def region_diagnostics(spark, sf):
    return rounded(quality.region_diagnostics(dense_panel(spark, sf), "region", "exposure", "deaths"))


# Burden and years of life lost, given a curve

CURVE = [1 + 0.0006 * (i * 0.5 - 22.0) ** 2 for i in range(101)]
RR_SQL = """, c AS (SELECT CAST(i AS INTEGER) AS i, 1 + 0.0006 * pow(i * 0.5 - 22.0, 2) AS rr FROM range(0, 101) t(i)),
l AS (SELECT fl.*, least(greatest(exposure / 0.5, 0), 100) AS pos FROM fl),
r AS (SELECT l.*, a.rr + (b.rr - a.rr) * (pos - a.i) AS rr FROM l JOIN c a ON a.i = least(floor(pos), 99) JOIN c b ON b.i = a.i + 1),
an AS (SELECT *, CASE WHEN rr > 1 THEN (rr - 1) / rr ELSE 0 END AS af, CASE WHEN rr > 1 THEN (rr - 1) / rr ELSE 0 END * deaths AS an FROM r)
"""


def attributable_rows(spark, sf) -> DataFrame:
    return burden.attributable(flagged_panel(spark, sf), burden.interpolate(F.col("exposure"), 0.0, 0.5, CURVE))


@query(FLAGS_SQL + RR_SQL + "SELECT region, date, round(rr, 8) AS rr, round(af, 8) AS af, round(an, 8) AS an FROM an")
def rr_interpolate(spark, sf):
    return rounded(attributable_rows(spark, sf).select("region", "date", "rr", "af", "an"), 8)


@query(FLAGS_SQL + ", c AS (SELECT CAST(i AS INTEGER) AS i, 1 + 0.0006 * pow(i * 0.5 - 22.0, 2) AS rr FROM range(0, 101) t(i)) SELECT region, date, round(rr, 6) AS rr FROM fl JOIN c ON c.i = least(greatest(ceil(exposure / 0.5 - 0.5), 0), 100)")
def rr_nearest(spark, sf):
    f = flagged_panel(spark, sf)
    return rounded(f.select("region", "date", burden.nearest_value(F.col("exposure"), 0.0, 0.5, CURVE).alias("rr")))


SUMS_SQL = """CAST(count(*) AS BIGINT) AS n_days, CAST(sum(deaths) AS BIGINT) AS total_deaths, round(sum(CASE WHEN is_heat THEN an ELSE 0 END), 4) AS heat_an, round(sum(CASE WHEN is_cold THEN an ELSE 0 END), 4) AS cold_an,
round(sum(CASE WHEN is_extreme_heat THEN an ELSE 0 END), 4) AS extreme_heat_an, round(sum(CASE WHEN is_extreme_cold THEN an ELSE 0 END), 4) AS extreme_cold_an, round(sum(CASE WHEN is_heat_p99 THEN an ELSE 0 END), 4) AS heat_p99_an, round(sum(CASE WHEN is_cold_p1 THEN an ELSE 0 END), 4) AS cold_p1_an,
CAST(count(*) FILTER (is_heat) AS BIGINT) AS n_heat_days, CAST(count(*) FILTER (is_cold) AS BIGINT) AS n_cold_days, CAST(count(*) FILTER (is_extreme_heat) AS BIGINT) AS n_extreme_heat_days, CAST(count(*) FILTER (is_extreme_cold) AS BIGINT) AS n_extreme_cold_days, CAST(count(*) FILTER (is_heat_p99) AS BIGINT) AS n_heat_p99_days, CAST(count(*) FILTER (is_cold_p1) AS BIGINT) AS n_cold_p1_days,
round(sum(CASE WHEN is_heat THEN an ELSE 0 END) / nullif(sum(deaths), 0) * 100, 4) AS heat_af_pct, round(sum(CASE WHEN is_cold THEN an ELSE 0 END) / nullif(sum(deaths), 0) * 100, 4) AS cold_af_pct,
round(sum(CASE WHEN is_heat THEN an ELSE 0 END) / (count(*) / 365.25), 4) AS annual_heat_an, round(sum(CASE WHEN is_cold THEN an ELSE 0 END) / (count(*) / 365.25), 4) AS annual_cold_an, round(sum(CASE WHEN is_heat THEN an ELSE 0 END) + sum(CASE WHEN is_cold THEN an ELSE 0 END), 4) AS total_an"""


@query(FLAGS_SQL + RR_SQL + "SELECT region, " + SUMS_SQL + " FROM an GROUP BY region")
def attributable_region(spark, sf):
    return rounded(burden.burden_sums(attributable_rows(spark, sf), ["region"]), 4)


@query(FLAGS_SQL + RR_SQL + "SELECT CAST(year(date) AS INTEGER) AS year, " + SUMS_SQL + " FROM an GROUP BY 1")
def attributable_annual(spark, sf):
    return rounded(burden.burden_sums(attributable_rows(spark, sf).withColumn("year", F.year("date")), ["year"]), 4)


@query(FLAGS_SQL + RR_SQL + "SELECT " + SUMS_SQL + " FROM an")
def attributable_national(spark, sf):
    return rounded(burden.burden_sums(attributable_rows(spark, sf), []), 4)


@query(FLAGS_SQL + RR_SQL + "SELECT region, CAST(sum(deaths) AS BIGINT) AS total_deaths, round(sum(CASE WHEN is_heat THEN an ELSE 0 END), 4) AS heat_an, round(sum(CASE WHEN is_cold THEN an ELSE 0 END), 4) AS cold_an FROM an GROUP BY ROLLUP (region)")
def attributable_rollup(spark, sf):
    return rounded(burden.region_and_national(attributable_rows(spark, sf), "region"), 4)


AGES_SQL = ", ages AS (SELECT CAST(o_custkey % 120 AS INTEGER) AS age, CAST(count(*) AS BIGINT) AS weight FROM ev GROUP BY 1), "


def life_table(spark) -> DataFrame:
    return spark.range(0, 91).select(F.col("id").cast("int").alias("age"), (80 - 0.85 * F.col("id")).alias("ex_mean"))


def mean_expectancy(spark, sf) -> DataFrame:
    ages = records(spark, sf).groupBy((F.col("o_custkey") % 120).cast("int").alias("age")).agg(F.count(F.lit(1)).alias("weight"))
    return burden.weighted_expectancy(ages.withColumnRenamed("age", "a"), life_table(spark), "a")


@query(FLAGS_SQL + RR_SQL + AGES_SQL + """e AS (SELECT sum(weight * (80 - 0.85 * least(age, 90))) / sum(weight) AS ex FROM ages),
b AS (SELECT region, count(*) / 365.25 AS n_years, sum(CASE WHEN is_heat THEN an ELSE 0 END) AS heat_an, sum(CASE WHEN is_cold THEN an ELSE 0 END) AS cold_an FROM an GROUP BY region)
SELECT region, round(heat_an * ex, 4) AS yll_heat, round(cold_an * ex, 4) AS yll_cold, round(heat_an * ex + cold_an * ex, 4) AS yll_total, round((heat_an * ex + cold_an * ex) / n_years, 4) AS annual_yll_total FROM b, e""")
def yll_region(spark, sf):
    return rounded(yll_rows(spark, sf).select("region", "yll_heat", "yll_cold", "yll_total", "annual_yll_total"), 4)


def yll_rows(spark, sf) -> DataFrame:
    sums = burden.burden_sums(attributable_rows(spark, sf), ["region"]).withColumn("n_years", F.col("n_days") / 365.25)
    return burden.years_of_life_lost(sums.join(F.broadcast(mean_expectancy(spark, sf))), F.col("ex"))


@query(FLAGS_SQL + RR_SQL + AGES_SQL + """e AS (SELECT sum(weight * (80 - 0.85 * least(age, 90))) / sum(weight) AS ex FROM ages),
b AS (SELECT region, sum(CASE WHEN is_heat THEN an ELSE 0 END) * any_value(ex) + sum(CASE WHEN is_cold THEN an ELSE 0 END) * any_value(ex) AS y FROM an, e GROUP BY region) SELECT region, round(y, 4) AS yll_total FROM b ORDER BY y DESC, region LIMIT 3""")
def top_regions(spark, sf):
    return rounded(burden.top_regions(yll_rows(spark, sf), n=3).select("region", "yll_total"), 4)


@query("WITH o AS (SELECT o_orderkey, CAST(o_custkey % 120 + 0.5 AS DOUBLE) AS a FROM orders) SELECT o_orderkey, round(CAST(80 AS DOUBLE) - CAST(0.85 AS DOUBLE) * least(greatest(a, 0), 90), 6) AS ex FROM o", cte=False)
def life_table_interpolation(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 120 + 0.5).alias("a"))
    return rounded(burden.interpolate_table(o, "a", life_table(spark), "age", "ex_mean", "ex").select("o_orderkey", "ex"))


@query("SELECT CAST(p_size AS INTEGER) AS age, round(avg(p_retailprice), 6) AS ex_mean, min(p_retailprice) AS ex_min, max(p_retailprice) AS ex_max, count(DISTINCT p_brand) AS n_years FROM part GROUP BY 1", cte=False)
def life_table_lookup(spark, sf):
    return rounded(burden.life_table_lookup(table(spark, sf, "part").select(F.col("p_size").alias("age"), F.col("p_retailprice").alias("ex"), F.col("p_brand").alias("year"))))


@query("""SELECT band, round(avg(e), 6) AS ex, round(arg_min(m, p_brand), 6) AS age_midpoint FROM (SELECT CASE WHEN p_size >= 40 THEN '40+' WHEN p_size >= 20 THEN '20-39' WHEN p_size >= 1 THEN '1-19' END AS band, p_brand, avg(p_retailprice) AS e, median(p_size) AS m FROM part GROUP BY ALL) WHERE band IS NOT NULL GROUP BY band""", cte=False)
def life_table_bands(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_size").alias("age"), F.col("p_retailprice").alias("ex"), F.col("p_brand").alias("year"))
    return rounded(burden.life_table_bands(p, parse.age_band("age", (1, 20, 40), "40+")))


# Matched sets


@query(""", cs AS (SELECT o_orderkey, date, strftime(date, '%Y%m') || isodow(date) AS s FROM ev), dy AS (SELECT DISTINCT date, strftime(date, '%Y%m') || isodow(date) AS s FROM ev)
SELECT o_orderkey, dy.date, CAST(dy.date = cs.date AS INTEGER) AS is_case FROM cs JOIN dy USING (s) WHERE s IN (SELECT s FROM dy GROUP BY s HAVING count(*) > 2)""")
def matched_sets(spark, sf):
    r = records(spark, sf)
    return matched.matched_sets(r, r.select("date").distinct(), "o_orderkey").select("o_orderkey", "date", "is_case")


@query(""", cs AS (SELECT o_orderkey, date, strftime(date, '%Y%m') || isodow(date) AS s FROM ev), dy AS (SELECT DISTINCT date, strftime(date, '%Y%m') || isodow(date) AS s FROM ev),
m AS (SELECT o_orderkey, dy.date, CAST(dy.date = cs.date AS INTEGER) AS is_case FROM cs JOIN dy USING (s) WHERE s IN (SELECT s FROM dy GROUP BY s HAVING count(*) > 2))
SELECT CAST(sum(is_case) AS BIGINT) AS n_cases, CAST(sum(1 - is_case) AS BIGINT) AS n_controls, round(sum(1 - is_case) / sum(is_case), 6) AS controls_per_case FROM m""")
def matched_summary(spark, sf):
    r = records(spark, sf)
    return rounded(matched.matched_summary(matched.matched_sets(r, r.select("date").distinct(), "o_orderkey")))


@query("SELECT strftime(date, '%Y_') || CAST(month(date) AS VARCHAR) || '_' || CAST(isodow(date) AS VARCHAR) AS stratum, CAST(count(DISTINCT date) AS INTEGER) AS n_dates, min(date) AS first_date FROM ev GROUP BY 1")
def stratum_dates(spark, sf):
    return matched.stratum_dates(records(spark, sf).select("date").distinct()).select("stratum", F.size("dates").alias("n_dates"), F.col("dates")[0].alias("first_date"))


# Pooling

STUDY_SQL = ", st AS (SELECT nation, region, avg(ln(o_totalprice)) AS y, var_samp(ln(o_totalprice)) / count(*) AS v FROM ev GROUP BY ALL HAVING count(*) > 5), "
POOL_SQL = STUDY_SQL + """f AS (SELECT region, CAST(count(*) AS BIGINT) AS k, sum(1 / v) AS w, sum(y / v) AS wy, sum(1 / (v * v)) AS ww FROM st GROUP BY region),
q AS (SELECT st.region, sum(pow(y - wy / w, 2) / v) AS q FROM st JOIN f ON st.region = f.region GROUP BY 1),
t AS (SELECT f.*, q, CASE WHEN k > 1 AND w - ww / w > 0 THEN greatest(0, (q - (k - 1)) / (w - ww / w)) ELSE 0 END AS tau2 FROM f JOIN q ON f.region = q.region),
r AS (SELECT st.region, sum(y / (v + tau2)) / sum(1 / (v + tau2)) AS random, sqrt(1 / sum(1 / (v + tau2))) AS random_se FROM st JOIN t ON st.region = t.region GROUP BY 1) """


def studies(spark, sf) -> DataFrame:
    p = F.log("o_totalprice")
    return records(spark, sf).groupBy("nation", "region").agg(F.avg(p).alias("y"), (F.var_samp(p) / F.count(F.lit(1))).alias("v"), F.count(F.lit(1)).alias("_n")).filter("_n > 5").drop("_n")


@query(POOL_SQL + "SELECT region, k, round(wy / w, 6) AS fixed, round(sqrt(1 / w), 6) AS fixed_se FROM t")
def pool_fixed(spark, sf):
    return rounded(pooling.pool(studies(spark, sf), ["region"]).select("region", "k", "fixed", "fixed_se"))


@query(POOL_SQL + "SELECT t.region, round(random, 6) AS random, round(random_se, 6) AS random_se, round(tau2, 6) AS tau2 FROM t JOIN r ON t.region = r.region")
def pool_dersimonian_laird(spark, sf):
    return rounded(pooling.pool(studies(spark, sf), ["region"]).select("region", "random", "random_se", "tau2"))


@query(POOL_SQL + "SELECT region, round(q, 5) AS q, CAST(k - 1 AS BIGINT) AS df, round(greatest(0, (q - (k - 1)) / q * 100), 5) AS i2, round(q / (k - 1), 5) AS h2 FROM t")
def heterogeneity(spark, sf):
    return rounded(pooling.heterogeneity(pooling.pool(studies(spark, sf), ["region"])).select("region", "q", "df", "i2", "h2"), 5)


@query(STUDY_SQL + "a AS (SELECT region, o_orderstatus AS s, avg(ln(o_totalprice)) AS y, stddev_samp(ln(o_totalprice)) / sqrt(count(*)) AS se FROM ev GROUP BY ALL) SELECT a.region, round(a.y - b.y, 6) AS diff, round(sqrt(a.se * a.se + b.se * b.se), 6) AS diff_se, round((a.y - b.y) / sqrt(a.se * a.se + b.se * b.se), 5) AS z, round(exp(a.y - b.y), 6) AS rr_ratio FROM a JOIN a b ON a.region = b.region AND a.s = 'F' AND b.s = 'O'")
def stratum_difference(spark, sf):
    p = F.log("o_totalprice")
    s = records(spark, sf).groupBy("region", F.col("o_orderstatus").alias("s")).agg(F.avg(p).alias("y"), (F.stddev_samp(p) / F.sqrt(F.count(F.lit(1)))).alias("se"))
    out = pooling.stratum_difference(s, ["region"], "s", "F", "O")
    return out.select("region", *[F.round(c, 6).alias(c) for c in ("diff", "diff_se")], F.round("z", 5).alias("z"), F.round("rr_ratio", 6).alias("rr_ratio"))


HORIZON_SQL = ", rr AS (SELECT region, CAST(year(date) % 2 * 28 + 7 AS INTEGER) AS lags, avg(exposure) / 24 AS rr FROM p GROUP BY ALL) "
RR_BY_SQL = ", rr AS (SELECT region, CAST(year(date) - 1995 AS INTEGER) AS lags, avg(exposure) / 25 AS rr FROM p GROUP BY ALL) "


def rr_by(spark, sf, label, scale: float) -> DataFrame:
    """Stand-ins for relative risks: mean exposures of all days, by region and a label of the year."""
    return panel(spark, sf).groupBy("region", label.alias("lags")).agg((F.avg("exposure") / scale).alias("rr"))


@query(HORIZON_SQL + "SELECT region, round(max(CASE WHEN lags = 7 THEN rr - 1 END), 6) AS err_short, round(max(CASE WHEN lags = 35 THEN rr - 1 END), 6) AS err_long, round(1 - max(CASE WHEN lags = 35 THEN rr - 1 END) / nullif(max(CASE WHEN lags = 7 THEN rr - 1 END), 0), 4) AS harvesting FROM rr GROUP BY region")
def harvesting_ratio(spark, sf):
    h = pooling.harvesting_ratio(rr_by(spark, sf, F.year("date") % 2 * 28 + 7, 24), ["region"])
    return h.select("region", F.round("err_short", 6).alias("err_short"), F.round("err_long", 6).alias("err_long"), F.round("harvesting", 4).alias("harvesting"))


@query(RR_BY_SQL + "SELECT a.region, a.lags, round(a.rr, 6) AS rr, round((a.rr - b.rr) / b.rr * 100, 5) AS pct_change FROM rr a JOIN rr b ON a.region = b.region AND b.lags = 0 WHERE a.lags <> 0")
def model_comparison(spark, sf):
    out = pooling.compare_models(rr_by(spark, sf, F.year("date") - 1995, 25), 0, ["region"], "lags")
    return out.select("region", "lags", F.round("rr", 6).alias("rr"), F.round("pct_change", 5).alias("pct_change"))


# Excess, given an expected count


EXP_SQL = ", e AS (SELECT *, avg(deaths) OVER (PARTITION BY region, month(date)) AS expected FROM fl) "


def expected_panel(spark, sf) -> DataFrame:
    f = flagged_panel(spark, sf).withColumn("m", F.month("date"))
    return f.join(f.groupBy("region", "m").agg(F.avg("deaths").alias("expected")), ["region", "m"]).drop("m")


@query(FLAGS_SQL + EXP_SQL + """, k AS (SELECT unnest(list_filter(['all', CASE WHEN is_heat THEN 'heat' END, CASE WHEN is_cold THEN 'cold' END, CASE WHEN is_extreme_heat THEN 'extreme_heat' END, CASE WHEN is_near_optimal THEN 'near_optimal' END], lambda z: z IS NOT NULL)) AS class, deaths AS d, expected AS e, deaths - expected AS x FROM e)
SELECT class, CAST(count(*) AS BIGINT) AS n_days, CAST(sum(d) AS BIGINT) AS total_deaths, round(sum(e), 3) AS total_expected, round(avg(x), 4) AS mean_excess, round(stddev_samp(x) / sqrt(count(x)), 5) AS se_excess FROM k GROUP BY class""")
def excess_by_class(spark, sf):
    classes = {"heat": F.col("is_heat"), "cold": F.col("is_cold"), "extreme_heat": F.col("is_extreme_heat"), "near_optimal": F.col("is_near_optimal")}
    out = excess.excess_by_class(expected_panel(spark, sf), classes)
    return out.select("class", "n_days", "total_deaths", F.round("total_expected", 3).alias("total_expected"), (F.round("mean_excess", 4) + 0.0).alias("mean_excess"), F.round("se_excess", 5).alias("se_excess"))


@query(FLAGS_SQL + EXP_SQL + "SELECT CAST(year(date) AS INTEGER) AS year, CAST(sum(deaths) AS BIGINT) AS total_deaths, round(sum(expected), 3) AS total_expected, round(sum(CASE WHEN is_heat THEN deaths - expected ELSE 0 END), 3) AS heat_excess FROM e GROUP BY 1")
def annual_excess(spark, sf):
    out = excess.annual_excess(expected_panel(spark, sf), {"heat": F.col("is_heat")})
    return out.select("year", "total_deaths", F.round("total_expected", 3).alias("total_expected"), F.round("heat_excess", 3).alias("heat_excess"))


@query("""SELECT CAST(year(date) AS INTEGER) AS year, region, CAST(sum(deaths) AS BIGINT) AS deaths FROM d GROUP BY ALL""")
def merge_increment(spark, sf):
    yearly = deaths(spark, sf).groupBy(F.year("date").alias("year"), "region").agg(F.sum("deaths").alias("deaths"))
    old = yearly.filter("year < 1999").withColumn("source", F.lit("a")).unionByName(yearly.filter("year >= 1999").withColumns({"source": F.lit("b"), "deaths": F.col("deaths") * 2}))
    new = yearly.filter("year >= 1999").withColumn("source", F.lit("b")).withColumnRenamed("deaths", "n")
    return io.merge_increment(old, new, ["year", "region"], ["deaths"], {"n": "deaths"}, "source").drop("source")


@query("""SELECT CAST(year(date) AS INTEGER) AS year, region, CAST(sum(deaths) AS BIGINT) AS deaths FROM d GROUP BY ALL""")
def upsert_increment(spark, sf):
    """A dataset by source and year takes a wrong increment, then the right one, twice; it is kept beside the checkpoints."""
    daily = cut(deaths(spark, sf).select(F.year("date").alias("year"), "region", "deaths", F.when(F.year("date") < 1999, "a").otherwise("b").alias("source")))
    path = f"{spark.sparkContext.getCheckpointDir()}/upsert-{uuid.uuid4().hex}"
    new = daily.filter("source = 'b'").withColumnRenamed("deaths", "n")
    for part in (daily.withColumn("deaths", F.when(F.col("source") == "b", F.col("deaths") * 2).otherwise(F.col("deaths"))), new, new):
        io.upsert(part, path, ["year", "region"], ["deaths"], {"n": "deaths"})
    return io.read_upserted(spark, path, ["year", "region"], ["deaths"])


# Models (no SQL: fitted by iteration)


def exposure_spline(df: DataFrame, inner: tuple[float, ...] = (0.1, 0.75, 0.9)) -> NaturalSpline:
    """Knots at global quantiles, boundary at the range: a few numbers on the driver."""
    return spline_at(stats.selected_quantiles(df, "exposure", [0.0, *inner, 1.0]), inner)


def spline_at(q: list[float | None], inner: tuple[float, ...]) -> NaturalSpline:
    low, *knots, high = q if None not in q else [0.0, *[50.0 * v for v in inner], 50.0]
    return NaturalSpline((low, high), tuple(sorted(set(knots) - {low, high})) or ((low + high) / 2,))


def fitted_regions(spark, sf) -> tuple[DataFrame, NaturalSpline]:
    p = panel(spark, sf)
    spline = exposure_spline(p)
    return dlnm.fit_regions(dlnm.cross_basis(p, "exposure", spline), spline), spline


def nation_panel(spark, sf) -> DataFrame:
    """Nations as regions: their days without events count, days without an exposure don't."""
    daily = P.count_events(records(spark, sf).drop("region").withColumnRenamed("nation", "region"), ["region", "date"])
    lines = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), F.to_date("l_shipdate").alias("date"), "l_quantity")
    supplier = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("region"))
    exposed = lines.join(supplier, "s_suppkey").groupBy("region", "date").agg(F.avg("l_quantity").alias("exposure"))
    return P.join_panels(P.densify(daily, fill=["deaths"]), exposed)


def fitted_nations(spark, sf) -> tuple[DataFrame, NaturalSpline, DataFrame]:
    """(fits, spline, panel) of nations."""
    p = nation_panel(spark, sf)
    spline = exposure_spline(p)
    return dlnm.fit_models(p, {"main": dlnm.Model(spline)}).drop("model"), spline, p


def pooled_fit(fits: DataFrame) -> DataFrame:
    """The pool of at least ten settled fits; empty where there are fewer, or where it doesn't settle."""
    return pooling.pool_multivariate(fits.filter("status = 'success'"), []).filter("coef is not null")


@query()
def dlnm_region_fit(spark, sf):
    return fitted_regions(spark, sf)[0]


@query()
def dlnm_pooled_curve(spark, sf):
    fits, spline, _ = fitted_nations(spark, sf)
    low, high = spline.boundary
    return dlnm.predict_rr(pooled_fit(fits), spline, stats.grid(low, (high - low) / 99, 100), F.lit((low + high) / 2)).select("at", "rr", "rr_lo", "rr_hi")


#: The main model at other lags, and exposure df x lag df with knots at equally spaced quantiles.
GRID = [(lags, "main", 4) for lags in (7, 14, 21, 28)] + [(21, f"df{e}", k) for e in (3, 4, 5) for k in (3, 4, 5)]


@query()
def sensitivity_grid(spark, sf):
    p = panel(spark, sf)
    knots = {"main": (0.1, 0.75, 0.9)} | {f"df{e}": tuple(k / e for k in range(1, e)) for e in (3, 4, 5)}
    places = sorted({0.0, 1.0, *(v for k in knots.values() for v in k)})
    at = dict(zip(places, stats.selected_quantiles(p, "exposure", places)))
    splines = {name: spline_at([at[0.0], *[at[v] for v in k], at[1.0]], k) for name, k in knots.items()}
    return dlnm.fit_grid(p, splines, GRID).drop("coef", "vcov")


@query()
def stratum_fits(spark, sf):
    """Fits by region and stratum in one job."""
    counts = P.count_events(records(spark, sf).withColumnRenamed("o_orderstatus", "stratum"), ["region", "stratum", "date"])
    p = counts.join(exposure(spark, sf), ["region", "date"])
    spline = exposure_spline(p)
    return dlnm.fit_regions(dlnm.cross_basis(p, "exposure", spline, by=("region", "stratum")), spline, ("region", "stratum")).drop("coef", "vcov")


@query()
def heatwave_effect(spark, sf):
    p = ts.attach_quantiles(panel(spark, sf), "exposure", {"p95": 0.95})
    p = ts.runs(p, F.col("exposure") > F.col("p95"), ["region"], min_length=3).withColumn("heatwave", F.col("in_run").cast("double"))
    spline = exposure_spline(p)
    fits = dlnm.fit_regions(dlnm.cross_basis(p, "exposure", spline), spline, extra=("heatwave",))
    pooled = pooling.pool(pooling.valid_estimates(fits.select(F.lit("all").alias("analysis"), F.col("extra_log_rr").alias("y"), (F.col("extra_se") * F.col("extra_se")).alias("v"))), ["analysis"])
    return pooled.withColumn("rr", F.exp("random"))


@query()
def adjusted_models(spark, sf):
    """Main model, with a splined pollutant, with a linear one."""
    p = panel(spark, sf)
    e = table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(F.avg("l_discount").alias("pm25"), F.avg("l_tax").alias("flu"))
    p = p.join(e, "date", "left")
    spline = exposure_spline(p)
    models = {"main": dlnm.Model(spline), "pm25": dlnm.Model(spline, splined=("pm25",)), "flu": dlnm.Model(spline, extra=("flu",))}
    return dlnm.fit_models(p, models).select("model", "region", "status", "rr_p99", "rr_p1")


def burden_draws(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(draws, panel): burden of the pooled curve against its own minimum; without a pooled curve there are no days to burden."""
    import numpy as np

    fits, spline, p = fitted_nations(spark, sf)
    q = [v or 0.0 for v in stats.selected_quantiles(p, "exposure", list(CUTS.values()))]
    cuts = dict(zip(CUTS, q))
    pooled = pooled_fit(fits).first()
    if pooled is None:
        p, coef, vcov, centre = p.limit(0), np.zeros(spline.df), np.zeros((spline.df, spline.df)), q[0]
    else:
        coef = np.array(pooled["coef"])
        vcov = np.array(pooled["vcov"]).reshape(len(coef), len(coef))
        centre, _ = dlnm.minimum_risk(coef, vcov, spline, cuts["p1"], cuts["p99"], 21, 4)
        coef, vcov = dlnm.reduce_over_lags(coef, vcov, spline.df, 21, 4)
    return burden.monte_carlo(p, coef, vcov, spline, centre, cuts), p


@query()
def monte_carlo_burden(spark, sf):
    return burden.interval_summary(burden_draws(spark, sf)[0], list(burden.METRICS))


@query()
def burden_intervals(spark, sf):
    """The seven metrics as sums, yearly means and percentages of all deaths, with their intervals."""
    draws, p = burden_draws(spark, sf)
    about = p.agg(F.sum("deaths").alias("n"), F.count_distinct("date").alias("days")).first()
    return burden.interval_metrics(draws, float(about["n"] or 0), about["days"] / 365.25)


@query()
def conditional_logit(spark, sf):
    p = dense_panel(spark, sf)
    fit = matched.conditional_logit(matched.stratum_counts(p, "deaths", ["exposure"], by=["region"]), ["exposure"])
    return spark.createDataFrame([("exposure", float(fit["beta"][0]), float(fit["se"][0]), int(fit["iterations"]), float(fit["n_cases"]))], "term string, log_or double, se double, iterations int, n_cases double")


@query()
def conditional_logit_extremes(spark, sf):
    p = ts.attach_quantiles(dense_panel(spark, sf), "exposure", {"low": 0.05, "high": 0.95})
    p = p.withColumns({"is_low": (F.col("exposure") <= F.col("low")).cast("double"), "is_high": (F.col("exposure") > F.col("high")).cast("double")})
    fit = matched.conditional_logit(matched.stratum_counts(p, "deaths", ["is_low", "is_high"], by=["region"]), ["is_low", "is_high"])
    return spark.createDataFrame([(t, float(b), float(s)) for t, b, s in zip(("is_low", "is_high"), fit["beta"], fit["se"])], "term string, log_or double, se double")


@query()
def meta_regression(spark, sf):
    s = studies(spark, sf).join(nations(spark, sf), "nation")
    z = P.z_scores(s, ["pop", "wealth"])
    long = z.select(F.explode(F.array(*[F.struct(F.lit(m).alias("moderator"), F.col(f"{m}_z").alias("z0")) for m in ("pop", "wealth")])).alias("_m"), "y", "v").select("_m.*", "y", "v")
    return pooling.meta_regression(long, ["moderator"], "z0", min_studies=5)


@query()
def excess_baseline(spark, sf):
    series = P.national_series(dense_panel(spark, sf), "date", ["deaths"], "exposure")
    return excess.excess(excess.expected_baseline(series)).select("date", "deaths", "expected", "excess", "excess_pct")


@query(", s AS (SELECT o_orderkey, date, row_number() OVER (ORDER BY md5('42|' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS k, count(*) OVER () AS n FROM ev) SELECT o_orderkey, date FROM s WHERE k <= CASE WHEN n > 1000 THEN 500 ELSE n END")
def seeded_sample(spark, sf):
    """A sampling operator: 500 orders by a seeded hash."""
    return P.sample_rows(records(spark, sf).select("o_orderkey", "date"), "o_orderkey", 1000, 500)


# Filters, sets, labels


@query("SELECT o_orderkey, o_custkey AS code FROM orders WHERE o_orderkey % 50 >= 2 AND CAST(o_orderdate AS DATE) >= (SELECT min(CAST(o_orderdate AS DATE)) + 21 FROM orders)", cte=False)
def event_filters(spark, sf):
    """Events whose code is missing or above the sentinel go, and those without room for their lags."""
    invalid = F.when(F.col("o_orderkey") % 50 == 0, 999_999).when(F.col("o_orderkey") % 50 != 1, F.col("o_custkey"))
    o = table(spark, sf, "orders").withColumns({"date": F.to_date("o_orderdate"), "code": invalid})
    return P.valid_events(P.with_lag_room(o, 21), ["date", "code"], "code").select("o_orderkey", "code")


@query("WITH s AS (SELECT s_nationkey AS k FROM supplier GROUP BY 1 HAVING sum(s_acctbal) > (SELECT sum(s_acctbal) / count(DISTINCT s_nationkey) FROM supplier)) SELECT 'common' AS kind, k FROM (SELECT DISTINCT c_nationkey AS k FROM customer INTERSECT SELECT k FROM s) UNION ALL SELECT 'missing', k FROM (SELECT DISTINCT c_nationkey AS k FROM customer EXCEPT SELECT k FROM s)", cte=False)
def key_sets(spark, sf):
    """Nations of customers, and nations whose suppliers hold more than the nations' mean."""
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"))
    held = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.sum("s_acctbal").alias("held"))
    s = held.join(F.broadcast(held.agg(F.avg("held").alias("mean")))).filter("held > mean").select("k")
    return P.common_keys(c, s, "k").select(F.lit("common").alias("kind"), "k").unionByName(P.missing_keys(c, s, "k").select(F.lit("missing").alias("kind"), "k"))


@query("SELECT region, date, deaths FROM d WHERE region IN (SELECT n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 9000)")
def keep_regions(spark, sf):
    good = table(spark, sf, "supplier").filter("s_acctbal > 9000").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("region"))
    return P.keep_regions(deaths(spark, sf), good)


@query("SELECT round(median(p50), 6) AS p50, round(median(s), 6) AS exposure_sd FROM (SELECT region, quantile_cont(exposure, 0.5) AS p50, stddev_samp(exposure) AS s FROM p GROUP BY region)")
def median_of_regions(spark, sf):
    p = panel(spark, sf)
    q = p.groupBy("region").agg(F.median("exposure").alias("p50"), F.stddev_samp("exposure").alias("exposure_sd"))
    return rounded(P.median_of(q, ["p50", "exposure_sd"]))


@query("""WITH y AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders), h AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders WHERE month(o_orderdate) IN (2, 3) AND day(o_orderdate) % 2 = 0),
e AS (SELECT y, CASE y WHEN 1995 THEN DATE '1995-04-16' WHEN 1996 THEN DATE '1996-04-07' WHEN 1997 THEN DATE '1997-03-30' WHEN 1998 THEN DATE '1998-04-12' WHEN 1999 THEN DATE '1999-04-04' WHEN 2000 THEN DATE '2000-04-23' WHEN 2001 THEN DATE '2001-04-15' WHEN 2002 THEN DATE '2002-03-31' END AS e FROM y)
SELECT date, 'known' AS name FROM h UNION ALL SELECT d, 'carnival' FROM (SELECT CAST(e - k AS DATE) AS d FROM e, (SELECT unnest([47, 48, 49, 50]) AS k)) WHERE d NOT IN (SELECT date FROM h)""", cte=False)
def holidays_with_carnival(spark, sf):
    o = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date"))
    known = o.filter((F.month("date").isin(2, 3)) & (F.dayofmonth("date") % 2 == 0)).distinct().withColumn("name", F.lit("known"))
    extra = parse.carnival_days(o.select(F.year("date").alias("year")).distinct()).select("date", F.lit("carnival").alias("name"))
    return P.add_missing_days(known, extra)


@query("""SELECT p_partkey, CASE WHEN contains(lower(p_type), 'brass') THEN 'metal' WHEN contains(lower(p_type), 'anodized') THEN 'coated' ELSE 'civic' END AS kind,
CASE WHEN p_size < 10 THEN 'low' WHEN p_size < 25 THEN 'medium' WHEN p_size < 40 THEN 'high' ELSE 'very high' END AS level, p_size - 10 AS growth_abs, round((p_size - 10) * 100.0 / 10, 6) AS growth_rel,
CASE WHEN p_size / 50.0 - 0.5 > 0.2 THEN 'strong displacement' WHEN p_size / 50.0 - 0.5 > 0.05 THEN 'some displacement' WHEN p_size / 50.0 - 0.5 >= -0.05 THEN 'none' ELSE 'delayed effects' END AS harvesting,
CASE WHEN p_size < 5 THEN 'robust' WHEN p_size < 10 THEN 'slight' ELSE 'substantial' END AS attenuation, CASE WHEN p_size / 1000.0 < 0.001 THEN '***' WHEN p_size / 1000.0 < 0.01 THEN '**' WHEN p_size / 1000.0 < 0.05 THEN '*' ELSE '' END AS stars FROM part""", cte=False)
def labels_and_levels(spark, sf):
    p = table(spark, sf, "part").withColumn("ten", F.lit(10))
    grown = parse.growth("ten", "p_size")
    return p.select(
        "p_partkey", parse.match_pattern("p_type", [("brass", "metal"), ("anodized", "coated")], "civic").alias("kind"), parse.level_category("p_size", (10, 25, 40), ("low", "medium", "high", "very high")).alias("level"),
        grown["growth_abs"].alias("growth_abs"), F.round(grown["growth_rel"], 6).alias("growth_rel"), parse.harvesting_label(F.col("p_size") / 50 - 0.5).alias("harvesting"), parse.attenuation_label("p_size").alias("attenuation"), parse.stars(F.col("p_size") / 1000).alias("stars"),
    )


@query("""SELECT o_orderkey, coalesce(CASE CAST(o_custkey % 4 AS VARCHAR) WHEN '1' THEN 'SP' WHEN '2' THEN 'RJ' END, 'UNKNOWN') AS state, o_custkey % 7 = 1 AS is_influenza, o_custkey % 7 = 5 AS is_covid, o_custkey % 7 = 2 AS is_other_virus, o_orderkey % 5 IN (2, 3) AS is_death, o_custkey % 110 >= 60 AS is_elderly FROM orders""", cte=False)
def case_flags(spark, sf):
    o = table(spark, sf, "orders").withColumns({"c": F.col("o_custkey") % 7, "e": F.col("o_orderkey") % 5, "a": F.col("o_custkey") % 110})
    return o.select("o_orderkey", parse.lookup(F.col("o_custkey") % 4, {"1": "SP", "2": "RJ"}).alias("state"), *[c.alias(k) for k, c in parse.case_flags("c", "e", "a").items()])


@query()
def harvesting_fits(spark, sf):
    """Lag horizons that share the minimum-risk exposure of the longest one, and their harvesting ratio."""
    p = panel(spark, sf)
    spline = exposure_spline(p)
    longest = dlnm.fit_regions(dlnm.cross_basis(p, "exposure", spline, 35), spline, lags=35)
    p = p.join(longest.select("region", F.col("mmt").alias("centre")), "region", "left")
    fits = dlnm.fit_grid(p, {"main": spline}, [(lags, "main", 4) for lags in (7, 14, 21, 28, 35)], centre="centre")
    fits = fits.select("region", "lags", "status", "reason", "mmt", *[f"rr_{k}" for k in dlnm.PERCENTILES])
    ratios = pooling.harvesting_ratio(fits.filter("status = 'success'"), ["region"], value="rr_p99")
    return fits.join(ratios, "region", "left")
