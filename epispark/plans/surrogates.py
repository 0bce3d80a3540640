"""The driver's commercial tables in the roles of the panel model, as DataFrames and as SQL.

Event record: an order, by its customer's nation (municipality) and region. Exposure: mean quantity
by the supplier's region and the shipping day. Strata: priority (cause), status (sex), price (age).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epispark.operators import panel as P


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("date"), "o_orderpriority", "o_orderstatus", "o_totalprice")
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation"))
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    return orders.join(customer, "o_custkey").join(nation, "nation")


def deaths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.count_events(records(spark, sf_dir), ["region", "date"])


def exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), F.to_date("l_shipdate").alias("date"), "l_quantity")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"))
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    return lines.join(supplier, "s_suppkey").join(nation, "nation").groupBy("region", "date").agg(F.avg("l_quantity").alias("exposure"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.join_panels(deaths(spark, sf_dir), exposure(spark, sf_dir))


def dense_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.join_panels(P.densify(deaths(spark, sf_dir), fill=["deaths"]), exposure(spark, sf_dir))


CTE = """WITH ev AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS date, o_orderpriority, o_orderstatus, o_totalprice, n_nationkey AS nation, n_regionkey AS region
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
d AS (SELECT region, date, CAST(count(*) AS BIGINT) AS deaths FROM ev GROUP BY region, date),
x AS (SELECT n_regionkey AS region, CAST(l_shipdate AS DATE) AS date, avg(l_quantity) AS exposure
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2),
p AS (SELECT region, date, deaths, exposure FROM d JOIN x USING (region, date)),
grid AS (SELECT region, CAST(unnest(generate_series((SELECT min(date) FROM d), (SELECT max(date) FROM d), INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT DISTINCT region FROM d)),
dense AS (SELECT region, date, coalesce(deaths, 0) AS deaths FROM grid LEFT JOIN d USING (region, date)),
pd AS (SELECT region, date, deaths, exposure FROM dense JOIN x USING (region, date))
"""
